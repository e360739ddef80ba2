"""Exact dedup, line dedup and decontamination against brute force and SQL."""

import hashlib
import pickle
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textmart.llm import decontaminate, exact_dedup, line_dedup

LONG = "word " * 20_000


def write(folder, rows, files=1):
    """A table of documents with columns whose names the operators use themselves."""
    folder.mkdir()
    step = -(-len(rows) // files) or 1
    for i in range(files):
        part = rows[i * step:(i + 1) * step]
        pq.write_table(pa.table({
            "doc_id": pa.array([r[0] for r in part], pa.int64()), "text": pa.array([r[1] for r in part], pa.string()),
            "digest": pa.array(["x"] * len(part)), "kept": pa.array([None] * len(part), pa.bool_()),
            "hash": pa.array([1] * len(part), pa.int64()), "doc": pa.array([2] * len(part), pa.int64())}),
            folder / f"part-{i}.parquet")
    return str(folder)


TEXTS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, LONG), (8, LONG), (9, "b"), (9, "b"), (None, "a"),
         (None, "only")]


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""],
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("batch_files", [None, 1])
def test_exact_dedup_over_stream_batches(spark, tmp_path, batch_files):
    path = write(tmp_path / "t", TEXTS, files=4)
    found = exact_dedup.deduplicate(spark, path, batch_files=batch_files)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected_groups(TEXTS)


def test_exact_dedup_checks_full_bytes_when_digests_collide(spark, tmp_path):
    path = write(tmp_path / "t", TEXTS, files=2)
    found = exact_dedup.deduplicate(spark, path, digest=lambda t: F.length(t).cast("string").cast("binary"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected_groups(TEXTS)


def test_exact_dedup_state_goes_on_with_new_files(spark, tmp_path):
    path = write(tmp_path / "t", TEXTS[:6])
    schema = spark.read.parquet(path).schema

    def state():
        stream = exact_dedup.read_stream(spark, path, schema)
        return {r["keep_id"]: (r["group_size"], r["file"]) for r in
                exact_dedup.keyed_state(stream, str(tmp_path / "state"), "doc_id", "text").collect()}

    assert state()[3][0] == 2
    pq.write_table(pa.table({c: pa.array([v], t) for c, v, t in (
        ("doc_id", 50, pa.int64()), ("text", "a", pa.string()), ("digest", "", pa.string()), ("kept", None, pa.bool_()),
        ("hash", 0, pa.int64()), ("doc", 0, pa.int64()))}), tmp_path / "t" / "later.parquet")
    after = state()
    assert after[50][0] == 3 and after[50][1].endswith("later.parquet") and 3 not in after


def test_exact_dedup_empty_table(spark, tmp_path):
    assert exact_dedup.deduplicate(spark, write(tmp_path / "t", [])).count() == 0


def test_exact_dedup_main_path_is_native(spark, tmp_path):
    found = exact_dedup.deduplicate(spark, write(tmp_path / "t", TEXTS))
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- line dedup ---

LINES = [
    (5, "shared line one\nown five\nshared line one"), (2, "Shared LINE one \nx\nx"), (7, "x\n\tshared line one\nown seven"),
    (8, None), (9, ""), (10, "shared line two"), (11, "shared line two\n"), (None, "shared line two\nnone of it"),
    (12, "ééééééééé\nééééééééé"), (13, "ééééééééé\nêêêêêêêêêê"), (14, "êêêêêêêêêê"), (15, LONG + "\n" + LONG), (16, LONG),
    (17, "same doc twice!\nrest"), (17, "same doc twice!\nother"),
]


def brute_lines(rows):
    keys = lambda t: [re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n")]
    order = lambda i: (i is None, i)
    owners = {}
    for i, t in rows:
        for k in keys(t):
            if len(k) >= 10 and (k not in owners or order(i) < order(owners[k])):
                owners[k] = i
    out = []
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if owners.get(k, i) == i]
        n = len((t or "").split("\n"))
        out.append((i, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 3), (5, 2)])
def test_line_dedup_is_the_same_for_any_runs(spark, tmp_path, batches, fanout):
    docs = spark.read.parquet(write(tmp_path / "t", LINES, files=3))
    found = line_dedup.digests(docs, batches=batches, fanout=fanout)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_lines(LINES)


def test_line_dedup_keeps_rows_and_columns(spark, tmp_path):
    docs = spark.read.parquet(write(tmp_path / "t", LINES))
    kept = line_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(LINES)
    assert {r["doc"] for r in kept.collect()} == {2}
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[7] == "x\nown seven" and texts[10] == "shared line two" and texts[16] == "" and texts[8] == ""


def test_line_runs_are_compacted(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for doc in range(5):
        keys = spark.createDataFrame([(doc, bytes([h])) for h in (0, doc, doc + 1)], "doc long, hash binary")
        lost = {bytes(r["hash"])[0] for r in runs.add(keys).collect()}
        assert lost == ({0, doc} if doc else set()), doc
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert spark.table(runs.levels[2][0]).count() == 5
    runs.close()


def test_line_dedup_empty_table(spark, tmp_path):
    docs = spark.read.parquet(write(tmp_path / "t", []))
    assert line_dedup.digests(docs).count() == 0 and line_dedup.deduplicate(docs).count() == 0


# --- decontamination ---

ITEM = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, ITEM), (2, "tiny item"), (3, None), (4, "..."), (5, "é1 b2"), (1, ITEM + " thirteen"), (None, "nameless item here"),
         (6, "a a a a a a a a a a a a")]
DOCS = [(1, "xx " + ITEM.upper() + " yy"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""),
        (5, "a TINY, item; tiny é1-b2!"), (6, "a " * 30 + "end"), (None, "nameless item here"), (7, LONG + ITEM + " thirteen x"),
        (8, "..."), (1, "two three four five six seven eight nine ten eleven twelve thirteen")]


def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault((n, *w[s:s + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, held = words(t), set(), set()
        for n in {k[0] for k in windows}:
            for s in range(len(w) - n + 1):
                for item in windows.get((n, *w[s:s + n]), ()):
                    held.add(item)
                    hit.update(range(s, s + n))
        out.append((i, len(w), len(hit), ",".join(sorted(held))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes,items", [(1 << 20, ITEMS), (60, ITEMS), (1 << 20, ITEMS[:1] + ITEMS[5:6])])
def test_decontamination_in_any_blocks(spark, tmp_path, block_bytes, items):
    docs = spark.read.parquet(write(tmp_path / "t", DOCS))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_matches(docs, bench, block_bytes=block_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in found), key=str) == \
        brute_contamination(DOCS, items)
    clean = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert clean.count() == sum(r[2] == 0 for r in brute_contamination(DOCS, items))


def test_longest_matches_and_places(spark, tmp_path):
    docs = spark.read.parquet(write(tmp_path / "t", DOCS))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {r["doc_id"]: r["matches"] for r in decontaminate.find_matches(docs, bench).where("doc_id = 7").collect()}
    assert [(m["start"], m["n_words"], m["item_id"], m["item_start"]) for m in rows[7]] == [(20_000, 13, "1", 0)]


def test_longest_matches_take_room_in_proportion_to_the_items():
    rng = range(3000)
    text = " ".join(f"w{k * k % 1013}x{k}" for k in rng).encode()
    queries = decontaminate.prepare([("long", text), ("other", b"z " + text[:200])])
    assert len(pickle.dumps(queries)) < 400 * len(rng)
    part = b" ".join(text.split()[100:400])
    assert decontaminate.scan([b"q " + part + b" q"], queries)[0][3] == [(1, 300, "long", 100)]
    plain = decontaminate.prepare([("long", text)], longest=False)
    assert plain.order is None and decontaminate.scan([part], plain)[0][1:] == ([(0, 300)], ["long"], [])


def test_decontamination_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(write(tmp_path / "t", DOCS))
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).count() == len(DOCS)
    assert {r["n_hit"] for r in decontaminate.find_matches(docs, bench).collect()} == {0}
    assert decontaminate.find_matches(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
