"""SimHash near duplicates, components, secrets and chat formatting against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from textmart.llm import chat, secrets, simhash
from textmart.llm.components import components


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(fps):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def near_texts():
    rng = random.Random(3)
    rows, n = [], 0
    for family in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 60, 300]))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(words)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(9)}"
            rows.append((n, " ".join(copy)))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "A b"), (n + 4, "a B"), (n + 5, "z " * 20_000)]


@pytest.mark.parametrize("tile", [1 << 15, 3])
def test_simhash_components(spark, tile):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, fp long, doc string")
    found = simhash.near_duplicates(docs, tile=tile)
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(fps)
    got = {r["doc"]: (r["fp"] & (2 ** 64 - 1), r["component"]) for r in found.collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert found.select(simhash.hex_of("fp")).first()[0] == f"{got[found.first()['doc']][0]:016x}"
    kept = simhash.deduplicate(docs, tile=tile)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_simhash_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "q r s t u v")],
                                 "doc_id long, text string")
    kept = simhash.deduplicate(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "3"]
    assert simhash.near_duplicates(docs).count() == 4
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.deduplicate(docs.limit(0)).count() == 0


def test_links_lose_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (40, 6), dtype=np.uint64))
    every = np.unique(np.concatenate([base, *(np.bitwise_xor.reduce(flips[:, :k], axis=1) ^ base for k in (1, 3, 5, 6))]))
    a, b = every[::2].copy(), every[1::2].copy()
    for u, v, one, two in ((*simhash.links_of(every, every), every, every), (*simhash.links_of(a, b, block=64), a, b)):
        label = {int(x): int(x) for x in every}
        def root(x):
            while label[x] != x:
                x = label[x]
            return x
        for x, y in zip(u.tolist(), v.tolist()):
            label[root(x)] = root(y)
        near = np.bitwise_count(one[:, None] ^ two[None, :]) <= 4
        for i, j in np.argwhere(near):
            assert root(int(one[i])) == root(int(two[j]))
        assert len(u) < len(every)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert found == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- secrets ---

ID, KEY = "AKIA" + "ABCDEFGH12345678", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
SECRETS = [
    (1, 'é password = "hunter22" and API_KEY: abc'), (2, "secret=token=abcdef token: 12345 TOKEN:123456"),
    (3, f"id {ID} x AKIASHORT {ID}"), (4, "0123456789abcdef0123456789abcdef g 0123456789abcdef01234567"), (5, None), (6, ""),
    (7, "secret=token: abcdef"), (8, f"{ID}\nkey {KEY}\nhttps://store.example/x\n"), (9, f"key {KEY} alone https://h.example"),
    (10, f"{ID}\n\n{KEY}"), (11, f"{ID} " + "far " * 200 + KEY), (12, "paſſword=abcdefgh ToKen=éabcdef"), (13, "x" * 300_000),
    (1, f"{KEY} {ID}"),
]


def brute_base(text):
    text, found = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_base_and_links(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in SECRETS], "doc_id long, text string, kinds string")
    rows = secrets.digest(secrets.scan(docs)).collect()
    got = sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows)
    want = []
    for i, t in SECRETS:
        base = brute_base(t)
        told = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((i, *(sum(b[1] == k for b in base) for k in range(3)), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(want)
    spans = {r["doc_id"]: r["spans"] for r in rows if r["doc_id"] != 1}
    assert "linked_secret" in spans[8] and "linked_endpoint" in spans[8] and spans[9] == ""
    assert "linked" not in spans[10] and "linked" not in spans[11]
    assert secrets.scan(docs.limit(0)).count() == 0


def test_weak_identifier_needs_a_secret():
    assert not secrets.spans_of("login: someone\nhttps://host.example/a")
    kinds = [s[2] for s in secrets.spans_of(f"login: someone\n{KEY}\nhttps://host.example/a")]
    assert kinds == ["linked_identifier", "linked_secret", "linked_endpoint"]


def test_interval_join_is_the_plain_one():
    rng = random.Random(1)
    for _ in range(200):
        parts = sorted((s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(6))))
        low = np.array([rng.randrange(60) for _ in range(5)])
        high = low + rng.randrange(20)
        table = np.array(parts, np.int64).reshape(-1, 2)
        want = [any(a <= s and e <= b for s, e in parts) for a, b in zip(low, high)]
        assert secrets._has_any(table, low, high).tolist() == want


# --- chat ---

ROLES = st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "", "<s>[INST] "]))
TEXT = st.one_of(st.none(), st.text(alphabet="<s>/[]INST \\é\n☃𝄞a", max_size=20))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXT), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    roles = pa.array([r for r, _ in turns], pa.string())
    texts = pa.array([t for _, t in turns], pa.string())
    rows = pa.RecordBatch.from_arrays([pa.array([1] * len(turns)), pa.array([r or "" for r, _ in turns]), texts],
                                      names=["c", "r", "t"])
    made, _ = chat._parts(rows, 1 << 20, pa.int64())
    formatted = made.column(1)[0].as_py()
    assert chat.parse(formatted) == [(r or "", t or "") for r, t in turns]
    spans = zip(made.column(3)[0].as_py(), made.column(4)[0].as_py())
    assert [chat.unescape(formatted[s:e]) for s, e in spans] == [t or "" for r, t in turns if r == "assistant"]
    assert bytes(chat.assemble(roles.fill_null(""), texts)[0]).decode() == formatted


def turns_table(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["ok", None, "é" * 50, "</s>[INST] x", "<\\s>"]), "x")
            for c in range(6) for t in range(rng.randrange(1, 12))]
    rows += [(50, t, "assistant", f"long {t} " * 30, "x") for t in range(400)]
    rows += [(None, 1, "user", "hi", "x"), (51, 1, "user", "b", "x"), (51, 1, "user", "b", "x"), (51, 1, "assistant", "b", "x"),
             (51, None, "user", "first", "x"), (52, 1, "assistant", "y" * 2_000_000, "x")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")


@pytest.mark.parametrize("part_bytes", [1 << 20, 500])
def test_chat_digests(spark, part_bytes):
    rows, table = turns_table(spark)
    formatted = chat.format_conversations(table, part_bytes=part_bytes)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(formatted).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        chars = sum(len(r) for r in formatted.where(f"conv_id <=> {'NULL' if conv is None else conv}").toPandas()["formatted"])
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest(),
                      len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    assert got == want
    if part_bytes == 500:
        assert formatted.where("conv_id = 50").count() > 10
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


def test_parts_are_linked_at_any_distance_within_a_block(spark):
    filler = "filler line\n" * 900  # over 10,000 code points without a blank line
    text = f"login: someone\n{filler}{KEY}\n"
    kinds = [s[2] for s in secrets.spans_of(text, reach=None)]
    assert "linked_identifier" in kinds and "linked_secret" in kinds
    assert not any(k.startswith("linked") for k in [s[2] for s in secrets.spans_of(text.replace(filler, filler + "\n"), reach=None)])
    assert not any(k.startswith("linked") for k in [s[2] for s in secrets.spans_of(text, reach=400)])


def test_secrets_keep_the_type_of_ids(spark):
    docs = spark.createDataFrame([("a", "password = hunter22"), (None, None)], "doc_id string, text string")
    rows = {r["doc_id"]: r["n_assign"] for r in secrets.digest(secrets.scan(docs)).collect()}
    assert rows == {"a": 1, None: 0}
