"""Cross-tokenizer alignment against a plain loop over whole texts."""

import hashlib
import random
from collections import Counter

import pytest

from textmart.llm import align

TEXTS = [
    "The cat sat on the mat.", "The cat sat on the mat.", "  two  spaces ", " ", "\n", "a\n b\n\nc \t d", None, "", "Straße été naïve 東京 🙂🙂 x",
    "<|endoftext|> </s> <s><unk> <0x0A> ▁x ▁", "▁ ▁", "\x85\xa0 　z", "'s 't 'LL don't I'm", "1 22 333 4444 55555",
    "a" * 3000, "ab " * 2000, "é ́ ‍​ ﻿", "fbdaf409ca8acbbc76452ae8bdd756c52a2b02cc", "\x00 \x01 \x1c \x1d",
]


def texts():
    rng = random.Random(5)
    letters = "abcdeéßñ .,;\n\t 日本0123'\"#&<>_-▁ 🙂"
    return [*TEXTS, *["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(150)],
            " ".join(f"word{i % 700}" for i in range(30_000))]


def brute(rows, pair):
    """Per row the numbers of the contract, from whole texts."""
    cuts = []
    for text in rows:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
            a, b = [], []
        ranges = []
        for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, listed = 0, []
            for i in ids:
                listed.append((at, at + len(table[i]), i))
                at += len(table[i])
            ranges.append(listed)
        cuts.append(ranges)
    links, meets, groups = [], [], []
    for a, b in cuts:
        ends_b = {e: i for _, e, i in b}
        links.append([(i, ends_b[e]) for _, e, i in a if e in ends_b])
        meet, first = [], 0
        for x, (s, e, _) in enumerate(a):
            while first < len(b) and b[first][1] <= s:
                first += 1
            y = first
            while y < len(b) and b[y][0] < e:
                meet.append((x, y))
                y += 1
        meets.append(meet)
        shared = sorted({e for _, e, _ in a} & set(ends_b))
        parts, begin = [], 0
        for end in shared:
            parts.append("|".join(",".join(str(i) for s, e, i in side if begin < e <= end) for side in (a, b)))
            begin = end
            if len(shared) > 3000:
                break
        groups.append(";".join(parts))
    counts = Counter(p for listed in links for p in listed)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(len(a), len(b), len(ls), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), g, m)
            for (a, b), ls, g, m in zip(cuts, links, groups, meets)]


@pytest.mark.parametrize("hot, section", [(1 << 18, 1 << 19), (3, 50), (1, 1)])
def test_alignment(spark, monkeypatch, hot, section):
    monkeypatch.setattr(align, "SECTION", section)
    rows = texts()
    pair = align.Pair(f"{align.FOLDER}/{align.BYTE_BPE}", f"{align.FOLDER}/{align.PIECE_BPE}")
    assert pair.by_pieces
    want = brute(rows, pair)
    docs = spark.createDataFrame([(i // 2, t, i, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_a long, row string")
    aligned = align.align(docs, detail=True).orderBy("doc", "n_a")
    listed = sorted((r["doc"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"],
                     tuple(tuple(p) for p in r["overlaps"])) for r in aligned.collect())
    expected = sorted((i // 2, w[0], w[1], w[2], w[3], w[6], tuple(w[7])) for i, w in enumerate(want))
    for got, plain in zip(listed, expected):
        assert got[:5] == plain[:5] and got[6] == plain[6]
        assert got[5].startswith(plain[5]) if plain[3] > 3000 else got[5] == plain[5]
    kept = align.at_rest(align.align(docs).withColumn("row", align.F.monotonically_increasing_id()), "t")
    scored = align.score_links(kept, align.pair_counts(kept), hot_pairs=hot)
    got = sorted(tuple(r)[1:] for r in kept.join(scored, "row").select("row", "doc", "n_links", "n_best", "count_sum").collect())
    assert got == sorted((i // 2, w[3], w[4], w[5]) for i, w in enumerate(want))


def test_digests(spark):
    docs = spark.createDataFrame([("a", "the cat"), ("a", "the cat"), ("b", None), (None, "")], "doc_id string, text string")
    pair = align.load(f"{align.FOLDER}/{align.BYTE_BPE}", f"{align.FOLDER}/{align.PIECE_BPE}")
    want = brute(["the cat", "the cat"], pair)[0]
    rows = sorted(map(tuple, align.digests(align.align(docs)).collect()), key=str)
    full = ("a", *want[:6], hashlib.sha256(want[6].encode()).hexdigest())
    assert rows == sorted([full, full, ("b", 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str)
    assert align.digests(align.align(docs.limit(0))).count() == 0


def test_pieces_are_forgotten_without_loss(monkeypatch):
    rows = texts()
    pair = align.Pair(f"{align.FOLDER}/{align.BYTE_BPE}", f"{align.FOLDER}/{align.PIECE_BPE}")
    whole = [[x.tolist() for side in pair.encode([t]) for x in side] for t in rows]
    monkeypatch.setattr(align, "PIECES", 40)
    monkeypatch.setattr(align, "PIECE_CHARS", 5)
    assert [[x.tolist() for side in pair.encode([t]) for x in side] for t in rows] == whole
    pair.by_pieces = False
    assert [[x.tolist() for side in pair.encode([t]) for x in side] for t in rows] == whole
