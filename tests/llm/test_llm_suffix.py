"""Suffix-array dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmart.llm import suffix_dedup


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + window] for t in raw for i in range(len(t) - window + 1))
    rows = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        spans = [(i, next((j for j in range(i, len(t)) if not gone[j]), len(t))) for i in range(len(t)) if gone[i] and not (i and gone[i - 1])]
        rows.append((len(t), sum(gone), bytes(c for c, g in zip(t, gone) if not g), tuple(spans)))
    return rows


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé 日") for _ in range(rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(25) for _ in range(4)]
    texts = [None, "", "a", "a" * 90, "ab" * 60, shared[0], text(300) * 2]
    for _ in range(60):
        parts = [text(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        texts.append("".join(parts))
    base = text(80)
    for _ in range(30):  # near copies
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice("xyz") + base[at + 1:])
    return [*texts, *texts[8:12], *[base] * 3]


def rows_of(found):
    return sorted((r["doc"], r["n_bytes"], r["n_removed"], bytes(r["kept"]), tuple(tuple(s) for s in r["spans"])) for r in found.collect())


# Groups of any size in one task, then none, so that all are dealt out by longer digits.
@pytest.mark.parametrize("window, group, part, gram", [(40, 1000, 16, 64), (40, 1, 16, 64), (40, 1, 5, 2), (7, 2, 3, 64), (1, 1000, 1, 64)])
def test_repeats_are_removed(spark, window, group, part, gram):
    texts = corpus(window + group)
    docs = spark.createDataFrame([(i // 2, t, i, [b"x"]) for i, t in enumerate(texts)],
                                 "doc_id long, text string, row long, spans array<binary>").repartition(6)
    found = suffix_dedup.remove_repeats(docs, window, group=group, part=part, gram=gram)
    assert rows_of(found) == sorted((i // 2, *row) for i, row in enumerate(brute(texts, window)))


def test_production_parameters(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    passage = text(450)
    texts = [text(700) + passage + text(30), passage[:400], passage[:399] + "?", text(399), "z" * 1000, "y" * 400, text(5000), passage + text(10_000)]
    texts += [texts[6], texts[6][:2500] + "#" + texts[6][2500:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert rows_of(suffix_dedup.remove_repeats(docs)) == sorted((i, *row) for i, row in enumerate(brute(texts, 400)))
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    none = spark.createDataFrame([("a", None), (None, "")], "doc_id string, text string")
    assert sorted(r["n_bytes"] for r in suffix_dedup.remove_repeats(none).collect()) == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=8), st.integers(1, 12), st.integers(1, 5))
def test_radix_passes(parts, window, digit):
    data = np.frombuffer(b"".join(parts) + b"end" * window, np.uint8)
    at = np.arange(len(data) - window + 1)
    group = at % 3
    seen = Counter((g, data[i:i + window].tobytes()) for i, g in zip(at.tolist(), group.tolist()))
    want = [seen[g, data[i:i + window].tobytes()] > 1 for i, g in zip(at.tolist(), group.tolist())]
    assert suffix_dedup.repeated_suffixes(data, at, group, window, digit).tolist() == want


@pytest.mark.parametrize("hashed", [0, 1])
def test_radix_with_lying_hashes(monkeypatch, hashed):
    """Groups are compared by their bytes, so hashes that are all alike lose and add nothing."""
    monkeypatch.setattr(suffix_dedup, "_CODES", np.full(256, hashed, np.uint64))
    data = np.frombuffer(b"abcabdabcxyzabd" * 2, np.uint8)
    at = np.arange(len(data) - 3)
    seen = Counter(data[i:i + 4].tobytes() for i in at.tolist())
    found = suffix_dedup.repeated_suffixes(data, at, np.zeros(len(at), np.int64), 4, 2)
    assert found.tolist() == [seen[data[i:i + 4].tobytes()] > 1 for i in at.tolist()]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 3000).astype(np.uint8)
    text[1700:2300] = text[200:800]
    at, _ = suffix_dedup.anchors(text, 100, 16)
    assert (at[1700:2200] - 1500 == at[200:700]).all()
    assert (at >= np.arange(len(at))).all() and (at + 16 <= np.arange(len(at)) + 100).all()
    other, _ = suffix_dedup.anchors(text[150:900], 100, 16)  # whatever stands around
    assert (other[50:550] + 150 == at[200:700]).all()
