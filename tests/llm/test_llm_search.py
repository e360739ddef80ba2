"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from textmart.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(d, Counter(cut(t)), len(cut(t))) for d, t in docs]
    bags = [b for b in bags if b[2]]
    number, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    weight = {t: math.floor(1000 * math.log((2 * number + 2) / (2 * c + 1))) for t, c in df.items()}
    rows = []
    for item, text in items:
        scores = []
        for doc, bag, n in bags:
            m = 25 + (75 * n * number) // length
            score = sum(times * weight[t] * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t, times in Counter(cut(text)).items() if t in bag)
            scores += [(-score, doc is None, doc or 0, doc)] * (score > 0)
        rows += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(rows, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Straße", "ÉTÉ", "été", "x-y", "A1", "a_b"]

    def text(most):
        return " ".join(rng.choice(words[: rng.choice([4, 20, len(words)])]) for _ in range(rng.randrange(1, most)))

    docs = [(i, text(rng.choice([4, 30, 200]))) for i in range(300)]
    docs += [(300 + i, docs[7][1]) for i in range(40)]  # copies: equal scores
    docs += [(400, None), (401, ""), (402, " \n.-"), (403, "w1 " * 40_000 + "w39"), (404, "w39 " * 3)]
    items = [(i, text(25)) for i in range(30)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w1 w1 w1 w39"), (33, "w2")]
    return docs, items


@pytest.mark.parametrize("k, block, rows", [(10, 4 << 20, 2000), (3, 200, 17)])
def test_ranked_search(spark, monkeypatch, k, block, rows):
    docs, items = corpus(k)
    monkeypatch.setattr("textmart.llm.common.BATCH_ROWS", rows)  # many small buckets
    found = ranked.search(
        spark.createDataFrame([(d, t, 1, 2.0) for d, t in docs], "doc_id long, text string, score int, norm double").repartition(5),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"), k=k, block_bytes=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, k)


def test_scouts_and_bounds_prune_without_loss():
    """Buckets below theta are skipped, and no row that reaches theta is lost."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    size, weights = 50, np.arange(1, 51)
    lists = [np.sort(rng.choice(size, rng.integers(1, 9), replace=False)) for _ in range(400)]
    impacts = [rng.integers(1, 10 ** 6, len(t)) for t in lists]
    norm = np.array([np.sqrt((weights[t] * i.astype(float) ** 2).sum()) for t, i in zip(lists, impacts)])
    bucket = ranked.Bucket(pa.record_batch({
        "terms": pa.array([t.tolist() for t in lists], pa.list_(pa.int32())),
        "impacts": pa.array([i.tolist() for i in impacts], pa.list_(pa.int32())), "norm": norm}), np.sqrt(weights))
    pruned = 0
    for _ in range(50):
        counts = Counter(rng.integers(0, size, 6).tolist())
        item = ranked.Item.of(counts, weights)
        exact = np.array([sum(counts[t] * int(weights[t]) * int(v) for t, v in zip(ts, vs)) for ts, vs in zip(lists, impacts)])
        for theta in (1, int(np.partition(exact, -10)[-10]), int(exact.max()), int(exact.max()) * 9):
            rows = bucket.survivors(item, max(theta, 1))
            assert set(np.flatnonzero(exact >= max(theta, 1))) <= set(rows.tolist())
            if len(rows):
                assert bucket.scores(rows, item, np.zeros(size, np.int64)).tolist() == exact[rows].tolist()
            pruned += len(lists) - len(rows)
    assert pruned > 50 * 400


def test_ranked_search_of_other_types_and_nothing(spark):
    docs = spark.createDataFrame([("b", "one two", None), ("a", "one two", None), (None, "one two", None), ("c", "three", None)],
                                 "doc_id string, text string, item string")
    items = spark.createDataFrame([("q", "two")], "item_id string, text string")
    assert [r["doc_id"] for r in ranked.search(docs, items).orderBy("rank").collect()] == ["a", "b", None]
    assert ranked.search(docs.limit(0), items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0
