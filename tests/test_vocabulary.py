import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmart.operators import frequency, joins, vocabulary

WORDS = F.split("text", " ")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    names = [f"w{i:03}" for i in range(300)]
    rows = [" ".join(rng.choices(names[:rng.choice([5, 60, 300])], k=rng.randrange(1, 40))) for _ in range(120)]
    return list(enumerate([*rows, "hot " * 500 + "w000", None, "", rows[3]]))


def expected(texts, size=None, min_rows=1):
    found = [t.split(" ") for _, t in texts if t is not None]
    occurrences, rows = Counter(w for t in found for w in t), Counter(w for t in found for w in set(t))
    ranked = sorted((w for w in rows if rows[w] >= min_rows), key=lambda w: (-occurrences[w], w))[:size]
    return {w: (i, occurrences[w], rows[w]) for i, w in enumerate(ranked)}


@pytest.mark.parametrize("size, min_rows", [(None, 1), (1, 1), (17, 1), (150, 3), (10_000, 1), (250, 1)])
def test_vocabulary(spark, texts, size, min_rows):
    found = vocabulary.vocabulary(spark.createDataFrame(texts, "id long, text string"), WORDS, size, min_rows)
    assert {r["term"]: (r["index"], r["occurrences"], r["rows"]) for r in found.collect()} == expected(texts, size, min_rows)


@pytest.mark.parametrize("hot", [10_000, 5])
def test_vectors(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(joins, "HOT_KEYS", hot)
    df = spark.createDataFrame([*texts, (0, "w001 w001 never")], "id long, text string")
    terms = vocabulary.vocabulary(spark.createDataFrame(texts, "id long, text string"), WORDS, 100)
    known = expected(texts, 100)
    want = []
    for i, text in [*texts, (0, "w001 w001 never")]:
        counts = sorted((known[w][0], n) for w, n in Counter(text.split(" ") if text is not None else []).items() if w in known)
        want.append((i, [c[0] for c in counts], [c[1] for c in counts]))
    assert sorted((r["id"], r["indices"], r["counts"]) for r in vocabulary.vectors(df, "id", WORDS, terms).collect()) == sorted(want)


def test_nothing(spark):
    empty = spark.createDataFrame([], "id long, text string")
    terms = vocabulary.vocabulary(empty, WORDS)
    assert terms.count() == 0 and vocabulary.vectors(empty, "id", WORDS, terms).count() == 0
    assert vocabulary.vectors(spark.createDataFrame([(1, "a")], "id long, text string"), "id", WORDS, terms).first()["indices"] == []


@pytest.mark.parametrize("k", [1, 7, 60, 100_000])
def test_top_ngrams_are_the_most_frequent(spark, texts, k):
    df = spark.createDataFrame(texts, "id long, text string")
    plain = frequency.top_k(frequency.ngram_frequency(df, WORDS), "n", "ngram", k).collect()
    assert frequency.top_ngrams(df, WORDS, k).collect() == plain


@pytest.mark.parametrize("codes", [1, 3, 40])
def test_keys_of_one_code_are_told_apart(spark, codes):
    """With few codes their sums hide the k-th key at first; none is lost."""
    rng = random.Random(codes)
    rows = spark.createDataFrame([(f"k{min(int(rng.expovariate(0.08)), 70)}",) for _ in range(900)], "key string")
    code = F.pmod(F.xxhash64("key"), F.lit(codes))
    for k in (1, 5, 20):
        plain = frequency.top_k(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "n", "key", k).collect()
        assert frequency.top_frequent(rows, F.col("key"), code, k, "key").collect() == plain
