import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmart.operators import frequency

TEXTS = ["the Cat, the dog", "a dog-house: the end", "cat cat cat", "", None, "x y"]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def words_of(text):
    return text.lower().replace(",", " ").replace("-", " ").replace(":", " ").split()


def test_word_frequency(docs):
    got = dict(frequency.word_frequency(docs, frequency.report_words(F.col("text")), ["THE"]).collect())
    assert got == Counter(w for t in TEXTS if t for w in words_of(t) if w != "the")


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("d", 1)], "w string, n int")
    assert [r.w for r in frequency.top_k(df, "n", "w", 3).collect()] == ["c", "a", "b"]


def test_ngrams_skip_short_texts_and_last_starts(docs):
    got = dict(frequency.ngram_frequency(docs, frequency.ngram_words(F.col("text"), ["the"])).collect())
    assert got["cat"] == 1 and got["cat cat"] == 1 and got["cat cat cat"] == 1
    assert "x" not in got and "Cat" not in got and got["a"] == 1 and got["a dog house"] == 1 and got["dog house end"] == 1
    assert "house" not in got and "end" not in got


def test_ngram_words_are_not_blank(value):
    text = "a \xa0 b\xa0c \u2003 12. d"
    assert value(frequency.ngram_words(F.col("t"), ["d"]), "t string", text) == ["a", "b\xa0c"]


def test_tfidf(docs):
    texts = [t for t in TEXTS if t is not None]
    tf = [Counter(words_of(t)) for t in texts]
    df = Counter(w for c in tf for w in c)
    idf = {w: math.log((len(texts) + 1) / (n + 1)) for w, n in df.items()}
    words = frequency.report_words(F.col("text"))
    ranking = dict(frequency.tfidf_ranking(docs, words).collect())
    assert ranking.keys() == idf.keys()
    for w in idf:
        assert ranking[w] == pytest.approx(idf[w] * sum(c[w] for c in tf))
    terms = {(r.id, r.term): (r.tf, r.score) for r in frequency.tfidf_terms(docs, "id", words).collect()}
    assert terms == {(i, w): (n, pytest.approx(n * idf[w])) for i, t in enumerate(TEXTS) if t for w, n in Counter(words_of(t)).items()}


def test_hashed_tfidf_agrees_with_terms_when_nothing_collides(docs):
    words = frequency.report_words(F.col("text"))
    exact = sorted(round(r.score, 4) for r in frequency.tfidf_ranking(docs, words).collect())
    hashed = frequency.hashed_ranking(docs, words, 1 << 27)
    assert hashed.dtypes == [("term_index", "int"), ("score", "double")]
    assert sorted(round(r.score, 4) for r in hashed.collect()) == pytest.approx(exact)
    by_word = sorted((r.id, r.tf, round(r.score, 4)) for r in frequency.tfidf_terms(docs, "id", words).collect())
    by_bucket = sorted((r.id, r.tf, round(r.score, 4)) for r in frequency.hashed_terms(docs, "id", words, 1 << 27).collect())
    assert by_bucket == by_word


def test_collisions_merge_words(docs):
    assert {r.term_index for r in frequency.hashed_ranking(docs, frequency.report_words(F.col("text")), 2).collect()} == {0, 1}


def test_ngrams_are_made_without_an_array_of_all_prefixes(spark):
    df = spark.createDataFrame([("a b c a b c",), ("a b",), (None,)], "text string")
    counted = frequency.ngram_frequency(df, F.split("text", " "))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan and "concat_ws" in plan
    assert dict(counted.collect()) == {
        "a": 2, "a b": 2, "a b c": 2, "b": 1, "b c": 1, "b c a": 1, "c": 1, "c a": 1, "c a b": 1}


def test_longer_ngrams_are_counted_after_frequent_beginnings_alone(spark, monkeypatch):
    text = " ".join(f"x{i}" for i in range(200))
    df = spark.createDataFrame([(text,), (text,), ("a a a a a a",)], "text string")
    kept, write = [], frequency.materialize

    def noted(table, label):
        table = write(table, label)
        kept.extend([table.count()] if label == "code-counts" else [])
        return table

    monkeypatch.setattr(frequency, "materialize", noted)
    assert [tuple(r) for r in frequency.top_ngrams(df, F.split("text", " "), 2).collect()] == [("a", 4), ("a a", 4)]
    assert sum(kept) < 210


def test_few_buckets_are_broadcast_whole_and_are_numbers(spark):
    df = spark.createDataFrame([(i, f"a b c d{i} e{i}") for i in range(30)], "id long, text string")
    found = frequency.hashed_terms(df, "id", F.split("text", " "), 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Union" not in plan and "as string" not in plan
    assert dict(found.dtypes)["term_index"] == "int"


def test_tfidf_is_the_same_with_few_and_many_terms(docs, monkeypatch):
    words = frequency.report_words(F.col("text"))
    whole = sorted(tuple(r) for r in frequency.tfidf_terms(docs, "id", words).collect())
    for keys in (1, 4):
        monkeypatch.setattr(frequency.joins, "HOT_KEYS", keys)
        found = frequency.tfidf_terms(docs, "id", words)
        assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == whole
