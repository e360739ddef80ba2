"""Word, n-gram and TF-IDF rankings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmart.functions import fixed_values as fixed
from textmart.functions import text as tx
from textmart.operators import joins
from textmart.operators.joins import join_weighted, lookup
from textmart.sources.tables import materialize


def top_k(df: DataFrame, measure: str, key: str, k: int) -> DataFrame:
    """The k rows with the largest measure; ties go to the smaller key."""
    return df.orderBy(F.desc(measure), F.asc(key)).limit(k)


def report_words(text: Column, drop: str = fixed.CLEAN_REPORT) -> Column:
    """The words of a report text: cleaned, then split at the report's word boundaries."""
    return tx.tokenize_regex(tx.clean_text(text, drop))


def word_frequency(df: DataFrame, words: Column, stop_words: Iterable[str] = ()) -> DataFrame:
    """How often each word occurs: (word, n). `stop_words` are left out whatever their case."""
    stops = sorted({w.lower() for w in stop_words})
    exploded = df.select(F.explode(words).alias("word"))
    if stops:
        exploded = exploded.where(~F.lower("word").isin(stops))
    return exploded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def ngram_words(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """The words the n-gram report counts; stop words are left out in their exact spelling."""
    cleaned = tx.clean_text(text, fixed.CLEAN_NGRAM, tidy=True)
    words = F.filter(F.split(cleaned, " "), lambda w: F.trim(w, F.lit(tx.SPACES)) != "")
    return tx.remove_stop_words(words, stop_words, ignore_case=False)


def ngram_frequency(df: DataFrame, words: Column, size: int = fixed.NGRAM_SIZE) -> DataFrame:
    """How often each n-gram prefix occurs: (ngram, n).

    Windows and their prefixes are rows, so that their texts are made by compiled code; no array of all prefixes is built.
    """
    windows = _windows(df.select(words.alias("words")), size)
    prefixes = [F.col("w0"), *[F.concat_ws(" ", *[F.col(f"w{i}") for i in range(n)]) for n in range(2, size + 1)]]
    return windows.select(F.explode(F.array(*prefixes)).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


def _windows(words: DataFrame, size: int) -> DataFrame:
    """Every full window of `size` of the `words`: (w0, w1, ...)."""
    starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(0)))
    return words.select("words", F.posexplode(starts).alias("at", "w0")).select(
        "w0", *[F.get("words", F.col("at") + i).alias(f"w{i}") for i in range(1, size)])


def top_frequent(rows: DataFrame, key: Column, code: Column, k: int, name: str) -> DataFrame:
    """The k most frequent values of `key`, a text, with their counts: (name, n); ties go to the smaller one.

    Only `code`, a 64-bit hash of the key, is counted and shuffled for all rows; then the keys whose code occurs as often as
    the k-th code are made and counted by themselves. Keys of one code have their sum there, so no key is counted too
    low. If such sums have raised the bar above the k-th key, it is lowered to that key and the keys are counted again.
    If fewer than k codes repeat, all keys are counted. `rows` is read twice, so it should be cheap to read.
    """
    coded = rows.withColumn("_code", code)
    counts = coded.groupBy("_code").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.where("n > 1"), "code-counts")

    def kth(df: DataFrame) -> int:
        found, least = df.orderBy(F.desc("n")).select("n").limit(k).agg(F.count("n"), F.min("n")).first()
        return least if found == k else 1

    def counted(least: int) -> DataFrame:
        found = rows if least == 1 else lookup(coded, counts.where(F.col("n") >= least).select("_code"), ["_code"], "inner")
        return materialize(found.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")), "top-counts")

    least = kth(counts)
    found = counted(least)
    lower = least if least == 1 else kth(found)
    return top_k(found if lower >= least else counted(lower), "n", name, k)


def top_ngrams(df: DataFrame, words: Column, k: int, size: int = fixed.NGRAM_SIZE) -> DataFrame:
    """The k most frequent n-gram prefixes: (ngram, n), as `ngram_frequency` counts them.

    The words of the texts are written down once. An n-gram occurs no more often than what it begins with, and comes after
    it in the order of texts: one word more is counted only after the k most frequent of those so far.
    """
    windows = _windows(materialize(df.select(words.alias("words")), "ngram-words"), size)
    rows, found = windows, None
    for length in range(1, size + 1):
        # Words hold no space: a text and its words stand for each other.
        first = [F.col(f"w{i}") for i in range(length)]
        if found is not None:
            begun = windows.withColumn("_begin", F.concat_ws(" ", *first[:-1]))
            rows = lookup(begun, found.select(F.col("ngram").alias("_begin")), ["_begin"], "inner")
        level = top_frequent(rows, F.concat_ws(" ", *first), F.xxhash64(*first), k, "ngram")
        found = materialize(top_k(level if found is None else found.unionByName(level), "n", "ngram", k), "top-ngrams")
    return top_k(found, "n", "ngram", k)


def document_terms(df: DataFrame, keep: Sequence[str], words: Column) -> DataFrame:
    """Each document's terms with their frequency, and one row with a null term: (*keep, term, tf).

    Sorting a document's words puts equal ones side by side, so its terms are the runs of that
    array: no shuffle of words is needed to count them. The null term counts documents.
    """
    w, starts = F.col("_words"), F.col("_starts")
    run_starts = F.filter(
        F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))

    def run(i: Column, nth: Column) -> Column:
        end = F.coalesce(F.get(starts, nth + 1), F.size(w))
        return F.struct(F.get(w, i).alias("term"), (end - i).alias("tf"))

    document = F.array(F.struct(F.lit(None).alias("term"), F.lit(1).alias("tf")))
    return (
        df.select(*keep, F.sort_array(words).alias("_words"))
        .select("*", F.when(F.size(w) > 0, run_starts).when(F.size(w) == 0, F.array().cast("array<int>")).alias("_starts"))
        .select(*keep, F.inline(F.concat(document, F.transform(starts, run))))
    )


def _frequencies(terms: DataFrame) -> DataFrame:
    """Per term, its occurrences and the documents it is in; at rest."""
    return materialize(terms.groupBy("term").agg(
        F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("documents")), "term-frequencies")


def _idf(frequencies: DataFrame) -> Column:
    documents = frequencies.where("term is null").select("documents").scalar()
    return F.log((documents + 1) / (F.col("documents") + 1))


def tfidf_ranking(df: DataFrame, words: Column) -> DataFrame:
    """Each term's tf-idf summed over the corpus: (term, score).

    A term has one idf, so the sum is its number of occurrences times its idf.
    """
    frequencies = _frequencies(document_terms(df, [], words))
    return frequencies.where("term is not null").select(
        "term", (F.col("occurrences") * _idf(frequencies)).alias("score"))


def tfidf_terms(df: DataFrame, id_col: str, words: Column) -> DataFrame:
    """Each document's terms: (id, term, tf, score)."""
    terms = materialize(document_terms(df, [id_col], words), "document-terms")
    frequencies = _frequencies(terms)
    scored = frequencies.where("term is not null").select("term", "documents", _idf(frequencies).alias("idf"))
    return join_weighted(terms.where("term is not null"), scored, "term", "documents", joins.HOT_KEYS).select(
        id_col, "term", "tf", (F.col("tf") * F.col("idf")).alias("score"))


def hash_buckets(words: Column, buckets: int = fixed.HASH_BUCKETS) -> Column:
    """Each word's bucket: the first 28 bits of its MD5 modulo `buckets`."""
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % buckets)


def _indexed(df: DataFrame) -> DataFrame:
    names = [c if c != "term" else "term_index" for c in df.columns]
    return df.withColumn("term", F.col("term").cast("int")).toDF(*names)


def hashed_ranking(df: DataFrame, words: Column, buckets: int = fixed.HASH_BUCKETS) -> DataFrame:
    """`tfidf_ranking` of hash buckets instead of words: (term_index, score). No vectors are built."""
    return _indexed(tfidf_ranking(df, hash_buckets(words, buckets).cast("array<int>")))


def hashed_terms(df: DataFrame, id_col: str, words: Column, buckets: int = fixed.HASH_BUCKETS) -> DataFrame:
    """Each document's buckets: (id, term_index, tf, score)."""
    return _indexed(tfidf_terms(df, id_col, hash_buckets(words, buckets).cast("array<int>")))
