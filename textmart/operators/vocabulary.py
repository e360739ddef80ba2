"""A vocabulary of the most frequent terms, and rows as vectors over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmart.functions import fixed_values as fixed
from textmart.operators.frequency import document_terms
from textmart.operators.ids import assign_ids
from textmart.operators.joins import join_weighted
from textmart.operators.selection import kth_largest
from textmart.sources.tables import materialize


def vocabulary(df: DataFrame, words: Column, size: int | None = fixed.VOCABULARY_SIZE, min_rows: int = 1) -> DataFrame:
    """The `size` most frequent terms (all, if None): (term, index, occurrences, rows); at rest.

    `index` counts from 0 in the order of occurrences, largest first, then of the term. Terms in fewer than `min_rows`
    rows do not take part. The smallest number of occurrences that gets in is found from histograms; only terms that
    reach it are put in order, by ranges. Rows whose words are null have no terms.
    """
    terms = document_terms(df, [], words).where("term IS NOT NULL")
    counts = terms.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("rows"))
    counts = materialize(counts.where(F.col("rows") >= min_rows), "term-counts")
    least = None if size is None else kth_largest(counts, "occurrences", size)
    if least is not None:
        counts = counts.where(F.col("occurrences") >= least)
    numbered = assign_ids(counts, [F.desc("occurrences"), "term"], "place")
    if size is not None:
        numbered = numbered.where(F.col("place") <= size)
    return materialize(numbered.select(
        "term", (F.col("place") - 1).cast("int").alias("index"), "occurrences", "rows"), "vocabulary")


def vectors(df: DataFrame, id_col: str, words: Column, terms: DataFrame) -> DataFrame:
    """Each row as a sparse vector over the vocabulary `terms`: (id_col, indices, counts), indices ascending.

    `indices` by itself is the binary vector. Words that are not in the vocabulary are left out; a row
    without any other has empty arrays, and each row has its own vector, also if ids repeat. Frequent terms are looked up
    in a broadcast of fewer than HOT_KEYS rows, the others joined.
    """
    numbered = df.select(F.col(id_col).alias("id"), words.alias("words"), F.monotonically_increasing_id().alias("row"))
    found = materialize(document_terms(numbered, ["row", "id"], F.coalesce("words", F.array().cast("array<string>"))), "row-terms")
    known = join_weighted(found.where("term IS NOT NULL"), terms.select("term", "index", "rows"), "term", "rows")
    rows = known.select("row", "id", F.struct("index", "tf").alias("entry")).unionByName(
        found.where("term IS NULL").select("row", "id", F.lit(None).cast("struct<index:int,tf:int>").alias("entry")))
    entries = F.sort_array(F.collect_list("entry"))  # no more than a row has terms
    return rows.groupBy("row", "id").agg(entries.alias("entries")).select(
        F.col("id").alias(id_col), F.col("entries.index").alias("indices"), F.col("entries.tf").alias("counts"))
