"""A typed column profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.operators.selection import exact_quantiles

QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact quantiles of number columns: (column, p25, p50, p75), the smallest values of at least that rank.

    Read at once; the result is a row per column.
    """
    found = exact_quantiles(df, columns, list(QUANTILES.values()))
    schema = T.StructType([T.StructField("column", T.StringType()), *[T.StructField(q, T.DoubleType()) for q in QUANTILES]])
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in columns], schema)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: (column, count, mean, stddev, min, p25, p50, p75, max), all exact.

    Non-numeric columns have only their count and, as text, their smallest and largest value.
    """
    columns = list(columns or df.columns)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name in columns]
    measures = []
    for c in columns:
        col = F.col(c)
        measures.append(F.count(col).alias(f"{c}:count"))
        measures += [F.min(col).cast("string").alias(f"{c}:min_text"), F.max(col).cast("string").alias(f"{c}:max_text")]
        if c in numeric:
            measures += [F.avg(col).alias(f"{c}:mean"), F.stddev_samp(col).alias(f"{c}:stddev"),
                         F.min(col).cast("double").alias(f"{c}:min"), F.max(col).cast("double").alias(f"{c}:max")]
    one_row = df.agg(*measures)

    def entry(c: str):
        get = lambda name: F.col(f"`{c}:{name}`")
        none = F.lit(None).cast("double")
        stats = [(get(name) if c in numeric else none).alias(name) for name in ("mean", "stddev", "min", "max")]
        return F.struct(F.lit(c).alias("column"), get("count").alias("count"), *stats,
                        get("min_text").alias("min_text"), get("max_text").alias("max_text"))

    summary = one_row.select(F.inline(F.array(*[entry(c) for c in columns])))
    if numeric:
        summary = summary.join(F.broadcast(quantiles(df, numeric)), "column", "left")  # a row per column
    else:
        summary = summary.withColumns({name: F.lit(None).cast("double") for name in QUANTILES})
    return summary.select("column", "count", "mean", "stddev", "min", *QUANTILES, "max", "min_text", "max_text")
