"""Dimensions and facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmart.operators.ids import assign_ids
from textmart.operators.joins import lookup
from textmart.sources.tables import materialize


def build_dim(df: DataFrame, columns: Sequence[str], id_col: str, null_keys: bool = True) -> DataFrame:
    """One row per distinct value of `columns`, numbered in their order.

    Without `null_keys`, rows in which all columns are null get no entry.
    """
    values = df.select(*columns).distinct()
    if not null_keys:
        values = values.na.drop("all")
    return assign_ids(values, columns, id_col)


def build_dims(values: Mapping[str, DataFrame], id_suffix: str = "_id") -> dict[str, DataFrame]:
    """Several dimensions of one text column each, numbered in one pass: name to (name_id, the column).

    As in `build_dim`, ids follow the order of the values and a null has a row.
    """
    stacked = None
    for name, df in values.items():
        part = df.select(F.lit(name).alias("dimension"), F.col(df.columns[0]).alias("value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    numbered = materialize(assign_ids(stacked.distinct(), ["dimension", "value"], "id"), "dimension-values")
    first = F.broadcast(numbered.groupBy("dimension").agg(F.min("id").alias("first")))  # a row per dimension
    numbered = numbered.join(first, "dimension")
    return {name: numbered.where(F.col("dimension") == name).select(
        (F.col("id") - F.col("first") + 1).alias(f"{name}{id_suffix}"), F.col("value").alias(df.columns[0]))
        for name, df in values.items()}


@dataclass(frozen=True)
class Dimension:
    """A dimension at rest, and how facts find their row: fact column to dimension column."""

    table: DataFrame
    keys: dict[str, str]
    columns: Sequence[str]
    how: str = "inner"
    null_safe: bool = False


def star_join(fact: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """Add each dimension's `columns` to the facts."""
    joined = fact
    for dim in dimensions:
        table = dim.table.select(*[F.col(d).alias(f) for f, d in dim.keys.items()], *dim.columns)
        joined = lookup(joined, table, list(dim.keys), dim.how, dim.null_safe, counted_on=fact)
    return joined


def explode_members(df: DataFrame, column: str, members: Column) -> DataFrame:
    """One row per member; rows without a member cell are left out."""
    return df.withColumn(column, F.explode(members))
