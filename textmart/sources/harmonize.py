"""Bring differently shaped sources to one schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.functions import fixed_values as fixed
from textmart.functions.text import normalize_whitespace


def _map_columns(df: DataFrame, kinds: tuple, change) -> DataFrame:
    wanted = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    return df.withColumns({c: change(F.col(c)) for c in wanted}) if wanted else df


def clean_cells(df: DataFrame) -> DataFrame:
    """Tabs and line breaks in any text cell become spaces; NaN in any number cell becomes null."""
    df = _map_columns(df, (T.StringType,), normalize_whitespace)
    return _map_columns(df, (T.DoubleType, T.FloatType), lambda c: F.when(~F.isnan(c), c))


def missing_to_null(df: DataFrame, cell: str = fixed.MISSING_CELL) -> DataFrame:
    """Text cells that are exactly `cell` become null."""
    return _map_columns(df, (T.StringType,), lambda c: F.nullif(c, F.lit(cell)))


def _typed(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """`value` as `target`, or null. Text such as "12.0" is the whole number 12, "12.5" is none."""
    typed = value.try_cast(target)
    if isinstance(source, T.StringType) and isinstance(target, T.IntegralType):
        number = value.try_cast("decimal(38,9)")
        typed = F.coalesce(typed, F.when(number == F.floor(number), number).try_cast(target))
    return typed


def _source(df: DataFrame, field: T.StructField, aliases: Mapping[str, Sequence[str]]) -> str | None:
    return next((c for c in (field.name, *aliases.get(field.name, ())) if c in df.columns), None)


def source_cells(df: DataFrame, schema: T.StructType, aliases: Mapping[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """What the columns of `schema` are taken from: their own column, the first alias there is, or null."""
    found = {f.name: _source(df, f, aliases or {}) for f in schema.fields}
    return {name: F.lit(None) if source is None else F.col(source) for name, source in found.items()}


def unfit(cell: Column, source: T.DataType, target: T.DataType) -> Column:
    """Whether a cell holds something that is not of the type; the missing-value mark is nothing."""
    held = cell.isNotNull() & (~cell.eqNullSafe(F.lit(fixed.MISSING_CELL)) if isinstance(source, T.StringType) else F.lit(True))
    return held & _typed(cell, source, target).isNull()


def harmonize(df: DataFrame, schema: T.StructType, aliases: Mapping[str, Sequence[str]] | None = None,
              on_unfit: str = "null") -> DataFrame:
    """The columns of `schema`, in its order and types.

    A column the source lacks is taken from the first alias it has, else it is null. Cells that do
    not fit the type become null, or with on_unfit="raise" are an error. Other columns are dropped.
    """
    if on_unfit not in ("raise", "null"):
        raise ValueError(f"on_unfit is raise or null, not {on_unfit}")
    columns = []
    for field in schema.fields:
        name = _source(df, field, aliases or {})
        if name is None:
            value = F.lit(None).cast(field.dataType)
        else:
            kind = df.schema[name].dataType
            value = _typed(F.col(name), kind, field.dataType)
            if on_unfit == "raise" and kind != field.dataType:
                told = F.concat(F.lit(f"{name} is no {field.dataType.simpleString()}: "), F.col(name).cast("string"))
                value = F.when(unfit(F.col(name), kind, field.dataType), F.raise_error(told).cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def rejects(df: DataFrame, schema: T.StructType, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The cells that do not fit: (column, cell), one row each."""
    found = []
    for field in schema.fields:
        name = _source(df, field, aliases or {})
        if name is not None and df.schema[name].dataType != field.dataType:
            bad = unfit(F.col(name), df.schema[name].dataType, field.dataType)
            found.append(F.when(bad, F.struct(F.lit(field.name).alias("column"), F.col(name).cast("string").alias("cell"))))
    if not found:
        return df.sparkSession.createDataFrame([], "column string, cell string")
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("bad")).select("bad.column", "bad.cell")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of `frames`, matched by column name; a column some lack is null there."""
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union
