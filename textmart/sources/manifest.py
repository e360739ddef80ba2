"""Many source files, listed in groups, read as one table."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.functions.dates import standardize_date
from textmart.sources import notation
from textmart.sources.harmonize import clean_cells, harmonize, missing_to_null, source_cells, union_all


@dataclass(frozen=True)
class SourceGroup:
    """Files that share a shape, and the columns that are constant for all their rows."""

    name: str
    paths: Sequence[str]
    constants: Mapping[str, object] = field(default_factory=dict)


def load_manifest(spark: SparkSession, path: str, folder: str, constants: Mapping[str, str]) -> list[SourceGroup]:
    """Groups of a JSON manifest {group: {"sources": [...], ...}}, with files relative to `folder`.

    `constants` maps a column to the group property it is filled from.
    """
    manifest = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return [
        SourceGroup(name, [f"{folder}/{s}" for s in group["sources"]],
                    {column: group[prop] for column, prop in constants.items()})
        for name, group in manifest.items()
    ]


_FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "orc": "orc", "parquet": "parquet"}


def _read_csv(spark: SparkSession, paths: Sequence[str], multi_line: bool) -> list[DataFrame]:
    """One read for all files of the same header. Cells are text."""
    headers: dict[tuple[str, ...], list[str]] = {}
    for path in paths:  # each file's first line
        headers.setdefault(tuple(spark.read.csv(path, header=True, multiLine=multi_line, escape='"').columns), []).append(path)
    return [
        spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(
            same, header=True, multiLine=multi_line, escape='"', enforceSchema=True, mode="FAILFAST")
        for columns, same in headers.items()]


def read_files(spark: SparkSession, paths: Sequence[str], multi_line: bool = False) -> DataFrame:
    """All files, each in the format its extension tells; columns that a file lacks are null.

    CSV files are split among tasks. Cells with line breaks need `multi_line`, and then each file is
    read by one task; without it, a row torn by a line break is an error.
    """
    by_format: dict[str, list[str]] = {}
    for path in paths:
        kind = PurePosixPath(path).suffix.lstrip(".").lower()
        if kind in ("xlsx", "xls"):
            raise ValueError(f"{path}: export workbooks to CSV first")
        by_format.setdefault(_FORMATS.get(kind, "parquet"), []).append(path)
    frames = []
    for kind, same in by_format.items():
        if kind == "csv":
            frames += _read_csv(spark, same, multi_line)
        elif kind == "json":
            frames.append(spark.read.json(same, primitivesAsString=True))
        else:
            frames.append(spark.read.format(kind).option("mergeSchema", True).load(same))
    if len(frames) > 1:  # formats type the same column in their own ways
        frames = [f.select(*[F.col(c).cast("string").alias(c) for c in f.columns]) for f in frames]
    return union_all(frames)


def ingest(groups: Sequence[tuple[SourceGroup, DataFrame]], schema: T.StructType,
           aliases: Mapping[str, Sequence[str]] | None = None, required: Sequence[str] = (),
           dates: Mapping[str, Sequence[str] | None] | None = None, on_unfit: str = "raise",
           prefer: str | None = None) -> DataFrame:
    """One clean table of `schema` from groups and their rows.

    Per group: whitespace in cells is cleaned, rows whose source cell of a `required` column is missing
    are dropped, columns are renamed and typed, missing-value cells become null, `dates` (column to
    extra formats) are rewritten as yyyy-MM-dd and the group's constants are filled in. Where a column's formats are
    None, one more pass over the group finds how its cells are written (`notation`), and `prefer` reads those that may be
    day or month first. A number or date that cannot be read is an error, or with on_unfit="null" null in a row that
    stays; `harmonize.rejects` lists such cells.
    """
    tables = []
    for group, df in groups:
        cleaned = clean_cells(df)
        cells = source_cells(cleaned, schema, aliases)
        for column in required:
            cleaned = cleaned.where(cells[column].isNotNull())
        table = missing_to_null(harmonize(cleaned, schema, aliases, on_unfit))
        found = notation.learn(table, [c for c, formats in (dates or {}).items() if formats is None])
        for column, formats in (dates or {}).items():
            if formats is None:
                day = F.date_format(notation.read(F.col(column), found[column], prefer, on_unfit), "yyyy-MM-dd")
            else:
                day = standardize_date(F.col(column), formats, on_unfit)
            table = table.withColumn(column, day)
        types = {f.name: f.dataType for f in schema.fields}
        for column, value in group.constants.items():
            table = table.withColumn(column, F.lit(value).cast(types[column]))
        tables.append(table.select(*schema.names))
    return union_all(tables)


def ingest_files(spark: SparkSession, groups: Sequence[SourceGroup], schema: T.StructType,
                 reader: Callable[..., DataFrame] = read_files, **options) -> DataFrame:
    """`ingest` over the files of each group."""
    return ingest([(g, reader(spark, g.paths)) for g in groups], schema, **options)
