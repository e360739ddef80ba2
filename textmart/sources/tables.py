"""Parquet tables, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


PACKED = "zstd"  # compression of tables that are wide

_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    if schema is None:
        return spark.read.parquet(path)
    # Partition columns come back last unless selected in order.
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def shared_dir(spark: SparkSession) -> str:
    """The folder of the `scratch` block, or the one named by spark.checkpoint.dir; a temporary one only in a local session."""
    if _SCRATCH.get():
        return _SCRATCH.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textmart-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Like a checkpoint it cuts lineage and survives lost executors; unlike one it is columnar,
    so later reads are pruned and filtered.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_packed(df: DataFrame, label: str) -> DataFrame:
    """`materialize` for wide tables: denser, and a little slower to write."""
    return materialize(df, label, PACKED)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None) -> None:
    """Overwrite `path`, also when `df` reads from it.

    The rows are written to a new folder beside it first. Only when that is complete, the old folder is
    set aside, the new one takes its name, and the old one is deleted. If a run is cut short in between,
    both are still there, as `path` with .old- or .new- and an id behind it.
    """
    path, version = path.rstrip("/"), uuid.uuid4().hex
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    table, new, old = at(path), at(f"{path}.new-{version}"), at(f"{path}.old-{version}")
    df.write.parquet(new.toString(), partitionBy=partition_by, compression=compression)
    store = table.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    replaced = store.exists(table)
    if replaced and not store.rename(table, old):
        raise OSError(f"{path} could not be set aside; the new rows are in {new.toString()}")
    if not store.rename(new, table):
        raise OSError(f"{new.toString()} could not become {path}; the old rows are in {old.toString()}")
    if replaced:
        store.delete(old, True)


@contextmanager
def scratch(spark: SparkSession, beside: str) -> Iterator[str]:
    """Intermediate tables go to a new folder beside `beside`, which is deleted when the block ends."""
    folder = f"{beside.rstrip('/')}.work-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *keys: str | Column, per_core: int = 2) -> DataFrame:
    """Give work that is heavy per row enough tasks.

    A few big splits (such as one file with one row group) would leave most cores idle. Inputs
    with at least `per_core` splits per core, as every large table has, are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *keys) if df.rdd.getNumPartitions() < per_core * cores else df


def fits(df: DataFrame, rows: int, size: int) -> bool:
    """Whether a table has at most `rows` rows and about `size` bytes; reads few rows more than that."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    count, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return count <= rows and (total or 0) <= size
