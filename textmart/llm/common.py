"""What the operators share: bounded Arrow batches, column plumbing, folders on shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.sources.tables import shared_dir

BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20

# Bytes of the white space that separates tokens: space, tab, line feed, vertical tab, form feed, return.
SPACE = " \t\n\v\f\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

Batches = Iterator[pa.RecordBatch]


def map_arrow(df: DataFrame, function: Callable[[Batches], Batches], schema: str | T.StructType,
              batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """`mapInArrow` over batches that are bounded in rows and bytes, however long the texts are."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return df.mapInArrow(function, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8, without decoding them."""
    return pc.cast(column, pa.binary()).to_pylist()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def fresh(taken: list[str], name: str) -> str:
    """`name`, with underscores in front as long as it clashes (names compare without case, as in Spark)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def column(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder made by `new_folder`, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def at_rest(df: DataFrame, label: str) -> DataFrame:
    """Write to shared storage and read again: cuts lineage, survives lost executors, is pruned when read."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
