"""Exact deduplication as a stateful stream, in DataFrame operations only.

Documents arrive as a file stream. A streaming aggregate keyed by the digest of the text keeps, in RocksDB on the
executors' disks and without expiry, the stable identifier of the document that stays, the locator of its content
(file and row) and the number of documents seen. Later documents of the same digest are hits on that state. Texts
are not held in state; a hit is checked on its full bytes afterwards: all texts of a digest must be equal to each
other (smallest = largest, combined before the shuffle, so a text copied by a third of all rows is one row per task).
Should unlike texts share a digest, that digest's rows are grouped by the text itself.

Stream state, checkpoint and intermediate tables are in a new folder below `spark.checkpoint.dir`.

Cases: null texts count as empty. Of equal texts the row with the largest id stays; a null id is smaller than any
other, so such a row stays only alone or beside other null ids. Rows that repeat id and text: all carry the same
keep_id, group_size counts each row, and all of those with the kept id are marked kept (they cannot be told apart by
id). Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.llm.common import at_rest, delete_folder, new_folder
from textmart.operators.joins import join_weighted
from textmart.sources.tables import fits

HIT_ROWS = 200_000          # digests of groups that are broadcast; more are joined by shuffling
HIT_BYTES = 32 << 20
BATCH_BYTES = 4 << 30        # of a micro-batch

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Stores of many partitions would each reserve disk that they do not fill.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in _STATE_CONF}
    for name, value in _STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def read_stream(spark: SparkSession, path: str, schema: T.StructType, batch_bytes: int = BATCH_BYTES,
                batch_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes))
    if batch_files:
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(batch_files))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # streams read folders and patterns; this pattern is the one file
    return reader.parquet(path)


def keyed_state(stream: DataFrame, folder: str, id_col: str, text_col: str,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Run the stream to its present end; the state of all digests: (digest, keep_id, file, row, group_size).

    Started again on the same `folder`, it takes in what has arrived since.
    """
    spark = stream.sparkSession
    rows = stream.select(
        digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
        F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.row_index").alias("row")).alias("at"))
    state = rows.groupBy("digest").agg(F.max("at").alias("kept"), F.count(F.lit(1)).alias("group_size"))
    with _rocksdb(spark):
        query = (state.writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start())
        query.awaitTermination()
        stored = spark.read.format("statestore").load(f"{folder}/stream")
        kept, size = (f"value.`{f.name}`" for f in stored.schema["value"].dataType.fields)
        return at_rest(stored.select(
            "key.digest", F.col(f"{kept}.id").alias("keep_id"), F.col(f"{kept}.file").alias("file"),
            F.col(f"{kept}.row").alias("row"), F.col(size).alias("group_size")), "exact-state")


def deduplicate(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES,
                batch_files: int | None = None) -> DataFrame:
    """Per row of the Parquet table at `path`: doc_id, keep_id, group_size, kept, text_sha256."""
    table = spark.read.parquet(path)
    if not {id_col, text_col} <= set(table.columns):
        raise ValueError(f"{path} has no columns {id_col}, {text_col}")
    folder = new_folder(spark, "exact-dedup")
    stream = read_stream(spark, path, table.schema, batch_bytes, batch_files)
    state = keyed_state(stream, folder, id_col, text_col, digest)
    delete_folder(spark, folder)

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = table.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    marked = texts.withColumn("digest", digest(F.col("text")))

    # Full bytes of all hits.
    hits = state.where("group_size > 1").select("digest")
    hits = F.broadcast(hits) if fits(hits, HIT_ROWS, HIT_BYTES) else hits
    unlike = at_rest(
        marked.join(hits, "digest", "left_semi").groupBy("digest")
        .agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest"),
        "exact-unlike")

    # The rows of whole tables are thin from here on: no texts.
    thin = at_rest(marked.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256")), "exact-rows")
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
               "text_sha256"]
    if unlike.isEmpty():
        return join_weighted(thin, state.select("digest", "keep_id", "group_size"), "digest", "group_size").select(*columns)
    alike = thin.join(unlike, "digest", "left_anti")
    apart = marked.join(unlike, "digest", "left_semi")
    groups = apart.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    resolved = apart.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256")).join(groups, "text")
    return (join_weighted(alike, state.select("digest", "keep_id", "group_size"), "digest", "group_size")
            .select(*columns).unionByName(resolved.select(*columns)))
