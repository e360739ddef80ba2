"""Line deduplication over levelled, sorted runs of line hashes.

`LineRuns` holds the lines seen so far as runs: tables of (hash, owner) bucketed and sorted by hash. A batch of lines
first finds its own owners (smallest document per hash, combined before the shuffle), then merge-anti-joins them with
every run: what is left is new and becomes a run of level 0. `fanout` runs of a level are compacted into one of the
next level, so there are only about fanout x log(batches) runs to join with. The runs' sides of these joins are
bucketed and are not shuffled.

Batches must come in ascending order of document ids; then the owner of a line is the smallest document that holds it.
`deduplicate` deals a whole table out into `batches` id ranges. Lines that are not their document's own are looked up
by (hash, document), so a line that a third of all documents share is spread over tasks.

Lines are split at \n. A line's key is the line without white space at its ends, A-Z in lower case; keys of fewer than
MIN_CHARS code points are never dropped. Hashes are 128 bits (XXH3) of the key.

Cases: a null or empty text is one empty line. All rows with one id are one document. Rows without an id are one
document that comes last. A document that loses all lines keeps its row, with an empty text. Other columns are kept
by `deduplicate`. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmart.llm.common import LOWER, Batches, as_bytes, at_rest, column, delete_folder, fresh, map_arrow, new_folder

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3
_STRIPPED = b" \t\n\v\f\r"


def key_hashes(text: bytes | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Per line the hash of its key, or None if the key is short."""
    hashes = []
    for line in (text or b"").translate(LOWER).split(b"\n"):
        key = line.strip(_STRIPPED)
        # A code point has at most 4 bytes.
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars
        hashes.append(xxhash.xxh3_128_digest(key) if long else None)
    return hashes


def _keys(batches: Batches, min_chars: int) -> Batches:
    for batch in batches:
        at, hashes = [], []
        for i, text in enumerate(as_bytes(batch.column(1))):
            own = {h for h in key_hashes(text, min_chars) if h is not None}
            hashes.extend(own)
            at.extend([i] * len(own))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.array(at, np.int64))), pa.array(hashes, pa.binary())], names=["doc", "hash"])


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, hash): the distinct long lines of each row."""
    chosen = docs.select(column(docs, id_col).alias("doc"), column(docs, text_col).cast("string").alias("text"))
    kind = chosen.schema["doc"].dataType.simpleString()
    return map_arrow(chosen, partial(_keys, min_chars=min_chars), f"doc {kind}, hash binary")


class LineRuns:
    """The lines of all batches so far, in sorted runs below a folder of their own."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.folder = new_folder(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (run.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash")
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete_folder(self.spark, f"{self.folder}/{name}")

    def add(self, keys: DataFrame) -> DataFrame:
        """Take in a batch of (doc, hash), which is read twice; returns its lines that are not the first."""
        new = keys.groupBy("hash").agg(F.min("doc").alias("owner"))
        for level in self.levels:
            for run in level:
                new = new.join(self.spark.table(run).select("hash"), "hash", "left_anti")
        name = self._write(new)
        own = self.spark.table(name).select(F.col("hash").alias("own_hash"), "owner")
        lost = at_rest(keys.join(own, (F.col("hash") == F.col("own_hash")) & F.col("doc").eqNullSafe(F.col("owner")),
                                 "left_anti"), "lines-lost")
        self._settle(0, name)
        return lost

    def _settle(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self.spark.table(runs[0])
            for run in runs[1:]:
                merged = merged.unionByName(self.spark.table(run))
            compact = self._write(merged)
            for run in runs:
                self._drop(run)
            self._settle(level + 1, compact)

    def close(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        delete_folder(self.spark, self.folder)


def lost_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, hashes): the documents that lose lines, and the hashes of those lines' keys."""
    spark = docs.sparkSession
    keys = line_keys(docs, id_col, text_col, min_chars)
    bounds = docs.agg(F.percentile_approx(column(docs, id_col), [i / batches for i in range(1, batches)], 10_000)).first()[0]
    number = F.lit(0)
    for bound in sorted(set(bounds or [])):
        number = number + F.when(F.col("doc") > F.lit(bound), 1).when(F.col("doc").isNull(), 1).otherwise(0)
    keys = at_rest(keys.withColumn("batch", number), "line-keys")
    runs = LineRuns(spark, fanout)
    lost = None
    for b in range(len(set(bounds or [])) + 1):
        part = runs.add(keys.where(F.col("batch") == b).select("doc", "hash"))
        lost = part if lost is None else lost.unionByName(part)
    runs.close()
    return lost.groupBy("doc").agg(F.collect_set("hash").alias("hashes"))


def _rewrite(batches: Batches, text: int, min_chars: int, digest: bool) -> Batches:
    """The lost hashes are the last column. Replaces the text, or tells counts and the digest of the new text."""
    for batch in batches:
        last = batch.num_columns - 1
        texts, lines, dropped = [], [], []
        for body, lost in zip(as_bytes(batch.column(text)), batch.column(last).to_pylist()):
            body = body or b""
            if not lost:
                texts.append(body)
                lines.append(body.count(b"\n") + 1)
                dropped.append(0)
                continue
            lost, parts = set(lost), body.split(b"\n")
            kept = [p for p, h in zip(parts, key_hashes(body, min_chars)) if h not in lost]
            texts.append(b"\n".join(kept))
            lines.append(len(parts))
            dropped.append(len(parts) - len(kept))
        if digest:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
        else:
            columns = [batch.column(i) for i in range(last)]
            columns[text] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])


def _with_lost(docs: DataFrame, id_col: str, lost: DataFrame) -> DataFrame:
    doc = fresh(docs.columns, "doc")
    lost = lost.select(F.col("doc").alias(doc), F.col("hashes").alias(fresh([*docs.columns, doc], "hashes")))
    return docs.join(lost, column(docs, id_col).eqNullSafe(lost[doc]), "left").drop(lost[doc])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """`docs`, all columns and rows, with the remaining lines of each text joined by \\n (null becomes empty)."""
    lost = lost_lines(docs, id_col, text_col, min_chars, batches, fanout)
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    return map_arrow(_with_lost(docs, id_col, lost), partial(_rewrite, text=at, min_chars=min_chars, digest=False),
                     docs.schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
            batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of what `deduplicate` leaves of each row."""
    chosen = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    lost = lost_lines(chosen, "doc_id", "text", min_chars, batches, fanout)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return map_arrow(_with_lost(chosen, "doc_id", lost), partial(_rewrite, text=1, min_chars=min_chars, digest=True),
                     f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")
