"""SimHash near duplicates by tiled exact comparison.

Fingerprints of equal bits are folded first, so exact and very near copies are one fingerprint however many they are.
The distinct fingerprints are dealt into tiles by their number of set bits, and large tiles into shares of about TILE.
Tiles whose bit counts differ by more than the radius are not paired: such fingerprints cannot be near. A pair of
tiles is one row with two arrays; a task compares them with numpy exclusive-or and bit counts, and inside a tile it
skips in the same way what differs too much in the bit counts of the four quarters. All other pairs are compared: no
link is missed. Links are reduced to a spanning forest at once, so that a family of many mutually near fingerprints
gives as many edges as it has members.

The number of comparisons grows with the square of the number of distinct fingerprints, at a small factor: that is
the method's price for exactness.

Cases: a null text has no words. No words: fingerprint 0, linked like any other. Fewer words than a shingle: the whole
sequence is hashed. Rows with equal ids are each in the table `fingerprints`, and all get a row. Null ids get rows; the
smallest id of a component is taken among its ids that are not null. Other columns are kept by `deduplicate`.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmart.llm.common import LOWER, Batches, as_bytes, at_rest, column, fresh, map_arrow
from textmart.llm.components import components
from textmart.operators.joins import join_weighted

SHINGLE = 4
RADIUS = 4
TILE = 1 << 15
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size) + np.arange(len(words))
    start = (end - size)[:n].tolist()
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(start, end[shingle - 1:].tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Batches, shingle: int) -> Batches:
    for batch in batches:
        made = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp): each row's fingerprint, as a long of the same bits."""
    chosen = docs.select(column(docs, id_col).alias("doc"), column(docs, text_col).cast("string").alias("text"))
    kind = chosen.schema["doc"].dataType.simpleString()
    return map_arrow(chosen, partial(_fingerprints, shingle=shingle), f"doc {kind}, fp long")


class _Forest:
    """Labels 0..n-1; joins edges, each component labelled by its smallest member."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            unlike = x != y
            if not unlike.any():
                return
            a, b = a[unlike], b[unlike]
            low, high = np.minimum(x[unlike], y[unlike]), np.maximum(x[unlike], y[unlike])
            np.minimum.at(self.label, high, low)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _quarters(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def links_of(a: np.ndarray, b: np.ndarray, radius: int = RADIUS, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (the same one twice: within it), as pairs of fingerprints.

    Rows of `a` with the same bit counts by quarter are taken together; each of these groups meets the rows of `b`
    whose counts differ by no more than the radius in sum.
    """
    same = a is b
    every = a if same else np.concatenate([a, b])
    forest, shift = _Forest(len(every)), 0 if same else len(a)
    qa, qb = _quarters(a), _quarters(b)
    kinds_a, of_a = np.unique(qa, axis=0, return_inverse=True)
    kinds_b, of_b = np.unique(qb, axis=0, return_inverse=True)
    order_a = np.argsort(of_a.ravel(), kind="stable")
    cut_a = np.append(np.searchsorted(of_a.ravel()[order_a], np.arange(len(kinds_a))), len(a))
    of_b = of_b.ravel()
    for k, kind in enumerate(kinds_a):
        near = np.abs(kinds_b - kind).sum(axis=1) <= radius
        cols = np.flatnonzero(near[of_b])
        if not len(cols):
            continue
        rows = order_a[cut_a[k]:cut_a[k + 1]]
        step = max(1, block // len(cols))
        other = b[cols]
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            i, j = np.nonzero(np.bitwise_count(a[some, None] ^ other[None, :]) <= radius)
            forest.join(some[i], cols[j] + shift)
    member = np.flatnonzero(forest.label != np.arange(len(every)))
    return every[member], every[forest.label[member]]


def _compare(batches: Batches, radius: int) -> Batches:
    for batch in batches:
        for one, two in zip(batch.column(0), batch.column(1)):
            a, b = (side.values.to_numpy().view(np.uint64) for side in (one, two))
            u, v = links_of(a, a if np.array_equal(a, b) else b, radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect all of the distinct fingerprints `fp` that differ in at most `radius` bits."""
    spark = distinct.sparkSession
    counted = distinct.select("fp", F.bit_count("fp").alias("bits"))
    shares = {r["bits"]: -(-r["count"] // tile) for r in counted.groupBy("bits").count().collect()}  # 65 rows at most
    if not shares:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    table = spark.createDataFrame(sorted(shares.items()), "bits int, shares long")
    dealt = counted.join(F.broadcast(table), "bits").withColumn("share", F.pmod(F.xxhash64("fp"), F.col("shares")))
    tiles = at_rest(dealt.groupBy("bits", "share").agg(F.collect_list("fp").alias("fps")), "tiles")
    # Each tile meets those of its own bit count from its share on, and all of the next `radius` counts.
    ahead = spark.createDataFrame(
        [(bits, other, n) for bits in shares for other, n in shares.items() if bits <= other <= bits + radius],
        "bits int, other int, n long")
    wanted = tiles.join(F.broadcast(ahead), "bits").select(
        F.col("fps").alias("one"), F.col("bits").alias("one_bits"), F.col("share").alias("one_share"),
        F.col("other").alias("bits"),
        F.explode(F.sequence(F.when(F.col("bits") == F.col("other"), F.col("share")).otherwise(F.lit(0).cast("long")),
                             F.col("n") - 1)).alias("share"))
    pairs = wanted.join(tiles.withColumnRenamed("fps", "two"), ["bits", "share"])
    dealt = pairs.repartition("one_bits", "one_share", "bits", "share").select("one", "two")
    return map_arrow(dealt, partial(_compare, radius=radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Per row of `docs`: (doc, fp, component), the component being the smallest id that is reachable over links."""
    rows = at_rest(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = at_rest(rows.groupBy("fp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("copies")), "fp-groups")
    roots = components(links(groups.select("fp"), radius, tile))
    rooted = at_rest(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                     .withColumn("root", F.coalesce("root", "fp")), "fp-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    found = at_rest(rooted.join(least, "root").select("fp", "component", "copies"), "fp-components")
    return join_weighted(rows, found, "fp", "copies").select("doc", "fp", "component")


def hex_of(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """`docs`, all columns, with the row of the smallest id of each component.

    Rows that repeat the kept id stay with it. A component without any id keeps its rows.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, radius, tile)
    gone = fresh(docs.columns, "gone")
    others = found.where("doc <> component OR doc IS NULL AND component IS NOT NULL").select(F.col("doc").alias(gone))
    # A null id never equals another, so rows without an id are looked up null-safely.
    others = others.distinct()
    return docs.join(others, column(docs, id_col).eqNullSafe(others[gone]), "left_anti")
