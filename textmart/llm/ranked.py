"""Ranked lexical search: the documents with the largest inner product with each item, by norm buckets.

A text's vector has an impact for each of its terms, an item's the number of times it has a term; a term's weight
stands half (its square root) on either side, so that lengths are comparable. What a search reads of a document are only the terms
of its items (a block of them, bounded in bytes), so texts are cut into words once per block and become short integer
vectors at rest. These are ordered by length over all partitions and read back in buckets. For an item with the k-th
best score `theta` so far:

1. a bucket whose longest vector times the item's length stays below theta is skipped (Cauchy-Schwarz);
2. inside, the item's largest coordinates are looked up until what is left of the item cannot reach theta by itself;
   only documents with one of these terms remain, and of them those whose partial product plus the bound of the
   remaining coordinates (length of the rest of both) reaches theta;
3. the survivors are scored in 64-bit integers.

Bounds are doubles, widened by one part in a million; scores are never rounded. Theta starts at the k-th best score
among scouts, the vectors of one in SCOUTS ids, so that all tasks prune from their first bucket on and vectors too
short for any item are not read (the length is a Parquet column that the scan filters). A task returns at most k rows for an item.

Cases: a null or empty text, or one without a term, has no vector and is not counted in N. Equal scores are ranked by
ascending id, null ids last, then in no stated order. Each row is a document of its own, also if rows repeat; each row of the items
is ranked for itself, so rows of one id give as many rankings. Items without a term, and empty tables, give no rows.
Texts are read whole. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.llm.common import Batches, as_bytes, at_rest, column, map_arrow
from textmart.sources.tables import spread

TOP = 10
BLOCK_BYTES = 4 << 20  # of item texts searched for in one pass
SCOUTS = 16
_SLACK = 1 + 1e-6

# Terms are runs of ASCII letters and digits and of all that is not ASCII; only A-Z are lower-cased.
_TERMS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
               for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


@dataclass(frozen=True)
class Statistics:
    """What weights are made of: documents with a term, all their terms, and for each item term the documents it is in."""

    documents: int
    length: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        ratio = (2 * self.documents + 2) / (2 * self.df + 1)
        return np.floor(1000 * np.log(ratio)).astype(np.int64)

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * self.documents) // self.length
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _lists(sizes: list[int], values: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _project(batches: Batches, vocabulary: dict[bytes, int]) -> Batches:
    """Each text's number of terms, and its terms of the vocabulary with their frequencies."""
    for batch in batches:
        n, sizes, found, counts = [], [], [], []
        for text in as_bytes(batch["text"]):
            words = terms(text)
            tf = Counter(map(vocabulary.get, words))
            tf.pop(None, None)
            n.append(len(words))
            sizes.append(len(tf))
            found += tf.keys()
            counts += tf.values()
        yield pa.record_batch({
            "doc": batch["doc"], "n": pa.array(n, pa.int64()),
            "terms": _lists(sizes, np.array(found, np.int32)), "tf": _lists(sizes, np.array(counts, np.int32))})


def _count(batches: Batches, size: int) -> Batches:
    """Per task, documents with each term; under -1 and -2 the documents with any term and the sum of their terms."""
    df, documents, length = np.zeros(size, np.int64), 0, 0
    for batch in batches:
        df += np.bincount(batch["terms"].flatten().to_numpy(), minlength=size)
        n = batch["n"].to_numpy()
        documents, length = documents + int((n > 0).sum()), length + int(n.sum())
    here = np.flatnonzero(df)
    yield pa.record_batch({"term": np.concatenate([here, [-1, -2]]), "n": np.concatenate([df[here], [documents, length]])})


def _statistics(projected: DataFrame, size: int) -> Statistics:
    counted = map_arrow(projected.select("n", "terms"), partial(_count, size=size), "term long, n long")
    df, totals = np.zeros(size, np.int64), {}
    for term, n in counted.groupBy("term").agg(F.sum("n")).collect():  # a row per term of the block's items
        if term < 0:
            totals[term] = n
        else:
            df[term] = n
    return Statistics(totals.get(-1, 0), totals.get(-2, 0), df)


def _weigh(batches: Batches, statistics: Statistics) -> Batches:
    """Impact vectors and their lengths; terms of weight 0 add nothing and are left out, as are vectors without any other."""
    weights = statistics.weights()
    for batch in batches:
        sizes = batch["terms"].value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        term, tf = batch["terms"].flatten().to_numpy(), batch["tf"].flatten().to_numpy().astype(np.int64)
        used = weights[term] > 0
        owner, term, tf = owner[used], term[used], tf[used]
        impact = statistics.impacts(tf, batch["n"].to_numpy()[owner])
        norm = np.sqrt(np.bincount(owner, weights[term] * impact.astype(float) ** 2, minlength=len(sizes)))
        kept = np.flatnonzero(norm > 0)
        sizes = np.bincount(owner, minlength=len(sizes))[kept]  # the others have no terms or impacts of 0 alone
        inside = np.isin(owner, kept)
        yield pa.record_batch({
            "doc": batch["doc"].take(pa.array(kept)), "norm": norm[kept],
            "terms": _lists(sizes, term[inside]), "impacts": _lists(sizes, impact[inside].astype(np.int32))})


@dataclass(frozen=True)
class Item:
    """An item's terms, largest coordinates first, with their exact factors and the length of what follows each."""

    terms: np.ndarray
    factors: np.ndarray  # occurrences times weight
    coordinates: np.ndarray  # occurrences times the weight's root
    rest: np.ndarray  # rest[i]: length of coordinates[i:]

    @staticmethod
    def of(counts: Counter, weights: np.ndarray) -> Item:
        term = np.array([t for t in counts if weights[t] > 0], np.int64)
        times = np.array([counts[t] for t in term.tolist()], np.int64)
        at = np.argsort(-times * np.sqrt(weights[term]), kind="stable")
        term, times = term[at], times[at]
        coordinates = times * np.sqrt(weights[term])
        rest = np.sqrt(np.append(np.cumsum((coordinates ** 2)[::-1])[::-1], 0))
        return Item(term, times * weights[term], coordinates, rest)


class Bucket:
    """Vectors of about the same length, by row and by term."""

    def __init__(self, batch: pa.RecordBatch, roots: np.ndarray):
        sizes = batch["terms"].value_lengths().to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.term = batch["terms"].flatten().to_numpy()
        self.impact = batch["impacts"].flatten().to_numpy().astype(np.int64)
        self.norm = batch["norm"].to_numpy()
        self.longest = float(self.norm.max())
        order = np.argsort(self.term, kind="stable")
        self.row = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.value = (self.impact * roots[self.term])[order]
        self.first = np.searchsorted(self.term[order], np.arange(len(roots) + 1))

    def survivors(self, item: Item, theta: int) -> np.ndarray:
        """The rows that may score `theta` or more."""
        if item.rest[0] * self.longest * _SLACK < theta:
            return np.empty(0, np.int64)
        # As few of the largest coordinates as leave a rest that is below theta by itself.
        focus = int(np.argmax(item.rest * self.longest * _SLACK < theta))
        product, seen = np.zeros(len(self.norm)), np.zeros(len(self.norm))
        for t, q in zip(item.terms[:focus].tolist(), item.coordinates[:focus].tolist()):
            rows, values = self.row[self.first[t]:self.first[t + 1]], self.value[self.first[t]:self.first[t + 1]]
            product[rows] += q * values
            seen[rows] += values * values
        here = np.flatnonzero(seen > 0)
        unseen = np.sqrt(np.maximum(self.norm[here] ** 2 - seen[here], 0) + 1e-9 * self.norm[here] ** 2)
        return here[(product[here] + item.rest[focus] * unseen) * _SLACK >= theta]

    def scores(self, rows: np.ndarray, item: Item, dense: np.ndarray) -> np.ndarray:
        """Exact scores of `rows`; `dense` is an array of zeros, one per term, and is one again afterwards."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        begins = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(begins - self.starts[rows], sizes)
        dense[item.terms] = item.factors
        found = np.add.reduceat(dense[self.term[at]] * self.impact[at], begins)
        dense[item.terms] = 0
        return found


def _search(batches: Batches, items: list[Item], weights: np.ndarray, theta: list[int], k: int) -> Batches:
    """The k best of this task for each item, among those that score theta or more: (item, doc, score)."""
    theta, roots, dense, kind = list(theta), np.sqrt(weights), np.zeros(len(weights), np.int64), None
    best: list[list] = [[] for _ in items]
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, bucket = batch["doc"].type, Bucket(batch, roots)
        for i, item in enumerate(items):
            rows = bucket.survivors(item, theta[i]) if len(item.terms) else ()
            if not len(rows):
                continue
            scores = bucket.scores(rows, item, dense)
            least = max(theta[i], int(np.partition(scores, -k)[-k]) if len(scores) > k else 1)
            good = scores >= least
            docs = batch["doc"].take(pa.array(rows[good])).to_pylist()
            best[i] = heapq.nsmallest(k, best[i] + [
                (-s, d is None, d if d is not None else 0, d) for s, d in zip(scores[good].tolist(), docs)], key=lambda x: x[:3])
            if len(best[i]) == k:
                theta[i] = max(theta[i], -best[i][-1][0])
    rows = [(i, entry[3], -entry[0]) for i, entries in enumerate(best) for entry in entries]
    if rows:
        item, doc, score = zip(*rows)
        yield pa.record_batch({"item": pa.array(item, pa.int32()), "doc": pa.array(doc, kind), "score": pa.array(score, pa.int64())})


def _best(vectors: DataFrame, items: list[Item], weights: np.ndarray, theta: list[int], k: int) -> DataFrame:
    """(item, doc, score, rank) of the k best of all `vectors` for each item; scores below theta are not looked for."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), vectors.schema["doc"], T.StructField("score", T.LongType())])
    found = map_arrow(vectors, partial(_search, items=items, weights=weights, theta=theta, k=k), schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list[tuple[object, list[bytes]]], k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, listed in block for t in listed))}
    schema = T.StructType([docs.schema["doc"], T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
    projected = at_rest(map_arrow(docs, partial(_project, vocabulary=vocabulary), schema), "search-terms")
    statistics = _statistics(projected, len(vocabulary))
    weights = statistics.weights()
    items = [Item.of(Counter(vocabulary[t] for t in listed), weights) for _, listed in block]
    schema = T.StructType([docs.schema["doc"], T.StructField("norm", T.DoubleType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("impacts", T.ArrayType(T.IntegerType()))])
    weighed = map_arrow(projected.where("size(terms) > 0"), partial(_weigh, statistics=statistics), schema)
    # Longest first; equal ones, as copies are, are dealt out by id.
    ordered = at_rest(weighed.repartitionByRange(F.desc("norm"), F.xxhash64("doc")).sortWithinPartitions(F.desc("norm")), "search-vectors")
    scouts = _best(ordered.where(F.pmod(F.xxhash64("doc"), F.lit(SCOUTS)) == 0), items, weights, [1] * len(items), k)
    theta = [1] * len(items)
    for row in scouts.where(F.col("rank") == k).select("item", "score").collect():  # a row per item at most
        theta[row["item"]] = row["score"]
    least = min((t / (i.rest[0] * _SLACK) for t, i in zip(theta, items) if len(i.terms)), default=0.0)
    return _best(ordered.where(F.col("norm") >= least), items, weights, theta, k)


def _blocks(rows: Iterator, size: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    block, held = [], 0
    for row in rows:
        text = (row["text"] or "").encode()
        block.append((row["item"], terms(text)))
        held += len(text)
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of each item: (item_col, rank, doc_col, score)."""
    spark = docs.sparkSession
    docs = docs.select(column(docs, doc_col).alias("doc"), column(docs, text_col).cast("string").alias("text"))
    items = items.select(column(items, item_col).alias("item"), column(items, item_text).cast("string").alias("text"))
    docs = spread(docs)
    result = None
    for block in _blocks(items.toLocalIterator(), block_bytes):
        found = at_rest(_search_block(docs, block, k), "search-found")
        names = spark.createDataFrame(
            list(enumerate(name for name, _ in block)),
            T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", items.schema["item"].dataType)]))
        # A row per item of the block.
        part = found.join(F.broadcast(names), "item").select(
            F.col("name").alias(item_col), "rank", F.col("doc").alias(doc_col), "score")
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = spark.createDataFrame([], T.StructType([
            T.StructField(item_col, items.schema["item"].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(doc_col, docs.schema["doc"].dataType), T.StructField("score", T.LongType())]))
    return result
