"""Language-model scores from an Elias-Fano trie of word pairs that is built and read in shards.

Counts of words come first: partial sums per batch, then one shuffle. Next the positions of all texts, training ones and
others, go once through a shuffle to the shard of their context (the word before): packed arrays, a row per batch and
shard. A shard counts its training pairs, builds a `PairTrie` of its contexts in a memory map, and looks up all its
positions. Only sums per document come back. The model is never in one place: its shards grow in number with the
corpus, not in size. What a shard needs from outside are the counts of the words that follow in its training pairs: those of
frequent words are broadcast (at most FREQUENT of 16 bytes, 16 MB), those of the others come by a join of the distinct
(shard, word) with the counts.

The model: absolute discounting. P(w | v) = (c(v w) - D) / c(v) + A(v) P1(w) for pairs seen in training, A(v) P1(w) for
others, with A(v) = D x followers(v) / c(v) (1 for an unseen v). P1 is the base model of single words. Frequent words are
those with over 1 / FREQUENT of all tokens, so fewer than FREQUENT of them; this only says how a count travels. Weights and
scores in the trie are one-byte codes.

A context with more than `shard_bytes / 8` positions is split by the following word; its count is known from the word
counts, and its followers are counted beforehand, from the distinct pairs of such contexts. Positions after such a word
stay in several tasks. A pair that is in very many texts is in one shard, with 12 bytes for each place where it occurs.

Words are known by 64-bit hashes (XXH64). Rows are read as Spark deals them out; the scan must be repeatable, as that
of a table is. Cases: a null text is empty; an empty text is scored as its end alone. Repeated rows each get a row. A
null id is never held out. With nothing to learn from, all words are unknown. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmart.llm.common import LOWER, Batches, as_bytes, at_rest, column, map_arrow
from textmart.llm.elias_fano import PairTrie

SHARD_BYTES = 16 << 20   # of text whose positions make a shard, about
BATCH_BYTES = 8 << 20    # of text that is packed together
FREQUENT = 1 << 20
DISCOUNT = 0.75
END, START = 0, 1        # hashes of the end, which is a token, and of the start, which is only a context

_U64 = np.uint64
_PACKED = "shard int, batch long, data binary, ids array<{id}>, train array<boolean>, sizes array<long>"
_FOLLOWERS = "shard int, word long"
_PARTS = ("batch long, docs array<int>, score array<double>, base array<double>, known array<long>, "
          "rare_docs array<int>, rare array<long>, ids array<{id}>, train array<boolean>, sizes array<long>")


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _tokens(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def _count(batches: Batches) -> Batches:
    """(word, n) of the training texts of a batch, their ends included."""
    for batch in batches:
        counts: dict[bytes, int] = {}
        ends = 0
        for text, train in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            if train:
                ends += 1
                for word in _tokens(text):
                    counts[word] = counts.get(word, 0) + 1
        words = np.array([END, *map(_hash, counts)] if ends else [], _U64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words.view(np.int64)), pa.array([ends, *counts.values()] if ends else [], pa.int64())],
            names=["word", "n"])


def _width(top: int) -> type:
    return np.uint16 if top < 1 << 16 else np.uint32


def _narrow(values: np.ndarray, top: int) -> np.ndarray:
    return values.astype(_width(int(top)))


def _positions(batch: pa.RecordBatch, shards: int, split) -> tuple:
    """Sizes of the texts, hashes of the words, and per position: document, word before, word, shard."""
    split_words, split_parts = split
    ids: dict[bytes, int] = {}
    sizes, tokens = [], []
    for text in as_bytes(batch.column(1)):
        words = _tokens(text)
        sizes.append(len(words) + 1)
        tokens.append(np.array([1, *[ids.setdefault(w, len(ids) + 2) for w in words], 0], np.int64))
    train = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = np.array([END, START, *map(_hash, ids)], _U64)
    docs = np.repeat(np.arange(len(sizes)) * 2 + train, sizes)
    before = np.concatenate([t[:-1] for t in tokens]) if tokens else np.zeros(0, np.int64)
    word = np.concatenate([t[1:] for t in tokens]) if tokens else np.zeros(0, np.int64)
    shard_of = (hashes % _U64(shards)).astype(np.int64)
    at = np.minimum(np.searchsorted(split_words, hashes), max(0, len(split_words) - 1))
    parts = np.where(split_words[at] == hashes, split_parts[at], 1) if len(split_words) else np.ones(len(hashes), np.int64)
    shard = shard_of[before]
    several = np.flatnonzero(parts[before] > 1)
    shard[several] += ((hashes[word[several]] >> _U64(7)) % parts[before[several]].astype(_U64)).astype(np.int64)
    shard %= shards
    return sizes, hashes, docs, before, word, shard


def _pack(batches: Batches, shards: int, split) -> Batches:
    """Every position of a batch to the shard of its context."""
    squeeze = zstandard.ZstdCompressor(level=1)
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        sizes, hashes, docs, before, word, shard = _positions(batch, shards, split.value)
        order = np.argsort(shard * len(hashes) + before, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        rows, data = [], []
        within, place = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)  # a shard's words, and their places
        for s in np.flatnonzero(np.diff(cut)):
            here = order[cut[s]:cut[s + 1]]
            n, doc, context, follower = len(here), docs[here], before[here], word[here]
            within[context] = within[follower] = True
            used = np.flatnonzero(within)
            within[used] = False
            place[used] = np.arange(len(used))
            body = [np.array([len(used), n, int(doc.max())], np.int64), hashes[used],
                    _narrow(np.diff(place[context], prepend=0), len(used)), _narrow(place[follower], len(used)),
                    _narrow(doc, doc.max())]
            rows.append(int(s))
            data.append(squeeze.compress(b"".join(b.tobytes() for b in body)))
        n = len(rows)
        kind = pa.list_(batch.schema.field(0).type)
        none = [None] * n
        yield pa.RecordBatch.from_arrays([
            pa.array([*rows, number % shards], pa.int32()), pa.array([number] * (n + 1), pa.int64()),
            pa.array([*data, None], pa.binary()), pa.array([*none, batch.column(0).to_pylist()], kind),
            pa.array([*none, batch.column(2).to_pylist()], pa.list_(pa.bool_())),
            pa.array([*none, sizes], pa.list_(pa.int64())),
        ], names=["shard", "batch", "data", "ids", "train", "sizes"])
        number += 1


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    used, n, most = (int(v) for v in np.frombuffer(body, np.int64, 3))
    at, rest = 24 + 8 * used, []
    for top in (used, used, most):
        rest.append(np.frombuffer(body, _width(top), n, at))
        at += rest[-1].nbytes
    return np.frombuffer(body, _U64, used, 24), np.cumsum(rest[0], dtype=np.int32), rest[1], rest[2].astype(np.int32)


def _followers(batches: Batches, shards: int, split, frequent) -> Batches:
    """(shard, word) of the training pairs for words that are not frequent, distinct per batch."""
    for batch in batches:
        _, hashes, _, _, word, shard = _positions(batch, shards, split.value)
        often = frequent.value[0]
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        here = np.flatnonzero((often[at] != hashes)[word] if len(often) else np.ones(len(word), bool))
        shard, word = np.divmod(np.unique(shard[here] * len(hashes) + word[here]), len(hashes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard.astype(np.int32)), pa.array(hashes[word].view(np.int64))], names=["shard", "word"])


def _split_pairs(batches: Batches, split) -> Batches:
    """(context, word) of the training pairs of split contexts, distinct per batch."""
    for batch in batches:
        _, hashes, _, before, word, _ = _positions(batch, 1, split.value)
        here = np.flatnonzero(np.isin(hashes, split.value[0])[before])
        pairs = np.divmod(np.unique(before[here] * len(hashes) + word[here]), len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(hashes[p].view(np.int64)) for p in pairs], names=["context", "word"])


def _pack_counts(batches: Batches) -> Batches:
    """Counts of words, (shard, word, n) sorted by shard, as a row per shard."""
    now, held = None, []

    def finished() -> pa.RecordBatch:
        word, many = (np.concatenate(c) for c in zip(*held))
        body = [np.array([len(word), many.max()], np.int64), word, _narrow(many, many.max())]
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(b.tobytes() for b in body))
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data], pa.binary())], names=["shard", "data"])

    for rows in batches:
        shard, word, many = (rows.column(c).to_numpy() for c in ("shard", "word", "n"))
        for s in np.unique(shard):
            if s != now and held:
                yield finished()
                held = []
            now = int(s)
            held.append((word[shard == s].view(_U64), many[shard == s]))
    if held:
        yield finished()


def _unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    n, most = (int(v) for v in np.frombuffer(body, np.int64, 2))
    return np.frombuffer(body, _U64, n, 16), np.frombuffer(body, _width(most), n, 16 + 8 * n).astype(np.int64)


def score_shard(packed: list[tuple[int, bytes]], frequent: tuple[np.ndarray, np.ndarray],
                others: tuple[np.ndarray, np.ndarray], split: tuple[np.ndarray, np.ndarray, np.ndarray],
                total: float) -> list[tuple]:
    """Build a shard's trie from its training positions and score all of them.

    `frequent` and `others` are the counts of words; all that follow in the shard's training pairs are in one of them.
    `split` has the contexts that are in several shards, their counts and numbers of followers.
    Per batch: documents, their sums (score without the words in `rare`, base, known words), and the words unseen after
    their context that are in neither, for which P1 is still to be added. `total` is N + (V + 1) / 2.
    """
    parts = [_unpack(d) for _, d in packed]
    words = np.unique(np.concatenate([p[0] for p in parts]))
    before, word, docs = [], [], []
    for hashes, b, w, d in parts:
        place = np.searchsorted(words, hashes)
        before.append(place[b].astype(np.int32))
        word.append(place[w].astype(np.int32))
        docs.append(d)
    del parts
    sizes = [len(b) for b in before]
    before, word, docs = (np.concatenate(x) for x in (before, word, docs))
    train = (docs & 1).astype(np.int8)
    pairs, place = np.unique(before.astype(np.int64) * len(words) + word, return_inverse=True)
    place = place.ravel().astype(np.int32)
    count = np.bincount(place, train, len(pairs))
    context, follower = np.divmod(pairs, len(words))
    seen = np.flatnonzero(count > 0)

    def table(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The value of each of the shard's words, 0 if it is not in the table."""
        if not len(keys):
            return np.zeros(len(words))
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        return np.where(keys[at] == words, values[at], 0).astype(float)

    seen_before = np.bincount(before, train, len(words))
    followers = np.bincount(context[seen], minlength=len(words)).astype(float)
    in_parts = table(split[0], split[1])
    seen_before = np.where(in_parts > 0, in_parts, seen_before)
    followers = np.where(in_parts > 0, table(split[0], split[2]), followers)
    often = table(*frequent) + table(*others)
    p1 = (often + 0.5) / total
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.minimum(1.0, np.where(seen_before > 0, DISCOUNT * followers / seen_before, 1.0))
    own = np.flatnonzero((seen_before > 0) & (followers > 0))  # the shard's contexts
    slot = np.zeros(len(words), np.int64)
    slot[own] = np.arange(len(own))
    c, f = context[seen], follower[seen]
    p = (count[seen] - DISCOUNT) / seen_before[c] + weight[c] * p1[f]
    trie = PairTrie.build(words[own], np.log10(weight[own]), slot[c], words[f], np.log10(p))

    known, back_off, paired, score = trie.lookup(words[context], words[follower])
    back_off = np.where(known, back_off, 0.0)
    plain = often[follower] > 0
    value = np.where(paired, score, back_off + np.where(plain, np.log10(p1[follower]), 0.0))
    rare = ~paired & ~plain
    token = words[before] != START
    base = np.where(token, np.log10(seen_before + 0.5)[before], 0.0)
    of_known = token & (seen_before[before] > 0)
    value, rare = value[place], rare[place]
    out, at = [], 0
    for (batch, _), n in zip(packed, sizes):
        here = slice(at, at + n)
        at += n
        d = docs[here] >> 1
        found, to = np.unique(d, return_inverse=True)
        sums = [np.bincount(to.ravel(), v[here], len(found)) for v in (value, base, of_known)]
        odd = rare[here]
        out.append((batch, found, *sums, d[odd], words[word[here][odd]]))
    return out


def _score(batches: Batches, frequent, split, total: float) -> Batches:
    """Rows come sorted by shard; a shard's rows are held together, the batches' descriptions pass through."""
    now, held = None, []
    counts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # by shard, of words that are not frequent

    def finished() -> pa.RecordBatch | None:
        word, many = (np.concatenate(c) for c in zip(*counts.pop(now, [(np.zeros(0, _U64), np.zeros(0, np.int64))])))
        order = np.argsort(word)
        found = score_shard(held, frequent.value, (word[order], many[order]), split, total)
        n = len(found)
        nothing = pa.nulls(n, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int32())),
            pa.array([f[2] for f in found], pa.list_(pa.float64())), pa.array([f[3] for f in found], pa.list_(pa.float64())),
            pa.array([f[4].astype(np.int64) for f in found], pa.list_(pa.int64())),
            pa.array([f[5] for f in found], pa.list_(pa.int32())),
            pa.array([f[6].view(np.int64) for f in found], pa.list_(pa.int64())),
            pa.nulls(n, kind), pa.nulls(n, pa.list_(pa.bool_())), nothing], names=names)

    names = ["batch", "docs", "score", "base", "known", "rare_docs", "rare", "ids", "train", "sizes"]
    kind = None
    for rows in batches:
        kind = rows.schema.field("ids").type
        told = rows.filter(rows.column("data").is_null())
        if told.num_rows:
            n = told.num_rows
            yield pa.RecordBatch.from_arrays(
                [told.column("batch"), *[pa.nulls(n, pa.list_(t)) for t in (pa.int32(), pa.float64(), pa.float64(),
                                                                            pa.int64(), pa.int32(), pa.int64())],
                 told.column("ids"), told.column("train"), told.column("sizes")], names=names)
        for shard, batch, data in zip(*(rows.column(c).to_pylist() for c in ("shard", "batch", "data"))):
            if data is None:
                continue
            if batch is None:
                counts.setdefault(shard, []).append(_unpack_counts(data))
                continue
            if shard != now and held:
                yield finished()
                held = []
            now = shard
            held.append((batch, data))
    if held:
        yield finished()


def _add_up(table: pa.Table) -> pa.Table:
    """All rows of a batch: one row per document."""
    told = table.filter(table["ids"].is_valid())
    ids, train, sizes = (told[c].combine_chunks().flatten() for c in ("ids", "train", "sizes"))
    sums = np.zeros((3, len(ids)))
    rest = table.filter(table["docs"].is_valid())
    docs = rest["docs"].combine_chunks().flatten().to_numpy()
    for row, name in zip(sums, ("score", "base", "known")):
        np.add.at(row, docs, rest[name].combine_chunks().flatten().to_numpy())
    n = len(ids)
    return pa.table({
        "batch": pa.array([table["batch"][0].as_py()] * n, pa.int64()), "doc": pa.array(np.arange(n, dtype=np.int32)),
        "id": ids, "train": train, "n_tokens": sizes, "score": pa.array(sums[0]), "base": pa.array(sums[1]),
        "n_known": pa.array(sums[2].astype(np.int64))})


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
          shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of `docs`, learning from those that meet `train`: (id, train, n_tokens, n_known, train_tokens,
    base_score, score)."""
    spark = docs.sparkSession
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"),
                       F.coalesce(train, F.lit(True)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = map_arrow(rows, _count, "word long, n long", BATCH_BYTES)
    counts = at_rest(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    n, v, ends = counts.agg(F.sum("n"), F.count(F.lit(1)), F.max(F.when(F.col("word") == END, F.col("n")))).first()
    n, v, ends = n or 0, v, ends or 0
    total = n + 0.5 * (v + 1)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def sorted_words(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = table.toArrow()
        word, many = found["word"].to_numpy().view(_U64), found["n"].to_numpy()
        order = np.argsort(word)
        return word[order], many[order]

    frequent = sorted_words(counts.where(F.col("n") * FREQUENT > n))  # fewer than FREQUENT rows
    most = max(1, shard_bytes // 8)
    hot = frequent[1] > most
    # The start is a context once per training text.
    split_words, split_counts = frequent[0][hot & (frequent[0] != END)], frequent[1][hot & (frequent[0] != END)]
    if ends > most:
        split_words, split_counts = np.append(split_words, _U64(START)), np.append(split_counts, ends)
    order = np.argsort(split_words)
    split_words, split_counts = split_words[order], split_counts[order]
    split_parts = -(-split_counts // most)
    context = spark.sparkContext
    shared = context.broadcast((split_words, split_parts))
    packed = map_arrow(rows, partial(_pack, shards=shards, split=shared), _PACKED.format(id=kind), BATCH_BYTES)
    often = context.broadcast(frequent)
    learned = rows.where("train")
    split_followers = np.zeros(len(split_words), np.int64)
    if len(split_words):
        behind = map_arrow(learned, partial(_split_pairs, split=shared), "context long, word long", BATCH_BYTES)
        found = behind.distinct().groupBy("context").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row per split word
        split_followers[np.searchsorted(split_words, found["context"].to_numpy().view(_U64))] = found["n"].to_numpy()
    followers = map_arrow(learned, partial(_followers, shards=shards, split=shared, frequent=often), _FOLLOWERS, BATCH_BYTES)
    counted = followers.repartition("word").distinct().join(counts, "word").select("shard", "word", "n")
    told = map_arrow(counted.sortWithinPartitions("shard"), _pack_counts, "shard int, data binary", BATCH_BYTES)
    dealt = (packed.unionByName(told, allowMissingColumns=True)
             .repartitionById(shards, "shard").sortWithinPartitions("shard"))  # one shard a task
    parts = at_rest(map_arrow(dealt, partial(
        _score, frequent=often, split=(split_words, split_counts, split_followers), total=total), _PARTS.format(id=kind), BATCH_BYTES), "lm-parts")

    added = parts.drop("rare_docs", "rare").groupBy("batch").applyInArrow(
        _add_up, f"batch long, doc int, id {kind}, train boolean, n_tokens long, score double, base double, n_known long")
    rare = parts.where(F.size("rare") > 0).select(
        "batch", F.inline(F.arrays_zip(F.col("rare_docs").alias("doc"), F.col("rare").alias("word"))))
    rest = (rare.join(counts, "word", "left").groupBy("batch", "doc")
            .agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / total)).alias("rest")))
    return added.join(rest, ["batch", "doc"], "left").select(
        F.col("id"), "train", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(ends + 0.5)) - F.col("n_tokens") * F.log10(F.lit(total))).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))
