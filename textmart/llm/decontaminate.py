"""Benchmark decontamination with suffix arrays of the training texts.

Every batch of documents is a shard. The positions of a shard at which a benchmark word pair (or word, if there are
items of one word) begins are its suffixes; they are sorted by their first words into a suffix array, and every
distinct benchmark window is looked up in it by binary search. From the positions found, matches are followed word by
word to their full length. Other suffixes cannot match a window and are not sorted.

The benchmark is the stated query set: it comes in blocks of bounded size, each held by every task in turn. Documents
are not shuffled, and each is searched whole inside one shard, so a passage that many documents share costs no more
than other text.

Cases: null texts (documents or items) have no words, and no words are never hit. Repeated rows of documents each get
their row. Items with equal ids count once; an item without an id counts as the id "". Columns of other names are
kept by `decontaminate` and ignored by `find_matches`. Empty tables give empty or untouched results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmart.llm.common import Batches, as_bytes, at_rest, column, map_arrow

WINDOW = 10
BLOCK_BYTES = 32 << 20  # of benchmark text that a task holds at once

# Letters A-Z to lower case, what is no word character to a space. All bytes of other characters are word bytes.
_WORD_BYTES = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))

FOUND = ("n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>, "
         "matches array<struct<start:int,n_words:int,item_id:string,item_start:int>>")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ITEMS = pa.list_(pa.string())
_MATCHES = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("item_id", pa.string()),
                               ("item_start", pa.int32())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def _unique_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the place of each row among them."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


@dataclass
class Queries:
    """The windows of a block of benchmark items, ready to be searched for."""

    words: dict[bytes, int]     # word -> id from 1; 0 is any other word, and the gap between texts
    windows: np.ndarray         # distinct windows, in order, zeros behind the short ones
    lengths: np.ndarray
    holders: list[list[int]]    # per window, the items that hold it
    first: list[tuple[int, int]]  # per window, item and position of its first occurrence
    names: list[str]            # item ids as text
    pairs: np.ndarray           # sorted codes of the windows' first word pairs; empty if a window has one word
    text: np.ndarray            # word ids of all items, a 0 behind each
    starts: np.ndarray          # where each item begins in it
    order: np.ndarray | None    # suffix array of the text; None if longest matches are not asked for
    ranges: np.ndarray          # per window of full length, where its suffixes begin and end in the suffix array


def _suffixes(text: np.ndarray, longest: int) -> np.ndarray:
    """Positions of the items' text in the order of what begins there, up to the end of an item, by prefix doubling."""
    rank, done = text, 1
    while True:
        ahead = np.zeros(len(text), np.int64)
        ahead[:max(0, len(text) - done)] = rank[done:]
        codes = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(codes, kind="stable")
        done *= 2
        if done > longest:
            return order
        ordered = codes[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def prepare(items: list[tuple[str, bytes | None]], window: int = WINDOW, longest: bool = True) -> Queries | None:
    """Index a block of (item id, text), with what longest matches need or without; None if it has no words."""
    words: dict[bytes, int] = {}
    owner, tokens, starts, sizes, names = [], [], [], [], []
    for name, text in items:
        found = words_of(text)
        if found:
            starts.append(len(tokens))
            sizes.append(len(found))
            names.append(name)
            tokens.extend(words.setdefault(w, len(words) + 1) for w in found)
            tokens.append(0)
            owner.extend([len(names) - 1] * (len(found) + 1))
    if not names:
        return None
    text, owner = np.array(tokens, np.int64), np.array(owner)
    counts = [max(1, n - window + 1) for n in sizes]
    at = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts)])
    length = np.repeat([min(window, n) for n in sizes], counts)
    padded = np.concatenate([text, np.zeros(window, np.int64)])
    rows = np.where(np.arange(window) < length[:, None], padded[at[:, None] + np.arange(window)], 0)
    windows, place = _unique_rows(rows)
    size = np.zeros(len(windows), np.int64)
    size[place] = length
    holders: list[set[int]] = [set() for _ in range(len(windows))]
    first = [None] * len(windows)
    for w, p in zip(place.tolist(), at.tolist()):
        item = int(owner[p])
        holders[w].add(item)
        if first[w] is None:
            first[w] = (item, p - starts[item])
    pairs = np.unique(windows[:, 0] * (len(words) + 1) + windows[:, 1]) if size.min() > 1 else np.array([], np.int64)
    order, ranges = None, np.zeros((len(windows), 2), np.int64)
    if longest:
        order = _suffixes(text, max(sizes))
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text))
        full = length == window
        ranges[:, 0] = len(text)
        np.minimum.at(ranges[:, 0], place[full], rank[at[full]])
        np.maximum.at(ranges[:, 1], place[full], rank[at[full]] + 1)
    return Queries(words, windows, size, [sorted(h) for h in holders], first, names, pairs, text, np.array(starts), order, ranges)


def suffix_array(tokens: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the shard's suffixes that may match, in the order of their first words; and those words."""
    width = queries.windows.shape[1]
    padded = np.concatenate([tokens, np.zeros(width, tokens.dtype)])
    at = np.flatnonzero(tokens)
    if len(queries.pairs):
        code = padded[at] * (len(queries.words) + 1) + padded[at + 1]
        place = np.minimum(np.searchsorted(queries.pairs, code), len(queries.pairs) - 1)
        at = at[queries.pairs[place] == code]
    keys = padded[at[:, None] + np.arange(width)]
    keys[np.logical_or.accumulate(keys == 0, axis=1)] = 0  # a match cannot go on behind a word of no item
    order = np.lexsort(keys.T[::-1])
    return at[order], keys[order]


def _bound(keys: np.ndarray, windows: np.ndarray, lengths: np.ndarray, behind: bool) -> np.ndarray:
    """Binary search: how many suffixes are before each window (or before what follows its matches)."""
    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(keys), np.int64)
    inside = np.arange(windows.shape[1]) < lengths[:, None]
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, len(keys) - 1)
        there = keys[middle]
        unlike = (there != windows) & inside
        column = unlike.argmax(axis=1)
        row = np.arange(len(windows))
        equal = ~unlike[row, column]
        before = np.where(equal, behind, there[row, column] < windows[row, column])
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low


def search(tokens: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of windows in a shard: positions and windows."""
    at, keys = suffix_array(tokens, queries)
    if not len(at):
        return at, at
    low = _bound(keys, queries.windows, queries.lengths, False)
    count = _bound(keys, queries.windows, queries.lengths, True) - low
    window = np.repeat(np.arange(len(low)), count)
    offset = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    return at[low[window] + offset], window


def _longest(tokens: np.ndarray, at: np.ndarray, window: np.ndarray, queries: Queries):
    """Full length of the match at each position, and where in the benchmark it is: (length, item, item position)."""
    length = queries.lengths[window].copy()
    where = np.array(queries.first, np.int64).reshape(-1, 2)[window]
    item, start = where[:, 0].copy(), where[:, 1].copy()
    alive = np.flatnonzero(length == queries.windows.shape[1])
    low, high = queries.ranges[window].T.copy()  # of the suffixes that go on like the text
    size = queries.windows.shape[1]
    last = len(queries.text) - 1

    def bound(begin: np.ndarray, end: np.ndarray, word: np.ndarray, behind: bool) -> np.ndarray:
        begin, end = begin.copy(), end.copy()
        while (open_ := begin < end).any():
            middle = np.minimum((begin + end) // 2, last)
            there = queries.text[np.minimum(queries.order[middle] + size, last)]
            before = there <= word if behind else there < word
            begin = np.where(open_ & before, middle + 1, begin)
            end = np.where(open_ & ~before, middle, end)
        return begin

    grown = np.zeros(len(at), bool)
    while len(alive):
        ahead = at[alive] + size
        word = np.where(ahead < len(tokens), tokens[np.minimum(ahead, len(tokens) - 1)], 0)
        alive, word = alive[word > 0], word[word > 0]
        begin = bound(low[alive], high[alive], word, False)
        end = bound(begin, high[alive], word, True)
        on = begin < end
        alive = alive[on]
        low[alive], high[alive] = begin[on], end[on]
        grown[alive] = True
        size += 1
        length[alive] += 1
    longer = np.flatnonzero(grown)
    if len(longer):  # the first place of each that goes on so far
        ends, which = np.unique(np.stack([low[longer], high[longer]], axis=1), axis=0, return_inverse=True)
        where = np.array([queries.order[a:b].min() for a, b in ends.tolist()])[which.ravel()]
        item[longer] = np.searchsorted(queries.starts, where, "right") - 1
        start[longer] = where - queries.starts[item[longer]]
    return length, item, start


def scan(texts: list[bytes | None], queries: Queries | None) -> list[tuple[int, list, list, list]]:
    """Per text: number of words, hit spans [start, end), ids of items found, and longest matches."""
    if queries is None:
        return [(len(words_of(t)), [], [], []) for t in texts]
    known = queries.words.get
    starts, parts, sizes, total = [], [], [], 0
    for text in texts:
        found = words_of(text)
        starts.append(total)
        sizes.append(len(found))
        parts.append(np.fromiter((known(w, 0) for w in found), np.int64, len(found)))
        parts.append(np.zeros(1, np.int64))
        total += len(found) + 1
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    at, window = search(tokens, queries)
    order = np.lexsort((window, at))
    at, window = at[order], window[order]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + queries.lengths[window], -1)
    hit = np.concatenate([[0], np.cumsum(edge) > 0]).astype(np.int8)
    change = np.diff(hit)
    begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    at_hits, window_hits = at, window
    if queries.order is None:
        at, window = at[:0], window[:0]
    length, item, start = _longest(tokens, at, window, queries)
    # Only matches that do not lie inside the one before them are told.
    reach = np.maximum.accumulate(at + length) if len(at) else at
    told = np.ones(len(at), bool)
    told[1:] = (at + length)[1:] > reach[:-1]
    begin_doc = np.searchsorted(starts, begins, "right") - 1
    match_doc = np.searchsorted(starts, at, "right") - 1
    out = [(n, [], [], []) for n in sizes]
    for d, b, e in zip(begin_doc.tolist(), begins.tolist(), ends.tolist()):
        out[d][1].append((b - starts[d], e - starts[d]))
    hit_doc = np.searchsorted(starts, at_hits, "right") - 1
    distinct = np.unique(hit_doc * len(queries.windows) + window_hits)
    held: dict[int, set[int]] = {}
    for code in distinct.tolist():
        held.setdefault(code // len(queries.windows), set()).update(queries.holders[code % len(queries.windows)])
    for d, items in held.items():
        out[d][2].extend(sorted({queries.names[i] for i in items}))
    for i in np.flatnonzero(told).tolist():
        d = int(match_doc[i])
        out[d][3].append((int(at[i]) - starts[d], int(length[i]), queries.names[int(item[i])], int(start[i])))
    return out


def _union(a: list, b: list) -> list:
    merged: list = []
    for start, end in sorted(a + b):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _structs(values: list, fields: tuple, kind: pa.DataType) -> pa.Array:
    return pa.array([[dict(zip(fields, v)) for v in row] for row in values], kind)


def _search_batches(batches: Batches, queries, text: int, keep: int, clean_only: bool) -> Batches:
    """Adds the found columns behind the first `keep`; joins them with those of earlier blocks if there are any."""
    block = queries.value
    for batch in batches:
        found = scan(as_bytes(batch.column(text)), block)
        n = [f[0] for f in found]
        spans, items, matches = ([f[i] for f in found] for i in (1, 2, 3))
        if batch.num_columns > keep:
            old = [batch.column(keep + i).to_pylist() for i in (2, 3, 4)]
            spans = [_union([(x["start"], x["end"]) for x in o], s) for o, s in zip(old[0], spans)]
            items = [sorted({*o, *i}) for o, i in zip(old[1], items)]
            matches = [[tuple(x.values()) for x in o] + m for o, m in zip(old[2], matches)]
        columns = [batch.column(i) for i in range(keep)]
        hits = [sum(e - s for s, e in row) for row in spans]
        if clean_only:
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:keep]).filter(
                pa.array([h == 0 for h in hits], pa.bool_()))
            continue
        columns += [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), _structs(spans, ("start", "end"), _SPANS),
                    pa.array(items, _ITEMS), _structs(matches, ("start", "n_words", "item_id", "item_start"), _MATCHES)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keep], "n_words", "n_hit", "spans",
                                                         "items", "matches"])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int,
            longest: bool) -> list:
    """The benchmark in blocks of about `block_bytes`, one at a time on the driver."""
    items = benchmark.select(F.coalesce(column(benchmark, item_col).cast("string"), F.lit("")).alias("id"),
                             column(benchmark, text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    share = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = (items if blocks == 1 else items.where(share == b)).collect()
        yield prepare([(r["id"], r["text"].encode() if r["text"] is not None else None) for r in rows], longest=longest)


def _run(docs: DataFrame, benchmark: DataFrame, text_at: int, item_col: str, benchmark_text: str, block_bytes: int,
         clean_only: bool) -> DataFrame:
    spark, keep = docs.sparkSession, len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(keep)])
    own = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    result = plain
    for queries in _blocks(benchmark, item_col, benchmark_text, block_bytes, not clean_only):
        if result is not plain and clean_only is False:
            result = at_rest(result, "decontaminate")
        shared = spark.sparkContext.broadcast(queries)  # grows in proportion to a block's words
        schema = own if clean_only else f"{own}, {FOUND}"
        result = map_arrow(result, partial(_search_batches, queries=shared, text=text_at, keep=keep,
                                           clean_only=clean_only), schema)
    return result


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", benchmark_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: `id_col`, n_words, n_hit, hit spans, ids of the items found, longest matches and their places."""
    chosen = docs.select(column(docs, id_col), column(docs, text_col).cast("string"))
    found = _run(chosen, benchmark, 1, item_col, benchmark_text, block_bytes, False)
    return found.withColumnRenamed("c0", id_col).drop("c1")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  benchmark_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs`, with all its columns, without the documents in which a benchmark window occurs."""
    names = docs.columns
    at = [n.lower() for n in names].index(text_col.lower())
    return _run(docs, benchmark, at, item_col, benchmark_text, block_bytes, True).toDF(*names)
