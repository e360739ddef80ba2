"""Suffix-array dedup: bytes inside any window of `window` bytes that also starts elsewhere are removed.

A depth-limited radix sort of all suffixes: they are dealt out by most significant digits, a suffix alone in its group
drops out, and after `window` bytes equal groups are exactly the repeated windows. No suffix is shuffled by itself:

* First digit. Of the 64-byte grams in a window, the one with the smallest hash is its anchor (the leftmost of equal
  ones); equal windows have equal anchors at equal places. The windows of one text with the same anchor make a *run* of
  neighbouring starts. Runs are dealt out by their anchor's hash, as thin rows with a digest of their bytes.
* All windows of runs with equal bytes are repeated. A task folds the equal runs it finds before anything is shuffled, so
  a run that is in a third of all texts is a row per task. An anchor with one text of a run is settled. Only runs that
  share an anchor and differ go on, with their bytes, one for each text of a run. Anchors of more than 1 / SHARE of the runs
  are dealt out by the digests of their runs.
* Next digits. A task sorts the suffixes of its groups by digits of DIGIT bytes through `window` bytes, and drops those alone
  in their group after each digit. A digit's value is a 64-bit hash; groups that are equal at the end are compared byte by byte,
  and sorted by their bytes if a hash should have lied.
* A group of more than GROUP different runs is not for one task. Its runs are cut into shorter ones of PART starts, dealt
  out by the bytes that all their windows share, a longer digit; and if that is not enough, into single windows,
  whose equal ones are just counted. So no group of unbounded size meets in one place, at any number of copies.

Texts are read where they lie, and known by a digest of id and text; they are packed when they are joined with their runs or spans.

Cases: null is empty; nothing is removed from texts of fewer than `window` bytes. Repeated rows are copies of each other,
also if ids repeat. Overlaps count, in one text, too (`aaaa...`). A cut may fall inside a character: the kept bytes are
given as binary. Long texts take memory in proportion in one task. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.llm.common import Batches, as_bytes, at_rest, column, map_arrow
from textmart.sources.tables import spread

WINDOW = 400
DIGIT = 50
GRAM = 64
GROUP = 1_000
PART = 16
BATCH_BYTES = 8 << 20
BATCH_RUNS = 50_000
SHARE = 2_000

_RNG = np.random.default_rng(20240613)
_CODES = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes (a power of two) from each place on, by doubling."""
    found, power, held = _CODES[data], np.full(1, _BASE), 1
    while held < size:
        found = found[:-held] * power + found[held:]
        power, held = power * power, 2 * held
    found ^= found >> np.uint64(32)
    found *= _MIX
    found ^= found >> np.uint64(29)
    return found


def anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's anchor, and the hashes of all grams."""
    hashes = gram_hashes(data, gram)
    # The smallest hash (its upper half), then the leftmost place.
    keys = (hashes >> _HALF << _HALF) | np.arange(len(hashes), dtype=np.uint64)
    width, held = window - gram + 1, 1
    while held * 2 <= width:
        keys, held = np.minimum(keys[:-held], keys[held:]), held * 2
    if held < width:
        keys = np.minimum(keys[:held - width], keys[width - held:])
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _runs(text: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and numbers of windows of the runs of a text, how far ahead their anchors are, and the anchors' hashes."""
    data = np.frombuffer(text, np.uint8)
    at, hashes = anchors(data, window, gram)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return first, np.diff(np.append(first, len(at))), at[first] - first, hashes[at[first]].astype(np.int64)


class _Rows:
    """Runs of several texts, given out in batches in which equal ones are folded."""

    def __init__(self, window: int):
        self.window, self.parts, self.digests, self.held = window, [], [], 0

    def add(self, text: bytes, row: bytes, start: np.ndarray, count: np.ndarray, lead: np.ndarray, key: np.ndarray) -> None:
        self.digests += [_digest(text[s:e]) for s, e in zip(start.tolist(), (start + count + (self.window - 1)).tolist())]
        self.parts.append((key, np.full(len(start), np.void(row)), start, count, lead))
        self.held += len(start)

    def take(self) -> pa.RecordBatch:
        """A row for each different run, with its copies; then one without digest for each run that has copies here."""
        key, row, start, count, lead = (np.concatenate(x) for x in zip(*self.parts))
        digest = np.frombuffer(b"".join(self.digests), "V16")
        self.parts, self.digests, self.held = [], [], 0
        halves = digest.view(np.uint64).reshape(-1, 2)
        order = np.lexsort(halves.T)
        opens = np.append(True, (halves[order[1:]] != halves[order[:-1]]).any(axis=1))
        copies = np.diff(np.append(np.flatnonzero(opens), len(order)))
        first, settled = order[opens], order[np.repeat(copies > 1, copies)]
        at = np.concatenate([first, settled])
        return pa.record_batch({
            "key": key[at], "digest": _binary(digest[at], 16, len(first)), "row": _binary(row[at], 16, len(at)),
            "start": start[at].astype(np.int64), "count": count[at].astype(np.int32), "lead": lead[at].astype(np.int32),
            "copies": np.concatenate([copies, np.zeros(len(settled))]).astype(np.int32)})


def _binary(values: np.ndarray, size: int, valid: int) -> pa.Array:
    """Values of one size as binary; null from the `valid`-th on."""
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(values), [None, pa.py_buffer(values.tobytes())])
    return pa.concat_arrays([fixed[:valid].cast(pa.binary()), pa.nulls(len(values) - valid, pa.binary())])


def _first_digit(batches: Batches, window: int, gram: int) -> Batches:
    rows = _Rows(window)
    for batch in batches:
        for row, text in zip(batch["row"].to_pylist(), as_bytes(batch["text"])):
            if len(text) >= window:
                found = _runs(text, window, gram)
                for begin in range(0, len(found[0]), BATCH_RUNS):  # of a very long text
                    rows.add(text, row, *[x[begin:begin + BATCH_RUNS] for x in found])
                    if rows.held >= BATCH_RUNS:
                        yield rows.take()
    if rows.held:
        yield rows.take()


_RUN = "key long, digest binary, row binary, start long, count int, lead int, copies int"


def _pack(batches: Batches) -> Batches:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array(list(map(packer.compress, as_bytes(batch["text"]))), pa.binary())
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", packed)


def _unpacked(column: pa.Array) -> list[bytes]:
    unpacker = zstandard.ZstdDecompressor()
    return [unpacker.decompress(text) for text in column.to_pylist()]


def _next_digit(batches: Batches, window: int, part: int) -> Batches:
    """The listed runs of each text in parts of at most `part` starts, keyed by the bytes that all windows of a part share.

    A part's windows begin in a block of `part` places before their anchor. The shared bytes are those of the whole
    block, also if a run has only some of its windows.
    """
    rows = _Rows(window)
    for batch in batches:
        for row, text, runs in zip(batch["row"].to_pylist(), _unpacked(batch["text"]), batch["runs"].to_pylist()):
            for run in runs:
                # Blocks of `part` places before the anchor: the same ones in every text.
                lead = run["lead"] - np.arange(run["count"])
                first = np.flatnonzero(np.append(True, np.diff(lead // part) != 0))
                start, anchor = run["start"] + first, run["start"] + run["lead"]
                low = (lead[first] // part * part).tolist()
                core = [int.from_bytes(_digest(text[anchor - at:anchor - at - part + 1 + window])[:8], "little", signed=True) for at in low]
                rows.add(text, row, start, np.diff(np.append(first, run["count"])), lead[first], np.array(core, np.int64))
                if rows.held >= BATCH_RUNS:
                    yield rows.take()
    if rows.held:
        yield rows.take()


def _bytes_of(batches: Batches, window: int) -> Batches:
    """The bytes of the listed runs of each text."""
    for batch in batches:
        keys, rows, starts, counts, alone, pieces = [], [], [], [], [], []
        for row, text, runs in zip(batch["row"].to_pylist(), _unpacked(batch["text"]), batch["runs"].to_pylist()):
            keys += [r["key"] for r in runs]
            rows += [row] * len(runs)
            starts += [r["start"] for r in runs]
            counts += [r["count"] for r in runs]
            alone += [r["alone"] for r in runs]
            pieces += [text[r["start"]:r["start"] + r["count"] - 1 + window] for r in runs]
        for begin in range(0, len(keys), BATCH_RUNS):
            end = begin + BATCH_RUNS
            yield pa.record_batch({
                "key": pa.array(keys[begin:end], pa.int64()), "row": pa.array(rows[begin:end], pa.binary()),
                "start": pa.array(starts[begin:end], pa.int64()), "count": pa.array(counts[begin:end], pa.int32()),
                "alone": pa.array(alone[begin:end], pa.bool_()), "bytes": pa.array(pieces[begin:end], pa.binary())})


_BYTES = "key long, row binary, start long, count int, alone boolean, bytes binary"


def repeated_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray, window: int, digit: int = DIGIT) -> np.ndarray:
    """Which of the suffixes at `at` share their first `window` bytes with another one of their group.

    Most significant digits first: each pass orders the suffixes of every group by their next `digit` bytes and
    makes groups of equal ones; a suffix alone in its group is done.
    """
    powers = np.cumprod(np.full(len(data), _BASE, np.uint64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * powers)])
    inverse = np.cumprod(np.full(len(data), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
    alive, label = np.arange(len(at)), group.astype(np.uint64)
    for depth in range(0, window, digit):
        size = min(digit, window - depth)
        begin = at[alive] + depth
        value = (prefix[begin + size] - prefix[begin]) * inverse[begin]
        value = (value ^ (value >> np.uint64(31))) * _MIX + label * _CODES[depth // digit]
        order = np.argsort(value, kind="stable")
        value = value[order]
        same = value[1:] == value[:-1]
        kept = np.append(same, False) | np.append(False, same)
        first = np.append(True, ~same)
        alive, label = alive[order][kept], np.cumsum(first)[kept].astype(np.uint64)
        if not len(alive):
            break
    # Groups are equal by their hashes; compare neighbours byte by byte.
    found = np.zeros(len(at), bool)
    for begin in range(0, len(alive), 20_000):
        # One back, so that every pair of neighbours is in a block.
        block, names = alive[max(0, begin - 1):begin + 20_000], label[max(0, begin - 1):begin + 20_000]
        rows = np.lib.stride_tricks.sliding_window_view(data, window)[at[block]]
        equal = (names[1:] == names[:-1]) & (rows[1:] == rows[:-1]).all(axis=1)
        equal &= group[block[1:]] == group[block[:-1]]
        found[block[1:][equal]] = True
        found[block[:-1][equal]] = True
        odd = np.flatnonzero((names[1:] == names[:-1]) & ~equal)
        if len(odd):  # unequal texts of one hash: group these by their bytes
            for name in np.unique(names[odd]).tolist():
                members = alive[label == name]
                seen: dict[tuple[int, bytes], list[int]] = {}
                for m in members.tolist():
                    seen.setdefault((int(group[m]), data[at[m]:at[m] + window].tobytes()), []).append(m)
                for listed in seen.values():
                    found[listed] = len(listed) > 1
    return found


def _sort_groups(batches: Batches, window: int) -> Batches:
    """Rows come in the order of their keys: whole groups are sorted together, as many as a batch has."""
    held: list[pa.RecordBatch] = []

    def settle(table: pa.Table) -> pa.RecordBatch:
        size = np.array(table["count"].to_numpy(), np.int64)
        pieces = table["bytes"].combine_chunks()
        data = np.frombuffer(b"".join(pieces.to_pylist()), np.uint8)
        first = np.cumsum(size + window - 1) - (size + window - 1)
        owner = np.repeat(np.arange(len(size)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        _, group = np.unique(table["key"].to_numpy(), return_inverse=True)
        found = repeated_suffixes(data, first[owner] + inside, group[owner], window)
        found &= table["alone"].to_numpy(zero_copy_only=False)[owner]
        # Neighbouring starts make one span.
        at = np.flatnonzero(found)
        begins = np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])) if len(at) else np.zeros(0, bool)
        begin, number = at[begins], np.diff(np.append(np.flatnonzero(begins), len(at)))
        start = table["start"].to_numpy()[owner[begin]] + inside[begin]
        return pa.record_batch({"row": table["row"].combine_chunks().take(pa.array(owner[begin])), "start": start, "end": start + number - 1 + window})

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        keys = table["key"].to_numpy()
        whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
        if whole:
            yield settle(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
    if held:
        yield settle(pa.Table.from_batches(held))


_SPAN = "row binary, start long, end long"


def _frequent(batches: Batches) -> Batches:
    """The anchors that have more than 1 / SHARE of a task's runs; few anchors have more than four of them."""
    keys = [batch["key"].to_numpy() for batch in batches]
    if keys:
        values, n = np.unique(np.concatenate(keys), return_counts=True)
        often = n > max(4, n.sum() // SHARE)
        yield pa.record_batch({"key": values[often], "n": n[often]})


def _listed(packed: DataFrame, runs: DataFrame) -> DataFrame:
    """Texts with the list of their `runs`: no more than a text has windows."""
    return packed.join(runs.groupBy("row").agg(F.collect_list(F.struct("key", "start", "count", "lead", "alone")).alias("runs")), "row")


def _settle(runs: DataFrame, group: int, last: bool) -> DataFrame:
    """The runs that have copies, and those that share an anchor with different ones: (key, row, start, count, lead, copied, alone, rival, large).

    `copied`: the run is repeated, which its task did not know. `rival`: the run stands for all its copies among
    others of its anchor; `large` if these are too many for one task.
    """
    held = runs.where("copies > 0")
    counted = map_arrow(held.select("key"), _frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # Each task lists fewer than SHARE anchors, and fewer than 10 * SHARE have so large a share of all runs.
    hot = at_rest(counted.where(F.col("n") * (10 * SHARE) > held.count()).select("key", F.lit(True).alias("hot")), "hot-anchors")
    hot_key = F.coalesce("hot", F.lit(False))
    dealt = held.join(F.broadcast(hot), "key", "left").withColumns(
        {"hot": hot_key, "deal": F.when(hot_key, F.xxhash64("digest")).otherwise(F.col("key"))}).repartition("deal")
    equal = Window.partitionBy("deal", "key", "digest")
    counted = dealt.withColumns({
        "total": F.sum("copies").over(equal), "place": F.row_number().over(equal.orderBy("row", "start"))})
    counted = counted.withColumn("different", F.sum(F.when(F.col("place") == 1, 1)).over(Window.partitionBy("deal", "key")))
    copied, alone = (F.col("total") > 1) & (F.col("copies") == 1), F.col("total") == 1
    rival = (F.col("place") == 1) & (F.col("hot") | (F.col("different") > 1))
    large = F.lit(False) if last else F.col("hot") | (F.col("different") > group)
    return at_rest(counted.where(copied | rival).select(
        "key", "row", "start", "count", "lead", copied.alias("copied"), alone.alias("alone"), rival.alias("rival"),
        large.alias("large")), "settled-runs")


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, part: int = PART) -> DataFrame:
    """The spans of `texts` (row, text) covered by repeated windows: (row, start, end) in bytes; they may overlap.

    `row` is binary, 16 bytes, and tells apart all rows but those that repeat.
    """
    digits = [partial(_next_digit, window=window, part=size) for size in (part, 1)]
    packed = map_arrow(texts.where(F.octet_length("text") >= window), _pack, "row binary, text binary", BATCH_BYTES)
    runs = at_rest(map_arrow(texts, partial(_first_digit, window=window, gram=gram), _RUN, BATCH_BYTES), "runs")
    span = ["row", "start", (F.col("start") + F.col("count") - 1 + window).alias("end")]
    spans = None
    while True:
        settled = _settle(runs, group, last=not digits)
        rivals = settled.where("rival")
        together = map_arrow(_listed(packed, rivals.where("NOT large")), partial(_bytes_of, window=window), _BYTES, BATCH_BYTES)
        ordered = together.repartition("key").sortWithinPartitions("key")
        found = runs.where("copies = 0").select(*span).unionByName(settled.where("copied").select(*span)).unionByName(
            map_arrow(ordered, partial(_sort_groups, window=window), _SPAN, BATCH_BYTES))
        spans = found if spans is None else spans.unionByName(found)
        large = rivals.where("large")
        if large.isEmpty():
            return spans
        runs = at_rest(map_arrow(_listed(packed, large), digits.pop(0), _RUN, BATCH_BYTES), "runs")


def _remove(batches: Batches) -> Batches:
    for batch in batches:
        kept, removed, listed = [], [], []
        for text, spans in zip(_unpacked(batch["text"]), batch["spans"].to_pylist()):
            merged: list[list[int]] = []
            for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            edges = [0, *[e for span in merged for e in span], len(text)]
            kept.append(b"".join([text[s:e] for s, e in zip(edges[::2], edges[1::2])]))
            removed.append(len(text) - len(kept[-1]))
            listed.append([{"start": s, "end": e} for s, e in merged])
        yield pa.record_batch({
            "doc": batch["doc"], "n_bytes": pa.array([len(k) + r for k, r in zip(kept, removed)], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()),
            "spans": pa.array(listed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   gram: int = GRAM, group: int = GROUP, part: int = PART) -> DataFrame:
    """(doc, n_bytes, n_removed, kept, spans), a row per document: what stays of its bytes, and the maximal removed spans."""
    gram = min(gram, 1 << (window // 2).bit_length() - 1) if window > 1 else 1
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    docs = spread(docs.select(column(docs, id_col).alias("doc"), text.alias("text")))
    name = F.col("doc").cast("string")
    named = F.concat(F.coalesce(F.length(name).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(name, F.lit("")), "text")
    texts = docs.withColumn("row", F.unhex(F.md5(named)))
    spans = repeated_spans(texts.select("row", "text"), window, gram, group, part)
    packed = map_arrow(texts, _pack, T.StructType([texts.schema["doc"], *T._parse_datatype_string("text binary, row binary").fields]), BATCH_BYTES)
    listed = packed.join(spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "row", "left")
    schema = T.StructType([texts.schema["doc"], *T._parse_datatype_string(
        "n_bytes long, n_removed long, kept binary, spans array<struct<start: long, end: long>>").fields])
    return map_arrow(listed.select("doc", "text", "spans"), _remove, schema, BATCH_BYTES)
