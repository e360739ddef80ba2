"""Chat formatting by columnar byte assembly.

Turns are dealt out by ranges of (conversation, turn), so that a conversation of any length is spread over tasks, and
sorted. A task takes its turns batch by batch: segment lengths of the pieces of every turn, their cumulative offsets
and scatter indices are numpy arrays, and the pieces are copied into one preallocated buffer that becomes the data of
an Arrow string column. No text is joined row by row.

A turn is  <s>[INST] role [/INST]text</s>  . Control strings inside roles and texts get a backslash behind their first
character; those that already have backslashes there get one more, so `unescape` gives back every text.

A conversation comes in one or more parts, in the order of `part`: more than one where it is longer than PART_BYTES or
runs on into the next task. Loss spans are in code points of the part's text and cover the texts of the assistant.

Cases: null roles and texts are empty. Turns that tie are ordered by role, then a hash of the text; repeated rows stay. A null turn
comes first, a null conversation is a conversation of its own. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmart.llm.common import Batches, column, map_arrow

PART_BYTES = 1 << 20
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)

FORMATTED = "part long, formatted string, n_turns long, loss_starts array<long>, loss_ends array<long>"


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _strings(values: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Escaped strings without nulls; their bytes and offsets."""
    values = pc.replace_substring_regex(pc.fill_null(values.cast(pa.large_string()), ""), _CONTROL, r"\1\\\2\3")
    values = pa.concat_arrays([values])  # its own buffers, from offset 0
    if not len(values):
        return values, np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values, data[offsets[0]:offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: (bytes, start of each turn in bytes, and in code points the length of what comes
    before each text and of the text)."""
    n = len(roles)
    role, role_data, role_at = _strings(roles)
    text, text_data, text_at = _strings(texts)
    constants = [np.frombuffer(c.encode(), np.uint8) for c in (OPEN, MIDDLE, CLOSE)]
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = (len(c) for c in constants)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for piece, constant in zip((0, 2, 4), constants):
        out[starts[:, piece, None] + np.arange(len(constant))] = constant
    for piece, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        out[np.arange(len(data)) + np.repeat(starts[:, piece] - at[:-1], np.diff(at))] = data
    before = pc.utf8_length(role).to_numpy(zero_copy_only=False) + len(OPEN) + len(MIDDLE)
    return out, starts[:, 0], before, pc.utf8_length(text).to_numpy(zero_copy_only=False)


def _parts(rows: pa.RecordBatch, part_bytes: int, kind: pa.DataType) -> tuple[pa.RecordBatch, np.ndarray]:
    """One row per part of the turns given, without its number; and at which turn each part begins."""
    n = rows.num_rows
    out, start, before, size = assemble(rows.column(1), rows.column(2))
    ends = np.append(start, len(out))
    names = rows.column(0)
    code = pc.dictionary_encode(names, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = code[1:] != code[:-1]
    # A part of a long conversation ends with the turn that fills it.
    first = np.flatnonzero(new)
    begin = start[first[np.cumsum(new) - 1]]
    full = (start - begin) // part_bytes
    new[1:] |= full[1:] != full[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    offsets = pa.py_buffer(np.append(start[first], len(out)).astype(np.int64))
    formatted = pa.LargeStringArray.from_buffers(len(first), offsets, pa.py_buffer(out)).cast(pa.string())
    whole = before + size + len(CLOSE)
    behind = np.cumsum(whole) - whole
    behind -= np.repeat(behind[first], last - first)
    assistant = pc.fill_null(pc.equal(rows.column(1), "assistant"), False).to_numpy(zero_copy_only=False)
    count = np.add.reduceat(assistant.astype(np.int64), first) if n else np.zeros(0, np.int64)
    at = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
    spans = [pa.ListArray.from_arrays(at, pa.array(v[assistant].astype(np.int64)))
             for v in (behind + before, behind + before + size)]
    made = pa.RecordBatch.from_arrays(
        [names.take(pa.array(first)), formatted, pa.array((last - first).astype(np.int64)), *spans],
        names=["conv_id", "formatted", "n_turns", "loss_starts", "loss_ends"])
    return made, np.append(ends[first], len(out))


def _format(batches: Batches, part_bytes: int) -> Batches:
    """Keeps the last, open conversation back for the next batch unless it fills a part."""
    number = TaskContext.get().partitionId() << 33
    held: pa.Table | None = None

    def told(rows: pa.RecordBatch):
        nonlocal number
        made, _ = _parts(rows, part_bytes, rows.schema.field(0).type)
        parts = pa.array(np.arange(number, number + made.num_rows, dtype=np.int64))
        number += made.num_rows
        return pa.RecordBatch.from_arrays([made.column(0), parts, *made.columns[1:]],
                                          names=["conv_id", "part", *made.schema.names[1:]])

    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch], batch.schema)
        rows = rows.combine_chunks().to_batches()[0] if rows.num_rows else None
        if rows is None:
            continue
        ids = pc.dictionary_encode(rows.column(0), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change = np.flatnonzero(ids[1:] != ids[:-1])
        open_at = int(change[-1]) + 1 if len(change) else 0
        if rows.slice(open_at).nbytes > part_bytes:
            open_at = rows.num_rows
        if open_at:
            yield told(rows.slice(0, open_at))
        held = pa.Table.from_batches([rows.slice(open_at)]) if open_at < rows.num_rows else None
    if held is not None:
        yield told(held.combine_chunks().to_batches()[0])


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, part, formatted, n_turns, loss_starts, loss_ends): the conversations' texts and loss masks."""
    rows = turns.select(
        column(turns, conv_col).alias("conv_id"), column(turns, turn_col).alias("turn"),
        F.coalesce(column(turns, role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(column(turns, text_col).cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    placed = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_arrow(placed.select("conv_id", "role", "text"), partial(_format, part_bytes=part_bytes),
                     f"conv_id {kind}, {FORMATTED}")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        for role, text in parse(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for s, e in zip(starts, ends):
            text = unescape(formatted[s:e])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(batches: Batches) -> Batches:
    """Digests of sorted parts; holds the sums of one conversation at a time."""
    none = object()
    now, sums, done, ids = none, _Digest(), [], []

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done))
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, formatted, starts, ends in zip(*(batch.column(c).to_pylist() for c in
                                                   ("conv_id", "formatted", "loss_starts", "loss_ends"))):
            if now is none or conv != now:
                if now is not none:
                    ids.append(now)
                    done.append(sums.row())
                now, sums = conv, _Digest()
            sums.add(formatted, starts, ends)
        if done:
            yield flush(kind)
            ids, done = [], []
    if now is not none:
        ids, done = [now], [sums.row()]
        yield flush(kind)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what is read back from its parts: turns, loss text, lengths and their digests."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    placed = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return map_arrow(placed, _read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                         "loss_sha256 string, formatted_chars long")
