"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A (a byte-level BPE of the `tokenizers` library) cuts a space and the text, tokenizer B (a `sentencepiece` model, which adds
the space) the text. Both give token bytes, so every token has a byte range. Per batch and keyed by document,
`pandas.merge_asof` finds for each token start the other side's covering token; the union of both directions is every
overlapping pair of tokens. Overlapping pairs that end at the same byte are *links*; their ends cut both sequences into *groups*.

`pair_counts` counts over the corpus how often two ids are linked, and `score_links` reads those counts back into the
documents: pairs with more than 1 / HOT_PAIRS of all links, so fewer than HOT_PAIRS of them, are looked up in an array
that every task holds; the others are joined, and none of them has more than that share of the rows.

Neither tokenizer forms a token that holds a space behind another character (checked when they are loaded; otherwise
texts are cut whole), so a text is cut into tokens in pieces that begin at a single space between two other characters, and a
worker keeps the tokens of up to PIECES pieces. Results are those of whole texts.

Cases: a null or empty text, and one whose tokens' bytes of either side are not those of the space and the text, has no
tokens: zeros and empty lists. Special tokens' strings in a text are plain text. Each row has its own result, also
if rows or ids repeat. Texts are cut whole; memory in a task grows with its longest text. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.llm.common import Batches, at_rest, column, map_arrow
from textmart.sources.tables import spread

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BATCH_BYTES = 2 << 20
SECTION = 1 << 19  # tokens of A that are aligned at once, unless one text has more
PIECES, PIECE_CHARS = 500_000, 10_000
HOT_PAIRS = 1 << 18

# A space between two characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s|^\s|\s\Z")  # in texts without these, every space is such a space


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes bytes as printable characters: itself if it is one, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their ids, and the tokens of pieces seen before."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        alphabet = _byte_alphabet()
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.b = SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("a tokenizer has an id without bytes")
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        cutter = spec["pre_tokenizer"] or {}
        self.by_pieces = (
            spec["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
            and not cutter.get("add_prefix_space") and not any(re.search(rb"[^ ] ", t) for t in self.b_bytes))
        # Ids as text with each separator that can follow, for the texts of groups.
        self.a_text = np.array([f"{i}{end}" for end in "|," for i in range(len(self.a_bytes))], object)
        self.b_text = np.array([f"{i}{end}" for end in (";", ",", "") for i in range(len(self.b_bytes))], object)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.stops, self.same = (array("i"), array("i")), (array("q", [0]), array("q", [0])), array("b")

    def _cut(self, text: str) -> list[str]:
        if not self.by_pieces:
            return [text]
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def _whole(self, a: list[int], b: list[int], text: str) -> bool:
        """Whether the tokens of both sides have the bytes of the space and the text."""
        return b"".join([self.a_bytes[i] for i in a]) == (" " + text).encode() == b"".join([self.b_bytes[i] for i in b])

    def _learn(self, pieces: list[str]) -> None:
        for begin in range(0, len(pieces), 10_000):
            some = [" " + p for p in pieces[begin:begin + 10_000]]
            size = np.fromiter(map(len, map(str.encode, some)), np.int64, len(some))
            whole, same = "".join(some).encode(), np.ones(len(some), bool)
            encodings = self.a.encode_batch_fast(some, add_special_tokens=False)
            both = [e.ids for e in encodings], self.b.encode([p[1:] for p in some], num_threads=1)
            for side, (found, table, sizes) in enumerate(zip(both, (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes))):
                flat, length = list(chain.from_iterable(found)), np.fromiter(map(len, found), np.int64, len(found))
                ends = np.concatenate([[0], np.cumsum(length)])
                held = np.concatenate([[0], np.cumsum(sizes[flat])])[ends]
                if b"".join([table[i] for i in flat]) != whole or (np.diff(held) != size).any():
                    same &= [b"".join([table[i] for i in ids]) == p.encode() for ids, p in zip(found, some)]
                self.ids[side].extend(flat)
                self.stops[side].extend((self.stops[side][-1] + ends[1:]).tolist())
            self.same.extend(same.tolist())
            self.place.update(zip(pieces[begin:begin + 10_000], range(len(self.place), len(self.place) + len(some))))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts in a row, and how many each text has; none if the bytes of a side differ."""
        cut = [self._cut(t) if t else [] for t in texts]
        pieces = set(chain.from_iterable(cut))
        new = pieces.difference(self.place)
        if len(self.place) + len(new) > PIECES:
            self._forget()
            new = pieces
        self._learn(list(new))
        sizes = np.array([len(parts) for parts in cut], np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        result = []
        for ids, stops in zip(self.ids, self.stops):
            first = np.frombuffer(stops, np.int64)[at]
            length = np.frombuffer(stops, np.int64)[at + 1] - first
            taken = np.arange(length.sum()) + np.repeat(first - np.cumsum(length) + length, length)
            number = np.bincount(owner, length, minlength=len(texts)).astype(np.int64)
            result.append((np.frombuffer(ids, np.int32)[taken].astype(np.int64) if len(taken) else taken, number))
        odd = np.unique(owner[np.frombuffer(self.same, np.int8)[at] == 0]) if len(at) else at
        if len(odd):
            stops = [np.concatenate([[0], np.cumsum(number)]) for _, number in result]
            gone = [t for t in odd.tolist() if not self._whole(*[
                ids[stop[t]:stop[t + 1]].tolist() for (ids, _), stop in zip(result, stops)], texts[t])]
            result = [(ids[~np.isin(np.repeat(np.arange(len(texts)), number), gone)],
                       np.where(np.isin(np.arange(len(texts)), gone), 0, number)) for ids, number in result]
        if max(map(len, pieces), default=0) > PIECE_CHARS:
            self._forget()  # very long pieces are not kept
        return result


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Pair:
    """Once per worker process."""
    return Pair(a_path, b_path)


def overlaps(a_start: np.ndarray, a_doc: np.ndarray, b_start: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens (positions in either side) whose byte ranges meet; starts ascend, documents have places of their own in them."""
    a = pd.DataFrame({"start": a_start, "doc": a_doc, "a": np.arange(len(a_start))})
    b = pd.DataFrame({"start": b_start, "doc": b_doc, "b": np.arange(len(b_start))})
    covering_b = pd.merge_asof(a, b, on="start", by="doc")
    covering_a = pd.merge_asof(b, a, on="start", by="doc")
    # Two tokens that start together are found from both sides.
    other = a_start[covering_a["a"].to_numpy()] != b_start
    left = np.concatenate([covering_b["a"].to_numpy(), covering_a["a"].to_numpy()[other]])
    right = np.concatenate([covering_b["b"].to_numpy(), covering_a["b"].to_numpy()[other]])
    return left, right


def _section(pair: Pair, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, detail: bool) -> dict[str, object]:
    """The results of some documents, aligned together: their ids in a row on both sides, and how many each has."""
    docs = len(n_a)
    a_doc, b_doc = np.repeat(np.arange(docs), n_a), np.repeat(np.arange(docs), n_b)
    a_end, b_end = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    left, right = overlaps(a_end - pair.a_sizes[a], a_doc, b_end - pair.b_sizes[b], b_doc)
    equal = a_end[left] == b_end[right]
    # No token is empty: an end has one pair. In order, each closes a group of tokens of both sides.
    link_a, link_b = np.sort(left[equal]), np.sort(right[equal])
    n_links = np.bincount(a_doc[link_a], minlength=docs)
    closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    closes_a[link_a], closes_b[link_b] = True, True
    a_group, b_group = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b

    # The text of the groups: ids of A, a bar, ids of B, a semicolon.
    written = np.empty(len(a) + len(b), object)
    last = np.append(b_doc[1:] != b_doc[:-1], True)
    before = np.concatenate([[0], link_b + 1])
    written[np.arange(len(a)) + before[a_group]] = pair.a_text[a + len(pair.a_bytes) * ~closes_a]
    written[np.arange(len(b)) + link_a[b_group] + 1] = pair.b_text[b + len(pair.b_bytes) * np.where(closes_b, 2 * last, 1)]
    written, stops = written.tolist(), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    groups = ["".join(written[begin:end]) for begin, end in zip(stops, stops[1:])]

    # The distinct linked ids of a document, and how often it links them.
    size_b = len(pair.b_bytes)
    size = len(pair.a_bytes) * size_b
    codes = np.sort(a_doc[link_a] * size + a[link_a] * size_b + b[link_b])
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else codes
    times = np.diff(np.append(first, len(codes)))
    of_doc, codes = np.divmod(codes[first], size)
    result = {
        "n_a": n_a, "n_b": n_b, "n_groups": n_links, "n_links": n_links, "groups": groups,
        "links": _structs(np.bincount(of_doc, minlength=docs), {"a": codes // size_b, "b": codes % size_b, "n": times})}
    if detail:
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        at = np.lexsort([right, left])
        doc = a_doc[left[at]]
        result["overlaps"] = _structs(np.bincount(doc, minlength=docs), {
            "a": left[at] - first_a[doc], "b": right[at] - first_b[doc]})
    return result


def _structs(sizes: np.ndarray, fields: dict[str, np.ndarray]) -> pa.Array:
    structs = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), structs)


def _align(batches: Batches, a_path: str, b_path: str, detail: bool) -> Batches:
    pair = load(a_path, b_path)
    for batch in batches:
        (a, n_a), (b, n_b) = pair.encode(batch["text"].to_pylist())
        a_stop, b_stop = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        sections = (np.flatnonzero(np.diff(a_stop[1:] // SECTION)) + 1).tolist()
        for begin, end in zip([0, *sections], [*sections, batch.num_rows]):
            if begin < end:
                found = _section(pair, a[a_stop[begin]:a_stop[end]], n_a[begin:end], b[b_stop[begin]:b_stop[end]], n_b[begin:end], detail)
                yield pa.record_batch({"doc": batch["doc"][begin:end], **found})


def align(docs: DataFrame, folder: str = FOLDER, a: str = BYTE_BPE, b: str = PIECE_BPE, id_col: str = "doc_id",
          text_col: str = "text", detail: bool = False) -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, groups, links), a row per document.

    `groups` is text: the ids of A and B of each group, as in "a1,a2|b1;a3|b2,b3". `links` lists a document's distinct
    linked ids: (a, b, n). With `detail`, `overlaps` lists the overlapping tokens by their places in the sequences: (a, b).
    """
    docs = spread(docs.select(column(docs, id_col).alias("doc"), column(docs, text_col).cast("string").alias("text")))
    number, pairs = T.LongType(), T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    schema = T.StructType([docs.schema["doc"], *[T.StructField(n, number) for n in ("n_a", "n_b", "n_groups", "n_links")],
                           T.StructField("groups", T.StringType()),
                           T.StructField("links", T.ArrayType(T.StructType([*pairs.fields, T.StructField("n", T.IntegerType())])))])
    if detail:
        schema = schema.add("overlaps", T.ArrayType(pairs))
    function = partial(_align, a_path=f"{folder}/{a}", b_path=f"{folder}/{b}", detail=detail)
    return map_arrow(docs, function, schema, BATCH_BYTES)


def _flat(links: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, a, b and n of all entries of a list column."""
    sizes = links.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    entries = links.flatten()
    a, b, n = (entries.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    return np.repeat(np.arange(len(links)), sizes), a, b, n


def _count(batches: Batches) -> Batches:
    for batch in batches:
        _, a, b, n = _flat(batch["links"])
        codes, at = np.unique(a << 32 | b, return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, at, n)
        yield pa.record_batch({"a": (codes >> 32).astype(np.int32), "b": (codes & 0xFFFFFFFF).astype(np.int32), "n": total})


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How often ids are linked in the whole corpus, and whether that is the most for its b: (a, b, n, best); at rest."""
    counted = map_arrow(aligned.select("links"), _count, "a int, b int, n long")
    counts = at_rest(counted.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    # A row per id of B at most: its vocabulary.
    return at_rest(counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _read_hot(batches: Batches, codes: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Batches:
    """Sums over the hot links of each row, in a row without ids, and the other links as they are."""
    for batch in batches:
        row, a, b, n = _flat(batch["links"])
        key = a << 32 | b
        at = np.minimum(np.searchsorted(codes, key), len(codes) - 1) if len(codes) else np.zeros(len(key), np.int64)
        hot = codes[at] == key if len(codes) else np.zeros(len(key), bool)
        n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        np.add.at(n_best, row[hot], n[hot] * best[at[hot]])
        np.add.at(count_sum, row[hot], n[hot] * counts[at[hot]])
        rows, cold = batch["row"].to_numpy(), ~hot
        none = pa.nulls(batch.num_rows, pa.int32())
        yield pa.record_batch({"row": rows, "a": none, "b": none, "n": none.cast(pa.int64()), "n_best": n_best, "count_sum": count_sum})
        yield pa.record_batch({"row": rows[row[cold]], "a": a[cold].astype(np.int32), "b": b[cold].astype(np.int32), "n": n[cold],
                               "n_best": np.zeros(cold.sum(), np.int64), "count_sum": np.zeros(cold.sum(), np.int64)})


def score_links(aligned: DataFrame, counts: DataFrame, row: str = "row", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row of `aligned` (at rest, told apart by the number `row`): n_best, its links that are the most frequent of
    their b, and count_sum, the corpus counts of its links: (row, n_best, count_sum)."""
    total = counts.agg(F.sum("n")).scalar()
    hot = counts.where(F.col("n") * hot_pairs > total).select(
        F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("code"), "n", "best")
    hot = hot.toPandas().sort_values("code")  # fewer than hot_pairs rows
    function = partial(_read_hot, codes=hot["code"].to_numpy(np.int64), counts=hot["n"].to_numpy(np.int64),
                       best=hot["best"].to_numpy(np.int64))
    read = at_rest(map_arrow(aligned.select(F.col(row).cast("long").alias("row"), "links"), function,
                             "row long, a int, b int, n long, n_best long, count_sum long"), "links-read")
    looked_up = read.where("a IS NOT NULL").select("row", "a", "b", "n").join(
        counts.select("a", "b", F.col("n").alias("count"), "best"), ["a", "b"]).select(
        "row", (F.col("n") * F.col("best").cast("long")).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
    parts = read.where("a IS NULL").select("row", "n_best", "count_sum").unionByName(looked_up)
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digests(aligned: DataFrame) -> DataFrame:
    """A row per document of `align`, whose groups become a digest, with the corpus counts of its links."""
    kept = aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    kept = at_rest(kept.withColumn("row", F.monotonically_increasing_id()), "aligned")
    scored = score_links(kept, pair_counts(kept))
    return kept.join(scored, "row").select("doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
