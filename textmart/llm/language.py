"""Language identification by a bidirectional recurrent network over bytes.

The network reads a text piece by piece: a piece is a run without white space, with a space at each end, and at most
PIECE bytes of it. Every position of a piece gets log probabilities of the languages, from the states of both
directions. A document's probabilities pool those of all its positions: mean over a piece, sum over the pieces.
As pieces do not depend on what stands around them, a task computes a distinct piece once and remembers it (at most
CACHE of them); the result is the same as for computing every occurrence.

Training takes about TRAIN_DOCS documents and WORDS distinct pieces of each language, chosen by hash (a piece as
likely as it is frequent); the network is fitted on the driver from these at most WORDS x languages pieces.

Cases: texts that are null or have no letter are `und` with score 0. Rows without a language are not learned from.
If nothing can be learned, all texts are `und`. Repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmart.llm import gru
from textmart.llm.common import LOWER, Batches, as_bytes, at_rest, column, map_arrow

TRAIN_DOCS = 500
WORDS = 5_000
LANGUAGES = 200     # more distinct values of the language column are refused
HIDDEN = 16
EPOCHS = 4
PIECE = 32
CACHE = 300_000
CHUNK = 2 << 20     # bytes of text whose new pieces are computed together

_LETTER_BYTE = re.compile(rb"[A-Za-z\x80-\xff]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def pieces(text: bytes) -> list[bytes]:
    found = text.translate(LOWER).split()
    if any(map(PIECE.__lt__, map(len, found))):
        found = [w[i:i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode(errors="replace")))


@dataclass
class Model:
    languages: list[str]
    weights: gru.Weights | None

    def positions(self, words: list[bytes]) -> list[np.ndarray]:
        """Log probabilities at every byte of each piece (bytes x languages)."""
        out: list[np.ndarray] = [np.zeros((0, len(self.languages)), np.float32)] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for rows in by_length.values():
            for at in range(0, len(rows), 4096):
                some = rows[at:at + 4096]
                ids = np.array([np.frombuffer(b" " + words[i] + b" ", np.uint8) for i in some])
                logp = gru.log_probabilities(self.weights, ids)[1:-1]
                for k, i in enumerate(some):
                    out[i] = logp[:, k]
        return out


class _Pool:
    """Pooled log probabilities of pieces, by piece."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1, len(self.model.languages)), np.float32)  # row 0: no letter

    def learn(self, words: set[bytes]) -> None:
        new = []
        for word in words:
            if _LETTER_BYTE.search(word):
                new.append(word)
            else:
                self.row[word] = 0
        if not new:
            return
        new.sort(key=len)
        means = np.empty((len(new), self.table.shape[1]), np.float32)
        sizes = np.array([len(w) for w in new])
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            for at in range(0, len(rows), 4096):
                some = rows[at:at + 4096]
                joined = np.frombuffer(b"".join(b" " + new[i] + b" " for i in some), np.uint8).reshape(len(some), n + 2)
                means[some] = gru.log_probabilities(self.model.weights, joined)[1:-1].mean(axis=0)
        at = len(self.table)
        self.row.update(zip(new, range(at, at + len(new))))
        self.table = np.concatenate([self.table, means])

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        split = [pieces(t) if t else [] for t in texts]
        unseen: set[bytes] = set()
        for words in split:
            unseen.update(words)
        unseen.difference_update(self.row.keys())
        if len(self.row) + len(unseen) > CACHE and self.row:
            self.clear()
            unseen = set().union(*split)
        self.learn(unseen)
        out = []
        for text, words in zip(texts, split):
            if not words or not has_letter(text):
                out.append(("und", 0.0))
                continue
            rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
            total = self.table[rows].sum(axis=0, dtype=np.float64)
            p = np.exp(total - total.max())
            p /= p.sum()
            best = int(p.argmax())
            out.append((self.model.languages[best], float(p[best])))
        return out


def _predict(batches: Batches, model) -> Batches:
    pool = _Pool(model.value) if model.value.weights is not None else None
    for batch in batches:
        texts = as_bytes(batch.column(1))
        found: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or b"") <= CHUNK):
                size += len(texts[end] or b"")
                end += 1
            found += pool.predict(texts[at:end]) if pool else [("und", 0.0)] * (end - at)
            at = end
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=["id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) per row."""
    chosen = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 x 3 x HIDDEN x 2 numbers and a little
    return map_arrow(chosen, partial(_predict, model=shared), f"id {kind}, lang_pred string, score double"
                     ).withColumnRenamed("id", id_col)


def label_positions(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, language, mean probability) of a text's bytes with one most likely language."""
    data = text.encode().translate(LOWER)
    spans: list[list] = []
    starts, words = [], []
    for m in re.finditer(rb"\S+", data):
        for at in range(m.start(), m.end(), PIECE):
            piece = data[at:min(at + PIECE, m.end())]
            if _LETTER_BYTE.search(piece):
                starts.append(at)
                words.append(piece)
    for begin, logp in zip(starts, model.positions(words)):
        for i, row in enumerate(np.exp(logp)):
            best = int(row.argmax())
            if spans and spans[-1][2] == best:
                spans[-1][1] = begin + i + 1
                spans[-1][3].append(float(row[best]))
            else:
                spans.append([begin + i, begin + i + 1, best, [float(row[best])]])
    return [(s, e, model.languages[k], float(np.mean(p))) for s, e, k, p in spans]


def _words(batches: Batches) -> Batches:
    for batch in batches:
        counts: dict[tuple[str, bytes], int] = {}
        for text, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
            for word in pieces(text):
                counts[lang, word] = counts.get((lang, word), 0) + 1
        own = [(k, n) for k, n in counts.items() if _LETTER_BYTE.search(k[1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in own], pa.string()), pa.array([k[1] for k, _ in own], pa.binary()),
             pa.array([n for _, n in own], pa.int64())], names=["lang", "word", "n"])


def _uniform(*columns: str | Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def fit(docs: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", train_docs: int = TRAIN_DOCS, words: int = WORDS, epochs: int = EPOCHS) -> Model:
    """Train on texts and languages of the rows that meet `learn_from`."""
    allowed = docs if learn_from is None else docs.where(learn_from)
    rows = allowed.select(column(allowed, id_col).alias("id"), column(allowed, text_col).alias("text"),
                          column(allowed, lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return Model([], None)

    def chance(sizes: dict[str, int], n: int) -> Column:
        rate = F.create_map(*[F.lit(v) for k, size in sizes.items() for v in (k, n / size)])
        return rate[F.col("lang")]

    chosen = rows.where(_uniform("id", "text") < chance({r["lang"]: r["count"] for r in counts}, train_docs))
    found = map_arrow(chosen.select("text", "lang"), _words, "lang string, word binary, n long")
    found = at_rest(found.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    totals = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Model([], None)
    sample = found.where(_uniform("lang", "word") < F.col("n") * chance(totals, words)).orderBy("lang", "word").collect()
    languages = sorted(totals)
    label = np.array([languages.index(r["lang"]) for r in sample])
    if not len(label):
        return Model([], None)
    weights = gru.train([b" " + bytes(r["word"]) + b" " for r in sample], label, len(languages), HIDDEN, epochs)
    return Model(languages, weights)
