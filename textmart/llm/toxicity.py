"""Toxicity: boosted trees over dense features of a text, calibrated.

Fitting takes at most TRAIN_ROWS labelled documents of each class, those whose ids come first in hash order, of those
allowed to be learned from. They are split by id hash into three parts. From the first, Spark counts in how many
documents of either class each word and word beginning occurs, and the terms that clearly prefer toxic documents are
the lexicon (two tiers, at most LEXICON terms). From the second, the trees learn from features of texts that did not
make the lexicon; the third calibrates their scores to the classes' shares among all labelled rows (isotonic).

Scoring is one pass over the texts without a shuffle. Features: densities of lexicon words and beginnings, plain and
after undoing look-alike spelling; second-person words, and lexicon words near them; capitals, punctuation, and
rates of words with digits or signs inside or with drawn-out letters. Labels, language, source and id are no features.

Cases: a null text is empty; an empty text gets a score, too. Several labels of one document count as toxic if one of
them is; null labels are not learned from. Repeated rows each get their row. Without labels of both classes every
score is the share of label 1 (0 if there are none). Other columns are kept by `keep_clean`, ignored by `score`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmart.llm import boosting
from textmart.llm.common import Batches, as_bytes, at_rest, column, map_arrow

TRAIN_ROWS = 8_000   # per class
LEXICON = 4_000
PREFIXES = (3, 4, 5, 6)
NEAR = 6             # words between a second-person word and one of the lexicon
CACHE = 400_000      # words a task remembers

SECOND_PERSON = set("you your yours yourself u ur thou tu te toi ton ta tes vous votre vos du dich dir dein deine deiner "
                    "ihr euch euer eure sie ihnen usted ustedes ti tus vosotros os vuestro vuestra".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_DRAWN = re.compile(r"(.)\1{2,}")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"

STRONG, MEDIUM, BEGIN, BEGIN_MEDIUM, PERSON, CAPITALS, ODD, HIDDEN = (1 << i for i in range(8))
# Bytes: 0 other, 1 capital letter, 2 small letter, 3 digit, 4 sign, 5 exclamation or question mark.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 4
_CLASS[[33, 63]] = 5
_CLASS[128:] = 2


def plain(word: str) -> str:
    """Lower case, without signs at the ends."""
    return word.strip(_EDGE).lower()


def undisguised(word: str) -> str:
    """Look-alike digits and signs as letters, signs inside dropped, drawn-out letters once."""
    letters = "".join(c for c in word.lower().translate(_LEET) if c.isalpha())
    return _DRAWN.sub(r"\1", letters)


def terms(text: str) -> set[str]:
    """A text's words, and their beginnings marked by a hyphen."""
    words = {plain(w) for w in text.split()}
    words.discard("")
    return words | {w[:n] + "-" for w in words for n in PREFIXES if len(w) > n}


class _Words(dict):
    """Word as it stands in the text -> what it is, in bits; remembers up to CACHE of them."""

    def __init__(self, strong: set[str], medium: set[str]) -> None:
        super().__init__()
        self.strong, self.medium = strong, medium

    def _bits(self, word: str) -> int:
        bits = 0
        if word in self.strong:
            bits |= STRONG
        elif word in self.medium:
            bits |= MEDIUM
        starts = [word[:n] + "-" for n in PREFIXES if len(word) > n]
        if any(s in self.strong for s in starts):
            bits |= BEGIN
        elif any(s in self.medium for s in starts):
            bits |= BEGIN_MEDIUM
        return bits

    def __missing__(self, word: str) -> int:
        core = plain(word)
        bits = self._bits(core)
        if core in SECOND_PERSON:
            bits |= PERSON
        if len(core) > 1 and word.strip(_EDGE).isupper():
            bits |= CAPITALS
        if core and (not core.isalpha() or _DRAWN.search(core)):
            bits |= ODD
            spellings = {undisguised(core), undisguised(word)}  # signs at the ends may be letters, or not
            if not bits & (STRONG | BEGIN) and any(self._bits(s) & (STRONG | BEGIN) for s in spellings):
                bits |= HIDDEN
        if len(self) >= CACHE:
            self.clear()
        self[word] = bits
        return bits


FEATURES = 18


def features(text: bytes, words: _Words) -> np.ndarray:
    found = text.decode(errors="replace").split()
    out = np.zeros(FEATURES)
    if not found:
        return out
    bits = np.fromiter(map(words.__getitem__, found), np.uint8, len(found))
    n = len(bits)
    counts = [int(np.count_nonzero(bits & b)) for b in (STRONG, MEDIUM, BEGIN, BEGIN_MEDIUM, PERSON, CAPITALS, ODD, HIDDEN)]
    out[:8] = np.array(counts) / n
    out[8:12] = np.log1p([counts[0], counts[2], counts[7], n])
    out[12] = np.log1p(counts[0] + counts[1] + counts[2] + counts[3] + counts[7])
    listed = np.flatnonzero(bits & (STRONG | BEGIN | HIDDEN))
    person = np.flatnonzero(bits & PERSON)
    if len(listed) and len(person):
        at = np.searchsorted(person, listed)
        before = np.abs(listed - person[np.maximum(at - 1, 0)])
        after = np.abs(person[np.minimum(at, len(person) - 1)] - listed)
        out[13] = np.mean(np.minimum(before, after) <= NEAR)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6)
    letters = max(1, kinds[1] + kinds[2])
    out[14:18] = kinds[1] / letters, kinds[3] / len(text), kinds[4] / len(text), kinds[5] / len(text)
    return out


def matrix(texts: list[bytes | None], words: _Words) -> np.ndarray:
    return np.array([features(t or b"", words) for t in texts]).reshape(len(texts), FEATURES)


@dataclass
class Model:
    strong: set[str]
    medium: set[str]
    trees: boosting.Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, texts: list[bytes | None], words: _Words) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.interp(self.trees.raw(matrix(texts, words)), *self.knots)


def _count_terms(batches: Batches) -> Batches:
    for batch in batches:
        toxic: dict[str, int] = {}
        clean: dict[str, int] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = toxic if label else clean
            for term in terms(text or ""):
                counts[term] = counts.get(term, 0) + 1
        names = list({**toxic, **clean})
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic.get(t, 0) for t in names], pa.int64()),
             pa.array([clean.get(t, 0) for t in names], pa.int64())], names=["term", "toxic", "clean"])


def _measure(batches: Batches, lexicon) -> Batches:
    words = _Words(*lexicon.value)
    for batch in batches:
        x = matrix(as_bytes(batch.column(0)), words)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "part", "x"])


def _lexicon(sample: DataFrame) -> tuple[set[str], set[str]]:
    """Terms of the sample (text, label), whose classes weigh alike, by how far they prefer toxic documents."""
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    ratio = sizes.get(1, 0) / max(1, sizes.get(0, 0))  # clean counts as if there were as many clean documents
    counted = map_arrow(sample.select("text", "label"), _count_terms, "term string, toxic long, clean long")
    z = (F.col("toxic") - F.col("clean") * ratio) / F.sqrt(F.col("toxic") + F.col("clean") * ratio * ratio + 1)
    kept = (counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where(F.col("toxic") > 2).withColumn("z", z).where(F.col("z") > 2.5)
            .where(F.col("toxic") > 4 * ratio * F.col("clean"))
            .orderBy(F.desc("z"), "term").limit(LEXICON).collect())
    return {r["term"] for r in kept if r["z"] > 4.5}, {r["term"] for r in kept if r["z"] <= 4.5}


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """`learn_from` is a condition on `docs`; `labels` has `id_col` and `label_col` 0 or 1."""
    spark = docs.sparkSession
    allowed = docs if learn_from is None else docs.where(learn_from)
    truth = (labels.where(column(labels, id_col).isNotNull() & column(labels, label_col).isNotNull())
             .groupBy(column(labels, id_col).alias("_id")).agg(F.max(column(labels, label_col).cast("int")).alias("label")))
    ids = allowed.select(column(allowed, id_col).alias("_id")).distinct().join(truth, "_id")
    ids = at_rest(ids.withColumn("rank", F.xxhash64("_id")), "toxicity-ids")
    sizes = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2 or min(sizes.values()) < 6:
        return Model(set(), set(), None, None, share)
    picked = [ids.where(F.col("label") == label).orderBy("rank", "_id").limit(train_rows) for label in (0, 1)]
    chosen = at_rest(picked[0].unionByName(picked[1]).select("_id", "label"), "toxicity-chosen")  # 2 x train_rows ids
    sample = allowed.select(column(allowed, id_col).alias("_id"), column(allowed, text_col).alias("text"))
    sample = sample.join(F.broadcast(chosen), "_id").select(
        "text", "label", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(10)).cast("int").alias("part"))
    sample = at_rest(sample, "toxicity-sample")
    lexicon = _lexicon(sample.where("part < 4"))
    shared = spark.sparkContext.broadcast(lexicon)
    rows = map_arrow(sample.where("part >= 4"), partial(_measure, lexicon=shared),
                     "label int, part int, x array<double>").toArrow()  # FEATURES doubles each
    y = rows["label"].to_numpy().astype(float)
    part = rows["part"].to_numpy()
    x = np.array(rows["x"].to_pylist()).reshape(len(y), FEATURES)
    weight = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))
    held = part >= 8
    if len({*y[~held]}) < 2 or len({*y[held]}) < 2:
        held = np.zeros(len(y), bool)  # too few rows to hold some back
        if len({*y}) < 2:
            return Model(set(), set(), None, None, share)
    trees = boosting.fit(x[~held], y[~held], weight[~held])
    test = held if held.any() else ~held
    knots = boosting.isotonic(trees.raw(x[test]), y[test], weight[test])
    return Model(*lexicon, trees, knots, share)


def _score(batches: Batches, model, text: int, threshold: float | None) -> Batches:
    """Scores behind the columns, or only the rows below the threshold."""
    words = _Words(model.value.strong, model.value.medium)
    for batch in batches:
        scores = model.value.score(as_bytes(batch.column(text)), words)
        if threshold is None:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])
        else:
            yield batch.filter(pa.array(scores < threshold))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) per row."""
    chosen = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON terms
    kind = chosen.schema["id"].dataType.simpleString()
    scored = map_arrow(chosen, partial(_score, model=shared, text=1, threshold=None),
                       f"id {kind}, text string, score double")
    return scored.select(F.col("id").alias(id_col), "score")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs`, all columns, without the rows of a score of `threshold` or more."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_arrow(docs, partial(_score, model=shared, text=at, threshold=threshold), docs.schema)
