"""Secret scans with multipart credential linking.

Base patterns report what is a secret by itself. Beside them, weak parts are gathered: access identifiers, secrets and
endpoints that alone are no finding (`WEAK`). The parts of a text are intervals; an interval join (sorted starts,
binary search) links each access identifier to the secrets and endpoints within its scope, and only parts whose
complements co-occur there are reported.

A scope is a run of text without a blank line, and in it at most `reach` code points between two parts; with reach=None,
as the registered query has it, only the structure bounds it. Each text is one row and is scanned whole where it lies: no shuffle, no candidate pairs; parts are linked by
interval bounds and counts, so a text that is one long list of identifiers costs no more than its length times a logarithm.

Cases: null texts are empty and have no spans. Spans are in code points, end exclusive. Repeated rows each get their
row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textmart.llm.common import Batches, column, map_arrow

KINDS = ("assign", "access", "hex")
REACH = 400  # unless the caller says otherwise; None: as far as the scope goes

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the same as all maximal runs, less the shorter ones
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Weak parts: an identifier, a secret, an endpoint. Base spans take part, too: an access span is an identifier, an
# assign or hex span a secret.
WEAK = {
    "identifier": re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{6,}|(?:user|login|client_?id|account)\x20*[:=]\x20*"
                             r"[\"']?[A-Za-z0-9_.@-]{4,})", re.ASCII),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}"
                         r"(?![A-Za-z0-9+/_=-])", re.ASCII),
    "endpoint": re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|jdbc:[a-z]+)://[^\s\"'<>|]{3,}",
                           re.ASCII),
}
_WEAK_ORDER = ("identifier", "secret", "endpoint")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

FOUND = "kinds array<string>, starts array<int>, ends array<int>, base array<boolean>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each base match, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return [(s, e, KINDS[k]) for s, e, k in found]


def _has_any(parts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a part lies within each [low, high]; `parts` is (start, end) by start.

    Parts of one kind do not overlap after sorting by start except where base and weak meet, so ends ascend with
    starts once the running maximum is taken; a part within bounds exists if the first start from `low` on ends in time.
    """
    if not len(parts):
        return np.zeros(len(low), bool)
    first = np.searchsorted(parts[:, 0], low, "left")
    # The smallest end among the parts from each place on.
    least = np.minimum.accumulate(parts[::-1, 1])[::-1]
    return np.where(first < len(parts), least[np.minimum(first, len(parts) - 1)], np.iinfo(np.int64).max) <= high


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int | None = REACH) -> list[tuple[int, int, str]]:
    """The weak parts whose complements lie in their scope; base spans are not repeated."""
    parts: dict[str, set[tuple[int, int]]] = {k: set() for k in _WEAK_ORDER}
    for s, e, kind in base:
        parts["identifier" if kind == "access" else "secret"].add((s, e))
    taken = {(s, e) for s, e, _ in base}
    weak: dict[str, list[tuple[int, int]]] = {}
    if not parts["identifier"] and not WEAK["identifier"].search(text):
        return []  # every link has an identifier
    for kind in ("identifier", "endpoint", "secret"):
        weak[kind] = [m.span() for m in WEAK[kind].finditer(text)]
        if kind == "secret":
            busy = sorted(taken | parts["identifier"] | parts["endpoint"])
            weak[kind] = _outside(weak[kind], busy)
        parts[kind].update(weak[kind])
    table = {k: np.array(sorted(v), np.int64).reshape(-1, 2) for k, v in parts.items()}
    # Scopes end at blank lines.
    cuts = np.array([0, *[m.start() for m in _BLANK_LINE.finditer(text)], len(text)], np.int64)

    def scope(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(cuts, spans[:, 0], "right")
        low, high = cuts[at - 1], cuts[np.minimum(at, len(cuts) - 1)]
        if reach is None:
            return low, high
        return np.maximum(low, spans[:, 0] - reach), np.minimum(high, spans[:, 1] + reach)

    # Identifiers with a secret in scope; then secrets and endpoints with such an identifier in scope.
    ids = table["identifier"]
    whole = ids[_has_any(table["secret"], *scope(ids))] if len(ids) else ids
    found = [(s, e, "linked_identifier") for s, e in whole.tolist() if (s, e) not in taken]
    for kind in ("secret", "endpoint"):
        spans = np.array(weak[kind], np.int64).reshape(-1, 2)
        if len(spans):
            kept = spans[_has_any(whole, *scope(spans))]
            found += [(s, e, f"linked_{kind}") for s, e in kept.tolist() if (s, e) not in taken]
    return found


def _outside(spans: list[tuple[int, int]], busy: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of `busy`."""
    if not spans or not busy:
        return spans
    b = np.array(busy, np.int64)
    reach = np.maximum.accumulate(b[:, 1])
    s = np.array(spans, np.int64)
    before = np.searchsorted(b[:, 0], s[:, 1], "left")  # those that begin before the span ends
    free = (before == 0) | (reach[np.maximum(before - 1, 0)] <= s[:, 0])
    return [span for span, f in zip(spans, free.tolist()) if f]


def spans_of(text: str | None, reach: int | None = REACH) -> list[tuple[int, int, str, bool]]:
    """All spans of a text: (start, end, kind, whether it is a base one), by start, base first."""
    if not text:
        return []
    base = base_spans(text)
    linked = sorted(linked_spans(text, base, reach))
    order = [*KINDS, "linked_identifier", "linked_secret", "linked_endpoint"]
    every = [(*s, True) for s in base] + [(*s, False) for s in linked]
    return sorted(every, key=lambda s: (s[0], order.index(s[2])))


def _scan(batches: Batches, reach: int | None) -> Batches:
    for batch in batches:
        found = [spans_of(t, reach) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0),
            pa.array([[s[2] for s in f] for f in found], pa.list_(pa.string())),
            pa.array([[s[0] for s in f] for f in found], pa.list_(pa.int32())),
            pa.array([[s[1] for s in f] for f in found], pa.list_(pa.int32())),
            pa.array([[s[3] for s in f] for f in found], pa.list_(pa.bool_())),
        ], names=["id", "kinds", "starts", "ends", "base"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = REACH) -> DataFrame:
    """Per document row: `id_col` and its spans as parallel arrays kinds, starts, ends, base (false: linked)."""
    chosen = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return map_arrow(chosen, partial(_scan, reach=reach), f"id {kind}, {FOUND}").withColumnRenamed("id", id_col)


def _digest(batches: Batches) -> Batches:
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, every = [], []
        for kinds, starts, ends, base in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            told = [f"{k}:{s}:{e}" for k, s, e in zip(kinds, starts, ends)]
            of_base = [t for t, b in zip(told, base) if b]
            for k in KINDS:
                counts[k].append(sum(kind == k and b for kind, b in zip(kinds, base)))
            digests.append(hashlib.sha256(",".join(of_base).encode()).hexdigest())
            every.append(",".join(told))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests), pa.array(every)],
            names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def digest(found: DataFrame) -> DataFrame:
    """`scan`'s result as counts, digest of the base spans and a list of all spans; the id, of any type, is called doc_id."""
    kind = found.schema[0].dataType.simpleString()
    return map_arrow(found, _digest, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                     "spans string")
