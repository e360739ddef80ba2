"""Elias-Fano coded sequences and a trie of word pairs in them, read in place from one memory map; vectorised lookups."""

from __future__ import annotations

import mmap

import numpy as np

_U64 = np.uint64
# Position of the k-th set bit in a byte.
_IN_BYTE = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    _set = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, :len(_set)] = _set


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """`values` of `bits` bits each, one behind the other in 64-bit words."""
    words = np.zeros(len(values) * bits // 64 + 2, _U64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(_U64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((at & 63) + bits > 64)
        words[word[over] + 1] |= values[over] >> (_U64(64) - shift[over])
    return words


def _unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), _U64)
    at = at * bits
    word, shift = at >> 6, (at & 63).astype(_U64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((_U64(64) - shift) & _U64(63)), _U64(0))
    return (low | high) & _U64((1 << bits) - 1)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0); `before` counts set bits ahead of each word."""
    word = np.searchsorted(before, k, "right") - 1
    rest = k - before[word]
    octets = words[word].view(np.uint8).reshape(-1, 8)
    upto = np.bitwise_count(octets).cumsum(axis=1, dtype=np.uint8)
    octet = (upto <= rest[:, None]).sum(axis=1)
    row = np.arange(len(k))
    rest = rest - np.where(octet > 0, upto[row, np.maximum(octet - 1, 0)], 0)
    return word * 64 + octet * 8 + _IN_BYTE[octets[row, octet], rest]


class EliasFano:
    """An ascending sequence (equal values allowed): low bits packed, high bits in unary."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high = n, bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.cumsum(ones) - ones
        self.zeros = np.arange(len(high), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        values = values.astype(_U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = _pack(values & _U64((1 << bits) - 1), bits)
        at = (values >> _U64(bits)).astype(np.int64) + np.arange(n)
        size = (int(at[-1]) if n else 0) // 64 + 2  # ends with a zero at least
        flags = np.zeros(size * 64, np.uint8)
        flags[at] = 1
        return n, bits, low, np.packbits(flags, bitorder="little").view(_U64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        high = _select(self.high, self.ones, at) - at
        return (high.astype(_U64) << _U64(self.bits)) | _unpack(self.low, self.bits, at)

    def _reach(self, high: np.ndarray) -> np.ndarray:
        """How many elements have high bits below `high`."""
        known = np.minimum(np.maximum(high - 1, 0), len(self.high) * 64 - self.n - 1)
        return np.where(high > 0, _select(~self.high, self.zeros, known) - known, 0)

    def successor(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Within [low, high) of the sequence, the place of the first element not below each value (`high` if none)."""
        top = (values >> _U64(self.bits)).astype(np.int64)
        low = np.minimum(np.maximum(low, self._reach(top)), high)
        end = np.maximum(np.minimum(high, self._reach(top + 1)), low)
        rest = values & _U64((1 << self.bits) - 1)
        while (open_ := np.flatnonzero(low < end)).size:  # few steps: elements of the same high bits
            middle = (low[open_] + end[open_]) // 2
            below = _unpack(self.low, self.bits, middle) < rest[open_]
            low[open_] = np.where(below, middle + 1, low[open_])
            end[open_] = np.where(below, end[open_], middle)
        return low

    def find(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each value in [low, high), or -1."""
        at = self.successor(values, low, high)
        inside = np.flatnonzero(at < high)
        found = np.full(len(values), -1, np.int64)
        hit = self[at[inside]] == values[inside]
        found[inside[hit]] = at[inside[hit]]
        return found


LEVELS = 256


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code book of at most 256 numbers, and each value's code of one byte (the nearest number)."""
    distinct = np.unique(values)
    if len(distinct) > LEVELS:
        book = np.unique(np.concatenate([np.quantile(values, np.linspace(0, 1, LEVELS // 2)),
                                         np.linspace(distinct[0], distinct[-1], LEVELS // 2)]))
    else:
        book = distinct
    if not len(book):
        return np.zeros(1), np.zeros(0, np.uint8)
    at = np.clip(np.searchsorted(book, values), 1, max(1, len(book) - 1))
    if len(book) > 1:
        at = np.where(values - book[at - 1] < book[at] - values, at - 1, at)
    else:
        at = np.zeros(len(values), np.int64)
    return book, at.astype(np.uint8)


class PairTrie:
    """Two levels: contexts, and the words behind each. Words are 64-bit ids.

    Level 1 holds the contexts' ids, an Elias-Fano sequence, with coded back-off weights and a monotone pointer each to
    where its followers begin. Level 2 holds the followers, by context, as places in the sorted list of all followers;
    to be ascending throughout, each context's places are moved up by the last value before them. A follower is found
    relative to its context: its place plus that shift, by successor search between two pointers.
    """

    _NAMES = ("context_low", "context_high", "pointer_low", "pointer_high", "word_low", "word_high", "pair_low",
              "pair_high", "weight_book", "weight_code", "score_book", "score_code")

    def __init__(self, buffer: memoryview | mmap.mmap) -> None:
        head = np.frombuffer(buffer, np.int64, 8 + 2 * len(self._NAMES))
        kinds = dict.fromkeys(self._NAMES, _U64) | {
            "weight_book": np.float64, "score_book": np.float64, "weight_code": np.uint8, "score_code": np.uint8}
        parts = {}
        for k, name in enumerate(self._NAMES):
            start, size = (int(v) for v in head[8 + 2 * k:10 + 2 * k])
            parts[name] = np.frombuffer(buffer, kinds[name], size, start)
        self.parts = parts
        sequences = [EliasFano(int(head[2 * k]), int(head[2 * k + 1]), parts[f"{name}_low"], parts[f"{name}_high"])
                     for k, name in enumerate(("context", "pointer", "word", "pair"))]
        self.context, self.pointer, self.word, self.pair = sequences

    @classmethod
    def build(cls, contexts: np.ndarray, weights: np.ndarray, owner: np.ndarray, follower: np.ndarray,
              score: np.ndarray) -> "PairTrie":
        """`contexts` ascending with `weights`; pairs by context place `owner`, then `follower`, with `score`."""
        words, place = np.unique(follower, return_inverse=True)
        place = place.ravel().astype(np.int64)
        pointer = np.searchsorted(owner, np.arange(len(contexts) + 1))
        has = np.flatnonzero(np.diff(pointer))
        last = place[pointer[has + 1] - 1] + 1
        shift = np.zeros(len(contexts), np.int64)
        shift[has] = np.cumsum(last) - last
        book, code = quantise(weights)
        score_book, score_code = quantise(score)
        coded = [EliasFano.encode(v) for v in (contexts, pointer, words, place + shift[owner])]
        arrays = [a for c in coded for a in c[2:]] + [book, code, score_book, score_code]
        head = [v for c in coded for v in c[:2]]
        at = 8 * (8 + 2 * len(arrays))
        for a in arrays:
            at = -(-at // 8) * 8
            head += [at, len(a)]
            at += a.nbytes
        levels = mmap.mmap(-1, max(at, 8))
        levels[:8 * len(head)] = np.array(head, np.int64).tobytes()
        for k, a in enumerate(arrays):
            start = head[8 + 2 * k]
            levels[start:start + a.nbytes] = np.ascontiguousarray(a).tobytes()
        return cls(levels)

    def lookup(self, contexts: np.ndarray, words: np.ndarray,
               step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per pair: whether the context is known, its weight, whether the pair is known, its score."""
        found = [self._lookup(contexts[at:at + step], words[at:at + step]) for at in range(0, max(1, len(contexts)), step)]
        return tuple(np.concatenate(part) for part in zip(*found))

    def _lookup(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(contexts)
        zero = np.zeros(n, np.int64)
        at = self.context.find(contexts, zero, zero + self.context.n)
        known = at >= 0
        safe = np.maximum(at, 0)
        weight = np.zeros(n)
        score, paired = np.zeros(n), np.zeros(n, bool)
        if not self.context.n or not n:
            return known, weight, paired, score
        weight = self.parts["weight_book"][self.parts["weight_code"][safe]]
        place = self.word.find(words, zero, zero + self.word.n)
        some = np.flatnonzero(known & (place >= 0))
        if len(some):
            low = self.pointer[safe[some]].astype(np.int64)
            high = self.pointer[safe[some] + 1].astype(np.int64)
            before = np.zeros(len(some), _U64)
            later = low > 0
            before[later] = self.pair[low[later] - 1] + _U64(1)
            found = self.pair.find(place[some].astype(_U64) + before, low, high)
            hit = found >= 0
            paired[some[hit]] = True
            score[some[hit]] = self.parts["score_book"][self.parts["score_code"][found[hit]]]
        return known, weight, paired, score
