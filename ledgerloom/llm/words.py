"""Words of a column of texts as numpy arrays: bounds, documents and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MUL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """buf: UTF-8 bytes of all texts; offsets: each text's bytes in it; start, end, doc: of each word."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def hashes(self) -> np.ndarray:
        return range_hashes(self.buf, self.start, self.end)


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes and length of each range; ranges are in order, apart and not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    power = np.full(int(size.max()) + 1, MUL)
    power[0] = 1
    power = np.cumprod(power)
    term = np.zeros(len(buf), np.uint64)
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    term[at] = (buf[at].astype(np.uint64) + np.uint64(1)) * power[at - np.repeat(start, size)]
    return mixed(np.add.reduceat(term, start) + size.astype(np.uint64) * MIX)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings; null is the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def words_of(column: pa.Array) -> Words:
    return split_words(*texts_of(column))


def split_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    black = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = black[:-1]
    start = np.flatnonzero(black & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = black[1:]
    end = np.flatnonzero(black & (~after | edge[1:])) + 1
    return Words(buf, offsets, start, end, np.searchsorted(offsets, start, "right") - 1)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries (of any texts; see inside())."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * MUL + hashes[j : j + n]
    return mixed(out)


def inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words lie in one text."""
    n = max(0, len(doc) - k + 1)
    return doc[:n] == doc[k - 1 :][:n]


def covered(n_words: int, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Words covered by windows of k words from the given starts."""
    steps = np.zeros(n_words + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    return np.cumsum(steps[:-1]) > 0


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """Whether buf[a:a+size] equals buf[b:b+size], for each row."""
    out = np.ones(len(a), bool)
    edges = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + step, "right")) - 1)
        n = size[lo:hi]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bad = buf[np.repeat(a[lo:hi], n) + at] != buf[np.repeat(b[lo:hi], n) + at]
        out[lo + np.unique(np.repeat(np.arange(hi - lo), n)[bad])] = False
        lo = hi
    return out


def take_ranges(buf: np.ndarray, a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one after the other."""
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return buf[np.repeat(a, size) + at]
