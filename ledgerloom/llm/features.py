"""Counts of each whole text that quality rules and the quality classifier look at, by numpy over a chunk of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import MUL, covered, inside, mixed, range_hashes, same_bytes, windows, words_of

SYMBOLS = b"#*$%&|<>"
#: All are longs. word_chars: code points in words; n_symbols: any of SYMBOLS; n_lines: lines with a word; n_dup_lines:
#: those equal to an earlier line; n_repeat_words: words in 3-word windows that the text holds twice or more (windows are
#: told apart by 64-bit hashes); n_distinct: different words.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_marks", "n_ends", "n_shouts", "n_wide")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS = {
    "n_symbols": _table(SYMBOLS),
    "n_upper": _table(bytes(range(65, 91))),
    "n_digits": _table(bytes(range(48, 58))),
    "n_marks": _table(b",;:'\"()-"),
    "n_ends": _table(b".?"),
    "n_shouts": _table(b"!"),
    "n_wide": _table(bytes(range(192, 256))),
}


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """One array per name of COUNTS; a null or empty text has zeros."""
    words = words_of(column)
    buf, offsets, n = words.buf, words.offsets, words.n_docs
    out = {"n_words": words.counts()}

    def total(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    black = np.zeros(len(buf) + 1, np.int8)
    black[words.start] += 1
    np.add.at(black, words.end, -1)
    out["word_chars"] = total((np.cumsum(black[:-1]) > 0) & ((buf & 0xC0) != 0x80))
    for name, table in _IS.items():
        out[name] = total(table[buf])

    # lines with a word
    breaks = np.append(np.flatnonzero(buf == 10), len(buf))
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(buf)]
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(breaks[np.searchsorted(breaks, start)], offsets[doc + 1])
    at = np.searchsorted(words.start, start)
    full = (at < len(words.start)) & (end > start)
    full[full] = words.start[at[full]] < end[full]
    start, end, doc = start[full], end[full], doc[full]
    out["n_lines"] = np.bincount(doc, minlength=n)
    _, first, back = np.unique(mixed(range_hashes(buf, start, end) + doc.astype(np.uint64) * MUL), return_index=True, return_inverse=True)
    lead = first[back] if len(start) else np.zeros(0, np.int64)
    again = np.flatnonzero((lead != np.arange(len(start))) & (end - start == end[lead] - start[lead]))
    again = again[same_bytes(buf, start[again], start[lead[again]], end[again] - start[again])]
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n)

    hashes = words.hashes()
    own = mixed(hashes + words.doc.astype(np.uint64) * MUL)
    out["n_distinct"] = np.bincount(words.doc[np.unique(own, return_index=True)[1]], minlength=n)
    at = np.flatnonzero(inside(words.doc, 3))
    _, back, often = np.unique(windows(own, 3)[at], return_inverse=True, return_counts=True)
    hit = at[often[back] > 1] if len(at) else at
    out["n_repeat_words"] = np.bincount(words.doc[covered(len(hashes), hit, 3)], minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def with_counts(batch: pa.RecordBatch, keep: list[str]) -> pa.RecordBatch:
    found = counts(batch.column("text"))
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(found[c]) for c in COUNTS], [*keep, *COUNTS])
