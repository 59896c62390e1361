"""Repeated passages by super-k-mers.

A window is k consecutive words of one document. Consecutive windows whose smallest hashed m-gram (the minimiser) is
the same one form a super-k-mer; it travels once, as one packed string, to the bucket of its minimiser. Equal windows
have equal minimisers, so they meet in one bucket, which sorts its windows and finds each one's smallest document.

Skew: equal super-k-mers of a chunk of documents are sent once, for the smallest document that holds them; the later
copies are settled on the spot. A minimiser shared by a third of all rows thus brings one string a chunk. A bucket of more
text than a task should sort at once is settled in parts of that size: what a part can tell is told, and the windows that it
knows no smaller document for, each once, go on to another shuffle, split anew by minimisers of another order. So a hot
bucket shrinks from level to level, by its copies and by its other words, and no task holds more than a part.

Defined results: a null or empty text, or one of fewer than k words, has no window. A null doc_id is neither smaller nor
larger than another: its row is returned whole and removes nothing. Rows that share a doc_id never remove from each other;
each is settled by its own text. Very long texts are taken whole. Extra columns stay, but those named like a result (in any case of
letters) are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, free_name, materialise, others, partitions_for, read, release, schema_with, small_batches
from .words import MUL, Words, inside, mixed, same_bytes, split_words, texts_of, take_ranges, windows, words_of

K, M = 13, 3
#: Unpacked bytes of one bucket on average, and the most that a task sorts at a time.
BUCKET_BYTES, PART_BYTES = 6 << 20, 24 << 20
#: Levels of shuffles after which buckets are sorted whole, whatever their size.
LEVELS = 8
#: A packed chunk: bytes of words, then these arrays of one row per super-k-mer.
_PACKED = "bucket long, n long, texts binary, doc binary, key binary, pos binary, spans binary"


def runs_of(words: Words, hashes: np.ndarray, k: int, m: int, ok: np.ndarray | None = None, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and minimiser of each super-k-mer, of the windows that are ok; each level has another order."""
    ok = inside(words.doc, k) if ok is None else ok
    n = len(ok)
    grams = windows(hashes, m)
    if level:
        grams = mixed(grams ^ mixed(np.full(1, level, np.uint64)))
    least = grams[:n].copy()
    for j in range(1, k - m + 1):
        np.minimum(least, grams[j : j + n], out=least)
    goes_on = np.zeros(n + 1, bool)
    goes_on[1:-1] = ok[1:] & ok[:-1] & (words.doc[1:n] == words.doc[: n - 1]) & (least[1:] == least[:-1])
    first = np.flatnonzero(ok & ~goes_on[:-1])
    last = np.flatnonzero(ok & ~goes_on[1:])
    return first, last - first + k, least[first]


def _leaders(key: np.ndarray) -> np.ndarray:
    """Index of the first row that has the same key."""
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    return first[back]


def _joined(starts: np.ndarray, stops: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one id that touch, as one; they come in order."""
    if not len(starts):
        return starts, stops, ids
    new = np.ones(len(starts), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (starts[1:] > stops[:-1])
    at = np.flatnonzero(new)
    return starts[at], np.maximum.reduceat(stops, at), ids[at]


def _spread(batches: Iterator[pa.RecordBatch], buckets: int, k: int, m: int) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        out = []
        held: dict[int, list[tuple]] = {}  # a batch's super-k-mers by bucket
        for rows in chunks(batch):
            rows = rows.take(pc.sort_indices(rows.column("doc_id")))
            words = words_of(rows.column("text"))
            doc, key = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
            hashes = words.hashes()
            first, size, least = runs_of(words, hashes, k, m)
            if not len(first):
                continue
            # equal super-k-mers of the chunk: candidates by hash, then byte by byte
            own = windows(hashes, k)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
            lead = _leaders(mixed(sums[first + size - k + 1] - sums[first]) + own[first] * MUL + size.astype(np.uint64))
            black = _normal(words)
            at, length = black.start[first], black.end[first + size - 1] - black.start[first]
            copy = np.flatnonzero((lead != np.arange(len(lead))) & (length == length[lead]) & (size == size[lead]))
            copy = copy[same_bytes(black.buf, at[copy], at[lead[copy]], length[copy])]
            alone = np.ones(len(first), bool)
            alone[copy] = False
            in_doc, begin = words.doc[first], words.first()
            pos = first - begin[in_doc]
            part = (least % np.uint64(buckets)).astype(np.int64)
            # copies in a larger doc_id of this chunk go, whatever the bucket finds; copies in the same one ask as well
            later = copy[doc[in_doc[copy]] > doc[in_doc[lead[copy]]]]
            alone[copy[doc[in_doc[copy]] == doc[in_doc[lead[copy]]]]] = True
            s, e, d = _joined(pos[later], pos[later] + size[later], in_doc[later])
            if len(s):
                spans = np.stack([doc[d].astype(np.int64), key[d].astype(np.int64), s, e])
                out.append((int(key[0] % buckets), 0, b"", b"", b"", b"", spans.tobytes()))
            send = np.flatnonzero(alone)
            send = send[np.argsort(part[send], kind="stable")]
            cut = np.flatnonzero(np.diff(part[send], prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(send))):
                rows_ = send[a:b]
                n = length[rows_] + 1
                text = take_ranges(black.buf, at[rows_], n)
                text[np.cumsum(n) - 1] = 10
                arrays = (doc[in_doc[rows_]].astype(np.int64), key[in_doc[rows_]].astype(np.int64), pos[rows_].astype(np.int32))
                held.setdefault(int(part[rows_[0]]), []).append((text, *arrays))
        for bucket, parts in held.items():
            packed = [press(np.concatenate(x).tobytes()) for x in zip(*parts)]
            out.append((bucket, sum(len(x[1]) for x in parts), *packed, b""))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _TYPES)], _NAMES)
        del out, held
        release()


def _normal(words: Words) -> Words:
    """The same words with one space after each."""
    size = words.end - words.start
    stop = np.cumsum(size + 1)
    buf = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    at = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    buf[at] = take_ranges(words.buf, words.start, size)
    return Words(buf, words.offsets, stop - 1 - size, stop - 1, words.doc)


_OUT = "doc_id long, key_ long, a long, b long, " + _PACKED
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]
_TYPES = [pa.int64(), pa.int64()] + [pa.binary()] * 5
_SPANS = pa.schema([("doc_id", pa.int64()), ("key_", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), *zip(_NAMES, _TYPES)])


def _found(doc: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(doc), t) for t in _TYPES]
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (doc, key, a, b)), *none], schema=_SPANS)


def _count(batches: Iterator[pa.RecordBatch], k: int, m: int, level: int, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """A partition: whole buckets in order. Each one's windows are sorted; out come the spans of words that a smaller document
    has too. Of a bucket of more than `most` bytes so do, packed for the next level, the windows that no part of it settles."""
    unpack = zstandard.ZstdDecompressor().decompress
    part: list[tuple] = []
    bucket, held, split = -1, 0, False

    def done(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal part, held
        if part:
            yield from _settled(part, k, m, 0 if last and not split else level + 1, buckets)
            part, held = [], 0
            release()

    for batch in batches:
        for r in batch.to_pylist():
            if r["spans"]:
                yield _found(*np.frombuffer(r["spans"], np.int64).reshape(4, -1))
            if r["n"]:
                if r["bucket"] != bucket:
                    yield from done(True)
                    bucket, split = r["bucket"], False
                texts = np.frombuffer(unpack(r["texts"]), np.uint8)
                if held and held + len(texts) > most:
                    split = True
                    yield from done(False)
                part.append((texts, *(np.frombuffer(unpack(r[c]), t) for c, t in (("doc", np.int64), ("key", np.int64), ("pos", np.int32)))))
                held += len(texts)
    yield from done(True)


def _settled(part: list[tuple], k: int, m: int, onward: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows of a part that a smaller document of it has too; the others as super-k-mers of level `onward`, if there is one."""
    buf, doc, key, pos = (np.concatenate(x) for x in zip(*part))
    words = split_words(buf, np.concatenate([[0], np.flatnonzero(buf == 10) + 1]))
    hashes = words.hashes()
    own = windows(hashes, k)
    at = np.flatnonzero(inside(words.doc, k))
    own, run = own[at], words.doc[at]
    by = np.argsort(own, kind="stable")
    same = np.flatnonzero(np.diff(own[by], prepend=own[by[0]] + np.uint64(1)))
    least = np.repeat(np.minimum.reduceat(doc[run[by]], same), np.diff(np.append(same, len(by))))
    lead = np.repeat(by[same], np.diff(np.append(same, len(by))))
    bad, head = np.empty(len(at), bool), np.empty(len(at), np.int64)
    bad[by], head[by] = least < doc[run[by]], lead
    # equal bytes, not only equal hashes: the whole first window of a stretch, then each next word
    ask = np.flatnonzero(bad | np.isin(np.arange(len(at)), head[bad]))
    near = np.zeros(len(ask), bool)
    near[1:] = (np.diff(ask) == 1) & (run[ask[1:]] == run[ask[:-1]]) & (head[ask[1:]] == head[ask[:-1]] + 1) & (run[head[ask[1:]]] == run[head[ask[:-1]]])
    x, y = at[ask], at[head[ask]]
    x, y = np.where(near, x + k - 1, x), np.where(near, y + k - 1, y)
    last_x, last_y = words.end[at[ask] + k - 1], words.end[at[head[ask]] + k - 1]
    size = last_x - words.start[x]
    equal = size == last_y - words.start[y]
    equal[equal] = same_bytes(words.buf, words.start[x[equal]], words.start[y[equal]], size[equal])
    if not equal.all():  # two different windows under one hash: this part's groups by their bytes
        bad = _by_bytes(words, at, run, doc, k)
    offset = pos.astype(np.int64) - words.first()[:-1]
    hit = np.flatnonzero(bad)
    s = offset[run[hit]] + at[hit]
    s, e, r = _joined(s, s + k, run[hit])
    yield _found(doc[r], key[r], s, e)
    if onward:
        ok = np.zeros(max(0, len(words.start) - k + 1), bool)
        ok[at[~bad]] = True
        first, n, minimiser = runs_of(words, hashes, k, m, ok, onward)
        if len(first):
            to = (minimiser % np.uint64(buckets)).astype(np.int64)
            rows = np.argsort(to, kind="stable")
            first, n, to = first[rows], n[rows], to[rows]
            run = words.doc[first]
            columns = doc[run], key[run], (offset[run] + first).astype(np.int32)
            length = words.end[first + n - 1] - words.start[first] + 1  # words have one byte after each
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            press = zstandard.ZstdCompressor(level=3).compress
            packed: list[list] = [[] for _ in _NAMES]
            for a, b in zip(cut, np.append(cut[1:], len(to))):
                text = take_ranges(words.buf, words.start[first[a:b]], length[a:b])
                text[np.cumsum(length[a:b]) - 1] = 10
                for where, v in zip(packed, (int(to[a]), int(b - a), press(text.tobytes()), *(press(c[a:b].tobytes()) for c in columns), b"")):
                    where.append(v)
            none = [pa.nulls(len(cut), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, *(pa.array(c, t) for c, t in zip(packed, _TYPES))], schema=_SPANS)


def _by_bytes(words: Words, at: np.ndarray, run: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    least: dict[bytes, int] = {}
    texts = [words.buf[words.start[i] : words.end[i + k - 1]].tobytes() for i in at]
    for t, d in zip(texts, doc[run]):
        least[t] = min(d, least.get(t, d))
    return np.array([least[t] < d for t, d in zip(texts, doc[run])])


def repeated_spans(docs: DataFrame, k: int = K, m: int = M, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, key (hash of the text), a, b: spans of words of each document that windows of smaller documents cover."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    small_batches(docs.sparkSession)
    parts = partitions_for(docs, "text", 3.0)
    buckets = partitions_for(docs, "text", 3.0, BUCKET_BYTES)
    packed, spans, level = rows.mapInArrow(lambda it: _spread(it, buckets, k, m), _PACKED), None, 0
    while True:
        most = part_bytes if level < LEVELS else 1 << 62
        met = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
        out = materialise(met.mapInArrow(lambda it, level=level, most=most: _count(it, k, m, level, buckets, most), _OUT))
        found = out.where("bucket is null").select("doc_id", F.col("key_").alias("key"), "a", "b")
        spans = found if spans is None else spans.unionByName(found)
        packed = out.where("bucket is not null").select(*_NAMES)
        if packed.isEmpty():
            return spans
        level += 1


def _cut(batch: pa.RecordBatch, spans_name: str) -> pa.RecordBatch:
    n_words, n_removed, kept = [], [], []
    for text, spans in zip(batch.column("text"), batch.column(spans_name)):
        words = (text.as_py() or "").encode().split()
        n_words.append(len(words))
        if spans.is_valid and len(spans):
            stay = np.ones(len(words), bool)
            for x in spans.as_py():
                stay[x["a"] : x["b"]] = False
            words = [w for w, s in zip(words, stay) if s]
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words))
    names = [c for c in batch.schema.names if c != spans_name]
    arrays = [batch.column(c) for c in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, [*names, "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, k: int = K, m: int = M, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words that stay, joined by one space."""
    rows = others(docs, "n_words", "n_removed", "kept_text")
    d, k_, s = free_name(rows, "_span_doc"), free_name(rows, "_span_key"), free_name(rows, "_spans")
    spans = repeated_spans(docs, k, m, part_bytes).groupBy(F.col("doc_id").alias(d), F.col("key").alias(k_)).agg(F.collect_list(F.struct("a", "b")).alias(s))
    both = rows.join(spans.hint("shuffle_hash"), (F.col("doc_id") == F.col(d)) & (F.xxhash64("text") == F.col(k_)), "left").drop(d, k_)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                yield _cut(part, s)

    return both.mapInArrow(run, schema_with(rows, "n_words long, n_removed long, kept_text string"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of the whole table: see the module's docstring."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM w),
dup AS (SELECT doc_id, i FROM win JOIN (SELECT s, min(doc_id) AS f FROM win GROUP BY s) USING (s) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, (SELECT unnest(range(13)) AS j)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
