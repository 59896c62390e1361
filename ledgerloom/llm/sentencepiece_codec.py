"""SentencePiece encoding and decoding with the pieces and scores of a model file.

Encoding takes the segmentation of greatest total score. It runs as a streaming Viterbi (Coder): positions are settled from
left to right, a window of open ends at most one longest piece ahead is kept, and whenever the surviving backpointer paths
all pass one boundary, the ids up to it are committed. A character that no piece covers becomes its bytes' pieces (or
the unknown piece) at ten below the least score. Of equal totals the path with the longer last piece wins.

Before the coder stands a memory: where no piece has a blank after another character, every path has a boundary before each
run of blanks, so what lies between two such boundaries goes through the coder once per Python worker and is remembered (in a bounded
memory, by a 64-bit hash of its bytes).

Text is taken as it is: a blank is the mark U+2581, and one is put in front. So decoding gives back the text exactly, but
that a U+2581 in the text itself comes back as a blank.

Defined results: null and empty texts have no ids and decode to the empty text. An id that the model lacks decodes to nothing.
Repeated rows are each encoded; a null doc_id is a row like any other. Extra columns stay, but those named like a result (in
any case of letters) are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_chunk, others, read, schema_with, small_batches
from .words import range_hashes, take_ranges, texts_of

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Segments that a Python worker remembers.
MEMORY = 600_000
#: Characters of a text that goes without the coder's window.
SHORT = 256
#: Characters that a coder is fed at a time.
_SLICE = 4096


@dataclass
class Pieces:
    score: dict[str, float]
    ids: dict[str, int]
    bytes_: list[int]  # id of each byte's piece, or nothing
    unknown: int
    table: list[bytes]  # what each id decodes to
    trie: tuple | None = field(default=None, repr=False)
    longest: int = 1
    least: float = 0.0
    cuts: bool = True

    def __post_init__(self):
        self.longest = max(map(len, self.score), default=1)
        self.least = min(self.score.values(), default=0.0) - 10
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.score)

    def __getstate__(self):
        return self.__dict__ | {"trie": None}  # each task builds its own

    def name(self) -> str:
        """A digest of all that an encoding depends on."""
        return hashlib.sha256(repr((sorted(self.score.items()), sorted(self.ids.items()), self.bytes_, self.unknown)).encode()).hexdigest()

    def ids_of(self, piece: str) -> list[int]:
        """Of one piece, or of a character that no piece covers."""
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.bytes_[x] for x in piece.encode()] if self.bytes_ else [self.unknown]

    def root(self) -> dict:
        """First characters of pieces: each with what may follow it and the score of the piece that ends there, or None."""
        if self.trie is None:
            self.trie = ({},)
            for piece, score in self.score.items():
                node = self.trie[0]
                for c in piece[:-1]:
                    node = node.setdefault(c, [{}, None])[0]
                node.setdefault(piece[-1], [{}, None])[1] = score
        return self.trie[0]


@lru_cache(2)
def load(path: str) -> Pieces:
    """Pieces of a model file; its path is a parameter, the driver reads it and tasks get the pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    score, ids, table, by_byte = {}, {}, [], {}
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            by_byte[int(p[3:5], 16)] = i
            table.append(bytes([int(p[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            table.append(b"")
        else:
            score[p], ids[p] = m.get_score(i), i
            table.append(p.replace(MARK, " ").encode())
    return Pieces(score, ids, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], m.unk_id(), table)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Coder:
    """Streaming Viterbi over a text that blanks are marked in: feed() gives the ids that are settled, finish() the rest.

    Boundaries from the last committed one to a longest piece ahead of the one at work are held. Of each the number and the
    sum of the later boundaries whose best path comes from it are kept: a boundary that nothing comes from any more is
    struck out, its predecessor then loses one, and so on; and when a single one comes from the committed boundary, all
    surviving paths pass it, so it is committed. Every pointer is set and struck out once or replaced, so time is linear in
    the text, however late its paths meet.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.text, self.at, self.done = pieces, "", 0, 0
        self.best, self.back, self.kids, self.sums = [0.0], [0], [0], [0]

    @property
    def window(self) -> int:
        """Boundaries between the last committed one and the one at work."""
        return self.at - self.done

    def feed(self, text: str) -> list[int]:
        self.text += text
        n = len(text)
        self.best += [-1e300] * n
        self.back += [0] * n
        self.kids += [0] * n
        self.sums += [0] * n
        out = self._run(len(self.text) - self.pieces.longest + 1)
        if self.done > _SLICE:
            self._forget()
        return out

    def finish(self) -> list[int]:
        return self._run(len(self.text))

    def _run(self, stop: int) -> list[int]:
        pieces, text, done = self.pieces, self.text, self.done
        root, score, least, n = pieces.root(), pieces.score, pieces.least, len(text)
        best, back, kids, sums = self.best, self.back, self.kids, self.sums
        out: list[int] = []
        for j in range(self.at, stop):
            here, node, e, first = best[j], root, j, done
            reached = []
            while e < n and (found := node.get(text[e])) is not None:
                node, s = found
                e += 1
                if s is not None and here + s > best[e]:
                    reached.append((e, here + s))
            if text[j] not in score and here + least > best[j + 1]:
                reached.append((j + 1, here + least))
            for e, total in reached:
                if best[e] > -1e299:  # the boundary that it was reached from so far loses it
                    old = back[e]
                    kids[old] -= 1
                    sums[old] -= e
                    while not kids[old] and old != first:
                        x, old = old, back[old]
                        kids[old] -= 1
                        sums[old] -= x
                best[e], back[e] = total, j
                kids[j] += 1
                sums[j] += e
            old = j
            while not kids[old] and old != first:
                x, old = old, back[old]
                kids[old] -= 1
                sums[old] -= x
            while done <= j and kids[done] == 1:
                e = sums[done]
                out += pieces.ids_of(text[done:e])
                done = e
        self.at, self.done = max(self.at, stop), done
        return out

    def _forget(self) -> None:
        """Drop what lies before the last committed boundary."""
        cut = self.done
        self.text = self.text[cut:]
        self.best, self.kids = self.best[cut:], self.kids[cut:]
        self.sums = [s - k * cut for s, k in zip(self.sums[cut:], self.kids)]
        self.back = [b - cut for b in self.back[cut:]]
        self.at, self.done = self.at - cut, 0


def _short(text: str, pieces: Pieces) -> list[int]:
    """The coder's answer for a text that needs no window: all boundaries are held, the path is read from its end."""
    root, score, least, n = pieces.root(), pieces.score, pieces.least, len(text)
    best, back = [-1e300] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for j in range(n):
        here, node, e = best[j], root, j
        while e < n and (found := node.get(text[e])) is not None:
            node, s = found
            e += 1
            if s is not None and here + s > best[e]:
                best[e], back[e] = here + s, j
        if here + least > best[j + 1] and text[j] not in score:
            best[j + 1], back[j + 1] = here + least, j
    ids, parts, e = pieces.ids, [], n
    while e:
        j = back[e]
        parts.append(text[j:e])
        e = j
    out: list[int] = []
    for piece in reversed(parts):
        i = ids.get(piece)
        if i is None:
            out += pieces.ids_of(piece)
        else:
            out.append(i)
    return out


def viterbi(text: str, pieces: Pieces) -> list[int]:
    """Ids of the best segmentation of a text that blanks are marked in."""
    if len(text) <= SHORT:
        return _short(text, pieces)
    coder, out = Coder(pieces), []
    for lo in range(0, len(text), _SLICE):
        out += coder.feed(text[lo : lo + _SLICE])
    return out + coder.finish()


def _segments(column: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts with a blank in front of each that isn't empty; start, end and text of each segment."""
    buf, offsets = texts_of(column)
    full = np.diff(offsets) > 0
    moved = offsets + np.concatenate([[0], np.cumsum(full)])
    out = np.full(int(moved[-1]), 32, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.cumsum(full), np.diff(offsets))] = buf
    head = np.zeros(len(out), bool)
    head[moved[:-1][full]] = True
    if pieces.cuts and len(out):
        blank = out == 32
        head[1:] |= blank[1:] & ~blank[:-1]
    start = np.flatnonzero(head)
    return out, start, np.append(start[1:], len(out)), np.searchsorted(moved, start, "right") - 1


def encode_column(column: pa.Array, pieces: Pieces, memory: dict[int, list[int]]) -> pa.ListArray:
    buf, start, end, doc = _segments(column, pieces)
    hashes, first, back = np.unique(range_hashes(buf, start, end), return_index=True, return_inverse=True)
    found: list[list[int]] = []
    raw = buf.tobytes()
    for h, a, b in zip(hashes.tolist(), start[first].tolist(), end[first].tolist()):
        ids = memory.get(h)
        if ids is None:
            ids = viterbi(raw[a:b].decode().replace(" ", MARK), pieces)
            if len(memory) >= MEMORY:
                memory.clear()
            if len(ids) <= 64:
                memory[h] = ids
        found.append(ids)
    size = np.array([len(x) for x in found], np.int64)
    flat = np.array([i for x in found for i in x], np.int32)
    values = take_ranges(flat, (np.cumsum(size) - size)[back], size[back]) if len(start) else flat
    n = np.bincount(doc, size[back], len(column)).astype(np.int64) if len(start) else np.zeros(len(column), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))


#: What this worker remembers of the pieces that it used last: tasks come and go, the worker stays.
_KEPT: dict[str, tuple[Pieces, dict[int, list[int]]]] = {}


def kept(pieces: Pieces, name: str) -> tuple[Pieces, dict[int, list[int]]]:
    """These pieces, with their trie, and the memory of this worker for them; name tells them from others."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = pieces, {}
    return _KEPT[name]


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """docs with ids."""
    rows = others(docs, "ids")
    name = pieces.name()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, encode_column(batch.column("text"), *kept(pieces, name))], [*batch.schema.names, "ids"])

    return by_chunk(rows, each, schema_with(rows, "ids array<int>"))


def decode_column(ids: pa.ListArray, pieces: Pieces) -> pa.Array:
    size = np.array([len(x) for x in pieces.table], np.int64)
    table = np.frombuffer(b"".join(pieces.table), np.uint8)
    lists = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    known = (flat >= 0) & (flat < len(size))
    doc = np.repeat(np.arange(len(lists)), lists)[known]
    flat = flat[known]
    out = take_ranges(table, (np.cumsum(size) - size)[flat], size[flat])
    edges = np.concatenate([[0], np.cumsum(np.bincount(doc, size[flat], len(lists)).astype(np.int64))])
    drop = edges[:-1][(np.diff(edges) > 0)]
    drop = drop[out[drop] == 32]  # the blank in front
    keep = np.ones(len(out), bool)
    keep[drop] = False
    edges = np.concatenate([[0], np.cumsum(keep)])[edges]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(out[keep].tobytes())])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # ids that aren't a text's: bytes that aren't UTF-8
        return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())


def decode(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """rows with decoded, from ids."""
    rows = others(rows, "decoded")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, decode_column(part.column("ids"), pieces)], [*part.schema.names, "decoded"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema_with(rows, "decoded string"))


def op5_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    pieces = load(model or default_model())
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    out = decode(encode(docs, pieces), pieces)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "ids")
