"""Compression of vectors to codes: a codebook for each part of a vector, trained by filtering Lloyd.

Vectors become whole numbers (vectors.whole) and are cut into equal consecutive parts. Each task deals its rows into blocks and
builds, for each block and part position, a kd-tree whose nodes cache box, sum and count of their points. The trees are
written once to the shared folder; every round reads them. A round walks the trees from the roots with all entries as candidates: an entry
goes where the best one for the box's middle is nearer to every corner of the box (nearest corner test, with ties to the lower index, exact
in whole numbers). Where one entry is left, the whole subtree is its own, by the cached sum and count; only points of leaves that
several entries contest are compared one by one. What a round sends on is a sum and a count for each entry and task.

Defined results: rows with a null vector or null or non-finite components are dropped. A vector shorter than the longest counts as
followed by zeros, and so does a width that the number of parts does not divide. Whole numbers beyond +-limit(width) (2^27 at 64
dimensions) stay at that end, so that every sum of squares fits a long. Null ids are coded but start no codebook; where an id stands
several times, its least vector starts one. Fewer ids than entries make smaller codebooks; none makes no codes (null code and error).
Repeated rows each have their own result. Extra columns stay, but those named like a result (in any case of letters) are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, free_name, materialise, others, read, release, schema_with, small_batches
from .vectors import matrix, usable, whole, width

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows of a block (one set of trees), points of a leaf, blocks of a file, and numbers of one numpy step.
BLOCK_ROWS, LEAF, FILE_BLOCKS, STEP = 8192, 16, 8, 1 << 20
#: A label that holds more than so small a part of the rows has its sum broadcast: there are fewer than that many.
HEAVY = 1000


def limit(d: int) -> int:
    """Largest whole number of a component for which d squares of differences fit a long."""
    return 1 << ((62 - max(0, (d - 1).bit_length())) // 2 - 1)


@dataclass
class Tree:
    """points in tree order and where they came from; of each node: its range of points, its left child (-1: a leaf; the right
    one is the next), box and sum."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    def packed(self) -> bytes:
        n, w = self.points.shape
        narrow = [x.astype(np.int32).tobytes() for x in (self.points, self.order, self.start, self.end, self.left, self.low, self.high)]
        return b"".join([np.array([n, w, len(self.start)]).tobytes(), self.sums.tobytes(), *narrow])

    @classmethod
    def of_bytes(cls, packed: bytes) -> Tree:
        n, w, m = np.frombuffer(packed, np.int64, 3).tolist()
        sums = np.frombuffer(packed, np.int64, m * w, 24).reshape(m, w)
        out, at = [], 24 + 8 * m * w
        for shape in ((n, w), (n,), (m,), (m,), (m,), (m, w), (m, w)):
            size = int(np.prod(shape))
            out.append(np.frombuffer(packed, np.int32, size, at).reshape(shape).astype(np.int64))
            at += 4 * size
        return cls(*out, sums)


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and which range each is of."""
    size = end - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - (np.cumsum(size) - size)[of] + start[of], of


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """kd-tree of whole-number points, level by level: a node's points are halved along the longest side of its box."""
    n, w = points.shape
    order = np.arange(n)
    levels, total = [], 1
    start, end = np.array([0]), np.array([n])
    while len(start):
        at, of = _ranges(start, end)
        own = points[order[at]]
        first = np.cumsum(end - start) - (end - start)
        low, high, sums = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first), np.add.reduceat(own, first)
        side, long = (high - low).argmax(1), (high - low).max(1)
        split = (end - start > leaf) & (long > 0)
        left = np.full(len(start), -1)
        left[split] = total + 2 * np.arange(split.sum())
        levels.append((start, end, left, low, high, sums))
        total += 2 * int(split.sum())
        go = split[of]
        at, of, own = at[go], of[go], own[go]
        value = own[np.arange(len(own)), side[of]] - low[of, side[of]]
        order[at] = order[at[np.argsort(of * (int(long.max()) + 1) + value, kind="stable")]]
        middle = (start + end) // 2
        start, end = np.stack([start, middle], 1)[split].ravel(), np.stack([middle, end], 1)[split].ravel()
    return Tree(points[order], order, *(np.concatenate(x) for x in zip(*levels)))


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each point in tree order (ties to the lower one), and each entry's sum and count of points."""
    k, w = book.shape
    code = np.zeros(len(tree.points), np.int64)
    sums, count = np.zeros((k, w), np.int64), np.zeros(k, np.int64)
    node, left_in = np.zeros(1, np.int64), np.ones((1, k), bool)
    number = np.arange(k)
    step = max(1, STEP // (k * w))
    while len(node):
        going, contested = [], []
        for i in range(0, len(node), step):
            at, some = node[i : i + step], left_in[i : i + step]
            low, high = tree.low[at][:, None], tree.high[at][:, None]
            away = ((2 * book - low - high) ** 2).sum(2)
            away[~some] = np.iinfo(np.int64).max
            best = away.argmin(1)
            near = book[best][:, None]
            corner = np.where(book > near, high, low)
            more = ((book - corner) ** 2).sum(2) - ((near - corner) ** 2).sum(2)
            some = some & ~((more > 0) | ((more == 0) & (number > best[:, None])))
            alone = some.sum(1) == 1
            best, whole_ = best[alone], at[alone]
            np.add.at(sums, best, tree.sums[whole_])
            np.add.at(count, best, tree.end[whole_] - tree.start[whole_])
            spot, of = _ranges(tree.start[whole_], tree.end[whole_])
            code[spot] = best[of]
            inner = tree.left[at] >= 0
            going.append((at[~alone & inner], some[~alone & inner]))
            contested.append((at[~alone & ~inner], some[~alone & ~inner]))
        leaf, some = (np.concatenate(x) for x in zip(*contested))
        _compare(tree, book, leaf, some, code, sums, count)
        node, left_in = (np.concatenate(x) for x in zip(*going))
        node, left_in = np.stack([tree.left[node], tree.left[node] + 1], 1).ravel(), np.repeat(left_in, 2, 0)
    return code, sums, count


def _compare(tree: Tree, book: np.ndarray, leaf: np.ndarray, some: np.ndarray, code: np.ndarray, sums: np.ndarray, count: np.ndarray) -> None:
    """Points of leaves against the entries that are left there, leaves with as many of them together."""
    many = some.sum(1)
    by = np.argsort(many, kind="stable")
    lo = 0
    while lo < len(by):
        hi = lo + max(1, STEP // (int(many[by[lo]]) * LEAF * book.shape[1]))
        rows = by[lo:hi]
        c = int(many[rows].max())
        entries = np.argsort(~some[rows], axis=1, kind="stable")[:, :c]  # those left come first, in order
        spot, of = _ranges(tree.start[leaf[rows]], tree.end[leaf[rows]])
        away = ((tree.points[spot][:, None] - book[entries[of]]) ** 2).sum(2)
        away[np.arange(c) >= many[rows][of][:, None]] = np.iinfo(np.int64).max
        pick = entries[of, away.argmin(1)]
        code[spot] = pick
        np.add.at(sums, pick, tree.points[spot])
        np.add.at(count, pick, 1)
        lo = hi


def forest(rows: DataFrame, vector: str, d: int, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows: the other columns of a block's rows; trees: one of each part. A table in the shared folder."""
    x_name = free_name(rows, "_x")
    wide = -(-d // parts) * parts
    kept = rows.where(usable(vector)).drop(vector).schema.fields
    small_batches(rows.sparkSession)

    def block_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = np.zeros((table.num_rows, wide), np.int64)
        x[:, :d] = matrix(table.column(x_name).chunk(0), d)
        trees = [build(x[:, i * (wide // parts) : (i + 1) * (wide // parts)]).packed() for i in range(parts)]
        rest = table.drop_columns([x_name]).to_struct_array()
        rest = rest.combine_chunks() if isinstance(rest, pa.ChunkedArray) else rest
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest), pa.array([trees])], ["rows", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, block_rows):
                part = batch.slice(i, block_rows)
                if held and n + part.num_rows > block_rows:
                    yield block_of(held)
                    held, n = [], 0
                    release()
                held.append(part)
                n += part.num_rows
        if n:
            yield block_of(held)

    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept)
    table = rows.where(usable(vector)).select(*[F.col(f"`{f.name}`") for f in kept], whole(vector, d, limit(wide)).alias(x_name))
    return materialise(table.mapInArrow(run, f"rows array<struct<{inner}>>, trees array<binary>"), maxRecordsPerFile=FILE_BLOCKS)


def first_books(rows: DataFrame, vec_id: str, vector: str, d: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """parts x entries x width numbers: the parts of the vectors of the least ids."""
    own = rows.where(usable(vector) & F.col(vec_id).isNotNull())
    ids = [r[0] for r in own.select(vec_id).distinct().orderBy(vec_id).limit(entries).collect()]
    wide = -(-d // parts) * parts
    first = own.where(F.col(vec_id).isin(ids)).groupBy(vec_id).agg(F.min(whole(vector, d, limit(wide))).alias("x")).orderBy(vec_id).collect()
    books = np.zeros((len(first), wide), np.int64)
    for i, r in enumerate(first):
        books[i, :d] = r["x"]
    return books.reshape(len(first), parts, wide // parts).transpose(1, 0, 2)


def next_books(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, and each entry that has some becomes the floor of their mean."""
    size, w = books.size // max(1, books.shape[2]), books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, w + 1), object)
        for batch in batches:
            for block in batch.column("trees"):
                found = [assign(Tree.of_bytes(t.as_py()), book)[1:] for t, book in zip(block.values, books)]
                total += np.hstack([np.concatenate([s for s, _ in found]), np.concatenate([c for _, c in found])[:, None]])
            release()
        used = np.flatnonzero(total[:, w] > 0)
        if len(used):
            at = np.repeat(used * (w + 1), w + 1) + np.tile(np.arange(w + 1), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[used].ravel().tolist(), pa.decimal128(38, 0))], ["at", "entry"])

    total = np.zeros(size * (w + 1), object)
    for r in trees.select("trees").mapInArrow(run, "at long, entry decimal(38,0)").groupBy("at").agg(F.sum("entry").alias("entry")).collect():
        total[r["at"]] = int(r["entry"])
    total, out = total.reshape(size, w + 1), books.reshape(size, w).copy()
    for i in np.flatnonzero(total[:, w] > 0):
        out[i] = [int(s) // int(total[i, w]) for s in total[i, :w]]
    return out.reshape(books.shape)


def train(rows: DataFrame, trees: DataFrame, vec_id: str, vector: str, d: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(rows, vec_id, vector, d, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = next_books(trees, books)
    return books


def encode(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows of the blocks with code (two hex digits a part) and error (squared distances summed over parts)."""
    inner = trees.schema["rows"].dataType.elementType
    names = inner.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("rows"), batch.column("trees")):
                rows = block.values
                code, error = np.zeros((len(rows), len(packed)), np.uint8), np.zeros(len(rows), np.int64)
                for i, t in enumerate(packed.values):
                    tree = Tree.of_bytes(t.as_py())
                    own = assign(tree, books[i])[0] if books.shape[1] else np.zeros(len(rows), np.int64)
                    code[tree.order, i] = own
                    if books.shape[1]:
                        error[tree.order] += ((tree.points - books[i][own]) ** 2).sum(1)
                digits = [r.tobytes().hex() for r in code] if books.shape[1] else [None] * len(rows)
                errors = pa.array(error) if books.shape[1] else pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(rows.field(i) for i in range(len(names))), pa.array(digits, pa.string()), errors], [*names, "code", "error"])
            release()

    plain = trees.sparkSession.createDataFrame([], inner)
    return trees.mapInArrow(run, schema_with(plain, "code string, error long"))


def with_label_error(coded: DataFrame, label: str, name: str = "label_error") -> DataFrame:
    """coded (a table that is written) with the errors summed over equal labels, nulls together. Rows of frequent labels stay where they are."""
    own = free_name(coded, "_label")
    sums = materialise(coded.groupBy(F.col(label).alias(own)).agg(F.sum("error").alias(name), F.count("*").alias(own + "_n")))
    total = sums.agg(F.sum(own + "_n")).first()[0] or 0
    heavy = sums.where(F.col(own + "_n") * HEAVY > total)
    tagged = coded.join(F.broadcast(heavy), F.col(label).eqNullSafe(F.col(own)), "left")
    few = tagged.where(F.col(own + "_n").isNotNull()).select(*coded.columns, name)
    rest = tagged.where(F.col(own + "_n").isNull()).select(*coded.columns)
    light = sums.where(F.col(own + "_n") * HEAVY <= total)
    return few.unionByName(rest.join(light, F.col(label).eqNullSafe(F.col(own))).select(*coded.columns, name))


def books_text(books: np.ndarray) -> str:
    """All entries' numbers by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The usable rows without their vectors, with code and error, as a table in the shared folder; and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("an entry is two hex digits: 1 to 256 of them")
    d = width(rows, vector) or 1
    plain = others(rows, "code", "error")
    trees = forest(plain, vector, d, parts)
    books = train(plain, trees, vec_id, vector, d, parts, entries, rounds)
    coded = materialise(encode(trees, books))
    discard(trees)
    return coded, books


def op12_vector_code_compression(spark, sf_dir: str) -> DataFrame:
    """A row for each usable row of embeddings: see the module's docstring."""
    coded, books = compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return with_label_error(coded, "label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """Each part's nearest entry of codebook b{n}, as assignment a{n}."""
    return f"""
a{n} AS (SELECT r, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM
  (SELECT x.r, x.p, b.e, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS d FROM x JOIN b{n} b ON x.p = b.p AND x.i = b.i GROUP BY x.r, x.p, b.e) GROUP BY r, p)"""


def _means(n: int) -> str:
    return f"""
m{n} AS (SELECT a.p, a.e, x.i, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS c FROM a{n} a JOIN x ON a.r = x.r AND a.p = x.p GROUP BY a.p, a.e, x.i),
b{n + 1} AS (SELECT b.p, b.e, b.i, CASE WHEN m.c IS NULL THEN b.v ELSE CAST((m.s - ((m.s % m.c) + m.c) % m.c) / m.c AS BIGINT) END AS v FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.e AND b.i = m.i)"""


ORACLE = f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
w AS (SELECT CAST(ceil(max(len(embedding)) / 16.0) AS BIGINT) AS w FROM k),
x AS (SELECT r, vec_id, label, (j - 1) // w AS p, (j - 1) % w AS i, coalesce(CAST(floor(256 * CAST(embedding[j] AS DOUBLE)) AS BIGINT), 0) AS v
  FROM (SELECT k.*, w, unnest(range(1, 16 * w + 1)) AS j FROM k, w)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT r, vec_id FROM k WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY embedding) = 1)),
b0 AS (SELECT p, e, i, v FROM x JOIN f USING (r) WHERE e < 64),{_round(0)},{_means(0)},{_round(1)},{_means(1)},{_round(2)},
done AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN done USING (r), books
"""
