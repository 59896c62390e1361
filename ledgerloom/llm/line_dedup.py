"""Repeated lines, by levelled sorted runs of line hashes.

A run is a bucketed table in the shared folder, sorted by hash within its buckets: for each line's hash the number of documents that hold it (1, 2, or 3 for
three and more) and the largest of them. A batch of documents is reduced to such rows, merge-anti-joined with the runs (a row
that the runs can't learn from goes) and written as a run of the lowest level. As soon as a level has FAN runs, they are merged
into one run of the next level. Runs are bucketed alike, so that neither joins nor merges shuffle them, and each run takes part in few merges. A fixed table
comes as batches of documents by falling id: the first holder of a line is then its largest one, and a line that is known to be frequent is never added again.

A document's line goes if the runs, merged, know three documents with it and a larger one than this. That is a join of lines with
the frequent lines only: those that hold more than a thousandth of all rows are given to each task (there are fewer than a
thousand), the others are shuffled. A line that a third of all documents hold sends at most three rows a batch of texts to the
count, and none to the join.

Batches hold disjoint documents; a batch that failed half-way leaves no run, and is added again.

Defined results: a null or empty text is one empty line. A null doc_id is no document: its row returns whole and counts nowhere.
Rows that share a doc_id are one document, which counts once and keeps its lines in all rows if it is the largest. Very long texts and lines are taken
whole. Lines are compared by 128-bit hashes. Extra columns stay, but those named like a result (in any case of letters) are replaced.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import _drop, checkpoint_dir, free_name, materialise, others, read, release, schema_with, small_batches

#: Code points of a line that counts, and documents that make it frequent.
LEAST, FREQUENT = 20, 3
#: Batches of a fixed table, and runs of a level that are merged into one.
BATCHES, FAN = 4, 2
#: A frequent line of more than so small a part of the rows is given to each task: there are fewer than that many.
HEAVY = 1000
BLANKS = b" \t\n\v\f\r"


def keys_of(text: str | None) -> list[bytes | None]:
    """The 128-bit hash of each line's key, None for lines whose key is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(BLANKS)
        out.append(xxhash.xxh3_128_digest(key.lower()) if len(key) >= LEAST and (len(key) >= 4 * LEAST or len(key.decode("utf-8", "replace")) >= LEAST) else None)
    return out


def _hashes(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of texts: hash, and its three largest documents, with the number of rows in which the batch has it on the largest."""
    for batch in batches:
        held: dict[bytes, list[int]] = {}
        rows: dict[bytes, int] = {}
        ids = batch.column("doc_id").to_pylist()
        for i in sorted(range(len(ids)), key=ids.__getitem__, reverse=True):
            for key in {k for k in keys_of(batch.column("text")[i].as_py()) if k is not None}:
                mine = held.setdefault(key, [])
                rows[key] = rows.get(key, 0) + 1
                if len(mine) < FREQUENT and ids[i] not in mine:
                    mine.append(ids[i])
        if held:
            digests = [k for k, docs in held.items() for _ in docs]
            docs = [d for docs in held.values() for d in docs]
            n = [rows[k] if j == 0 else 0 for k, docs in held.items() for j in range(len(docs))]
            yield pa.RecordBatch.from_arrays([*_hashes(digests), pa.array(docs, pa.int64()), pa.array(n, pa.int64())], ["h", "g", "doc", "n_rows"])
        release()


@contextmanager
def _sorted_scans(spark: SparkSession):
    """While runs are joined: a bucket that is one sorted file is read as sorted, so that merge joins don't sort it again."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """Levels of sorted runs: h, g (the hash), n_docs (at most 3), last (largest document), n_rows (rows met with it)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, docs: DataFrame) -> None:
        """docs: doc_id, text of documents that no earlier batch has."""
        small_batches(self.spark)
        rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        # a document in several rows: one holder
        holders = rows.mapInArrow(_holders, "h long, g long, doc long, n_rows long").groupBy("h", "g", "doc").agg(F.sum("n_rows").alias("n_rows"))
        new = holders.repartition(self.buckets, "h", "g").groupBy("h", "g").agg(F.least(F.count("*"), F.lit(FREQUENT)).alias("n_docs"), F.max("doc").alias("last"), F.sum("n_rows").alias("n_rows"))
        for name in self.runs():
            run = self.spark.table(name).alias("run")
            known = (F.col("new.h") == F.col("run.h")) & (F.col("new.g") == F.col("run.g")) & (F.col("run.n_docs") >= FREQUENT) & (F.col("run.last") >= F.col("new.last"))
            new = new.alias("new").join(run.hint("merge"), known, "left_anti").select("new.*")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            merging = self.levels[level]
            self._write(self.merged(merging), level + 1)
            self.levels[level] = []
            self._remove(merging)
            level += 1

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """One row for each hash of these runs (all by default): full merge joins of runs that are bucketed alike."""
        names = self.runs() if names is None else names
        out = self.spark.table(names[0])
        for name in names[1:]:
            a, b = out.alias("a"), self.spark.table(name).alias("b").hint("merge")
            both = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.g") == F.col("b.g")), "full_outer")
            sum_of = lambda c: F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))
            out = both.select(F.coalesce("a.h", "b.h").alias("h"), F.coalesce("a.g", "b.g").alias("g"), F.least(sum_of("n_docs"), F.lit(FREQUENT)).alias("n_docs"), F.greatest("a.last", "b.last").alias("last"), sum_of("n_rows").alias("n_rows"))
        return out

    def frequent(self) -> DataFrame:
        """Lines that three or more documents hold, as a table in the shared folder."""
        with _sorted_scans(self.spark):
            return materialise(self.merged().where(F.col("n_docs") >= FREQUENT).select("h", "g", "last", "n_rows"))

    def close(self) -> None:
        self._remove(self.runs())
        self.levels = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{checkpoint_dir(self.spark)}/{name}"
        with _sorted_scans(self.spark):
            rows.write.option("path", path).bucketBy(self.buckets, "h", "g").sortBy("h", "g").saveAsTable(name)
        atexit.register(_drop, self.spark, path)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            _drop(self.spark, f"{checkpoint_dir(self.spark)}/{name}")


def batches_of(docs: DataFrame, n: int = BATCHES) -> list[DataFrame]:
    """docs with an id in n batches of about as many, by falling id."""
    id_ = F.col("doc_id").cast("long")
    edges = docs.select(F.percentile_approx(id_, [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else []
    edges = sorted(set(edges or []), reverse=True)
    if not edges:
        return [docs]
    out = [docs.where(id_ > edges[0])]
    out += [docs.where((id_ <= a) & (id_ > b)) for a, b in zip(edges, edges[1:])]
    return [*out, docs.where(id_ <= edges[-1])]


def dropped_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), lines: the hashes of the lines that the document loses."""
    total = docs.count()
    heavy = {r.h.to_bytes(8, "little", signed=True) + r.g.to_bytes(8, "little", signed=True): r.last for r in frequent.where(F.col("n_rows") * HEAVY > total).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, digests, gone = [], [], []
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                for key in {k for k in keys_of(text.as_py()) if k is not None}:
                    last = heavy.get(key)
                    if last is None or doc < last:
                        where.append(i)
                        digests.append(key)
                        gone.append(last is not None)
            if where:
                own = batch.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("key"), *_hashes(digests), pa.array(gone)], ["doc_id", "key", "h", "g", "gone"])
            release()

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    lines = rows.mapInArrow(run, "doc_id long, key long, h long, g long, gone boolean")
    light = frequent.where(F.col("n_rows") * HEAVY <= total).select("h", "g", "last")
    met = lines.join(light, ["h", "g"], "left").where(F.col("gone") | (F.col("doc_id") < F.col("last")))
    return met.groupBy("doc_id", "key").agg(F.collect_set(F.struct("h", "g")).alias("lines"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: the lines that stay, joined by line feeds."""
    spark = docs.sparkSession
    rows = others(docs, "n_lines", "n_dropped", "kept_text")
    runs = LineRuns(spark, fan=fan)
    for batch in batches_of(docs.select("doc_id", "text"), batches):
        runs.add(batch)
    frequent = runs.frequent()
    runs.close()
    d, k, lines = free_name(rows, "_line_doc"), free_name(rows, "_line_key"), free_name(rows, "_lines")
    gone = materialise(dropped_lines(docs, frequent).select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("lines").alias(lines)))
    both = rows.join(gone, (F.col("doc_id") == F.col(d)) & (F.xxhash64("text") == F.col(k)), "left").drop(d, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(lines)
            n_lines, n_dropped, kept = [], [], []
            for text, lost in zip(batch.column("text"), batch.column(at)):
                text = text.as_py() or ""
                n_lines.append(text.count("\n") + 1)
                if lost.is_valid:
                    bad = {r["h"].to_bytes(8, "little", signed=True) + r["g"].to_bytes(8, "little", signed=True) for r in lost.as_py()}
                    stay = [line for line, key in zip(text.split("\n"), keys_of(text)) if key not in bad]
                    n_dropped.append(n_lines[-1] - len(stay))
                    text = "\n".join(stay)
                else:
                    n_dropped.append(0)
                kept.append(text)
            own = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in own), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                [*(batch.schema.names[i] for i in own), "n_lines", "n_dropped", "kept_text"],
            )
            release()

    small_batches(spark)
    return both.mapInArrow(run, schema_with(rows, "n_lines long, n_dropped long, kept_text string"))


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of the whole table: see the module's docstring."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT r, k.doc_id, i, line, coalesce(k.doc_id < last, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM s GROUP BY r, doc_id
"""
