"""Exact top-k search of 64-bit binary codes by incremental multi-index hashing.

A code is cut into m segments, so wide that a bucket of (segment, value) holds about LOAD codes. Codes at Hamming distance m*r+m-1 at most
agree with the query to within r bits in some segment. So buckets of (segment, value) are probed at growing radii, each
code found is verified in full, and a query goes on until the distance of its kth verified neighbour is covered. A query
that needs j more units of distance probes only j segments at the next radius.

Copies: equal codes are one entry with its k+1 least ids (no further one can be among the k nearest), and equal query codes
are searched once. Probes and entries meet in an equi-join on (segment, value), whose hot values Spark splits.

Defined results: rows with a null id or vector are neither queries nor neighbours; a query's own id is not its neighbour.
Ties of distance go by id. A table of fewer than k other ids gives them all. Repeated rows of one id and code are one row. An id
with several codes is one query and one neighbour: the distance of two ids is the least of any of their codes.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, read

#: FIRST: radius up to which every query is probed at the start. LOAD: codes in a bucket on average; to look at a code that
#: a probe has met costs far less than a probe.
K, BITS, FIRST, LOAD = 10, 64, 0, 16


def sign_code(vector: str) -> Column:
    """Bit i is set if element i of the first 64 is above zero."""
    return F.expr(f"aggregate(transform(slice({vector}, 1, {BITS}), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")


def _segments(n_codes: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment."""
    m = min(16, max(2, round(BITS / max(1.0, math.log2(max(2, n_codes / LOAD))))))
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _value(code: str, low: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(code), low).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


def _probes(queries: DataFrame, segments: list[tuple[int, int]], at: int, radius: int) -> DataFrame:
    """Buckets of one segment at exactly this distance from the query's own."""
    low, width = segments[at]
    masks = F.explode(F.array(*[F.lit(x) for x in _masks(width, radius)]))
    return queries.select("q", "bound", F.lit(at).alias("seg"), masks.alias("mask")).select("q", "bound", "seg", _value("q", low, width).bitwiseXOR(F.col("mask")).alias("value"))


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """rows, queries: id, code (long). query_id, rank, neighbor_id, distance of the k nearest rows of each query."""
    rows = materialise(rows.where("id is not null and code is not null").select("id", "code").distinct())
    queries = materialise(queries.where("id is not null and code is not null").select("id", "code").distinct())
    # k+1 ids (the query's own among them) are sure to be among so many pairs of id and code
    most = (k + 1) * (rows.groupBy("id").count().agg(F.max("count")).first()[0] or 1)
    numbered = rows.withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    codes = materialise(numbered.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("code", "ids", F.col("ids")[0].alias("least"), F.size("ids").alias("n")))
    segments = _segments(codes.count())
    m = len(segments)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _value("code", low, width).alias("value")) for i, (low, width) in enumerate(segments)]))
    index = codes.select("code", "least", "n", each.alias("s")).select("s.seg", "s.value", "code", "least", "n")
    found = None
    active = queries.select(F.col("code").alias("q")).distinct().select("q", F.lit(BITS).alias("bound"), F.lit(m).alias("need"))
    active = materialise(active)
    radius, widest = FIRST, max(w for _, w in segments)
    while True:
        # every segment up to FIRST bits at the start, then the `need` first segments at the next radius
        probes = None
        for i, (_, width) in enumerate(segments):
            for r in range(radius + 1) if radius == FIRST else (radius,):
                if r <= width:
                    p = _probes(active.where(F.col("need") > i), segments, i, r)
                    probes = p if probes is None else probes.unionByName(p)
        if probes is not None:
            met = probes.join(index.hint("shuffle_hash"), ["seg", "value"])
            met = met.select("q", "bound", "code", "least", "n", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance")).where("distance <= bound")
            met = met.groupBy("q", "code").agg(*[F.min(c).alias(c) for c in ("least", "n", "distance")])
            if found is not None:
                met = met.unionByName(found).dropDuplicates(["q", "code"])
            order = W.partitionBy("q").orderBy("distance", "least")
            found = materialise(met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r"))
        if radius >= widest:
            break
        # distance at which `most` pairs, so k+1 ids, the query's own among them, are verified; what the searched radii cover
        sums = F.sum("n").over(W.partitionBy("q").orderBy("distance", "least").rowsBetween(W.unboundedPreceding, 0))
        bounds = found.withColumn("rows", sums).where(F.col("rows") >= most).groupBy("q").agg(F.min("distance").alias("b"))
        covered = m * radius + m - 1
        active = active.where(F.col("need") >= m).select("q").join(bounds, "q", "left").select("q", F.coalesce("b", F.lit(BITS)).alias("bound"))
        active = materialise(active.where(F.col("bound") > covered).withColumn("need", F.least(F.lit(m), F.col("bound") - covered)))
        if active.isEmpty():
            break
        radius += 1
    near = found.join(codes.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    out = queries.withColumnsRenamed({"id": "query_id", "code": "q"}).join(near, "q").where("neighbor_id <> query_id")
    if most > k + 1:
        out = out.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", F.col("distance").cast("long").alias("distance"))


def op1_exact_topk_search(spark, sf_dir: str) -> DataFrame:
    """Queries: every row whose vec_id is divisible by 50, once each; against all rows."""
    rows = read(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), sign_code("embedding").alias("code"))
    rows = materialise(rows)
    return search(rows, rows.where("id % 50 = 0"))


ORACLE = """
WITH bit AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
code AS (SELECT vec_id, string_agg(CASE WHEN x > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS c FROM bit WHERE i < 64 GROUP BY vec_id),
pair AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, CAST(hamming(q.c, r.c) AS BIGINT) AS distance FROM code q JOIN code r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance FROM pair
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= 10
"""
