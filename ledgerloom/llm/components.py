"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise

#: A key that holds more than so small a part of the rows is joined by broadcast: there are fewer than that many such keys.
HEAVY = 1000


def joined(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the row of `table` that has their key. `size` tells how many rows have a key, of `total` or fewer rows.

    The edges of a large component all meet at its least node, and no task could hold them. So rows of a key that holds more than
    a HEAVY-th of them stay where they are: such keys are fewer than HEAVY, whatever the data. The rest is shuffled.
    """
    tagged = rows.join(F.broadcast(table.where(F.col(size) * HEAVY > total)), key, "left")
    few = tagged.where(F.col(size).isNotNull())
    rest = tagged.where(F.col(size).isNull()).select(*rows.columns).join(table.where(F.col(size) * HEAVY <= total), key)
    return few.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). node, root: each node of an edge and the least node of its component.

    Edges point from the larger node to the smaller one. A large-star step leads each edge on to the least neighbour of its
    smaller end, a small-star step ties all smaller neighbours of a node to the least of them. Each step is aggregations with map-side
    combining and equi-joins over the edges, whose number never grows; the result of a round is a table in the shared folder, so that
    neither lineage nor the driver grows with the number of rounds.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _state(now)
    while seen[0]:
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        ends = now.groupBy("b").agg(F.count("*").alias("n")).join(least, "b", "left").select("b", F.coalesce("m", "b").alias("m"), "n")
        large = materialise(joined(now, ends, "b", "n", seen[0]).select("a", F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        near = joined(large, least, "a", "n", seen[0])
        both = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        after = materialise(near.select(both.alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        discard(large)
        discard(now)
        now = after
        if (state := _state(now)) == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
