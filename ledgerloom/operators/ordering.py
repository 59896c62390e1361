"""The order of dates in a sheet, and where new rows go.

existing: group, idx (0, 1, ... in sheet order), date. new: group, seq (file order), date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least number of telling pairs, and least share of the leading direction.
PAIRS, SHARE = 3, 0.75


def pair_counts(rows: DataFrame, by: str = "group", order: str = "idx") -> DataFrame:
    """Ascending, descending and equal neighbours of each group's dated rows."""
    previous = F.lag("date").over(W.partitionBy(by).orderBy(order))
    pairs = rows.where("date is not null").withColumn("_p", previous)
    return pairs.groupBy(by).agg(
        F.count("*").alias("sampled"), F.count_if(F.col("date") > F.col("_p")).alias("ascending"), F.count_if(F.col("date") < F.col("_p")).alias("descending"), F.count_if(F.col("date") == F.col("_p")).alias("ties")
    )


def evidence(counts: DataFrame) -> DataFrame:
    """Trend, and the order if it is conclusive; the confidence stays a fraction of whole numbers (leading / compared)."""
    compared, leading = F.col("ascending") + F.col("descending"), F.greatest("ascending", "descending")
    trend = F.when(compared == 0, F.lit(None)).when(F.col("ascending") >= F.col("descending"), "ascending").otherwise("descending")
    sure = (compared >= PAIRS) & (leading >= compared * SHARE)
    return counts.withColumns({"compared": compared, "leading": leading, "trend": trend, "order": F.when(sure, trend).otherwise("undefined")})


def combine(counts: DataFrame) -> DataFrame:
    """Evidence of all groups together: counts add up."""
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("sampled", "ascending", "descending", "ties")])
    return evidence(sums)


def insertion_points(existing: DataFrame, new: DataFrame, order: DataFrame) -> DataFrame:
    """new with position: the idx of the existing row it goes before, or the number of rows for the end.

    order: group, order. In ascending order a row goes before the first existing one with a later date; undated new rows, and
    all in a group of undefined order, go to the end. Instead of comparing each new row with each existing one, existing
    and new rows of a group are sorted once by date: the position is the least idx among later dates, a running minimum.
    """
    sized = existing.groupBy("group").agg(F.count("*").alias("_size"))
    marked = existing.where("date is not null").select("group", "date", "idx", F.lit(0).alias("is_new"), F.lit(None).cast("long").alias("seq"))
    marked = marked.unionByName(new.select("group", "date", F.lit(None).cast("long").alias("idx"), F.lit(1).alias("is_new"), F.col("seq").cast("long").alias("seq")))
    marked = marked.join(order.select("group", "order"), "group", "left")
    # strictly later dates in the sheet's own sense: days counted forwards or backwards
    day = F.unix_date("date") * F.when(F.col("order") == "descending", -1).otherwise(1)
    later = F.min("idx").over(W.partitionBy("group").orderBy("_day").rangeBetween(1, W.unboundedFollowing))
    found = marked.withColumn("_day", day).withColumn("_later", later).where("is_new = 1").join(sized, "group", "left")
    placed = (F.col("date").isNotNull()) & F.col("order").isin("ascending", "descending")
    return found.select("group", "seq", "date", F.coalesce(F.when(placed, F.col("_later")), F.col("_size"), F.lit(0)).cast("long").alias("position"))


def sink_plan(existing: DataFrame, new: DataFrame, order: DataFrame) -> DataFrame:
    """Every row of the sheet afterwards: group, target (0, 1, ...), is_new, idx or seq."""
    placed = insertion_points(existing, new, order).join(order.select("group", "order"), "group", "left")
    day = F.unix_date("date") * F.when(F.col("order") == "descending", -1).when(F.col("order") == "ascending", 1).otherwise(0)
    undated = F.col("date").isNull() & F.coalesce(F.col("order").isin("ascending", "descending"), F.lit(False))
    rows = placed.select("group", "position", F.lit(0).alias("kind"), undated.cast("int").alias("undated"), F.coalesce(day, F.lit(0)).alias("day"), F.col("seq").alias("at"))
    rows = rows.unionByName(existing.select("group", F.col("idx").cast("long").alias("position"), F.lit(1).alias("kind"), F.lit(0).alias("undated"), F.lit(0).alias("day"), F.col("idx").cast("long").alias("at")))
    target = F.row_number().over(W.partitionBy("group").orderBy("position", "kind", "undated", "day", "at")) - 1
    return rows.select("group", target.cast("long").alias("target"), (F.col("kind") == 0).alias("is_new"), "at")
