"""Proofs that a reading is whole: row arithmetic, balance chains, day totals, phantom rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_arithmetic(rows: DataFrame) -> DataFrame:
    """before + value - fee = after, in whole cents."""
    return rows.withColumn("row_ok", F.col("before_cents") + F.col("value_cents") - F.coalesce("fee_cents", F.lit(0)) == F.col("after_cents"))


#: Places in a file's order that one segment of its chain spans: what a window holds, however long a statement is.
SEGMENT = 100_000


def in_segments(rows: DataFrame, order: str, segment: int = SEGMENT) -> DataFrame:
    return rows.withColumn("_segment", F.floor(F.col(order) / segment))


def balance_chain(rows: DataFrame, by: str = "file_id", order: str = "row_no", counted: dict[str, Column] | None = None, segment: int = SEGMENT, read: Column | None = None) -> DataFrame:
    """A row a file: rows that add up or don't, links of consecutive rows that hold or break, in the direction that breaks less.

    A file's order is cut into segments. Each is proved for itself and summed up: its counts, its first and its last balances. Summaries
    are merged in order, a link more between each two that follow one another; so no task holds a file, only its summaries. `order` is a
    whole number. Only rows that are `read` (all by default) are links of the chain. counted: more conditions, whose rows are counted along."""
    counted = counted or {}
    part = [by, "_segment"]
    rows = rows if "_segment" in rows.columns else in_segments(rows, order, segment)
    ends = F.struct(F.col("before_cents").alias("b"), F.col("after_cents").alias("a"))
    own = row_arithmetic(rows).withColumn("_x", F.when(F.lit(True) if read is None else read, ends))
    breaks = lambda last, first: (F.coalesce(F.col(f"{last}.b") != F.col(f"{first}.a"), F.lit(False)), F.coalesce(F.col(f"{last}.a") != F.col(f"{first}.b"), F.lit(False)))
    before = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    down, up = breaks("_last", "_x")
    is_read = F.col("_x").isNotNull()
    sums = {
        "n_rows": F.count_if(is_read), "rows_ok": F.count_if(is_read & F.col("row_ok")), "rows_bad": F.count_if(is_read & ~F.col("row_ok")), "breaks_newest_first": F.count_if(down), "breaks_oldest_first": F.count_if(up),
    } | {c: F.count_if(x) for c, x in counted.items()}
    found = own.withColumn("_last", F.last("_x", ignorenulls=True).over(before)).groupBy(*part).agg(
        *[x.alias(c) for c, x in sums.items()], F.min_by("_x", F.when(is_read, F.col(order))).alias("_first"), F.max_by("_x", F.when(is_read, F.col(order))).alias("_end")
    )
    met = found.withColumn("_last", F.last("_end", ignorenulls=True).over(W.partitionBy(by).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)))
    down, up = breaks("_last", "_first")
    met = met.withColumns({"breaks_newest_first": F.col("breaks_newest_first") + down.cast("long"), "breaks_oldest_first": F.col("breaks_oldest_first") + up.cast("long")})
    out = met.groupBy(by).agg(*[F.sum(c).alias(c) for c in sums])
    broken = F.least("breaks_newest_first", "breaks_oldest_first")
    return out.withColumns({"links_broken": broken, "links_ok": F.greatest(F.col("n_rows") - 1, F.lit(0)) - broken})


def day_close(lines: DataFrame, by: str = "file_id", order: str = "line_no") -> DataFrame:
    """Lines with is_close (declares a balance: balance_cents) or a signed amount_cents. A row a closing: declared and expected balance.

    A group ends with its closing line and runs on over page breaks; the first closing has nothing to be checked against.
    """
    before = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    grouped = lines.withColumn("day_no", F.coalesce(F.sum(F.col("is_close").cast("long")).over(before), F.lit(0)))
    days = grouped.groupBy(by, "day_no").agg(
        F.coalesce(F.sum(F.when(~F.col("is_close"), F.col("amount_cents"))), F.lit(0)).cast("long").alias("moved_cents"),
        F.max(F.when(F.col("is_close"), F.col("balance_cents"))).alias("declared_cents"),
    )
    previous = F.lag("declared_cents").over(W.partitionBy(by).orderBy("day_no"))
    days = days.withColumn("expected_cents", previous + F.col("moved_cents")).where("declared_cents is not null")
    return days.withColumn("agrees", F.col("expected_cents") == F.col("declared_cents"))


def phantom_rows(rows: DataFrame, by: str, order: str, key: list[str], balance: str) -> DataFrame:
    """Rows with is_phantom: same key as the row before and a balance that didn't move."""
    w = W.partitionBy(by).orderBy(order)
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    still = F.col(balance).isNotNull() & (F.col(balance) == F.lag(balance).over(w))
    return rows.withColumn("is_phantom", F.coalesce(still & same & (F.row_number().over(w) > 1), F.lit(False)))


def first_of_line(rows: DataFrame, by: list[str], line: str, key: list[str], order: str) -> DataFrame:
    """The first row of each source line and key; rows without a line all stay."""
    n = F.row_number().over(W.partitionBy(*by, line, *key).orderBy(order))
    return rows.withColumn("_n", n).where(F.col(line).isNull() | (F.col("_n") == 1)).drop("_n")


def first_details(rows: DataFrame, by: str, order: str, detail: str, most: int) -> DataFrame:
    """by, details: the first so many details of each file, in order; what is beyond never leaves its task."""
    first = rows.where(F.col(detail).isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("_n") <= most)
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(detail).alias("d")))), lambda x: x["d"]).alias("details"))


def trustworthy(audit: DataFrame) -> DataFrame:
    """Verdict on an audit row: n_tx, n_unread, rows_bad, contradictions, links_broken, rows_ok; the first reason that holds."""
    reason = (
        F.when(F.col("n_tx") == 0, "no transaction recognised")
        .when(F.col("n_unread") > 0, "rows not read")
        .when(F.col("contradictions") > 0, "direction contradicts sign")
        .when(F.col("rows_bad") > 0, "row arithmetic fails")
        .when(F.col("links_broken") > 0, "balance chain breaks")
        .when(F.col("rows_ok") == 0, "nothing to check")
    )
    return audit.withColumns({"reason": reason, "trusted": reason.isNull()})
