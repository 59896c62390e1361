"""Two readings of a file: compared as multisets of day, direction and cents; one is taken whole, never their union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["date", "direction", "amount_cents"]
#: Description of fee rows that a reading derives from a column; the other reading cannot have them.
FEE = "Tarifa"
#: Differences that are listed; they are counted in full.
LISTED = 40


def comparable(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("description") != FEE)


def inner_days(chosen: DataFrame, sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both, on the days strictly inside the sample's first and last; nothing if those are its only days."""
    span = sample.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    cut = lambda d: d.crossJoin(F.broadcast(span)).where("date > lo and date < hi").drop("lo", "hi")
    return cut(chosen), cut(sample)


def counts(chosen: DataFrame, witness: DataFrame) -> DataFrame:
    """A row a key: in both, only in the chosen reading, only in the witness."""
    both = chosen.select(*KEY, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(witness.select(*KEY, F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = both.groupBy(*KEY).agg(F.sum("a").cast("long").alias("a"), F.sum("b").cast("long").alias("b"))
    return n.select(*KEY, F.least("a", "b").alias("common"), F.greatest(F.lit(0), F.col("a") - F.col("b")).alias("only_chosen"), F.greatest(F.lit(0), F.col("b") - F.col("a")).alias("only_witness"))


def cross_check(chosen: DataFrame, witness: DataFrame) -> DataFrame:
    """One row of totals."""
    n = counts(comparable(chosen), comparable(witness))
    return n.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("common", "only_chosen", "only_witness")])


def differences(chosen: DataFrame, witness: DataFrame, order: str = "source_order", listed: int = LISTED) -> DataFrame:
    """Rows beyond the common number of their key, numbered in file order, chosen side first; the first `listed`, then by date."""

    def beyond(left: DataFrame, right: DataFrame, side: str) -> DataFrame:
        mine = left.withColumn("_n", F.row_number().over(W.partitionBy(*KEY).orderBy(order)))
        theirs = right.groupBy(*KEY).agg(F.count("*").alias("_m"))
        return mine.join(theirs, KEY, "left").where(F.col("_n") > F.coalesce("_m", F.lit(0))).select(F.lit(side).alias("side"), *KEY, "description", order)

    a, b = comparable(chosen), comparable(witness)
    return beyond(a, b, "chosen").unionByName(beyond(b, a, "witness")).orderBy("side", order).limit(listed).orderBy("date", "side", order)


def verdict(check: DataFrame, proved: bool, witnessed: bool, covered: bool = True) -> DataFrame:
    """Level of the reading that is taken: proved readings go before empirical ones; a witness without a difference corroborates."""
    agreed = (F.col("only_chosen") == 0) & (F.col("only_witness") == 0) & F.lit(covered)
    if proved:
        level = F.when(agreed, "corroborated").otherwise("proved") if witnessed else F.lit("proved")
    else:
        level = F.lit("empirical" if witnessed else "refused")
    return check.withColumn("level", level)
