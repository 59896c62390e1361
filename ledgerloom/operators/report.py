"""Balances, totals and rows for the sheet, from transactions (date, description, direction, amount_cents, source_order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates


def incoming() -> Column:
    return F.sum(F.when(F.col("direction") == "credit", F.col("amount_cents")).otherwise(0)).cast("long")


def outgoing() -> Column:
    return F.sum(F.when(F.col("direction") != "credit", F.col("amount_cents")).otherwise(0)).cast("long")


def monthly_balance(tx: DataFrame) -> DataFrame:
    """A row a month with its net and the running total. The window sees months, not transactions."""
    months = tx.groupBy(dates.competence(F.col("date")).alias("competence_key")).agg(
        F.min(dates.month_sheet(F.col("date"))).alias("label"), incoming().alias("in_cents"), outgoing().alias("out_cents"), F.count("*").alias("n")
    )
    net = F.col("in_cents") - F.col("out_cents")
    running = F.sum(net).over(W.orderBy("competence_key").rowsBetween(W.unboundedPreceding, 0))
    return months.withColumns({"net_cents": net, "cumulative_cents": running.cast("long")})


def balance_with_total(tx: DataFrame) -> DataFrame:
    """The months and, with a null key, their total."""
    return tx.rollup(dates.competence(F.col("date")).alias("competence_key")).agg(
        incoming().alias("in_cents"), outgoing().alias("out_cents"), F.count("*").alias("n")
    ).withColumn("net_cents", F.col("in_cents") - F.col("out_cents"))


def totals(tx: DataFrame) -> DataFrame:
    return tx.agg(F.coalesce(incoming(), F.lit(0)).alias("in_cents"), F.coalesce(outgoing(), F.lit(0)).alias("out_cents"), F.count("*").alias("n"))


def by_competence(tx: DataFrame) -> DataFrame:
    """A row a month: transactions, first and last position in the file."""
    return tx.groupBy(dates.competence(F.col("date")).alias("competence_key")).agg(F.count("*").alias("n"), F.min("source_order").alias("first_order"), F.max("source_order").alias("last_order"))


def sheet_rows(tx: DataFrame) -> DataFrame:
    """What a sheet takes: serial and text of the date; one of the two amounts is null."""
    category = F.col("category") if "category" in tx.columns else F.lit(None).cast("string")
    amount = lambda d: F.when(F.col("direction") == d, F.col("amount_cents"))
    return tx.select(
        "source_order", dates.sheet_serial(F.col("date")).cast("long").alias("date_serial"), dates.brazilian(F.col("date")).alias("date_text"), "description",
        category.alias("category"), amount("credit").alias("in_cents"), amount("debit").alias("out_cents"),
    )


def missing_sheets(tx: DataFrame, sheets: DataFrame) -> DataFrame:
    """Months of tx whose sheet isn't there; sheets: sheet. No sheets known means that all exist."""
    months = tx.select(dates.competence(F.col("date")).alias("competence_key"), dates.month_sheet(F.col("date")).alias("sheet")).distinct()
    known = sheets.select("sheet").distinct()
    any_known = known.agg((F.count("*") > 0).alias("any"))
    return months.join(known, "sheet", "left_anti").crossJoin(F.broadcast(any_known)).where("any").select("competence_key", "sheet")


def running_balance(rows: DataFrame, by: str, order: str, seed: Column) -> DataFrame:
    """seed + in - out, row after row of each sheet."""
    step = F.sum(F.coalesce("in_cents", F.lit(0)) - F.coalesce("out_cents", F.lit(0)))
    return rows.withColumn("balance_cents", seed + step.over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
