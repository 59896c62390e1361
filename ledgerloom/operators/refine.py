"""The profile of a workbook, refined by a port: what headers don't tell is asked for, and believed only where the cells confirm it.

A workbook whose headers name all needed roles is never asked about. For any other one the port gets its columns (letter, header, and how
many of the filled cells are dates, numbers, texts, formulas) and answers with pairs of letter and role. Each pair is settled for
itself, and its verdict kept: a role that the headers name stays theirs. A workbook that still lacks a needed role gets the usual letters, and a warning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.steps import stored, then
from ..sources.workbook import is_date_style
from . import profile
from .cascade import BATCH, Port, asked_in_batches

ACCEPTED = "confirmed by the cells"
USUAL = "some columns could not be told: the usual letters stand in for them"


def evidence(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, col, filled and how many of them are dates, numbers, texts, formulas; a text that reads as a date is one."""
    kind = F.col("kind")
    day = F.when(kind == "number", is_date_style(F.col("style"))).otherwise((kind == "text") & dates.reads_loosely(F.col("value")))
    cells, day = then(cells, {"_day": day}, *by, "col", "kind"), F.col("_day")
    counts = {"filled": kind != "empty", "n_dates": day, "n_numbers": (kind == "number") & ~day, "n_texts": (kind == "text") & ~day, "n_formulas": kind == "formula"}
    return cells.groupBy(*by, "col").agg(*[F.count_if(x).alias(c) for c, x in counts.items()])


def confirmed(role: Column) -> Column:
    """Whether at least half of a column's filled cells are of a kind that fits the role. What is written to is not calculated."""
    half = lambda c: c * 2 >= F.col("filled")
    fits = (
        F.when(role == "date", half(F.col("n_dates"))).when(role.isin("in", "out"), half(F.col("n_numbers")))
        .when(role == "balance", half(F.col("n_numbers") + F.col("n_formulas"))).otherwise(half(F.col("n_texts")))
    )
    return F.coalesce((F.col("filled") > 0) & fits, F.lit(False))


def questions(columns: DataFrame, by: list[str]) -> DataFrame:
    """by, columns: the workbooks that lack a needed role, with all that is known of their columns."""
    known = ["col", "header", "role", "filled", "n_dates", "n_numbers", "n_texts", "n_formulas"]
    found = columns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*known))).alias("columns"), F.collect_set(F.when(F.col("role").isin(*profile.NEEDED), F.col("role"))).alias("_has"))
    return found.where(F.size("_has") < len(profile.NEEDED)).drop("_has")


def settle(columns: DataFrame, told: DataFrame, by: list[str]) -> DataFrame:
    """told (by, pos, col, role) with verdict: the first reason against it, or ACCEPTED. Of several answers for one role or column the first that
    the cells confirm counts."""
    own = columns.select(*by, "col", F.col("role").alias("_own"), "filled", "n_dates", "n_numbers", "n_texts", "n_formulas")
    taken = columns.where("role <> 'ignore'").select(*by, "role", F.lit(True).alias("_taken"))
    met = told.join(own, [*by, "col"], "left").join(taken, [*by, "role"], "left")
    against = (
        F.when(~F.coalesce(F.col("role").isin(*profile.LETTERS), F.lit(False)), "no such role").when(F.col("_own").isNull(), "no such column").when(F.col("_own") != "ignore", "the column has a role by its header")
        .when(F.col("_taken"), "the role has a column by its header").when(~confirmed(F.col("role")), "the cells do not confirm it")
    )
    met = met.withColumn("_no", against)
    before = lambda c: F.count_if(F.col("_no").isNull()).over(W.partitionBy(*by, c).orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    again = (before("role") > 0) | (before("col") > 0)
    return met.select(*by, "pos", "col", "role", F.coalesce("_no", F.when(again, "answered already"), F.lit(ACCEPTED)).alias("verdict"))


def refine(columns: DataFrame, by: list[str], port: Port | None, batch: int = BATCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """columns (by, col, header, role, and the counts of evidence) with the port's confirmed roles and said_by (headers, port or null); what was told,
    with verdicts; and failures (by, failure). Answers are written before they are used: nothing asks twice."""
    known = F.when(F.col("role") != "ignore", "headers")
    spark = columns.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.select(*by).schema.fields)
    if port is None:
        return columns.withColumn("said_by", known), spark.createDataFrame([], f"{kinds}, pos int, col string, role string, verdict string"), spark.createDataFrame([], f"{kinds}, failure string")
    asked = stored(asked_in_batches(questions(columns, by), port, "array<struct<col: string, role: string>>", batch).select(*by, "answer", "failure"))
    told = asked.select(*by, F.posexplode("answer").alias("pos", "x")).select(*by, "pos", "x.col", "x.role")
    told = stored(settle(columns, told, by))
    new = told.where(F.col("verdict") == ACCEPTED).select(*by, "col", F.col("role").alias("_told"))
    out = columns.join(new, [*by, "col"], "left")
    out = out.withColumns({"said_by": F.coalesce(known, F.when(F.col("_told").isNotNull(), "port")), "role": F.coalesce("_told", "role")}).drop("_told")
    return out, told, asked.where("failure is not null").select(*by, "failure")


def profiles(cells: DataFrame, headers: DataFrame, by: list[str], port: Port | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row a workbook: its layout, where it comes from (headers, port or usual) and warnings; what the port told, with verdicts; its failures.
    headers: by, col, header of each column."""
    columns = profile.columns_with_roles(headers, by).join(evidence(cells, by), [*by, "col"], "left")
    columns = columns.fillna(0, ["filled", "n_dates", "n_numbers", "n_texts", "n_formulas"])
    # written once: questions, verdicts, layout and what is joined with them would each read all cells again
    refined, told, failures = refine(columns if port is None else stored(columns), by, port)
    found = profile.layout(refined.withColumn("has_formula", F.col("n_formulas") > 0), by)
    by_port = refined.groupBy(*by).agg(F.bool_or(F.coalesce(F.col("said_by") == "port", F.lit(False))).alias("_port"))
    failed = failures.groupBy(*by).agg(F.array_sort(F.collect_set("failure")).alias("_failed"))
    found = found.join(by_port, by).join(failed, by, "left")
    complete = F.size("missing") == 0
    source = F.when(~complete, "usual").when(F.col("_port"), "port").otherwise("headers")
    warnings = F.concat(F.coalesce("_failed", F.array().cast("array<string>")), F.when(complete, F.array().cast("array<string>")).otherwise(F.array(F.lit(USUAL))))
    return found.withColumns({"source": source, "warnings": warnings}).drop("_port", "_failed"), told, failures
