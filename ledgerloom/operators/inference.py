"""What a sheet's cells tell about its columns: frequent values, lists, kinds, headers, widths, styles, formulas.

cells: sheet, row, col (letters), kind (text, number, formula, empty), value, style, formula.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def most_frequent(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equal counts the one seen first. Counts are summed map-side before any ranking."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = n.groupBy(*by).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("_first"))).alias("b"))
    return best.select(*by, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


#: A list has so many values at least, so few different ones, and so large a share of repeated ones.
LEAST_VALUES, MOST_DISTINCT, REPEATED = 8, 60, 0.6


def list_columns(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Groups whose values look like a list to choose from, with the options, the most frequent first."""
    # counts of keys first: values without a key count as values only
    keyed = rows.where(F.col(value).isNotNull()).withColumn("_k", text.option_key(F.col(value)))
    per_key = keyed.groupBy(*by, "_k").agg(F.count("*").alias("n"), F.min_by(value, order).alias("option"), F.min(order).alias("_first"))
    real = F.col("_k") != ""
    sums = per_key.groupBy(*by).agg(
        F.sum("n").alias("n_values"), F.count_if(real).alias("n_distinct"), F.coalesce(F.sum(F.when(real & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("n_repeated")
    )
    lists = sums.where(
        (F.col("n_values") >= LEAST_VALUES) & F.col("n_distinct").between(1, MOST_DISTINCT) & (F.col("n_distinct") * 3 <= F.col("n_values")) & (F.col("n_repeated") >= F.col("n_values") * REPEATED)
    )
    # at most MOST_DISTINCT options are left for each group
    kept = per_key.where(real).join(lists, by, "left_semi").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "_first", "option"))), lambda o: o["option"]).alias("options"))
    return lists.join(kept, by)


def option_usage(rows: DataFrame, option: str = "option", context: str = "context", order: str = "pos") -> DataFrame:
    """How often each option is used for money in and out, and its first three contexts."""
    nth = F.row_number().over(W.partitionBy(option).orderBy(order))
    first = rows.withColumn("_n", nth).where("_n <= 3").groupBy(option).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", context))), lambda c: c[context]).alias("contexts"))
    n = rows.groupBy(option).agg(F.count_if(F.col("flow") == "in").alias("n_in"), F.count_if(F.col("flow") == "out").alias("n_out"))
    return n.join(first, option)


def column_kinds(cells: DataFrame, date_style: Column, money_style: Column) -> DataFrame:
    """Kind of each column of a sheet by its cells: formula, date, money, number, text or empty."""
    n = cells.groupBy("sheet", "col").agg(
        F.count_if(F.col("kind") == "formula").alias("f"), F.count_if((F.col("kind") == "number") & date_style).alias("d"), F.count_if((F.col("kind") == "number") & money_style).alias("m"),
        F.count_if(F.col("kind") == "number").alias("n"), F.count_if(F.col("kind") == "text").alias("t"),
    )
    total = F.col("f") + F.col("n") + F.col("t")
    kind = (
        F.when(total == 0, "empty").when(F.col("f") * 2 >= total, "formula").when(F.col("d") * 2 >= total, "date").when(F.col("m") * 2 >= total, "money")
        .when(F.col("n") >= F.col("t"), "number").otherwise("text")
    )
    return n.withColumn("column_kind", kind)


def header_rows(cells: DataFrame, role: Column, within: int = 40) -> DataFrame:
    """The row of each sheet with the most distinct roles, of the first `within`; three filled cells and roles at least; the earlier on a tie."""
    n = cells.where((F.col("row") <= within) & (F.col("kind") != "empty")).withColumn("_r", role)
    n = n.groupBy("sheet", "row").agg(F.count("*").alias("filled"), F.count_distinct("_r").alias("roles")).where("filled >= 3 and roles >= 3")
    return n.groupBy("sheet").agg(F.min_by("row", F.struct(-F.col("roles"), F.col("row"))).alias("row"), F.max("roles").alias("roles"))


def column_widths(cells: DataFrame) -> DataFrame:
    return cells.where("value is not null").groupBy("sheet", "col").agg(F.max(text.text_width(F.col("value"))).alias("width"))


def description_style(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Letter case (3 to 1), separator in half of the texts or more, mean length."""
    c = F.col(value)
    n = rows.where(c.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.regexp_count(c, F.lit("[A-ZÁÂÃÀÉÊÍÓÔÕÚÇ]"))).alias("_u"), F.sum(F.regexp_count(c, F.lit("[a-záâãàéêíóôõúç]"))).alias("_l"),
        F.sum(F.length(c)).alias("n_chars"), *[F.count_if(F.contains(c, F.lit(s))).alias(f"_s{i}") for i, s in enumerate(("|", " - ", "/", "•"))],
    )
    case = F.when(F.col("_u") > F.col("_l") * 3, "upper").when(F.col("_l") > F.col("_u") * 3, "lower").otherwise("mixed")
    sep = F.coalesce(*[F.when(F.col(f"_s{i}") * 2 >= F.col("n"), F.lit(s)) for i, s in enumerate(("|", " - ", "/", "•"))])
    return n.select(*by, "n", case.alias("letter_case"), sep.alias("separator"), "n_chars")


# --- formulas: string literals and absolute rows must survive, so a cell's formula goes through one small scanner ---

_REFERENCE = re.compile(r'"(?:[^"]|"")*"?|(?<![A-Za-z0-9_.])(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?!\d)(?!\()')


def shift_formula(formula: str, by: int) -> str | None:
    """References moved down by so many rows, but absolute ones; null if one would leave the sheet."""
    lost = False

    def move(m: re.Match) -> str:
        nonlocal lost
        if m[4] is None:
            return m[0]
        row = int(m[4]) if m[3] else int(m[4]) + by
        lost |= row < 1
        return f"{m[1]}{m[2]}{m[3]}{row}"

    out = formula if by == 0 else _REFERENCE.sub(move, formula)
    return None if lost else out


def least_offset(formula: Column, row: Column) -> Column:
    """How far above its own row a formula reaches by references that move, 0 or less: JVM patterns, string literals left out."""
    bare = F.regexp_replace(formula, r'"(?:[^"]|"")*"?', '""')
    at = F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_.])\$?[A-Za-z]{1,3}(\d+)(?!\d)(?!\()"), F.lit(1))
    return F.least(F.lit(0), F.coalesce(F.array_min(F.transform(at, lambda x: x.try_cast("int") - row)), F.lit(0)))


def translated(rows: DataFrame, formula: str, from_row: str, to_row: str, out: str = "translated") -> DataFrame:
    """rows with the formula moved from one row to another; batches of Arrow, no shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {out} string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f[out] = [None if t is None else shift_formula(t, int(b) - int(a)) for t, a, b in zip(f[formula], f[from_row], f[to_row])]
            yield f

    return rows.mapInPandas(run, schema)


def formula_columns(cells: DataFrame, first_row: int, writable: tuple[str, ...] = ()) -> DataFrame:
    """Calculated columns of each sheet: occurrences, model (of the greatest row that generalises), kind, style, whether it is column-wide."""
    rows = cells.where((F.col("row") >= first_row) & (F.col("kind") == "formula") & ~F.col("col").isin(*writable, ""))
    found = rows.withColumn("_o", least_offset(F.col("formula"), F.col("row")))
    n = found.groupBy("sheet", "col").agg(
        F.count("*").alias("n"), F.max_by(F.when(F.col("_o") >= -1, F.struct("formula", "row")), F.when(F.col("_o") >= -1, F.col("row"))).alias("model"),
        F.max_by("formula", F.when(F.col("row") == first_row, 1)).alias("first_row_formula"),
    )
    data_rows = cells.where(F.col("row") >= first_row).groupBy("sheet").agg(F.count_distinct("row").alias("n_rows"))
    styles = most_frequent(rows, ["sheet", "col"], "style", "row").select("sheet", "col", "style")
    own_above = F.regexp_like("model.formula", F.concat(F.lit(r"(^|[^A-Za-z0-9_$])\$?"), F.col("col"), F.lit(r"\$?"), (F.col("model.row") - 1).cast("string"), F.lit(r"(?!\d)")))
    kind = F.when(own_above, "accumulated").when(F.col("model.formula").rlike(r"[A-Z]{1,3}\d+"), "row").otherwise("other")
    out = n.join(data_rows, "sheet").join(styles, ["sheet", "col"], "left").where("model is not null or first_row_formula is not null")
    return out.select("sheet", "col", "n", F.col("model.formula").alias("model"), F.col("model.row").alias("model_row"), kind.alias("formula_kind"), "style", (F.col("n") >= F.least("n_rows", F.lit(3))).alias("column_wide"))


def repeat_formula(rules: DataFrame) -> DataFrame:
    """Whether a column's formula is repeated: accumulated, or column-wide with three or more; two or fewer don't; else undecided (null)."""
    return rules.withColumn("repeats", F.when(F.col("formula_kind") == "accumulated", True).when(F.col("column_wide") & (F.col("n") >= 3), True).when(F.col("n") <= 2, False))


def merge_formula_rules(rules: DataFrame, order: str = "sheet_no", by: tuple[str, ...] = ()) -> DataFrame:
    """One rule a column over all sheets (of each workbook, if by names it): most occurrences, the first sheet on a tie."""
    best = F.min_by(F.struct(*[c for c in rules.columns if c not in ("col", *by)]), F.struct(-F.col("n"), F.col(order)))
    return rules.groupBy(*by, "col").agg(best.alias("b")).select(*by, "col", "b.*")
