"""What is known of a workbook before anything is written to it, as one nested row: sheets, header, columns, lists, formulas, order of dates.

Each workbook has its own header row and its own letters for the roles. Both are joined to the cells once, and the operators of inference and
profile take them as columns, so that any number of workbooks is one plan: every part groups by workbook (or workbook and sheet) and comes together
in a join by workbook.

Defined results: a workbook without a header row has its sheets and categories and a warning, and no columns; one without month sheets is judged by
its sample sheet alone; a sheet without cells is named, if `sheets` names it. Rows and samples are those of whole sheets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.steps import stored
from ..sources import workbook
from . import categories, inference, ordering, profile

NO_HEADER, NO_DATES, NO_ROWS = "no header row was found", "no column of dates was found: the order of the sheets is unknown", "the sample sheet has no filled row"
#: What tells a workbook's sheets apart where an operator groups by sheet alone.
_KEY = "_key"
#: First texts of the sample sheet that stand in for those of a month's.
SAMPLES = 8
#: Places of sheets without a month come after those of all months.
_LATER = 1 << 20


def inspect(cells: DataFrame, validations: DataFrame | None = None, sheets: DataFrame | None = None) -> DataFrame:
    """path, sheet_names, month_sheets, support_sheets, sample_sheet, header_row, first_data_row, columns (col, header, role, column_kind), categories,
    description_samples, filled_rows, list_columns (col, options, source, source_ref), formula_columns (col, model, model_row, formula_kind, n, column_wide),
    date_order, dates_compared, date_orders (sheet, order), warnings.

    cells: of sources.workbook. validations: path, sheet, sheet_no, sqref, formula. sheets: path, sheet, sheet_no; those that have cells if not given.
    The cells, each workbook's start and letters and each part are written and read again: one plan of all would take longer to build than to run."""
    cells = cells.select("path", "sheet", "sheet_no", "row", "col", "kind", "value", "style", "formula").withColumn(_KEY, F.concat_ws("\0", "path", "sheet_no"))
    cells = stored(cells)
    named = (cells if sheets is None else sheets).select("path", "sheet", "sheet_no").distinct()
    named = stored(named.withColumns({"_month": _is_month(F.col("sheet")), "_support": dates.is_support_sheet(F.col("sheet"))}))
    in_order = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("sheet_no", "sheet")))), lambda x: x["sheet"])
    found = named.groupBy("path").agg(in_order(F.lit(True)).alias("sheet_names"), in_order(F.col("_month")).alias("month_sheets"), in_order(F.col("_support")).alias("support_sheets"))

    start = stored(_start(cells, named))
    found = found.join(start.select("path", F.col("sheet").alias("sample_sheet"), "header_row", "_first"), "path", "left").withColumnRenamed("_first", "first_data_row")

    # the sample's columns, and the letters of the roles
    sample = cells.join(start.select("path", "sheet_no", "header_row", "_first"), ["path", "sheet_no"])
    headers = sample.where("row = header_row AND trim(coalesce(value, '')) <> ''").select("path", "col", F.trim("value").alias("header"))
    below = sample.where("row >= _first")
    kinds = inference.column_kinds(below.withColumn("sheet", F.col("path")), workbook.is_date_style(F.col("style")), workbook.is_money_style(F.col("style")))
    columns = profile.columns_with_roles(headers, ["path"]).join(kinds.select(F.col("sheet").alias("path"), "col", "column_kind"), ["path", "col"], "left")
    columns = stored(columns.withColumn("column_kind", F.coalesce("column_kind", F.lit("empty"))))
    letters = stored(profile.layout(columns.withColumn("has_formula", F.col("column_kind") == "formula"), ["path"]))
    has_date = columns.groupBy("path").agg(F.bool_or(F.col("role") == "date").alias("_dated"))
    number = text.column_number(F.col("col"))
    told = columns.groupBy("path").agg(_listed(number, "col", "header", "role", "column_kind").alias("columns"))
    filled = below.where("kind IN ('text', 'number')").groupBy("path").agg(F.count_distinct("row").alias("filled_rows"))

    # sheets of data: those of months, or else the sample
    has_months = named.groupBy("path").agg(F.bool_or("_month").alias("_any"))
    data = named.join(has_months, "path").join(start.select("path", F.col("sheet_no").alias("_sample"), "_first"), "path").where("CASE WHEN _any THEN _month ELSE sheet_no = _sample END").select("path", "sheet_no", "_first")
    own = stored(cells.join(data, ["path", "sheet_no"]).join(letters.select("path", "writable", *[f"{r}_col" for r in profile.LETTERS]), "path"))

    formulas = stored(_formulas(own))
    lists = stored(_lists(cells, own, validations, stored(headers), letters, start, formulas))
    # a column that a workbook hasn't got has no dates: the usual letter doesn't stand in for it
    per_sheet, whole = _orders(own.join(has_date.where("_dated").select("path"), "path", "left_semi"))
    samples = stored(_samples(own, below.join(letters.select("path", "description_col"), "path")))
    options = categories.sheet_categories(cells, ["path"]).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "option"))), lambda x: x["option"]).alias("categories"))

    for part in (told, filled, has_date, options, samples, formulas.groupBy("path").agg(_listed(number, "col", "model", "model_row", "formula_kind", "n", "column_wide").alias("formula_columns")), lists, per_sheet, whole):
        found = found.join(part, "path", "left")
    warnings = F.array(F.when(F.col("header_row").isNull(), NO_HEADER), F.when(F.col("header_row").isNotNull() & ~F.coalesce("_dated", F.lit(False)), NO_DATES), F.when(F.col("header_row").isNotNull() & (F.coalesce("filled_rows", F.lit(0)) == 0), NO_ROWS))
    empty = {c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("columns", "categories", "description_samples", "list_columns", "formula_columns", "date_orders")}
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("filled_rows", "dates_compared")}
    return found.withColumns(empty | zero | {"date_order": F.coalesce("date_order", F.lit("undefined")), "warnings": F.filter(warnings, lambda x: x.isNotNull())}).drop("_dated")


def _is_month(sheet: Column) -> Column:
    """Whether a sheet is named after a month, accents and case aside."""
    months = F.transform(F.array(*[F.lit(m) for m in dates.MONTHS]), text.comparison_key)
    return F.coalesce(F.array_contains(months, text.comparison_key(sheet.cast("string"))), F.lit(False))


def _listed(order: Column, *fields: str) -> Column:
    """Rows of a group as an array of these fields, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.struct(*fields).alias("x"))))
    return F.transform(rows, lambda r: r["x"])


def _start(cells: DataFrame, named: DataFrame) -> DataFrame:
    """path, sheet, sheet_no, header_row, _first: the sheet with the most filled rows below a header; months come before others on a tie."""
    own = cells.join(named.where("NOT _support").select("path", "sheet_no", "_month"), ["path", "sheet_no"])
    rows = inference.header_rows(own.withColumn("sheet", F.col(_KEY)), profile.role_of(F.col("value"))).select(F.col("sheet").alias(_KEY), "row")
    at = own.select("path", "sheet_no", "sheet", "_month", _KEY).distinct().join(rows, _KEY)
    # a sheet's name needn't be its own in a workbook, its place is
    ranked = at.select("path", F.col(_KEY).alias("sheet"), (F.col("sheet_no") + F.when(F.col("_month"), 0).otherwise(_LATER)).alias("sheet_no"), "row")
    best = profile.sample_sheets(own.withColumn("sheet", F.col(_KEY)), ranked, ["path"]).select(F.col("sheet").alias(_KEY))
    return at.join(best, _KEY).select("path", "sheet", "sheet_no", F.col("row").alias("header_row"), (F.col("row") + 1).alias("_first"))


def _formulas(own: DataFrame) -> DataFrame:
    """path, col and the rule of each calculated column that is not written to, over the sheets of data."""
    rows = own.where("NOT array_contains(writable, col)").withColumn("sheet", F.col(_KEY))
    found = inference.formula_columns(rows, F.col("_first")).join(rows.select(F.col(_KEY).alias("sheet"), "path", "sheet_no").distinct(), "sheet")
    return inference.merge_formula_rules(found.drop("sheet"), by=("path",))


def _lists(cells: DataFrame, own: DataFrame, validations: DataFrame | None, headers: DataFrame, letters: DataFrame, start: DataFrame, formulas: DataFrame) -> DataFrame:
    """path, list_columns. The operator looks for uses in sheets of data only, and for ranges in all."""
    usual = cells.sparkSession.createDataFrame([], workbook.VALIDATIONS)
    rules = (usual if validations is None else validations).join(start.select("path", "_first"), "path")
    rules = rules.join(own.select("path", "sheet_no").distinct(), ["path", "sheet_no"], "left_semi")
    roles = {r: F.col(f"{r}_col") for r in profile.LETTERS}
    rest = cells.join(own.select("path", "sheet_no").distinct(), ["path", "sheet_no"], "left_anti")
    # cells of other sheets only serve ranges: no first row lets one of them be a use
    both = own.drop("writable").unionByName(rest, allowMissingColumns=True)
    found = profile.list_columns(both, rules, headers, ["path"], F.col("_first"), roles, formulas)
    return found.groupBy("path").agg(_listed(text.column_number(F.col("col")), "col", "options", "source", "source_ref").alias("list_columns"))


def _orders(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The order of dates of each sheet of data as an array, and of all of a workbook's sheets together."""
    rows = own.where("col = date_col AND row >= _first")
    day = F.when(F.col("kind") == "text", dates.parse_loose(F.col("value"))["date"]).when(F.col("kind") == "number", dates.from_serial(F.floor(F.col("value").try_cast("double"))))
    counts = ordering.pair_counts(rows.select(F.col(_KEY).alias("group"), F.col("row").alias("idx"), day.alias("date")))
    of = rows.select("path", "sheet_no", "sheet", F.col(_KEY).alias("group")).distinct()
    counts = stored(counts.join(of, "group"))
    per_sheet = ordering.evidence(counts).groupBy("path").agg(_listed(F.col("sheet_no"), "sheet", "order").alias("date_orders"))
    sums = counts.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("sampled", "ascending", "descending", "ties")])
    whole = ordering.evidence(sums).select("path", F.col("order").alias("date_order"), F.col("compared").alias("dates_compared"))
    return per_sheet, whole


def _samples(own: DataFrame, sample: DataFrame) -> DataFrame:
    """path, description_samples: of the last month that has any, else of the sample sheet."""
    latest = profile.latest_samples(own, ["path"], F.col("description_col"), F.col("_first"))
    texts = sample.where("col = description_col AND kind = 'text' AND trim(value) <> ''")
    first = texts.groupBy("path").agg(F.slice(_listed(F.col("row"), "value"), 1, SAMPLES).alias("_own"))
    met = first.join(latest, "path", "full")
    return met.select("path", F.coalesce("samples", F.transform("_own", lambda x: F.trim(x["value"]))).alias("description_samples"))
