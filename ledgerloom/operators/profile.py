"""What a workbook's sheets practise: roles of columns, order of dates, formulas, styles, lists to choose from, and the layout to write by.

cells: sheet, sheet_no, row, col (letters), kind, value, style, formula, and the columns of `by` that name the workbook.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, text
from . import inference, ordering

# The header words of each role, in order; a header is a word, or else has one in it.
ROLE_WORDS = (
    ("date", ("DATA", "DT", "DIA", "DATA LANCAMENTO", "DATA DO LANCAMENTO")),
    ("description", ("DESCRICAO", "HISTORICO", "LANCAMENTO", "DETALHE", "DISCRIMINACAO", "MEMO")),
    ("category", ("CATEGORIA", "CLASSIFICACAO", "PLANO DE CONTAS", "CONTA")),
    ("flow", ("FLUXO DE CAIXA", "FLUXO", "GRUPO", "TIPO DE FLUXO")),
    ("in", ("ENTRADA", "ENTRADAS", "CREDITO", "RECEITA", "RECEBIMENTO")),
    ("out", ("SAIDA", "SAIDAS", "DEBITO", "DESPESA", "PAGAMENTO")),
    ("balance", ("SALDO", "SALDO ACUMULADO", "SALDO CORRENTE")),
)
# The letters of a sheet whose headers say nothing, and first words of a list that are its header.
LETTERS = {"date": "B", "description": "C", "category": "D", "flow": "E", "in": "F", "out": "G", "balance": "H"}
LIST_HEADERS = ("CATEGORIA", "CATEGORIAS", "OPCAO", "OPCOES", "ITEM", "ITENS", "TIPO", "TIPOS", "LISTA")
#: Roles without which a sheet can't be written to; those that are written, those that never are.
NEEDED, WRITTEN, KEPT = ("date", "description", "in", "out"), ("date", "description", "category", "in", "out"), ("flow", "balance")
#: Most options of a list, most filled rows that are counted, most examples before and after equal ones fall together.
MOST_OPTIONS, MOST_ROWS, MOST_SEEN, MOST_EXAMPLES = 400, 201, 60, 30


def role_of(header: Column) -> Column:
    """The role that a header names: as a whole, else in part; null if none."""
    key = text.comparison_key(F.coalesce(header, F.lit("")))
    whole = [F.when(key.isin(*words), F.lit(role)) for role, words in ROLE_WORDS]
    part = [F.when(key.rlike("|".join(words)), F.lit(role)) for role, words in ROLE_WORDS]
    return F.coalesce(*whole, *part)


def columns_with_roles(headers: DataFrame, by: list[str]) -> DataFrame:
    """headers: by, col, header. role: each role goes to the first column that claims it, 'ignore' to the others."""
    number = text.column_number(F.col("col"))
    claimed = headers.withColumns({"_role": role_of(F.col("header")), "_no": number})
    nth = F.row_number().over(W.partitionBy(*by, "_role").orderBy("_no"))
    return claimed.withColumn("role", F.when(F.col("_role").isNotNull() & (nth == 1), F.col("_role")).otherwise("ignore")).drop("_role", "_no")


def layout(columns: DataFrame, by: list[str]) -> DataFrame:
    """by, the letter of each role (usual ones where a role is missing), forbidden and writable letters, and missing: needed roles without a
    column. columns: by, col, role, has_formula. A column with formulas is never written to, nor is A."""
    letter = {r: F.max(F.when(F.col("role") == r, F.col("col"))) for r in LETTERS}
    found = columns.groupBy(*by).agg(
        *[F.coalesce(letter[r], F.lit(usual)).alias(f"{r}_col") for r, usual in LETTERS.items()],
        F.collect_set(F.when(F.coalesce("has_formula", F.lit(False)) | F.col("role").isin(*KEPT), F.col("col"))).alias("_f"),
        F.filter(F.array(*[F.when(F.max(F.col("role") == r), None).otherwise(F.lit(r)) for r in NEEDED]), lambda x: x.isNotNull()).alias("missing"),
    )
    forbidden = F.array_sort(F.array_union("_f", F.array(F.lit("A"), *[F.col(f"{r}_col") for r in KEPT])))
    writable = F.filter(F.array(*[F.col(f"{r}_col") for r in WRITTEN]), lambda c: ~F.array_contains("forbidden", c))
    return found.withColumn("forbidden", forbidden).withColumn("writable", writable).drop("_f")


def sample_sheets(cells: DataFrame, headers: DataFrame, by: list[str]) -> DataFrame:
    """by, sheet, n_rows: of the sheets with a header row (headers: by, sheet, sheet_no, row) the one with the most rows written below it,
    counted up to a limit; the first on a tie."""
    below = cells.join(headers.select(*by, "sheet", F.col("row").alias("_header")), [*by, "sheet"]).where("row > _header AND kind IN ('text', 'number')")
    n = below.groupBy(*by, "sheet").agg(F.least(F.count_distinct("row"), F.lit(MOST_ROWS)).alias("n_rows"))
    ranked = headers.join(n, [*by, "sheet"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    best = ranked.groupBy(*by).agg(F.min_by(F.struct("sheet", "n_rows"), F.struct(-F.col("n_rows"), F.col("sheet_no"))).alias("b"))
    return best.select(*by, "b.sheet", "b.n_rows")


def sheet_orders(existing: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """group, order, said_by: the order of dates that a sheet practises itself, else what its profile said (profiled: group, order), else
    the order of all sheets together, else undefined. existing: group, idx, date."""
    counts = ordering.pair_counts(existing)
    own = ordering.evidence(counts).select("group", F.col("order").alias("_own"))
    whole = ordering.combine(counts).select(F.col("order").alias("_whole"))
    rows = existing.select("group").distinct().join(own, "group", "left")
    rows = rows.join(profiled.select("group", F.col("order").alias("_said")), "group", "left") if profiled is not None else rows.withColumn("_said", F.lit(None).cast("string"))
    rows = rows.join(F.broadcast(whole))  # one row
    sure = lambda c: F.nullif(F.col(c), F.lit("undefined"))
    said_by = F.when(sure("_own").isNotNull(), "sheet").when(sure("_said").isNotNull(), "profile").when(sure("_whole").isNotNull(), "workbook")
    return rows.select("group", F.coalesce(sure("_own"), sure("_said"), sure("_whole"), F.lit("undefined")).alias("order"), said_by.alias("said_by"))


def formula_rules(own: DataFrame, profiled: DataFrame, sheets: DataFrame) -> DataFrame:
    """sheet, col, model, model_row, first_row_formula, header, said_by: for each approved column (profiled: col, ...) the formula that the sheet practises
    itself (own: sheet, col, ...), else the profile's. A stray formula of a column that the profile doesn't have is no rule; without a profile all are."""
    fields = ["model", "model_row", "first_row_formula", "header"]
    mine = own.select("sheet", "col", *[F.col(c).alias(f"_own_{c}") for c in fields], F.lit(True).alias("_has"))
    if profiled.isEmpty():
        return mine.select("sheet", "col", *[F.col(f"_own_{c}").alias(c) for c in fields], F.lit("sheet").alias("said_by"))
    every = sheets.select("sheet").distinct().join(F.broadcast(profiled.select("col", *fields)))  # a handful of columns
    met = every.join(mine, ["sheet", "col"], "left")
    has = F.coalesce("_has", F.lit(False))
    pick = {"model": F.when(has, F.col("_own_model")).otherwise(F.col("model")), "model_row": F.when(has, F.col("_own_model_row")).otherwise(F.col("model_row"))}
    pick |= {c: F.coalesce(F.nullif(f"_own_{c}", F.lit("")), F.col(c)) for c in ("first_row_formula", "header")}
    return met.withColumns(pick | {"said_by": F.when(has, "sheet").otherwise("profile")}).select("sheet", "col", *fields, "said_by")


def conventions(cells: DataFrame, by: list[str], first_row: int, letters: dict[str, str] = LETTERS) -> tuple[DataFrame, DataFrame]:
    """Styles: by, sheet, col, style of each written column: the most frequent of filled cells, the first met on a tie, else the first of empty
    ones. Dates: by, sheet, date_as_text: whether most dates are written as texts."""
    own = cells.where((F.col("row") >= first_row) & F.col("col").isin(*[letters[r] for r in WRITTEN])).withColumn("_filled", F.coalesce("value", F.lit("")) != "")
    n = own.where("style is not null").groupBy(*by, "sheet", "col", "_filled", "style").agg(F.count("*").alias("n"), F.min("row").alias("_first"))
    rank = F.struct(~F.col("_filled"), F.when(F.col("_filled"), -F.col("n")).otherwise(0), F.col("_first"))
    styles = n.groupBy(*by, "sheet", "col").agg(F.min_by("style", rank).alias("style"))
    dated = own.where((F.col("col") == letters["date"]) & F.col("_filled")).groupBy(*by, "sheet")
    return styles, dated.agg((F.count_if(F.col("kind") == "text") * 2 > F.count("*")).alias("date_as_text"))


def chain_gaps(cells: DataFrame, by: list[str], targets: DataFrame, accumulated: DataFrame, first_row: int) -> DataFrame:
    """by, sheet, row, col: the row above the first new one (targets: by, sheet, target) that has nothing in an accumulated column (accumulated: by, sheet,
    col): the balance would start anew below it. A row that isn't in the sheet at all is no gap."""
    above = targets.where(F.col("target") > first_row).select(*by, "sheet", (F.col("target") - 1).alias("row"))
    there = cells.join(above, [*by, "sheet", "row"])
    wanted = there.select(*by, "sheet", "row").distinct().join(accumulated.select(*by, "sheet", "col"), [*by, "sheet"])
    filled = there.where("kind <> 'empty'").select(*by, "sheet", "row", "col")
    return wanted.join(filled, [*by, "sheet", "row", "col"], "left_anti")


# --- lists to choose from ---


def ranges_of(rows: DataFrame, sqref: str = "sqref") -> DataFrame:
    """rows with col, first_row, last_row: one row for each column that a reference such as `D13:D254 $F$13` covers; what is none is left out."""
    part = F.explode(F.split(F.trim(F.upper(sqref)), r"\s+"))
    found = rows.withColumn("_p", part).where(F.col("_p").rlike(r"^\$?[A-Z]{1,3}\$?\d+(:\$?[A-Z]{1,3}\$?\d+)?$"))
    get = lambda i: F.regexp_extract("_p", r"^\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?$", i)
    a, b = text.column_number(get(1)), text.column_number(F.coalesce(F.nullif(get(3), F.lit("")), get(1)))
    r, s = get(2).cast("int"), F.coalesce(F.nullif(get(4), F.lit("")), get(2)).cast("int")
    found = found.withColumns({"first_row": F.least(r, s), "last_row": F.greatest(r, s), "_c": F.explode(F.sequence(F.least(a, b), F.greatest(a, b)))})
    return found.withColumn("col", text.column_letters(F.col("_c"))).drop("_p", "_c")


def inline_options(formula: Column) -> Column:
    """The options of a list written in the formula itself (`"Yes,No"`, a doubled quote for one); null if it is a reference."""
    inner = F.regexp_extract(F.trim(formula), r'(?s)^"(.*)"$', 1)
    return F.when(F.trim(formula).rlike(r'(?s)^".*"$'), F.filter(F.split(F.replace(inner, F.lit('""'), F.lit('"')), ","), lambda x: x != ""))


def without_header(options: Column, header: Column) -> Column:
    """Options but a first one that only names the column."""
    key = text.option_key(F.get(options, F.lit(0)))
    named = key.isin(*LIST_HEADERS) | (key == text.option_key(header)) | (key == text.option_key(F.concat(header, F.lit("s"))))
    return F.when(F.coalesce(named, F.lit(False)), F.slice(options, 2, F.greatest(F.lit(1), F.size(options)))).otherwise(options)


def range_options(refs: DataFrame, cells: DataFrame, by: list[str], most: int = MOST_OPTIONS) -> DataFrame:
    """refs (by, sheet, ref) with options: the texts of a range of one column, in order, spelt as they are; the first `most` of them. References to
    several columns or to no sheet have none and are left out."""
    shape = r"^=?\s*(?:'([^']+)'|([A-Za-z0-9_À-ÿ .]+?))?!?\$?([A-Z]{1,3})\$?(\d+)?(?::\$?([A-Z]{1,3})\$?(\d+)?)?$"
    get = lambda i: F.regexp_extract(F.trim("ref"), shape, i)
    number = lambda i, other: F.coalesce(F.nullif(get(i), F.lit("")).cast("int"), F.lit(other))
    last = F.when(get(6) != "", get(6).cast("int")).when((get(5) == "") & (get(4) != ""), F.lit(2**31 - 1)).otherwise(F.lit(2**31 - 1))
    named = F.coalesce(F.nullif(F.trim(F.concat(get(1), get(2))), F.lit("")), F.col("sheet"))
    asked = refs.select(*by, "sheet", "ref").distinct().where(F.trim("ref").rlike(shape) & ((get(5) == "") | (get(5) == get(3))))
    asked = asked.select(*by, "sheet", "ref", named.alias("_sheet"), get(3).alias("col"), number(4, 1).alias("_a"), last.alias("_b"))
    said = cells.where("trim(coalesce(value, '')) <> ''").select(*by, F.trim("sheet").alias("_sheet"), "col", "row", "value")
    met = asked.join(said, [*by, "_sheet", "col"]).where("row between _a and _b")
    nth = F.row_number().over(W.partitionBy(*by, "sheet", "ref").orderBy("row"))
    kept = met.withColumn("_n", nth).where(F.col("_n") <= most)
    return kept.groupBy(*by, "sheet", "ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias("options"))


def list_columns(cells: DataFrame, validations: DataFrame, headers: DataFrame, by: list[str], first_row: int, letters: dict[str, str] = LETTERS, calculated: DataFrame | None = None) -> DataFrame:
    """by, col, options, source (inline, range or content), source_ref, examples (context, option, flow): the columns that are filled from a list.

    validations: by, sheet, sheet_no, sqref, formula (of sources.workbook.validations). The first sheet whose formal list gives options counts; a text
    column without one is a list if its content looks like it, but not the columns of known roles. Examples are uses of valid options: the first ones of a
    column, equal ones once.
    """
    data = cells.where((F.col("row") >= first_row) & (F.col("kind") == "text") & (F.trim("value") != ""))
    formal = ranges_of(validations).where(F.col("last_row") >= first_row).withColumn("_inline", inline_options(F.col("formula")))
    if calculated is not None:
        formal, data = (d.join(calculated.select(*by, "col"), [*by, "col"], "left_anti") for d in (formal, data))
    asked = formal.where("_inline is null").select(*by, "sheet", F.trim("formula").alias("ref"))
    named = headers.select(*by, "col", F.col("header").alias("_h"))
    read = range_options(asked, cells, by).withColumnsRenamed({"options": "_range", "ref": "_ref"})
    met = formal.withColumn("_ref", F.trim("formula")).join(read, [*by, "sheet", "_ref"], "left").join(named, [*by, "col"], "left")
    options = F.coalesce("_inline", without_header(F.col("_range"), F.coalesce("_h", F.lit(""))))
    source = F.when(F.col("_inline").isNotNull(), "inline").otherwise("range")
    met = met.withColumns({"_options": options, "_source": source}).where("size(_options) > 0")
    first = met.groupBy(*by, "col").agg(F.min_by(F.struct(F.col("_options").alias("options"), F.col("_source").alias("source"), F.when(F.col("_source") == "range", F.col("_ref")).alias("source_ref")), F.struct("sheet_no", "first_row")).alias("b"))
    known = first.select(*by, "col", "b.*")
    covered = formal.select(*by, "col").distinct()
    free = data.where(~F.col("col").isin(*[letters[r] for r in ("date", "description", "in", "out")])).unionByName(data.join(covered, [*by, "col"], "left_semi")).dropDuplicates([*by, "sheet", "row", "col"])
    free = free.join(known.select(*by, "col"), [*by, "col"], "left_anti").join(named.select(*by, "col"), [*by, "col"], "left_semi")
    placed = free.withColumn("_at", F.col("sheet_no").cast("long") * (1 << 32) + F.col("row"))
    content = inference.list_columns(placed, [*by, "col"], "value", "_at").select(*by, "col", "options", F.lit("content").alias("source"), F.lit(None).cast("string").alias("source_ref"))
    lists = known.unionByName(content)
    return lists.join(_examples(cells, data, lists, by, first_row, letters), [*by, "col"], "left")


def _examples(cells: DataFrame, data: DataFrame, lists: DataFrame, by: list[str], first_row: int, letters: dict[str, str]) -> DataFrame:
    filled = F.trim(F.coalesce("value", F.lit("")))
    at = lambda r: F.max(F.when(F.col("col") == letters[r], F.nullif(filled, F.lit(""))))
    rows = cells.where(F.col("row") >= first_row).groupBy(*by, "sheet", "row").agg(at("description").alias("context"), at("in").alias("_i"), at("out").alias("_o"))
    rows = rows.where("context is not null").select(*by, "sheet", "row", "context", F.when(F.col("_o").isNotNull(), "out").when(F.col("_i").isNotNull(), "in").alias("flow"))
    used = data.join(lists.select(*by, "col", F.transform("options", text.option_key).alias("_keys")), [*by, "col"]).join(rows, [*by, "sheet", "row"])
    column = W.partitionBy(*by, "col").orderBy("sheet_no", "row")
    seen = used.withColumn("_n", F.row_number().over(column)).where(F.col("_n") <= MOST_SEEN).where(F.array_contains("_keys", text.option_key(F.col("value"))))
    pair = [*by, "col", text.option_key(F.col("context")).alias("_a"), text.option_key(F.col("value")).alias("_b")]
    once = seen.groupBy(*pair).agg(F.min(F.struct("_n", "context", F.col("value").alias("option"), "flow")).alias("e"))
    some = once.groupBy(*by, "col").agg(F.slice(F.array_sort(F.collect_list("e")), 1, MOST_EXAMPLES).alias("_e"))
    return some.select(*by, "col", F.transform("_e", lambda e: F.struct(e["context"].alias("context"), e["option"].alias("option"), e["flow"].alias("flow"))).alias("examples"))


def latest_samples(cells: DataFrame, by: list[str], letter: str, first_row: int, most: int = 8) -> DataFrame:
    """by, samples: the first texts of a column in the last month's sheet that has any."""
    months = F.array(*[F.lit(m) for m in dates.MONTHS])
    rows = cells.where((F.col("col") == letter) & (F.col("row") >= first_row) & (F.col("kind") == "text") & (F.trim("value") != ""))
    rows = rows.where(F.array_contains(F.transform(months, text.comparison_key), text.comparison_key(F.col("sheet"))))
    last = rows.groupBy(*by).agg(F.max("sheet_no").alias("sheet_no"))
    first = rows.join(last, [*by, "sheet_no"]).withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("row"))).where(F.col("_n") <= most)
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.trim("value").alias("v")))), lambda x: x["v"]).alias("samples"))
