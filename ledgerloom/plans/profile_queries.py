"""Queries of rule documents, categories, what workbooks practise, and the cascade; with those of queries.py, all of the library's."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.steps import own_folder, spread, stored
from ..operators import cascade, categories, inference, inspection, profile, refine, rules
from ..sources import rulebook, workbook, workbook_source
from .queries import _EVIDENCE, _HOUSE, _LAGGED, _OPTION, _PAIRS, _RULES, _SAYS, ORACLES, QUERIES, _cells, _dated, _query, _spoken
from .tables import ORDERS, read

__all__ = ["ORACLES", "QUERIES"]


def _values(rows) -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


# --- categories ---

_DEFAULT = _values((*c, i) for i, c in enumerate(categories.DEFAULT))


@_query(f"""WITH c(option, flow_class, pos) AS (VALUES {_DEFAULT}),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 41 >= 37 THEN 'none' WHEN p_partkey % 2 = 0 THEN upper(option) ELSE option END AS category FROM part LEFT JOIN c ON pos = p_partkey % 41)
SELECT p_partkey, category, coalesce(flow_class, '') AS flow_class FROM p LEFT JOIN c ON upper(c.option) = upper(category)""")
def flow_class(spark, d: str) -> DataFrame:
    """Parts under the default categories, in either case, and some under none."""
    known = categories.default_categories(spark)
    rows = read(spark, d, "part").withColumn("pos", (F.col("p_partkey") % 41).cast("int")).join(known.select("pos", "option"), "pos", "left")
    rows = rows.select("p_partkey", F.coalesce(F.when(F.col("p_partkey") % 2 == 0, F.upper("option")).otherwise(F.col("option")), F.lit("none")).alias("category"))
    return categories.with_flow_class(rows, known).select("p_partkey", "category", "flow_class")


@_query("""WITH f AS (SELECT p_brand AS path, p_type AS option, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT path, option, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS pos FROM f""")
def sheet_categories(spark, d: str) -> DataFrame:
    """Each brand's types as the sheet of categories of its workbook, under a header and with blanks between."""
    said = read(spark, d, "part").select(F.col("p_brand").alias("path"), (F.col("p_partkey") + 1).cast("int").alias("row"), F.col("p_type").alias("value"))
    head = said.select("path").distinct().select("path", F.lit(1).alias("row"), F.lit("Categoria").alias("value"))
    blank = said.select("path", (F.col("row") + 10_000_000).alias("row"), F.lit(" ").alias("value"))
    cells = said.unionByName(head).unionByName(blank).select("path", F.lit(" categorías").alias("sheet"), "row", F.lit("A").alias("col"), "value")
    return categories.sheet_categories(cells, ["path"])


def _categorised(spark, d: str) -> DataFrame:
    """The orders' sheets with a category on every row whose number is not divisible by 3."""
    cells = _cells(spark, d)
    own = F.struct("col", "value")
    named = F.when((F.col("col") == "C") & (F.col("row") % 3 != 0), F.array(own, F.struct(F.lit("D").alias("col"), F.concat(F.lit("Cat "), "value").alias("value"))))
    return cells.select(*[c for c in cells.columns if c not in ("col", "value")], F.inline(F.coalesce(named, F.array(own))))


_SHEET_ROWS = f"SELECT account_id AS sheet, CAST(12 + row_number() OVER (PARTITION BY account_id ORDER BY source_order) AS INT) AS pos, * FROM ({ORDERS})"


@_query(f"SELECT sheet, pos, description, 'Cat ' || description AS category, CASE WHEN direction = 'debit' THEN 'out' ELSE 'in' END AS flow FROM ({_SHEET_ROWS}) WHERE pos % 3 <> 0 AND amount_cents > 0")
def category_history(spark, d: str) -> DataFrame:
    return categories.category_history(_categorised(spark, d), [], 13, "C", "D", "F", "G")


@_query(f"""SELECT p_partkey AS rule_id FROM part WHERE p_size % 2 = 0 AND {_OPTION.format('p_type')} NOT IN (SELECT {_OPTION.format('p_type')} FROM part WHERE length(p_type) % 2 = 0)""")
def rules_without_category(spark, d: str) -> DataFrame:
    p = read(spark, d, "part")
    ruled = p.select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") % 2 == 0).alias("active"), F.lower("p_type").alias("category_key"))
    return categories.rules_without_category(ruled, p.where("length(p_type) % 2 = 0").select(F.col("p_type").alias("option"))).select("rule_id")


# --- the rules document ---


def _documents(spark, d: str) -> DataFrame:
    """A rules document for each nation: a set for each supplier with two good rules, one that repeats an identifier, one without a
    category and one that is no object; every tenth supplier's set lacks an identifier. Every ninth document is cut off."""
    s = read(spark, d, "supplier")
    rule = lambda id_, category: F.concat(F.lit('{"id": "'), F.lit(id_), F.lit('", "direcao": "'), F.when(F.col("s_suppkey") % 3 == 0, "entrada").when(F.col("s_suppkey") % 3 == 1, "saida").otherwise("x"), F.lit('", "quando": {"nome": "'), "s_name", F.lit('", "contem": ["A", 5]}, "categoriaChave": "'), F.lit(category), F.lit('", "prioridade": 2}'))
    body = F.concat(F.lit('{"id": '), F.when(F.col("s_suppkey") % 10 == 0, F.lit("7")).otherwise(F.concat(F.lit('"s'), "s_suppkey", F.lit('"'))), F.lit(', "impressoes": ["f'), F.col("s_suppkey") % 7, F.lit('"], "regras": ['), F.concat_ws(",", rule("a", "CAT"), rule("b", "CAT"), rule("a", "CAT"), rule("c", ""), F.lit("3")), F.lit("]}"))
    docs = s.groupBy(F.col("s_nationkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", body.alias("b")))).alias("x"), F.max("s_suppkey").alias("m"))
    whole = F.concat(F.lit('{"versao": 2, "ultimaCarteiraId": "s'), "m", F.lit('", "carteiras": ['), F.array_join(F.transform("x", lambda e: e["b"]), ","), F.lit("]}"))
    return docs.select("path", F.when(F.col("path").cast("int") % 9 == 8, F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("text"))


_SETS = "s AS (SELECT CAST(s_nationkey AS VARCHAR) AS path, s_suppkey, s_name, max(s_suppkey) OVER (PARTITION BY s_nationkey) AS m FROM supplier), good AS (SELECT * FROM s WHERE CAST(path AS INT) % 9 <> 8 AND s_suppkey % 10 <> 0)"


@_query(f"""WITH {_SETS} SELECT path, 's' || s_suppkey AS set_id, r AS rule_id, CASE WHEN s_suppkey % 3 = 0 THEN 'in' ELSE 'out' END AS direction, s_name AS name, 'CAT' AS category_key, 2 AS priority, 'A' AS terms FROM good, (SELECT unnest(['a', 'b']) AS r)""")
def rules_document(spark, d: str) -> DataFrame:
    found = rulebook.read(_documents(spark, d)).rules
    return found.select("path", "set_id", "rule_id", "direction", "name", "category_key", "priority", F.array_join("terms", ",").alias("terms"))


@_query(f"""WITH {_SETS}, w AS (SELECT path, 1 AS n FROM s GROUP BY path UNION ALL SELECT path, CASE WHEN s_suppkey % 3 = 2 THEN 7 ELSE 3 END FROM good UNION ALL SELECT path, 1 FROM s WHERE CAST(path AS INT) % 9 <> 8 AND s_suppkey % 10 = 0)
SELECT path, CAST(sum(n) AS BIGINT) AS n_warnings FROM w GROUP BY path""")
def rules_document_warnings(spark, d: str) -> DataFrame:
    return rulebook.read(_documents(spark, d)).warnings.groupBy("path").agg(F.count("*").alias("n_warnings"))


@_query(f"""WITH {_SETS} SELECT path, 's' || s_suppkey AS set_id, r AS rule_id, CASE WHEN s_suppkey % 3 = 0 THEN 'in' ELSE 'out' END AS direction, s_name AS name FROM good, (SELECT unnest(['a', 'b']) AS r)""")
def rules_document_written(spark, d: str) -> DataFrame:
    """The documents written again, and read from what was written."""
    again = rulebook.read(rulebook.documents(rulebook.read(_documents(spark, d))))
    return again.rules.select("path", "set_id", "rule_id", "direction", "name")


@_query(f"""WITH {_SETS}, a AS (SELECT DISTINCT path, 'f' || k AS fingerprint, m FROM s, (SELECT unnest(range(9)) AS k)),
k AS (SELECT path, 'f' || (s_suppkey % 7) AS fingerprint, arg_min('s' || s_suppkey, s_suppkey) AS known FROM good GROUP BY ALL)
SELECT path, fingerprint, coalesce(known, CASE WHEN m % 10 <> 0 AND CAST(path AS INT) % 9 <> 8 THEN 's' || m END) AS set_id,
 CASE WHEN known IS NOT NULL THEN 'fingerprint' WHEN m % 10 <> 0 AND CAST(path AS INT) % 9 <> 8 THEN 'last' ELSE 'new' END AS reason FROM a LEFT JOIN k USING (path, fingerprint)""")
def rule_set_choice(spark, d: str) -> DataFrame:
    docs = _documents(spark, d)
    asked = docs.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.concat(F.lit("f"), i))).alias("fingerprint"))
    return rulebook.chosen(rulebook.read(docs), asked).select("path", "fingerprint", "set_id", "reason")


@_query(f"""SELECT p_brand AS path, sha256(string_agg({_OPTION.format('p_type')}, '|' ORDER BY {_OPTION.format('p_type')}) || chr(10) || string_agg('C=' || {_OPTION.format('p_name')}, '|' ORDER BY {_OPTION.format('p_name')}) || chr(10)
 || coalesce(string_agg({_OPTION.format('p_name')}, '|' ORDER BY {_OPTION.format('p_name')}) FILTER (p_size > 25), '')) AS fingerprint FROM part GROUP BY 1""")
def workbook_fingerprint(spark, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("path", F.col("p_brand"))
    headers = p.select("path", F.lit("c").alias("col"), F.lower("p_name").alias("header"))
    return rulebook.fingerprints(p.select("path", F.col("p_type").alias("sheet")), headers, p.where("p_size > 25").select("path", F.col("p_name").alias("option")))


# --- what workbooks practise ---

_HEADERS = ("Data", "Histórico do mês", "Categoria", "Crédito (R$)", "Débito", "Saldo", "Data de novo", "Nada", "Fluxo de caixa", "Entrada")
_ROLE_SQL = "coalesce({}, {})".format(
    ", ".join(f"CASE WHEN h IN ({', '.join(repr(w) for w in words)}) THEN '{role}' END" for role, words in profile.ROLE_WORDS),
    ", ".join(f"CASE WHEN regexp_matches(h, '{'|'.join(words)}') THEN '{role}' END" for role, words in profile.ROLE_WORDS),
)
_COLUMNS = f"""c AS (SELECT p_brand AS path, chr(CAST(65 + p_partkey % 10 AS INT)) AS col, min(CASE (p_partkey + length(p_name)) % 10 {' '.join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADERS))} END) AS header FROM part GROUP BY ALL),
n AS (SELECT *, trim(regexp_replace(upper(strip_accents(header)), '\\s+', ' ', 'g')) AS h FROM c), q AS (SELECT *, {_ROLE_SQL} AS r FROM n),
roles AS (SELECT path, col, header, CASE WHEN r IS NOT NULL AND row_number() OVER (PARTITION BY path, r ORDER BY col) = 1 THEN r ELSE 'ignore' END AS role FROM q)"""


def _headed(spark, d: str) -> DataFrame:
    """Ten columns for each brand, headed by a wording that depends on its parts."""
    h = F.element_at(F.array(*[F.lit(x) for x in _HEADERS]), ((F.col("p_partkey") + F.length("p_name")) % 10 + 1).cast("int"))
    rows = read(spark, d, "part").select(F.col("p_brand").alias("path"), text.column_letters((F.col("p_partkey") % 10 + 1).cast("int")).alias("col"), h.alias("header"))
    return rows.groupBy("path", "col").agg(F.min("header").alias("header"))


@_query(f"WITH {_COLUMNS} SELECT * FROM roles")
def column_roles(spark, d: str) -> DataFrame:
    return profile.columns_with_roles(_headed(spark, d), ["path"])


def _letter(role: str) -> str:
    return f"coalesce(max(col) FILTER (role = '{role}'), '{profile.LETTERS[role]}')"


@_query(f"""WITH {_COLUMNS}, l AS (SELECT path, {", ".join(f"{_letter(r)} AS {r}_col" for r in profile.LETTERS)}, list(DISTINCT col) FILTER (role IN ('flow', 'balance') OR col = 'D') AS f,
 array_to_string(list_filter([{", ".join(f"CASE WHEN count(*) FILTER (role = '{r}') = 0 THEN '{r}' END" for r in profile.NEEDED)}], lambda x: x IS NOT NULL), ',') AS missing FROM roles GROUP BY path),
m AS (SELECT *, list_sort(list_distinct(list_concat(coalesce(f, []), ['A', flow_col, balance_col]))) AS forbidden FROM l)
SELECT * EXCLUDE (f, forbidden), array_to_string(forbidden, ',') AS forbidden, array_to_string(list_filter([{", ".join(f"{r}_col" for r in profile.WRITTEN)}], lambda c: NOT list_contains(forbidden, c)), ',') AS writable FROM m""")
def layout_of_profile(spark, d: str) -> DataFrame:
    columns = profile.columns_with_roles(_headed(spark, d), ["path"]).withColumn("has_formula", F.col("col") == "D")
    found = profile.layout(columns, ["path"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("forbidden", "writable", "missing")})


# --- profiles that a port refines ---


def _untold(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """The orders' sheets under headers that tell of categories only; every seventh customer's name dates and texts, too."""
    cells = _cells(spark, d)
    seen = stored(cells.select("sheet", "col").distinct())
    named = F.col("sheet") % 7 == 0
    header = F.when(named & (F.col("col") == "B"), "Data").when(named & (F.col("col") == "C"), "Histórico").otherwise("?")
    headers = seen.select("sheet", "col", header.alias("header"))
    return cells, headers.unionByName(seen.select("sheet", F.lit("D").alias("col"), F.lit("Categoria").alias("header")).distinct())


def _right_port(items: list[dict]) -> list[tuple[int, object]]:
    pairs = (("B", "date"), ("C", "description"), ("F", "in"), ("G", "out"), ("H", "balance"), ("Z", "flow"), ("C", "category"), ("H", "flow"), ("B", "when"))
    return [(x["index"], [{"col": c, "role": r} for c, r in pairs]) for x in items]


def _wrong_port(items: list[dict]) -> list[tuple[int, object]]:
    return [(x["index"], [{"col": c, "role": r} for c, r in (("B", "in"), ("C", "date"), ("F", "description"), ("H", "out"), ("D", "flow"))]) for x in items]


_SHEETS = f"s AS (SELECT account_id AS sheet, count(*) AS n, count(*) FILTER (direction = 'credit') AS f, account_id % 7 = 0 AS named FROM ({ORDERS}) GROUP BY 1)"
_NONE, _OWN, _HAS = "no such column", "the column has a role by its header", "the role has a column by its header"


@_query(f"""WITH {_SHEETS}, a AS (SELECT s.*, unnest([{{'pos': 0, 'col': 'B', 'role': 'date'}}, {{'pos': 1, 'col': 'C', 'role': 'description'}}, {{'pos': 2, 'col': 'F', 'role': 'in'}}, {{'pos': 3, 'col': 'G', 'role': 'out'}}, {{'pos': 4, 'col': 'H', 'role': 'balance'}},
  {{'pos': 5, 'col': 'Z', 'role': 'flow'}}, {{'pos': 6, 'col': 'C', 'role': 'category'}}, {{'pos': 7, 'col': 'H', 'role': 'flow'}}, {{'pos': 8, 'col': 'B', 'role': 'when'}}]) AS t FROM s)
SELECT sheet, t.pos AS pos, t.col AS col, t.role AS role, CASE WHEN t.role = 'when' THEN 'no such role' WHEN t.col = 'Z' OR (t.col = 'F' AND f = 0) OR (t.col = 'G' AND f = n) THEN '{_NONE}'
 WHEN named AND t.col IN ('B', 'C') THEN '{_OWN}' WHEN t.role = 'category' THEN '{_HAS}' WHEN t.col = 'H' AND t.role = 'flow' THEN 'the cells do not confirm it' ELSE '{refine.ACCEPTED}' END AS verdict FROM a""")
def port_verdicts(spark, d: str) -> DataFrame:
    """What becomes of each answer of a port that is right about most columns."""
    _, told, _ = refine.profiles(*_untold(spark, d), ["sheet"], _right_port)
    return told


@_query(f"""WITH {_SHEETS} SELECT sheet, CASE WHEN f > 0 AND f < n THEN 'port' ELSE 'usual' END AS source, 'B' AS date_col, 'C' AS description_col, 'F' AS in_col, 'G' AS out_col,
 CASE WHEN f = 0 THEN 'in' WHEN f = n THEN 'out' ELSE '' END AS missing, CASE WHEN f > 0 AND f < n THEN '' ELSE '{refine.USUAL}' END AS warnings FROM s""")
def profile_by_port(spark, d: str) -> DataFrame:
    """Profiles that headers and a port's answers give together."""
    found, _, _ = refine.profiles(*_untold(spark, d), ["sheet"], _right_port)
    return found.select("sheet", "source", "date_col", "description_col", "in_col", "out_col", F.array_join("missing", ",").alias("missing"), F.array_join("warnings", ",").alias("warnings"))


@_query(f"""WITH {_SHEETS}, a AS (SELECT s.*, unnest(['B', 'C', 'F', 'H', 'D']) AS col FROM s)
SELECT sheet, CASE WHEN col = 'F' AND f = 0 THEN '{_NONE}' WHEN col = 'D' OR (named AND col IN ('B', 'C')) THEN '{_OWN}' WHEN named AND col = 'F' THEN '{_HAS}' ELSE 'the cells do not confirm it' END AS verdict, count(*) AS n, 'usual' AS source FROM a GROUP BY ALL""")
def wrong_port_refused(spark, d: str) -> DataFrame:
    """A port that is wrong about every column changes no profile."""
    found, told, _ = refine.profiles(*_untold(spark, d), ["sheet"], _wrong_port)
    return told.groupBy("sheet", "verdict").agg(F.count("*").alias("n")).join(found.select("sheet", "source"), "sheet")


def _booked(spark, d: str, *more: str) -> DataFrame:
    """The orders' sheets in workbooks of ten customers each."""
    number = F.col("sheet").cast("int")
    return _cells(spark, d, *more).withColumns({"path": number % 10, "sheet_no": number})


@_query(f"""WITH n AS (SELECT account_id AS sheet, least(count(*), 201) AS n_rows FROM ({ORDERS}) GROUP BY 1)
SELECT sheet % 10 AS path, sheet, n_rows FROM n QUALIFY row_number() OVER (PARTITION BY sheet % 10 ORDER BY n_rows DESC, sheet) = 1""")
def sample_sheets(spark, d: str) -> DataFrame:
    cells = _booked(spark, d)
    headers = cells.select("path", "sheet", "sheet_no").distinct().withColumn("row", F.lit(12))
    return profile.sample_sheets(cells, headers, ["path"])


@_query(f"""WITH n AS (SELECT account_id AS g, count(*) AS filled_rows, count_if(direction = 'credit') AS credits FROM ({ORDERS}) GROUP BY 1),
 b AS (SELECT *, g % 10 AS book, count(*) OVER (PARTITION BY g % 10) AS n_sheets FROM n QUALIFY row_number() OVER (PARTITION BY g % 10 ORDER BY least(filled_rows, 201) DESC, g) = 1),
 c AS (SELECT "group" AS g, {_PAIRS} FROM ({_LAGGED}) GROUP BY 1), own AS (SELECT g, {_EVIDENCE} FROM c)
SELECT CAST(book AS VARCHAR) AS path, n_sheets, CAST(b.g AS VARCHAR) AS sample_sheet, 12 AS header_row, filled_rows, own."order" AS date_order,
 'B date date, C description text, F in ' || CASE WHEN credits > 0 THEN 'money' ELSE 'empty' END || ', G out ' || CASE WHEN credits < filled_rows THEN 'money' ELSE 'empty' END || ', H balance formula' AS columns,
 CASE WHEN filled_rows > 1 THEN 'H accumulated' ELSE 'H other' END AS formulas FROM b JOIN own USING (g)""")
def workbook_inspection(spark, d: str) -> DataFrame:
    """The orders' workbooks, with headers, inspected as one row each."""
    cells = _booked(spark, d).withColumns({"path": F.col("path").cast("string"), "sheet": F.col("sheet").cast("string")})
    heads = F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(h).alias("value")) for c, h in (("B", "Data"), ("C", "Descrição"), ("F", "Entrada"), ("G", "Saída"), ("H", "Saldo"))]))
    none = F.lit(None).cast("string")
    heads = cells.select("path", "sheet", "sheet_no").distinct().select("*", heads).select("*", F.lit(12).alias("row"), F.lit("text").alias("kind"), none.alias("style"), none.alias("formula"))
    found = inspection.inspect(cells.unionByName(heads))
    told = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[f] for f in fields])), ", ")
    return found.select(
        "path", F.size("sheet_names").cast("long").alias("n_sheets"), "sample_sheet", "header_row", "filled_rows", "date_order",
        told("columns", "col", "role", "column_kind").alias("columns"), told("formula_columns", "col", "formula_kind").alias("formulas"),
    )


_PROFILED = "CASE WHEN g % 5 = 0 THEN 'descending' WHEN g % 5 = 1 THEN 'undefined' END"


@_query(f"""WITH c AS (SELECT "group" AS g, {_PAIRS} FROM ({_LAGGED}) GROUP BY 1), own AS (SELECT g, {_EVIDENCE} FROM c), t AS (SELECT {_PAIRS} FROM ({_LAGGED})), whole AS (SELECT {_EVIDENCE} FROM t)
SELECT g AS "group", CASE WHEN own."order" <> 'undefined' THEN own."order" WHEN g % 5 = 0 THEN 'descending' ELSE (SELECT "order" FROM whole) END AS "order",
 CASE WHEN own."order" <> 'undefined' THEN 'sheet' WHEN g % 5 = 0 THEN 'profile' WHEN (SELECT "order" FROM whole) <> 'undefined' THEN 'workbook' END AS said_by FROM own""")
def sheet_order_precedence(spark, d: str) -> DataFrame:
    rows = _dated(spark, d)
    said = rows.select("group").distinct().select("group", F.when(F.col("group") % 5 == 0, "descending").when(F.col("group") % 5 == 1, "undefined").alias("order"))
    return profile.sheet_orders(rows, said)


@_query(f"""WITH n AS (SELECT account_id AS sheet, count(*) AS n FROM ({ORDERS}) GROUP BY 1), c AS (SELECT sheet, n, unnest(['H', 'I']) AS col FROM n)
SELECT sheet, col, CASE WHEN col = 'H' THEN CASE WHEN n > 1 THEN 'H' || (n + 11) || '+F' || (n + 12) || '-G' || (n + 12) END ELSE 'A1' END AS model, CASE WHEN col = 'H' THEN 'sheet' ELSE 'profile' END AS said_by, CASE WHEN col = 'H' THEN 'Saldo' ELSE 'Total' END AS header FROM c""")
def formula_precedence(spark, d: str) -> DataFrame:
    own = stored(inference.formula_columns(_cells(spark, d), 13, ("B", "C", "F", "G"))).withColumns({"first_row_formula": F.lit(None).cast("string"), "header": F.lit("")})
    stray = own.withColumn("col", F.lit("Z"))
    said = spark.createDataFrame([("H", "H1", 2, "G7", "Saldo"), ("I", "A1", 3, None, "Total")], "col string, model string, model_row int, first_row_formula string, header string")
    return profile.formula_rules(own.unionByName(stray), said, own).select("sheet", "col", "model", "said_by", "header")


_STYLED = f"""r AS (SELECT account_id % 10 AS path, account_id AS sheet, 12 + row_number() OVER (PARTITION BY account_id ORDER BY source_order) AS row, * FROM ({ORDERS})),
v AS (SELECT path, sheet, 'B' AS col, row, 's' || (amount_cents % 3) AS style FROM r UNION ALL SELECT path, sheet, 'C', row, 't' || (row % 2) FROM r),
m AS (SELECT path, sheet, col, style, count(*) AS n, min(row) AS f FROM v GROUP BY ALL)"""


def _styled(spark, d: str) -> DataFrame:
    """Dates and descriptions in styles that vary; the date is a text in rows whose amount is odd; the category column is empty but for a style."""
    rows = _booked(spark, d, "amount_cents").where("col IN ('B', 'C')")
    cell = lambda col, kind, value, style: F.struct(F.lit(col).alias("col"), kind.alias("kind"), value.alias("value"), style.alias("style"))
    day = cell("B", F.when(F.col("amount_cents") % 2 == 1, "text").otherwise(F.col("kind")), F.col("value"), F.concat(F.lit("s"), F.col("amount_cents") % 3))
    said = cell("C", F.col("kind"), F.col("value"), F.concat(F.lit("t"), F.col("row") % 2))
    none = cell("D", F.lit("empty"), F.lit(None).cast("string"), F.concat(F.lit("e"), F.col("row") % 2))
    return rows.select("path", "sheet", "sheet_no", "row", "formula", F.inline(F.when(F.col("col") == "B", F.array(day)).otherwise(F.array(said, none))))


@_query(f"""WITH {_STYLED} SELECT path, sheet, col, style FROM m QUALIFY row_number() OVER (PARTITION BY path, sheet, col ORDER BY n DESC, f) = 1 UNION ALL SELECT DISTINCT path, sheet, 'D', 'e1' FROM r""")
def sheet_styles(spark, d: str) -> DataFrame:
    return profile.conventions(_styled(spark, d), ["path"], 13)[0]


@_query(f"WITH {_STYLED} SELECT path, sheet, count(*) FILTER (amount_cents % 2 = 1) * 2 > count(*) AS date_as_text FROM r GROUP BY ALL")
def sheet_date_kinds(spark, d: str) -> DataFrame:
    return profile.conventions(_styled(spark, d), ["path"], 13)[1]


@_query(f"""WITH r AS (SELECT account_id AS sheet, 12 + row_number() OVER (PARTITION BY account_id ORDER BY source_order) AS row, count(*) OVER (PARTITION BY account_id) AS n FROM ({ORDERS}))
SELECT CAST(sheet % 10 AS BIGINT) AS path, sheet, CAST(row AS INT) AS row, 'H' AS col FROM r WHERE row = 12 + n AND row % 2 = 0""")
def chain_gaps(spark, d: str) -> DataFrame:
    """Balances missing in even rows; the next row of each sheet comes after its last one."""
    cells = _booked(spark, d).withColumn("path", F.col("path").cast("long")).where("NOT (col = 'H' AND row % 2 = 0)")
    targets = cells.groupBy("path", "sheet").agg((F.max("row") + 1).alias("target"))
    return profile.chain_gaps(cells, ["path"], targets, targets.select("path", "sheet", F.lit("H").alias("col")), 13)


@_query("""WITH p AS (SELECT p_partkey, p_size, unnest([0, 1]) AS k FROM part), e AS (SELECT p_partkey, k, p_size, unnest(CASE WHEN k = 0 THEN ['D', 'E'] ELSE ['Z'] END) AS col FROM p)
SELECT p_partkey, col, CAST(CASE WHEN k = 0 THEN least(p_size, 9) ELSE 7 END AS INT) AS first_row, CAST(CASE WHEN k = 0 THEN greatest(p_size, 9) ELSE 7 END AS INT) AS last_row FROM e""")
def list_ranges(spark, d: str) -> DataFrame:
    ref = F.concat(F.lit("$D$"), "p_size", F.lit(":e9  z7 none 1A"))
    return profile.ranges_of(read(spark, d, "part").select("p_partkey", ref.alias("sqref"))).select("p_partkey", "col", "first_row", "last_row")


@_query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type || ';"x"' WHEN p_size % 3 = 1 THEN 'A;' || p_type END AS options FROM part""")
def inline_lists(spark, d: str) -> DataFrame:
    """Lists in the formula, headed by the column's own name or not, and references, which are none."""
    k = F.col("p_size") % 3
    formula = F.when(k == 0, F.concat(F.lit('"Tipos,'), "p_type", F.lit(',""x"",,"'))).when(k == 1, F.concat(F.lit(' "A,'), "p_type", F.lit('"'))).otherwise("Categorias!$A:$A")
    return read(spark, d, "part").select("p_partkey", F.array_join(profile.without_header(profile.inline_options(formula), F.lit("Tipo")), ";").alias("options"))


def _books(spark, d: str) -> DataFrame:
    """Workbooks as files, one for each 200 parts: a sheet of parts with types in D, chosen from a list that sheet Categorias has, and sizes in E, from a list in the validation."""
    head = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    tell = lambda ref, x: f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>'

    def book(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("p_partkey")
        rows = [f'<row r="{13 + i}">{tell(f"C{13 + i}", n)}{tell(f"D{13 + i}", t)}{tell(f"E{13 + i}", "S" if s < 25 else "L")}</row>' for i, (n, t, s) in enumerate(zip(f["p_name"], f["p_type"], f["p_size"]))]
        lists = '<dataValidations><dataValidation type="list" sqref="D13:D5000"><formula1>Categorias!$A:$A</formula1></dataValidation><dataValidation type="whole" sqref="F1"/></dataValidations>'
        later = '<extLst><ext><x14:dataValidations xmlns:x14="http://schemas.microsoft.com/office/spreadsheetml/2009/9/main" xmlns:xm="http://schemas.microsoft.com/office/excel/2006/main"><x14:dataValidation type="list"><x14:formula1><xm:f>"S,L"</xm:f></x14:formula1><xm:sqref>E13:E5000</xm:sqref></x14:dataValidation></x14:dataValidations></ext></extLst>'
        kinds = ["Categoria", *sorted(set(f["p_type"]))]
        sheets = {1: head + "".join(rows) + "</sheetData>" + lists + later + "</worksheet>", 2: head + "".join(f'<row r="{i + 1}">{tell(f"A{i + 1}", x)}</row>' for i, x in enumerate(kinds)) + "</sheetData></worksheet>"}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            ids = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in ((1, "JANEIRO"), (2, "Categorias")))
            z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{ids}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in sheets) + "</Relationships>")
            for i, xml in sheets.items():
                z.writestr(f"xl/worksheets/sheet{i}.xml", xml)
        return pd.DataFrame({"path": [str(f["block"].iloc[0])], "content": [out.getvalue()]})

    parts = read(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", F.floor(F.col("p_partkey") / 200).alias("block"))
    return spread(parts, "block").groupBy("block").applyInPandas(book, "path string, content binary")


_BLOCKS = "p AS (SELECT *, CAST(p_partkey // 200 AS VARCHAR) AS path, CAST(12 + row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) AS INT) AS r FROM part)"


@_query(f"""WITH {_BLOCKS}, k AS (SELECT path, p_type, row_number() OVER (PARTITION BY path ORDER BY p_type) + 1 AS r FROM (SELECT DISTINCT path, p_type FROM p))
SELECT path, 'JANEIRO' AS sheet, r AS row, unnest(['C', 'D', 'E']) AS col, unnest([p_name, p_type, CASE WHEN p_size < 25 THEN 'S' ELSE 'L' END]) AS value FROM p
UNION ALL SELECT path, 'Categorias', CAST(r AS INT), 'A', p_type FROM k UNION ALL SELECT DISTINCT path, 'Categorias', 1, 'A', 'Categoria' FROM p""")
def workbook_cells(spark, d: str) -> DataFrame:
    """Parts written as workbooks and read back as cells."""
    return workbook.cells(_books(spark, d)).select("path", "sheet", "row", "col", "value")


@_query(f"""WITH {_BLOCKS} SELECT path || '.xlsx' AS book, r AS row, unnest(['C', 'D']) AS col, unnest([p_name, p_type]) AS value FROM p""")
def workbook_scan(spark, d: str) -> DataFrame:
    """Parts written as workbook files, and two columns of one of their sheets read by the data source: a share of each book is a task."""
    folder = workbook_source.write(_books(spark, d), own_folder(spark))
    cells = workbook_source.load(spark, folder, ["path", "sheet", "row", "col", "value"], sheets='["JANEIRO"]').where("row >= 13 AND col IN ('C', 'D')")
    return cells.select(F.regexp_extract("path", "[^/]+$", 0).alias("book"), "row", "col", "value")


@_query(f"""WITH {_BLOCKS}, b AS (SELECT DISTINCT path FROM p) SELECT path, 'JANEIRO' AS sheet, 'D13:D5000' AS sqref, 'Categorias!$A:$A' AS formula, false AS later FROM b UNION ALL SELECT path, 'JANEIRO', 'E13:E5000', '"S,L"', true FROM b""")
def workbook_validations(spark, d: str) -> DataFrame:
    return workbook.validations(_books(spark, d)).select("path", "sheet", "sqref", "formula", "later")


@_query(f"""WITH {_BLOCKS}, k AS (SELECT path, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS options FROM p GROUP BY path)
SELECT path, 'D' AS col, options, 'range' AS source, 'Categorias!$A:$A' AS source_ref FROM k UNION ALL SELECT path, 'E', 'S;L', 'inline', NULL FROM k""")
def list_columns(spark, d: str) -> DataFrame:
    """The lists of the parts' workbooks: one read from another sheet, without its header, and one in the validation itself."""
    books = stored(_books(spark, d))
    cells = stored(workbook.cells(books))
    headers = spark.createDataFrame([("C", "Descrição"), ("D", "Categoria"), ("E", "Tamanho")], "col string, header string")
    headers = books.select("path").join(F.broadcast(headers))
    found = profile.list_columns(cells, stored(workbook.validations(books)), headers, ["path"], 13)
    return found.select("path", "col", F.array_join("options", ";").alias("options"), "source", "source_ref")


@_query(f"""WITH {_BLOCKS}, u AS (SELECT path, upper(p_name) AS a, upper(p_type) AS b, min(r) AS r FROM p WHERE r < 73 GROUP BY ALL)
SELECT path, CAST(least(count(*), 30) AS INT) AS n_examples, (SELECT p_name || '/' || p_type FROM p WHERE p.path = u.path AND p.r = 13) AS first_example FROM u GROUP BY path""")
def list_examples(spark, d: str) -> DataFrame:
    books = stored(_books(spark, d))
    headers = books.select("path", F.lit("D").alias("col"), F.lit("Categoria").alias("header"))
    found = profile.list_columns(stored(workbook.cells(books)), stored(workbook.validations(books)), headers, ["path"], 13).where("col = 'D'")
    first = F.col("examples")[0]
    return found.select("path", F.size("examples").alias("n_examples"), F.concat_ws("/", first["context"], first["option"]).alias("first_example"))


@_query(f"""WITH {_BLOCKS} SELECT path, string_agg(p_type, ';' ORDER BY r) AS samples FROM p WHERE r < 21 GROUP BY path""")
def latest_samples(spark, d: str) -> DataFrame:
    return profile.latest_samples(stored(workbook.cells(_books(spark, d))), ["path"], "D", 13).select("path", F.array_join("samples", ";").alias("samples"))


# --- the cascade ---


def _same_person(items: list[dict]) -> list[tuple[int, object]]:
    """A stand-in for the port: a name of an even number of letters is the same; answers twice, and to what wasn't asked."""
    return [(x["index"], len(x["name"]) % 2 == 0) for x in items] + [(x["index"], True) for x in items] + [(-1, True), (10**6, True)]


def _classified(items: list[dict]) -> list[tuple[int, object]]:
    """A stand-in for the classifier: by direction, in another spelling, and for some a category that the list lacks."""
    return [(x["index"], "no such" if "comércio" in x["description"].lower() else "taxa  DE cartao" if x["flow"] == "out" else "FORNECEDOR") for x in items]


_HALF = "list_contains(w, 'RED') <> list_contains(w, 'WIDGET')"
_PART_NAMES = "p AS (SELECT p_partkey AS tx_id, string_split(upper(p_name), ' ') AS w, upper(p_name) AS k, length(p_name) % 2 = 0 AS even, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)"


def _part_tx(spark, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("tx_id"), F.col("p_name").alias("description"), F.lit("in").alias("flow"), F.round(F.col("p_retailprice") * 100).cast("long").alias("amount_cents"), F.lit(None).cast("string").alias("account_id"))


_OPTIONS = [("A", 0), ("B", 1), ("C", 2)]


@_query(f"""WITH {_PART_NAMES}, f AS (SELECT *, list_contains(w, 'RED') AND list_contains(w, 'WIDGET') AS entire, {_HALF} AS half FROM p),
-- a half name that the port confirms counts as whole; one that it doesn't counts as none
g AS (SELECT *, entire OR (half AND even) AS r1, (entire OR (half AND even)) AND c >= 100000 AND contains(k, 'RED') AS r2, contains(k, 'RING') AND NOT contains(k, 'SMALL') AS r3 FROM f)
SELECT tx_id, CASE WHEN r2 THEN 'B' WHEN r1 THEN 'A' WHEN r3 THEN 'C' END AS option, CASE WHEN r2 OR r1 OR r3 THEN 'user' END AS decided_by, coalesce(half AND even AND (r1 OR r2), false) AS via_agent FROM g""")
def cascade_with_identity(spark, d: str) -> DataFrame:
    ruled = spark.createDataFrame([r for r in _RULES if r[0] != "r4"], rules.RULES)
    decided, _, _ = cascade.categorise(_part_tx(spark, d), ruled, spark.createDataFrame(_OPTIONS, "option string, pos int"), identity=_same_person)
    return decided.select("tx_id", "option", "decided_by", "via_agent")


@_query(f"""WITH h AS (SELECT {_SAYS} AS s, event_type, user_id FROM events), o AS (SELECT CASE event_type WHEN 'purchase' THEN 'house' WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'house' ELSE 'model' END WHEN 'error' THEN 'house' ELSE 'model' END AS who FROM h)
SELECT 0 AS by_user, 0 AS by_agent, count(*) FILTER (who = 'house') AS by_house, count(*) FILTER (who = 'model') AS by_model, 0 AS without FROM o""")
def decision_summary(spark, d: str) -> DataFrame:
    """Events by house rules, and the rest by the classifier, which sees each wording once."""
    none = spark.createDataFrame([], rules.RULES)
    decided, _, _ = cascade.categorise(_spoken(spark, d), none, spark.createDataFrame(_HOUSE, "option string, pos int"), classifier=_classified)
    return cascade.decision_summary(decided)


@_query(f"""SELECT event_id AS tx_id, CASE event_type WHEN 'signup' THEN 'Fornecedor' ELSE 'Taxa de cartão' END AS option FROM events WHERE event_type IN ('click', 'view') OR event_type = 'signup' AND user_id % 2 = 1""")
def classifier_groups(spark, d: str) -> DataFrame:
    """What no rule decides, asked about once for each direction and wording."""
    rows = rules.with_house_option(_spoken(spark, d), spark.createDataFrame(_HOUSE, "option string, pos int")).where("house_option IS NULL")
    return cascade.classify(rows, spark.createDataFrame(_HOUSE, "option string, pos int"), _classified).select("tx_id", "option")
