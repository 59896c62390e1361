"""The library's operators applied to the benchmark's whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions.steps import dealt
from ..operators import arbitrate, dedup, inference, ordering, proof, report, rules
from ..sources import files, ofx, pages, tabular, workbook
from .tables import EVENTS, ORDERS, cents, events_tx, orders_tx, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_SUMS = """CAST(coalesce(sum(amount_cents) FILTER (direction = 'credit'), 0) AS BIGINT) AS in_cents, CAST(coalesce(sum(amount_cents) FILTER (direction <> 'credit'), 0) AS BIGINT) AS out_cents, count(*) AS n"""
_MONTHS = "['JANEIRO','FEVEREIRO','MARÇO','ABRIL','MAIO','JUNHO','JULHO','AGOSTO','SETEMBRO','OUTUBRO','NOVEMBRO','DEZEMBRO'][month(date)]"
_KEY = "strftime(date, '%Y-%m')"


@_query(f"""WITH m AS (SELECT {_KEY} AS competence_key, min({_MONTHS}) AS label, {_SUMS} FROM ({ORDERS}) GROUP BY 1)
SELECT *, in_cents - out_cents AS net_cents, CAST(sum(in_cents - out_cents) OVER (ORDER BY competence_key) AS BIGINT) AS cumulative_cents FROM m""")
def monthly_dashboard(spark, d: str) -> DataFrame:
    return report.monthly_balance(orders_tx(spark, d))


@_query(f"WITH m AS (SELECT {_KEY} AS competence_key, {_SUMS} FROM ({ORDERS}) GROUP BY GROUPING SETS (({_KEY}), ())) SELECT *, in_cents - out_cents AS net_cents FROM m")
def dashboard_total(spark, d: str) -> DataFrame:
    return report.balance_with_total(orders_tx(spark, d))


@_query(f"SELECT {_SUMS} FROM ({ORDERS})")
def report_totals(spark, d: str) -> DataFrame:
    return report.totals(orders_tx(spark, d))


@_query("SELECT strftime(CAST(l_shipdate AS DATE), '%Y-%m') AS competence_key, count(*) AS n, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM lineitem GROUP BY 1")
def partition_by_competence(spark, d: str) -> DataFrame:
    return report.by_competence(read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_orderkey").alias("source_order")))


@_query(f"""SELECT source_order, date_diff('day', DATE '1899-12-30', date) AS date_serial, strftime(date, '%d/%m/%Y') AS date_text, description, CAST(NULL AS VARCHAR) AS category,
 CASE WHEN direction = 'credit' THEN amount_cents END AS in_cents, CASE WHEN direction = 'debit' THEN amount_cents END AS out_cents FROM ({ORDERS})""")
def sheet_rows(spark, d: str) -> DataFrame:
    return report.sheet_rows(orders_tx(spark, d))


@_query(f"SELECT DISTINCT {_KEY} AS competence_key, {_MONTHS} AS sheet FROM ({ORDERS}) WHERE {_MONTHS} NOT IN ('JANEIRO', 'JULHO', 'DEZEMBRO')")
def missing_sheets(spark, d: str) -> DataFrame:
    return report.missing_sheets(orders_tx(spark, d), spark.createDataFrame([("JANEIRO",), ("JULHO",), ("DEZEMBRO",)], "sheet string"))


@_query(f"""SELECT account_id, source_order, 1000 + CAST(sum(CASE WHEN direction = 'credit' THEN amount_cents ELSE -amount_cents END) OVER (PARTITION BY account_id ORDER BY source_order) AS BIGINT) AS balance_cents FROM ({ORDERS})""")
def running_balance(spark, d: str) -> DataFrame:
    tx = orders_tx(spark, d)
    amount = lambda x: F.when(F.col("direction") == x, F.col("amount_cents"))
    rows = tx.withColumns({"in_cents": amount("credit"), "out_cents": amount("debit")})
    return report.running_balance(rows, "account_id", "source_order", F.lit(1000).cast("long")).select("account_id", "source_order", "balance_cents")


_HASHED = f"""SELECT *, sha256(concat_ws('|', year(date) || '-' || month(date) || '-' || day(date), direction, amount_cents, upper(description), account_id, ordinal)) AS hash FROM
 (SELECT *, row_number() OVER (PARTITION BY date, direction, amount_cents, upper(description), account_id ORDER BY source_order) - 1 AS ordinal FROM ({EVENTS}))"""


@_query(f"SELECT source_order, ordinal FROM ({_HASHED})")
def dedup_ordinal(spark, d: str) -> DataFrame:
    return dedup.with_hashes(events_tx(spark, d)).select("source_order", "ordinal")


@_query(f"SELECT source_order, hash FROM ({_HASHED})")
def tx_hash(spark, d: str) -> DataFrame:
    return dedup.with_hashes(events_tx(spark, d)).select("source_order", "hash")


def _ledger(spark, d: str) -> tuple[DataFrame, DataFrame]:
    hashed = dedup.with_hashes(events_tx(spark, d))
    return hashed, hashed.where("source_order % 2 = 0").select(dates.competence(F.col("date")).alias("competence_key"), "hash")


@_query(f"SELECT source_order, hash FROM ({_HASHED}) WHERE hash NOT IN (SELECT hash FROM ({_HASHED}) WHERE source_order % 2 = 0)")
def ledger_anti(spark, d: str) -> DataFrame:
    return dedup.not_in_ledger(*_ledger(spark, d)).select("source_order", "hash")


@_query(f"SELECT source_order, hash FROM ({_HASHED}) WHERE hash IN (SELECT hash FROM ({_HASHED}) WHERE source_order % 2 = 0)")
def ledger_semi(spark, d: str) -> DataFrame:
    return dedup.in_ledger(*_ledger(spark, d)).select("source_order", "hash")


def _recorded(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Events in coarse amounts, so that buckets have several rows; a third of them as the recorded ones."""
    tx = events_tx(spark, d).withColumn("amount_cents", F.floor(F.col("amount_cents") / 500) * 500)
    return tx.where("source_order % 3 <> 0"), tx.where("source_order % 3 = 0").withColumnRenamed("source_order", "row_order")


_COARSE = f"SELECT * REPLACE (CAST(floor(amount_cents / 500.0) * 500 AS BIGINT) AS amount_cents) FROM ({EVENTS})"


@_query(f"""WITH b AS (SELECT date, amount_cents, direction, count(*) FILTER (source_order % 3 <> 0) AS n_tx, count(*) FILTER (source_order % 3 = 0) AS n_slots FROM ({_COARSE}) GROUP BY ALL)
SELECT *, greatest(0, n_tx - n_slots) AS n_new FROM b WHERE n_tx > 0""")
def bucket_match_counts(spark, d: str) -> DataFrame:
    return dedup.match_counts(*_recorded(spark, d))


@_query(f"""WITH RECURSIVE e AS (SELECT *, upper(description) AS k FROM ({_COARSE})),
b AS (SELECT date, amount_cents, direction, list(source_order ORDER BY source_order) FILTER (source_order % 3 <> 0) AS txs, list(k ORDER BY source_order) FILTER (source_order % 3 <> 0) AS asks,
  list(k ORDER BY source_order) FILTER (source_order % 3 = 0) AS slots, list(description ORDER BY source_order) FILTER (source_order % 3 = 0) AS said FROM e GROUP BY ALL),
-- one transaction of every bucket a step: the first free slot of its name, else the first free one
step AS (SELECT date, amount_cents, direction, 0 AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS slot FROM b WHERE txs IS NOT NULL
UNION ALL SELECT date, amount_cents, direction, i + 1, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM
 (SELECT s.date, s.amount_cents, s.direction, s.i, s.used, b.txs, coalesce(
    list_filter(range(1, len(coalesce(slots, [])) + 1), lambda j: NOT list_contains(s.used, j) AND slots[j] = asks[s.i + 1])[1],
    list_filter(range(1, len(coalesce(slots, [])) + 1), lambda j: NOT list_contains(s.used, j))[1]) AS pick
  FROM step s JOIN b USING (date, amount_cents, direction) WHERE s.i < len(b.txs)))
SELECT txs[i] AS source_order, slot IS NULL AS is_new, said[slot] AS recorded_as, slot IS NOT NULL AND slots[slot] <> asks[i] AS name_differs FROM step JOIN b USING (date, amount_cents, direction) WHERE i > 0""")
def bucket_match_exact(spark, d: str) -> DataFrame:
    return dedup.match_recorded(*_recorded(spark, d)).select("source_order", "is_new", "recorded_as", "name_differs")


def _readings(spark, d: str) -> tuple[DataFrame, DataFrame]:
    tx = events_tx(spark, d)
    return tx.where("source_order % 7 <> 0"), tx.where("source_order % 11 <> 0")


_TWO = f"a AS (SELECT date, direction, amount_cents FROM ({EVENTS}) WHERE source_order % 7 <> 0), b AS (SELECT date, direction, amount_cents FROM ({EVENTS}) WHERE source_order % 11 <> 0)"


@_query(f"WITH {_TWO} SELECT (SELECT count(*) FROM (FROM a INTERSECT ALL FROM b)) AS common, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS only_chosen, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS only_witness")
def cross_check(spark, d: str) -> DataFrame:
    return arbitrate.cross_check(*_readings(spark, d))


@_query(f"WITH {_TWO} FROM a INTERSECT ALL FROM b")
def cross_check_common(spark, d: str) -> DataFrame:
    a, b = (x.select(*arbitrate.KEY) for x in _readings(spark, d))
    return a.intersectAll(b)


@_query(f"WITH {_TWO} FROM a EXCEPT ALL FROM b")
def cross_check_only_left(spark, d: str) -> DataFrame:
    a, b = (x.select(*arbitrate.KEY) for x in _readings(spark, d))
    return a.exceptAll(b)


@_query(f"WITH {_TWO} FROM b EXCEPT ALL FROM a")
def cross_check_only_right(spark, d: str) -> DataFrame:
    a, b = (x.select(*arbitrate.KEY) for x in _readings(spark, d))
    return b.exceptAll(a)


@_query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY date, direction, amount_cents ORDER BY source_order) AS k FROM ({EVENTS}) WHERE source_order % 7 <> 0),
m AS (SELECT *, row_number() OVER (PARTITION BY date, direction, amount_cents ORDER BY source_order) AS k FROM ({EVENTS}) WHERE source_order % 11 <> 0),
x AS (SELECT 'chosen' AS side, n.* EXCLUDE (k, account_id) FROM n LEFT JOIN (SELECT date, direction, amount_cents, count(*) AS c FROM m GROUP BY ALL) USING (date, direction, amount_cents) WHERE k > coalesce(c, 0)
 UNION ALL SELECT 'witness', m.* EXCLUDE (k, account_id) FROM m LEFT JOIN (SELECT date, direction, amount_cents, count(*) AS c FROM n GROUP BY ALL) USING (date, direction, amount_cents) WHERE k > coalesce(c, 0))
SELECT side, date, direction, amount_cents, description, source_order FROM x ORDER BY side, source_order LIMIT 40""")
def cross_check_differences(spark, d: str) -> DataFrame:
    return arbitrate.differences(*_readings(spark, d))


def _statement(spark, d: str) -> DataFrame:
    """Orders of each customer as a statement with balances, broken every 97th row."""
    tx = orders_tx(spark, d).withColumn("value_cents", F.when(F.col("direction") == "credit", F.col("amount_cents")).otherwise(-F.col("amount_cents")))
    after = F.sum("value_cents").over(W.partitionBy("account_id").orderBy("source_order").rowsBetween(W.unboundedPreceding, 0))
    rows = tx.withColumn("after_cents", after).withColumn("before_cents", F.col("after_cents") - F.col("value_cents"))
    rows = rows.withColumn("after_cents", F.when(F.col("source_order") % 97 == 0, F.col("after_cents") + 1).otherwise(F.col("after_cents")))
    return rows.select(F.col("account_id").alias("file_id"), F.col("source_order").alias("row_no"), "value_cents", "before_cents", "after_cents", F.lit(0).cast("long").alias("fee_cents"))


@_query(f"""WITH s AS (SELECT account_id AS file_id, source_order AS row_no, CASE WHEN direction = 'credit' THEN amount_cents ELSE -amount_cents END AS v FROM ({ORDERS})),
r AS (SELECT *, sum(v) OVER (PARTITION BY file_id ORDER BY row_no) AS a FROM s), q AS (SELECT file_id, row_no, v, a - v AS b, a + CASE WHEN row_no % 97 = 0 THEN 1 ELSE 0 END AS a FROM r),
l AS (SELECT *, lead(a) OVER (PARTITION BY file_id ORDER BY row_no) AS na, lead(b) OVER (PARTITION BY file_id ORDER BY row_no) AS nb FROM q),
g AS (SELECT file_id, count(*) AS n_rows, count(*) FILTER (b + v = a) AS rows_ok, count(*) FILTER (b + v <> a) AS rows_bad, count(*) FILTER (b <> na) AS breaks_newest_first, count(*) FILTER (a <> nb) AS breaks_oldest_first FROM l GROUP BY 1)
SELECT *, least(breaks_newest_first, breaks_oldest_first) AS links_broken, n_rows - 1 - least(breaks_newest_first, breaks_oldest_first) AS links_ok FROM g""")
def balance_chain(spark, d: str) -> DataFrame:
    return proof.balance_chain(_statement(spark, d))


@_query(f"""WITH e AS (SELECT account_id, source_order, description = 'signup' AS c, CASE WHEN direction = 'credit' THEN amount_cents ELSE -amount_cents END AS v FROM ({EVENTS})),
g AS (SELECT *, coalesce(count(*) FILTER (c) OVER (PARTITION BY account_id ORDER BY source_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS day_no FROM e),
m AS (SELECT account_id AS file_id, day_no, CAST(coalesce(sum(v) FILTER (NOT c), 0) AS BIGINT) AS moved_cents, max(v) FILTER (c) AS declared_cents FROM g GROUP BY ALL),
x AS (SELECT *, lag(declared_cents) OVER (PARTITION BY file_id ORDER BY day_no) + moved_cents AS expected_cents FROM m)
SELECT *, expected_cents = declared_cents AS agrees FROM x WHERE declared_cents IS NOT NULL""")
def day_close(spark, d: str) -> DataFrame:
    signed = F.when(F.col("direction") == "credit", F.col("amount_cents")).otherwise(-F.col("amount_cents"))
    lines = events_tx(spark, d).select(F.col("account_id").alias("file_id"), F.col("source_order").alias("line_no"), (F.col("description") == "signup").alias("is_close"), signed.alias("amount_cents"), signed.alias("balance_cents"))
    return proof.day_close(lines)


_PAIRS = """count(*) AS sampled, count(*) FILTER (date > p) AS ascending, count(*) FILTER (date < p) AS descending, count(*) FILTER (date = p) AS ties"""
_LAGGED = f'SELECT account_id AS "group", date, lag(date) OVER (PARTITION BY account_id ORDER BY source_order) AS p FROM ({ORDERS})'
_EVIDENCE = """ascending + descending AS compared, greatest(ascending, descending) AS leading, CASE WHEN ascending + descending = 0 THEN NULL WHEN ascending >= descending THEN 'ascending' ELSE 'descending' END AS trend,
 CASE WHEN ascending + descending >= 3 AND greatest(ascending, descending) >= 0.75 * (ascending + descending) THEN CASE WHEN ascending >= descending THEN 'ascending' ELSE 'descending' END ELSE 'undefined' END AS "order" """


def _dated(spark, d: str) -> DataFrame:
    return orders_tx(spark, d).select(F.col("account_id").alias("group"), F.col("source_order").alias("idx"), "date")


@_query(f'WITH c AS (SELECT "group", {_PAIRS} FROM ({_LAGGED}) GROUP BY 1) SELECT *, {_EVIDENCE} FROM c')
def date_order_evidence(spark, d: str) -> DataFrame:
    return ordering.evidence(ordering.pair_counts(_dated(spark, d)))


@_query(f"WITH c AS (SELECT {_PAIRS} FROM ({_LAGGED})) SELECT *, {_EVIDENCE} FROM c")
def date_order_combined(spark, d: str) -> DataFrame:
    return ordering.combine(ordering.pair_counts(_dated(spark, d)))


def _insertion(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each customer's orders by date as the sheet but every fourth, which is new; odd customers' sheets run downwards."""
    tx = _dated(spark, d)
    down = F.col("group") % 2 == 1
    day = F.unix_date("date") * F.when(down, -1).otherwise(1)
    old = tx.where("idx % 4 <> 0").withColumn("idx", (F.row_number().over(W.partitionBy("group").orderBy(day, "idx")) - 1).cast("long"))
    order = tx.select("group").distinct().withColumn("order", F.when(down, "descending").otherwise("ascending"))
    return old, tx.where("idx % 4 = 0").withColumnRenamed("idx", "seq"), order


_SHEET = f"""o AS (SELECT account_id AS g, source_order AS k, date, CASE WHEN account_id % 2 = 1 THEN -1 ELSE 1 END AS s FROM ({ORDERS})),
old AS (SELECT g, date, s, row_number() OVER (PARTITION BY g ORDER BY s * date_diff('day', DATE '1970-01-01', date), k) - 1 AS idx FROM o WHERE k % 4 <> 0),
placed AS (SELECT o.g, o.k, o.date, o.s, coalesce((SELECT min(idx) FROM old WHERE old.g = o.g AND o.s * date_diff('day', o.date, old.date) > 0), (SELECT count(*) FROM old WHERE old.g = o.g)) AS position FROM o WHERE k % 4 = 0)"""


@_query(f'WITH {_SHEET} SELECT g AS "group", k AS seq, date, CAST(position AS BIGINT) AS position FROM placed')
def ordered_insert(spark, d: str) -> DataFrame:
    return ordering.insertion_points(*_insertion(spark, d))


@_query(f"""WITH {_SHEET}, u AS (SELECT g, position, 0 AS kind, s * date_diff('day', DATE '1970-01-01', date) AS day, k AS "at" FROM placed UNION ALL SELECT g, idx, 1, 0, idx FROM old)
SELECT g AS "group", row_number() OVER (PARTITION BY g ORDER BY position, kind, day, "at") - 1 AS target, kind = 0 AS is_new, CAST("at" AS BIGINT) AS "at" FROM u""")
def sink_plan(spark, d: str) -> DataFrame:
    return ordering.sink_plan(*_insertion(spark, d))


@_query("""WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def most_frequent_first_seen(spark, d: str) -> DataFrame:
    return inference.most_frequent(read(spark, d, "events"), ["user_id"], "event_type", "event_id")


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, 'item' AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'fee', CAST(round(l_tax * 100) AS BIGINT) FROM lineitem WHERE round(l_tax * 100) > 0""")
def fee_flatmap(spark, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").withColumns({"_a": cents("l_extendedprice"), "_f": cents("l_tax")})
    item = F.struct(F.lit("item").alias("part"), F.col("_a").alias("amount_cents"))
    fee = F.when(F.col("_f") > 0, F.struct(F.lit("fee").alias("part"), F.col("_f").alias("amount_cents")))
    each = F.explode(F.filter(F.array(item, fee), lambda x: x.isNotNull()))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", each.alias("t")).select("l_orderkey", "l_linenumber", "l_partkey", "t.part", "t.amount_cents")


_UPPER = "upper(strip_accents(replace(coalesce({}, ''), 'ß', 'ss')))"
_OPTION = "trim(regexp_replace(" + _UPPER + ", '[^A-Z0-9]+', ' ', 'g'))"


@_query(f"SELECT doc_id, {_OPTION.format('text')} AS option_key FROM documents")
def option_key(spark, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.option_key(F.coalesce("text", F.lit(""))).alias("option_key"))


@_query(rf"SELECT conv_id, turn, trim(regexp_replace({_UPPER.format('text')}, '\s+', ' ', 'g')) AS comparison_key FROM conversations")
def comparison_key(spark, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", text.comparison_key(F.coalesce("text", F.lit(""))).alias("comparison_key"))


@_query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name || ' Ltda' WHEN 1 THEN s_name || ' | Filial' WHEN 2 THEN s_name || ' - Comércio' ELSE s_name || ' EIRELI ME' END AS name FROM supplier)
SELECT s_suppkey, regexp_replace(trim(regexp_replace(regexp_extract(upper(strip_accents(name)), '^(.*?)(\\s*(\\||\\s-\\s).*)?$', 1), '[^A-Z0-9]+', ' ', 'g')), '( (LTDA|ME|MEI|EPP|EIRELI|SA|CIA|EI|SS))+$', '') AS counterparty_key FROM s""".replace("\\\\", "\\"))
def counterparty_key(spark, d: str) -> DataFrame:
    k, n = F.col("s_suppkey") % 4, F.col("s_name")
    name = F.when(k == 0, F.concat(n, F.lit(" Ltda"))).when(k == 1, F.concat(n, F.lit(" | Filial"))).when(k == 2, F.concat(n, F.lit(" - Comércio"))).otherwise(F.concat(n, F.lit(" EIRELI ME")))
    return read(spark, d, "supplier").select("s_suppkey", text.counterparty_key(name).alias("counterparty_key"))


_NOISE = "'" + "','".join(dict.fromkeys(text.NOISE_WORDS)) + "'"


@_query(f"SELECT p_partkey, array_to_string(list_filter(string_split({_OPTION.format('''p_name || ' de ' || p_type || ' ltda' ''')}, ' '), lambda t: t <> '' AND t NOT IN ({_NOISE})), ' ') AS name_key FROM part")
def name_tokens(spark, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.name_key(F.concat_ws(" ", "p_name", F.lit("de"), "p_type", F.lit("ltda"))).alias("name_key"))


_CATEGORIES = [("Standard ", 0), ("ECONOMY", 1), ("economy", 2), ("Prómo", 3), ("Large", 4)]


@_query(f"""WITH o(option, pos) AS (VALUES {", ".join(map(str, _CATEGORIES))}), k AS (SELECT {_OPTION.format('option')} AS k, arg_min(option, pos) AS option FROM o GROUP BY 1)
SELECT p_partkey, p_type, option, coalesce(option, '') AS shown FROM part LEFT JOIN k ON k.k = {_OPTION.format('p_type')}""")
def category_lookup(spark, d: str) -> DataFrame:
    options = spark.createDataFrame(_CATEGORIES, "option string, pos int")
    found = rules.canonical_options(read(spark, d, "part").withColumn("answer", F.col("p_type")), options)
    return found.select("p_partkey", "p_type", "option", F.coalesce("option", F.lit("")).alias("shown"))


_SAYS = "CASE event_type WHEN 'purchase' THEN 'Pix recebido' WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'Venda cartão' ELSE 'Estorno de venda' END WHEN 'error' THEN 'Tarifa bancária' WHEN 'click' THEN 'Tarifa iFood' ELSE 'Compra' END"
_HOUSE = [("Recebimento de vendas", 0), ("Taxa de cartão", 1), ("Fornecedor", 2)]


def _spoken(spark, d: str) -> DataFrame:
    flow = F.when(F.col("event_type").isin("purchase", "signup"), "in").otherwise("out")
    return read(spark, d, "events").select(F.col("event_id").alias("tx_id"), F.expr(_SAYS).alias("description"), flow.alias("flow"), cents("value").alias("amount_cents"), F.col("user_id").cast("string").alias("account_id"))


@_query("""SELECT event_id AS tx_id, CASE event_type WHEN 'purchase' THEN 'Recebimento de vendas' WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'Recebimento de vendas' END WHEN 'error' THEN 'Taxa de cartão' END AS house_option FROM events""")
def house_rules(spark, d: str) -> DataFrame:
    return rules.with_house_option(_spoken(spark, d), spark.createDataFrame(_HOUSE, "option string, pos int")).select("tx_id", "house_option")


_RULES = [
    ("r1", True, "Red widget", "in", "red widget", None, None, None, None, "A", None, None, None, 0, 0),
    ("r2", True, "Dear red", "in", "red widget", ["red"], 100000, None, None, "B", None, None, None, 0, 1),
    ("r3", True, "Rings", "in", None, ["ring"], None, None, ["small"], "C", None, None, None, 0, 2),
    ("r4", True, "Ring name", "in", "ring", None, None, None, None, "A", None, None, None, 0, 3),
    ("r5", False, "Off", "in", "blue widget", None, None, None, None, "A", None, None, None, 9, 4),
]


@_query("""WITH p AS (SELECT p_partkey AS tx_id, string_split(upper(p_name), ' ') AS w, upper(p_name) AS k, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part),
m AS (SELECT tx_id, list_contains(w, 'RED') AND list_contains(w, 'WIDGET') AS r1, list_contains(w, 'RED') AND list_contains(w, 'WIDGET') AND c >= 100000 AS r2, contains(k, 'RING') AND NOT contains(k, 'SMALL') AS r3, (list_contains(w, 'RED') <> list_contains(w, 'WIDGET')) AS half, list_contains(w, 'RING') AS r4 , c FROM p)
SELECT tx_id, CASE WHEN r2 THEN 'B' WHEN r1 THEN 'A' WHEN r3 THEN 'C' END AS option, CASE WHEN r2 OR r1 OR r3 THEN 'user' END AS decided_by, CASE WHEN r2 THEN 'r2' WHEN r1 THEN 'r1' WHEN r3 THEN 'r3' END AS rule_id,
 array_to_string(list_filter([CASE WHEN half THEN 'r1' END, CASE WHEN half AND c >= 100000 AND list_contains(string_split((SELECT k FROM p WHERE p.tx_id = m.tx_id), ' '), 'RED') THEN 'r2' END, CASE WHEN r4 THEN 'r4' END], lambda x: x IS NOT NULL), ',') AS pending,
 array_to_string(list_filter([CASE WHEN r2 AND r1 THEN 'r1' END, CASE WHEN (r2 OR r1) AND r3 THEN 'r3' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM m""")
def user_rules_best(spark, d: str) -> DataFrame:
    tx = read(spark, d, "part").select(F.col("p_partkey").alias("tx_id"), F.col("p_name").alias("description"), F.lit("in").alias("flow"), cents("p_retailprice").alias("amount_cents"), F.lit(None).cast("string").alias("account_id"))
    found = rules.decide(tx, spark.createDataFrame(_RULES, rules.RULES), spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "option string, pos int"))
    return found.select("tx_id", "option", "decided_by", "rule_id", F.array_join("pending", ",").alias("pending"), F.array_join("conflicts", ",").alias("conflicts"))


@_query(ORACLES["user_rules_best"])
def user_rules_among_many(spark, d: str) -> DataFrame:
    """The same decisions among a hundred thousand rules more, each under a name or a term of its own that no part has."""
    n = F.col("id").cast("string")
    more = spark.range(100_000).select(
        F.concat(F.lit("many"), n).alias("rule_id"), F.lit(True).alias("active"), F.lit("Many").alias("label"), F.lit("in").alias("direction"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("supplier "), n)).alias("name"),
        F.when(F.col("id") % 2 == 1, F.array(F.lit("ring"), F.concat(F.lit("invoice "), n))).alias("terms"), F.lit(None).cast("long").alias("min_cents"), F.lit(None).cast("long").alias("max_cents"), F.lit(None).cast("array<string>").alias("exceptions"),
        F.lit("A").alias("category_key"), F.lit(None).cast("string").alias("account_id"), F.lit(None).cast("array<string>").alias("aliases_yes"), F.lit(None).cast("array<string>").alias("aliases_no"), F.lit(0).alias("priority"), (F.col("id") + 10).cast("int").alias("pos"),
    )
    tx = read(spark, d, "part").select(F.col("p_partkey").alias("tx_id"), F.col("p_name").alias("description"), F.lit("in").alias("flow"), cents("p_retailprice").alias("amount_cents"), F.lit(None).cast("string").alias("account_id"))
    found = rules.decide(tx, spark.createDataFrame(_RULES, rules.RULES).unionByName(more), spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "option string, pos int"))
    return found.select("tx_id", "option", "decided_by", "rule_id", F.array_join("pending", ",").alias("pending"), F.array_join("conflicts", ",").alias("conflicts"))


_MINED = """SELECT p_name || ' ' || p_brand AS description, p_type AS category, 'in' AS flow, p_size % 3 AS sheet, p_partkey AS pos FROM part"""


@_query(f"""WITH h AS ({_MINED}), k AS (SELECT *, array_to_string(list_filter(string_split({_OPTION.format('description')}, ' '), lambda t: t <> '' AND t NOT IN ({_NOISE})), ' ') AS name FROM h),
g AS (SELECT flow, name, count(*) AS n, min(category) AS category, count(DISTINCT category) AS c, count(DISTINCT sheet) AS n_sheets FROM k WHERE contains(name, ' ') GROUP BY ALL)
SELECT flow, name, n, category, n_sheets FROM g WHERE n >= 2 AND c = 1 ORDER BY n DESC, name LIMIT 20""")
def rule_mining(spark, d: str) -> DataFrame:
    parts = read(spark, d, "part").selectExpr("concat_ws(' ', p_name, p_brand) AS description", "p_type AS category", "'in' AS flow", "p_size % 3 AS sheet", "p_partkey AS pos")
    return rules.mine(parts, least=2).select("flow", "name", "n", "category", "n_sheets")


@_query(f"""WITH v AS (SELECT 'priority' AS col, o_orderpriority AS v, o_orderkey AS pos FROM orders UNION ALL SELECT 'status', o_orderstatus, o_orderkey FROM orders UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), o_orderkey FROM orders),
k AS (SELECT col, {_OPTION.format('v')} AS k, count(*) AS n, arg_min(v, pos) AS option, min(pos) AS f FROM v GROUP BY ALL),
g AS (SELECT col, CAST(sum(n) AS BIGINT) AS n_values, count(*) FILTER (k <> '') AS n_distinct, CAST(coalesce(sum(n) FILTER (k <> '' AND n > 1), 0) AS BIGINT) AS n_repeated, array_to_string(list(option ORDER BY n DESC, f), ',') AS options FROM k GROUP BY col)
SELECT * FROM g WHERE n_values >= 8 AND n_distinct BETWEEN 1 AND 60 AND n_distinct * 3 <= n_values AND n_repeated >= n_values * 0.6""")
def infer_list(spark, d: str) -> DataFrame:
    each = "stack(3, 'priority', o_orderpriority, 'status', o_orderstatus, 'customer', cast(o_custkey as string)) as (col, v)"
    rows = read(spark, d, "orders").selectExpr("o_orderkey AS pos", each)
    return inference.list_columns(rows, ["col"], "v", "pos").select("col", "n_values", "n_distinct", "n_repeated", F.array_join("options", ",").alias("options"))


@_query(f"""SELECT source_order, coalesce(amount_cents = lag(amount_cents) OVER w AND description = lag(description) OVER w, false) AS is_phantom FROM ({_COARSE}) WINDOW w AS (PARTITION BY account_id ORDER BY source_order)""")
def phantom_drop(spark, d: str) -> DataFrame:
    tx = events_tx(spark, d).withColumn("amount_cents", F.floor(F.col("amount_cents") / 500) * 500)
    return proof.phantom_rows(tx, "account_id", "source_order", ["description"], "amount_cents").select("source_order", "is_phantom")


@_query(f"""SELECT source_order FROM (SELECT *, CASE WHEN source_order % 5 = 0 THEN NULL ELSE source_order // 40 END AS line FROM ({EVENTS}))
QUALIFY line IS NULL OR row_number() OVER (PARTITION BY account_id, line, date, direction, description ORDER BY source_order) = 1""")
def first_of_line(spark, d: str) -> DataFrame:
    tx = events_tx(spark, d).withColumn("line", F.when(F.col("source_order") % 5 != 0, F.floor(F.col("source_order") / 40)))
    return proof.first_of_line(tx, ["account_id"], "line", ["date", "direction", "description"], "source_order").select("source_order")


@_query("""SELECT o_orderkey, 'R$ ' || replace(regexp_replace(format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT) // 100), ',', '.', 'g'), ' ', '') || ',' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS shown FROM orders""")
def format_brl(spark, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", money.format_brl(cents("o_totalprice")).alias("shown"))


@_query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, 'ok' AS status FROM orders")
def parse_brl(spark, d: str) -> DataFrame:
    """Amounts printed and read back."""
    parsed = money.parse_brl(money.format_brl(cents("o_totalprice")))
    return read(spark, d, "orders").select("o_orderkey", parsed["cents"].alias("cents"), parsed["status"].alias("status"))


@_query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d FROM orders")
def parse_dates(spark, d: str) -> DataFrame:
    """Dates printed in the sheet's form and read back."""
    p = dates.parse_br(dates.brazilian(F.col("o_orderdate").cast("date")))
    return read(spark, d, "orders").select("o_orderkey", p["date"].alias("date"), *[p[c].cast("long").alias(c) for c in "ymd"])


@_query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def json_extract(spark, d: str) -> DataFrame:
    fields = F.from_json("props", "k bigint, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return read(spark, d, "events").withColumn("_p", fields).select("event_id", F.col("_p.k").alias("k"), (F.col("props").isNotNull() & F.col("_p._bad").isNull()).alias("valid"))


@_query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents)
SELECT doc_id, CAST(n // 150 AS BIGINT) AS block, count(*) AS n_lines, string_agg('L' || (n + 1) || '| ' || line, chr(10) ORDER BY n) AS body FROM l GROUP BY ALL""")
def page_lines(spark, d: str) -> DataFrame:
    """Numbered lines of each text in blocks of 150; a block is as large as its lines are long, and never more of them."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    numbered = F.concat(F.lit("L"), F.col("n") + 1, F.lit("| "), F.col("line"))
    blocks = lines.groupBy("doc_id", F.floor(F.col("n") / 150).cast("long").alias("block")).agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("n", numbered.alias("t")))).alias("_t"))
    return blocks.select("doc_id", "block", "n_lines", F.array_join(F.transform("_t", lambda x: x["t"]), "\n").alias("body"))


@_query("""WITH n AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i, count(*) OVER () AS n FROM pages)
SELECT page_id FROM n WHERE i IN (SELECT CAST(floor(k * (n - 1) / 2.0 + 0.5) AS BIGINT) FROM (SELECT unnest([0, 1, 2]) AS k), (SELECT count(*) AS n FROM pages))""")
def block_sample(spark, d: str) -> DataFrame:
    """The first, middle and last page in order: positions by rank, found by range-sorted counts instead of one global window."""
    return sample_of_order(read(spark, d, "pages").select("page_id"), "page_id", 3)


def sample_of_order(rows: DataFrame, order: str, n: int, parts: int = 200) -> DataFrame:
    """Rows at n even places of the order (the feature: a sample of n blocks), whatever the order's type. Keys are dealt into sorted ranges; the
    ranges' counts, at most `parts` of them, tell in which range and where in it each place lies."""
    ranged = rows.select(order).repartitionByRange(parts, order).select(order, F.spark_partition_id().alias("_part")).persist()
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    total, places, before = sum(c for _, c in counts), [], 0
    wanted = sorted({int(i * (total - 1) / max(1, n - 1) + 0.5) for i in range(n)}) if total else []
    for part, c in counts:
        places += [(part, w - before + 1) for w in wanted if before <= w < before + c]
        before += c
    if not places:
        return rows.limit(0)
    spark = rows.sparkSession
    at = F.broadcast(spark.createDataFrame(places, "_part int, _at int"))  # n rows
    held = ranged.join(F.broadcast(at.select("_part").distinct()), "_part").withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(order)))
    return rows.join(F.broadcast(held.join(at, ["_part", "_at"]).select(order).distinct()), order, "left_semi")


@_query("SELECT p_partkey, CAST(p_size + 700 AS BIGINT) AS number, CASE WHEN p_size + 700 > 702 THEN chr(CAST(65 + (((p_size + 699) // 26 - 1) // 26 - 1) AS INT)) ELSE '' END || chr(CAST(65 + (((p_size + 699) // 26) - 1) % 26 AS INT)) || chr(CAST(65 + (p_size + 699) % 26 AS INT)) AS letters FROM part")
def column_letters(spark, d: str) -> DataFrame:
    number = F.col("p_size") + 700
    letters = text.column_letters(number)
    return read(spark, d, "part").select("p_partkey", text.column_number(letters).cast("long").alias("number"), letters.alias("letters"))


@_query("SELECT p_partkey, 'H' || p_size || '+F' || (p_size + 1) || '-$G$7&\"F1\"' AS translated FROM part")
def formula_translate(spark, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", F.lit('H1+F2-$G$7&"F1"').alias("f"), F.lit(1).alias("a"), F.col("p_size").alias("b"))
    return inference.translated(rows, "f", "a", "b").select("p_partkey", "translated")


# --- sources: the tables written out in a source's form, and read back by it ---


@_query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'xls-legacy' WHEN 3 THEN 'spreadsheet' WHEN 4 THEN 'text' WHEN 5 THEN 'ofx' ELSE 'text' END AS kind FROM events""")
def file_kinds(spark, d: str) -> DataFrame:
    heads = [b"%PDF-1.7", b"\xff\xd8\xff\xe0", b"\xd0\xcf\x11\xe0", b"PK\x03\x04.. xl/workbook.xml", b"PK\x03\x04", b"OFXHEADER:100", b"data,valor"]
    body = F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("event_id") % 7 + 1).cast("int")), F.encode("props", "UTF-8"))
    return read(spark, d, "events").select("event_id", files.kind(body, F.lit("a.dat")).alias("kind"))


@_query("SELECT doc_id, text FROM documents")
def decode_text(spark, d: str) -> DataFrame:
    """Texts as UTF-8, Latin letters of one byte, and UTF-16 with its mark."""
    k = F.col("doc_id") % 3
    content = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.encode("text", "ISO-8859-1")).otherwise(F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE")))
    # a text with other letters than those of one byte stays UTF-8
    content = F.when((k == 1) & F.col("text").rlike(r"[^\x00-\x7E\xA0-\xFF]"), F.encode("text", "UTF-8")).otherwise(content)
    return files.with_text(read(spark, d, "documents").where("text is not null").select("doc_id", content.alias("content"))).select("doc_id", "text")


@_query("""SELECT p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS row_no, CAST(p_partkey AS VARCHAR) || '~' || p_name || chr(10) || '"' || p_type || '"~' || p_size || '' AS cells FROM part
UNION ALL SELECT DISTINCT p_brand, 0, 'key~name; type~size' FROM part""")
def delimited_tables(spark, d: str) -> DataFrame:
    """Parts as one delimited file a brand, with quotes, breaks and blank lines; the delimiter is found out."""
    name = F.concat(F.lit('"'), "p_name", F.lit("\n"), F.lit('""'), "p_type", F.lit('"""'))
    lines = F.concat_ws(";", "p_partkey", name, "p_size")
    body = read(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", lines.alias("l")))).alias("_l"))
    text_ = F.concat(F.lit('key;"name; type";size\r\n'), F.array_join(F.transform("_l", lambda x: x["l"]), "\r\n\r\n"))
    return files.tables(body.select("path", text_.alias("text"))).select("path", F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", "~").alias("cells"))


def _written(spark, d: str) -> DataFrame:
    """Each customer's orders as a statement of text cells; a fee of 7 cents on every fifth, a broken balance on every 97th."""
    rows = _statement(spark, d).withColumn("fee_cents", F.when(F.col("row_no") % 5 == 0, 7).otherwise(0))
    rows = rows.withColumn("after_cents", F.col("after_cents") - F.col("fee_cents"))
    cells = F.array(F.when(F.col("value_cents") >= 0, "Crédito").otherwise("Débito"), money.format_brl(F.col("value_cents")), money.format_brl(F.col("before_cents")), money.format_brl(F.col("after_cents")), F.when(F.col("fee_cents") > 0, "0,07").otherwise("Grátis"), F.lit("31/08/2026 10:00"))
    body = rows.select(F.col("file_id").cast("string").alias("path"), (F.row_number().over(W.partitionBy("file_id").orderBy("row_no"))).alias("row_no"), cells.alias("cells"))
    header = F.array(*[F.lit(x) for x in ("Movimentação", "Valor", "Saldo Antes", "Saldo depois", "Tarifa", "Data")])
    return body.unionByName(body.select("path").distinct().select("path", F.lit(0).alias("row_no"), header.alias("cells")))


@_query(f"""WITH s AS (SELECT account_id, source_order, CASE WHEN direction = 'credit' THEN amount_cents ELSE -amount_cents END AS v, CASE WHEN source_order % 5 = 0 THEN 7 ELSE 0 END AS fee FROM ({ORDERS})),
r AS (SELECT *, sum(v) OVER (PARTITION BY account_id ORDER BY source_order) AS a FROM s), q AS (SELECT account_id, source_order, v, fee, a - v AS b, a + CASE WHEN source_order % 97 = 0 THEN 1 ELSE 0 END - fee AS a FROM r),
l AS (SELECT *, lead(a) OVER w AS na, lead(b) OVER w AS nb FROM q WINDOW w AS (PARTITION BY account_id ORDER BY source_order)),
g AS (SELECT CAST(account_id AS VARCHAR) AS path, count(*) AS n_tx, count(*) FILTER (fee > 0) AS n_fees, count(*) FILTER (b + v - fee = a) AS rows_ok, count(*) FILTER (b + v - fee <> a) AS rows_bad, least(count(*) FILTER (b <> na), count(*) FILTER (a <> nb)) AS links_broken FROM l GROUP BY 1)
SELECT *, CASE WHEN rows_bad > 0 THEN 'row arithmetic fails' WHEN links_broken > 0 THEN 'balance chain breaks' WHEN rows_ok = 0 THEN 'nothing to check' END AS reason FROM g""")
def statement_audit(spark, d: str) -> DataFrame:
    return tabular.audit(tabular.read_rows(_written(spark, d))).select("path", "n_tx", "n_fees", "rows_ok", "rows_bad", "links_broken", "reason")


@_query(f"""SELECT CAST(account_id AS VARCHAR) AS path, direction, amount_cents, CASE WHEN direction = 'credit' THEN 'Recebimento vendas' ELSE 'Lançamento' END AS description FROM ({ORDERS})
UNION ALL SELECT CAST(account_id AS VARCHAR), 'debit', 7, 'Tarifa' FROM ({ORDERS}) WHERE source_order % 5 = 0""")
def statement_transactions(spark, d: str) -> DataFrame:
    return tabular.transactions(tabular.read_rows(_written(spark, d))).select("path", "direction", "amount_cents", "description")


def _ofx_texts(spark, d: str) -> DataFrame:
    tx = orders_tx(spark, d)
    sign = F.when(F.col("direction") == "credit", "").otherwise("-")
    amount = F.concat(sign, F.floor(F.col("amount_cents") / 100), F.lit("."), F.lpad((F.col("amount_cents") % 100).cast("string"), 2, "0"))
    block = F.concat(F.lit("<STMTTRN><TRNTYPE>"), F.upper("direction"), F.lit("</TRNTYPE><DTPOSTED>"), F.date_format("date", "yyyyMMdd"), F.lit("120000[-3:BRT]<TRNAMT>"), amount, F.lit("<MEMO>"), "description", F.lit(" - Transferência | Pix</STMTTRN>\n"))
    files_ = tx.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("source_order", block.alias("b")))).alias("_b"))
    body = F.concat(F.lit("OFXHEADER:100\n<OFX><ORG>Banco X</ORG><ACCTID>"), "account_id", F.lit("</ACCTID><BANKTRANLIST><DTSTART>19960101<DTEND>20031231\n"), F.array_join(F.transform("_b", lambda x: x["b"]), ""), F.lit("</BANKTRANLIST></OFX>"))
    return files_.select(F.col("account_id").cast("string").alias("path"), body.alias("text"))


@_query(f"""SELECT CAST(account_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY account_id ORDER BY source_order) - 1 AS source_order, date, 'Pix - ' || description AS description, direction, amount_cents, 'banco-x-' || account_id AS account FROM ({ORDERS})""")
def ofx_transactions(spark, d: str) -> DataFrame:
    tx = ofx.transactions(ofx.blocks(_ofx_texts(spark, d)))
    return tx.select("path", "source_order", "date", "description", "direction", "amount_cents", F.col("account_id").alias("account"))


@_query(f"""WITH g AS (SELECT CAST(account_id AS VARCHAR) AS path, count(*) AS declared, count(*) AS n_tx, count(*) FILTER (date < DATE '1996-01-01' OR date > DATE '2003-12-31') AS n_out_of_period FROM ({ORDERS}) GROUP BY 1)
SELECT *, CASE WHEN n_out_of_period > 0 THEN 'dates out of period' END AS reason FROM g""")
def ofx_audit(spark, d: str) -> DataFrame:
    texts = _ofx_texts(spark, d)
    return ofx.audit(texts, ofx.blocks(texts)).select("path", F.col("declared").cast("long").alias("declared"), "n_tx", "n_out_of_period", "reason")


def _page_texts(spark, d: str) -> DataFrame:
    """Each user's events as a page of a day-balance statement: a closing line after each day, off by a cent on the 20th."""
    e = events_tx(spark, d).withColumn("v", F.when(F.col("direction") == "credit", F.col("amount_cents")).otherwise(-F.col("amount_cents")))
    days = e.groupBy("account_id", "date").agg(F.sum("v").alias("v"), F.max("source_order").alias("source_order"))
    closing = F.sum("v").over(W.partitionBy("account_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)) + F.when(F.dayofmonth("date") == 20, 1).otherwise(0)
    rows = e.select("account_id", "date", F.lit(0).alias("k"), "source_order", F.col("description").alias("t"), "v").unionByName(days.select("account_id", "date", F.lit(1).alias("k"), "source_order", F.lit("Saldo do dia").alias("t"), closing.alias("v")))
    line = F.concat(dates.brazilian(F.col("date")), F.lit(" "), "t", F.lit(" "), money.format_brl(F.col("v")))
    body = rows.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("date", "k", "source_order", line.alias("l")))).alias("_l"))
    text_ = F.concat(F.lit("290 - PagSeguro Internet S/A\nConta "), "account_id", F.lit("\nExtrato da conta\nData Valor\nDescrição\n"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n"))
    return body.select(F.col("account_id").alias("path"), F.lit(0).alias("page"), text_.alias("text"))


@_query(f"""WITH e AS (SELECT account_id AS path, date, sum(CASE WHEN direction = 'credit' THEN amount_cents ELSE -amount_cents END) AS v, count(*) AS n FROM ({EVENTS}) GROUP BY ALL),
c AS (SELECT *, sum(v) OVER (PARTITION BY path ORDER BY date) + CASE WHEN day(date) = 20 THEN 1 ELSE 0 END AS closing FROM e),
x AS (SELECT *, lag(closing) OVER (PARTITION BY path ORDER BY date) + v AS want FROM c)
SELECT path, CAST(sum(n) AS BIGINT) AS n_tx, count(want) AS days_checked, count(*) FILTER (want <> closing) AS days_bad,
 CASE WHEN count(want) = 0 THEN 'no day balance to check' WHEN count(*) FILTER (want <> closing) > 0 THEN 'day balance does not follow' END AS reason FROM x GROUP BY path""")
def page_audit(spark, d: str) -> DataFrame:
    texts = _page_texts(spark, d)
    return pages.audit(texts, pages.read_lines(texts)).select("path", "n_tx", "days_checked", "days_bad", "reason")


@_query(f"SELECT account_id AS path, date, description, CASE WHEN amount_cents = 0 THEN 'credit' ELSE direction END AS direction, amount_cents FROM ({EVENTS})")
def page_transactions(spark, d: str) -> DataFrame:
    texts = _page_texts(spark, d)
    return pages.transactions(texts, pages.read_lines(texts)).select("path", "date", "description", "direction", "amount_cents")


@_query(r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '[^\s]+') AS w FROM benchmark), l AS (SELECT item_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM t),
n AS (SELECT item_id, i // 8 AS line, string_agg(x, ' ' ORDER BY i) AS s FROM l GROUP BY ALL)
SELECT item_id, line // 5 AS page, string_agg(s, chr(10) ORDER BY line) AS text FROM n GROUP BY ALL""")
def words_to_pages(spark, d: str) -> DataFrame:
    """Positioned words, eight to a line and five lines to a page, out of order and of unequal height."""
    w = read(spark, d, "benchmark").select(F.col("item_id").alias("path"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+)"))).alias("i", "text"))
    line = F.floor(F.col("i") / 8)
    placed = w.select("path", F.floor(line / 5).alias("page"), "text", (F.col("i") % 8 * 50.5).alias("x0"), (line % 5 * 12 + F.when(F.col("i") % 2 == 0, 0.3).otherwise(-0.3)).alias("top"))
    return pages.lines_to_pages(pages.words_to_lines(placed)).select(F.col("path").alias("item_id"), "page", "text")


# --- what cells tell ---


@_query("""SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def description_lengths(spark, d: str) -> DataFrame:
    return inference.description_style(read(spark, d, "documents"), ["lang"], "text").select("lang", "n", "n_chars")


def _cells(spark, d: str, *more: str) -> DataFrame:
    """Each customer's orders as a sheet: dates in B, names in C, amounts in F or G, a running balance in H. more: columns of the orders to keep."""
    tx = dealt(orders_tx(spark, d), read(spark, d, "orders"), "account_id").withColumn("row", (F.row_number().over(W.partitionBy("account_id").orderBy("source_order")) + 12).cast("int"))
    r = F.col("row").cast("string")
    cell = lambda col, kind, value, style, formula=None: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(style).alias("style"), (F.lit(None).cast("string") if formula is None else formula).alias("formula"))
    credit = F.col("direction") == "credit"
    balance = F.when(F.col("row") == 13, F.concat(F.lit("G7+F"), r, F.lit("-G"), r)).otherwise(F.concat(F.lit("H"), F.col("row") - 1, F.lit("+F"), r, F.lit("-G"), r))
    each = F.array(cell("B", "number", dates.sheet_serial(F.col("date")), "dd/mm/yyyy"), cell("C", "text", F.col("description"), "0"), F.when(credit, cell("F", "number", F.col("amount_cents") / 100, "#,##0.00")), F.when(~credit, cell("G", "number", F.col("amount_cents") / 100, "#,##0.00")), cell("H", "formula", F.lit("1"), "#,##0.00", balance))
    return tx.select(F.col("account_id").alias("sheet"), "row", *more, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("c")).select("sheet", "row", *more, "c.*")


#: Every built-in id up to 60, and codes with quotes, escapes, brackets and currencies.
_CODES = ("dd/mm/yyyy", "d-mmm", "mmm yy", "mm:ss", "hh:mm", '"day" 0', '"R$" dd', "R$ #,##0.00", "#,##0", "0.00", "$0", "[$-416]dd/mm", "[Red]0", r"\d0", "yyyy", "General", "0%", "m/0")
_STYLES = (*(str(i) for i in range(61)), *_CODES)


@_query(f"""WITH s AS (SELECT o_orderkey, o_orderkey % {len(_STYLES)} AS i FROM orders)
SELECT o_orderkey, CASE WHEN i IN (14, 15, 16, 17, 22, 27, 30, 36, 45, 46, 47, 50, 57, 58, 61, 62, 63, 67, 72, 73, 75) THEN 'date' WHEN i IN (5, 6, 7, 8, 42, 43, 44, 68, 69, 71) THEN 'money' END AS kind,
 i IN (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47, 61, 62, 63, 72, 78) AS shown_as_date FROM s""")
def style_kinds(spark, d: str) -> DataFrame:
    """Each order under one of many number formats: what an inspection and a table make of it."""
    style = F.element_at(F.array(*[F.lit(x) for x in _STYLES]), (F.col("o_orderkey") % len(_STYLES) + 1).cast("int"))
    rows = read(spark, d, "orders").select("o_orderkey", style.alias("s"))
    s = F.col("s")
    return rows.select("o_orderkey", F.when(workbook.is_date_style(s), "date").when(workbook.is_money_style(s), "money").alias("kind"), workbook.is_shown_date(s).alias("shown_as_date"))


@_query(f"""WITH n AS (SELECT account_id AS sheet, count(*) AS n, count(*) FILTER (direction = 'credit') AS f FROM ({ORDERS}) GROUP BY 1)
SELECT sheet, unnest(list_filter([CASE WHEN true THEN 'B date' END, 'C text', CASE WHEN f > 0 THEN 'F money' END, CASE WHEN n > f THEN 'G money' END, 'H formula'], lambda x: x IS NOT NULL)) AS found FROM n""")
def column_kinds(spark, d: str) -> DataFrame:
    kinds = inference.column_kinds(_cells(spark, d), workbook.is_date_style(F.col("style")), workbook.is_money_style(F.col("style")))
    return kinds.select("sheet", F.concat_ws(" ", "col", "column_kind").alias("found"))


@_query(f"""WITH n AS (SELECT account_id AS sheet, count(*) AS n FROM ({ORDERS}) GROUP BY 1)
SELECT sheet, 'H' AS col, n, CASE WHEN n > 1 THEN 'H' || (n + 11) || '+F' || (n + 12) || '-G' || (n + 12) END AS model, n >= least(n, 3) AS column_wide, CASE WHEN n > 1 THEN 'accumulated' ELSE 'other' END AS formula_kind,
 CASE WHEN n > 1 THEN true WHEN n >= 3 THEN true WHEN n <= 2 THEN false END AS repeats FROM n""")
def formula_columns(spark, d: str) -> DataFrame:
    found = inference.repeat_formula(inference.formula_columns(_cells(spark, d), 13, ("B", "C", "F", "G")))
    return found.select("sheet", "col", "n", "model", "column_wide", "formula_kind", "repeats")


@_query(f"""SELECT account_id AS sheet, 12 + row_number() OVER (PARTITION BY account_id ORDER BY source_order) AS row_order, date, description, direction, amount_cents FROM ({ORDERS})""")
def existing_rows(spark, d: str) -> DataFrame:
    found = workbook.existing_rows(_cells(spark, d).withColumn("path", F.lit("book")), 13, "B", "C", "D", "F", "G")
    return found.select("sheet", "row_order", "date", "description", "direction", "amount_cents")


@_query("""SELECT event_type AS option, count(*) FILTER (user_id % 2 = 0) AS n_in, count(*) FILTER (user_id % 2 = 1) AS n_out, array_to_string((list(props ORDER BY event_id))[1:3], ',') AS contexts FROM events GROUP BY 1""")
def option_usage(spark, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("event_type").alias("option"), F.col("props").alias("context"), F.col("event_id").alias("pos"), F.when(F.col("user_id") % 2 == 0, "in").otherwise("out").alias("flow"))
    return inference.option_usage(rows).select("option", "n_in", "n_out", F.array_join("contexts", ",").alias("contexts"))


@_query("""SELECT rule_id, array_to_string(list_sort(list(DISTINCT k)), ',') AS candidates FROM (SELECT upper(p_name) AS k, unnest(list_filter([CASE WHEN list_contains(string_split(upper(p_name), ' '), 'RED') <> list_contains(string_split(upper(p_name), ' '), 'WIDGET') THEN 'r1' END,
 CASE WHEN list_contains(string_split(upper(p_name), ' '), 'RED') AND NOT list_contains(string_split(upper(p_name), ' '), 'WIDGET') AND round(p_retailprice * 100) >= 100000 THEN 'r2' END, CASE WHEN list_contains(string_split(upper(p_name), ' '), 'RING') THEN 'r4' END], lambda x: x IS NOT NULL)) AS rule_id FROM part) GROUP BY rule_id""")
def identity_questions(spark, d: str) -> DataFrame:
    tx = read(spark, d, "part").select(F.col("p_partkey").alias("tx_id"), F.col("p_name").alias("description"), F.lit("in").alias("flow"), cents("p_retailprice").alias("amount_cents"), F.lit(None).cast("string").alias("account_id"))
    found = rules.identity_questions(rules.matches(tx, spark.createDataFrame(_RULES, rules.RULES)))
    return found.select("rule_id", F.array_join("candidates", ",").alias("candidates"))


@_query(f"""WITH h AS ({_HASHED}), k AS (SELECT *, source_order % 2 = 0 AS known FROM h)
SELECT strftime(date, '%Y-%m') AS competence_key, count(*) FILTER (NOT known) AS n_new, count(*) FILTER (known) AS n_duplicates, CAST(coalesce(sum(amount_cents) FILTER (NOT known AND direction = 'credit'), 0) AS BIGINT) AS in_cents, CAST(coalesce(sum(amount_cents) FILTER (NOT known AND direction = 'debit'), 0) AS BIGINT) AS out_cents FROM k GROUP BY 1""")
def import_report(spark, d: str) -> DataFrame:
    from .importing import plan_import

    tx = events_tx(spark, d)
    known = dedup.with_hashes(tx).where("source_order % 2 = 0").select(dates.competence(F.col("date")).alias("competence_key"), "hash")
    none = tx.where("false").withColumnRenamed("source_order", "row_order")
    sheets = spark.createDataFrame([(m,) for m in dates.MONTHS], "sheet string")
    return plan_import(tx, known, none, sheets).report.select("competence_key", "n_new", "n_duplicates", F.col("in_cents").cast("long").alias("in_cents"), F.col("out_cents").cast("long").alias("out_cents"))
