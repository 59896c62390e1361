"""Page-text statements whose days end with a declared balance; and page text from positioned words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions.steps import apart, spread
from ..operators import proof

# The bank's own wording of an entry, of the head of its tables, and of lines that say nothing.
_ENTRY = r"^(\d{2}/\d{2}/\d{4})\s+(.+?)\s+(-)?\s*R\$\s*(-)?\s*([\d.]+,\d{2})\s*$"
_HEADER = r"^data\b.*\b(valor|descric)"
_NOISE = rf"^\s*$|{_HEADER}|^descricao$|^valor$|^data$|^pagina\s+\d+"


def is_statement(body: Column) -> Column:
    """Issuer and title and column names."""
    key = F.lower(text.plain(body))
    # fixed values: the issuer's names, the title and the column names
    return key.rlike("pagseguro|pagbank") & key.rlike("extrato da conta") & key.rlike(r"\bdata\b") & key.rlike(r"\bvalor\b") & key.rlike("descric")


def words_to_lines(words: DataFrame) -> DataFrame:
    """words: path, page, text, x0, top. A line is what rounds to one height, from left to right."""
    height = F.floor(F.col("top") + 0.5)
    lines = words.groupBy("path", "page", height.alias("line")).agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("_w"))
    return lines.select("path", "page", "line", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"))


def lines_to_pages(lines: DataFrame) -> DataFrame:
    pages = lines.groupBy("path", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_l"))
    return pages.select("path", "page", F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("text"))


def headers(pages: DataFrame) -> DataFrame:
    """path, account, period: the first line that shows each."""
    lines = pages.select("path", "page", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    at = F.struct("page", "n")
    # fixed values: how the bank writes issuer, account, branch and period
    pick = lambda p: F.min_by(F.trim(F.regexp_extract("line", p, 1)), F.when(F.col("line").rlike(p), at))
    period = F.min_by("line", F.when(F.col("line").rlike("(?i)per[ií]odo"), at))
    found = lines.groupBy("path").agg(pick(r"^\s*\d{3}\s*-\s*(.+?)\s*$").alias("_issuer"), pick(r"(?i)Conta\s+([\d.-]+)").alias("_number"), pick(r"(?i)Ag[êe]ncia\s+([\d-]+)").alias("branch"), period.alias("_p"), F.bool_or(F.lower("line").contains("pagbank")).alias("_b"))
    bank = F.coalesce(F.nullif("_issuer", F.lit("")), F.when(F.col("_b"), "PagBank").otherwise("PagSeguro Internet S/A"))
    days = F.regexp_extract_all(F.coalesce("_p", F.lit("")), F.lit(r"\d{2}/\d{2}/\d{4}"), F.lit(0))
    return found.select("path", "branch", text.account_ref(bank, F.col("_number")).alias("account"), dates.parse_br(F.get(days, F.lit(0))).alias("period_from"), dates.parse_br(F.get(days, F.lit(1))).alias("period_to"))


def read_lines(pages: DataFrame) -> DataFrame:
    """A row a line of the tables: an entry, a day's balance (is_close), another balance (is_anchor), or unread."""
    lines = pages.select("path", "page", F.posexplode(F.split("text", r"\r?\n")).alias("n", "_raw"))
    lines = spread(lines, "path", "page")
    lines = apart(lines, {"line": text.one_line(F.col("_raw"))}, "path", "page", "n")
    lines = apart(lines, {"_entry": F.col("line").rlike(_ENTRY), "_key": F.lower(text.plain(F.col("line")))})
    lines = apart(lines, {"_opens": F.col("_entry") | F.col("_key").rlike(_HEADER), "_noise": F.col("_key").rlike(_NOISE)}, "path", "page", "n", "line", "_entry")
    inside = F.max("_opens").over(W.partitionBy("path", "page").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("_in", inside).where("_in and not _noise")
    # the pattern is matched once for each of its parts, and what is made of a part once a line
    part = lambda i: F.when(F.col("_entry"), F.regexp_extract("line", _ENTRY, i)).otherwise("")
    rows = apart(rows, {f"_{i}": part(i) for i in range(1, 6)}, "path", "page", "n", "line", "_entry")
    rows = apart(rows, {"_d": dates.parse_br(F.col("_1")), "description": text.one_line(F.col("_2")), "_cents": money.parse_plain_brl(F.col("_5")), "_minus": (F.col("_3") == "-") | (F.col("_4") == "-")}, "path", "page", "n", "line", "_entry")
    rows = apart(rows, {"_key": F.trim(F.lower(text.plain(F.col("description"))))})
    rows = apart(rows, {"is_unread": ~F.col("_entry") | F.col("_d").isNull(), "signed_cents": F.when(F.col("_minus"), -F.col("_cents")).otherwise(F.col("_cents")), "is_close": F.col("_key").rlike(r"^saldo do dia\b"), "is_anchor": F.col("_key").rlike(r"^saldo\s+(anterior|inicial|final|em conta|atual|disponivel)")})
    return rows.select("path", "page", "n", "line", "_d", "description", "is_unread", "signed_cents", "is_close", "is_anchor")


def transactions(pages: DataFrame, rows: DataFrame) -> DataFrame:
    order = F.row_number().over(W.partitionBy("path").orderBy("page", "n")) - 1
    entries = rows.where("not is_unread and not is_close and not is_anchor").withColumn("source_order", order.cast("long"))
    return entries.join(headers(pages), "path").select(
        "path", "source_order", F.col("_d.date").alias("date"), F.col("_d.y").alias("y"), F.col("_d.m").alias("m"), F.col("_d.d").alias("d"), "description",
        F.when(F.col("signed_cents") < 0, "debit").otherwise("credit").alias("direction"), F.abs("signed_cents").alias("amount_cents"), F.col("line").alias("raw_line"), F.col("account.id").alias("account_id"), "account",
    )


def audit(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a file: days whose balance follows from the one before, and verdict. The first anchor stands in for a day before the first."""
    good = rows.where("not is_unread")
    place = W.partitionBy("path").orderBy("page", "n")
    known = F.coalesce(F.max(F.col("is_close") | F.col("is_anchor")).over(place.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    good = good.withColumns({"_first": F.col("is_anchor") & ~known, "line_no": F.row_number().over(place)})
    moves = good.where("not is_anchor or _first").select("path", "line_no", (F.col("is_close") | F.col("_first")).alias("is_close"), F.col("signed_cents").alias("balance_cents"), F.col("signed_cents").alias("amount_cents"))
    # entries before the first anchor count towards the first closing, as a sheet without an anchor has nothing to check them with
    days = proof.day_close(moves, "path", "line_no").groupBy("path").agg(F.count_if(F.col("expected_cents").isNotNull()).alias("days_checked"), F.count_if(~F.col("agrees")).alias("days_bad"))
    head = headers(pages)
    day = lambda c: F.struct(f"{c}.y", f"{c}.m", f"{c}.d")
    out_of = (F.col("period_from").isNotNull() & (day("_d") < day("period_from"))) | (F.col("period_to").isNotNull() & (day("_d") > day("period_to")))
    entry = ~F.col("is_unread") & ~F.col("is_close") & ~F.col("is_anchor")
    n = rows.join(head, "path").groupBy("path").agg(F.count_if(entry).alias("n_tx"), F.count_if("is_unread").alias("n_unread"), F.count_if(entry & out_of).alias("n_out_of_period"))
    out = n.join(days, "path", "left").fillna(0, ["days_checked", "days_bad"])
    reason = (
        F.when(F.col("n_tx") == 0, "no transaction recognised").when(F.col("days_checked") == 0, "no day balance to check").when(F.col("days_bad") > 0, "day balance does not follow")
        .when(F.col("n_out_of_period") > 0, "dates out of period").when(F.col("n_unread") > 0, "lines not read")
    )
    return out.withColumns({"reason": reason, "trusted": reason.isNull()})
