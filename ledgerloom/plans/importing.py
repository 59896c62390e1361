"""Import of statements: read, prove, drop what is recorded, categorise, place, report, and append to the ledger.

One plan over all files and months: the month is a column, not a loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.steps import stored
from ..operators import dedup, ledger, report, rules
from ..sources import extractor as port
from ..sources import files, ofx, pages, tabular, workbook
from ..sources.extractor import Extractor


@dataclass
class Reading:
    """transactions of the files that were proved; audit: a row a file with trusted and reason; extracted: what an extractor read of texts and
    sheets that are no statement of a known form. Nothing proves it, so it is kept apart for the user to confirm."""

    transactions: DataFrame
    audit: DataFrame
    extracted: DataFrame | None = None


class Parser(Protocol):
    """A reader of one more form of statement. It works on a DataFrame of all files of its form, not on one file."""

    #: What the audit calls its files.
    name: str

    def can_parse(self, path: Column, content: Column, kind: Column) -> Column:
        """Whether a file is of its form; kind is what the library takes it for."""

    def parse(self, found: DataFrame) -> DataFrame:
        """found: path, content. path, source_order, date, description, direction, amount_cents, account_id, and raw_line if there is one. A row
        without date or amount says that the file can't be read whole."""


#: What a parser's transactions must have, by type.
PARSED = {"path": "string", "source_order": "bigint", "date": "date", "description": "string", "direction": "string", "amount_cents": "bigint", "account_id": "string"}
NOT_WHOLE, NOTHING = "a row could not be read", "no transaction"


def read_by_parsers(found: DataFrame, parsers: Sequence[Parser]) -> tuple[DataFrame, DataFrame] | None:
    """Transactions of the files that parsers claimed (found: path, content, parser), and their audit: a file is trusted if it has transactions
    and each has date, direction and amount. None without parsers."""
    rows = None
    for p in parsers:
        own = p.parse(found.where(F.col("parser") == p.name).select("path", "content"))
        if missing := [c for c in PARSED if c not in own.columns]:
            raise ValueError(f"parser {p.name} gives no {', '.join(missing)}")
        raw = F.col("raw_line").cast("string") if "raw_line" in own.columns else F.lit(None).cast("string")
        own = own.select(*[F.col(c).cast(t).alias(c) for c, t in PARSED.items()], raw.alias("raw_line"))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return None
    rows = stored(rows)
    whole = F.col("date").isNotNull() & F.col("amount_cents").isNotNull() & F.coalesce(F.col("direction").isin("credit", "debit"), F.lit(False))
    n = rows.groupBy("path").agg(F.count("*").alias("n_tx"), F.count_if(~whole).alias("_bad"))
    audit = found.where("parser is not null").select("path", "parser").join(n, "path", "left")
    reason = F.when(F.coalesce("n_tx", F.lit(0)) == 0, NOTHING).when(F.col("_bad") > 0, NOT_WHOLE)
    audit = audit.select("path", F.coalesce("n_tx", F.lit(0)).cast("long").alias("n_tx"), F.when(reason.isNotNull(), F.concat(F.col("parser"), F.lit(": "), reason)).alias("reason"), reason.isNull().alias("trusted"))
    return rows.withColumns({"y": F.year("date"), "m": F.month("date"), "d": F.dayofmonth("date")}), audit


def read_statements(spark: SparkSession, path: str, extractor: Extractor | None = None, parsers: Sequence[Parser] = ()) -> Reading:
    """Every file under a path by its kind. Files whose proof fails bring no transaction; their reason is in the audit. A file that a parser claims
    (the first of them) is its alone; parsers aren't asked about delimited files of files.LARGE bytes and more, which are read in ranges."""
    if len({p.name for p in parsers}) < len(parsers):
        raise ValueError("parsers need names of their own")
    found, large = files.load(spark, path, files.LARGE), files.large_paths(spark, path)
    found = found.withColumn("kind", files.kind(F.col("content"), F.col("path")))
    claims = [F.when(p.can_parse(F.col("path"), F.col("content"), F.col("kind")), p.name) for p in parsers]
    found = found.withColumn("parser", F.coalesce(*claims, F.lit(None).cast("string")))
    found = found.withColumn("kind", F.when(F.col("parser").isNull(), F.col("kind")).otherwise("parser"))
    parsed = read_by_parsers(found, parsers)
    texts = files.with_text(found.where("kind in ('text', 'ofx')"))
    blocks = ofx.blocks(texts.where("kind = 'ofx'"))
    # workbooks go by their bytes, whatever their names end in
    sheets = workbook.rows_of(workbook.cells(found.where("kind = 'spreadsheet'"), sheet_no=0))
    cells = files.tables(texts.where("kind = 'text'")).unionByName(sheets)
    if large:
        cells = cells.unionByName(files.large_tables(spark, large))
    # read once, and used for the proof, the accounts and the transactions
    rows = stored(tabular.read_rows(stored(cells)))
    audits = tabular.audit(rows).select("path", "n_tx", "reason", "trusted").unionByName(ofx.audit(texts.where("kind = 'ofx'"), blocks).select("path", "n_tx", "reason", "trusted"))
    columns = ["path", "source_order", "date", "y", "m", "d", "description", "direction", "amount_cents", "raw_line", "account_id"]
    tx = tabular.transactions(rows).select(*columns).unionByName(ofx.transactions(blocks).select(*columns))
    if parsed:
        tx, audits = tx.unionByName(parsed[0].select(*columns)), audits.unionByName(parsed[1])
    known = found.select("path", "kind")
    if large:
        known = known.unionByName(rows.sparkSession.createDataFrame([(p, "text") for p in large], "path string, kind string"))
    others = known.join(audits.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("n_tx"), F.concat(F.lit("not a statement that can be proved: "), "kind").alias("reason"), F.lit(False).alias("trusted"))
    extracted = None
    if extractor is not None:
        lines = sheets.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.array_join("cells", " | ").alias("l")))), lambda x: x["l"]), "\n").alias("text"))
        unknown = texts.where("kind = 'text'").select("path", "text").unionByName(lines).join(others.select("path"), "path", "left_semi")
        extracted, told = read_by_extractor(unknown, extractor)
        others = others.join(told.select("path"), "path", "left_anti").unionByName(told)
    return Reading(tx.join(audits.where("trusted").select("path"), "path", "left_semi"), audits.unionByName(others), extracted)


def read_by_extractor(texts: DataFrame, extractor: Extractor) -> tuple[DataFrame, DataFrame]:
    """Transactions that the extractor reads of texts (path, text), in the order of blocks and lines, and an audit row for each: never trusted; a
    file of which no block could be read has its first error as the reason. Answers are written, so that no action and no lost executor asks twice."""
    found = stored(port.extract(port.blocks(texts), extractor))
    good = port.settled(found).withColumn("date", F.to_date("date"))
    order = (F.row_number().over(W.partitionBy("path").orderBy("block", "line")) - 1).cast("long")
    none = F.lit(None).cast("string")
    rows = good.select("path", order.alias("source_order"), "date", F.year("date").alias("y"), F.month("date").alias("m"), F.dayofmonth("date").alias("d"), "description", "direction", "amount_cents", none.alias("raw_line"), none.alias("account_id"))
    errors = found.groupBy("path").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("block"))).alias("_e"))
    n = rows.groupBy("path").agg(F.count("*").alias("n_tx"))
    out = texts.select("path").join(n, "path", "left").join(errors, "path", "left").withColumn("n_tx", F.coalesce("n_tx", F.lit(0)))
    reason = F.when(F.col("n_tx") > 0, F.when(F.col("_e").isNotNull(), F.concat(F.lit("read in part by the extractor, not proved: "), "_e")).otherwise("read by the extractor, not proved")).otherwise(F.coalesce("_e", F.lit("the extractor found no transaction")))
    return rows, out.select("path", "n_tx", reason.alias("reason"), F.lit(False).alias("trusted"))


def read_pages(page_texts: DataFrame) -> Reading:
    """Statements as page text (path, page, text)."""
    rows = pages.read_lines(page_texts)
    audit = pages.audit(page_texts, rows)
    return Reading(pages.transactions(page_texts, rows).join(audit.where("trusted").select("path"), "path", "left_semi"), audit.select("path", "n_tx", "reason", "trusted"))


@dataclass
class Import:
    rows: DataFrame
    report: DataFrame
    missing: DataFrame


def plan_import(tx: DataFrame, known: DataFrame, existing: DataFrame, sheets: DataFrame, options: DataFrame | None = None, user_rules: DataFrame | None = None) -> Import:
    """rows: every transaction with its status and category. report: a row a month. missing: months without a sheet, of which nothing is written."""
    found = dedup.deduplicate(tx, known, existing)
    missing = report.missing_sheets(tx, sheets)
    absent = missing.select("competence_key", F.lit(True).alias("_absent"))
    found = found.join(absent, "competence_key", "left").withColumn("status", F.when(F.col("_absent") & (F.col("status") == "new"), "no_sheet").otherwise(F.col("status"))).drop("_absent")
    if options is not None and user_rules is not None:
        asked = found.select(F.col("hash").alias("tx_id"), "description", F.when(F.col("direction") == "credit", "in").otherwise("out").alias("flow"), "amount_cents", "account_id")
        decided = rules.decide(asked, user_rules, options).select(F.col("tx_id").alias("hash"), F.col("option").alias("category"), "decided_by")
        found = found.join(decided, "hash", "left")
    is_new = F.col("status") == "new"
    months = found.groupBy("competence_key").agg(
        F.count_if(is_new).alias("n_new"), F.count_if(F.col("status").isin("known_hash", "recorded")).alias("n_duplicates"), F.count_if("name_differs").alias("n_name_differs"), F.count_if(F.col("status") == "no_sheet").alias("n_no_sheet"),
        F.sum(F.when(is_new & (F.col("direction") == "credit"), F.col("amount_cents")).otherwise(0)).alias("in_cents"), F.sum(F.when(is_new & (F.col("direction") == "debit"), F.col("amount_cents")).otherwise(0)).alias("out_cents"),
    )
    return Import(found, months, missing)


def run_import(tx: DataFrame, ledger_path: str, existing: DataFrame, sheets: DataFrame, write=None, dry_run: bool = False, ledger_on_failure: bool = False, **rule_args) -> Import:
    """Plans an import and, unless dry_run, hands the new rows to write(df) and then appends them to the ledger.

    A failed write leaves the ledger alone; ledger_on_failure appends all the same, and the failure is still raised.
    """
    plan = plan_import(tx, ledger.load(tx.sparkSession, ledger_path), existing, sheets, **rule_args)
    if dry_run:
        return plan
    new = plan.rows.where("status = 'new'").withColumn("date", F.col("date"))
    error = None
    try:
        if write is not None:
            write(report.sheet_rows(new).withColumn("sheet", F.lit(None).cast("string")) if "sheet" not in new.columns else new)
    except Exception as e:
        if not ledger_on_failure:
            raise
        error = e
    ledger.append(new, ledger_path)
    if error:
        raise error
    return plan


def month_of(tx: DataFrame) -> DataFrame:
    return tx.withColumns({"competence_key": dates.competence(F.col("date")), "sheet": dates.month_sheet(F.col("date"))})
