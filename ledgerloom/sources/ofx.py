"""OFX statements, SGML or XML: blocks and tags by pattern, since version 1 is not well-formed XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions.steps import apart, held, spread, then
from ..operators import proof


def is_ofx(body: Column) -> Column:
    head = F.upper(F.substring(body, 1, 8192))
    return (F.contains(head, F.lit("OFXHEADER")) | F.contains(head, F.lit("<OFX>"))) & F.contains(F.upper(body), F.lit("<STMTTRN>"))


def tag(block: Column, name: str) -> Column:
    """Text of a leaf, up to the next tag; '' if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(block, f"(?i)<{name}>([^<]*)", 1), r"^\s+|\s+$", ""))


def blocks(texts: DataFrame) -> DataFrame:
    """A row a transaction block, with the header of its file and `unread`, the reason why it could not be read."""
    found = F.regexp_extract_all("text", F.lit(r"(?is)<STMTTRN>(.*?)</STMTTRN>"), F.lit(1))
    # tags are found once each, and what they say of a file is worked out once a file
    files = then(texts.where(is_ofx(F.col("text"))), {f"_{t}": tag(F.col("text"), t) for t in ("DTSTART", "DTEND", "ORG", "FID", "BANKID", "ACCTID")} | {"_blocks": found}, "path")
    bank = F.coalesce(F.nullif("_ORG", F.lit("")), F.nullif("_FID", F.lit("")), F.col("_BANKID"))
    files = then(files, {"_from": dates.parse_compact(F.col("_DTSTART")), "_to": dates.parse_compact(F.col("_DTEND")), "bank": bank}, "path", "_ACCTID", "_blocks").withColumnRenamed("_ACCTID", "number")
    files = then(files, {"account": text.account_ref(F.col("bank"), F.col("number"))})
    # a statement's blocks are the work of many tasks
    rows = files.select("*", F.posexplode("_blocks").alias("block_no", "block")).drop("_blocks")
    rows = spread(proof.in_segments(rows, "block_no"), "path", "_segment").drop("_segment")
    rows = apart(rows, {f"_{t}": tag(F.col("block"), t) for t in ("DTPOSTED", "TRNAMT", "TRNTYPE", "MEMO", "NAME")})
    rows = apart(rows, {"_d": dates.parse_compact(F.col("_DTPOSTED")), "_v": money.parse_ofx(F.col("_TRNAMT")), "kind": F.upper("_TRNTYPE"), "memo": F.coalesce(F.nullif("_MEMO", F.lit("")), F.col("_NAME"))})
    rows = rows.drop("_DTPOSTED", "_TRNAMT", "_TRNTYPE", "_MEMO", "_NAME")
    cents = F.col("_v.cents")
    unread = F.when(F.col("_d").isNull(), "date").when(F.col("_v.status") != "ok", "value").when(((F.col("kind") == "CREDIT") & (cents < 0)) | ((F.col("kind") == "DEBIT") & (cents >= 0)), "direction")
    day = lambda c: F.struct(f"{c}.y", f"{c}.m", f"{c}.d")
    out = (F.col("_from").isNotNull() & (day("_d") < day("_from"))) | (F.col("_to").isNotNull() & (day("_d") > day("_to")))
    return then(rows, {"unread": held(unread), "out_of_period": unread.isNull() & out, "raw_line": F.substring(text.one_line(F.col("block")), 1, 120)})


def transactions(rows: DataFrame) -> DataFrame:
    incoming = F.col("_v.cents") >= 0
    rows = text.memo_described(rows.where("unread is null").withColumn("_in", incoming), "memo", "_in")
    return rows.select(
        "path", F.col("block_no").cast("long").alias("source_order"), F.col("_d.date").alias("date"), F.col("_d.y").alias("y"), F.col("_d.m").alias("m"), F.col("_d.d").alias("d"), "description",
        F.when(incoming, "credit").otherwise("debit").alias("direction"), F.abs("_v.cents").alias("amount_cents"), "raw_line", F.col("account.id").alias("account_id"), "account",
    )


def details(rows: DataFrame, most: int = 6) -> DataFrame:
    """path, details: the first blocks of each file that could not be read, with why."""
    said = rows.withColumn("_said", F.when(F.col("unread").isNotNull(), F.concat(F.lit("block "), (F.col("block_no") + 1).cast("string"), F.lit(": "), "unread", F.lit(": "), "raw_line")))
    return proof.first_details(said, "path", "block_no", "_said", most)


def audit(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a file: declared and read blocks, leftover tags of its list, final balance, verdict."""
    listed = F.regexp_extract("text", r"(?is)<BANKTRANLIST>(.*?)</BANKTRANLIST>", 1)
    rest = F.regexp_replace(listed, r"(?is)<STMTTRN>.*?</STMTTRN>", "")
    left = F.array_except(F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(r"(?i)</?([A-Z0-9.]+)>"), F.lit(1)), F.upper)), F.array(F.lit("DTSTART"), F.lit("DTEND"), F.lit("BANKTRANLIST")))
    balance = money.parse_ofx(F.regexp_extract("text", r"(?is)<LEDGERBAL>.*?<BALAMT>([^<\s]*)", 1))["cents"]
    declared = F.regexp_count("text", F.lit(r"(?is)<STMTTRN>.*?</STMTTRN>"))
    files = texts.where(is_ofx(F.col("text"))).select("path", declared.alias("declared"), left.alias("leftover"), balance.alias("final_balance_cents"))
    n = rows.groupBy("path").agg(F.count_if(F.col("unread").isNull()).alias("n_tx"), F.count_if(F.col("unread").isNotNull()).alias("n_unread"), F.count_if("out_of_period").alias("n_out_of_period"))
    out = files.join(n, "path", "left").fillna(0, ["n_tx", "n_unread", "n_out_of_period"])
    reason = (
        F.when(F.col("declared") == 0, "no transaction block").when(F.col("n_unread") > 0, "blocks not read").when(F.size("leftover") > 0, "tags not understood")
        .when(F.col("n_out_of_period") > 0, "dates out of period").when(F.col("n_tx") != F.col("declared"), "not confirmed")
    )
    return out.withColumns({"reason": reason, "trusted": reason.isNull()})
