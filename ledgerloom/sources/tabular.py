"""Delimited or sheet statements with a balance before and after each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions.steps import apart, held, spread, then
from ..operators import proof

# The headers of each role, exact after dropping case and accents.
ROLES = {
    "movement": ("movimentacao", "movimento", "sentido"),
    "kind": ("tipo", "tipo de transacao", "modalidade"),
    "value": ("valor", "valor da transacao", "montante"),
    "before": ("saldo antes", "saldo anterior", "saldo inicial"),
    "after": ("saldo depois", "saldo posterior", "saldo final", "saldo apos"),
    "fee": ("tarifa", "taxa", "tarifas"),
    "date": ("data", "data da transacao", "data hora"),
    "status": ("situacao", "status"),
    "description": ("descricao", "historico", "observacao"),
    "to": ("destino",),
    "to_bank": ("destino instituicao",),
    "to_account": ("destino conta",),
    "from": ("origem",),
    "from_bank": ("origem instituicao",),
    "from_account": ("origem conta",),
}
#: Unread lines of a file that are told.
DETAILS = 8
NEEDED = ("date", "value", "before", "after", "movement")


def with_roles(cells: DataFrame) -> DataFrame:
    """path, row_no, raw, and a column for each role ('' where a file lacks it); files without the needed roles are left out.

    Each file has its own header row, which is joined to its rows: files of different layouts go through one plan. Roles are found
    once for each distinct header: a bank's files share one.
    """
    headers = cells.where("row_no = 0").select("path", F.col("cells").alias("_header"))

    def first(names: tuple[str, ...]) -> Column:
        return F.coalesce(F.array_min(F.filter(F.array(*[F.array_position("_h", F.lit(n)) for n in names]), lambda p: p > 0)), F.lit(0))

    known = apart(headers.select("_header").distinct(), {"_h": F.transform("_header", text.label_key)})
    known = apart(known, {f"_{r}": first(names).cast("int") for r, names in ROLES.items()}, "_header")
    known = known.where(" and ".join(f"_{r} > 0" for r in NEEDED))
    rows = proof.in_segments(cells.where("row_no > 0"), "row_no").join(headers.join(known, "_header").drop("_header"), "path")
    cell = lambda r: F.when(F.col(f"_{r}") > 0, F.coalesce(F.get("cells", F.col(f"_{r}") - 1), F.lit(""))).otherwise("")
    return then(rows.select("path", "row_no", "_segment", "cells", *[F.col(f"_{r}") for r in ROLES]), {"raw": text.one_line(F.array_join("cells", " | "))} | {r: cell(r) for r in ROLES}, "path", "row_no", "_segment")


def read_rows(cells: DataFrame) -> DataFrame:
    """A row a statement line, with parsed amounts and `unread`, the reason why it could not be read (null if it could)."""
    # one shuffle for the parsing and for the proof that may follow: few files, or one that is huge, are the work of many tasks; and what is
    # before it and after it are two stages of code, each of a size that the JVM compiles
    rows = then(spread(with_roles(cells), "path", "_segment"), {"_d": dates.parse_loose(F.col("date")), "_label": text.label_key(F.col("movement"))})
    cells_ = {"_v": "value", "_b": "before", "_a": "after", "_f": "fee"}
    rows = then(rows, {f"{n}t": money.cell_text(F.col(c)) for n, c in cells_.items()})
    rows = then(rows, {f"{n}n": money.cell_number(F.col(f"{n}t")) for n in cells_})
    rows = then(rows, {n: money.cell_amount(F.col(f"{n}t"), F.col(f"{n}n")) for n in cells_})
    label = F.col("_label")
    bad = lambda c: F.col(f"{c}.status") != "ok"
    unread = F.when(F.col("_d").isNull(), "date").when(bad("_v"), "value").when(bad("_b") | bad("_a"), "balance").when(F.col("_f.status") == "bad", "fee")
    says_in, says_out = F.startswith(label, F.lit("cred")) | F.startswith(label, F.lit("entrada")), F.startswith(label, F.lit("deb")) | F.startswith(label, F.lit("saida"))
    positive = F.col("_v.cents") >= 0
    return then(
        rows, {
            "unread": held(unread), "value_cents": F.col("_v.cents"), "before_cents": F.col("_b.cents"), "after_cents": F.col("_a.cents"), "fee_cents": F.abs(F.coalesce("_f.cents", F.lit(0))),
            "incoming": says_in | (~says_out & positive), "contradicts": (says_in | says_out) & (says_in != positive), "credit": F.startswith(label, F.lit("cred")),
        },
    )


def accounts(rows: DataFrame) -> DataFrame:
    """path, account: the institution and number that most rows name."""
    own = rows.select("path", "row_no", F.when(F.col("credit"), F.col("to_bank")).otherwise(F.col("from_bank")).alias("bank"), F.when(F.col("credit"), F.col("to_account")).otherwise(F.col("from_account")).alias("number"))
    # one pass over the rows: few distinct values are left of each file
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.trim(c).alias("value")) for c in ("bank", "number")]))
    n = own.select("path", "row_no", both.alias("x")).select("path", "row_no", "x.*").groupBy("path", "what", "value").agg(F.count("*").alias("n"), F.min("row_no").alias("_first"))
    n = then(n, {"_key": text.label_key(F.coalesce("value", F.lit("")))})
    named = ~F.col("_key").isin(*text.NOBODY)
    best = lambda c: F.min_by("value", F.when(named & (F.col("what") == c), F.struct(-F.col("n"), F.col("_first")))).alias(c)
    return then(n.groupBy("path").agg(best("bank"), best("number")), {"account": text.account_ref(F.col("bank"), F.col("number"))}, "path")


def transactions(rows: DataFrame) -> DataFrame:
    """One transaction a row read, and one more for its fee."""
    other = F.when(F.col("incoming"), F.coalesce(F.nullif("from", F.lit("")), F.col("description"))).otherwise(F.coalesce(F.nullif("to", F.lit("")), F.col("description")))
    read = then(rows.where("unread is null"), {"_kind": text.label_key(F.col("kind")), "_other": other})
    read = then(read, {"_method": text.method_of(F.col("kind"), F.col("_kind"))})
    read = text.described(read, "_method", "_other", "incoming", "_text")
    main = F.struct(F.col("_text").alias("description"), F.when(F.col("incoming"), "credit").otherwise("debit").alias("direction"), F.abs("value_cents").alias("amount_cents"), F.lit(0).alias("part"))
    fee = F.when(F.col("fee_cents") > 0, F.struct(F.lit("Tarifa").alias("description"), F.lit("debit").alias("direction"), F.col("fee_cents").alias("amount_cents"), F.lit(1).alias("part")))
    each = read.withColumn("t", F.explode(F.filter(F.array(main, fee), lambda x: x.isNotNull())))
    order = F.row_number().over(W.partitionBy("path").orderBy("row_no", "t.part")) - 1
    out = each.select("path", order.cast("long").alias("source_order"), F.col("_d.date").alias("date"), F.col("_d.y").alias("y"), F.col("_d.m").alias("m"), F.col("_d.d").alias("d"), F.col("t.description").alias("description"), F.col("t.direction").alias("direction"), F.col("t.amount_cents").alias("amount_cents"), F.abs("after_cents").alias("balance_after_cents"), F.col("raw").alias("raw_line"))
    return out.join(accounts(rows), "path").select("*", F.col("account.id").alias("account_id"))


def audit(rows: DataFrame) -> DataFrame:
    """A row a file: what was read and proved, and whether that is enough to trust it."""
    read = F.col("unread").isNull()
    counted = {"n_unread": ~read, "contradictions": read & F.col("contradicts"), "n_fees": read & (F.col("fee_cents") > 0)}
    out = proof.balance_chain(rows, "path", "row_no", counted, read=read).withColumnRenamed("n_rows", "n_tx")
    return proof.trustworthy(out.select("path", "n_tx", *counted, "rows_ok", "rows_bad", "links_ok", "links_broken"))


def details(rows: DataFrame) -> DataFrame:
    """path, details: the first lines of each file that could not be read, with why."""
    said = rows.withColumn("_said", F.when(F.col("unread").isNotNull(), F.concat(F.lit("row "), F.col("row_no").cast("string"), F.lit(": "), "unread", F.lit(": "), F.substring("raw", 1, 120))))
    return proof.first_details(said, "path", "row_no", "_said", DETAILS)
