"""Amounts as whole cents: parsers that never fail, and the printed form.

A parser returns struct(cents bigint, status string): ok, absent (no value is meant) or bad (unreadable, cents null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, label_key

_WIDEST = "decimal(28,10)"


def _result(cents: Column, absent: Column) -> Column:
    status = F.when(absent, "absent").when(cents.isNull(), "bad").otherwise("ok")
    return F.struct(F.when(~absent, cents).alias("cents"), status.alias("status"))


def to_cents(number: Column) -> Column:
    """Half up, away from float error: through decimals."""
    return F.round(number.cast(_WIDEST) * 100, 0).cast("long")


def _decimal(text: Column) -> Column:
    return text.try_cast(_WIDEST)


def parse_brl(raw: Column) -> Column:
    """`R$ 1.234,56`, `-R$ 10`, `(R$ 5,00)`: struct(cents, status, negative). Without comma or two decimals it is whole reais."""
    text = F.trim(raw)
    negative = text.rlike(r"^-|\(\s*R\$|-\s*R\$")
    number = F.regexp_replace(F.regexp_replace(text, r"(?i)R\$", ""), rf"[()\-]|{SPACES}", "")
    lead = lambda x: F.nullif(F.regexp_extract(x, r"^(\d+\.?\d*|\.\d+)", 1), F.lit(""))
    comma = to_cents(_decimal(lead(F.regexp_replace(F.regexp_replace(number, r"\.", ""), "^([^,]*),", "$1."))))
    decimals = to_cents(_decimal(lead(number)))
    whole = _decimal(F.nullif(F.regexp_extract(F.regexp_replace(number, r"\.", ""), r"^\d+", 0), F.lit(""))).cast("long") * 100
    cents = F.when(F.contains(number, F.lit(",")), comma).when(number.rlike(r"\.\d{2}$"), decimals).otherwise(whole)
    status = F.when(cents.isNull(), "bad").otherwise("ok")
    return F.struct(cents.alias("cents"), status.alias("status"), F.coalesce(negative, F.lit(False)).alias("negative"))


# Cells that say that there is no value.
NO_VALUE = ("", "-", "--", "gratis", "isento", "desconhecido", "n/a", "na", "naoseaplica")


#: The usual form of an amount, which needs no clearing of accents and blanks.
_USUAL = r"^-?(?:R\$ ?)?[\d.]{1,19},\d\d$"


def cell_text(raw: Column) -> Column:
    """A cell of a statement table in lower case, without accents, currency and blanks; the usual form as it is."""
    long_way = F.regexp_replace(F.regexp_replace(label_key(raw), r"r\$", ""), SPACES, "")
    return F.when(raw.isNull(), "").when(raw.rlike(_USUAL), raw).otherwise(long_way)


def cell_number(text: Column) -> Column:
    """Digits, dots and commas of a cell_text."""
    return F.regexp_replace(text, r"[()+\-]|R\$ ?", "")


def cell_amount(text: Column, number: Column) -> Column:
    """struct(cents, status) of a cell_text and its cell_number."""
    good = number.rlike(r"^\d{1,3}(\.\d{3})*(,\d{1,2})?$|^\d+(,\d{1,2})?$|^\d+(\.\d{1,2})?$")
    canonical = F.when(F.contains(number, F.lit(",")), F.replace(F.regexp_replace(number, r"\.", ""), F.lit(","), F.lit("."))).otherwise(number)
    # two decimals and few digits: the digits are the cents
    cents = F.when(good, F.when(number.rlike(r"^[\d.]{1,19},\d\d$"), F.regexp_replace(number, "[.,]", "").try_cast("long")).otherwise(to_cents(_decimal(canonical))))
    return _result(F.when(text.rlike(r"^[-(]"), -cents).otherwise(cents), text.isin(*NO_VALUE))


def parse_cell(raw: Column) -> Column:
    """A signed cell of a statement table: struct(cents, status). Many cells of a row go by its three steps, each apart."""
    text = cell_text(raw)
    return cell_amount(text, cell_number(text))


def parse_ofx(raw: Column) -> Column:
    """Signed, comma or dot decimals: struct(cents, status)."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), SPACES, "")
    number = F.regexp_replace(text, r"^[+-]", "")
    number = F.when(F.contains(number, F.lit(",")), F.regexp_replace(F.regexp_replace(number, r"\.", ""), "^([^,]*),", "$1.")).otherwise(number)
    cents = F.when(number.rlike(r"^\d+(\.\d+)?$"), to_cents(_decimal(number)))
    return _result(F.when(F.startswith(text, F.lit("-")), -cents).otherwise(cents), F.lit(False))


def parse_plain_brl(text: Column) -> Column:
    """`1.234,56` of a line that a pattern has matched: cents."""
    return to_cents(_decimal(F.replace(F.regexp_replace(text, r"\.", ""), F.lit(","), F.lit("."))))


def format_brl(cents: Column) -> Column:
    """`R$ 1.234,56`."""
    a = F.abs(cents)
    whole = F.translate(F.format_number(F.floor(a / 100), 0), ",", ".")
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("R$ "), whole, F.lit(","), F.lpad((a % 100).cast("string"), 2, "0"))


def clamp_width(width: Column) -> Column:
    return F.least(F.greatest(F.round(width, 2), F.lit(9.0)), F.lit(58.0))
