"""Dates as year, month, day and, where the day exists, a date. 31/02 keeps its numbers and has no date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the months' sheets.
MONTHS = ("JANEIRO", "FEVEREIRO", "MARÇO", "ABRIL", "MAIO", "JUNHO", "JULHO", "AGOSTO", "SETEMBRO", "OUTUBRO", "NOVEMBRO", "DEZEMBRO")
_LOOSE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
# Sheets that hold no month.
SUPPORT_SHEETS = ("CATEGORIAS", "FLUXO DE CAIXA SIMPLIFICADO", "ANÁLISE")


def _once(value: Column, use) -> Column:
    """use(value), whose argument is computed once however often it occurs: a plain expression would be copied to each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _dated(digits: Column, year: int, month: int, day: int) -> Column:
    """struct(date, y, m, d) of an array of digits, which tells each at its place; two digits of a year are of this century."""

    def numbers(x: Column) -> Column:
        y = F.get(x, F.lit(year))
        return F.array(F.when(F.length(y) == 2, y.try_cast("int") + 2000).otherwise(y.try_cast("int")), F.get(x, F.lit(month)).try_cast("int"), F.get(x, F.lit(day)).try_cast("int"))

    return _once(digits, lambda x: _once(numbers(x), lambda n: _struct(*[F.get(n, F.lit(i)) for i in range(3)])))


def _struct(year: Column, month: Column, day: Column) -> Column:
    """struct(date, y, m, d), null if month or day is out of range."""
    ok = month.between(1, 12) & day.between(1, 31)
    last = F.when(month == 2, F.when(((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    date = F.when(year.between(1, 9999) & (day <= last), F.make_date(year, month, day))
    return F.when(ok, F.struct(date.alias("date"), year.alias("y"), month.alias("m"), day.alias("d")))


def parse_br(raw: Column) -> Column:
    """Strictly dd/mm/yy or dd/mm/yyyy."""
    return _dated(F.split(F.regexp_extract(F.trim(raw), r"^\d{2}/\d{2}/(\d{2}|\d{4})$", 0), "/"), 2, 1, 0)


def parse_loose(raw: Column) -> Column:
    """d/m/y or d-m-y anywhere in the text."""
    return _dated(F.split(F.regexp_extract(raw, _LOOSE, 0), "[/-]"), 2, 1, 0)


def reads_loosely(raw: Column) -> Column:
    """Whether parse_loose makes anything of a text, without taking it apart."""
    return F.coalesce(F.regexp_extract(raw, _LOOSE, 0).rlike(r"^(0?[1-9]|[12]\d|3[01])[/-](0?[1-9]|1[0-2])[/-]"), F.lit(False))


def parse_compact(raw: Column) -> Column:
    """yyyymmdd at the start; what follows (time, zone) doesn't count."""
    digits = F.regexp_extract(F.trim(raw), r"^\d{8}", 0)
    return _once(digits, lambda x: _dated(F.array(F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)), 0, 1, 2))


def iso(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y, m, d)


def brazilian(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


def sheet_serial(date: Column) -> Column:
    """Days since 1899-12-30."""
    return F.date_diff(date, F.lit("1899-12-30").cast("date"))


def from_serial(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def competence(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_sheet(date: Column) -> Column:
    """The month's name alone: the same sheet for any year."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(date))


def is_support_sheet(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, r"\s+", " ")).isin(*SUPPORT_SHEETS)


def unpadded(date: Column) -> Column:
    return F.concat_ws("-", F.year(date), F.month(date), F.day(date))
