"""Workbooks (OOXML) as a table of cells.

load() gives path, sheet, sheet_no, row, col, kind, value, style (number format code, or the id of a built-in one) and formula of every filled cell.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import cached_property, partial
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.steps import apart

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_REF = re.compile(r"([A-Z]+)(\d+)")
#: What a cell is told by.
CELL = ("row", "col", "kind", "value", "style", "formula")
SCHEMA = "path string, sheet string, sheet_no int, row int, col string, kind string, value string, style string, formula string"
# Built-in number format ids that an inspection takes for dates and for money, and those that a table shows as dates.
DATE_IDS = (14, 15, 16, 17, 22, 27, 30, 36, 45, 46, 47, 50, 57, 58)
MONEY_IDS = (5, 6, 7, 8, 42, 43, 44)
SHOWN_DATE_IDS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)


class Book:
    """An open workbook. Its shared strings and styles are read when they are first asked for, its sheets one by one."""

    def __init__(self, z: zipfile.ZipFile):
        self.z, self.names = z, set(z.namelist())

    @cached_property
    def sheets(self) -> list[tuple[int, str, str]]:
        return list(_sheets(self.z))

    @cached_property
    def shared(self) -> list[str]:
        found: list[str] = []
        if "xl/sharedStrings.xml" in self.names:
            with self.z.open("xl/sharedStrings.xml") as f:
                for si in _ended(f, "sst", "si"):
                    found.append(_text(si))
        return found

    @cached_property
    def styles(self) -> list[str]:
        if "xl/styles.xml" not in self.names:
            return []
        root = ET.fromstring(self.z.read("xl/styles.xml"))
        codes = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iterfind(".//m:numFmts/m:numFmt", _NS)}
        ids = [int(xf.get("numFmtId") or 0) for xf in root.iterfind(".//m:cellXfs/m:xf", _NS)]
        return [codes.get(n) or str(n) for n in ids]

    def cells(self, target: str, wanted: Callable[[int, str], bool] | None = None, columns: tuple[str, ...] = CELL) -> Iterator[tuple]:
        """row, col, kind, value, style and formula of a sheet's filled cells, row by row of its XML. wanted(row, col): cells to tell of. What isn't
        among the columns is null and, if nothing else needs it, not looked up: no shared string is read for a count of cells."""
        told, said, styled = "formula" in columns or "kind" in columns, "value" in columns or "kind" in columns, "style" in columns
        masters: dict[str, tuple[str, int]] = {}
        with self.z.open(target) as f:
            for line in _ended(f, "sheetData", "row"):
                for c in line.iterfind("m:c", _NS):
                    ref = _REF.fullmatch(c.get("r") or "")
                    if not ref:
                        continue
                    row, col, formula = int(ref[2]), ref[1], None
                    fx = c.find("m:f", _NS) if told else None
                    if fx is not None:
                        formula = fx.text
                        if fx.get("t") == "shared":  # the first cell of a group has the text, the others point to it
                            if formula:
                                masters.setdefault(fx.get("si"), (formula, row))
                            elif fx.get("si") in masters:
                                from ..operators.inference import shift_formula

                                formula = shift_formula(masters[fx.get("si")][0], row - masters[fx.get("si")][1])
                    if wanted is not None and not wanted(row, col):
                        continue
                    kind_, text, style = c.get("t"), None, None
                    if said:
                        v, inline = c.find("m:v", _NS), c.find("m:is", _NS)
                        raw = v.text if v is not None else None
                        text = self.shared[int(raw)] if kind_ == "s" and raw else _text(inline) if inline is not None else raw
                    if styled and (n := int(c.get("s") or -1)) >= 0 and n < len(self.styles):
                        style = self.styles[n]
                    kind = "formula" if formula else "empty" if text in (None, "") else "text" if kind_ in ("s", "inlineStr", "str") else "number"
                    yield row, col, kind, text, style, formula


def _text(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter(f"{{{_NS['m']}}}t"))


def _ended(f, parent: str, name: str) -> Iterator[ET.Element]:
    """Elements of this name as they end; what the parent holds is dropped after each, so that memory doesn't grow with the sheet."""
    above = None
    for event, e in ET.iterparse(f, ("start", "end")):
        if event == "start":
            if e.tag == f"{{{_NS['m']}}}{parent}":
                above = e
        elif e.tag == f"{{{_NS['m']}}}{name}":
            yield e
            if above is not None:
                above.clear()


def cells_of(path: str, content: bytes, sheet_no: int | None = None) -> Iterator[tuple]:
    """Every filled cell of a workbook, or of one of its sheets, sheet by sheet; a sheet's XML is parsed as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = Book(z)
        for no, name, target in book.sheets:
            if sheet_no in (None, no):
                for cell in book.cells(target):
                    yield path, name, no, *cell


def load(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every workbook under a path that Spark can read."""
    return cells(spark.read.format("binaryFile").load(path).select("path", "content"))


def cells(files: DataFrame, sheet_no: int | None = None) -> DataFrame:
    """files: path, content. A file is one task's work (workbook_source deals sheets to tasks); cells come out as a stream of batches. With
    sheet_no only that sheet is unpacked. A file that is no workbook has none."""
    return _read(files, partial(cells_of, sheet_no=sheet_no), SCHEMA)


def _read(files: DataFrame, each: Callable[[str, bytes], Iterator[tuple]], columns: str) -> DataFrame:
    import pyarrow as pa

    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in columns.split(", "))])

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                try:
                    for row in each(p, content):
                        rows.append(row)
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                except (zipfile.BadZipFile, KeyError, ET.ParseError):  # broken, or a ZIP of something else
                    pass
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, columns)


VALIDATIONS = "path string, sheet string, sheet_no int, sqref string, formula string, later boolean"


def validations_of(path: str, content: bytes) -> Iterator[tuple]:
    """The lists to choose from that a workbook's sheets define, of both forms: range and formula of each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for no, name, target in _sheets(z):
            with z.open(target) as f:
                for _, e in ET.iterparse(f):
                    tag = e.tag.rsplit("}", 1)[-1]
                    if tag == "dataValidation" and e.get("type") == "list":
                        find = lambda *names, e=e: next((x.text for x in e.iter() if x.tag.rsplit("}", 1)[-1] in names and x.text), None)
                        later = not e.tag.startswith(f"{{{_NS['m']}}}")
                        where = find("sqref") if later else e.get("sqref")
                        if where:
                            yield path, name, no, where, find("f") or "" if later else find("formula1") or "", later
                    elif tag == "row":
                        e.clear()


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[int, str, str]]:
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for no, s in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheets/m:sheet", _NS)):
        target = targets[s.get(_REL)].lstrip("/")
        yield no, s.get("name"), target if target.startswith("xl/") else f"xl/{target}"


def sheets_of(path: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for no, name, _ in _sheets(z):
            yield path, name, no


def sheets(files: DataFrame) -> DataFrame:
    """path, sheet, sheet_no of every sheet, those without cells too. files: path, content."""
    return _read(files, sheets_of, "path string, sheet string, sheet_no int")


def validations(files: DataFrame) -> DataFrame:
    """files: path, content."""
    return _read(files, validations_of, VALIDATIONS)


def _named(style: Column, ids: tuple[int, ...]) -> Column:
    return style.isin(*[str(i) for i in ids])


def is_date_style(style: Column) -> Column:
    """What an inspection takes for a date: by its id, or by day or year letters in its code, but for text in quotes, escapes and currency."""
    s = F.coalesce(style, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(s, '"[^"]*"', ""), r"\\.", "")
    return _named(s, DATE_IDS) | (~bare.rlike(r"(?i)r\$") & bare.rlike("(?i)dd?|yy|mmm") & bare.rlike("(?i)[dy]"))


def is_money_style(style: Column) -> Column:
    """What an inspection takes for money, if it is no date."""
    s = F.coalesce(style, F.lit(""))
    return ~is_date_style(style) & (_named(s, MONEY_IDS) | s.rlike(r"(?i)r\$|\$|#,##0"))


def is_shown_date(style: Column) -> Column:
    """What a table of a sheet shows as a date."""
    s = F.coalesce(style, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(s, r"\[[^\]]*\]", ""), '"[^"]*"', "")
    return _named(s, SHOWN_DATE_IDS) | (bare.rlike("(?i)[dmy]") & bare.rlike("(?i)[/-]|mmm"))


def shown(cells: DataFrame) -> DataFrame:
    """cells with shown: what a reader sees; a number in a date style as dd/mm/yyyy."""
    day = F.date_format(dates.from_serial(F.floor(F.col("value").try_cast("double"))), "dd/MM/yyyy")
    return cells.withColumn("shown", F.when((F.col("kind") == "number") & is_shown_date(F.col("style")), day).otherwise(F.coalesce("value", F.lit(""))))


def rows_of(cells: DataFrame, sheet_no: int = 0) -> DataFrame:
    """path, row_no (0 is the first filled row), cells: the text matrix of a sheet, cells at their columns."""
    from ..functions.text import column_number

    own = shown(cells.where(F.col("sheet_no") == sheet_no)).where("shown <> ''").withColumn("_c", column_number(F.col("col")))
    rows = own.groupBy("path", "row").agg(F.map_from_entries(F.collect_list(F.struct("_c", "shown"))).alias("_m"), F.max("_c").alias("_n"))
    filled = rows.select("path", "row", F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(""))).alias("cells"))
    n = F.row_number().over(W.partitionBy("path").orderBy("row")) - 1
    return filled.select("path", n.alias("row_no"), "cells")


def existing_rows(cells: DataFrame, first_row: int, date: str, description: str, category: str, money_in: str, money_out: str) -> DataFrame:
    """Recorded transactions of each sheet, in sheet order; rows without a date are left out."""
    from ..functions import money

    own = cells.where((F.col("row") >= first_row) & F.col("col").isin(date, description, category, money_in, money_out))
    at = lambda letter, c: F.max(F.when(F.col("col") == letter, F.col(c)))
    rows = own.groupBy("path", "sheet", "row").agg(*[at(letter, c).alias(f"{n}_{c}") for n, letter in (("d", date), ("t", description), ("c", category), ("i", money_in), ("o", money_out)) for c in ("kind", "value")])
    day = F.when(F.col("d_kind") == "text", dates.parse_loose(F.col("d_value"))["date"]).otherwise(dates.from_serial(F.floor(F.col("d_value").try_cast("double"))))

    def cents(n: str) -> Column:
        typed = money.parse_cell(F.col(f"{n}_value"))["cents"]
        return F.abs(F.when(F.col(f"{n}_kind") == "text", typed).otherwise(money.to_cents(F.col(f"{n}_value").try_cast("decimal(28,10)"))))

    # a step each: one method of all three would be beyond what the JVM compiles
    rows = apart(apart(apart(rows, {"date": day}), {"_i": cents("i")}), {"_o": cents("o")}).where("date is not null")
    incoming = F.coalesce("_i", F.lit(0)) > 0
    return rows.select(
        "path", "sheet", F.col("row").cast("long").alias("row_order"), "date", F.coalesce("t_value", F.lit("")).alias("description"), F.col("c_value").alias("category"),
        F.when(incoming, "credit").otherwise("debit").alias("direction"), F.when(incoming, F.col("_i")).otherwise(F.coalesce("_o", F.lit(0))).alias("amount_cents"),
    )
