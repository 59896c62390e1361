"""Workbooks as a data source: the tasks of one read share the sheets of a workbook, and a task reads only the bytes of its sheets.

    cells = workbook_source.load(spark, "s3://books/2026", columns=["path", "sheet", "row", "col", "value"])
    cells.where("sheet = 'JANEIRO' AND row >= 13 AND col IN ('C', 'D')")

or spark.read.format("workbook") after register(spark). The columns are those of workbook.SCHEMA; a read may name fewer, by schema().

- Tasks: the driver lists names and sizes and opens nothing. A workbook of n times `splitbytes` gets n shares (MOST_SHARES at most); each share's task
  reads the file's directory of sheets, deals the sheets that the filters leave by their size, and unpacks its own. Small workbooks go together,
  up to `splitbytes` a task.
- Filters on path, sheet, sheet_no, row, col and kind are settled in the source, where the session has spark.sql.python.filterPushdown.enabled: sheets
  that fail are not unpacked, cells that fail are never built. Without the setting Spark filters; the options sheets (a JSON list of names),
  firstrow and lastrow leave out as much.
- Columns: without value and kind no shared strings are read, without style no styles.

Defined results: a file that is no workbook, a broken one and an empty one have no cells; a workbook that breaks off in the midst of a sheet has the
cells before. Names that begin with _ or . are not listed, as Spark does not. A path without files is an error. Paths are those that pyarrow's
file systems open (local, file:, s3:, gs:, hdfs:); for any other, workbook.load reads by Spark's own.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .workbook import CELL, SCHEMA, Book

#: Bytes of a workbook for each task that reads it, and the most tasks that share one.
SPLIT_BYTES, MOST_SHARES = 1 << 20, 64
#: Cells of a batch; bytes that are read ahead of a file; a ZIP file without entries.
BATCH, READ_BYTES, LEAST_ZIP = 20_000, 1 << 16, 22
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_FILE, _SHEET, _CELL = ("path",), ("sheet", "sheet_no"), ("row", "col", "kind")
_ORDERED = {GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}


@dataclass(frozen=True)
class Test:
    """A condition on one column that the source settles by itself."""

    column: str
    op: str
    value: object = None

    def holds(self, x) -> bool:
        if self.op == "null":
            return x is None
        if self.op == "same":
            return x == self.value
        if x is None:  # as in SQL, what compares with nothing isn't true
            return False
        match self.op:
            case "some":
                return True
            case "eq":
                return x == self.value
            case "in":
                return x in self.value
            case "gt":
                return x > self.value
            case "ge":
                return x >= self.value
            case "lt":
                return x < self.value
        return x <= self.value


def test_of(f: Filter) -> Test | None:
    """The test that a filter asks for, or None if Spark is to evaluate it."""
    if len(f.attribute if hasattr(f, "attribute") else ()) != 1 or f.attribute[0] not in _FILE + _SHEET + _CELL:
        return None
    column, numeric = f.attribute[0], f.attribute[0] in ("sheet_no", "row")
    match f:
        case EqualTo():
            return Test(column, "eq", f.value) if f.value is not None else None
        case EqualNullSafe():
            return Test(column, "same", f.value)
        case In():
            return Test(column, "in", frozenset(x for x in f.value if x is not None))
        case IsNotNull():
            return Test(column, "some")
        case IsNull():
            return Test(column, "null")
    if type(f) in _ORDERED and numeric and f.value is not None:
        return Test(column, _ORDERED[type(f)], f.value)
    return None


@dataclass
class Share(InputPartition):
    """Share `part` of `parts` of each of these files."""

    paths: tuple[str, ...]
    part: int = 0
    parts: int = 1


def file_system(path: str):
    """pyarrow's file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        head, _, rest = path.partition(":")
        return fs.FileSystem.from_uri(f"{head}://{rest}" if head == "file" and not rest.startswith("//") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _listed(path: str) -> list[tuple[str, int]]:
    """Files under a path, with their sizes; by name, so that every plan deals them alike."""
    from pyarrow import fs

    where, at = file_system(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    base, head = at.rstrip("/"), path.rstrip("/")
    found = []
    for i in where.get_file_info(fs.FileSelector(at, recursive=True)):
        inner = i.path[len(base) :].lstrip("/")
        if i.type == fs.FileType.File and not any(x[0] in "_." for x in inner.split("/")):
            found.append((f"{head}/{inner}", i.size))
    return sorted(found)


def shares(files: list[tuple[str, int]], split: int = SPLIT_BYTES) -> list[Share]:
    """Tasks of a read: the shares of each large file, and small files together."""
    out, small, n = [], [], 0
    for path, size in files:
        parts = min(MOST_SHARES, -(-size // split))
        if parts > 1:
            out += [Share((path,), i, parts) for i in range(parts)]
            continue
        if small and n + size > split:
            out.append(Share(tuple(small)))
            small, n = [], 0
        small.append(path)
        n += size
    return out + ([Share(tuple(small))] if small else [])


def dealt(sizes: list[int], part: int, parts: int) -> list[int]:
    """Which of these sheets are this share's: the largest first, each to the share that has the least. Every task finds the same."""
    loads, mine = [0] * parts, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        to = min(range(parts), key=lambda p: (loads[p], p))
        loads[to] += sizes[i] + 1
        if to == part:
            mine.append(i)
    return sorted(mine)


class Cells(DataSourceReader):
    """Reads cells; the tests are those of the options."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options.get("path")
        if not self.path:
            raise ValueError("a workbook source needs a path")
        known = {x.split()[0]: x.split()[1] for x in SCHEMA.split(", ")}
        if odd := [f.name for f in schema if known.get(f.name) != f.dataType.simpleString()]:
            raise ValueError(f"columns of a workbook source are {SCHEMA}; not these: {', '.join(odd)}")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[Test] = []
        if "sheets" in options:
            self.tests.append(Test("sheet", "in", frozenset(json.loads(options["sheets"]))))
        for name, op in (("firstrow", "ge"), ("lastrow", "le")):
            if name in options:
                self.tests.append(Test("row", op, int(options[name])))

    def partitions(self) -> list[Share]:
        files = [f for f in _listed(self.path) if self._passes({"path": f[0]}, _FILE)]
        return shares(files, self.split) or [Share(())]

    def _passes(self, values: dict, columns: tuple[str, ...]) -> bool:
        return all(t.holds(values[t.column]) for t in self.tests if t.column in columns)

    def read(self, partition: Share) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.schema), []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        for path in partition.paths:
            for row in self._of_file(path, partition.part, partition.parts):
                rows.append(row)
                if len(rows) == BATCH:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    def _of_file(self, path: str, part: int, parts: int) -> Iterator[tuple]:
        names = [f.name for f in self.schema]
        own = [t for t in self.tests if t.column in ("row", "col")]
        kinds = [t for t in self.tests if t.column == "kind"]
        tests = {c: [t.holds for t in own if t.column == c] for c in ("row", "col")}
        wanted = (lambda row, col: all(h(row) for h in tests["row"]) and all(h(col) for h in tests["col"])) if own else None
        needed = tuple(c for c in CELL if c in names or (c == "kind" and kinds))
        where, at = file_system(path)
        try:
            with where.open_input_file(at) as f:
                if f.size() < LEAST_ZIP:
                    return
                with zipfile.ZipFile(io.BufferedReader(f, READ_BYTES)) as z:
                    book = Book(z)
                    left = [s for s in book.sheets if self._passes({"sheet": s[1], "sheet_no": s[0]}, _SHEET)]
                    sizes = [z.getinfo(target).compress_size for _, _, target in left]
                    for i in dealt(sizes, part, parts):
                        no, name, target = left[i]
                        for cell in book.cells(target, wanted, needed):
                            values = dict(zip(CELL, cell), path=path, sheet=name, sheet_no=no)
                            if all(t.holds(values["kind"]) for t in kinds):
                                yield tuple(values[n] for n in names)
        except (zipfile.BadZipFile, KeyError, ET.ParseError):  # broken, or a ZIP of something else
            return


class FilteredCells(Cells):
    """Cells of a session that hands filters down."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = test_of(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Cells:
        kind = FilteredCells if str(self.options.get("pushdown", "false")).lower() == "true" else Cells
        return kind(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def load(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Cells of every workbook under a path; filters go into the source if the session allows it, columns limit what is read."""
    register(spark)
    kinds = {x.split()[0]: x for x in SCHEMA.split(", ")}
    pushdown = spark.conf.get(_PUSHDOWN, "false")
    return spark.read.format("workbook").option("pushdown", pushdown).options(**options).schema(", ".join(kinds[c] for c in columns or kinds)).load(path)


def write(books: DataFrame, folder: str) -> str:
    """books (path: a name, content) as files of a folder that the tasks share, <name>.xlsx each. A file comes into place whole, by a rename, so that
    an attempt that is lost or runs twice leaves no half of one. Names that are equal are one file, of any of their contents."""

    def put(batches):
        import pandas as pd

        where, at = file_system(folder)
        where.create_dir(at, recursive=True)
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                draft = f"{at}/.{uuid.uuid4().hex}"
                with where.open_output_stream(draft) as f:
                    f.write(content)
                where.move(draft, f"{at}/{name}.xlsx")
            yield pd.DataFrame({"n": [len(batch)]})

    books.select("path", "content").mapInPandas(put, "n long").agg(F.sum("n")).collect()
    return folder
