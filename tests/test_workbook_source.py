import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from ledgerloom.sources import workbook, workbook_source

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, sheets, shared=("Ana", "Pix")):
    """sheets: name -> rows of cells as XML."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        ids = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>{ids}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>" + "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows) + "</sheetData></worksheet>")


def rows(n, k=0):
    """n rows: a date, a name, a number, and a formula that the first cell of a group shares with the others."""
    shared = lambda r: f'<f t="shared" si="0" ref="H2:H{n + 1}">H1+F2</f>' if r == 2 else '<f t="shared" si="0"/>'
    return [(r, [f'<c r="B{r}" s="1"><v>{46254 + k}</v></c>', f'<c r="C{r}" t="s"><v>{r % 2}</v></c>', f'<c r="F{r}"><v>{r * 10 + k}</v></c>', f'<c r="H{r}">{shared(r)}<v>{r}</v></c>']) for r in range(2, n + 2)]


@pytest.fixture
def folder(tmp_path):
    book(f"{tmp_path}/large.xlsx", {f"S{i}": rows(5 + 20 * i, i) for i in range(12)})
    for i in range(3):
        book(f"{tmp_path}/small{i}.xlsx", {"S0": rows(3, i), "S1": rows(2)})
    (tmp_path / "sub").mkdir()
    book(f"{tmp_path}/sub/again.xlsx", {"S0": rows(3)})
    (tmp_path / "_hidden.xlsx").write_bytes(b"PK")
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "none.xlsx").write_bytes(b"")
    return str(tmp_path)


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def told(cells, names=None):
    """Cells without the scheme of their paths."""
    out = cells.withColumn("path", F.regexp_extract("path", "[^/]+$", 0)) if "path" in cells.columns else cells
    return sorted(map(str, out.select(*(names or out.columns)).collect()))


def test_the_same_cells_as_by_the_bytes(spark, folder):
    plain = workbook.cells(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content"))
    assert plain.count() > 1000
    for split in (1, 2_000, 1 << 20):
        assert told(workbook_source.load(spark, folder, splitbytes=str(split))) == told(plain)
    assert told(workbook_source.load(spark, f"file://{folder}/large.xlsx")) == told(plain.where("path like '%large%'"))


def test_a_book_of_twelve_sheets_uses_twelve_tasks(spark, folder):
    cells = workbook_source.load(spark, f"{folder}/large.xlsx", splitbytes="100")
    tasks = cells.select("sheet", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == len({r.sheet for r in tasks}) == len({r.task for r in tasks}) == 12
    assert len(workbook_source.shares([("a", 10), ("b", 10), ("c", 25), ("d", 1)], 20)) == 4
    # each sheet goes to one share, however many there are, and the largest don't meet
    for parts in (1, 3, 12, 40):
        got = [workbook_source.dealt([5, 100, 90, 5, 0, 5], p, parts) for p in range(parts)]
        assert sorted(sum(got, [])) == [0, 1, 2, 3, 4, 5]
        assert parts == 1 or not any({1, 2} <= set(g) for g in got)


def test_filters_and_columns_reach_the_source(pushing, folder):
    plain = workbook.cells(pushing.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content"))
    where = "sheet = 'S3' AND row BETWEEN 4 AND 20 AND col IN ('C', 'H') AND kind <> 'x'"
    asked = workbook_source.load(pushing, folder, splitbytes="100").where(where)
    assert told(asked) == told(plain.where(where)) and asked.count() == 34
    plan = asked._jdf.queryExecution().executedPlan().toString()
    condition = plan[plan.index("Filter") : plan.index("BatchScan")]
    assert "kind" in condition and not any(x in condition for x in ("sheet", "row#", "col#"))
    for each in ("sheet_no < 2", "row = 2", "row <=> 2", "col is null", "kind = 'formula' AND formula like 'H1%'", "sheet IN ('S1', 'no')", "row > 50 OR col = 'B'", "path like '%small%'", "value IS NOT NULL AND sheet_no >= 10"):
        assert told(workbook_source.load(pushing, folder).where(each)) == told(plain.where(each)), each
    few = workbook_source.load(pushing, folder, ["path", "row", "sheet"], splitbytes="100").where("sheet = 'S11'")
    assert few.columns == ["path", "row", "sheet"] and told(few) == told(plain.where("sheet = 'S11'"), ["path", "row", "sheet"])
    assert "value#" not in few._jdf.queryExecution().executedPlan().toString()


def test_what_is_not_asked_for_is_not_read(tmp_path):
    book(f"{tmp_path}/a.xlsx", {"S0": rows(4), "S1": rows(4)})
    with zipfile.ZipFile(f"{tmp_path}/a.xlsx") as z:
        opened, open_ = [], z.open
        z.open = lambda name, *a, **k: opened.append(getattr(name, "filename", name)) or open_(name, *a, **k)
        b = workbook.Book(z)
        found = list(b.cells(b.sheets[1][2], lambda row, col: row > 3, ("row", "col")))
        assert [x[:2] for x in found] == [(r, c) for r in (4, 5) for c in "BCFH"]
        assert not {"xl/sharedStrings.xml", "xl/styles.xml", "xl/worksheets/sheet1.xml"} & set(opened)
        # a formula that is shared from a row that isn't asked for
        assert [x[5] for x in b.cells(b.sheets[0][2], lambda row, col: (row, col) == (5, "H"))] == ["H4+F5"]


def test_options_and_errors(spark, folder, tmp_path):
    cells = workbook_source.load(spark, folder, sheets='["S1", "S2"]', firstrow="3", lastrow="3")
    assert {(r.sheet, r.row) for r in cells.collect()} == {("S1", 3), ("S2", 3)}
    (tmp_path / "empty").mkdir()
    assert workbook_source.load(spark, f"{tmp_path}/empty").count() == 0
    with pytest.raises(Exception, match="FileNotFound|no such"):
        workbook_source.load(spark, f"{tmp_path}/nowhere").count()
    with pytest.raises(Exception, match="not these: size"):
        workbook_source.register(spark)
        spark.read.format("workbook").schema("size int").load(folder).count()
    assert workbook_source.test_of(StringContains(("sheet",), "x")) is None and workbook_source.test_of(EqualTo(("value",), "x")) is None
    assert workbook_source.test_of(GreaterThan(("sheet",), "x")) is None and not workbook_source.test_of(In(("row",), (1, None))).holds(None)


def test_recorded_rows_by_the_source(spark, folder):
    cells = workbook_source.load(spark, f"{folder}/small1.xlsx", ["path", "sheet", "row", "col", "kind", "value"])
    got = workbook.existing_rows(cells, 2, "B", "C", "D", "F", "G").where("sheet = 'S0'").orderBy("row_order").collect()
    assert [(str(r.date), r.description, r.direction, r.amount_cents) for r in got] == [("2026-08-21", x, "credit", n) for x, n in (("Ana", 2100), ("Pix", 3100), ("Ana", 4100))]
