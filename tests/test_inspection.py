"""A workbook inspected as a whole: each part against what the file was made of."""

from ledgerloom.operators import inspection
from ledgerloom.sources import workbook

from .test_workbook_source import book

HEAD = ["Data", "Descrição", "Categoria", "Entrada", "Saída", "Saldo"]


def text(ref, x):
    return f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>'


def month(head, days, letters="BCDEFG", name="Pix"):
    """A header in a row of the sheet's own, and a row for each day: serial, name, one of two categories, money in, a running balance."""
    out = [(head, [text(f"{c}{head}", h) for c, h in zip(letters, HEAD)])]
    for r, day in enumerate(days, head + 1):
        b, c, d, e, _, g = letters
        out.append((r, [f'<c r="{b}{r}" s="1"><v>{day}</v></c>', text(f"{c}{r}", f"{name} {r}"), text(f"{d}{r}", ("Casa", "Carro")[r % 2]), f'<c r="{e}{r}"><v>{r}</v></c>', f'<c r="{g}{r}"><f>{g}{r - 1}+{e}{r}</f><v>1</v></c>']))
    return out


def test_workbooks_of_many_kinds_in_one_plan(spark, tmp_path):
    listed = [(i, [text(f"A{i}", x)]) for i, x in enumerate(("Categoria", "Casa", "Carro", "Casa"), 1)]
    book(f"{tmp_path}/a.xlsx", {"Capa": [(1, [text("A1", "Olá")])], "JANEIRO": month(4, range(46000, 46004)), "Fevereiro": month(4, range(46031, 46040), name="Ted"), "Categorias": listed, "MARÇO": []})
    book(f"{tmp_path}/b.xlsx", {"Extrato": month(9, range(46040, 46000, -5), "CDEFGH")})
    book(f"{tmp_path}/c.xlsx", {"Notas": [(1, [text("A1", "nada")])]})
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.xlsx").select("path", "content")
    rules = spark.createDataFrame([("D5:D99", "Categorias!$A:$A", 1), ("E5", '"1,2"', 0)], "sqref string, formula string, sheet_no int")
    rules = files.where("path like '%a.xlsx'").select("path").crossJoin(rules).selectExpr("path", "CASE sheet_no WHEN 1 THEN 'JANEIRO' ELSE 'Capa' END AS sheet", "sheet_no", "sqref", "formula", "false AS later")
    got = {r.path[-6]: r for r in inspection.inspect(workbook.cells(files), rules, workbook.sheets(files)).collect()}
    assert set(got) == set("abc")
    a, b, c = (got[x] for x in "abc")
    assert (a.sheet_names, a.month_sheets, a.support_sheets) == (["Capa", "JANEIRO", "Fevereiro", "Categorias", "MARÇO"], ["JANEIRO", "Fevereiro", "MARÇO"], ["Categorias"])
    assert (a.sample_sheet, a.header_row, a.first_data_row, a.filled_rows) == ("Fevereiro", 4, 5, 9)
    kinds = dict(zip("BCDEFG", ("date", "text", "text", "number", "empty", "formula")))
    roles = ["date", "description", "category", "in", "out", "balance"]
    assert [tuple(x) for x in a.columns] == [(col, h, role, kinds[col]) for col, h, role in zip("BCDEFG", HEAD, roles)]
    assert a.categories == ["Casa", "Carro"] and a.description_samples == [f"Ted {r}" for r in range(5, 13)]
    assert [(x.col, x.options, x.source, x.source_ref) for x in a.list_columns] == [("D", ["Casa", "Carro", "Casa"], "range", "Categorias!$A:$A")]
    assert [(x.col, x.model, x.model_row, x.formula_kind, x.n, x.column_wide) for x in a.formula_columns] == [("G", "G12+E13", 13, "accumulated", 9, True)]
    assert (a.date_order, a.dates_compared, a.warnings) == ("ascending", 11, []) and [x.sheet for x in a.date_orders] == ["JANEIRO", "Fevereiro"]
    # no month sheets, other letters, another header row, newest first
    assert (b.sample_sheet, b.header_row, b.date_order, b.dates_compared, b.filled_rows) == ("Extrato", 9, "descending", 7, 8)
    assert [(x.col, x.role) for x in b.columns] == list(zip("CDEFGH", roles)) and b.description_samples == [f"Pix {r}" for r in range(10, 18)]
    assert [(x.col, x.formula_kind) for x in b.formula_columns] == [("H", "accumulated")] and b.month_sheets == []
    assert [(x.col, x.source) for x in b.list_columns] == [("E", "content")]
    assert (c.sample_sheet, c.header_row, c.columns, c.list_columns, c.date_order, c.filled_rows) == (None, None, [], [], "undefined", 0)
    assert c.sheet_names == ["Notas"] and c.warnings == [inspection.NO_HEADER]


def test_no_workbooks(spark):
    none = spark.createDataFrame([], workbook.SCHEMA)
    assert inspection.inspect(none).count() == 0
