import zipfile

import pytest

from ledgerloom.plans import importing
from ledgerloom.sources import files, ofx, pages, tabular, workbook

HEADER = "Movimentação,Tipo,Valor,Saldo antes,Saldo depois,Tarifa,Data,Destino,Destino Instituição,Destino Conta,Origem,Origem Instituição,Origem Conta,Descrição"
ROWS = [
    'Crédito,Pix,"161,00","R$ 709,04","R$ 870,04",Grátis,31/08/2026 20:02,LOJA,Stone Pagamentos,11-5,ACAI,Banco X,9,',
    'Débito,Pix,"-94,00","R$ 803,04","R$ 709,04",Grátis,31/08/2026 14:41,Ana Lima,Banco Y,8,LOJA,Stone Pagamentos,11-5,',
    'Crédito,Maquininha,"25,00","R$ 778,28","R$ 803,04","-0,24",30/08/2026 11:00,LOJA,Stone Pagamentos,11-5,Desconhecido,-,Desconhecido,',
]


def csv_text(rows=ROWS, header=HEADER):
    return "\r\n".join([header, *rows, "", " "])


def read_csv(spark, text, path="a.csv"):
    return tabular.read_rows(files.tables(spark.createDataFrame([(path, text)], "path string, text string")))


def test_delimited_text():
    assert files.sniff_delimiter('\n "a;b;c",x\n1;2') == ","
    assert files.sniff_delimiter("a;b\tc;d") == ";"
    assert files.sniff_delimiter("plain") == ","
    assert files.matrix('a,"b ""q""\nc",d\r\n\r\n , \n1,2') == [["a", 'b "q"\nc', "d"], ["1", "2"]]
    assert files.decode_bytes("é".encode()) == files.decode_bytes(b"\xe9") == files.decode_bytes(b"\xff\xfe\xe9\x00") == "é"


def test_kinds(spark):
    rows = [("a.csv", b"a,b"), ("b", b"%PDF-1"), ("c.txt", b"PK\x03\x04 xl/workbook"), ("d.xlsx", b"PK\x03\x04"), ("e.zip", b"PK\x03\x04"), ("f", b"\xd0\xcf\x11\xe0"), ("g", b"\xff\xd8\xff"), ("h", b" <ofx>"), ("i", b"")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r.path: r.k for r in df.select("path", files.kind(df.content, df.path).alias("k")).collect()}
    assert [got[p] for p, _ in rows] == ["text", "pdf", "spreadsheet", "spreadsheet", "text", "xls-legacy", "image", "ofx", "text"]


def test_tabular_statement(spark):
    rows = read_csv(spark, csv_text())
    a = tabular.audit(rows).first()
    assert (a.n_tx, a.n_unread, a.rows_ok, a.rows_bad, a.links_ok, a.links_broken, a.contradictions, a.n_fees, a.trusted) == (3, 0, 3, 0, 2, 0, 0, 1, True)
    tx = tabular.transactions(rows).orderBy("source_order").collect()
    assert [(t.description, t.direction, t.amount_cents) for t in tx] == [("Pix - ACAI", "credit", 16100), ("Pix - Ana Lima", "debit", 9400), ("Maquininha - Recebimento vendas", "credit", 2500), ("Tarifa", "debit", 24)]
    assert {t.account_id for t in tx} == {"stone-115"} and [t.source_order for t in tx] == [0, 1, 2, 3]


@pytest.mark.parametrize(
    "rows,reason",
    [
        ([ROWS[0], ROWS[2]], "balance chain breaks"),
        ([ROWS[0], ROWS[1], ROWS[1], ROWS[2]], "balance chain breaks"),
        ([ROWS[0].replace("161,00", "162,00"), *ROWS[1:]], "row arithmetic fails"),
        ([ROWS[0].replace("Crédito", "Débito"), *ROWS[1:]], "direction contradicts sign"),
        ([ROWS[0].replace("31/08/2026", "ontem"), *ROWS[1:]], "rows not read"),
        ([ROWS[0].replace("161,00", "1.6,1"), *ROWS[1:]], "rows not read"),
        (ROWS[::-1], None),
    ],
)
def test_tampered_statements(spark, rows, reason):
    assert tabular.audit(read_csv(spark, csv_text(rows))).first().reason == reason


OFX = """OFXHEADER:100
<OFX><ORG>Stone Pagamentos</ORG><BANKID>0197<ACCTID>11-5</ACCTID>
<BANKTRANLIST><DTSTART>20260801<DTEND>20260831
<STMTTRN><TRNTYPE>CREDIT<DTPOSTED>20260831200200[-3:BRT]<TRNAMT>161.00<MEMO>ACAI - Transferência | Pix</STMTTRN>
<STMTTRN><TRNTYPE>DEBIT</TRNTYPE><DTPOSTED>20260830</DTPOSTED><TRNAMT>-94,00</TRNAMT><NAME>Ana</NAME></STMTTRN>
</BANKTRANLIST><LEDGERBAL><BALAMT>870.04</LEDGERBAL></OFX>"""


def read_ofx(spark, text):
    texts = spark.createDataFrame([("x.ofx", text)], "path string, text string")
    rows = ofx.blocks(texts)
    return ofx.audit(texts, rows).first(), ofx.transactions(rows).orderBy("source_order").collect()


def test_ofx(spark):
    a, tx = read_ofx(spark, OFX)
    assert (a.declared, a.n_tx, a.n_unread, a.n_out_of_period, a.leftover, a.final_balance_cents, a.trusted) == (2, 2, 0, 0, [], 87004, True)
    assert [(str(t.date), t.description, t.direction, t.amount_cents, t.account_id) for t in tx] == [("2026-08-31", "Pix - ACAI", "credit", 16100, "stone-115"), ("2026-08-30", "Ana", "debit", 9400, "stone-115")]


@pytest.mark.parametrize(
    "change,reason",
    [(("20260830", "20260730"), "dates out of period"), (("-94,00", "x"), "blocks not read"), (("<TRNTYPE>DEBIT", "<TRNTYPE>CREDIT"), "blocks not read"), (("</BANKTRANLIST>", "<EXTRA>1</BANKTRANLIST>"), "tags not understood")],
)
def test_tampered_ofx(spark, change, reason):
    assert read_ofx(spark, OFX.replace(*change))[0].reason == reason


PAGES = [
    "290 - PagSeguro Internet S/A\nConta 99-3\nExtrato da conta\nPeriodo: 15/07/2026 a 14/08/2026\nData Valor\nDescrição\n17/07/2026 Vendas PIX R$ 65,35\n17/07/2026 Saldo do dia R$ 250,38\n18/07/2026 Vendas VISA R$ 56,94",
    "Data Valor\nDescrição\n18/07/2026 Pix enviado - Ana -R$ 6,94\n18/07/2026 Saldo do dia R$ 300,38\nPagina 2",
]


def read_pages(spark, texts):
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "path string, page int, text string")
    rows = pages.read_lines(df)
    return pages.audit(df, rows).first(), pages.transactions(df, rows).orderBy("source_order").collect(), df


def test_pages(spark):
    a, tx, df = read_pages(spark, PAGES)
    assert (a.n_tx, a.days_checked, a.days_bad, a.n_unread, a.n_out_of_period, a.trusted) == (3, 1, 0, 0, 0, True)
    assert [(t.description, t.direction, t.amount_cents, t.account_id) for t in tx] == [("Vendas PIX", "credit", 6535, "pagseguro-993"), ("Vendas VISA", "credit", 5694, "pagseguro-993"), ("Pix enviado - Ana", "debit", 694, "pagseguro-993")]
    assert df.groupBy().agg({"text": "max"}) and df.select(pages.is_statement(df.text).alias("s")).collect()[0].s


@pytest.mark.parametrize("change,reason", [(("-R$ 6,94", "-R$ 6,95"), "day balance does not follow"), (("18/07/2026 Pix", "18/07/2027 Pix"), "dates out of period"), (("Pagina 2", "garbage"), "lines not read"), (("18/07/2026 Saldo do dia R$ 300,38", ""), "no day balance to check")])
def test_tampered_pages(spark, change, reason):
    assert read_pages(spark, [p.replace(*change) for p in PAGES])[0].reason == reason


def test_words_become_pages(spark):
    words = spark.createDataFrame([("f", 1, "b", 9.0, 10.2), ("f", 1, "a", 1.0, 9.9), ("f", 1, "c", 1.0, 20.0)], "path string, page int, text string, x0 double, top double")
    assert pages.lines_to_pages(pages.words_to_lines(words)).first().text == "a b\nc"


def workbook_bytes(path, rows):
    """A minimal workbook: shared and inline strings, a date style, a shared formula."""
    cells = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="AGOSTO" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Pix - ACAI</t></si><si><r><t>Sal</t></r><r><t>ário </t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    path = f"{tmp_path}/b.xlsx"
    rows = [
        (2, ['<c r="B2" s="1"><v>46254</v></c>', '<c r="C2" t="s"><v>0</v></c>', '<c r="D2" t="s"><v>1</v></c>', '<c r="F2"><v>161.5</v></c>', '<c r="H2"><f t="shared" si="0" ref="H2:H3">H1+F2-G2</f><v>1</v></c>']),
        (3, ['<c r="B3" t="inlineStr"><is><t>21/08/2026</t></is></c>', '<c r="C3" t="inlineStr"><is><t>Ana</t></is></c>', '<c r="G3"><v>9.99</v></c>', '<c r="H3"><f t="shared" si="0"/><v>2</v></c>']),
    ]
    workbook_bytes(path, rows)
    cells = workbook.load(spark, path)
    assert {(c.row, c.col): c.formula for c in cells.where("formula is not null").collect()} == {(2, "H"): "H1+F2-G2", (3, "H"): "H2+F3-G3"}
    assert [r.cells for r in workbook.rows_of(cells).orderBy("row_no").collect()] == [["", "20/08/2026", "Pix - ACAI", "Salário ", "", "161.5", "", "1"], ["", "21/08/2026", "Ana", "", "", "", "9.99", "2"]]
    got = workbook.existing_rows(cells, 2, "B", "C", "D", "F", "G").orderBy("row_order").collect()
    assert [(str(r.date), r.description, r.category, r.direction, r.amount_cents) for r in got] == [("2026-08-20", "Pix - ACAI", "Salário ", "credit", 16150), ("2026-08-21", "Ana", None, "debit", 999)]


def test_a_folder_of_statements(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(csv_text().encode())
    (tmp_path / "b.csv").write_bytes(csv_text(ROWS[::2]).encode("cp1252"))
    (tmp_path / "c.ofx").write_text(OFX)
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    # a workbook under the old name, beside one that is none: bytes count
    table = files.matrix(csv_text())
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    told = lambda i, j, x: f'<c r="{letters[j]}{i}" t="inlineStr"><is><t>{x.replace("&", "&amp;")}</t></is></c>'
    workbook_bytes(f"{tmp_path}/e.xls", [(i, [told(i, j, x) for j, x in enumerate(row) if x]) for i, row in enumerate(table, 1)])
    (tmp_path / "f.xlsx").write_bytes(b"PK\x03\x04 broken xl/")
    # a cell longer than the reader's usual limit is a cell like any other
    (tmp_path / "g.csv").write_text('a,b\n"' + "x" * 200_000 + '",2\n')
    r = importing.read_statements(spark, str(tmp_path))
    got = {a.path.rsplit("/")[-1]: (a.n_tx, a.reason, a.trusted) for a in r.audit.collect()}
    assert got == {"a.csv": (3, None, True), "b.csv": (2, "balance chain breaks", False), "c.ofx": (2, None, True), "d.pdf": (0, "not a statement that can be proved: pdf", False), "e.xls": (3, None, True), "f.xlsx": (0, "not a statement that can be proved: spreadsheet", False), "g.csv": (0, "not a statement that can be proved: text", False)}
    assert r.transactions.count() == 10


def test_first_details_of_what_was_not_read(spark):
    bad = [f"Crédito,x{i}" for i in range(12)]
    text = "Movimentação,Valor,Saldo antes,Saldo depois,Data\n" + "\n".join(f"{x},1,2,31/08/2026" for x in bad)
    rows = tabular.read_rows(files.tables(spark.createDataFrame([("p", text)], "path string, text string")))
    got = tabular.details(rows).first().details
    assert len(got) == tabular.DETAILS and got[0].startswith("row 1: value: Crédito")
    blocks = ofx.blocks(spark.createDataFrame([("p", OFX.replace("<TRNAMT>", "<OTHER>"))], "path string, text string"))
    assert [d.split(":")[0] for d in ofx.details(blocks, 1).first().details] == ["block 1"]
