import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text


def values(spark, rows, expr, schema="x string"):
    return [r.v for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(expr.alias("v")).collect()]


def test_keys(spark):
    x = F.col("x")
    assert values(spark, ["  São   João\n- Café ", "ﬁça ß", "é"], text.comparison_key(x)) == ["SAO JOAO - CAFE", "FICA SS", "E"]
    assert values(spark, ["Pix - José & Filhos (2)", "  "], text.option_key(x)) == ["PIX JOSE FILHOS 2", ""]
    assert values(spark, ["Padaria Sol Ltda ME | loja 2", "Açaí • centro", "ME", "LTDA ME", "A / B", "X-Y S.A."], text.counterparty_key(x)) == ["PADARIA SOL", "ACAI", "ME", "LTDA", "A", "X Y S A"]
    assert values(spark, ["Pix enviado - Maria da Silva LTDA", "PIX DE"], text.name_key(x)) == ["MARIA SILVA", ""]
    assert values(spark, ["São Paulo & Cia!", "--"], text.slug(x)) == ["sao-paulo-cia", ""]
    assert values(spark, ["maria DA silva"], text.title_case(x)) == ["Maria Da Silva"]


@pytest.mark.parametrize("a,b,kind", [("Maria Silva", "Pix Maria da Silva", "exact"), ("Maria Silva", "Maria Souza", "candidate"), ("Maria", "Maria Souza", "candidate"), ("Jo Silva", "Jo Lima", "none"), ("Pix", "Maria", "none"), ("Ana", "Bia", "none")])
def test_name_match(spark, a, b, kind):
    e = text.name_match(text.name_words(F.col("a")), text.name_words(F.col("b")))
    assert values(spark, [(a, b)], e, "a string, b string") == [kind]


def test_descriptions(spark):
    e = text.compose_description(F.col("m"), F.col("c"), F.col("i"))
    rows = [("Pix", "  Ana  Lima ", True), ("Pix", "Desconhecido", True), ("Pix", "-", False), ("", "Bia", False), ("", "", False), ("", None, True), ("Pix", "PIX Ana", True), ("Pix", "Pixel", True)]
    assert values(spark, rows, e, "m string, c string, i boolean") == ["Pix - Ana Lima", "Pix - Recebimento vendas", "Pix", "Bia", "Lançamento", "Recebimento vendas", "Pix - Ana", "Pix - Pixel"]
    e = text.memo_description(F.col("m"), F.col("i"))
    rows = [("LOJA - B - Transferência | Pix", True), ("Venda | x - Maquininha", True), ("sem corte", False), ("", True), ("Ana - Boleto pago", False), ("Z - Cartão | Débito", True), ("Q - Outro meio", False)]
    assert values(spark, rows, e, "m string, i boolean") == ["Pix - LOJA - B", "Maquininha - Venda | x", "sem corte", "Recebimento vendas", "Boleto - Ana", "Cartão - Z", "Outro meio - Q"]
    assert values(spark, ["Pix", "Transação", "Recebível de cartão", "TED", "Antecipação", "", "Coisa"], text.method_of(F.col("x"))) == ["Pix", "Maquininha", "Cartão", "Transferência", "Antecipação", "", "Coisa"]


def test_accounts(spark):
    e = text.account_ref(F.col("a"), F.col("b"))
    got = values(spark, [("Banco do Brasil S.A.", "12.3-4"), ("", "77 8"), ("", ""), ("Novo Banco", None)], e, "a string, b string")
    assert [(g.id, g.label) for g in got] == [("banco-do-brasil-1234", "Banco do Brasil S.A. - Conta 12.3-4"), ("conta-778", "Conta 778"), ("conta", "Conta"), ("novo-banco", "Novo Banco")]


def test_columns_and_widths(spark):
    assert values(spark, [1, 26, 27, 52, 703, 702, 16384], text.column_letters(F.col("x")), "x int") == ["A", "Z", "AA", "AZ", "AAA", "ZZ", "XFD"]
    assert values(spark, ["A", "Z", "AA", "XFD"], text.column_number(F.col("x"))) == [1, 26, 27, 16384]
    assert values(spark, ["MiA x"], text.text_width(F.col("x"))) == [pytest.approx(1.4 + 0.55 + 1.15 + 0.55 + 1)]
    assert values(spark, ["&lt;a&gt; &amp;lt;"], text.unescape_xml(F.col("x"))) == ["<a> &lt;"]


def test_money(spark):
    got = values(spark, ["R$ 1.234,56", "-R$ 10", "(R$ 5,00)", "1234.56", "1.234", "abc", "", "R$ -3,1", "1.234.567,89"], money.parse_brl(F.col("x")))
    assert [(g.cents, g.status, g.negative) for g in got] == [(123456, "ok", False), (1000, "ok", True), (500, "ok", True), (123456, "ok", False), (123400, "ok", False), (None, "bad", False), (None, "bad", False), (310, "ok", False), (123456789, "ok", False)]
    got = values(spark, ["R$ 709,04", "-94,00", "Grátis", "", None, "1.2.3", "(5,5)", "N/A", "12.34", "1,234"], money.parse_cell(F.col("x")))
    assert [(g.cents, g.status) for g in got] == [(70904, "ok"), (-9400, "ok"), (None, "absent"), (None, "absent"), (None, "absent"), (None, "bad"), (-550, "ok"), (None, "absent"), (1234, "ok"), (None, "bad")]
    got = values(spark, ["-94.00", "1.234,5", "+3", "x", ""], money.parse_ofx(F.col("x")))
    assert [(g.cents, g.status) for g in got] == [(-9400, "ok"), (123450, "ok"), (300, "ok"), (None, "bad"), (None, "bad")]
    assert values(spark, [123456, -5, 0, 100000000], money.format_brl(F.col("x")), "x long") == ["R$ 1.234,56", "-R$ 0,05", "R$ 0,00", "R$ 1.000.000,00"]


def test_dates(spark):
    d = datetime.date
    got = values(spark, ["20/08/2026", "05/01/26", "31/02/2026", "1/1/2026", "00/10/2026", "10/13/2026", " 20/08/2026 "], dates.parse_br(F.col("x")))
    assert [g and (g.date, g.y, g.m, g.d) for g in got] == [(d(2026, 8, 20), 2026, 8, 20), (d(2026, 1, 5), 2026, 1, 5), (None, 2026, 2, 31), None, None, None, (d(2026, 8, 20), 2026, 8, 20)]
    got = values(spark, ["em 3-4-26 às 9", "31/08/2026 20:02", "x"], dates.parse_loose(F.col("x")))
    assert [g and g.date for g in got] == [d(2026, 4, 3), d(2026, 8, 31), None]
    assert values(spark, ["20260831200200[-3:BRT]", "2026083"], dates.parse_compact(F.col("x")))[1] is None
    assert values(spark, [d(2026, 8, 20)], dates.sheet_serial(F.col("x")), "x date") == [46254]
    assert values(spark, [46254], dates.from_serial(F.col("x")), "x int") == [d(2026, 8, 20)]
    assert values(spark, [d(2026, 3, 7)], F.concat_ws(" ", dates.month_sheet(F.col("x")), dates.competence(F.col("x")), dates.unpadded(F.col("x"))), "x date") == ["MARÇO 2026-03 2026-3-7"]
    assert values(spark, ["fluxo de caixa   simplificado", "JULHO"], dates.is_support_sheet(F.col("x"))) == [True, False]


def test_xml_text_survives(spark):
    odd = ["a & b", "&amp;", "<x y='1'>\"q\"</x>", "", "é&lt;"]
    assert values(spark, odd, text.unescape_xml(text.escape_xml(F.col("x")))) == odd
    assert values(spark, odd[:3], text.escape_xml(F.col("x"))) == ["a &amp; b", "&amp;amp;", "&lt;x y=&apos;1&apos;&gt;&quot;q&quot;&lt;/x&gt;"]
