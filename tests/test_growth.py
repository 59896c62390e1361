"""What a query's time and its tasks' memory grow by: how often a source is read, how rows are dealt, how often a pattern is matched."""

import itertools
import random
import re

import pytest

from ledgerloom.functions import dates, steps
from ledgerloom.operators import refine
from ledgerloom.plans import profile_queries, queries
from ledgerloom.sources import ofx, pages

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_profiles_read_the_cells_once(spark):
    kinds = "sheet string, row int, col string, kind string, value string, style string"
    rows = [(s, r, c, k, v, None) for s in "ab" for r in range(1, 5) for c, k, v in (("B", "text", "01/02/2026"), ("C", "text", "x"), ("F", "number", "1"), ("G", "number", "2"))]
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    cells = spark.createDataFrame(rows, kinds).mapInPandas(counted, kinds)
    headers = spark.createDataFrame([(s, c, "?") for s in "ab" for c in "BCFG"], "sheet string, col string, header string")
    port = lambda items: [(x["index"], [{"col": c, "role": r} for c, r in (("B", "date"), ("C", "description"), ("F", "in"), ("G", "out"))]) for x in items]
    found, told, _ = refine.profiles(cells, headers, ["sheet"], port)
    assert {(r.sheet, r.source) for r in found.collect()} == {("a", "port"), ("b", "port")} and told.where(f"verdict = '{refine.ACCEPTED}'").count() == 8
    assert seen.value == len(rows)


@pytest.mark.parametrize("query", ["sheet_styles", "category_history"])
def test_sheets_are_dealt_by_their_rows(spark, monkeypatch, query):
    monkeypatch.setattr(steps, "TASK_ROWS", 100)
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    made = profile_queries.QUERIES[query](spark, SF)
    assert made.rdd.getNumPartitions() == n // 100 + 1
    assert optimized(made).count("Window") == 1


def test_formulas_of_sheets_are_found_once(spark):
    made = profile_queries.formula_precedence(spark, SF)
    assert "Window" not in optimized(made) and made.count() > 0


def test_patterns_of_a_page_line_are_matched_once_each(spark):
    text = "290 - PagSeguro Internet S/A\nConta 1\nExtrato da conta\nData Valor Descrição\n01/02/2026 Pix R$ 1,00\n31/02/2026 Pix -R$ 2,00\n00/02/2026 x R$ 1,00\nno entry\n01/02/2026 Saldo do dia R$ -1,00\nSaldo\n02/02/2026 Saldo anterior R$ 0,50"
    lines = pages.read_lines(spark.createDataFrame([("p", 0, text)], "path string, page int, text string"))
    got = [(r.n, r.description, r.is_unread, r.signed_cents, r.is_close, r.is_anchor, r._d and r._d.date and str(r._d.date)) for r in lines.orderBy("n").collect()]
    assert got == [
        (4, "Pix", False, 100, False, False, "2026-02-01"), (5, "Pix", False, -200, False, False, None), (6, "x", True, 100, False, False, None), (7, "", True, None, False, False, None),
        (8, "Saldo do dia", False, -100, True, False, "2026-02-01"), (9, "", True, None, False, False, None), (10, "Saldo anterior", False, 50, False, True, "2026-02-02"),
    ]
    entries = lines.where("not is_unread and not is_close and not is_anchor")
    assert optimized(entries).count("[\\d.]+,\\d{2}") == 6  # whether it is an entry, and five parts


@pytest.mark.parametrize("query", ["list_examples", "list_columns"])
def test_workbooks_are_made_and_unpacked_once(spark, query):
    made = optimized(profile_queries.QUERIES[query](spark, SF))
    assert "FlatMapGroupsInPandas" not in made and "MapInArrow" not in made


def test_digits_of_a_date_are_looked_for_once(spark):
    rows = spark.createDataFrame([("x",)], "x string")
    for parse in (dates.parse_br, dates.parse_loose, dates.parse_compact):
        assert optimized(rows.select(parse(rows.x).alias("d")).where("d.y > 0")).count("regexp_extract") <= 2, parse  # the filter's copy and its own


def reference(day, month, year):
    if day is None or not (1 <= month <= 12 and 1 <= day <= 31):
        return None
    leap = year % 4 == 0 and (year % 100 or year % 400 == 0)
    last = 29 if leap and month == 2 else 28 if month == 2 else 30 if month in (4, 6, 9, 11) else 31
    return (f"{year:04}-{month:02}-{day:02}" if 1 <= year <= 9999 and day <= last else None, year, month, day)


def test_dates_of_odd_texts(spark):
    r = random.Random(5)
    years, seps = ["26", "0026", "2026", "1900", "2000", "2024", "0000", "202", "20266", ""], ["/", "-", "/", "."]
    texts = [f"{r.choice(['', ' ', 'a '])}{d}{r.choice(seps)}{m}{r.choice(seps)}{r.choice(years)}{r.choice(['', ' ', ' 1/2/34'])}" for d, m in itertools.product(["0", "00", "1", "01", "29", "30", "31", "32", "131"], ["0", "1", "02", "2", "12", "13", "4"]) for _ in range(6)]
    texts += [f"{y}{m}{d}{t}" for y, m, d, t in itertools.product(["2024", "0000", "1900"], ["02", "13", "00", "11"], ["00", "29", "31", "3"], ["", "12", " x"])] + [None, "", " "]
    cut = lambda y: int(y) + 2000 if len(y) == 2 else int(y)

    def br(t):
        m = re.fullmatch(r"(\d\d)/(\d\d)/(\d\d|\d{4})", (t or "").strip(" "))
        return m and reference(int(m[1]), int(m[2]), cut(m[3]))

    def loose(t):
        m = re.search(r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})", t or "")
        return m and reference(int(m[1]), int(m[2]), cut(m[3]))

    def compact(t):
        m = re.match(r"(\d{4})(\d\d)(\d\d)", (t or "").strip(" "))
        return m and reference(int(m[3]), int(m[2]), int(m[1]))

    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    got = rows.select("x", dates.parse_br(rows.x).alias("br"), dates.parse_loose(rows.x).alias("loose"), dates.parse_compact(rows.x).alias("compact"), dates.reads_loosely(rows.x).alias("reads")).collect()
    told = lambda d: d and (d.date and str(d.date), d.y, d.m, d.d)
    for g in got:
        assert (told(g.br), told(g.loose), told(g.compact)) == (br(g.x), loose(g.x), compact(g.x)), g
        assert g.reads == (g.loose is not None), g


def test_tags_of_a_block_are_read_once(spark):
    assert queries.ofx is ofx
    body = "OFXHEADER:100\n<OFX><BANKTRANLIST><STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20260230<TRNAMT>-1.00<MEMO>Ana - Pix</STMTTRN></BANKTRANLIST></OFX>"
    rows = ofx.blocks(spark.createDataFrame([("p", body)], "path string, text string"))
    made = ofx.transactions(rows)
    assert optimized(made).count("<DTPOSTED>") == 1 and made.count() == 1
