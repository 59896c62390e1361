import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import arbitrate, dedup, inference, ledger, ordering, proof, report, rules
from ledgerloom.plans import importing

D = lambda n: datetime.date(2026, 1, n)
TX = "date date, description string, direction string, amount_cents long, source_order long, account_id string"


def tx_frame(spark, rows):
    return spark.createDataFrame([(d, n, k, c, i, "acc") for i, (d, n, k, c) in enumerate(rows)], TX)


def test_hash_of_known_text(spark):
    import hashlib

    got = dedup.with_hashes(tx_frame(spark, [(D(7), "Pão  de queijo", "credit", 500), (D(7), "PAO DE QUEIJO", "credit", 500)])).orderBy("source_order").collect()
    want = [hashlib.sha256(f"2026-1-7|credit|500|PAO DE QUEIJO|acc|{i}".encode()).hexdigest() for i in (0, 1)]
    assert [(g.ordinal, g.hash) for g in got] == list(enumerate(want))


def greedy(tx, existing):
    key = lambda s: " ".join(s.upper().split())

    def party(s):
        head = key(s).split("|")[0].split()
        while len(head) > 1 and head[-1] in ("LTDA", "ME"):
            head.pop()
        return " ".join(head)

    pool, out = {}, {}
    for d, n, k, c in existing:
        pool.setdefault((d, k, c), []).append([n, False])
    for i, (d, n, k, c) in enumerate(tx):
        free = [s for s in pool.get((d, k, c), []) if not s[1]]
        named = next((s for s in free if key(s[0]) == key(n)), None) or next((s for s in free if party(s[0]) == party(n)), None)
        slot = named or (free[0] if free else None)
        if slot:
            slot[1] = True
        out[i] = (slot is None, slot and slot[0], slot is not None and named is None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_match_is_the_greedy_one(spark, seed):
    r = random.Random(seed)
    rows = lambda n: [(D(r.randint(1, 6)), r.choice(["ana", "Ana | x", "ana ltda", "bob", "Bob me", "zed"]), r.choice(["credit", "debit"]), r.randint(1, 4)) for _ in range(n)]
    t, e = rows(400), rows(150)
    got = {x.source_order: (x.is_new, x.recorded_as, x.name_differs) for x in dedup.match_recorded(tx_frame(spark, t), tx_frame(spark, e).withColumnRenamed("source_order", "row_order")).collect()}
    assert got == greedy(t, e)
    counts = dedup.match_counts(tx_frame(spark, t), tx_frame(spark, e)).agg(F.sum("n_new")).first()[0]
    assert counts == sum(x[0] for x in got.values())


def test_import_again_adds_nothing(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    tx = tx_frame(spark, [(D(1), "a", "credit", 5), (D(1), "a", "credit", 5), (D(2), "b", "debit", 7)])
    none = spark.createDataFrame([], "date date, description string, direction string, amount_cents long, row_order long")
    sheets = spark.createDataFrame([("JANEIRO",)], "sheet string")
    first = importing.run_import(tx, path, none, sheets, dry_run=True)
    assert {(r.n_new, r.n_duplicates, r.in_cents, r.out_cents) for r in first.report.collect()} == {(3, 0, 10, 7)}
    importing.run_import(tx, path, none, sheets)
    assert ledger.load(spark, path).count() == 3
    importing.run_import(tx, path, none, sheets)
    assert ledger.load(spark, path).count() == 3
    # a known row uses up no recorded one
    slot = spark.createDataFrame([(D(1), "a", "credit", 5, 0)], none.schema)
    again = importing.plan_import(tx_frame(spark, [(D(1), "a", "credit", 5)] * 4), ledger.load(spark, path), slot, sheets)
    assert sorted(r.status for r in again.rows.collect()) == ["known_hash", "known_hash", "new", "recorded"]
    absent = importing.plan_import(tx, ledger.load(spark, f"{tmp_path}/none"), none, spark.createDataFrame([("MAIO",)], "sheet string"))
    assert {r.status for r in absent.rows.collect()} == {"no_sheet"} and [r.sheet for r in absent.missing.collect()] == ["JANEIRO"]


def test_failed_write_leaves_the_ledger(spark, tmp_path):
    none = spark.createDataFrame([], "date date, description string, direction string, amount_cents long, row_order long")
    args = (none, spark.createDataFrame([("JANEIRO",)], "sheet string"))
    tx = tx_frame(spark, [(D(1), "a", "credit", 5)])

    def fail(_):
        raise OSError("disk")

    for on_failure, n in ((False, 0), (True, 1)):
        path = f"{tmp_path}/{on_failure}"
        with pytest.raises(OSError):
            importing.run_import(tx, path, *args, write=fail, ledger_on_failure=on_failure)
        assert ledger.load(spark, path).count() == n
    ledger.backup(tx, str(tmp_path), "v1")
    with pytest.raises(Exception, match="(?i)exists"):
        ledger.backup(tx, str(tmp_path), "v1")


def test_cross_check(spark):
    a = [(D(1), "x", "credit", 5), (D(2), "y", "debit", 5), (D(2), "Tarifa", "debit", 1), (D(3), "z", "credit", 9)]
    b = [(D(1), "X1", "credit", 5), (D(1), "x2", "credit", 5), (D(3), "z", "credit", 9)]
    check = arbitrate.cross_check(tx_frame(spark, a), tx_frame(spark, b))
    assert tuple(check.first()) == (2, 1, 1)
    assert [(x.side, x.description) for x in arbitrate.differences(tx_frame(spark, a), tx_frame(spark, b)).collect()] == [("witness", "x2"), ("chosen", "y")]
    assert arbitrate.verdict(check, True, True).first().level == "proved" and arbitrate.verdict(check, False, False).first().level == "refused"
    same = arbitrate.cross_check(tx_frame(spark, a), tx_frame(spark, a))
    assert arbitrate.verdict(same, True, True).first().level == "corroborated"
    x, y = arbitrate.inner_days(tx_frame(spark, a), tx_frame(spark, b))
    assert (x.count(), y.count()) == (2, 0)


def test_day_close_and_phantoms(spark):
    rows = [(1, False, 10), (2, True, 100), (3, False, -5), (4, False, 7), (5, True, 102), (6, True, 103)]
    lines = spark.createDataFrame([("f", n, c, v, v) for n, c, v in rows], "file_id string, line_no long, is_close boolean, amount_cents long, balance_cents long")
    got = [(r.expected_cents, r.declared_cents, r.agrees) for r in proof.day_close(lines).orderBy("day_no").collect()]
    assert got == [(None, 100, None), (102, 102, True), (102, 103, False)]
    seq = [("a", 1), ("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", None), ("b", None)]
    df = spark.createDataFrame([("f", i, k, b) for i, (k, b) in enumerate(seq)], "f string, i int, k string, b int")
    assert [r.is_phantom for r in proof.phantom_rows(df, "f", "i", ["k"], "b").orderBy("i").collect()] == [False, True, True, False, False, False, False]


def merged(existing, new, order):
    sign = {"ascending": 1, "descending": -1}.get(order, 0)
    queue = sorted([n for n in new if n[1]], key=lambda n: sign * n[1].toordinal()) + [n for n in new if not n[1]] if sign else list(new)
    out, i = [], 0
    for idx, d in existing:
        while d and sign and i < len(queue) and queue[i][1] and sign * queue[i][1].toordinal() < sign * d.toordinal():
            out.append((True, queue[i][0]))
            i += 1
        out.append((False, idx))
    return out + [(True, n[0]) for n in queue[i:]]


def test_sink_plan_is_the_ordered_merge(spark):
    r = random.Random(7)
    existing, new, orders, want = [], [], [], {}
    for g in range(60):
        order = r.choice(["ascending", "descending", "undefined"])
        day = lambda: D(r.randint(1, 9)) if r.random() < 0.85 else None
        e, n = [(i, day()) for i in range(r.randint(0, 6))], [(i, day()) for i in range(r.randint(0, 5))]
        existing += [(g, *x) for x in e]
        new += [(g, *x) for x in n]
        orders.append((g, order))
        want[g] = merged(e, n, order)
    plan = ordering.sink_plan(spark.createDataFrame(existing, "group int, idx int, date date"), spark.createDataFrame(new, "group int, seq int, date date"), spark.createDataFrame(orders, "group int, order string"))
    got = {}
    for x in plan.orderBy("group", "target").collect():
        got.setdefault(x.group, []).append((x.is_new, x["at"]))
    assert got == {g: v for g, v in want.items() if v}


def test_order_needs_evidence(spark):
    rows = [("a", i, D(d) if d else None) for i, d in enumerate((1, 2, 2, None, 3, 1))] + [("b", i, D(d)) for i, d in enumerate((1, 2, 3, 4, 1))] + [("c", 0, D(1))]
    counts = ordering.pair_counts(spark.createDataFrame(rows, "group string, idx int, date date"))
    got = {r.group: (r.ascending, r.descending, r.ties, r.order) for r in ordering.evidence(counts).collect()}
    assert got == {"a": (2, 1, 1, "undefined"), "b": (3, 1, 0, "ascending"), "c": (0, 0, 0, "undefined")}
    both = ordering.combine(counts).first()
    assert (both.ascending, both.descending, both.order) == (5, 2, "undefined")


OPTIONS = [("Recebimento de vendas", 0), ("Taxa de cartão ", 1), ("Aluguel", 2)]


def spoken(spark, rows):
    return spark.createDataFrame([(i, d, f, c, a) for i, (d, f, c, a) in enumerate(rows)], "tx_id int, description string, flow string, amount_cents long, account_id string")


def rule(i, **kw):
    base = {"rule_id": f"r{i}", "active": True, "label": f"rule {i}", "direction": "out", "name": None, "terms": None, "min_cents": None, "max_cents": None, "exceptions": None, "category_key": "ALUGUEL", "account_id": None, "aliases_yes": None, "aliases_no": None, "priority": 0, "pos": i}
    return tuple((base | kw).values())


def test_house_rules(spark):
    rows = [("Pix - João", "in", 1, None), ("Estorno Pix", "in", 1, None), ("Pix - João", "out", 1, None), ("Tarifa pacote", "out", 1, None), ("Tarifa iFood", "out", 1, None), ("Taxa de lixo", "out", 1, None), ("Taxa da maquininha", "out", 1, None), ("Pixel", "in", 1, None)]
    got = [r.house_option for r in rules.with_house_option(spoken(spark, rows), spark.createDataFrame(OPTIONS, "option string, pos int")).orderBy("tx_id").collect()]
    assert got == ["Recebimento de vendas", None, None, "Taxa de cartão ", None, None, "Taxa de cartão ", None]


def test_user_rules(spark):
    found = [
        rule(0, name="Maria Silva"), rule(1, name="Maria Silva", min_cents=100, max_cents=200, category_key="TAXA DE CARTAO"), rule(2, terms=["conta luz"], exceptions=["atraso"]),
        rule(3, name="Zé"), rule(4, active=False, terms=["conta luz"], category_key="TAXA DE CARTAO"), rule(5, name="Bruna", aliases_yes=["BRUNA LIMA"], aliases_no=["BRUNA REIS"]), rule(6, terms=["tarifa"], account_id="k"), rule(7, terms=["x"], category_key="unknown"),
    ]
    rows = [("Pix Maria da Silva", "out", 150, None), ("Pix Maria da Silva", "out", 300, None), ("Maria Souza", "out", 1, None), ("conta de luz", "out", 1, None), ("pg conta luz atraso", "out", 1, None), ("pg conta luz", "out", 1, None), ("Bruna Lima", "out", 1, None), ("Bruna Reis", "out", 1, None), ("Bruna Dias", "out", 1, None), ("Tarifa", "out", 1, "k"), ("Tarifa", "out", 1, "j"), ("Maria Silva", "in", 1, None), ("x", "out", 1, None)]
    out = rules.decide(spoken(spark, rows), spark.createDataFrame(found, rules.RULES), spark.createDataFrame(OPTIONS, "option string, pos int")).orderBy("tx_id").collect()
    got = [(r.option, r.decided_by, r.rule_id, r.pending, r.conflicts, r.against_house) for r in out]
    assert got[0] == ("Taxa de cartão ", "user", "r1", [], ["r0"], False)
    assert got[1] == ("Aluguel", "user", "r0", [], [], False)
    assert got[2] == (None, None, None, ["r0"], [], False)
    assert [g[2] for g in got[3:9]] == [None, None, "r2", "r5", None, None] and got[8][3] == ["r5"] and got[7][3] == []
    assert got[9] == ("Aluguel", "user", "r6", [], [], True) and got[10][:2] == ("Taxa de cartão ", "house")
    assert got[11][:2] == (None, None) and got[12][:2] == (None, None)
    bad = {r.rule_id: r.problems for r in rules.problems(spark.createDataFrame(found + [rule(8), rule(9, name="Pix Ltda"), rule(10, min_cents=5, max_cents=1, terms=["a"]), rule(11, min_cents=1)], rules.RULES)).collect()}
    assert bad["r3"] == ["name too short"] and bad["r8"] == ["no condition"] and bad["r9"] == ["no condition", "generic words only"] and bad["r10"] == ["range reversed"] and bad["r11"] == ["range alone"] and bad["r0"] == []


def test_answers_and_upserts(spark):
    r = spark.createDataFrame([rule(0, name="Bruna", aliases_no=["BRUNA REIS"]), rule(1, name="Ana Lima")], rules.RULES)
    a = spark.createDataFrame([("r0", "Pix Bruna Reis", True, 0), ("r0", "Bruna Dias", True, 1), ("r0", "bruna dias", False, 2)], "rule_id string, name string, applies boolean, pos int")
    out = {x.rule_id: (x.aliases_yes, x.aliases_no) for x in rules.apply_answers(r, a).collect()}
    assert out == {"r0": (["BRUNA REIS"], ["BRUNA DIAS"]), "r1": ([], [])}
    new = rules.upsert(r, spark.createDataFrame([rule(0, label="changed") [:0] + ("r1", *rule(1, label="changed")[1:]), ("r9", *rule(9)[1:])], rules.RULES)).orderBy("pos").collect()
    assert [(x.rule_id, x.label) for x in new] == [("r0", "rule 0"), ("r1", "changed"), ("r9", "rule 9")]


def test_mining(spark):
    seen = [("Pix Ana Lima", "A", "out")] * 3 + [("ANA LIMA", "A", "out"), ("Bia Reis", "A", "out"), ("Bia Reis", "B", "out"), ("Bia Reis", "B", "out")] + [("Solo", "A", "out")] * 5 + [("Caio Dias", "C", "out")] * 3
    h = spark.createDataFrame([(d, c, f, "s", i) for i, (d, c, f) in enumerate(seen)], "description string, category string, flow string, sheet string, pos int")
    assert [(r.name, r.n, r.category, r.examples) for r in rules.mine(h).collect()] == [("ANA LIMA", 4, "A", ["Pix Ana Lima", "ANA LIMA"]), ("CAIO DIAS", 3, "C", ["Caio Dias"])]
    known = spark.createDataFrame([rule(0, name="Lima Ana")], rules.RULES)
    gone = spark.createDataFrame([("out", "CAIO DIAS")], "flow string, name string")
    assert rules.mine(h, rules=known, dismissed=gone).count() == 0
    assert [x.label for x in rules.rule_of_suggestion(rules.mine(h, rules=known)).collect()] == ["C – Caio Dias"]


def test_options_keep_their_spelling(spark):
    o = spark.createDataFrame([("Salário ", 0), ("SALARIO", 1)], "option string, pos int")
    a = spark.createDataFrame([("salario",), ("x",), (None,)], "answer string")
    assert [r.option for r in rules.canonical_options(a, o).collect()] == ["Salário ", None, None]
    assert rules.canonical_options(a, o, last=True).first().option == "SALARIO"


@pytest.mark.parametrize(
    "formula,by,want",
    [("H12+F13-G13", 287, "H299+F300-G300"), ('IF(A1="A1 ""B2""",LOG10(B2),$C$3)', 1, 'IF(A2="A1 ""B2""",LOG10(B3),$C$3)'), ("A1", -1, None), ("SUM(A$1:A5)", 2, "SUM(A$1:A7)"), ("x_A1+AB12", 1, "x_A1+AB13"), ("A1", 0, "A1")],
)
def test_shifted_formulas(formula, by, want):
    assert inference.shift_formula(formula, by) == want


def test_how_far_a_formula_reaches(spark):
    cases = [("H1+F2-G2", 2, -1), ('$G$7&"F1"+A9', 5, 0), ("SUM(A1:B9)", 4, -3), ("LOG10(A3)+x.A1+A$1", 3, 0), ("", 3, 0), ('"A1', 9, 0), ("AB12+$C4", 6, -2)]
    rows = spark.createDataFrame(cases, "f string, r int, want int")
    assert rows.where(inference.least_offset(F.col("f"), F.col("r")) != F.col("want")).collect() == []


def test_formula_columns(spark):
    rows = [("s", 13, "H", "G7+F13-G13"), ("s", 14, "H", "H13+F14-G14"), ("s", 15, "H", "H14+F15-G15"), ("s", 14, "I", "F14*2")]
    cells = spark.createDataFrame([(s, r, c, "formula", "1", "n", f) for s, r, c, f in rows] + [("s", 16, "A", "text", "x", None, None)], "sheet string, row int, col string, kind string, value string, style string, formula string")
    got = {r.col: (r.n, r.model, r.model_row, r.formula_kind, r.column_wide, r.repeats) for r in inference.repeat_formula(inference.formula_columns(cells, 13)).collect()}
    assert got == {"H": (3, "H14+F15-G15", 15, "accumulated", True, True), "I": (1, "F14*2", 14, "row", False, False)}


def test_headers_kinds_and_styles(spark):
    cells = [(r, c, k, v) for r, row in enumerate([["x", "", ""], ["data", "valor", "descricao"], ["1", "2", "PIX - A"], ["3", "4", "PIX - B"]], 1) for c, v in zip("ABC", row) for k in ["text" if not v.isdigit() else "number"] if v]
    df = spark.createDataFrame([("s", r, c, k, v, "0.00" if c == "B" else "dd/mm", None) for r, c, k, v in cells], "sheet string, row int, col string, kind string, value string, style string, formula string")
    role = F.when(F.col("value").isin("data", "valor", "descricao"), F.col("value"))
    assert [(r.row, r.roles) for r in inference.header_rows(df, role).collect()] == [(2, 3)]
    body = df.where("row > 2")
    kinds = {r.col: r.column_kind for r in inference.column_kinds(body, F.col("style") == "dd/mm", F.col("style") == "0.00").collect()}
    assert kinds == {"A": "date", "B": "money", "C": "text"}
    s = inference.description_style(body.where("col = 'C'"), ["sheet"], "value").first()
    assert (s.letter_case, s.separator, s.n_chars) == ("upper", " - ", 14)
    assert {r.col: r.width for r in inference.column_widths(df).collect()}["A"] == pytest.approx(3.55)


def test_report_of_nothing(spark):
    none = spark.createDataFrame([], TX)
    assert report.monthly_balance(none).count() == 0 and tuple(report.totals(none).first()) == (0, 0, 0)
