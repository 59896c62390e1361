import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cascade, categories, dedup, profile, rules
from ledgerloom.sources import rulebook

RULE = {"id": "r1", "ativo": True, "rotulo": "Rent", "direcao": "saida", "quando": {"nome": "Maria Souza", "contem": ["ALUGUEL"], "valorCents": {"min": 5, "max": 900}}, "excecoes": ["ESTORNO"], "categoriaChave": "ALUGUEL", "contaId": "a", "aliasesSim": ["MARIA S"], "aliasesNao": ["MARIA X"], "prioridade": 3, "origem": "minerada"}


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def book_of(spark, *texts):
    return rulebook.read(rows(spark, [(f"p{i}", t) for i, t in enumerate(texts)], "path string, text string"))


def said(book):
    return sorted(r.warning for r in book.warnings.collect())


def test_a_rules_document_is_read_whole(spark):
    book = book_of(spark, json.dumps({"versao": 1, "carteiras": [{"id": "c", "nome": "Shop", "impressoes": ["f", 3, "g"], "regras": [RULE], "dispensadas": ["saida|X"], "atualizadoEm": "now"}], "ultimaCarteiraId": "c"}))
    r, s = book.rules.first(), book.sets.first()
    assert (r.rule_id, r.active, r.label, r.direction, r.name, r.terms, r.min_cents, r.max_cents, r.exceptions) == ("r1", True, "Rent", "out", "Maria Souza", ["ALUGUEL"], 5, 900, ["ESTORNO"])
    assert (r.category_key, r.account_id, r.aliases_yes, r.aliases_no, r.priority, r.origin) == ("ALUGUEL", "a", ["MARIA S"], ["MARIA X"], 3, "minerada")
    assert (s.set_id, s.set_name, s.fingerprints, s.dismissed, s.updated) == ("c", "Shop", ["f", "g"], ["saida|X"], "now")
    assert book.last.first().last_id == "c" and said(book) == []
    again = rulebook.read(rulebook.documents(book))
    assert again.rules.drop("path").collect() == book.rules.drop("path").collect() and again.sets.drop("path").collect() == book.sets.drop("path").collect()


@pytest.mark.parametrize("text, warnings, n_sets", [("{oops", 1, 0), ("[1]", 1, 0), ("", 0, 0), ("  ", 0, 0), (None, 0, 0), ('{"carteiras": 5}', 0, 0), ('{"versao": 9, "carteiras": []}', 1, 0), ('{"carteiras": [4, {"id": 7}, {"id": "a"}, {"id": "a"}]}', 3, 1)])
def test_no_document_fails(spark, text, warnings, n_sets):
    book = book_of(spark, text)
    assert len(said(book)) == warnings and book.sets.count() == n_sets and book.rules.count() == 0


def test_bad_rules_are_left_out_with_a_reason(spark):
    bad = [5, RULE | {"categoriaChave": ""}, RULE | {"id": "x", "direcao": "up"}, RULE, RULE, RULE | {"id": "off", "ativo": False}, RULE | {"id": "q", "quando": {"valorCents": {"min": 1}}}]
    book = book_of(spark, json.dumps({"carteiras": [{"id": "c", "regras": bad}], "ultimaCarteiraId": "gone"}))
    assert [(r.rule_id, r.direction, r.active) for r in book.rules.orderBy("pos").collect()] == [("x", "out", True), ("r1", "out", True), ("off", "out", False)]
    assert len(said(book)) == 5 and book.last.count() == 0


def test_a_document_is_saved_in_place(spark, tmp_path):
    path = f"{tmp_path}/rules.json"
    for name in ("one", "two"):
        book = book_of(spark, json.dumps({"carteiras": [{"id": name, "regras": [RULE]}]}))
        rulebook.save(rulebook.documents(book), path)
        assert [s.set_id for s in rulebook.load(spark, path).sets.collect()] == [name]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["rules.json"]


def test_choice_and_dismissals(spark):
    book = book_of(spark, json.dumps({"carteiras": [{"id": "a", "impressoes": ["f"]}, {"id": "b", "impressoes": ["f", "g"]}], "ultimaCarteiraId": "b"}))
    asked = rows(spark, [("p0", "f"), ("p0", "g"), ("p0", "h"), ("p9", "f")], "path string, fingerprint string")
    assert {(r.path, r.fingerprint): (r.set_id, r.reason) for r in rulebook.chosen(book, asked).collect()} == {("p0", "f"): ("a", "fingerprint"), ("p0", "g"): ("b", "fingerprint"), ("p0", "h"): ("b", "last"), ("p9", "f"): (None, "new")}
    key = spark.range(1).select(rulebook.suggestion_key(F.lit("out"), F.lit("Pix enviado Maria")).alias("k")).first().k
    assert key == "saida|MARIA"
    left = rulebook.dismiss(book, rows(spark, [("p0", "a", key), ("p0", "a", key)], "path string, set_id string, key string")).sets
    assert {s.set_id: s.dismissed for s in left.collect()} == {"a": [key], "b": []}


def test_fingerprint_ignores_order_case_and_accents(spark):
    def of(sheets, columns, options):
        make = lambda data, *names: rows(spark, [("w", *([x] if isinstance(x, str) else x)) for x in data], ", ".join(f"{n} string" for n in ("path", *names)))
        return rulebook.fingerprints(make(sheets, "sheet"), make(columns, "col", "header"), make(options, "option")).first().fingerprint

    one = of(["Janeiro", "MAIO"], [("b", "Data"), ("C", "Descrição")], ["Salário ", "Gás"])
    assert one == of(["maio", "janeiro", ""], [("C", "DESCRICAO"), ("B", "data")], ["gas", "salario"])
    assert one != of(["Janeiro"], [("b", "Data"), ("C", "Descrição")], ["Salário ", "Gás"])


def test_flow_class_is_exact_but_for_case(spark):
    known = categories.default_categories(spark)
    assert known.count() == 37
    got = categories.with_flow_class(rows(spark, [("GÁS",), ("Gas",), ("Salário ",), (None,)], "category string"), known)
    assert {r.category: r.flow_class for r in got.collect()} == {"GÁS": "GASTOS VARIÁVEIS", "Gas": "", "Salário ": "", None: ""}


CELL = "path string, sheet string, sheet_no int, row int, col string, kind string, value string, style string, formula string"


def cell(sheet, row, col, value, kind="text", style=None, no=0):
    return ("w", sheet, no, row, col, kind, value, style, None)


def test_lists_of_content_validation_and_reference(spark):
    data = [cell("MAIO", 13 + i, "D", ["Rent", "Food", "Rent ", "rent"][i % 4]) for i in range(12)] + [cell("MAIO", 13 + i, "C", f"who {i % 5}") for i in range(12)]
    data += [cell("MAIO", 13 + i, "G" if i % 2 else "F", "5", "number") for i in range(12)] + [cell("MAIO", 13 + i, "J", f"free {i}") for i in range(12)]
    data += [cell("Lista ", i, "B", x, no=1) for i, x in ((1, "Opções"), (2, " Food "), (3, "Rent"), (4, ""), (5, "Water"))]
    cells = rows(spark, data, CELL)
    headers = rows(spark, [("w", "C", "Descrição"), ("w", "D", "Categoria"), ("w", "E", "Tipo"), ("w", "J", "Nota")], "path string, col string, header string")
    made = lambda *v: rows(spark, [("w", *x) for x in v], "path string, sheet string, sheet_no int, sqref string, formula string, later boolean")
    found = lambda v: {r.col: r for r in profile.list_columns(cells, v, headers, ["path"], 13).collect()}
    got = found(made())
    assert set(got) == {"D"} and got["D"].source == "content" and got["D"].options == ["Rent", "Food"]
    got = found(made(("MAIO", 0, "D13:D99 E13", "Lista!$B:$B", False), ("MAIO", 0, "D1:D5", '"no"', False), ("JUNHO", 1, "D13", '"late"', True)))
    assert got["D"].options == [" Food ", "Rent", "Water"] and got["D"].source == "range" and got["D"].source_ref == "Lista!$B:$B" and got["E"].options == [" Food ", "Rent", "Water"]
    assert [(e.context, e.option, e.flow) for e in got["D"].examples][:3] == [("who 0", "Rent", "in"), ("who 1", "Food", "out"), ("who 2", "Rent ", "in")] and len(got["D"].examples) == 8
    assert found(made(("MAIO", 0, "D13", "Nowhere!$A:$A", False), ("JUNHO", 1, "D14", '"x,y"', True)))["D"].options == ["x", "y"]


def test_ranges_and_inline_lists(spark):
    refs = rows(spark, [("D13:D254 F13:F20",), ("$b$2",), ("E5:C3",), ("junk 1:2",)], "sqref string")
    assert sorted((r.sqref, r.col, r.first_row, r.last_row) for r in profile.ranges_of(refs).collect()) == [("$b$2", "B", 2, 2), ("D13:D254 F13:F20", "D", 13, 254), ("D13:D254 F13:F20", "F", 13, 20), ("E5:C3", "C", 3, 5), ("E5:C3", "D", 3, 5), ("E5:C3", "E", 3, 5)]
    got = rows(spark, [(' "a,,b ""q"""',), ("A1:A2",), ('""',)], "f string").select(profile.inline_options(F.col("f")).alias("o")).collect()
    assert [r.o for r in got] == [["a", 'b "q"'], None, []]
    cut = rows(spark, [(["Tipos", "x"], "Tipo"), (["x", "Tipo"], "Tipo"), (["ITEM"], ""), ([], "a")], "o array<string>, h string").select(profile.without_header(F.col("o"), F.col("h")).alias("o")).collect()
    assert [r.o for r in cut] == [["x"], ["x", "Tipo"], [], []]


def test_range_options_of_bounded_and_quoted_references(spark):
    cells = rows(spark, [cell("My list", i, "A", f"v{i}") for i in range(1, 9)] + [cell("MAIO", 1, "A", "own")], CELL)
    refs = rows(spark, [("w", "MAIO", r) for r in ("'My list'!$A$2:$A$4", "=$A:$A", "My list!A7", "'My list'!A1:B3", "x+y")], "path string, sheet string, ref string")
    got = {r.ref: r.options for r in profile.range_options(refs, cells, ["path"]).collect()}
    assert got == {"'My list'!$A$2:$A$4": ["v2", "v3", "v4"], "=$A:$A": ["own"], "My list!A7": ["v7", "v8"]}
    assert profile.range_options(refs.limit(1), cells, ["path"], 2).first().options == ["v2", "v3"]


def test_conventions_and_gaps(spark):
    data = [cell("MAIO", 13, "B", "1/5", "text", "a"), cell("MAIO", 14, "B", "46000", "number", "b"), cell("MAIO", 15, "B", "46001", "number", "b"), cell("MAIO", 16, "B", None, "empty", "z"), cell("MAIO", 13, "D", None, "empty", "e"), cell("MAIO", 15, "H", None, "empty", "b")]
    styles, days = profile.conventions(rows(spark, data, CELL), ["path"], 13)
    assert {r.col: r.style for r in styles.collect()} == {"B": "b", "D": "e"} and [r.date_as_text for r in days.collect()] == [False]
    at = lambda target: rows(spark, [("w", "MAIO", target)], "path string, sheet string, target int")
    wanted = rows(spark, [("w", "MAIO", "H")], "path string, sheet string, col string")
    assert [profile.chain_gaps(rows(spark, data, CELL), ["path"], at(t), wanted, 13).count() for t in (13, 16, 17, 30)] == [0, 1, 1, 0]


def test_many_rules_meet_by_what_they_need(spark):
    """The pairs of the shuffled way are those of the broadcast one: names, aliases, parts of words, short terms, ranges."""
    texts = ["Pix Maria Souza", "MARIA", "souza lima", "estringa", "ring toss", "Pagto aluguel maio", "x", "", None, "a b c", "José Lima Maria Souza"]
    tx = rows(spark, [(i, t, "in" if i % 2 else "out", 100 * i, "a") for i, t in enumerate(texts)] + [(100 + i, t, "in", 500, None) for i, t in enumerate(texts)], "tx_id int, description string, flow string, amount_cents long, account_id string")
    made = [("r1", "Maria Souza", None, None), ("r2", "maria", ["SOUZA"], None), ("r3", None, ["ring"], None), ("r4", None, ["LUGUEL MA"], None), ("r5", None, ["a"], None), ("r6", "Ana Prado", None, ["JOSE LIMA MARIA SOUZA", "X"]), ("r7", None, ["ring", "toss"], None), ("r8", "lima", ["ri"], None)]
    ruled = rows(spark, [(i, True, i, d, n, t, None, None, None, "CAT", None, y, None, 0, k) for k, (i, n, t, y) in enumerate(made) for d in ("in", "out")], rules.RULES)
    ruled = ruled.withColumn("rule_id", F.concat("rule_id", "direction"))
    few, many, parts = (sorted(map(tuple, rules.matches(tx, ruled, n, most).collect())) for n, most in ((10**6, 9), (0, 10**6), (0, 5)))
    assert few == many == parts and len(few) > 20 and {r[1][:2] for r in few} >= {"r1", "r3", "r4", "r5", "r6", "r7"}


def test_ports_answer_by_index_and_may_fail(spark):
    items = rows(spark, [(i, f"n{i}") for i in range(10)], "k int, name string").coalesce(1)
    got = cascade.asked_in_batches(items, lambda b: [(x["index"], x["k"] * 2) for x in b if x["k"] != 3] + [(0, -1), (99, 5)], "int", 4)
    assert [r.answer for r in got.orderBy("k").collect()] == [0, 2, 4, None, 8, 10, 12, 14, 16, 18]

    def fails(b):
        if b[0]["k"] == 4:
            raise RuntimeError("down")
        return [(x["index"], 1) for x in b]

    got = cascade.asked_in_batches(items, fails, "int", 4).orderBy("k").collect()
    assert [r.answer for r in got] == [1] * 4 + [None] * 4 + [1] * 2 and {r.failure for r in got} == {None, "RuntimeError: down"}


def test_cascade_asks_only_what_waits(spark):
    tx = rows(spark, [(0, "Pix Maria Souza"), (1, "Maria Lima"), (2, "Maria Braga"), (3, "mercado"), (4, "Mercado"), (5, "feira")], "tx_id int, description string").selectExpr("*", "'out' AS flow", "100L AS amount_cents", "'a' AS account_id")
    ruled = rows(spark, [("r", True, "Maria", "out", "Maria Souza", None, None, None, None, "RENT", None, None, None, 0, 0)], rules.RULES)
    options = rows(spark, [("Rent", 0), ("Food", 1)], "option string, pos int")
    seen = rows(spark, [], "x int")  # the ports run elsewhere; what they were asked shows in the answers
    identity = lambda b: [(x["index"], x["name"] == "MARIA LIMA") for x in b]
    classifier = lambda b: [(x["index"], {"MERCADO": "food", "FEIRA": "nothing"}.get(x["_key"], "rent")) for x in b]
    decided, learnt, failures = cascade.categorise(tx, ruled, options, identity, classifier)
    got = {r.tx_id: (r.option, r.decided_by, r.via_agent) for r in decided.collect()}
    assert got == {0: ("Rent", "user", False), 1: ("Rent", "user", True), 2: ("Rent", "model", False), 3: ("Food", "model", False), 4: ("Food", "model", False), 5: (None, None, False)}
    assert learnt.first().aliases_yes == ["MARIA LIMA"] and learnt.first().aliases_no == ["MARIA BRAGA"] and failures.count() == 0 and seen.count() == 0
    assert cascade.decision_summary(decided).first().asDict() == {"by_user": 2, "by_agent": 1, "by_house": 0, "by_model": 3, "without": 1}

    def down(b):
        raise OSError("no network")

    decided, learnt, failures = cascade.categorise(tx, ruled, options, down, down)
    assert {(r.stage, r.failure) for r in failures.collect()} == {("identity", "OSError: no network"), ("classifier", "OSError: no network")}
    assert learnt.first().aliases_no == [] and decided.where("option is not null").count() == 1


def test_equal_rows_of_two_files_are_one(spark):
    """Two copies of a statement: equal transactions count by file, and what both have is written once."""
    one = [(i, "2026-01-0%d" % (i % 3 + 1), "x", "credit", 5, "a") for i in range(9)]
    tx = rows(spark, [(p, *r) for p in ("f1", "f2") for r in one], "path string, source_order long, d string, description string, direction string, amount_cents long, account_id string").selectExpr("path", "source_order", "cast(d as date) AS date", "description", "direction", "amount_cents", "account_id")
    hashed = dedup.with_hashes(tx)
    assert hashed.select("hash").distinct().count() == 9 and hashed.agg(F.max("ordinal")).first()[0] == 2
    ledger = hashed.where("false").selectExpr("date_format(date, 'yyyy-MM') AS competence_key", "hash")
    found = dedup.deduplicate(tx, ledger, tx.where("false").withColumnRenamed("source_order", "row_order"))
    assert {(r.path, r.status): r["count"] for r in found.groupBy("path", "status").count().collect()} == {("f1", "new"): 9, ("f2", "known_hash"): 9}


def test_rules_are_removed_by_id(spark):
    ruled = rows(spark, [("a", 0), ("b", 1), ("c", 2)], "rule_id string, pos int")
    assert [r.rule_id for r in rules.removed(ruled, ruled.where("rule_id = 'b'")).orderBy("pos").collect()] == ["a", "c"]
