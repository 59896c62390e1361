import json

import pytest

from ledgerloom.plans import importing
from ledgerloom.sources import extractor


def line(n, d, v, s):
    return {"linha": f"L{n}", "data": d, "valor": v, "direcao": "entrada", "descricao": "x", "saldoApos": s}


def answer(rows):
    return "```json\n" + json.dumps({"lancamentos": rows}) + "\n```"


def test_json_repair():
    assert extractor.balanced_json('note {"a": "}{", "b": {"c": 1}} tail') == ('{"a": "}{", "b": {"c": 1}}', False)
    assert extractor.balanced_json('{"a": [1, 2') == (None, True)
    assert extractor.balanced_json("nothing") == (None, False)
    rows, cut = extractor.parse_answer(answer([line(3, "2026-01-02", "R$ 1.234,5", 10.25), {"data": "x", "valor": 1}, line(None, "2026-01-02", None, None), 7]))
    assert not cut and rows == [{"line": 3, "date": "2026-01-02", "description": "x", "direction": "credit", "amount_cents": 123450, "balance_cents": 1025}]


def test_blocks_and_sample(spark):
    texts = spark.createDataFrame([("a", "\n".join(f"row {i}" for i in range(11))), ("b", "")], "path string, text string")
    parts = extractor.blocks(texts, 2)
    got = {(r.path, r.block): r.body for r in parts.collect()}
    assert got[("a", 5)] == "L11| row 10" and len(got) == 7
    assert sorted((r.path, r.block) for r in extractor.witness_blocks(parts).collect()) == [("a", 0), ("a", 3), ("a", 5), ("b", 0)]


def test_extraction(spark):
    texts = spark.createDataFrame([("a", "\n".join(["one", "two", "boom", "four", "five"]))], "path string, text string")

    def extract(body):
        if "boom" in body:
            raise ValueError("no")
        if body.count("\n"):  # too long: cut off, so asked again in halves
            return '{"lancamentos": ['
        n = int(body[1 : body.index("|")])
        return answer([line(n, "2026-01-01", n, n)] * 2)

    found = extractor.extract(extractor.blocks(texts, 2), extract, pause=0)
    rows = found.orderBy("block", "line").collect()
    assert [(r.block, r.line, r.error) for r in rows] == [(0, 1, None), (0, 1, None), (0, 2, None), (0, 2, None), (1, None, "ValueError: no"), (2, 5, None), (2, 5, None)]
    assert [r.line for r in extractor.settled(found).orderBy("line").collect()] == [1, 2, 5]
    assert extractor.extract(texts, None).count() == 0


def test_transient_errors_are_tried_again():
    calls = []

    def extract(body):
        calls.append(body)
        if len(calls) < 3:
            raise extractor.Transient
        return answer([])

    assert extractor._ask(extract, "x", 0) == [] and len(calls) == 3
    with pytest.raises(extractor.Transient):
        extractor._ask(lambda _: (_ for _ in ()).throw(extractor.Transient()), "x", 0)


def test_answers_of_every_kind(spark):
    fence = chr(96) * 3
    made = [("profile", fence + 'json\n{"linhaCabecalho": 12, "colunas": [{"letra": "B", "papel": "data"}]}\n' + fence, "ok"), ("recognition", '{"instituicao": "X"', "cut"), ("recognition", "no idea", "empty"), ("categories", '{"else": 1}', "bad"), ("recognition", None, "empty")]
    for kind, said, status in made:
        got = extractor.answers(spark.createDataFrame([(said,)], "answer string"), kind).first()
        assert got.status == status and (got.parsed is not None) == (status == "ok"), said
    assert set(extractor.ANSWERS) == {"recognition", "profile", "list_columns", "formula_columns", "categories", "identities"}
    batch = spark.createDataFrame([("b", '{"itens": [{"indice": 1, "mesmaPessoa": true}, {"indice": 1, "mesmaPessoa": false}, {"indice": 9, "mesmaPessoa": true}, {"indice": 0, "mesmaPessoa": false}]}')], "batch string, answer string")
    assert {(r["index"], r.said) for r in extractor.indexed(batch, ["batch"], "identities", 3).collect()} == {(0, False), (1, True)}


def test_unknown_files_go_to_the_extractor(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"paid {i}" for i in range(4)))
    (tmp_path / "b.txt").write_text("boom")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")

    def extract(body):
        if "boom" in body:
            raise ValueError("no")
        return answer([line(i + 1, "2026-01-0%d" % (i + 1), i + 5, None) for i in range(4)])

    r = importing.read_statements(spark, str(tmp_path), extract)
    got = {a.path.rsplit("/")[-1]: (a.n_tx, a.reason, a.trusted) for a in r.audit.collect()}
    assert got == {"a.txt": (4, "read by the extractor, not proved", False), "b.txt": (0, "ValueError: no", False), "c.pdf": (0, "not a statement that can be proved: pdf", False)}
    assert r.transactions.count() == 0 and [(x.source_order, str(x.date), x.amount_cents) for x in r.extracted.orderBy("source_order").collect()] == [(i, f"2026-01-0{i + 1}", 100 * (i + 5)) for i in range(4)]
    assert importing.read_statements(spark, str(tmp_path)).extracted is None
