"""A port's answers about columns: believed only where the cells confirm them, each for itself."""

from ledgerloom.operators import refine

CELLS = "sheet string, row int, col string, kind string, value string, style string"


def book(spark):
    rows = []
    for r in range(1, 7):
        rows += [("a", r, "B", "text", f"0{r}/01/2026", None), ("a", r, "C", "text", "Pix", None), ("a", r, "F", "number", "5", "0.00"), ("a", r, "G", "number", "46000", "14"), ("a", r, "H", "formula", "1", None)]
    rows += [("b", 1, "B", "number", "46000", "dd/mm/yyyy"), ("b", 1, "C", "text", "x", None), ("b", 1, "D", "number", "1", None), ("b", 1, "E", "number", "1", None)]
    headers = [("a", c, "?") for c in "BCFGHK"] + [("b", "B", "Data"), ("b", "C", "Historico"), ("b", "D", "Entrada"), ("b", "E", "Saida")]
    return spark.createDataFrame(rows, CELLS), spark.createDataFrame(headers, "sheet string, col string, header string")


def verdicts(spark, *pairs):
    def port(items):
        return [(x["index"], [{"col": c, "role": r} for c, r in pairs]) for x in items]

    found, told, failures = refine.profiles(*book(spark), ["sheet"], port)
    # all of b's roles stand in its headers: it is not asked about
    assert {r.sheet for r in told.collect()} == {"a"} and failures.count() == 0
    return {r.sheet: r for r in found.collect()}, [r.verdict for r in told.orderBy("pos").collect()]


def test_each_answer_for_itself(spark):
    found, said = verdicts(spark, ("F", "date"), ("B", "date"), ("G", "date"), ("C", "description"), ("C", "category"), ("F", "in"), ("H", "out"), ("H", "balance"), ("K", "out"), ("Z", "out"), ("C", None))
    no, again = "the cells do not confirm it", "answered already"
    assert said == [no, refine.ACCEPTED, again, refine.ACCEPTED, again, refine.ACCEPTED, no, refine.ACCEPTED, no, "no such column", "no such role"]
    a, b = found["a"], found["b"]
    assert (a.source, a.missing, a.warnings, a.date_col, a.in_col, a.balance_col) == ("usual", ["out"], [refine.USUAL], "B", "F", "H") and "H" in a.forbidden
    assert (b.source, b.missing, b.warnings, b.in_col, b.out_col) == ("headers", [], [], "D", "E")


def test_a_port_that_fails_or_is_absent_leaves_the_usual_letters(spark):
    def broken(items):
        raise ValueError("no connection")

    for port, warnings in ((broken, ["ValueError: no connection", refine.USUAL]), (None, [refine.USUAL]), (lambda items: [], [refine.USUAL])):
        found, told, failures = refine.profiles(*book(spark), ["sheet"], port)
        a = {r.sheet: r for r in found.collect()}["a"]
        assert (a.source, a.warnings, a.date_col) == ("usual", warnings, "B") and told.count() == 0 and failures.count() == (port is broken)
