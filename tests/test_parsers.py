"""Forms of statements that the user adds."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import importing

from .test_sources import csv_text


class Lines:
    """`day|what|cents` a line, under a mark of its own."""

    def __init__(self, name, mark):
        self.name, self.mark = name, mark

    def can_parse(self, path, content, kind):
        return F.startswith(F.decode(F.substring(content, 1, 8), "UTF-8"), F.lit(self.mark))

    def parse(self, found):
        lines = found.select("path", F.posexplode(F.slice(F.split(F.decode("content", "UTF-8"), "\n"), 2, 1000)).alias("source_order", "line")).where("line <> ''")
        part = F.split("line", r"\|")
        cents = F.get(part, F.lit(2)).try_cast("long")
        return lines.select("path", "source_order", F.get(part, F.lit(0)).try_cast("date").alias("date"), F.get(part, F.lit(1)).alias("description"), F.when(cents < 0, "debit").otherwise("credit").alias("direction"), F.abs(cents).alias("amount_cents"), F.lit(None).alias("account_id"), F.col("line").alias("raw_line"))


def test_forms_of_ones_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text(csv_text())
    (tmp_path / "b.csv").write_text("#lines\n2026-01-02|Ana|150\n2026-01-03|Rui|-99\n")
    (tmp_path / "c.txt").write_text("#lines\n2026-01-02|Ana|150\n2026-01-03|Rui|x\n")
    (tmp_path / "d.txt").write_text("#lines\n")
    (tmp_path / "e.txt").write_text("#other\n2026-01-02|Eva|1\n")
    parsers = [Lines("lines", "#lines"), Lines("any", "#")]  # of two that claim a file the first has it
    r = importing.read_statements(spark, str(tmp_path), parsers=parsers)
    audit = {x.path.rsplit("/")[-1]: (x.n_tx, x.reason, x.trusted) for x in r.audit.collect()}
    assert audit == {"a.csv": (3, None, True), "b.csv": (2, None, True), "c.txt": (2, "lines: a row could not be read", False), "d.txt": (0, "lines: no transaction", False), "e.txt": (1, None, True)}
    got = {(x.path.rsplit("/")[-1], x.description, x.direction, x.amount_cents, x.y) for x in r.transactions.where("path not like '%a.csv'").collect()}
    assert got == {("b.csv", "Ana", "credit", 150, 2026), ("b.csv", "Rui", "debit", 99, 2026), ("e.txt", "Eva", "credit", 1, 2026)}
    with pytest.raises(ValueError, match="names of their own"):
        importing.read_statements(spark, str(tmp_path), parsers=[parsers[0], parsers[0]])
    parsers[0].parse = lambda found: found.select("path")
    with pytest.raises(ValueError, match="lines gives no source_order"):
        importing.read_statements(spark, str(tmp_path), parsers=parsers)
