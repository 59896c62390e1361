"""Recorded rows matched as sets: what the fold in order gives, with few rows left for it."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dedup

NAMES = ["Pix - ANA", "pix - ana", "Pix - ANA | loja", "TED BOB", "BOB LTDA", "BOB - x", "", None, "Çesta", "CESTA", "ANA", "ANA / 2"]
TX = "date string, amount_cents long, direction string, description string, source_order long, account_id string"


def fold(spark, tx, slots):
    """Every bucket in order, by plain loops over the keys that the library makes."""
    frame = spark.createDataFrame([(n,) for n in NAMES], "description string")
    keys = {r.description: (r.k, r.p) for r in frame.select("description", dedup.text.comparison_key(F.col("description")).alias("k"), dedup.text.counterparty_key(F.col("description")).alias("p")).collect()}
    free, out = {}, Counter()
    for d, c, w, n, _ in sorted(slots, key=lambda r: r[4]):
        free.setdefault((d, c, w), []).append(n)
    for d, c, w, n, at, _ in sorted(tx, key=lambda r: r[4]):
        have = free.get((d, c, w), [])
        same = lambda m, n=n: keys[m][0] == keys[n][0]
        party = lambda m, n=n: bool(keys[n][1]) and keys[m][1] == keys[n][1]
        at_ = next((i for i, m in enumerate(have) if same(m)), next((i for i, m in enumerate(have) if party(m)), None))
        differs = at_ is None and bool(have)
        at_ = 0 if at_ is None and have else at_
        out[(at, at_ is None, None if at_ is None else have.pop(at_), differs)] += 1
    return out


@pytest.mark.parametrize("seed,names", [(1, 12), (2, 3), (3, 2), (4, 7)])
def test_sets_give_what_the_fold_gives(spark, seed, names):
    r = random.Random(seed)
    pick = lambda: (f"2026-01-{r.randint(1, 6):02}", r.randint(1, 6), r.choice(["credit", "debit"]), r.choice(NAMES[:names]))
    tx = [(*pick(), i, "a") for i in range(260)]
    slots = [(*pick(), i) for i in range(200)]
    a = spark.createDataFrame(tx, TX).withColumn("date", F.to_date("date")).repartition(3)
    b = spark.createDataFrame(slots, "date string, amount_cents long, direction string, description string, row_order long").withColumn("date", F.to_date("date")).repartition(3)
    got = Counter((x.source_order, x.is_new, x.recorded_as, x.name_differs) for x in dedup.match_recorded(a, b).collect())
    assert got == fold(spark, tx, slots)


def test_few_rows_are_contested(spark):
    """An import that overlaps the sheet: names repeat, some came back written otherwise; Python sees the contested rows only."""
    r = random.Random(8)
    days = [f"2026-01-{d:02}" for d in range(1, 29)]
    tx = [(r.choice(days), r.randint(1, 4000), "credit", f"Pix - NAME {r.randrange(300)}", i, "a") for i in range(4000)]
    tx += [("2026-01-01", 5, "debit", "Tarifa", 10_000 + i, "a") for i in range(500)]
    slots = [(d, c, w, n if r.random() < 0.8 or n == "Tarifa" else n[6:] + f" {r.randrange(99)}", i) for d, c, w, n, i, _ in tx if r.random() < 0.6]
    a = spark.createDataFrame(tx, TX).withColumn("date", F.to_date("date"))
    b = spark.createDataFrame(slots, "date string, amount_cents long, direction string, description string, row_order long").withColumn("date", F.to_date("date"))
    assert dedup.match_recorded(a, b).count() == len(tx)
    keys = {"_key": dedup.text.comparison_key(F.col("description")), "_party": dedup.text.counterparty_key(F.col("description"))}
    both = a.select(*dedup.BUCKET, "description", F.lit(1).alias("_kind")).unionByName(b.select(*dedup.BUCKET, "description", F.lit(0).alias("_kind")))
    n = {x.how: x["count"] for x in dedup.ways(both.withColumns(keys)).groupBy("how").count().collect()}
    assert n.get(None, 0) < 0.05 * sum(n.values()) and n["key"] > 0.5 * sum(n.values())
