"""What the ledger knows of a batch: found without moving the ledger, and the same by every way."""

from pyspark.sql import functions as F

from ledgerloom.operators import dedup, ledger

NAMES = ["hash", "date", "description", "direction", "amount_cents", "account_id"]


def batch(spark, numbers, year=2026):
    """Transactions of a number each, dealt over the months of a year; the hash is the number's."""
    rows = spark.createDataFrame([(n,) for n in numbers], "n int")
    day = F.make_date(F.lit(year), F.col("n") % 12 + 1, F.lit(5))
    return rows.select(F.sha2(F.col("n").cast("string"), 256).alias("hash"), day.alias("date"), F.lit("x").alias("description"), F.lit("credit").alias("direction"), F.col("n").cast("long").alias("amount_cents"), F.lit("a").alias("account_id"))


def numbers(df):
    return sorted(r.amount_cents for r in df.collect())


def test_every_way_finds_the_same(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    for some in (range(0, 300, 2), range(300, 400)):
        ledger.append(batch(spark, some), path)
    ledger.append(batch(spark, range(0, 300, 3), 2025), path)  # the same hashes in other months are others
    known = ledger.load(spark, path)
    asked = batch(spark, [*range(250, 310), *range(250, 260)])
    undated = asked.limit(3).withColumn("date", F.lit(None).cast("date"))
    want = [n for n in [*range(250, 310), *range(250, 260)] if n % 2 == 0 or n >= 300]
    for few in (0, dedup.FEW_HASHES):
        keys = dedup.ledger_keys(asked, known, few)
        assert keys.count() == len(set(want)) and keys.columns == ["competence_key", "hash"]
        assert numbers(dedup.in_ledger(asked, known, keys)) == sorted(want)
        assert len(numbers(dedup.not_in_ledger(asked, known, keys))) == 70 - len(want)
        assert dedup.ledger_keys(undated, known, few).count() == 0 and dedup.not_in_ledger(undated, known).count() == 3
        assert dedup.ledger_keys(asked.limit(0), known, few).count() == 0
        assert dedup.ledger_keys(asked, known.limit(0), few).count() == 0
    assert numbers(dedup.in_ledger(asked, known)) == sorted(want)


def test_the_ledger_stays_where_it_is(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    ledger.append(batch(spark, range(240)), path)
    known, asked = ledger.load(spark, path), batch(spark, [2, 14, 15])  # March and April
    keys = dedup.ledger_keys(asked, known)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    # from the join down to the ledger's scan; what the scan prunes by is printed below it
    left = plan[plan.index("LeftSemi") :]
    left = left[: left.index("\n", left.index("FileScan"))]
    assert "BroadcastHashJoin" in plan and "Exchange" not in left
    filters = left[left.index("PartitionFilters") :]
    assert "2026-03" in filters and "2026-04" in filters and "2026-05" not in filters
    assert "ReadSchema: struct<hash:string>" in left
    assert keys.count() == 3
    many = dedup.ledger_keys(asked, known, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "2026-03" in many[many.index("LeftSemi") :]


def test_a_batch_is_deduplicated_once_computed(spark, tmp_path):
    """The whole of it: ledger first, then repeats of the batch's own files, then recorded rows."""
    tx = batch(spark, range(20)).drop("hash").withColumns({"source_order": F.col("amount_cents"), "path": F.lit("a")})
    again = tx.where("amount_cents < 5").withColumn("path", F.lit("b"))
    path = f"{tmp_path}/ledger"
    ledger.append(dedup.with_hashes(tx.where("amount_cents between 10 and 12")), path)
    existing = tx.where("amount_cents >= 18").select("date", "description", "direction", "amount_cents", F.col("source_order").alias("row_order"))
    got = dedup.deduplicate(tx.unionByName(again), ledger.load(spark, path), existing)
    by = {(r.path, r.amount_cents): r.status for r in got.collect()}
    assert len(by) == 25 == got.count()
    assert {k for k, v in by.items() if v == "known_hash"} == {("a", 10), ("a", 11), ("a", 12)} | {("b", n) for n in range(5)}
    assert {k for k, v in by.items() if v == "recorded"} == {("a", 18), ("a", 19)}
