"""The ledger's batches: all of their rows or none, once."""

import pytest

from ledgerloom.operators import ledger

HASHED = "hash string, date date, description string, direction string, amount_cents bigint, account_id string"


def frame(spark, *names, month=1):
    rows = [(n, f"2026-{month + i % 3:02}-05", "x", "credit", i, "a") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, HASHED.replace("date date", "date string")).selectExpr("hash", "cast(date as date) AS date", "description", "direction", "amount_cents", "account_id")


def hashes(spark, path):
    return sorted(r.hash for r in ledger.load(spark, path).collect())


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/ledger"
    assert hashes(spark, path) == [] and ledger.append(frame(spark, "a", "b"), path)
    real = ledger.publish

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(ledger, "publish", dies)
    with pytest.raises(KeyboardInterrupt):
        ledger.append(frame(spark, "c", "d", "e"), path)
    assert hashes(spark, path) == ["a", "b"]
    monkeypatch.setattr(ledger, "publish", real)
    # the same batch again: its rows once, whatever the first attempt left
    assert ledger.append(frame(spark, "c", "d", "e"), path) and not ledger.append(frame(spark, "c", "d", "e").repartition(3), path)
    assert hashes(spark, path) == ["a", "b", "c", "d", "e"]
    assert not ledger.append(frame(spark).limit(0), path)


def test_of_two_writers_of_a_batch_one_wins(spark, tmp_path, monkeypatch):
    """Both have written their rows before either publishes."""
    path, held, real = f"{tmp_path}/ledger", [], ledger.publish
    monkeypatch.setattr(ledger, "publish", lambda *a: held.append(a) or True)
    for _ in range(2):
        ledger.append(frame(spark, "a", "b", "c"), path)
    ledger.append(frame(spark, "x", month=4), path)
    assert hashes(spark, path) == []
    assert [real(*a) for a in held] == [True, False, True]
    assert hashes(spark, path) == ["a", "b", "c", "x"] and len(ledger.batches(spark, path)) == 2
    assert not real(*held[0][:2], held[0][2], "another attempt")
    plan = ledger.load(spark, path).where("competence_key = '2026-04'")
    assert plan.count() == 1 and "competence_key" in plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_a_ledger_without_manifests_is_read(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    ledger.entries(frame(spark, "old", "older")).write.partitionBy("competence_key").parquet(path)
    assert ledger.append(frame(spark, "new"), path) and hashes(spark, path) == ["new", "old", "older"]
