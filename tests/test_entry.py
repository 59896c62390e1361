import os
import subprocess
import sys

import __spark_entry__ as entry_points
from ledgerloom.operators import ledger
from ledgerloom.plans import profile_queries as queries
from ledgerloom.streaming import inbox

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "cumulative_cents" in df.columns


def test_every_library_query_runs(spark):
    for name, f in queries.QUERIES.items():
        df = f(spark, SF)
        assert len(set(df.columns)) == len(df.columns), name
        assert df.count() >= 0, name


def test_rest_works_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry_points.__file__))
    os.makedirs(tmp_path / "ledgerloom")
    for d in os.listdir(f"{root}/ledgerloom"):
        if d not in ("llm", "__pycache__"):
            os.symlink(f"{root}/ledgerloom/{d}", tmp_path / "ledgerloom" / d)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'monthly_dashboard' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_inbox_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "2026-01-0%d" % (i % 3 + 1), "x", "credit", 5, "a") for i in range(9)], "source_order long, d string, description string, direction string, amount_cents long, account_id string")
    rows = rows.selectExpr("source_order", "cast(d as date) AS date", "description", "direction", "amount_cents", "account_id")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the same file again under another name brings nothing
        inbox.start(inbox.stream(spark, f"{tmp_path}/in"), f"{tmp_path}/ledger", f"{tmp_path}/state").awaitTermination()
        assert ledger.load(spark, f"{tmp_path}/ledger").count() == 9
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # both copies in one batch bring what one brings
    rows.coalesce(1).write.parquet(f"{tmp_path}/both")
    rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/both")
    inbox.start(inbox.stream(spark, f"{tmp_path}/both"), f"{tmp_path}/ledger2", f"{tmp_path}/state2").awaitTermination()
    assert ledger.load(spark, f"{tmp_path}/ledger2").count() == 9
    daily = inbox.monthly_totals(inbox.stream(spark, f"{tmp_path}/in"))
    assert daily.isStreaming and daily.columns == ["date", "direction", "amount_cents", "n"]
