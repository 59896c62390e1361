"""Closings of a stream are those of the whole table, whatever order its files bring the lines in."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import proof
from ledgerloom.streaming import day_close


def test_late_lines_fall_in_their_place(spark, tmp_path):
    r = random.Random(3)
    lines = []
    for account in ("a", "b", "c"):
        balance, n = 0, 0
        for day in range(1, 9):
            for _ in range(r.randint(0, 4)):
                v = r.randint(-50, 50)
                balance += v
                lines.append((account, day, n := n + 1, False, v))
            lines.append((account, day, n := n + 1, True, balance + (day == 5)))
    # files by day, but a third of the lines comes a day late; at the end a line of another account, far on
    files = [[x for x in lines if x[1] == d and r.random() < 2 / 3] for d in range(1, 9)]
    here = {id(x) for f in files for x in f}
    for d in range(1, 9):
        files[min(d, 7)] += [x for x in lines if x[1] == d and id(x) not in here]
    files += [[("z", 20, 1, False, 1)], [("z", 21, 2, False, 1)]]
    schema = "file_id string, at timestamp, line_no long, is_close boolean, cents long"
    frame = lambda rows: spark.createDataFrame(rows, schema.replace("at timestamp", "d int")).selectExpr("file_id", "timestamp'2026-01-01' + make_interval(0, 0, 0, d - 1, 0, 0, line_no) AS at", "line_no", "is_close", "cents")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, rows in enumerate(files):
            frame(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            query = day_close.closings(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        got = sorted(map(tuple, spark.read.schema(day_close.CLOSINGS).parquet(f"{tmp_path}/out").collect()))
    finally:
        spark.conf.set(key, before)
    whole = frame(lines).withColumns({"amount_cents": F.col("cents"), "balance_cents": F.col("cents")})
    want = proof.day_close(whole).select("file_id", "day_no", "moved_cents", "declared_cents", "expected_cents", "agrees").collect()
    assert got == sorted(map(tuple, want)) and len(got) == 24 and sum(x[5] is False for x in got) == 6
