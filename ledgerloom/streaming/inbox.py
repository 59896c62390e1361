"""An inbox of transaction files as a stream: each micro-batch is deduplicated against the ledger and appended to it.

Rows are told apart by their hashes, which count equal transactions by file: the ledger is the same however the inbox is cut into
batches, and a batch that is run again after a failure finds its rows recorded and adds only those that it had not written yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.steps import stored
from ..operators import dedup, ledger

SCHEMA = "source_order bigint, date date, description string, direction string, amount_cents bigint, account_id string"


def stream(spark: SparkSession, inbox: str, schema: str = SCHEMA, files_per_batch: int = 100) -> DataFrame:
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
    return files.withColumn("path", F.col("_metadata.file_path"))


def import_batch(batch: DataFrame, ledger_path: str) -> None:
    hashed = stored(dedup.once(dedup.with_hashes(batch)).where("not is_repeat"))
    ledger.append(dedup.not_in_ledger(hashed, ledger.load(batch.sparkSession, ledger_path)), ledger_path)


def start(tx: DataFrame, ledger_path: str, checkpoint: str) -> StreamingQuery:
    return tx.writeStream.foreachBatch(lambda batch, _: import_batch(batch, ledger_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_totals(tx: DataFrame, late: str = "40 days") -> DataFrame:
    """Totals of each day as they become final; rows later than the watermark allows don't reopen a day."""
    timed = tx.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    sums = timed.groupBy(F.window("at", "1 day"), "direction").agg(F.sum("amount_cents").alias("amount_cents"), F.count("*").alias("n"))
    return sums.select(F.col("window.start").cast("date").alias("date"), "direction", "amount_cents", "n")
