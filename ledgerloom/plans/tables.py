"""Transactions out of the benchmark's tables. Doubles become whole cents first; a double is never summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def orders_tx(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("source_order"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("description"),
        F.when(F.col("o_orderstatus") == "F", "credit").otherwise("debit").alias("direction"), cents("o_totalprice").alias("amount_cents"), F.col("o_custkey").alias("account_id"),
    )


def events_tx(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(
        F.col("event_id").alias("source_order"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("description"),
        F.when(F.col("event_type").isin("purchase", "signup"), "credit").otherwise("debit").alias("direction"), cents("value").alias("amount_cents"), F.col("user_id").cast("string").alias("account_id"),
    )


ORDERS = """SELECT o_orderkey AS source_order, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS description,
 CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS direction, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents, o_custkey AS account_id FROM orders"""
EVENTS = """SELECT event_id AS source_order, CAST(ts AS DATE) AS date, event_type AS description,
 CASE WHEN event_type IN ('purchase', 'signup') THEN 'credit' ELSE 'debit' END AS direction, CAST(round(value * 100) AS BIGINT) AS amount_cents, CAST(user_id AS VARCHAR) AS account_id FROM events"""
