"""Long plans in steps: expressions that are computed once, tables that are written and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def then(rows: DataFrame, new: dict[str, Column], *keep: str) -> DataFrame:
    """rows' columns (those to keep, or all) and new ones, as one more projection. Spark doesn't merge projections where an expression would
    be copied; only filters are pushed through them, into what they filter by: see `held`."""
    return rows.select(*[F.col(c) for c in keep or rows.columns], *[c.alias(n) for n, c in new.items()])


def held(column: Column) -> Column:
    """The same values; a filter by them stays above the projection that has them, and does not copy what they are made of."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt out by these columns to as many tasks as a shuffle has: parsing costs far more than the bytes by which Spark would
    join small partitions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Rows of a table that one task sorts: a window's memory then stays the same however large the table is.
TASK_ROWS = 100_000


def dealt(rows: DataFrame, counted: DataFrame, *by: str, each: int | None = None) -> DataFrame:
    """rows dealt out by these columns to tasks of about `each` rows (TASK_ROWS by default) of `counted` (the table they come from, whose count is in its files'
    footers), and to as many as a shuffle has at least. What is grouped or ordered by these columns needs no further shuffle, and AQE, which
    joins by compressed bytes, doesn't put several such tasks into one."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, counted.count() // (each or TASK_ROWS) + 1), *by)


def apart(rows: DataFrame, new: dict[str, Column], *keep: str) -> DataFrame:
    """rows' columns (those to keep, or all) and new ones, which are computed once: a generator of one row stands between them and what
    uses them, so that no expression is copied into others, and the code of each step stays below the JVM's limit for a method."""
    return rows.select(*[F.col(c) for c in keep or rows.columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


_OWN: dict[str, str] = {}  # folder of each session that names none


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints. Where the session names none: one in the warehouse, which executors share; in local mode a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        local = spark.sparkContext.master.startswith("local")
        _OWN[app] = tempfile.mkdtemp(prefix="ledger-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ledger-{uuid.uuid4().hex}"
    return _OWN[app]


def own_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what uses it several times computes it once, and a lost executor asks no port twice."""
    path = own_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    """At the end of the driver, if its session is still there; else the cluster's own cleaning takes over."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
