"""The append-only ledger of what has been written, and backups that are never overwritten."""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.steps import stored

SCHEMA = "competence_key string, hash string, date date, description string, direction string, amount_cents bigint, category string, account_id string"


def entries(written: DataFrame) -> DataFrame:
    """Ledger rows of hashed transactions."""
    category = F.col("category") if "category" in written.columns else F.lit(None).cast("string")
    return written.select(dates.competence(F.col("date")).alias("competence_key"), "hash", "date", "description", "direction", "amount_cents", category.alias("category"), "account_id")


#: Folder of a ledger's manifests; Spark reads no folder whose name begins so.
MANIFESTS = "_batches"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function that makes its paths."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path
    return where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def batch_name(written: DataFrame) -> str:
    """A name that the batch's hashes give: the same rows written again are the same batch."""
    n = written.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hash")).alias("a"), F.sum(F.xxhash64("hash", F.lit(1)).cast("decimal(20,0)")).alias("b")).first()
    return hashlib.sha256(f"{n['n']}:{n['a']}:{n['b']}".encode()).hexdigest()[:32]


def append(written: DataFrame, path: str) -> bool:
    """Adds a batch: all of its rows or none, once. Whether it was new.

    Two phases. The rows are written to a folder of this attempt's own, by month, few files a month: no reader knows it. Then a manifest that names the
    folder is put in place by one rename, which fails if another writer has published the same batch. A writer that dies before leaves
    files that nothing refers to; the batch is then written anew. Of two writers of one batch the first to rename wins."""
    rows = stored(entries(written))
    spark, name, attempt = rows.sparkSession, batch_name(rows), uuid.uuid4().hex
    fs, where = _files(spark, path)
    manifest = f"{path}/{MANIFESTS}/{name}"
    if fs.exists(where(manifest)):
        return False
    if rows.isEmpty():
        return False
    data = f"{path}/batch={attempt}"
    # dealt by month and a share of the hashes, so that no month is one task
    rows.repartition("competence_key", F.pmod(F.xxhash64("hash"), F.lit(8))).write.partitionBy("competence_key").parquet(data)
    return publish(spark, path, name, attempt)


def publish(spark: SparkSession, path: str, name: str, attempt: str) -> bool:
    """The second phase: a batch's folder becomes part of the ledger, unless the batch is there already."""
    fs, where = _files(spark, path)
    fs.mkdirs(where(f"{path}/{MANIFESTS}"))
    draft = where(f"{path}/{MANIFESTS}/.{attempt}")
    out = fs.create(draft, True)
    out.write(bytearray(attempt.encode()))
    out.close()
    final = where(f"{path}/{MANIFESTS}/{name}")
    try:
        # a rename onto an existing file is refused by Hadoop's file systems; local ones replace it, so look first
        done = not fs.exists(final) and fs.rename(draft, final)
    except Py4JJavaError:
        done = False
    if not done:
        fs.delete(draft, False)
        fs.delete(where(f"{path}/batch={attempt}"), True)
    return done


def batches(spark: SparkSession, path: str) -> dict[str, str]:
    """Published batches and their folders."""
    fs, where = _files(spark, path)
    if not fs.exists(where(f"{path}/{MANIFESTS}")):
        return {}
    found = {}
    for status in fs.listStatus(where(f"{path}/{MANIFESTS}")):
        if not status.getPath().getName().startswith("."):
            with_ = fs.open(status.getPath())
            found[status.getPath().getName()] = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
            with_.close()
    return found


def load(spark: SparkSession, path: str) -> DataFrame:
    """The rows of published batches, by their manifests; empty before the first one."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    fs, where = _files(spark, path)
    found = spark.createDataFrame([], SCHEMA)
    # all folders are one table with its months below them: a filter by month reads those months only
    if folders := [f"{path}/batch={x}" for x in sorted(batches(spark, path).values())]:
        found = spark.read.schema(f"{SCHEMA}, batch string").option("basePath", path).parquet(*folders).select(*names)
    # months of a ledger that was begun without manifests
    if older := [str(x.getPath()) for x in fs.globStatus(where(f"{path}/competence_key=*")) or []]:
        found = found.unionByName(spark.read.schema(SCHEMA).option("basePath", path).parquet(*older).select(*names))
    return found


def backup(df: DataFrame, folder: str, name: str) -> str:
    """A versioned copy; an existing one is an error, not replaced."""
    path = f"{folder}/{name}"
    df.write.mode("error").parquet(path)
    return path
