"""Session helpers of the corpus operators: intermediate tables and Arrow passes over whole texts."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text of one numpy pass. A longer single text is its own pass.
CHUNK_BYTES = 1 << 20
#: Text of one Arrow batch; the session's own limit if that is smaller.
BATCH_BYTES = 8 << 20
#: The word of every corpus operator: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


_OWN: dict[str, str] = {}  # folder of each session that names none


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none: a temporary one in local mode (tests), else one in the
    warehouse, which all executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        local = spark.sparkContext.master.startswith("local")
        _OWN[app] = tempfile.mkdtemp(prefix="corpus-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corpus-{uuid.uuid4().hex}"
    return _OWN[app]


def materialise(df: DataFrame, **options) -> DataFrame:
    """Write df as Parquet in the shared folder (with these writer options) and read it back: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialise wrote, once nothing will read it any more."""
    path = getattr(df, "_stored", None) if df is not None else None
    if path:
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone; the cluster's own cleaning takes over
        pass


def others(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, in any case of letters."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def schema_with(df: DataFrame, more: str) -> StructType:
    """df's columns and more, whatever the names of df's are."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def in_share(total: int, wanted: float, *columns):
    """Whether the hash of these columns falls in the share that brings about `wanted` of `total` rows: a filter, so that a
    sample neither sorts all rows nor takes some from every task."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, total)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, n in enumerate(size):
        if i > first and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    yield batch.slice(first)


def release() -> None:
    """Give freed memory back: a Python worker lives on after its task, and would keep the peak of its arrays."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of BATCH_BYTES at most, so that a worker's memory is bounded."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    if not re.fullmatch(r"\d+b?", now) or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def by_chunk(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, text: str = "text") -> DataFrame:
    """mapInArrow whose function sees one chunk of whole texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                if (out := each(part)) is not None:
                    yield out
            release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def held_out(doc_id: str, folds: int, fold: int):
    """crc32 of the id as text, by folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def partitions_for(df: DataFrame, text: str, blow_up: float, most: int = 64 << 20) -> int:
    """Partitions that keep `blow_up` times the text under `most` bytes each, at least the session's own number."""
    total = df.select(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total * blow_up / most) + 1)
