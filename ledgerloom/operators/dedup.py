"""What is already recorded: ordinals and hashes, the ledger, and the match that uses up recorded rows one by one.

tx: date, description, direction, amount_cents, account_id, source_order, and path (the file) where there are several. existing: date, description, direction,
amount_cents, row_order (the order of the sheet).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.steps import stored

#: Hashes of a batch (some 90 bytes each with their month) that are sent to every task which reads the ledger.
FEW_HASHES = 200_000
BUCKET = ["date", "amount_cents", "direction"]


def with_hashes(tx: DataFrame) -> DataFrame:
    """ordinal (0, 1, ... of equal transactions of a day of one file, in its order) and hash. The file isn't in the hash: the same
    transaction of two files that overlap has one."""
    rows = tx.withColumn("_key", text.comparison_key(F.col("description")))
    file = ["path"] if "path" in tx.columns else []
    same = W.partitionBy(*file, "date", "direction", "amount_cents", "_key", "account_id").orderBy("source_order")
    rows = rows.withColumn("ordinal", (F.row_number().over(same) - 1).cast("long"))
    payload = F.concat_ws("|", dates.unpadded(F.col("date")), "direction", "amount_cents", "_key", "account_id", "ordinal")
    return rows.withColumn("hash", F.sha2(payload, 256)).drop("_key")


def once(hashed: DataFrame) -> DataFrame:
    """hashed with is_repeat: whether an earlier file (by path) of the batch has the hash too."""
    if "path" not in hashed.columns:
        return hashed.withColumn("is_repeat", F.lit(False))
    nth = F.row_number().over(W.partitionBy("hash").orderBy("path", "source_order"))
    return hashed.withColumn("is_repeat", nth > 1)


def ledger_keys(hashed: DataFrame, ledger: DataFrame, few: int = FEW_HASHES) -> DataFrame:
    """competence_key and hash, once each, of what the ledger knows of hashed. hashed is read twice: hand in a table (see steps.stored).

    The ledger is the large side, and it is on the left of a semi-join, so that it is cut before anything moves. Its months are a literal list,
    one entry for each month of the batch: other months' files are not opened. Up to `few` hashes go to every task, and no row of the ledger is
    shuffled but those found. Of more, keys alone meet by a shuffle, and Spark filters the ledger's scan by a Bloom filter of its own making
    (spark.sql.optimizer.runtime.bloomFilter) where the ledger is large and the batch is not. An empty batch opens nothing."""
    asked = hashed.select(dates.competence(F.col("date")).alias("competence_key"), "hash")
    size = asked.agg(F.count("*").alias("n"), F.collect_set("competence_key").alias("months")).first()
    own = ledger.where(F.col("competence_key").isin(*size["months"])).select("competence_key", "hash")
    asked = asked.distinct()
    return own.join(F.broadcast(asked) if size["n"] <= few else asked, ["competence_key", "hash"], "left_semi").distinct()


def not_in_ledger(hashed: DataFrame, ledger: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """hashed with competence_key, without what the ledger knows; keys: its ledger_keys, if they are there already."""
    keys = ledger_keys(hashed, ledger) if keys is None else keys
    return hashed.withColumn("competence_key", dates.competence(F.col("date"))).join(keys, ["competence_key", "hash"], "left_anti")


def in_ledger(hashed: DataFrame, ledger: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """hashed with competence_key, what the ledger knows; keys as in not_in_ledger."""
    keys = ledger_keys(hashed, ledger) if keys is None else keys
    return hashed.withColumn("competence_key", dates.competence(F.col("date"))).join(keys, ["competence_key", "hash"], "left_semi")


def match_counts(tx: DataFrame, existing: DataFrame) -> DataFrame:
    """How many of each bucket are new: those beyond its recorded rows, whatever their names. Map-side sums, one shuffle."""
    both = tx.select(*BUCKET, F.lit(1).alias("t"), F.lit(0).alias("e")).unionByName(existing.select(*BUCKET, F.lit(0).alias("t"), F.lit(1).alias("e")))
    sums = both.groupBy(*BUCKET).agg(F.sum("t").cast("long").alias("n_tx"), F.sum("e").cast("long").alias("n_slots"))
    return sums.where("n_tx > 0").withColumn("n_new", F.greatest(F.lit(0), F.col("n_tx") - F.col("n_slots")))


class _Slots:
    """Recorded rows of one bucket; each is taken once: the first free one of the name, else of the counterparty, else any."""

    def __init__(self):
        self.said: list[str] = []
        self.queues: dict[tuple, deque[int]] = {}
        self.used: list[bool] = []

    def add(self, key: str, party: str, said: str) -> None:
        for q in (("key", key), ("party", party), ("any",)):
            self.queues.setdefault(q, deque()).append(len(self.said))
        self.said.append(said)
        self.used.append(False)

    def take(self, key: str, party: str) -> tuple[bool, str | None, bool]:
        """is_new, recorded_as, name_differs."""
        for q in (("key", key), ("party", party), ("any",)):
            waiting = self.queues.get(q) if q != ("party", "") else None
            while waiting:
                i = waiting.popleft()
                if not self.used[i]:
                    self.used[i] = True
                    return False, self.said[i], q[0] == "any"
        return True, None, False


def _use_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets one after the other, recorded rows before the incoming ones, both in order; only the slots of one bucket are held."""
    bucket, slots = None, _Slots()
    for batch in batches:
        out = []
        names = [*BUCKET, "_kind", "_key", "_party", "_said"]
        for *at, kind, key, party, said in zip(*(batch.column(c).to_pylist() for c in names)):
            if at != bucket:
                bucket, slots = at, _Slots()
            if kind:
                out.append(slots.take(key, party))
            else:
                slots.add(key, party, said)
        rows = batch.column("_row").filter(pc.equal(batch.column("_kind"), 1))
        found = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([rows, *found], ["_row", "is_new", "recorded_as", "name_differs"])


def ways(met: DataFrame) -> DataFrame:
    """met (the rows of buckets that have both kinds) with how: the way in which a bucket can be matched as a set, or null if it can't.

    key: every name has as many recorded rows as transactions, or the bucket has one name. Nobody takes a row of another name, so equal
    names pair off in order. party: no name in common, but one counterparty. any: neither names nor counterparties in common. In both of
    these, rows pair off in the order of the bucket. In any other bucket a transaction may take what another one would have
    taken by name: it is contested, and the order decides."""
    by = lambda *c: W.partitionBy(*BUCKET, *c)
    asks, slots = F.col("_kind") == 1, F.col("_kind") == 0
    for c in ("_key", "_party"):
        met = met.withColumns({f"{c}_t": F.count_if(asks).over(by(c)), f"{c}_s": F.count_if(slots).over(by(c))})
    shared = lambda c: (F.col(f"{c}_t") > 0) & (F.col(f"{c}_s") > 0)
    of = by()
    met = met.withColumns(
        {
            "_fits": F.bool_and(F.col("_key_t") <= F.col("_key_s")).over(of), "_one_key": F.min("_key").over(of) == F.max("_key").over(of), "_keys": F.bool_or(shared("_key")).over(of),
            "_one_party": (F.min("_party").over(of) == F.max("_party").over(of)) & (F.max("_party").over(of) != ""), "_parties": F.bool_or(shared("_party") & (F.col("_party") != "")).over(of),
        }
    )
    how = F.when(F.col("_fits") | F.col("_one_key"), "key").when(~F.col("_keys") & F.col("_one_party"), "party").when(~F.col("_keys") & ~F.col("_parties"), "any")
    return met.withColumn("how", how).drop("_fits", "_one_key", "_keys", "_one_party", "_parties", *[f"{c}_{x}" for c in ("_key", "_party") for x in "ts"])


def pair_off(settled: DataFrame) -> DataFrame:
    """_row, is_new, recorded_as, name_differs of rows whose bucket is matched as a set: the nth transaction takes the nth recorded row."""
    group = F.when(F.col("how") == "key", F.col("_key")).otherwise("")
    rows = settled.withColumn("_g", group).withColumn("_n", F.row_number().over(W.partitionBy(*BUCKET, "_g", "_kind").orderBy("_at")))
    pair = W.partitionBy(*BUCKET, "_g", "_n")
    slot = F.col("_kind") == 0
    rows = rows.withColumns({"_met": F.count_if(slot).over(pair) > 0, "recorded_as": F.max(F.when(slot, F.col("_said"))).over(pair)})
    return rows.where("_kind = 1").select("_row", (~F.col("_met")).alias("is_new"), "recorded_as", (F.col("_met") & (F.col("how") == "any")).alias("name_differs"))


def match_recorded(tx: DataFrame, existing: DataFrame) -> DataFrame:
    """tx with is_new, recorded_as and name_differs; each recorded row absorbs one transaction.

    The result depends on the order within a bucket (day, cents, direction). Most buckets are matched as sets, by ranks (see ways): their
    rows stay in the JVM. Only contested ones are run through in order, each in one task, as a stream: time is linear in its rows and memory
    in its recorded rows. Buckets without recorded rows take part in neither.
    """
    # new expressions: the two may come from one table
    slots = existing.select(*[F.col(c).alias(c) for c in (*BUCKET, "description", "row_order")])
    taken = slots.select(*BUCKET).distinct()
    keys = {"_key": F.coalesce(text.comparison_key(F.col("description")), F.lit("\0")), "_party": F.coalesce(text.counterparty_key(F.col("description")), F.lit(""))}
    mine = tx.join(taken, BUCKET, "left_semi").withColumns(keys)
    mine = mine.select(*BUCKET, F.lit(1).alias("_kind"), F.col("source_order").cast("long").alias("_at"), "_key", "_party", F.lit(None).cast("string").alias("_said"), F.struct(*tx.columns).alias("_row"))
    theirs = slots.withColumns(keys).select(*BUCKET, F.lit(0).alias("_kind"), F.col("row_order").cast("long").alias("_at"), "_key", "_party", F.col("description").alias("_said"), F.lit(None).alias("_row"))
    met = stored(ways(mine.unionByName(theirs)))
    schema = f"_row {mine.schema['_row'].dataType.simpleString()}, is_new boolean, recorded_as string, name_differs boolean"
    contested = met.where("how is null").repartition(*BUCKET).sortWithinPartitions(*BUCKET, "_kind", "_at").mapInArrow(_use_up, schema)
    found = pair_off(met.where("how is not null")).unionByName(contested).select("_row.*", "is_new", "recorded_as", "name_differs")
    free = tx.join(taken, BUCKET, "left_anti").select(*tx.columns, F.lit(True).alias("is_new"), F.lit(None).cast("string").alias("recorded_as"), F.lit(False).alias("name_differs"))
    return found.unionByName(free)


def deduplicate(tx: DataFrame, ledger: DataFrame, existing: DataFrame) -> DataFrame:
    """tx with ordinal, hash, competence_key, status (new, known_hash, recorded), recorded_as and name_differs.

    What the ledger knows is set aside first and uses up no recorded row; so is what an earlier file of the batch has too.
    """
    hashed = stored(once(with_hashes(tx)))  # read by the counts, the lookup and each way on
    repeats = hashed.where("is_repeat").withColumn("competence_key", dates.competence(F.col("date"))).drop("is_repeat")
    hashed = hashed.where("not is_repeat").drop("is_repeat")
    keys = stored(ledger_keys(hashed, ledger))
    known = in_ledger(hashed, ledger, keys).unionByName(repeats)
    matched = match_recorded(not_in_ledger(hashed, ledger, keys), existing)
    status = F.when(F.col("is_new"), "new").otherwise("recorded")
    matched = matched.withColumn("status", status).drop("is_new")
    known = known.withColumns({"status": F.lit("known_hash"), "recorded_as": F.lit(None).cast("string"), "name_differs": F.lit(False)})
    return matched.unionByName(known.select(*matched.columns))
