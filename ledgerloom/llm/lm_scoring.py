"""Language-model scoring by a hidden Markov model of words, beside an add-one unigram score.

Words are told apart by 64-bit hashes of their lower-cased bytes. Each is of a class: a word of a bounded list of frequent
ones is its own class, another one is of the class of its last letters. The model emits classes from hidden states, and a
word from its class by its corpus count: log p(text) = log p(classes), by the scaled forward recursion over the whole
text, + sum of log (c+1)/(N_class+V_class+1). Its tables have a fixed size whatever the corpus.

1. The frequent words are the most counted ones of all training documents: batches send a count for each of their words,
   Spark adds them up and keeps the top ones. A pass over the texts then writes, for each batch of documents, its sequence of
   classes and, by bucket of words, which rare word is in which document how often. (Frequent words are counted on the spot,
   so no bucket is hot.)
2. A bucket has all occurrences of its words: it counts them over the training documents, and sends back to each batch
   the sums of log10(c+1) of its documents. N and V add up over the buckets.
3. Baum-Welch over all training documents, each text one sequence. It starts from classes clustered by what stands before and after
   them, counted over all of these documents, too. Each task returns expected counts of states and classes, Spark adds them up, and the
   driver, which holds only the model, re-estimates it. No count, class or parameter comes from a sample.
4. Each batch meets its sums, and its documents are scored.

Defined results: a null or empty text is its end alone; a very long one is one sequence. A null doc_id counts as training. Rows with
repeated ids are scored one by one. Without training tokens the counts are zero and the score of words is that of an untaught model. Extra
columns don't come through. An empty table has no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_chunk, chunks, held_out, materialise, partitions_for, read, release, small_batches
from .words import MIX, Words, mixed, range_hashes, words_of

#: Frequent words with a class of their own, and classes of the rest.
FREQUENT, ENDINGS = 8192, 1023
STATES, ROUNDS = 8, 2
#: Bins into which the neighbours of a class are counted: of one class each, and of all others; rounds of clustering by these counts, and tries.
OWN_BINS, OTHER_BINS, CLUSTER_ROUNDS, TRIES = 40, 8, 15, 8
END = FREQUENT + ENDINGS
CLASSES = END + 1
_BUCKET = 8 << 20
_FLUSH = 1 << 20
#: Text of a batch, and words of the sequences that step together.
_BATCH, _TOGETHER = 4 << 20, 1 << 18

_ENCODED = "batch long, bucket long, n int, ids array<long>, held array<boolean>, data binary"
_HELD = 7, 2


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def lowered(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and the class of its last three bytes."""
    buf = words.buf.copy()
    buf[(buf >= 65) & (buf <= 90)] += 32
    if not len(words.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tail = np.zeros(len(words.start), np.uint64)
    for back in (1, 2, 3):
        at = words.end - back
        tail = tail * np.uint64(257) + np.where(at >= words.start, buf[np.maximum(at, 0)], 0).astype(np.uint64)
    return range_hashes(buf, words.start, words.end), (mixed(tail * MIX) % np.uint64(ENDINGS)).astype(np.int64)


def _tally(batch: pa.RecordBatch) -> pa.RecordBatch:
    names, often = np.unique(lowered(words_of(batch.column("text")))[0], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(often.astype(np.int64))], ["name", "often"])


def frequent_of(texts: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """Sorted hashes of the most frequent words of all texts; at least two occurrences, ties by hash."""
    counts = by_chunk(texts.select("text"), _tally, "name long, often long").groupBy("name").agg(F.sum("often").alias("often")).where("often > 1")
    best = counts.orderBy(F.desc("often"), "name").limit(most).select("name").toPandas()
    return np.sort(best["name"].to_numpy(np.int64).view(np.uint64))


def classes_of(hashes: np.ndarray, ending: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return FREQUENT + ending
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[at] == hashes, at, FREQUENT + ending)


def _encode(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("data", pa.binary())])
    serial = TaskContext.get().partitionId() << 24
    for batch in (part for b in batches for part in chunks(b, most=_BATCH)):
        parts = []
        done = 0
        for rows in chunks(batch):
            words = words_of(rows.column("text"))
            parts.append((*lowered(words), words.doc + done, words.counts()))
            done += rows.num_rows
        if not parts:
            continue
        hashes, ending, doc, size = (np.concatenate(x) for x in zip(*parts))
        train = ~batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        kind = classes_of(hashes, ending, frequent)
        out = [(serial, -1, batch.num_rows, batch.column("ids").to_pylist(), batch.column("held").to_pylist(), _pack(size.astype(np.int32), kind.astype(np.uint16)))]
        known = kind < FREQUENT
        counts = np.bincount(kind[known & train[doc]], minlength=FREQUENT)
        out.append((serial, -2, batch.num_rows, None, None, _pack(counts)))
        rare = np.flatnonzero(~known)
        if len(rare):
            by = rare[np.lexsort((doc[rare], hashes[rare], hashes[rare] % np.uint64(buckets)))]
            h, d = hashes[by], doc[by]
            post = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
            tf = np.diff(np.append(post, len(by)))
            ph, pd_ = h[post], d[post]
            word = np.flatnonzero(np.concatenate([[True], ph[1:] != ph[:-1]]))
            n_posts = np.diff(np.append(word, len(ph)))
            taught = np.add.reduceat(tf * train[pd_], word)
            wh, we = ph[word], ending[by][post][word]
            bucket = (wh % np.uint64(buckets)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            at = np.append(word, len(ph))
            for a, b in zip(cut, np.append(cut[1:], len(wh))):
                s = slice(at[a], at[b])
                data = _pack(wh[a:b], we[a:b].astype(np.uint16), taught[a:b].astype(np.uint32), n_posts[a:b].astype(np.uint32), pd_[s].astype(np.uint32), tf[s].astype(np.uint32))
                out.append((serial, int(bucket[a]), batch.num_rows, None, None, data))
        serial += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        del parts, out
        release()


_SUMS = pa.schema([("batch", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets of words in order: rows of sums for batches, and one row (batch -1) of the classes' counts and words."""
    total, different = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    sums: dict[int, np.ndarray] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        data = []
        for x in sums.values():
            at = np.flatnonzero(x[0] + x[1])
            data.append(_pack(at.astype(np.uint32), x[0][at], x[1][at].astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.shape[1] for x in sums.values()], pa.int32()), pa.array(data, pa.binary())], schema=_SUMS)

    def bucket(rows: list[dict]) -> None:
        nonlocal held
        parts = [_unpack(r["data"]) for r in rows]
        names, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        count = np.bincount(back, np.concatenate([p[2] for p in parts])).astype(np.int64)
        kind = FREQUENT + np.concatenate([p[1] for p in parts])[first].astype(np.int64)
        np.add.at(total, kind, count)
        np.add.at(different, kind, count > 0)
        log, seen = np.log10(count + 1.0)[back], (count > 0)[back]
        done = 0
        for r, p in zip(rows, parts):
            s = slice(done, done := done + len(p[0]))
            if r["batch"] not in sums:
                sums[r["batch"]] = np.zeros((2, r["n"]))
                held += r["n"]
            x, tf = sums[r["batch"]], p[5].astype(np.float64)
            x[0] += np.bincount(p[4], tf * np.repeat(log[s], p[3]), r["n"])
            x[1] += np.bincount(p[4], tf * np.repeat(seen[s], p[3]), r["n"])

    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and rows[0]["bucket"] != r["bucket"]:
                bucket(rows)
                rows = []
                if held > _FLUSH:
                    yield flush()
                    sums.clear()
                    held = 0
            rows.append(r)
    if rows:
        bucket(rows)
    if sums:
        yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([0], pa.int32()), pa.array([_pack(total, different)], pa.binary())], schema=_SUMS)


@dataclass
class Markov:
    """start: of states; turn: state x state; emit: class x state."""

    start: np.ndarray
    turn: np.ndarray
    emit: np.ndarray


def untaught(states: int = STATES, seed: int = 3) -> Markov:
    r = np.random.default_rng(seed)
    turn = np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * (0.8 - 0.2 / max(1, states - 1))
    emit = 1 + 0.5 * r.random((CLASSES, states))
    return Markov(np.full(states, 1 / states), turn / turn.sum(1, keepdims=True), emit / emit.sum(0))


def _order(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from the longest on, and how many have a word at each step."""
    by = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[by], -np.arange(size.max(initial=0)), "left")
    return by, alive


def forward_logs(model: Markov, kinds: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence of classes, by the scaled forward recursion; all sequences step together."""
    first = np.cumsum(size) - size
    by, alive = _order(size)
    logs = np.zeros(len(size))
    emit, turn = model.emit, model.turn
    now = np.empty((0, len(model.start)))
    for t, n in enumerate(alive):
        e = emit[kinds[first[by[:n]] + t]]
        now = (now[:n] @ turn if t else model.start) * e
        scale = now.sum(1)
        now /= scale[:, None]
        logs[:n] += np.log10(scale)
    out = np.empty(len(size))
    out[by] = logs
    return out


def _steps(alive: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of steps with at most so many words, or one step."""
    out, lo = [], 0
    total = np.concatenate([[0], np.cumsum(alive)])
    while lo < len(alive):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def expected(model: Markov, kinds: np.ndarray, size: np.ndarray, most: int = _TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of whole sequences of classes: of starts, turns and emissions, and the log likelihood.

    The steps go in ranges of at most `most` words. On the way forward the states before each range are kept; on the way back
    a range's own states are found again from them, so memory is bounded however long a sequence is, and no sequence is cut.
    """
    first = np.cumsum(size) - size
    by, alive = _order(size)
    k = len(model.start)
    here = lambda t: kinds[first[by[: alive[t]]] + t]

    def forward(lo: int, hi: int, now: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        up, scales = [], []
        for t in range(lo, hi):
            now = (now[: alive[t]] @ model.turn if t else model.start) * model.emit[here(t)]
            scales.append(now.sum(1, keepdims=True))
            now = now / scales[-1]
            up.append(now)
        return up, scales

    ranges, entry, loss, last = _steps(alive, most), [], 0.0, None
    now = np.empty((0, k))
    for lo, hi in ranges:
        entry.append(now)
        last = forward(lo, hi, now)
        now = last[0][-1]
        loss += sum(float(np.log(x).sum()) for x in last[1])
    turns, emits, down, starts = np.zeros((k, k)), np.zeros((CLASSES, k)), np.ones((0, k)), np.zeros(k)
    for i in range(len(ranges) - 1, -1, -1):
        lo, hi = ranges[i]
        up, scales = last if i == len(ranges) - 1 else forward(lo, hi, entry[i])
        weights, where = [], []
        for t in range(hi - 1, lo - 1, -1):
            n = alive[t]
            back = np.ones((n, k))
            if len(down):
                back[: len(down)] = down @ model.turn.T
            weights.append(up[t - lo] * back)
            where.append(here(t))
            down = model.emit[where[-1]] * back / scales[t - lo]
            if t:
                turns += (up[t - lo - 1] if t > lo else entry[i])[:n].T @ down
        if not lo:
            starts = weights[-1].sum(0)
        at, w = np.concatenate(where), np.concatenate(weights)
        emits += np.column_stack([np.bincount(at, w[:, j], CLASSES) for j in range(k)])
    return starts, turns * model.turn, emits, loss


def improved(starts: np.ndarray, turns: np.ndarray, emits: np.ndarray, prior: float = 0.1) -> Markov:
    """The model of greatest likelihood, with a little weight of the overall class shares in every state."""
    share = (emits.sum(1, keepdims=True) + 1e-2) / (emits.sum() + 1e-2 * len(emits))
    emit = emits + prior * len(emits) * share
    turn, start = turns + 1e-2, starts + 1e-2
    return Markov(start / start.sum(), turn / turn.sum(1, keepdims=True), emit / emit.sum(0))


def _with_ends(kinds: np.ndarray, size: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences, each a whole text and its end; the longest first, so that the long ones step together."""
    stop = np.cumsum(size)
    rows = np.flatnonzero(train)
    rows = rows[np.argsort(-size[rows], kind="stable")]
    n = size[rows].astype(np.int64)
    at = np.arange(int(n.sum())) + np.repeat((stop - size)[rows] - (np.cumsum(n) - n), n)
    return np.insert(kinds[at].astype(np.int64), np.cumsum(n), END), n + 1


def bins_of(counts: np.ndarray) -> np.ndarray:
    """The bin that each class is counted in as a neighbour of others: one each for the end and the most counted of the frequent words (counts: of
    these), some for all others together."""
    bins = OWN_BINS + (mixed((np.arange(CLASSES).astype(np.uint64) + np.uint64(1)) * MIX) % np.uint64(OTHER_BINS)).astype(np.int64)
    top = np.argsort(-counts, kind="stable")[: OWN_BINS - 1]
    bins[top] = np.arange(1, len(top) + 1)
    bins[END] = 0
    return bins


def neighbours(kinds: np.ndarray, size: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """For each class: how often a class of each bin stands before it, and after it, within a sequence."""
    inner = np.ones(max(0, len(kinds) - 1), bool)
    inner[np.cumsum(size)[:-1] - 1] = False
    before, after, width = kinds[:-1][inner], kinds[1:][inner], OWN_BINS + OTHER_BINS
    left = np.bincount(after * width + bins[before], minlength=CLASSES * width).reshape(CLASSES, width)
    right = np.bincount(before * width + bins[after], minlength=CLASSES * width).reshape(CLASSES, width)
    return np.concatenate([left, right], 1)


def _meet(batches: Iterator[pa.RecordBatch], bins: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((CLASSES, 2 * (OWN_BINS + OTHER_BINS)), np.int64)
    for batch in batches:
        for data, held in zip(batch.column("data").to_pylist(), batch.column("held").to_pylist()):
            size, kinds = _unpack(data)
            total += neighbours(*_with_ends(kinds, size, ~np.array(held, bool)), bins)
        release()
    at = np.flatnonzero(total.sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(x) for x in total[at].T)], ["row", *(f"c{j}" for j in range(total.shape[1]))])


def _near(points: np.ndarray, weight: np.ndarray, rounds: int, states: int, seed: int) -> tuple[float, np.ndarray]:
    """The cluster of each point, by weighted means, and how far the points are from their means."""
    r = np.random.default_rng(seed)
    away = lambda c: (points**2).sum(1)[:, None] - 2 * points @ c.T + (c**2).sum(1)
    centres = points[[int(weight.argmax())]]
    while len(centres) < states:  # far from the centres so far, by weight
        far = np.maximum(away(centres).min(1), 0) * weight
        centres = np.concatenate([centres, points[[int(r.choice(len(points), p=far / far.sum())) if far.sum() else 0]]])
    near = away(centres).argmin(1)
    for _ in range(rounds):
        for j in range(states):
            if (near == j).any():
                centres[j] = np.average(points[near == j], 0, weight[near == j])
        near = away(centres).argmin(1)
    return float(away(centres).min(1) @ weight), near


def clustered(met: np.ndarray, rounds: int = CLUSTER_ROUNDS, states: int = STATES, seed: int = 3) -> Markov:
    """A model whose states lean to clusters of classes with like neighbours (met: as by neighbours, of all training documents)."""
    width = met.shape[1] // 2
    sides = met[:, :width].astype(float), met[:, width:].astype(float)
    often = np.maximum(sides[0].sum(1), sides[1].sum(1))
    seen = np.flatnonzero(often)
    model = untaught(states)
    if not len(seen):
        return model
    shares = [(x[seen] + 5 * x.sum(0) / x.sum()) / (x[seen].sum(1, keepdims=True) + 5) for x in sides]
    near = min((_near(np.sqrt(np.concatenate(shares, 1)), often[seen], rounds, states, seed + i) for i in range(TRIES)), key=lambda x: x[0])[1]
    lean = np.full((len(seen), states), 0.2 / states)
    lean[np.arange(len(seen)), near] += 0.8
    emits = np.zeros((CLASSES, states))
    emits[seen] = lean * often[seen][:, None]
    return improved(emits.sum(0), emits.sum(0)[:, None] * model.turn, emits)


def start_model(encoded: DataFrame, frequent: np.ndarray, rounds: int = CLUSTER_ROUNDS) -> Markov:
    """The clusters of classes by their neighbours in all training documents: at most CLASSES rows for the driver. (frequent: the words' classes.)"""
    counts = _added(encoded.where("bucket = -2").select("data"), 1, FREQUENT)[0][: max(1, len(frequent))]
    bins, names = bins_of(counts), [f"c{j}" for j in range(2 * (OWN_BINS + OTHER_BINS))]
    parts = encoded.where("bucket = -1").select("held", "data").mapInArrow(lambda it: _meet(it, bins), "row int, " + ", ".join(f"{x} long" for x in names))
    found = parts.groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
    met = np.zeros((CLASSES, len(names)), np.int64)
    met[found["row"].to_numpy(np.int64)] = found[names].to_numpy(np.int64)
    return clustered(met, rounds)


def _expect(batches: Iterator[pa.RecordBatch], model: Markov) -> Iterator[pa.RecordBatch]:
    k = len(model.start)
    total = [np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))]
    for batch in batches:
        for data, held in zip(batch.column("data").to_pylist(), batch.column("held").to_pylist()):
            size, kinds = _unpack(data)
            kinds, size = _with_ends(kinds, size, ~np.array(held, bool))
            stop = np.cumsum(size)
            lo = 0
            while lo < len(size):  # so many sequences together, or a single one however long
                hi = max(lo + 1, int(np.searchsorted(stop, stop[lo] - size[lo] + _TOGETHER, "right")))
                for t, x in zip(total, expected(model, kinds[stop[lo] - size[lo] : stop[hi - 1]], size[lo:hi])):
                    t += x
                lo = hi
        release()
    rows = np.concatenate([total[2], total[1], total[0][None]])
    at = np.flatnonzero(rows.sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(rows[at, j]) for j in range(k))], ["row", *(f"s{j}" for j in range(k))])


def taught(encoded: DataFrame, model: Markov, rounds: int = ROUNDS) -> Markov:
    """Rounds of Baum-Welch over all training documents; a round brings at most CLASSES + STATES + 1 rows to the driver."""
    k = len(model.start)
    names = [f"s{j}" for j in range(k)]
    texts = encoded.where("bucket = -1").select("held", "data")
    for _ in range(rounds):
        parts = texts.mapInArrow(lambda it, m=model: _expect(it, m), "row int, " + ", ".join(f"{x} double" for x in names))
        found = parts.groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
        if found.empty:
            break
        rows = np.zeros((CLASSES + k + 1, k))
        rows[found["row"].to_numpy()] = found[names].to_numpy()
        model = improved(rows[-1], rows[CLASSES:-1], rows[:CLASSES])
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Markov, counts: np.ndarray, total: np.ndarray, different: np.ndarray, docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of one batch in order: its texts first, then its sums."""
    n_train, n_words = int(total.sum()), int(different.sum())
    word_log = np.log10(counts + 1.0)
    of_class = np.log10(total + different + 1.0)
    below = np.log10(max(1, n_train + n_words + 1))
    now: tuple | None = None

    def done() -> pa.RecordBatch:
        ids, held, size, kinds, sums = now
        release()
        doc = np.repeat(np.arange(len(size)), size)
        own = kinds < FREQUENT
        logs = sums[0] + np.bincount(doc[own], word_log[kinds[own]], len(size)) + np.log10(docs + 1.0)
        known = sums[1] + np.bincount(doc[own], counts[kinds[own]] > 0, len(size)) + (docs > 0)
        stop = np.cumsum(size)
        whole = np.insert(kinds, stop, END)
        hidden = forward_logs(model, whole, size + 1)
        in_class = logs - np.log10(docs + 1.0) - np.bincount(doc, of_class[kinds], len(size))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(size + 1), pa.array(known.round().astype(np.int64)), pa.array(np.full(len(size), n_train)), pa.array(logs - (size + 1) * below), pa.array(hidden + in_class)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    for batch in batches:
        for r in batch.to_pylist():
            if r["ids"] is not None:
                if now is not None:
                    yield done()
                size, kinds = _unpack(r["data"])
                now = r["ids"], r["held"], size.astype(np.int64), kinds.astype(np.int64), np.zeros((2, len(size)))
            else:
                at, logs, known = _unpack(r["data"])
                now[4][0][at] += logs
                now[4][1][at] += known
    if now is not None:
        yield done()


def score_texts(docs: DataFrame, held) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held: which rows don't teach."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("ids"), held.alias("held"), "text")
    training = rows.where(~F.col("held"))
    frequent = frequent_of(training)
    n_docs = training.count()
    parts, buckets = partitions_for(rows, "text", 0.5), partitions_for(rows, "text", 0.5, _BUCKET)
    encoded = materialise(rows.mapInArrow(lambda it: _encode(it, frequent, buckets), _ENCODED))
    words = encoded.where("bucket >= 0").select("batch", "bucket", "n", "data")
    sums = materialise(words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, "batch long, n int, data binary"))
    # counts of the frequent words and of the classes: arrays of fixed length, added up by Spark one class at a time
    counts = _added(encoded.where("bucket = -2").select("data"), 1, FREQUENT)[0]
    total, different = _added(sums.where("batch = -1").select("data"), 2, CLASSES)
    total[:FREQUENT], different[:FREQUENT] = counts, counts > 0
    total[END], different[END] = n_docs, int(n_docs > 0)
    model = taught(encoded, start_model(encoded, frequent))
    meet = encoded.where("bucket = -1").select("batch", F.lit(0).alias("k"), "ids", "held", "data")
    meet = meet.unionByName(sums.where("batch >= 0").select("batch", F.lit(1).alias("k"), "data"), allowMissingColumns=True)
    met = meet.repartition("batch").sortWithinPartitions("batch", "k")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met.mapInArrow(lambda it: _score(it, model, counts, total, different, n_docs), schema)


def _added(packed: DataFrame, arrays: int, length: int) -> np.ndarray:
    names = [f"a{i}" for i in range(arrays)]

    def spread(batches):
        total = np.zeros((arrays, length), np.int64)
        for batch in batches:
            for data in batch.column("data").to_pylist():
                total += np.stack(_unpack(data))
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(x[at]) for x in total)], ["at", *names])

    found = packed.mapInArrow(spread, "at int, " + ", ".join(f"{x} long" for x in names)).groupBy("at").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
    out = np.zeros((arrays, length), np.int64)
    out[:, found["at"].to_numpy(np.int64)] = found[names].to_numpy(np.int64).T
    return out


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"), held_out("doc_id", *_HELD))
