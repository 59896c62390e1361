"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins, each bin has a value in the feature's lookup table, and a score is the logistic of the sum
of the values. Tables are learnt by cyclic boosting: round after round, each feature in turn gets a tree of three leaves
on its own bins, fitted to the gradient that is left. Then the pairs of features that explain most of the rest get
two-dimensional tables, boosted by trees of four leaves. Scoring is one table addition for each feature and pair.

The model is fitted on at most FIT_ROWS labelled documents, those with the smallest hashes of their ids; features are
counted over whole texts, and every document is scored.

Defined results: a null or empty text has zero counts and gets the score of such texts. Labels that are null, or of a null
doc_id, teach nothing; of several labels of a document the worst counts. Without labels of both kinds the score is the
share of good labels, 0.5 if there are none. Very long texts are counted whole. Repeated rows are each scored; extra columns stay, but one
named score (in any case of letters) is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import COUNTS, counts, with_counts
from .shared import by_chunk, held_out, in_share, materialise, others, read, schema_with

#: The most labelled rows that a fit takes to the driver.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
#: From this score on a document is good.
GOOD = 0.3
FEATURES = ("words", "word_length", "symbols", "repeated_lines", "repeated_words", "distinct", "upper", "digits", "marks", "ends", "shouts", "wide", "lines")


def matrix(c: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, c["n_distinct"] / words,
            c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_ends"] / words, c["n_shouts"] / words, c["n_wide"] / chars, c["n_lines"] / words,
        ]
    )


def _leaves(g: np.ndarray, h: np.ndarray, splits: int, least: float = 1.0, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton values of a tree on ordered bins with so many greedy splits, and its gain."""
    edges, total = [0, len(g)], 0.0
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(splits):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:]):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            gl, hl, gr, hr = gs[at] - gs[a], hs[at] - hs[a], gs[b] - gs[at], hs[b] - hs[at]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
            gain[(hl < least) | (hr < least)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), int(at[gain.argmax()]))
        if best[1] is None:
            break
        total += best[0]
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out, total


def _square(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of four leaves on a grid: one split of the rows, then one of the columns on either side."""
    best = (np.zeros_like(g), 0.0)
    for i in range(1, len(g)):
        (a, x), (b, y) = (_leaves(g[s].sum(0), h[s].sum(0), 1) for s in (slice(None, i), slice(i, None)))
        if x + y > best[1]:
            best = (np.vstack([np.tile(a, (i, 1)), np.tile(b, (len(g) - i, 1))]), x + y)
    return best


@dataclass
class Additive:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[at[:, j]]
        for i, j, t in self.pairs:
            total += t[at[:, i] * PAIR_BINS // BINS, at[:, j] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1) -> Additive:
    """x: rows of features, y: 1 for good."""
    share = y.mean() if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = Additive(0.0, edges, [np.zeros(BINS) for _ in edges], [])
    if not 0 < share < 1:
        model.base = 0.0 if not len(y) else (6.0 if share else -6.0)
        return model
    model.base = float(np.log(share / (1 - share)))
    at = model.bins(x)
    total = np.full(len(x), model.base)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(len(edges)):
            g, h = left()
            leaf, _ = _leaves(np.bincount(at[:, j], g, BINS), np.bincount(at[:, j], h, BINS), 2)
            model.tables[j] += rate * leaf
            total += rate * leaf[at[:, j]]
    coarse = at * PAIR_BINS // BINS
    cell = lambda i, j, w: np.bincount(coarse[:, i] * PAIR_BINS + coarse[:, j], w, PAIR_BINS**2).reshape(PAIR_BINS, -1)
    g, h = left()
    gains = sorted(((_square(cell(i, j, g), cell(i, j, h))[1], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains]
    for _ in range(rounds // 3):
        for i, j, table in model.pairs:
            g, h = left()
            leaf, _ = _square(cell(i, j, g), cell(i, j, h))
            table += rate * leaf
            total += rate * leaf[coarse[:, i], coarse[:, j]]
    return model


def labelled(counts_: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the fit_rows documents with the smallest id hashes, a document that repeats with the same counts once; at
    most that many rows reach the driver."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labels = labels.where(in_share(labels.count(), 1.5 * fit_rows, F.lit(8), "doc_id"))
    rows = counts_.join(labels, "doc_id").dropDuplicates(["doc_id", *COUNTS]).orderBy(F.xxhash64(F.col("doc_id"), F.lit(8)), *COUNTS).limit(fit_rows).toPandas()
    return matrix({c: rows[c].to_numpy(np.int64) for c in COUNTS}), (rows["quality"].to_numpy() == 1).astype(float)


def text_counts(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return by_chunk(docs.select(F.col("doc_id").cast("long"), "text"), lambda b: with_counts(b, ["doc_id"]), schema)


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Additive:
    """A model from the labelled ones of docs; the texts of the others aren't looked at twice."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("known")).distinct()
    # ids of at most twice fit_rows documents, which bounds the broadcast; docs may hold fewer of them
    chosen = known.where(in_share(known.count(), 1.5 * fit_rows, F.lit(8), "known")).limit(fit_rows * 2)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("known"), "left_semi")
    return fit(*labelled(text_counts(own), labels, fit_rows))


def scored(docs: DataFrame, model: Additive) -> DataFrame:
    """docs with a score; one pass over the texts, no shuffle."""
    rows = others(docs, "score")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(matrix(counts(batch.column("text"))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return by_chunk(rows, each, schema_with(rows, "score double"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = materialise(text_counts(docs))
    model = fit(*labelled(found.where(~held_out("doc_id", 5, 0)), labels))

    def each(batches):
        for b in batches:
            score = model.score(matrix({c: b.column(c).to_numpy() for c in COUNTS}))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = found.mapInArrow(each, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
