"""Whitening of embeddings along their leading principal components, found by matrix-free block Lanczos.

Vectors become whole numbers x (vectors.whole). The fit list is each distinct x once: its covariance V (divisor n, centred before
multiplying) is never formed. A pass over the fit list gives V times a block of vectors: each task centres its rows and returns the
products of its part, which Spark adds up entry by entry, so the driver gets one table of width x block numbers a pass. The block
Krylov space grows on the driver with full reorthogonalisation; directions that vanish (breakdown) are begun anew with random ones,
a basis that has got too large is restarted from its best Ritz vectors, and the search ends when the residuals of the wanted pairs do,
at the latest when the space is whole. The trace comes from the rows' exact deviations, so the explained shares need no other eigenvalue.

Copies: a vector that many rows share is one row of the fit list, combined before the shuffle; the result is a map over all rows with
a model of width x components numbers.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped, as the contract says; null and repeated ids
stay, one result for each row. Vectors shorter than the longest count as followed by zeros. Components whose eigenvalue is zero but for rounding have
no whitened value and are not returned; so a table of one distinct vector, or of none, gives no components. A deviation that no long holds is null. Extra columns stay, but those
named like a result (in any case of letters) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, free_name, materialise, others, read, schema_with, small_batches
from .vectors import matrix, usable, whole, width

COMPONENTS = 4
#: Vectors multiplied in one pass, most vectors of a basis, and passes after which the search gives up.
BLOCK, BASIS, PASSES = 8, 128, 500
_LONG = 1 << 63


@dataclass
class Whitening:
    """mean and sums of the n vectors of the fit list; components as columns, by falling eigenvalue; their explained shares."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.components / np.sqrt(self.values))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sum)^2 of each row, exact."""
    about = ((x.astype(float) * n - np.array(sums, float)) ** 2).sum(1)
    # below 2^63 every step is exact modulo 2^64
    wrapped = ((x.astype(np.uint64) * np.uint64(n % (1 << 64)) - np.array([s % (1 << 64) for s in sums], np.uint64)) ** 2).sum(1)
    out = wrapped.tolist()
    for i in np.flatnonzero(about > _LONG / 2):
        out[i] = sum((n * int(c) - s) ** 2 for c, s in zip(x[i], sums))
    return out


def _summed(fit: DataFrame, d: int, size: int, of: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """Sum over the batches of fit of an array of `size` numbers; a task returns one sum, Spark adds up the tasks' entry by entry."""
    kind = "decimal(38,0)" if exact else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch.column("x"), d)).ravel()
                total = part if total is None else total + part
        if total is not None:
            entry = pa.array([int(v) for v in total], pa.decimal128(38, 0)) if exact else pa.array(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), entry], ["at", "entry"])

    out = np.zeros(size, object if exact else float)
    for r in fit.mapInArrow(run, f"at long, entry {kind}").groupBy("at").agg(F.sum("entry").alias("entry")).collect():
        out[r["at"]] = int(r["entry"]) if exact else r["entry"]
    return out


def _fresh(block: np.ndarray, basis: np.ndarray, wanted: int, scale: float, draw: np.random.Generator) -> np.ndarray:
    """An orthonormal block that is orthogonal to the basis: what is left of `block`, and random directions where nothing is."""
    d = len(block)
    wanted = min(wanted, d - basis.shape[1])
    out = np.zeros((d, 0))
    for turn in range(10):
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            block = block - out @ (out.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        u = u[:, s > 1e-12 * scale][:, : wanted - out.shape[1]]
        for _ in range(2):
            u = u - basis @ (basis.T @ u)
            u = u - out @ (out.T @ u)
            u = np.linalg.qr(u)[0]
        out = np.hstack([out, u])
        if out.shape[1] >= wanted:
            break
        block, scale = draw.standard_normal((d, wanted - out.shape[1])), 1.0
    return out


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, most: int = BASIS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix known by its products, and their vectors as columns."""
    k, most = min(k, d), max(most, 2 * (k + block))
    draw = np.random.default_rng(seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    new = _fresh(draw.standard_normal((d, min(block, d))), basis, block, 1.0, draw)
    least, stale = np.inf, 0
    for _ in range(PASSES):
        image = product(new)
        basis, images = np.hstack([basis, new]), np.hstack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn[:, : k + block], images @ turn[:, : k + block]
        scale = max(abs(values[0]), np.finfo(float).tiny)
        residual = np.linalg.norm(moved[:, :k] - ritz[:, :k] * values[:k], axis=0).max() / scale if basis.shape[1] >= k else np.inf
        # rounding sets a floor, which differs from matrix to matrix: there the residual falls no further
        stale = 0 if residual < least / 2 else stale + 1
        least = min(least, residual)
        if basis.shape[1] == d or residual <= 1e-15 or (residual <= 1e-11 and stale >= 3):
            return np.maximum(values[:k], 0), np.linalg.qr(ritz[:, :k])[0] * 1.0
        new = _fresh(image, basis, block, scale, draw)
        if basis.shape[1] + block > most:
            basis, images = ritz, moved
    raise ArithmeticError(f"no convergence in {PASSES} passes: residual {least}")


def fit_of(rows: DataFrame, vector: str, d: int) -> DataFrame:
    """x: each distinct vector of whole numbers once, as a table in the shared folder."""
    return materialise(rows.where(usable(vector)).select(whole(vector, d).alias("x")).distinct())


def learn(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors; None if there is no vector."""
    small_batches(rows.sparkSession)
    d = width(rows, vector)
    if not d:
        return None
    fit = fit_of(rows, vector, d)

    def counted(x: np.ndarray) -> np.ndarray:
        x = x.astype(object) if np.abs(x.astype(float)).max() > 2**40 else x
        return np.append(x.sum(0).astype(object), len(x))

    *sums, n = _summed(fit, d, d + 1, counted, exact=True).tolist()
    if not n:
        return None
    mean = np.array([s / n for s in sums])

    def product(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ block)

        return _summed(fit, d, block.size, of).reshape(block.shape) / n

    values, vectors = block_lanczos(product, d, components)
    some = values > max(1, d) * 4 * np.finfo(float).eps * max(values[0], np.finfo(float).tiny)
    some &= values > 1e-26 * max(1.0, float(np.abs(mean).max()) ** 2)  # a single vector leaves only the rounding of its mean
    values, vectors = values[some], vectors[:, some]
    m = len(values)
    model = Whitening(n, sums, values, vectors, np.zeros(m), 0.0)

    def proof(x: np.ndarray) -> np.ndarray:
        p = model.project(x)
        spread = sum(v / n / n for v in deviations(x, n, sums))
        return np.concatenate([[spread], p.sum(0), (p.T @ p).ravel()])

    last = _summed(fit, d, 1 + m + m * m, proof) / n
    mean_p, second = last[1 : 1 + m], last[1 + m :].reshape(m, m)
    model.explained = values / last[0] if m else values
    model.identity_error = float(np.abs(second - np.outer(mean_p, mean_p) - np.eye(m)).max(initial=0.0))
    discard(fit)
    return model


def whiten(rows: DataFrame, model: Whitening | None, vector: str) -> DataFrame:
    """The usable rows with deviation (long) and whitened (array<double>, a value for each component of the model)."""
    kept = others(rows.where(usable(vector)), "deviation", "whitened")
    if model is None:
        return kept.limit(0).withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")})
    d, m, x_name = len(model.sums), len(model.values), free_name(kept, "_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(x_name), d)
            exact = [v if v < _LONG else None for v in deviations(x, model.n, model.sums)]
            p = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m), pa.array(model.project(x).ravel()))
            at = [i for i, c in enumerate(batch.schema.names) if c != x_name]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(exact, pa.int64()), p], [*(batch.schema.names[i] for i in at), "deviation", "whitened"])

    # a session may know more columns of one table under one name than Arrow takes: the batch keeps their order
    return kept.withColumn(x_name, whole(vector, d)).mapInArrow(run, schema_with(kept, "deviation long, whitened array<double>"))


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """A row for each usable row of embeddings and component: see the module's docstring."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = learn(rows, "embedding")
    out = whiten(rows, model, "embedding").select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    n, explained, values, error = (model.n, model.explained.tolist(), model.values.tolist(), model.identity_error) if model else (0, [], [], 0.0)
    pick = lambda numbers: F.get(F.array(*[F.lit(float(v)) for v in numbers]).cast("array<double>"), F.col("i"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", pick(explained).alias("explained"), F.lit(error).alias("identity_error"), pick(values).alias("eigenvalue"))
