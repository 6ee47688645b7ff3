"""Embedding whitening: pivoted Cholesky of the scatter, Jacobi on its triangular factor.

Spark adds up whole numbers: first counts and sums, then products of what is left after
the rounded mean is taken off, so the covariance is exact before it is a double.  The
driver holds d x d numbers.  A pivoted Cholesky factor L of the covariance has columns
that one-sided Jacobi rotations make orthogonal: L J = U diag(s), so the squared column
norms are the eigenvalues and the normalised columns the components, small ones as
precise as large ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.llm.common import tidied
from cellfold.runtime import written

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries are held within a long.
MOST = float(1 << 62)
#: Rows of vectors that a task works on at once.
ROWS = 4096


def good_vectors(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length there is: the rows whose entries are all finite, and floor(64 c) +
    1,000,000 of these as whole numbers."""
    lengths = pc.fill_null(lists.value_lengths(), -1).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        flat = pc.fill_null(lists.take(pa.array(rows)).flatten().cast(pa.float64()), float("nan"))
        values = flat.to_numpy(zero_copy_only=False).reshape(-1, length)
        fine = np.isfinite(values).all(axis=1)
        if fine.any():
            with np.errstate(over="ignore"):
                whole = np.floor(np.clip(SCALE * values[fine], -MOST, MOST))
            yield rows[fine], whole.astype(np.int64) + SHIFT


def exact(values: np.ndarray, most: int) -> np.ndarray:
    """The same numbers in a type in which sums up to ``most`` are exact."""
    return values.astype(np.float64) if most < 1 << 53 else values.astype(object)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


def whole_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``length, k, total``: sums of entry k, and with k = -1 how many vectors there are."""
    found: dict[int, list] = {}
    for batch in batches:
        for rows, x in good_vectors(batch.column("vector")):
            n, sums = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
            part = exact(x, largest(x) * len(x)).sum(axis=0)
            found[x.shape[1]] = [n + len(rows), sums + np.array([int(v) for v in part], object)]
    for length, (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([length] * (length + 1), pa.int32()), pa.array(range(-1, length), pa.int32()),
             pa.array([Decimal(v) for v in [n, *sums]], pa.decimal128(38, 0))], ["length", "k", "total"])


def scatter(mean: np.ndarray):
    """``i, j, total``: sums of products of entries less ``mean``, for i <= j."""
    d = len(mean)

    def run(batches):
        total = np.zeros((d, d), object)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                for _, x in good_vectors(batch.column("vector").slice(low, ROWS)):
                    if x.shape[1] == d:
                        y = x - mean if largest(x) < 1 << 61 else x.astype(object) - mean
                        y = exact(y, largest(y) ** 2 * len(y))
                        part = y.T @ y
                        total = total + (part.astype(np.int64) if part.dtype != object else part)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "total"])

    return run


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with V = L L', its rows in V's order; as many columns as V has rank."""
    d, left = len(v), v.diagonal().copy()
    factor, done = np.zeros((d, d)), np.zeros(d, bool)
    enough = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        pivot = int(np.where(done, -np.inf, left).argmax())
        if left[pivot] <= enough:
            return factor[:, :k]
        factor[pivot, k] = root = np.sqrt(left[pivot])
        done[pivot] = True
        rest = ~done
        factor[rest, k] = (v[rest, pivot] - factor[rest, :k] @ factor[pivot, :k]) / root
        left[rest] -= factor[rest, k] ** 2
    return factor


def rotated(a: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``a`` times rotations that make its columns orthogonal: all pairs in every sweep,
    those of a round being disjoint."""
    n = a.shape[1]
    a = np.hstack([a, np.zeros((len(a), n % 2))])
    ring = np.arange(a.shape[1])
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            p, q = ring[:half], ring[half:][::-1]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), scale, out=np.zeros_like(gamma), where=scale > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            c = 1 / np.hypot(1, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], np.roll(ring[1:], 1)])
        if worst < 1e-15:
            break
    return a[:, :n]


@dataclass(frozen=True)
class Whitening:
    """n vectors of whole numbers; ``mean`` is the rounded one, ``rest`` the sums without it."""

    n: int
    mean: np.ndarray
    rest: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean).astype(float) - np.array([r / self.n for r in self.rest])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2; None where a long can't hold one."""
        rest = np.array(self.rest, object)
        most = self.n * (largest(x) + largest(self.mean)) + max(map(abs, self.rest), default=0)
        if most**2 * x.shape[1] < 1 << 62:
            return ((self.n * (x - self.mean) - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        sums = ((self.n * (x.astype(object) - self.mean) - rest) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in sums]


def fit(vectors: DataFrame, top: int = COMPONENTS) -> Whitening | None:
    """The covariance's ``top`` components over all good vectors of the length that most
    have (of two, the longer); None without any."""
    sums = written(vectors.select("vector").mapInArrow(tidied(whole_sums), "length int, k int, total decimal(38,0)")
                   .groupBy("length", "k").agg(F.sum("total").alias("total")), "sums")
    best = sums.where("k = -1").orderBy(F.desc("total"), F.desc("length")).first()
    if best is None:
        return None
    d, n = best["length"], int(best["total"])
    total = [int(r["total"]) for r in sums.where((F.col("length") == d) & (F.col("k") >= 0)).orderBy("k").collect()]
    mean = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, mean)]
    products = vectors.select("vector").mapInArrow(tidied(scatter(np.array(mean, np.int64))), "i int, j int, total decimal(38,0)")
    v = np.zeros((d, d))
    for r in products.groupBy("i", "j").agg(F.sum("total").alias("total")).toLocalIterator():
        i, j = r["i"], r["j"]
        # Whole numbers until this division, which rounds once.
        v[i, j] = v[j, i] = (n * int(r["total"]) - rest[i] * rest[j]) / n**2
    turned = rotated(pivoted_cholesky(v))
    norms = np.linalg.norm(turned, axis=0)
    order = np.argsort(-norms, kind="stable")[:top]
    order = order[norms[order] > 0]
    components = turned[:, order] / norms[order]
    components = components * np.where(np.take_along_axis(components, np.abs(components).argmax(axis=0)[None], 0) < 0, -1, 1)
    return Whitening(n, np.array(mean, np.int64), tuple(rest), norms[order] ** 2, components, float(v.trace()))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, measured."""
    k, d = len(model.eigenvalues), len(model.mean)

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, x in good_vectors(batch.column("vector")):
                if x.shape[1] == d:
                    w = np.hstack([model.apply(x), np.ones((len(x), 1))])
                    total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "total"])

    found = np.zeros((k + 1, k + 1))
    sums = vectors.select("vector").mapInArrow(tidied(run), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    for r in sums.toLocalIterator():
        found[r["i"], r["j"]] = r["total"]
    mean = found[:k, k] / model.n
    upper = found[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)
    return float(np.abs(np.triu(upper)).max(initial=0.0))


def whiten(vectors: DataFrame, top: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every good
    row of ``vectors`` (``vec_id, vector`` and any others, which are left out) and component.

    A vector that is null, empty or holds null, NaN or an infinity is left out, as is one of
    another length than most have.  Repeated rows count and come back each; vec_id may be
    null.  Directions in which the vectors don't vary are no components, so equal vectors
    give no rows.  Entries beyond 2^62 are held there; a deviation beyond a long is null.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, top)
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    k, d = len(model.eigenvalues), len(model.mean)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                for rows, x in good_vectors(part.column("vector")):
                    if x.shape[1] != d:
                        continue
                    many = len(rows) * k
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                         pa.array(np.full(many, model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                         pa.array(model.apply(x).reshape(-1)), pa.array(np.tile(model.eigenvalues / model.trace, len(rows))), pa.array(np.full(many, error))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "vector").mapInArrow(tidied(run), schema)
