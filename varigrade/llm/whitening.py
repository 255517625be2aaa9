"""Whitening of vectors with the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

The covariance V is never formed. ``Centred.times`` gives V W for a block W by one pass: every task centres its rows exactly
(n x - S in whole numbers, then divided by n), adds X^T (X W) up, and Spark sums these width x block tables by entry.

The driver holds tables of width x subspace only:

1. Rayleigh-Ritz: the subspace's projected matrix gives approximate pairs (theta, u) with residuals r = V u - theta u.
2. Leading pairs whose residual has reached double precision are locked: they leave the subspace and are projected out of
   all later work.
3. For the leading pairs that are left, the correction equations (I - Q Q^T)(V - theta)(I - Q Q^T) t = -r, with Q the locked
   and the current vectors, are solved by some steps of MINRES. All equations of a round share their passes.
4. The corrections join the subspace, orthonormalised. A subspace that is too wide restarts from its leading pairs.

A last Rayleigh-Ritz among the locked vectors, whose products are computed afresh, puts them in order of eigenvalue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.session import materialize

COMPONENTS = 32
EPS = float(np.finfo(np.float64).eps)
_LIMIT = 2.0 ** 62


def entries(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, x array<long>) of the rows whose vector is neither null nor holds null or non-finite entries.

    An entry c becomes floor(64 c) + 1000000, c taken as double.
    """
    whole = F.col(column).cast("array<double>")
    usable = F.col(column).isNotNull() & F.forall(whole, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return vectors.filter(usable).select(
        F.col(key).cast("long").alias(key), F.transform(whole, lambda c: F.floor(c * 64) + F.lit(1_000_000)).alias("x"))


def _whole(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a table of int64."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


@dataclass(frozen=True)
class Centred:
    """A table of whole-number vectors ``x`` of one width, its row count n and its exact sums S."""

    rows: DataFrame
    n: int
    sums: tuple[int, ...]

    @property
    def width(self) -> int:
        return len(self.sums)

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """n x - S as int64; exact, since n |x| stays far below 2^63."""
        n, sums = self.n, np.array(self.sums, np.int64)
        return lambda x: x * n - sums

    def total(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all rows of ``part(centred rows as double)``, a table of ``shape``.

        A task gives one table; Spark adds tables by entry, so the driver gets one table whatever the number of tasks.
        """
        centre, n, size = self.centre(), self.n, int(np.prod(shape))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size, np.longdouble)
            for batch in batches:
                if batch.num_rows:
                    out += part(centre(_whole(batch.column(0))) / n).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out.astype(np.float64))], ["at", "value"])

        found = self.rows.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
        table = np.zeros(size)
        for row in found.collect():  # one row an entry
            table[row["at"]] = row["value"]
        return table.reshape(shape)

    def times(self, block: np.ndarray) -> np.ndarray:
        """V ``block``, one pass over the rows."""
        return self.total(lambda x: x.T @ (x @ block), block.shape) / self.n


def centred(rows: DataFrame) -> Centred:
    """Count and exact sums of a written table of ``x``; vectors of several widths are refused."""
    widths = [r.width for r in rows.select(F.size("x").alias("width")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("vectors of several widths")
    width = widths[0] if widths else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, low, high = np.zeros(width, np.int64), 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch.column(0))
                sums, count = sums + x.sum(axis=0), count + len(x)
                low, high = (min(low, int(x.min())), max(high, int(x.max()))) if width else (0, 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array([count, *sums.tolist()], pa.int64()),
                                          pa.array([max(-low, high)] * (width + 1), pa.int64())], ["at", "value", "largest"])

    found = rows.select("x").mapInArrow(run, "at long, value long, largest long").groupBy("at").agg(
        F.sum("value").alias("value"), F.max("largest").alias("largest")).collect()  # one row an entry
    value = {r["at"]: r["value"] for r in found}
    n = value.get(0, 0)
    if n and max(r["largest"] for r in found) * n >= 2 ** 62:
        raise OverflowError("n * x does not fit a long")
    return Centred(rows, n, tuple(value[k + 1] for k in range(width)) if n else (0,) * width)


# --- the eigenvectors --------------------------------------------------------------------------------------------

def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``against``; directions that add nothing are left out."""
    for _ in range(2):  # twice is enough
        block = block - against @ (against.T @ block)
        sizes = np.linalg.norm(block, axis=0)
        block = block[:, sizes > 0] / sizes[sizes > 0]
        if not block.shape[1]:
            return block
        basis, size, _ = np.linalg.svd(block, full_matrices=False)
        block = basis[:, size > 1e-10 * size[0]]
    return block - against @ (against.T @ block)


def minres(operator: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Solve ``operator`` t = ``right`` column by column; all columns take their steps together.

    Ends after ``steps``, or when every residual is below ``goal`` of its start.
    """
    size = np.linalg.norm(right, axis=0)
    start = np.where(size > 0, size, 1.0)
    v_old, v = np.zeros_like(right), right / start
    t, w_old, w = (np.zeros_like(right) for _ in range(3))
    beta, eta = np.zeros(right.shape[1]), size.copy()
    c_old, c = np.ones(right.shape[1]), np.ones(right.shape[1])
    s_old, s = np.zeros(right.shape[1]), np.zeros(right.shape[1])
    for _ in range(steps):
        product = operator(v)
        alpha = (v * product).sum(axis=0)
        following = product - alpha * v - beta * v_old
        beta_next = np.linalg.norm(following, axis=0)
        delta = c * alpha - c_old * s * beta
        first = np.hypot(delta, beta_next)
        second, third = s * alpha + c_old * c * beta, s_old * beta
        safe = np.where(first > 0, first, 1.0)
        c_old, s_old = c, s
        c, s = np.where(first > 0, delta / safe, 1.0), np.where(first > 0, beta_next / safe, 0.0)
        w_old, w = w, np.where(first > 0, (v - third * w_old - second * w) / safe, 0.0)
        t = t + c * eta * w
        eta = -s * eta
        v_old, v = v, np.where(beta_next > 0, following / np.where(beta_next > 0, beta_next, 1.0), 0.0)
        beta = beta_next
        if np.all(np.abs(eta) <= goal * start):
            break
    return t


def leading_eigenpairs(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, steps: int = 5,
                       block: int | None = None, tolerance: float | None = None, rounds: int = 500,
                       seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix given by products.

    ``tolerance`` bounds residuals relative to the largest eigenvalue; it defaults to rounding at this width. ``block``
    pairs are corrected per round, with ``steps`` of MINRES each. ``RuntimeError`` after ``rounds``.
    """
    wanted = min(wanted, width)
    block = min(width, block or wanted + 4)
    tolerance = tolerance or 8 * EPS * np.sqrt(width)
    widest = max(4 * block, wanted + 2 * block)  # a whole narrow space fits without a restart
    locked = np.zeros((width, 0))
    basis = _orthonormal(np.random.default_rng(seed).normal(size=(width, block)), locked)
    images = times(basis)
    scale, spare = 0.0, min(block, 4)
    for _ in range(rounds):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        scale = max(scale, float(values[0])) if len(values) else scale
        vectors, products = basis @ turn, images @ turn
        left = wanted - locked.shape[1]
        residual = products - vectors * values - locked @ (locked.T @ products)
        size = np.linalg.norm(residual, axis=0)
        done = size[:left] <= tolerance * scale
        ready = len(done) if done.all() else int(np.argmin(done))  # the leading ones in a row
        if ready:
            locked = np.hstack([locked, vectors[:, :ready] - locked @ (locked.T @ vectors[:, :ready])])
            locked[:, -ready:] /= np.linalg.norm(locked[:, -ready:], axis=0)
            basis, images = vectors[:, ready:], products[:, ready:]
            vectors, products, values = basis, images, values[ready:]
            residual = residual[:, ready:]
        if locked.shape[1] >= wanted:
            return _ordered(times, locked)
        open_pairs = min(vectors.shape[1], wanted - locked.shape[1] + spare, block)
        fixed = np.hstack([locked, vectors[:, :open_pairs]])
        theta = values[:open_pairs]

        def projected(t: np.ndarray) -> np.ndarray:
            t = t - fixed @ (fixed.T @ t)
            t = times(t) - theta * t
            return t - fixed @ (fixed.T @ t)

        right = -residual[:, :open_pairs]
        corrections = minres(projected, right - fixed @ (fixed.T @ right), steps, 0.05)
        if widest < width and basis.shape[1] + open_pairs > widest:  # restart from the leading pairs
            basis, images = vectors[:, : wanted - locked.shape[1] + block], products[:, : wanted - locked.shape[1] + block]
            basis, images = basis[:, : widest - open_pairs], images[:, : widest - open_pairs]
        else:
            basis, images = vectors, products
        fresh = _orthonormal(corrections, np.hstack([locked, basis]))
        if not fresh.shape[1]:  # nothing new: corrections vanish where the subspace is exact already, so try elsewhere
            fresh = _orthonormal(np.random.default_rng(seed + locked.shape[1]).normal(size=(width, 1)),
                                 np.hstack([locked, basis]))
            if not fresh.shape[1]:  # the subspace is everything: residuals are rounding alone
                tolerance *= 2
                images = times(basis)
                continue
        basis, images = np.hstack([basis, fresh]), np.hstack([images, times(fresh)])
    raise RuntimeError("eigenvectors have not converged")


def _ordered(times: Callable[[np.ndarray], np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vectors, _ = np.linalg.qr(vectors)
    small = vectors.T @ times(vectors)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    vectors = vectors @ turn[:, ::-1]
    return values[::-1], vectors / np.linalg.norm(vectors, axis=0)


# --- whitening ---------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """Components in order of falling eigenvalue: unit vectors as columns, eigenvalues, and the trace of the covariance."""

    space: Centred
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def identity_error(self) -> float:
        """Largest absolute entry of the whitened rows' covariance minus the identity, one pass."""
        weights, k = self.weights, len(self.values)
        if not k:
            return 0.0

        def part(x: np.ndarray) -> np.ndarray:
            z = x @ weights
            return np.vstack([z.T @ z, z.sum(axis=0)])

        found = self.space.total(part, (k + 1, k)) / self.space.n
        return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on all of ``rows`` (``x`` of one width). Directions without variance beyond rounding are no components."""
    space = centred(rows)
    if not space.n or not space.width:
        return Whitening(space, np.zeros(0), np.zeros((space.width, 0)), 0.0)
    trace = float(space.total(lambda x: (x * x).sum(axis=0), (space.width,)).sum() / space.n)
    if not trace:
        return Whitening(space, np.zeros(0), np.zeros((space.width, 0)), 0.0)
    values, vectors = leading_eigenpairs(space.times, space.width, components)
    real = values > 64 * EPS * space.width * trace
    return Whitening(space, values[real], vectors[:, real], trace)


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Rows whose vector is null or holds a null or non-finite entry take no part; a zero vector does. Repeated rows are fitted
    and returned as often as they occur, rows without a key too. ``deviation`` is the exact sum of (n x - S)^2, null where
    it would not fit a long. There are at most ``components`` components, fewer where rows vary in fewer directions: none
    for an empty table, a single row or rows that are all alike. Vectors of several widths are refused.
    """
    rows = materialize(entries(vectors, key, column))
    fitted = fit_whitening(rows, components)
    weights, n, k = fitted.weights, fitted.space.n, len(fitted.values)
    explained = fitted.values / fitted.trace if k else fitted.values
    error, centre = fitted.identity_error(), fitted.space.centre()
    schema = pa.schema([("key", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x, rows_here = centre(_whole(batch.column(1))), batch.num_rows
                rough = (x.astype(np.float64) ** 2).sum(axis=1)
                exact = pa.array((x * x).sum(axis=1), pa.int64(), mask=rough >= _LIMIT)
                take = np.repeat(np.arange(rows_here), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(take)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_here)),
                    pa.array(np.full(len(take), n)), exact.take(pa.array(take)), pa.array((x / n @ weights).ravel()),
                    pa.array(np.tile(explained, rows_here)), pa.array(np.full(len(take), error))], schema=schema)

    ddl = "key long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select(key, "x").mapInArrow(run, ddl).withColumnRenamed("key", key)
