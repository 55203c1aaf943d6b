"""Whitening of embeddings by Jacobi-Davidson on a covariance that is never formed.

Entries become integers (floor of 64 times the entry, plus 1,000,000), so counts, sums and deviations are exact.
The fit list holds each distinct integer vector once. With its mean taken off each entry before anything is
multiplied, one pass over it multiplies the covariance with a block of directions: every task adds up
C'(C B) over its rows C, and only such sums of (dimensions x directions) travel. The search for the
leading eigenvectors runs on the driver over that product alone:

* Rayleigh-Ritz in a growing subspace gives the Ritz pairs and their residuals;
* each unfinished pair's correction equation, projected off the finished vectors and all wanted Ritz vectors, is
  solved roughly by MINRES; the equations of one round advance together, so a step of all costs one pass;
* the corrections extend the subspace, which is cut back to its best Ritz vectors when it is full;
* a pair whose residual has reached double precision is locked and left out of the search. The search ends when the
  wanted largest of all values, locked or not, are locked.

How it spreads: the distinct vectors are found by a partially aggregated grouping, so a vector that a third of all rows
hold leaves each task once, and they are written to the shared folder. A pass sends one block of sums per task; above
`Settings.fan_in` tasks these are first added up in about the square root of as many. The driver holds
blocks of (dimensions x subspace), whatever the number of rows.

Defined cases: rows whose vector is NULL, empty, or holds NULL, NaN, an infinity or an entry beyond 2^47 in size are dropped,
and so are rows whose vector has another length than most rows (of equally frequent lengths the greater counts). NULL and repeated
vec_ids stay, row by row. Directions of no variance can't be whitened: a table of rank r gives r components, equal
vectors or a single row none. An empty table gives an empty result. Eigenvalues that tie have any orthonormal
vectors of their space. A deviation that no 64-bit integer holds is NULL. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base

EPS = float(np.finfo(np.float64).eps)
Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    components: int = 16
    scale: int = 64
    shift: int = 1_000_000
    #: Ritz vectors carried beyond the wanted ones.
    guard: int = 4
    #: Largest subspace, in multiples of the wanted components.
    space: int = 5
    #: MINRES steps a round at most, and the share of a residual that is left then.
    inner_steps: int = 4
    inner_share: float = 0.1
    #: A residual counts as zero at so many units of rounding of the largest eigenvalue, times the root of the dimensions.
    residual_units: float = 4.0
    rounds: int = 500
    #: Blocks of sums that the driver adds up itself.
    fan_in: int = 32
    seed: int = 7


# ---- the integer vectors -------------------------------------------------------------------


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(vec_id, x): the usable rows with their integer vectors, of whatever length."""
    entries = F.col(vector)
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 2.0**47))

    def whole(c: Column) -> Column:
        return (F.floor(c.cast("double") * F.lit(float(settings.scale))) + F.lit(settings.shift)).cast("long")

    kept = embeddings.where(entries.isNotNull() & (F.size(entries) > 0)).where(usable)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, whole).alias("x"))


def common_length(vectors: DataFrame) -> int | None:
    """The most frequent length, of equally frequent ones the greater; None without rows."""
    counted = vectors.groupBy(F.size("x").alias("length")).count()
    first = counted.orderBy(F.desc("count"), F.desc("length")).first()
    return first["length"] if first else None


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


# ---- passes over the fit list --------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """The distinct vectors, and what the first pass found out about them."""

    vectors: DataFrame
    tasks: int
    dims: int
    n: int
    sums: tuple[int, ...]
    fan_in: int

    def centring(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n: the whole part of the mean is taken off exactly, its fraction in double precision."""
        whole, rest = self.parted()
        fraction = np.array([r / self.n for r in rest])
        return lambda x: (x - whole).astype(np.float64) - fraction

    def parted(self) -> tuple[np.ndarray, list[int]]:
        parts = [divmod(s, self.n) for s in self.sums]
        return np.array([q for q, _ in parts], dtype=np.int64), [r for _, r in parts]

    def total(self, block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``block`` (of centred rows) over the fit list."""
        centred, dims = self.centring(), self.dims
        return _summed(self.vectors, lambda b: block(centred(_matrix(b, dims))), shape, self.tasks, self.fan_in)

    def product(self, directions: np.ndarray) -> np.ndarray:
        """The covariance times a block of directions, in one pass."""
        return self.total(lambda c: c.T @ (c @ directions), directions.shape) / self.n


def _summed(
    vectors: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], tasks: int, fan_in: int
) -> np.ndarray:
    """Blocks of one shape added up: in each task, then in few tasks, then here."""

    def adding(to_block: Callable[[pa.RecordBatch], np.ndarray]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, seen = np.zeros(shape), False
            for batch in batches:
                if batch.num_rows:
                    sums, seen = sums + to_block(batch), True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        return run

    def rejoined(batch: pa.RecordBatch) -> np.ndarray:
        return np.sum([np.frombuffer(b).reshape(shape) for b in batch.column("sums").to_pylist()], axis=0)

    partial = vectors.select("x").mapInArrow(adding(block), "sums binary")
    if tasks > fan_in:
        partial = partial.repartition(math.isqrt(tasks - 1) + 1).mapInArrow(adding(rejoined), "sums binary")
    return sum((np.frombuffer(row[0]).reshape(shape) for row in partial.collect()), np.zeros(shape))


#: Sums of whole numbers travel in two halves, which doubles hold exactly for 2^22 rows a task and more.
HALF = 1 << 26


def fit_list(vectors: DataFrame, dims: int, settings: Settings) -> Fit:
    """The distinct vectors of the common length, written, counted and summed exactly."""
    distinct = base.stored(vectors.where(F.size("x") == dims).select("x").distinct(), "whitening-fit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            n, high, low = n + len(x), high + (x // HALF).sum(axis=0), low + (x % HALF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(high), pa.array(low)],
                names=["i", "n", "high", "low"],
            )

    sums = (
        distinct.mapInArrow(count, "i int, n long, high long, low long").groupBy("i")
        .agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
        .orderBy("i").collect()
    )
    tasks = distinct.rdd.getNumPartitions()
    return Fit(distinct, tasks, dims, sums[0]["n"], tuple(int(s["high"]) * HALF + int(s["low"]) for s in sums), settings.fan_in)


# ---- the search ----------------------------------------------------------------------------


def _off(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    return block - basis @ (basis.T @ block)


def _extension(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal directions of the block outside the basis; what is left of rounding alone goes."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = _off(basis, _off(basis, block))
        if not block.size:
            return block
        left, strength, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, strength > 1e-10]
    return block[:, : max(0, basis.shape[0] - basis.shape[1])]


def minres(apply: Product, right: np.ndarray, steps: int, share: float) -> np.ndarray:
    """Approximate solutions of the symmetric systems ``apply(T) = right``, column by column in step.

    A column rests once its residual is at ``share`` of its right side; the others go on.
    """
    k = right.shape[1]
    x, w, w_old, v_old = (np.zeros_like(right) for _ in range(4))
    norm = np.linalg.norm(right, axis=0)
    goal, rest = norm * share, norm.copy()
    v, gamma = right.copy(), norm.copy()
    c, c_old, s, s_old = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    open_ = norm > 0
    for _ in range(steps):
        open_ &= (np.abs(rest) > goal) & (gamma > EPS * norm)
        if not open_.any():
            break
        gap = np.where(open_, gamma, 1.0)
        v = v / gap
        image = apply(np.where(open_, v, 0.0))
        delta = np.sum(image * v, axis=0)
        v_next = image - delta * v - gamma * v_old
        gamma_next = np.linalg.norm(v_next, axis=0)
        a0 = c * delta - c_old * s * gamma
        a1 = np.hypot(a0, gamma_next)
        open_ &= a1 > 0
        a1 = np.where(a1 > 0, a1, 1.0)
        a2, a3 = s * delta + c_old * c * gamma, s_old * gamma
        w, w_old = (v - a3 * w_old - a2 * w) / a1, w
        c_old, s_old, c, s = c, s, a0 / a1, gamma_next / a1
        x = x + np.where(open_, c * rest, 0.0) * w
        rest = np.where(open_, -s * rest, rest)
        v_old, v, gamma = v, v_next, gamma_next
    return x


@dataclass(frozen=True)
class Eigen:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def jacobi_davidson(product: Product, dims: int, settings: Settings = Settings()) -> Eigen:
    """The largest eigenvalues of a symmetric operator known by its products only, with unit vectors.

    Raises when the rounds don't suffice, rather than give what has not converged.
    """
    wanted = min(settings.components, dims)
    carried = min(dims, wanted + settings.guard)
    most = max(settings.space * wanted, carried + wanted)
    rng = np.random.default_rng(settings.seed)
    used = 0

    def applied(block: np.ndarray) -> np.ndarray:
        nonlocal used
        used += 1
        return product(block)

    locked, values = np.zeros((dims, 0)), np.zeros(0)
    space = np.linalg.qr(rng.standard_normal((dims, carried)))[0]
    image = applied(space)
    refreshed = 0
    for _ in range(settings.rounds):
        inner = space.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = space @ turn, image @ turn
        # Of all values known, the wanted largest; those not locked yet are worked on.
        ranked = sorted([(v, -1) for v in values] + [(v, i) for i, v in enumerate(theta)], reverse=True)
        chosen = [i for _, i in ranked[:wanted] if i >= 0]
        limit = settings.residual_units * math.sqrt(dims) * EPS * max(ranked[0][0], 0.0)
        gaps = _off(locked, ritz_image[:, chosen] - ritz[:, chosen] * theta[chosen])
        done = {i for i, size in zip(chosen, np.linalg.norm(gaps, axis=0), strict=True) if size <= limit}
        locked = np.linalg.qr(np.concatenate([locked, ritz[:, sorted(done)]], axis=1))[0]
        values = np.concatenate([values, theta[sorted(done)]])
        todo = [j for j, i in enumerate(chosen) if i not in done]
        if not todo:
            break
        # Locked vectors leave the subspace; a full one is cut back to its best Ritz vectors.
        kept = [i for i in range(len(theta)) if i not in done]
        if len(kept) + len(todo) <= most:
            space, image = _off(locked, ritz[:, kept]), _off(locked, ritz_image[:, kept])
        else:
            # Images turned over many rounds gather rounding, so they are made anew.
            space = np.linalg.qr(_off(locked, ritz[:, kept[:carried]]))[0]
            image = _off(locked, applied(space))
        targets = [chosen[j] for j in todo]
        fixed = np.linalg.qr(np.concatenate([locked, ritz[:, targets]], axis=1))[0]
        shifts = theta[targets]

        def correction(t: np.ndarray, fixed: np.ndarray = fixed, shifts: np.ndarray = shifts) -> np.ndarray:
            inside = _off(fixed, t)
            return _off(fixed, applied(inside) - inside * shifts)

        held = np.concatenate([locked, space], axis=1)
        if held.shape[1] < dims:
            solved = minres(correction, _off(fixed, -gaps[:, todo]), settings.inner_steps, settings.inner_share)
            more = _extension(held, solved)
            if not more.size:
                more = _extension(held, rng.standard_normal((dims, len(todo))))
            space = np.concatenate([space, more], axis=1)
            image = np.concatenate([image, _off(locked, applied(more))], axis=1)
        else:
            # The subspace is everything: what is left of the residuals is the rounding of old images.
            if refreshed == 3:
                raise RuntimeError(f"residuals stay above {limit:.3g} in the whole space")
            refreshed += 1
            space = np.linalg.qr(space)[0]
            image = _off(locked, applied(space))
    else:
        raise RuntimeError(f"{settings.rounds} rounds left {wanted - len(values)} of {wanted} eigenvectors open")
    return _settled(applied, locked, wanted, lambda: used)


def _settled(applied: Product, locked: np.ndarray, wanted: int, used: Callable[[], int]) -> Eigen:
    """A last Rayleigh-Ritz among the locked vectors, largest first."""
    image = applied(locked)
    inner = locked.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
    vectors, image = locked @ turn, image @ turn
    return Eigen(values, vectors, np.linalg.norm(image - vectors * values, axis=0), used())


# ---- the whole -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What whitens a row: the fit, its leading eigenpairs, and how well the result is whitened."""

    fit: Fit
    eigen: Eigen
    trace: float
    identity_error: float


def fitted(vectors: DataFrame, settings: Settings = Settings()) -> Whitening | None:
    """None without usable rows, or where no direction varies."""
    dims = common_length(vectors)
    if dims is None:
        return None
    fit = fit_list(vectors, dims, settings)
    trace = float(fit.total(lambda c: np.sum(c * c, axis=0), (dims,)).sum()) / fit.n
    if trace <= 0:
        return None
    eigen = jacobi_davidson(fit.product, dims, settings)
    real = eigen.values > dims * 64 * EPS * eigen.values[0]
    eigen = Eigen(eigen.values[real], eigen.vectors[:, real], eigen.residuals[real], eigen.products)
    turn = eigen.vectors / np.sqrt(eigen.values)
    k = turn.shape[1]
    mean = fit.total(lambda c: (c @ turn).sum(axis=0), (k,)) / fit.n

    def spread(c: np.ndarray) -> np.ndarray:
        w = c @ turn - mean
        return w.T @ w

    error = float(np.abs(fit.total(spread, (k, k)) / fit.n - np.eye(k)).max())
    return Whitening(fit, eigen, trace, error)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _deviations(x: np.ndarray, whole: np.ndarray, rest: list[int], n: int) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exactly."""
    off = x - whole
    if x.size and x.shape[1] * (n * (int(np.abs(off).max()) + 1)) ** 2 < 2**63:
        apart = n * off - np.array(rest, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = (sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in off.tolist())
    return [v if v < 2**63 else None for v in exact]


def whitened(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """A row per vector and component, for every row of the common length."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    fit, values = model.fit, model.eigen.values
    centred, dims, n, (whole, rest) = fit.centring(), fit.dims, fit.n, fit.parted()
    turn = model.eigen.vectors / np.sqrt(values)
    explained, error, k = values / model.trace, model.identity_error, len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dims)
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, dtype=np.int64)),
                    pa.array(_deviations(x, whole, rest, n), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array((centred(x) @ turn).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.where(F.size("x") == dims).mapInArrow(run, SCHEMA)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.small_batches(spark, 4096)
    vectors = integer_vectors(base.table(spark, sf_dir, "embeddings"))
    return whitened(vectors, fitted(vectors))
