"""Whitening of vectors by Chebyshev-filtered subspace iteration.

The covariance is only ever applied to a few vectors: a pass over the rows multiplies the centred matrix X
of each task with a block Q and adds up X'(XQ). A short Lanczos run bounds the spectrum from below; the
three-term recurrence of the Chebyshev polynomials then takes a pass for each degree and damps the
interval between that bound and the least Ritz value, while what lies above grows like cosh. After each
filter the block is made orthonormal (QR) and rotated to Ritz vectors, until the residuals of the wanted
pairs are certified to be as small as rounding lets them be.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import table
from tallygrid.llm.vectors import matrix, whole_numbers
from tallygrid.session import stored

COMPONENTS, STEPS = 4, 256
GUARD = 20  # further vectors of the block, which widen the gap to the unwanted spectrum
LANCZOS, DEGREE, ROUNDS = 8, 10, 30  # passes of the bound, of a filter at most, and filters at most
CERTIFIED = 1e-13  # residual over the greatest eigenvalue
WEAK = 1e-12  # share of the trace below which a direction has no variance
PIECE = 8192  # rows multiplied at once
GROUP = 64  # matrices added up by a task or the driver


@dataclass
class Passes:
    """Products with the covariance of the rows of ``x``, each one a job whose tasks send a small matrix."""

    x: DataFrame
    dim: int
    n: int
    mean: np.ndarray
    levels: int = 0  # of sums between the tasks and the driver

    def __post_init__(self):
        tasks = self.x.rdd.getNumPartitions()
        self.levels = max(0, math.ceil(math.log(max(tasks, 1), GROUP) - 1e-9) - 1)

    def _sums(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """Sum over the centred rows of what ``part`` makes of a piece of them.

        Matrices are added in the order of the tasks, so that a repeated job rounds alike. The driver adds up
        those of ``GROUP`` tasks at most; of more, each ``GROUP`` are added up by a task of a second stage.
        """
        mean, dim = self.mean, self.dim

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                rows = matrix(batch.column(0), dim)
                for at in range(0, len(rows), PIECE):
                    total += part(rows[at : at + PIECE] - mean)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([total.tobytes()])], ["task", "v"])

        def added(found: pa.Table) -> pa.Table:
            found = found.sort_by("task")
            total = sum((np.frombuffer(v) for v in found["v"].to_pylist()), np.zeros(int(np.prod(shape))))
            return pa.table({"task": found["task"].slice(0, 1), "v": pa.array([total.tobytes()])})

        kinds, sums = "task long, v binary", self.x.select("x").mapInArrow(each, "task long, v binary")
        for _ in range(self.levels):
            sums = sums.groupBy(F.floor(F.col("task") / GROUP)).applyInArrow(added, kinds)
            sums = sums.withColumn("task", F.floor(F.col("task") / GROUP))
        return np.frombuffer(added(sums.toArrow())["v"][0].as_py()).reshape(shape)

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        return self._sums(lambda rows: rows.T @ (rows @ q), q.shape) / self.n

    def variances(self) -> np.ndarray:
        return self._sums(lambda rows: (rows * rows).sum(0)[None], (1, self.dim))[0] / self.n

    def whitened_covariance(self, axes: np.ndarray) -> np.ndarray:
        """Covariance of the rows times ``axes``, from the products themselves."""

        def part(rows: np.ndarray) -> np.ndarray:
            w = rows @ axes
            return np.vstack([w.T @ w, w.sum(0)[None]])

        k = axes.shape[1]
        sums = self._sums(part, (k + 1, k)) / self.n
        return sums[:k] - np.outer(sums[k], sums[k])


def lower_bound(times: Callable[[np.ndarray], np.ndarray], dim: int, steps: int, rng) -> float:
    """A bound below the spectrum from a Lanczos run: the least Ritz value less its residual, 0 at least."""
    v = rng.standard_normal(dim)
    basis, diagonal, off = [v / np.linalg.norm(v)], [], []
    for _ in range(min(steps, dim)):
        w = times(basis[-1][:, None])[:, 0]
        diagonal.append(float(basis[-1] @ w))
        for _ in range(2):
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        off.append(float(np.linalg.norm(w)))
        if off[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
        basis.append(w / off[-1])
    k = len(diagonal)
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off[: k - 1], 1) + np.diag(off[: k - 1], -1))
    return max(0.0, float(values[0] - off[k - 1] * abs(vectors[-1, 0])))


def chebyshev(times, q: np.ndarray, low: float, high: float, above: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the interval from ``low`` to ``high``, scaled to 1 at ``above``, of the
    covariance times ``q``."""
    middle, half = (high + low) / 2, max((high - low) / 2, 1e-9 * above)
    scale = half / (above - middle)
    first, last = scale, q
    now = (times(q) - middle * q) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        now, last = 2 * (following / half) * (times(now) - middle * now) - scale * following * last, now
        scale = following
    return now


@dataclass
class Spectrum:
    """The leading eigenpairs of the covariance, greatest first."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float  # of the worst pair, over the greatest eigenvalue
    passes: int


def leading(passes: Passes, count: int, guard: int = GUARD, seed: int = 1) -> Spectrum:
    """The ``count`` greatest eigenvalues and their unit vectors.

    A round whose filter is done ends the iteration if the residuals are below ``CERTIFIED``, or if they no
    longer fall and rounding alone explains them; without either after ``ROUNDS`` it is an error.
    """
    done = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal done
        done += 1
        return passes.covariance_times(q)

    rng, dim = np.random.default_rng(seed), passes.dim
    count, width = min(count, dim), min(dim, count + guard)
    trace = float(passes.variances().sum())
    if not trace:
        return Spectrum(np.zeros(count), np.eye(dim)[:, :count], 0.0, 0.0, done)
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    low, worst = (lower_bound(times, dim, LANCZOS, rng) if width < dim else 0.0), math.inf
    for _ in range(ROUNDS):
        image = times(q)
        values, rotation = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        values, rotation = values[::-1], rotation[:, ::-1]
        q, image = q @ rotation, image @ rotation
        residual = float(np.linalg.norm(image - q * values, axis=0)[:count].max() / values[0])
        if width == dim or residual < CERTIFIED or (residual < 100 * CERTIFIED and residual > worst / 2):
            return Spectrum(np.maximum(values[:count], 0), q[:, :count], trace, residual, done)
        worst = min(worst, residual)
        high, above = max(values[-1], low), values[0]
        # No more than brings the wanted values to the end, and no growth that hides the weakest of the block.
        at = max((2 * values[count - 1] - high - low) / max(high - low, 1e-9 * above), 1.0)
        growth = math.acosh(at) if at > 1 else 1e-3
        degree = int(np.clip(math.ceil(math.log(residual / CERTIFIED * 2) / growth), 2, DEGREE))
        q = np.linalg.qr(chebyshev(times, q, low, high, above, degree))[0]
    raise ArithmeticError(f"the leading components are not certified: residual {worst:.1e}")


def _totals(x: DataFrame) -> tuple[int, int, list[int]]:
    """Number of rows, length of the longest and exact sum of each dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(0))
            most = float(np.abs(rows).max(initial=0)) * max(len(rows), 1)
            total = rows.sum(0) if most < 2.0**62 else rows.astype(object).sum(0)
            columns = [pa.array([len(rows)], pa.int64()), pa.array([[str(v) for v in total]], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "sums"])

    parts = x.select("x").mapInArrow(each, "n long, sums array<string>")
    n = F.sum(F.when(F.col("at") == 0, F.col("n"))).alias("n")
    split = parts.select("n", F.posexplode(F.concat(F.array(F.lit("0")), "sums")).alias("at", "v"))
    found = split.groupBy("at").agg(n, F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toPandas().sort_values("at")
    if not len(found):
        return 0, 0, []
    return int(found["n"].iloc[0]), len(found) - 1, [int(v) for v in found["v"]][1:]


def _projected(n: int, sums: list[int], axes: np.ndarray):
    """For each batch of rows their deviations (null beyond 64 bits) and projections on ``axes``."""
    dim, mean = len(sums), np.array([s / n for s in sums])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0), matrix(batch.column(1), dim)
            most = n * float(np.abs(x).max(initial=0)) + float(max(map(abs, sums), default=0))
            if dim * most * most < 2.0**62:
                d = n * x - np.array(sums, np.int64)
                deviation = pa.array((d * d).sum(1), pa.int64())
            else:
                whole = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
                deviation = pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())
            w = (x - mean) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * axes.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([ids, deviation, lists], ["vec_id", "deviation", "whitened"])

    return each


def whiten(rows: DataFrame, components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """For every row of ``rows`` (``vec_id``, ``embedding``) and each of the leading ``components``: ``vec_id``,
    ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    The covariance is that of the different vectors floor(``steps`` * c). Rows whose vector is null or holds
    null, non-finite or immense components (``vectors.whole_numbers``) are left out; repeated rows come out
    each, null ids stay null, other columns are not read. Shorter vectors are filled up with zeros.
    Directions without variance (below ``WEAK`` of the trace) are no components, so a single vector, equal
    ones or an empty table give no rows, and vectors of fewer dimensions fewer components. A ``deviation``
    beyond 64 bits is null. Components of equal eigenvalues are any orthonormal choice.
    """
    given = whole_numbers(rows, "embedding", steps)
    least, most = given.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))
        given = given.withColumn("x", F.concat("x", zeros))
    fit = stored(given.select("x").distinct(), "fit")
    n, dim, sums = _totals(fit)
    kinds = "vec_id long, deviation long, whitened array<double>"
    axes, explained, error = np.zeros((dim, 0)), [], 0.0
    if n and dim:
        passes = Passes(fit, dim, n, np.array([s / n for s in sums]))
        found = leading(passes, components)
        some = found.values > WEAK * found.trace
        axes = found.vectors[:, some] / np.sqrt(found.values[some])
        explained = [float(v / found.trace) for v in found.values[some]]
        if some.any():
            error = float(np.abs(passes.whitened_covariance(axes) - np.eye(axes.shape[1])).max())
    ids = given.select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    shown = ids.mapInArrow(_projected(n, sums, axes), kinds) if explained else ids.where("false").select(
        "vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")
    )
    share = F.get(F.array(*[F.lit(v) for v in explained]).cast("array<double>"), F.col("_at"))
    return shown.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
