"""Operator 13: embedding whitening by a pivoted Cholesky factor and one-sided Jacobi.

Vectors are put on an integer grid, x = floor(256 * c), so equal vectors are equal exactly and
sums are exact. The fit list holds each distinct x once.

1. Distinct x: one shuffle, equal vectors merged before it; written once.
2. n and the sums of each dimension, exactly (three 22-bit limbs of each entry).
3. The scatter of x - mean, centred before multiplying: a product a batch, one row for each
   dimension and task, added up by dimension.
4. On the driver, where only dimension x dimension numbers arrive: the scatter is factored
   P'VP = LL' with the largest remaining diagonal as pivot, until that is rounding. The columns
   of L are rotated in disjoint pairs until all are orthogonal: V = (LJ)(LJ)', so their squared
   norms are V's eigenvalues and the normalised columns its eigenvectors.
5. Every row is projected; the covariance of the projected fit list is measured for
   ``identity_error``.

Edge cases: vectors that are null or hold null or non-finite entries are left out; so are empty
vectors and those that haven't the table's most frequent length (of several, the largest).
Rows that repeat count once in the fit and are all returned, null ids too. There are at
most as many components as the scatter has rank, so equal vectors alone (or a single one) and an
empty table give no rows. Entries beyond the range of long are held at its ends. ``deviation`` is
null where it exceeds a long; ``deviation_wide`` has it in up to 38 digits. Only the id and the
vector column are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.session import materialize, ship_package

GRID = 256.0
COMPONENTS = 4
LIMB = 22  # bits; sums of limbs stay exact up to 2**41 rows
SWEEPS = 60  # Jacobi converges quadratically, in some ten sweeps
_LONG_MAX = (1 << 63) - 1


class Whitening(NamedTuple):
    """A fit: size of the list, exact sums, mean, directions over their deviations, eigenvalues, trace, measured error."""

    n: int
    sums: list[int]
    mean: np.ndarray
    directions: np.ndarray  # dimension x components, unit columns
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """Factor with v = factor @ factor.T, dimension x rank; rows in v's own order.

    Each step takes the largest remaining diagonal entry as its pivot and ends where that is no
    more than rounding, which reveals the rank.
    """
    d = len(v)
    left = np.array(np.diag(v), np.float64)
    floor = d * np.finfo(np.float64).eps * max(left.max(initial=0.0), 0.0)
    factor = np.zeros((d, d))
    open_ = np.ones(d, bool)
    for k in range(d):
        pivot = int(np.argmax(np.where(open_, left, -np.inf)))
        if left[pivot] <= floor:
            return factor[:, :k]
        root = np.sqrt(left[pivot])
        open_[pivot] = False
        column = np.where(open_, (v[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / root, 0.0)
        column[pivot] = root
        factor[:, k] = column
        left = np.where(open_, left - column**2, left)
    return factor


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A tournament: every pair of ``n`` columns once, in rounds of disjoint pairs."""
    seats = np.arange(n + n % 2)
    for _ in range(len(seats) - 1):
        p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
        plays = (p < n) & (q < n)  # with an odd number, one column rests
        yield np.minimum(p, q)[plays], np.maximum(p, q)[plays]
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])


def jacobi_columns(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` times a rotation, all orthogonal to working precision."""
    a = np.array(factor, np.float64)
    small = 4 * np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in _rounds(a.shape[1]):
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            slant = np.abs(gamma) / np.sqrt(np.maximum(alpha * beta, np.finfo(np.float64).tiny))
            worst = max(worst, slant.max(initial=0.0))
            turn = slant > small
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst <= small:
            break
    return a


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns, the largest entry positive) of a scatter, up to its rank."""
    a = jacobi_columns(pivoted_cholesky(v))
    values = (a * a).sum(0)
    order = np.argsort(-values, kind="stable")
    values, a = values[order], a[:, order]
    vectors = a / np.sqrt(values)
    if len(values):
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    return values, vectors


def _grid(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    """A list column whose rows all have ``d`` longs, as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _rows(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], names=["row", "part"])


def _total(parts: DataFrame, dtype: str) -> np.ndarray:
    """Sum of the tasks' matrices; each row number is added up in one task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[row] = total.get(row, 0) + np.frombuffer(raw, dtype)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["row", "part"])

    rows = parts.repartition("row").mapInArrow(add, "row int, part binary").collect()  # dimension x dimension numbers at most
    return np.stack([np.frombuffer(r["part"], dtype) for r in sorted(rows, key=lambda r: r["row"])])


def _per_task(fit: DataFrame, d: int, shape: tuple[int, int], dtype: str, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` each batch of the fit list, added up over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            total += of(_grid(batch, 0, d))
        yield _rows(total)

    return _total(fit.select("x").mapInArrow(run, "row int, part binary"), dtype)


def _limbs(x: np.ndarray) -> np.ndarray:
    low = (1 << LIMB) - 1
    return np.stack([(x & low).sum(0), ((x >> LIMB) & low).sum(0), (x >> 2 * LIMB).sum(0), np.full(x.shape[1], len(x), np.int64)])


def on_grid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part, x as longs."""
    entries = vectors[vector_col]
    finite = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)))
    x = F.transform(entries, lambda c: F.floor(F.lit(GRID) * c.cast("double")))
    return vectors.where(entries.isNotNull() & (F.size(entries) > 0) & finite).select(vectors[id_col].alias("vec_id"), x.alias("x"))


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Fit over the distinct ``x`` of ``rows``, all of length ``d``."""
    distinct = materialize(rows.select("x").distinct(), "whitening-fit")
    low, mid, high, counts = _per_task(distinct, d, (4, d), "int64", _limbs).tolist()
    n = counts[0]
    sums = [a + (b << LIMB) + (c << 2 * LIMB) for a, b, c in zip(low, mid, high, strict=True)]
    mean = np.array([s / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    v = _per_task(distinct, d, (d, d), "float64", scatter) / n
    values, vectors = eigen(v)
    values, vectors = values[:components], vectors[:, :components]
    if not len(values):
        return Whitening(n, sums, mean, vectors, values, float(np.trace(v)), 0.0)
    turn = vectors / np.sqrt(values)
    k = len(values)
    centre = _per_task(distinct, d, (1, k), "float64", lambda x: ((x - mean) @ turn).sum(0, keepdims=True))[0] / n

    def measured(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn - centre
        return w.T @ w

    error = np.abs(_per_task(distinct, d, (k, k), "float64", measured) / n - np.eye(k)).max()
    return Whitening(n, sums, mean, vectors, values, float(np.trace(v)), float(error))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n * x - S)**2, exactly, for each row."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if x.shape[1] * most * most <= _LONG_MAX:
        return ((n * x - np.array(sums)) ** 2).sum(1).tolist()
    wide = n * x.astype(object) - np.array(sums, object)
    return (wide**2).sum(1).tolist()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error and deviation_wide of every row that takes part."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = on_grid(vectors, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"
    # One row for each length that occurs; only the most frequent one comes to the driver.
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    d = usual["d"]
    rows = rows.where(F.size("x") == d)
    model = fit(rows, d, components)
    k = len(model.eigenvalues)
    turn = model.directions / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace if k else model.eigenvalues

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _grid(batch, 1, d)
            whitened = (x - model.mean) @ turn
            exact = deviations(x, model.n, model.sums)
            rows_of = pa.array(np.repeat(np.arange(len(x)), k))
            narrow = pa.array([v if v <= _LONG_MAX else None for v in exact], pa.int64())
            wide = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            total = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows_of),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(total, model.n, np.int64)),
                    narrow.take(rows_of),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(total, model.identity_error)),
                    wide.take(rows_of),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"],
            )

    return rows.select("vec_id", "x").mapInArrow(project, schema)
