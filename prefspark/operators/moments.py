"""Incremental catalogue fit (B2-B6): a mergeable moment state, stored, merged and solved.

The state of a set of vectors is their number, mean and centred scatter matrix. It is an
aggregate: states of disjoint sets merge into the state of their union (pairwise update of mean
and scatter), so a catalogue that grows is fitted again from its stored state and the new items
alone. As a table it has a row for each dimension: ``dim, n, means`` (of all dimensions)
and ``scatter`` (the dimension's row of the matrix); rows of one dimension merge by themselves,
in any order, and a task holds one row of the matrix for each of its dimensions.

Only the solution, dimension x dimension numbers, is made on the driver. One solution serves
every number of components: the first ``k`` columns of the projection are the projection to
``k`` components (``reduced``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions import vectors as V
from prefspark.session import ship_package

STATE = "dim int, n long, means array<double>, scatter array<double>"
_NAMES = ["dim", "n", "means", "scatter"]


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (len(lengths) and (lengths != lengths[0]).any()):
        raise ValueError("vectors differ in dimension")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _rows(dims: list[int], n: list[int], means: list[np.ndarray], scatter: list[np.ndarray]) -> pa.RecordBatch:
    double = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(n, pa.int64()), pa.array(means, double), pa.array(scatter, double)], names=_NAMES)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State of a task's vectors."""
    n, mean, scatter = 0, None, None
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch.column(0))
        here = x.mean(axis=0)
        centred = x - here
        if mean is None:
            n, mean, scatter = len(x), here, centred.T @ centred
            continue
        if len(here) != len(mean):
            raise ValueError("vectors differ in dimension")
        delta = here - mean
        scatter += centred.T @ centred + np.outer(delta, delta) * (n * len(x) / (n + len(x)))
        mean = mean + delta * (len(x) / (n + len(x)))
        n += len(x)
    if n:
        yield _rows(list(range(len(mean))), [n] * len(mean), [mean] * len(mean), list(scatter))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same dimension, merged."""
    held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, n, means, scatter in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            means, scatter = np.array(means), np.array(scatter)
            if dim in held:
                n0, means0, scatter0 = held[dim]
                if len(means0) != len(means):
                    raise ValueError("states differ in dimension")
                delta = means - means0
                scatter = scatter0 + scatter + delta[dim] * delta * (n0 * n / (n0 + n))
                means, n = means0 + delta * (n / (n0 + n)), n0 + n
            held[dim] = (n, means, scatter)
    if held:
        yield _rows(list(held), *(list(c) for c in zip(*held.values(), strict=True)))


def moments(items: DataFrame, col: str = "embedding") -> DataFrame:
    """State of a column of vectors (null vectors are left out); no rows for no vectors."""
    ship_package(items.sparkSession)
    vectors = items.where(F.col(col).isNotNull()).select(F.col(col).cast("array<double>").alias("v"))
    return merge(vectors.mapInArrow(_partial, STATE))


def merge(*states: DataFrame) -> DataFrame:
    """State of the union of disjoint sets."""
    rows = states[0]
    for other in states[1:]:
        rows = rows.unionByName(other)
    return rows.repartition("dim").mapInArrow(_merge, STATE)


class Fit(NamedTuple):
    """A solved state: scaler and principal axes (columns, by falling variance)."""

    n: int
    mean: np.ndarray
    scale: np.ndarray  # population standard deviation; 1 where it is 0
    axes: np.ndarray
    variances: np.ndarray
    correlation: np.ndarray  # what was solved


def solve(state: DataFrame) -> Fit:
    """Scaler and exact principal axes; of each axis the largest loading is positive."""
    rows = sorted(state.collect(), key=lambda r: r["dim"])  # one for each dimension
    if not rows:
        raise ValueError("no vectors to fit")
    n, mean = rows[0]["n"], np.array(rows[0]["means"])
    covariance = np.array([r["scatter"] for r in rows]) / n
    covariance = (covariance + covariance.T) / 2
    std = np.sqrt(np.maximum(np.diag(covariance), 0.0))
    scale = np.where(std == 0, 1.0, std)
    correlation = covariance / np.outer(scale, scale)
    values, axes = np.linalg.eigh(correlation)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    return Fit(n, mean, scale, axes, values, correlation)


def _literals(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def standardise(items: DataFrame, fit: Fit, col: str = "embedding") -> DataFrame:
    """B2: any rows, new ones too, by the fitted mean and scale."""
    centred = F.zip_with(F.col(col), _literals(fit.mean), lambda x, m: x.cast("double") - m)
    return items.withColumn(col, F.zip_with(centred, _literals(fit.scale), lambda x, s: x / s))


def project(items: DataFrame, fit: Fit, k: int | None = None, col: str = "embedding") -> DataFrame:
    """Standardise and turn to the first ``k`` axes (all by default), not normalised."""
    ship_package(items.sparkSession)
    axes = fit.axes[:, : k or len(fit.mean)]
    keep = [c for c in items.columns if c != col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = ((_matrix(batch.column(len(keep))) - fit.mean) / fit.scale) @ axes if len(batch) else np.zeros((0, axes.shape[1]))
            offsets = pa.array(np.arange(len(scores) + 1, dtype=np.int32) * axes.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))], names=[*keep, col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keep).schema.fields)
    rows = items.where(F.col(col).isNotNull()).select(*keep, F.col(col).cast("array<double>").alias(col))
    return rows.mapInArrow(run, f"{kinds}, `{col}` array<double>")


def reduced(projected: DataFrame, k: int, col: str = "embedding") -> DataFrame:
    """The unit-length catalogue of ``k`` components, from a projection to at least as many."""
    return projected.withColumn(col, V.l2_normalise(F.slice(col, 1, k), as_float=False))
