"""Columnar blocks: many small (value, key) entries in a few shuffled rows.

A task sorts the entries of a batch by bucket and emits one row for each bucket, with the
entries as packed arrays. Spark shuffles the rows by bucket; a task then has all entries of its
buckets as numpy arrays, a share of 1 / partitions of the whole.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.session import materialize

BITMAP_BITS = 24


def settle(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, then let Spark's cleaner remove the shuffle files that led to it: after a
    collection nothing refers to them any more, and a long job holds its current step on disk only."""
    kept = materialize(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return kept


def n_buckets(spark: SparkSession) -> int:
    """Buckets: a few for each shuffle partition, so that more partitions mean smaller tasks."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Rows (bucket, one binary for each column) of entries."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [len(ordered)]]).astype(np.int64)
    arrays = [pa.array(ordered[starts], pa.int32())]
    for column in columns:
        values = column[order]
        arrays.append(pa.array([values[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *names])


def unpacked(batches: Iterator[pa.RecordBatch], dtypes: list[str]) -> list[np.ndarray]:
    """All entries that a task's rows hold, column by column."""
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for batch in batches:
        for part, dtype, column in zip(parts, dtypes, batch.columns[1:], strict=True):
            part += [np.frombuffer(raw.as_py(), dtype) for raw in column]
    return [np.concatenate([*part, np.zeros(0, dtype)]) for part, dtype in zip(parts, dtypes, strict=True)]


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Which residues of a long column occur, as 2**BITMAP_BITS booleans: a filter of fixed size."""
    place = F.col(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1  # Spark's bitmaps count from 1
    rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(1 << BITMAP_BITS, bool)
    for row in rows.collect():  # at most 2**BITMAP_BITS / 32768 rows of 4 KB
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        out[(row["b"] - 1) * 32768 :][: len(bits)] = bits.astype(bool)
    return out
