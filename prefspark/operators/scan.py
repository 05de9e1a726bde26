"""Ordered scans within a key that stay parallel when one key is hot.

``Window.partitionBy(key).orderBy(...)`` puts every row of a key in one task; a
user holding a third of all reactions would then be one task.  Here rows are
range-partitioned on ``(key, order...)``, so a hot key spans many partitions.
Each partition computes positions and running sums of its own rows (the rows
arrive sorted), and per-(partition, key) totals give every partition's offset
within the key.  That table has at most partitions + keys rows, and the offset
window over it sees one key's partitions only.  The scanned rows are written to
the shared folder once, so every later branch sees the same partition ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from prefspark.session import materialize, ship_package


def _local_scan(key: str, value: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows of one partition arrive in (key, order) order; counters carry across batches.
        prev_key, carry_n, carry_s = None, 0, 0.0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            keys = pdf[key].to_numpy()
            m = len(keys)
            new = np.empty(m, dtype=bool)
            new[0] = keys[0] != prev_key
            new[1:] = keys[1:] != keys[:-1]
            idx = np.arange(m)
            start = np.maximum.accumulate(np.where(new, idx, 0))
            cont = start == 0 if not new[0] else np.zeros(m, dtype=bool)  # first run continues the last batch
            local = idx - start + np.where(cont, carry_n, 0)
            out = pdf.assign(_local=local.astype(np.int64))
            if value:
                vals = pdf[value].to_numpy(dtype=np.float64)
                cs = np.cumsum(vals)
                base = np.where(start > 0, cs[np.maximum(start - 1, 0)], 0.0)
                before = cs - vals - base + np.where(cont, carry_s, 0.0)
                out = out.assign(_local_sum=before)
                carry_s = before[-1] + vals[-1]
            carry_n = int(local[-1]) + 1
            prev_key = keys[-1]
            yield out

    return run


def ordered_scan(df: DataFrame, key: str, order: list[str], value: str | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Add ``position`` (0-based rank within ``key`` by ``order``, which must be total)
    and, when ``value`` is given, ``sum_before`` (sum of ``value`` over earlier rows)."""
    spark = df.sparkSession
    ship_package(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    with_pid = ranged.withColumn("_pid", F.spark_partition_id())
    fields = list(with_pid.schema.fields) + [Ty.StructField("_local", Ty.LongType())]
    if value:
        fields.append(Ty.StructField("_local_sum", Ty.DoubleType()))
    # Written once to the shared folder: partition ids and local positions are then
    # stored values, so the totals and the join below read the same rows however
    # often Spark re-plans them (a recomputed range exchange may bucket differently).
    scanned = materialize(with_pid.mapInPandas(_local_scan(key, value), Ty.StructType(fields)), "ordered-scan")

    totals = scanned.groupBy("_pid", key).agg(
        F.count(F.lit(1)).alias("_cnt"), *([F.sum(value).alias("_sum")] if value else [])
    )
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", key, F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
        *([F.coalesce(F.sum("_sum").over(w), F.lit(0.0)).alias("_off_sum")] if value else []),
    )
    out = scanned.join(offsets, ["_pid", key])
    cols = [c for c in df.columns] + [(F.col("_off") + F.col("_local")).alias("position")]
    if value:
        cols.append((F.col("_off_sum") + F.col("_local_sum")).alias("sum_before"))
    return out.select(*cols)


def mean_before() -> Column:
    """Over ``ordered_scan`` output: mean of earlier values, 0 for a key's first row."""
    return F.when(F.col("position") > 0, F.col("sum_before") / F.col("position")).otherwise(F.lit(0.0))
