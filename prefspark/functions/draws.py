"""Keyed pseudo-random draws.

Every random choice in the library is a pure function of ``(seed, key)``:
``u = first 52 bits of md5(seed ':' key) / 2**52``.  The same expression runs in
Spark and in DuckDB, so draws are identical across engines, partitionings and
task retries (``rand(seed)`` depends on partition layout and is never used).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _as_str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    return F.lit(str(c))


def uniform(seed, *parts) -> Column:
    """Uniform [0, 1) from md5 of ``seed:part1:part2...``."""
    h = F.md5(F.concat_ws(":", _as_str(seed), *[_as_str(p) for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO_POW_52)


def normal(seed, *parts) -> Column:
    """Standard normal by Box-Muller over two keyed uniforms; ``1 - u`` keeps ln away from 0."""
    u1 = F.lit(1.0) - uniform(seed, *parts, "n1")
    u2 = uniform(seed, *parts, "n2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def random_normals(seed, dim, *parts) -> Column:
    """``dim`` keyed standard normals (component i keyed by ``parts + (i,)``)."""
    dim_col = dim if isinstance(dim, Column) else F.lit(int(dim))
    return F.transform(F.sequence(F.lit(0), dim_col - 1), lambda i: normal(seed, *parts, i))


def with_random_unit_vector(df, out: str, seed, dim, *parts):
    """Add ``out``: keyed normals divided by their norm (a zero norm divides by 1).

    Draws, norm and division are separate projections, so each normal is drawn
    once per component rather than once per component per component.
    """
    raw = df.withColumn("_rv_raw", random_normals(seed, dim, *parts))
    normed = raw.withColumn("_rv_norm", F.sqrt(F.aggregate("_rv_raw", F.lit(0.0), lambda acc, x: acc + x * x)))
    guard = F.when(F.col("_rv_norm") == 0, F.lit(1.0)).otherwise(F.col("_rv_norm"))
    return normed.withColumn(out, F.transform("_rv_raw", lambda x: x / guard)).drop("_rv_raw", "_rv_norm")


# ---- the same draws in plain Python (for per-group pandas code and tests) ----

def py_uniform(seed, *parts) -> float:
    text = ":".join(str(p) for p in (seed, *parts))
    return py_uniform_text(text)


def py_uniform_text(text: str) -> float:
    """``u`` of an already joined key (first 52 bits of the md5 digest)."""
    return (int.from_bytes(hashlib.md5(text.encode("utf-8")).digest()[:7], "big") >> 4) / TWO_POW_52


def py_uniforms(texts: list[str]) -> np.ndarray:
    """``py_uniform_text`` of many keys."""
    if not texts:
        return np.zeros(0)
    digests = b"".join([hashlib.md5(t.encode("utf-8")).digest() for t in texts])
    return (np.frombuffer(digests, ">u8")[::2].astype(np.uint64) >> np.uint64(12)).astype(np.float64) / TWO_POW_52


def py_normal(seed, *parts) -> float:
    u1 = 1.0 - py_uniform(seed, *parts, "n1")
    u2 = py_uniform(seed, *parts, "n2")
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)


# ---- DuckDB text of the same expressions (oracle SQL) ----

def sql_uniform(seed_sql: str, *parts_sql: str) -> str:
    body = " || ':' || ".join([f"CAST({seed_sql} AS VARCHAR)"] + [f"CAST({p} AS VARCHAR)" for p in parts_sql])
    return f"(CAST(('0x' || substr(md5({body}), 1, 13)) AS BIGINT)::DOUBLE / {TWO_POW_52})"


def sql_normal(seed_sql: str, *parts_sql: str) -> str:
    u1 = f"(1.0 - {sql_uniform(seed_sql, *parts_sql, repr('n1'))})"
    u2 = sql_uniform(seed_sql, *parts_sql, repr("n2"))
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"
