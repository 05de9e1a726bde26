"""Operator 6: approximate nearest neighbours by learned partitions.

On a bounded sample of distinct vectors (SAMPLE, by hash) a neighbour graph is built and cut
into equal parts by repeated bisection: each half is a half of the order by the graph's second
eigenvector. A small network (one hidden layer) learns the parts of each vector's neighbours.
It then places every distinct vector of the table in its most probable part, and routes each
query to its most probable parts, as many as it takes to reach a total probability that gave a
recall of RECALL on the sample. Parts are searched whole, in blocks, by exact cosine in double
precision: there is no cap on a part.

Equal vectors are one entry with its k + 1 smallest ids, which is all that a list of k + 1
needs; so copies, even a third of the table, cost one entry. Part sizes are counted, and large
parts and large query groups are split in blocks that all meet.

Edge cases: null, zero or non-finite vectors and those with null components take no part, nor
do rows with a null id or a vector whose length isn't the most frequent one (the least of
these). Rows that repeat id and vector are one row; a query's own id is never among its
results. Fewer candidates than k give fewer results, none give none; an empty table gives an
empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.session import materialize

SAMPLE = 4000
GRAPH = 10  # neighbours in the graph
PART_ROWS = 2000  # aimed at
MIN_PARTS = 16  # whenever they get LEAST_ROWS rows each; fewer vectors are one part
LEAST_ROWS = 20
MAX_PARTS = 64
HIDDEN = 128
RECALL = 0.985  # on the sample; the table's own recall is measured in the tests
BLOCK = 4096  # vectors of a part, or queries, in one block


@dataclass
class Router:
    """Network that gives each part's probability; the total probability at which a query stops."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    enough: float = 1.0

    def probabilities(self, unit: np.ndarray) -> np.ndarray:
        z = np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def routes(self, unit: np.ndarray, enough: float | None = None) -> np.ndarray:
        """(rows, parts) booleans: the most probable parts up to the total ``enough``."""
        p = self.probabilities(unit)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, before < (self.enough if enough is None else enough), 1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(unit: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows."""
    out = np.empty((len(unit), k), np.int64)
    for at in range(0, len(unit), 1024):
        s = unit[at : at + 1024] @ unit.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, levels: int) -> np.ndarray:
    """Part of each node: ``2**levels`` parts of equal size (within one) with few edges between them."""
    n = len(near)
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(5)
    for _ in range(levels):
        for p in np.unique(part):
            members = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[members] = np.arange(len(members))
            a = np.repeat(np.arange(len(members)), near.shape[1])
            b = place[near[members].ravel()]
            a, b = a[b >= 0], b[b >= 0]
            ends = np.concatenate([a, b]), np.concatenate([b, a])
            degree = np.bincount(ends[0], minlength=len(members)) + 1e-9
            first = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
            v = rng.standard_normal(len(members))
            for _ in range(60):  # power steps towards the second eigenvector of the normalised graph
                v -= first * (first @ v)
                v = v / (np.linalg.norm(v) + 1e-12)
                v = v + np.bincount(ends[0], (v / np.sqrt(degree))[ends[1]], minlength=len(members)) / np.sqrt(degree)
            order = np.argsort(v / np.sqrt(degree), kind="stable")
            part[members[order[len(members) // 2 :]]] += 1 << 20  # told apart now, numbered below
        part = np.unique(part, return_inverse=True)[1] if len(part) else part
        part = part.astype(np.int64)
        for p in range(part.max() + 1 if len(part) else 0):
            part[part == p] = p
    return part


def fit(sample: np.ndarray, n_parts: int, steps: int = 600) -> Router:
    """Router for the parts of the sample's neighbour graph."""
    unit = _unit(sample)
    n, dim = unit.shape
    rng = np.random.default_rng(11)
    levels = max(0, int(np.log2(max(1, min(n_parts, n // 4)))))
    if not levels:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = neighbours(unit, min(GRAPH, n - 1))
    part = balanced_parts(near, levels)
    parts = part.max() + 1
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1)
    target[np.arange(n), part] += near.shape[1] / 2
    target /= target.sum(axis=1, keepdims=True)
    router = Router(rng.standard_normal((dim, HIDDEN)) * (2 / dim) ** 0.5 * dim**0.5 / 4, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * (1 / HIDDEN) ** 0.5, np.zeros(parts))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (router.w1, router.b1, router.w2, router.b2)]
    for step in range(1, steps + 1):
        at = rng.integers(0, n, 512)
        x = unit[at]
        hidden = np.maximum(x @ router.w1 + router.b1, 0)
        z = hidden @ router.w2 + router.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - target[at]) / len(at)
        back = (d @ router.w2.T) * (hidden > 0)
        for (m, v), weight, grad in zip(state, (router.w1, router.b1, router.w2, router.b2), (x.T @ back, back.sum(0), hidden.T @ d, d.sum(0)), strict=True):
            grad = grad + 1e-5 * weight
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            weight -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    # How far a query must go: the least total probability that finds RECALL of the sample's pairs.
    placed = router.probabilities(unit).argmax(axis=1)
    for enough in (0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 1.1):
        router.enough = enough
        routes = router.routes(unit)
        if routes[np.arange(n)[:, None], placed[near]].mean() >= RECALL:
            break
    return router


def _matrix(column: pa.Array | list) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def _placed(router_of: Callable[[], Router]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the most probable part and the parts to search to rows (vector, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = router_of()
        for batch in batches:
            if not len(batch):
                continue
            unit = _unit(_matrix(batch.column(0).to_pylist()))
            part = router.probabilities(unit).argmax(axis=1)
            routes = [np.flatnonzero(r).astype(np.int32) for r in router.routes(unit)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), pa.array(routes, pa.list_(pa.int32()))], names=[*batch.schema.names, "part", "routes"])

    return run


def _search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Nearest entries of a block of items to each query vector of a block."""

    def run(items: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(items) or not len(asked):
            return pd.DataFrame({"key": [], "vec_id": [], "score": []}).astype({"key": "int64", "vec_id": "int64", "score": "float64"})
        x, q = _matrix(items["x"]), _matrix(asked["q"])
        nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        keys, ids, scores = [], [], []
        for at in range(0, len(q), 256):
            rough = (q[at : at + 256] / nq[at : at + 256, None]) @ (x / nx[:, None]).T
            take = min(len(x), k + 8)
            best = np.argpartition(-rough, take - 1, axis=1)[:, :take]
            edge = np.take_along_axis(rough, best, 1).min(axis=1) if take < len(x) else np.full(len(rough), -np.inf)
            for r in range(len(rough)):
                row = at + r
                chosen = best[r]
                ties = np.flatnonzero(rough[r] >= edge[r] - 1e-12)  # as near as the last one, but for rounding
                if len(ties) > take:
                    chosen = ties
                exact = (x[chosen] * q[row]).sum(axis=1) / (nx[chosen] * nq[row])
                found = sorted((-s, i) for s, c in zip(exact, chosen, strict=True) for i in items["ids"].iloc[c])[:k]
                keys += [asked["key"].iloc[row]] * len(found)
                ids += [i for _, i in found]
                scores += [-s for s, _ in found]
        return pd.DataFrame({"key": np.array(keys, np.int64), "vec_id": np.array(ids, np.int64), "score": np.array(scores, np.float64)})

    return run


def search(vectors: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, part_rows: int = PART_ROWS) -> DataFrame:
    """The k nearest found rows of each row whose id is divisible by ``every``: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    raw = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    raw = raw.where(finite & F.exists("vector", lambda c: c != 0))
    length = raw.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if length is None:
        return empty
    rows = raw.where(F.size("vector") == length["dim"]).select("vec_id", F.transform("vector", lambda c: c + F.lit(0.0)).alias("vector"))
    rows = materialize(rows.withColumn("key", F.xxhash64("vector")).dropDuplicates(["vec_id", "key", "vector"]), "ann-rows")
    # One entry for each distinct vector, with the ids that a list of k + 1 can need.
    first = Window.partitionBy("key", "vector").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    entries = few.groupBy("key", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entries, "ann-entries")
    n = entries.count()
    drawn = entries.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").toPandas()  # ``sample`` vectors at most
    parts = max(1 << max(0, round(np.log2(max(1, n / part_rows)))), MIN_PARTS if n >= MIN_PARTS * LEAST_ROWS else 1)
    held = spark.sparkContext.broadcast(fit(_matrix(drawn["vector"]), min(parts, MAX_PARTS)))
    route = _placed(lambda: held.value)
    placed = materialize(entries.select("vector", "key", "ids").mapInArrow(route, "vector array<double>, key bigint, ids array<bigint>, part int, routes array<int>"), "ann-placed")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "key", "vector")
    sought = asked.select(F.col("key").alias("q_key"), F.col("vector").alias("q_vector")).distinct()
    wanted = placed.join(sought, (F.col("key") == F.col("q_key")) & (F.col("vector") == F.col("q_vector")), "left_semi").select("vector", "key", F.explode("routes").alias("part"))
    # Blocks: every block of a part's entries meets every block of the part's queries.
    blocks = lambda df: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = F.broadcast(blocks(placed).withColumnRenamed("blocks", "item_blocks").join(blocks(wanted).withColumnRenamed("blocks", "query_blocks"), "part"))  # MAX_PARTS rows
    own = lambda of: F.pmod(F.xxhash64("key", F.lit(1)), F.col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    items = placed.join(sizes, "part").select(F.col("part").alias("p"), F.col("vector").alias("x"), "ids", own("item_blocks").alias("i"), all_of("query_blocks").alias("j"))
    questions = wanted.join(sizes, "part").select(F.col("part").alias("q_p"), F.col("vector").alias("q"), F.col("key").alias("key"), own("query_blocks").alias("q_j"), all_of("item_blocks").alias("q_i"))
    found = items.groupBy("p", "i", "j").cogroup(questions.groupBy("q_p", "q_i", "q_j")).applyInPandas(_search(k + 1), "key bigint, vec_id bigint, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")
    # Equal vectors have equal keys; the few keys of several vectors are told apart by their scores' owner.
    pairs = asked.select(F.col("vec_id").alias("query_id"), "key").distinct().join(found, "key").where("query_id != vec_id")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
