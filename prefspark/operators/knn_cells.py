"""Pruned exact nearest neighbours: pivot (Voronoi) cells with triangle-inequality bounds.

Items belong to the cell of their nearest pivot; a cell knows how many items it has and how near
and how far they lie from the pivot. A query is first searched in its own cell, which gives the
distance of its ``k``-th nearest item there. It then meets another cell only if that can still
hold an item at that distance or nearer, by three bounds on the distance from the query ``q`` to
any item of a cell with pivot ``p``, nearest item ``lo`` and farthest item ``hi`` from it:

- ``d(q, p) - hi`` and ``lo - d(q, p)`` (triangle inequality),
- ``(d(q, p)^2 - d(q, h)^2) / (2 d(p, h))`` with the query's own pivot ``h``: the items of the
  cell lie on the pivot's side of the bisector.

The rest are never compared, whatever they hold. All bounds give way by a slack far over the
rounding of the distances, so ties at the cut are kept and the result is exact.

Inner products are searched as distances: items get one more coordinate, ``sqrt(M - |x|^2)`` with
the largest ``|x|^2 = M``, which makes them equally long, so nearer means a larger product.

Skew: a cell of more than ``item_block`` items is several blocks (by a hash of the item), and the
queries that meet a cell are split in chunks of about ``query_block``, so a group holds one item
block and one chunk at most. The driver sees the pivots (a bounded sample decides them) and a
few numbers for each cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions import vectors as V
from prefspark.session import materialize

MAX_CELLS = 16_384  # pivots are model-sized; beyond that, cells get more blocks
SAMPLE_PER_CELL = 16  # items that the pivots are fitted on, for each cell
SAMPLE_ROWS = 65_536
ROUNDS = 4  # of moving each pivot to the middle of its sample
SLACK = 1e-7  # of the lengths involved; rounding is below a third of it
_CHUNK = 1024


class Cells(NamedTuple):
    """Pivots and, for each cell, its number of items, bounds on their distance to the pivot, and blocks."""

    pivots: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray
    longest2: float | None  # largest |x|^2 if items are searched by inner product


def _points(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any() or column.null_count:
        raise ValueError("vectors differ in dimension")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def lifted(x: np.ndarray, longest2: float | None, items: bool) -> np.ndarray:
    """Points between which distances are searched: with one more coordinate if products are wanted."""
    if longest2 is None:
        return x
    more = np.sqrt(np.maximum(longest2 - np.einsum("ij,ij->i", x, x), 0.0)) if items else np.zeros(len(x))
    return np.concatenate([x, more[:, None]], axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot."""
    if x.shape[1] != pivots.shape[1]:
        raise ValueError("query and item vectors differ in dimension")
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def fit_pivots(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """``n`` pivots (fewer if the sample has fewer distinct rows): distinct rows, moved to the middle of what is nearest to them."""
    rows = np.unique(sample, axis=0)
    pivots = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)]
    for _ in range(rounds):
        home = np.concatenate([distances(rows[at : at + _CHUNK], pivots).argmin(1) for at in range(0, len(rows), _CHUNK)])
        total = np.zeros_like(pivots)
        np.add.at(total, home, rows)
        count = np.bincount(home, minlength=len(pivots))[:, None]
        pivots = np.where(count > 0, total / np.maximum(count, 1), pivots)
    return np.unique(pivots, axis=0)


def _place(pivots: np.ndarray, longest2: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _CHUNK):
                some = batch.slice(at, _CHUNK)
                d = distances(lifted(_points(some.column(1)), longest2, True), pivots)
                home = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], names=["item_id", "ivec", "cell", "dist"])

    return run


def build(items: DataFrame, n_cells: int, item_block: int, metric: str = "l2", seed: int = 42) -> tuple[Cells, DataFrame]:
    """Cells of ``items`` (item_id, ivec), and the items with their cell and block; the rows with their cells are written once."""
    longest2 = None
    if metric == "dot":
        longest2 = items.agg(F.max(V.dot("ivec", "ivec")).alias("m")).first()["m"] or 0.0
    n_cells = min(n_cells, MAX_CELLS)
    rows = min(SAMPLE_ROWS, SAMPLE_PER_CELL * n_cells)
    sample = items.orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(rows).select("ivec").toArrow()["ivec"].combine_chunks()
    points = _points(sample)
    pivots = fit_pivots(lifted(points, longest2, True), n_cells) if len(points) else np.zeros((1, 1))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select("item_id", "ivec").schema.fields)
    placed = materialize(items.select("item_id", "ivec").mapInArrow(_place(pivots, longest2), f"{kinds}, cell int, dist double"), "knn-cells")
    n, low, high = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect():  # one row a cell
        n[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    blocks = -(-n // item_block)
    spread = placed.join(F.broadcast(_by_cell(items.sparkSession, {"blocks": blocks})), "cell")  # at most MAX_CELLS rows
    block = F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int")
    return Cells(pivots, n, low, high, blocks, longest2), spread.select("item_id", "ivec", "cell", block.alias("block"))


def _by_cell(spark, columns: dict[str, np.ndarray]) -> DataFrame:
    """A row for each cell whose numbers are all above 0."""
    keep = np.all([c > 0 for c in columns.values()], axis=0)
    rows = [(int(i), *(int(c[i]) for c in columns.values())) for i in np.flatnonzero(keep)]
    return spark.createDataFrame(rows, "cell int, " + ", ".join(f"{name} int" for name in columns))


def may_hold(q: np.ndarray, reach: np.ndarray, cells: Cells) -> np.ndarray:
    """(query, cell) booleans: the cell may hold an item at a distance of at most ``reach``; the query's own cell is left out."""
    d = distances(q, cells.pivots)
    lengths = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] + np.sqrt(np.einsum("ij,ij->i", cells.pivots, cells.pivots))[None, :] + cells.high[None, :]
    home = np.where(cells.n > 0, d, np.inf).argmin(1)
    least = np.maximum(d - cells.high[None, :], cells.low[None, :] - d)
    between = distances(cells.pivots[home], cells.pivots)
    at_home = d[np.arange(len(q)), home][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        # Rounding of the squares grows as the pivots near each other.
        bisector = (d**2 - at_home**2 - 1e-12 * lengths**2) / (2 * between)
    least = np.maximum(least, np.where(between > SLACK * lengths, bisector, -np.inf))
    out = (least <= reach[:, None] + SLACK * (1 + lengths)) & (cells.n > 0)[None, :]
    out[np.arange(len(q)), home] = False
    return out


def _meetings(cells: Cells, vec: int, reach: int | None, chunks: np.ndarray | None, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of queries, once for each (cell, block) that they meet: their own cell, or (``reach`` given) the others that may matter.

    Without ``chunks``, one row (cell, n) for each cell and batch; with them, whole rows with cell, block and chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _CHUNK):
                some = batch.slice(at, _CHUNK)
                q = lifted(_points(some.column(vec)), cells.longest2, False)
                if reach is None:
                    row = np.arange(len(q))
                    cell = np.where(cells.n > 0, distances(q, cells.pivots), np.inf).argmin(1)
                else:
                    row, cell = np.nonzero(may_hold(q, some.column(reach).to_numpy(zero_copy_only=False), cells))
                if chunks is None:
                    met = np.bincount(cell, minlength=len(cells.n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(met).astype(np.int32)), pa.array(met[met > 0])], names=["cell", "n"])
                    continue
                chunk = some.column(len(names)).to_numpy()[row] % chunks[cell]
                times = cells.blocks[cell]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(np.repeat(row, times))
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(i).take(take) for i in range(len(names))), *(pa.array(v.astype(np.int32)) for v in (np.repeat(cell, times), block, np.repeat(chunk, times)))],
                    names=[*names, "cell", "block", "chunk"],
                )

    return run


def _searched(queries: DataFrame, cells: Cells, placed: DataFrame, search, qid_cols: list[str], schema: str, excluded: DataFrame | None, query_block: int, reach: bool) -> DataFrame:
    """Candidates of the queries in the cells that they meet."""
    spark = queries.sparkSession
    names = [*qid_cols, "qvec", "k"]
    rows = queries.select(*names, F.pmod(F.xxhash64(*qid_cols), F.lit(1 << 30)).alias("spread"), *(["reach"] if reach else []))
    at = len(names) + 1 if reach else None
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    meet = lambda chunks: _meetings(cells, len(qid_cols), at, chunks, names)
    met = np.zeros(len(cells.n), np.int64)
    for r in rows.mapInArrow(meet(None), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one row a cell
        met[r["cell"]] = r["n"]
    # A hash splits a cell's queries about evenly, so chunks are aimed at half the size that a group may have.
    chunks = -(-2 * met // query_block)
    left = rows.mapInArrow(meet(np.maximum(chunks, 1)), f"{kinds}, cell int, block int, chunk int")
    if excluded is not None:
        left = left.join(excluded, [*qid_cols, "cell", "block"], "left")
    right = placed.join(F.broadcast(_by_cell(spark, {"chunks": chunks})), "cell")  # at most MAX_CELLS rows
    right = right.select("item_id", "ivec", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    keys = ("cell", "block", "chunk")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)


def topk(queries: DataFrame, cells: Cells, placed: DataFrame, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], metric: str, qid_cols: list[str], query_block: int, exclude: DataFrame | None = None) -> DataFrame:
    """``qid_cols + [item_id, score, rank]`` of written queries (``qid_cols``, qvec, k); ``search`` ranks the items of one block."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(*qid_cols).schema.fields] + ["item_id long", "score double"])
    excluded = None
    if exclude is not None:
        where = placed.select("item_id", "cell", "block")
        excluded = exclude.select(*qid_cols, "item_id").join(where, "item_id").groupBy(*qid_cols, "cell", "block").agg(F.collect_list("item_id").alias("ex_ids"))
        excluded = materialize(excluded, "knn-excluded")  # read by both searches
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    window = Window.partitionBy(*qid_cols).orderBy(order, F.col("item_id").asc())

    def best(candidates: DataFrame) -> DataFrame:
        ranked = candidates.withColumn("rank", F.row_number().over(window).cast("long"))
        return ranked.join(queries.select(*qid_cols, "k"), qid_cols).where(F.col("rank") <= F.col("k"))

    own = materialize(best(_searched(queries, cells, placed, search, qid_cols, schema, excluded, query_block, False)), "knn-own")
    last = own.where(F.col("rank") == F.col("k")).select(*qid_cols, "score")
    reach = F.sqrt("score") if metric == "l2" else F.sqrt(F.greatest(V.dot("qvec", "qvec") + F.lit(cells.longest2 or 0.0) - 2 * F.col("score"), F.lit(0.0)))
    # A query that found fewer than k in its own cell meets every cell.
    reaching = materialize(queries.join(last, qid_cols, "left").withColumn("reach", F.coalesce(reach, F.lit(float("inf")))).drop("score"), "knn-reach")
    others = _searched(reaching, cells, placed, search, qid_cols, schema, excluded, query_block, True)
    return best(own.drop("rank", "k").unionByName(others)).drop("k")


def n_met(queries: DataFrame, cells: Cells) -> tuple[int, int]:
    """(pairs of a query and another cell that must be compared, all such pairs) for queries with qvec and reach."""
    run = _meetings(cells, 0, 1, None, ["qvec"])
    met = queries.select("qvec", "reach").mapInArrow(run, "cell int, n bigint").agg(F.sum("n").alias("n")).first()["n"] or 0
    return int(met), queries.count() * (int((cells.n > 0).sum()) - 1)


def cells_for(n_items: int, item_block: int) -> int:
    """Cells for so many items: about one for each block, more while cells are smaller than sqrt(n) blocks would need."""
    return max(1, min(MAX_CELLS, max(math.ceil(n_items / item_block), math.isqrt(n_items) // 8)))
