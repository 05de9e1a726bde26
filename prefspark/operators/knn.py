"""Exact nearest-neighbour search and the reference's retrieval operators.

Core: ``block_topk``.  Query vectors are written once and counted there.  While all
items fit one block (by a memory budget and the vector width), each query block meets
that block in a cogroup: one dense matrix product with a local tie-aware top-k.
Larger catalogues go through pivot cells (``knn_cells``), where a query only meets the
cells that can still hold a nearer item.  Groups hold at most one query block and one
item block, whatever the data size.  Nothing passes through the driver except row
counts, the width and the pivots, and no row pairs are materialised.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.operators import knn_cells
from prefspark.operators import seen as seen_sets
from prefspark.session import materialize, ship_package

BLOCK_BYTES = 64 << 20  # memory budget of one item block (float64 matrix); query blocks get a quarter
TILE = 16384  # items of a block that are compared at a time
SCORE_BYTES = 16 << 20  # of the scores that are held at once: some query rows against a tile
QUERY_ROWS = 4096  # of a group while the whole catalogue is one block, so that many tasks share the queries
TIE = 1e-9  # of the lengths involved: items this near to the cut are ranked by their exact scores


def _excluded(qpdf: pd.DataFrame, ids: np.ndarray):
    """Query row -> places of the items that it must not get, or None."""
    if "ex_ids" in qpdf.columns:
        lists = qpdf["ex_ids"].to_numpy()
        seen = lambda row: lists[row]
    elif "ex_bits" in qpdf.columns:
        bits = qpdf["ex_bits"].to_numpy()
        seen = lambda row: None if bits[row] is None else seen_sets.items_of([b["block"] for b in bits[row]], [bytes(b["bitmap"]) for b in bits[row]])[1]
    else:
        return lambda row: None
    by_id = np.argsort(ids, kind="stable")
    ordered = ids[by_id]

    def places(row: int) -> np.ndarray | None:
        gone = seen(row)
        if gone is None or not len(gone):
            return None
        gone = np.asarray(gone, dtype=np.int64)
        first, last = np.searchsorted(ordered, gone, "left"), np.searchsorted(ordered, gone, "right")
        while (last > first + 1).any():  # an id that several items have
            more = np.flatnonzero(last > first + 1)
            first, last = np.concatenate([first, first[more] + 1]), np.concatenate([np.where(last > first + 1, first + 1, last), last[more]])
        return by_id[first[last > first]]

    return places


def _nearest(key: np.ndarray, k: np.ndarray, cut: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the entries that can be among a row's ``k`` smallest; ``cut``, up to which they can, falls in place."""
    near = key <= (cut + slack)[:, None]
    many = near.sum(axis=1) > 4 * k + 16
    for some in np.unique(k[many]):
        rows = np.flatnonzero(many & (k == some))
        if some < key.shape[1]:
            part = key if len(rows) == len(key) else key[rows]
            cut[rows] = np.fmin(cut[rows], np.partition(part, some - 1, axis=1)[:, some - 1])
            near[rows] = part <= (cut[rows] + slack[rows])[:, None]
    row, place = np.nonzero(near)
    kept = ~np.isposinf(key[row, place])
    return row[kept], place[kept]


def _block_fn(metric: str, qid_cols: list[str]):
    def run(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        cols = qid_cols + ["item_id", "score"]
        if len(qpdf) == 0 or len(ipdf) == 0:
            return pd.DataFrame({c: [] for c in cols})
        ivec, qvec = ipdf["ivec"].to_numpy(), qpdf["qvec"].to_numpy()
        if {len(v) for v in qvec} != {len(v) for v in ivec}:
            raise ValueError("query and item vectors differ in dimension")
        k = qpdf["k"].to_numpy(dtype=np.int64)
        asked = np.flatnonzero(k > 0)
        cut = np.full(len(k), np.inf)  # of each query: no item beyond is among its nearest
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]  # row, item, score
        for at in range(0, len(ivec), TILE):
            X = np.stack(ivec[at : at + TILE]).astype(np.float64)
            ids = ipdf["item_id"].to_numpy(dtype=np.int64)[at : at + TILE]
            excluded = _excluded(qpdf, ids)
            xx = np.einsum("ij,ij->i", X, X)
            longest = np.sqrt(np.nanmax(xx))
            step = max(1, SCORE_BYTES // (8 * len(ids)))
            for start in range(0, len(asked), step):
                rows = asked[start : start + step]
                q = np.stack(qvec[rows]).astype(np.float64)
                key = q @ X.T
                key *= -2.0 if metric == "l2" else -1.0
                if metric == "l2":
                    key += xx[None, :]  # + |q|^2, constant per row
                for r, whole in enumerate(rows.tolist()):
                    gone = excluded(whole)
                    if gone is not None:
                        key[r, gone] = np.inf  # seen: never chosen
                slack = TIE * (np.sqrt(np.einsum("ij,ij->i", q, q)) + longest) ** 2
                limit = cut[rows]
                row, sel = _nearest(key, k[rows], limit, np.where(np.isfinite(slack), slack, 0.0))
                cut[rows] = limit
                if metric == "l2":
                    diff = X[sel] - q[row]
                    score = np.einsum("ij,ij->i", diff, diff)
                else:
                    score = np.einsum("ij,ij->i", X[sel], q[row])
                found.append((rows[row], ids[sel], score))
        row, item, score = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.lexsort((item, score if metric == "l2" else -score, row))
        row = row[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k[row]  # rows are in order: places from where each begins
        res = qpdf[qid_cols].iloc[row[best]].reset_index(drop=True)
        res["item_id"] = item[order[best]]
        res["score"] = score[order[best]]
        return res

    return run


def block_topk(
    queries: DataFrame,
    items: DataFrame,
    k,
    metric: str = "l2",
    qid_cols: list[str] | None = None,
    query_col: str = "query",
    item_vec_col: str = "embedding",
    query_block: int | None = None,
    item_block: int | None = None,
    exclude: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
    cells: int | None = None,
    written: bool = False,
    exclude_bitmaps: DataFrame | None = None,
) -> DataFrame:
    """Exact top-``k`` items per query row.

    ``metric='l2'``: squared Euclidean distance ascending; ``'dot'``: inner product
    descending; ties broken by ``item_id``.  ``k`` is an int or a column name of
    ``queries`` (per-query k).  ``exclude`` (``qid_cols + [item_id]``) removes pairs
    before ranking: each query row carries its excluded ids *of the item block that it
    meets* (at most the block size), so exclusion is exact and bounded even for a
    query that excludes most of the catalogue.  ``exclude_bitmaps`` is the same as bitmaps
    (``user_id, block, bitmap`` of ``operators.seen``): a query row carries its user's
    bitmaps, and query blocks shrink by their size; pivot cells, whose ids are spread, get
    ids in their place.  ``cells`` asks for so many pivot cells
    whatever the number of items; ``written`` says that ``queries`` is already a stored
    table.  Returns ``qid_cols + [item_id, score, rank]``.
    """
    if metric not in ("l2", "dot"):
        raise ValueError(f"unknown metric {metric}")
    qid_cols = qid_cols or ["user_id"]
    ship_package(queries.sparkSession)
    k_col = F.col(k) if isinstance(k, str) else F.lit(int(k))
    q = queries.select(*qid_cols, F.col(query_col).alias("qvec"), k_col.cast("long").alias("k"))
    q = q if written else materialize(q, "knn-queries")
    it = items.select("item_id", F.col(item_vec_col).alias("ivec"))
    nq = q.count()
    stats = it.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("ivec")).alias("d")).first()
    ni, dim = int(stats["n"] or 0), max(int(stats["d"] or 1), 1)
    item_block = item_block or max(1024, block_bytes // (dim * 8))
    asked, query_block = query_block, query_block or max(256, block_bytes // 4 // (dim * 8))
    if cells is None and ni > item_block:
        cells = knn_cells.cells_for(ni, item_block)
    if exclude_bitmaps is not None and cells and ni:
        exclude, exclude_bitmaps = seen_sets.seen_pairs(exclude_bitmaps), None
    if cells and ni:
        built, placed = knn_cells.build(it, cells, item_block, metric)
        return knn_cells.topk(q, built, placed, _block_fn(metric, qid_cols), metric, qid_cols, query_block, exclude)
    # One item block: it is copied to each query block, and a query's candidates are its answer.
    query_block = asked or min(query_block, QUERY_ROWS)
    if exclude_bitmaps is not None:
        exclude_bitmaps = materialize(exclude_bitmaps.select("user_id", "block", "bitmap"), "knn-bitmaps")
        carried = (exclude_bitmaps.agg(F.sum(F.length("bitmap")).alias("n")).first()["n"] or 0) // max(nq, 1)
        query_block = max(256, query_block * dim * 8 // (dim * 8 + carried))
    bq = max(1, math.ceil(nq / query_block))
    q_rep = q.select("*", F.pmod(F.xxhash64(*qid_cols), F.lit(bq)).alias("qb"))
    i_rep = it.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bq - 1).cast("long"))).alias("qb"))
    if exclude is not None:
        ex = exclude.select(*qid_cols, "item_id").groupBy(*qid_cols).agg(F.collect_list("item_id").alias("ex_ids"))
        q_rep = q_rep.join(ex, qid_cols, "left")
    if exclude_bitmaps is not None:
        ex = exclude_bitmaps.groupBy("user_id").agg(F.collect_list(F.struct("block", "bitmap")).alias("ex_bits"))  # a row for each 32,768 items
        q_rep = q_rep.join(ex, "user_id", "left")
    schema_fields = [f"{f.name} {f.dataType.simpleString()}" for f in queries.select(*qid_cols).schema.fields]
    schema = ", ".join(schema_fields + ["item_id long", "score double"])
    cand = q_rep.groupBy("qb").cogroup(i_rep.groupBy("qb")).applyInPandas(_block_fn(metric, qid_cols), schema)
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    w = Window.partitionBy(*qid_cols).orderBy(order, F.col("item_id").asc())
    return cand.withColumn("rank", F.row_number().over(w).cast("long"))


# ---------------------------------------------------------------------------
# Reference operators built on block_topk
# ---------------------------------------------------------------------------

def seen_counts(seen: DataFrame) -> DataFrame:
    return seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_seen"))


def available_items(seen: DataFrame, n_items_col) -> DataFrame:
    """C4 summary per user: seen, available, lowest available item (dense ids)."""
    first = first_available(seen, n_items_col)
    return (
        seen_counts(seen)
        .select("user_id", "n_seen", (n_items_col - F.col("n_seen")).alias("n_available"))
        .join(first, "user_id", "left")
    )


def first_available(seen: DataFrame, n_items_col) -> DataFrame:
    """Lowest item id a user has not seen, for dense ids 0..n-1.

    Among ids 0..n_seen at least one is unseen, so only ``n_seen + 1`` candidates per
    user are generated (the size of the user's own seen set), never users x items.
    """
    cnt = seen_counts(seen)
    cands = cnt.select(
        "user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_seen").cast("long"))).alias("item_id")
    ).where(F.col("item_id") < n_items_col)
    return (
        cands.join(seen, ["user_id", "item_id"], "left_anti")
        .groupBy("user_id")
        .agg(F.min("item_id").alias("first_available"))
    )


def knn_unseen_exact(queries: DataFrame, items: DataFrame, seen: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest items a user has not seen.

    Seen pairs are removed inside each block before the local top-k (see
    ``block_topk(exclude=...)``), so every block emits at most k candidates per
    user, however much of the catalogue the user has already seen.
    """
    return block_topk(queries, items, k, metric=metric, exclude=seen)


def knn_unseen_bitmaps(queries: DataFrame, items: DataFrame, bitmaps: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """C6 over seen sets that are bitmaps."""
    return block_topk(queries, items, k, metric=metric, exclude_bitmaps=bitmaps)


def knn_cosine(queries: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """Best available item by inner product; strict ``> -1``, lowest id wins ties."""
    best = knn_unseen_exact(queries, items, seen, 1, metric="dot")
    return best.where(F.col("score") > -1.0).select("user_id", "item_id", F.col("score").alias("similarity"))


def knn_unseen(queries: DataFrame, items: DataFrame, seen: DataFrame, n_items_col, k_candidates: int = 10) -> DataFrame:
    """C5, the reference's mode: fetch ``min(2k, available)`` nearest from the whole
    catalogue, keep the first unseen; else fall back to the lowest available id.

    Users with nothing available get no row.
    """
    cnt = seen_counts(seen)
    q = (
        queries.join(cnt, "user_id", "left")
        .select("*", (n_items_col - F.coalesce(F.col("n_seen"), F.lit(0))).alias("_avail"))
        .where(F.col("_avail") > 0)
        .select("user_id", "query", F.least(F.lit(2 * k_candidates), F.col("_avail")).alias("_k"))
    )
    q = materialize(q, "unseen-queries")  # read by the search and by the fallback
    cand = block_topk(q, items, "_k", metric="l2", written=True)
    hit = (
        cand.join(seen, ["user_id", "item_id"], "left_anti")
        .groupBy("user_id")
        .agg(F.min_by(F.struct("item_id", "score"), F.col("rank")).alias("hit"))
    )
    fb = first_available(seen, n_items_col)
    users = q.select("user_id")
    return (
        users.join(hit, "user_id", "left")
        .join(fb, "user_id", "left")
        .select(
            "user_id",
            F.coalesce(F.col("hit.item_id"), F.col("first_available")).alias("item_id"),
            F.col("hit").isNull().alias("fallback"),
        )
        .where(F.col("item_id").isNotNull())
    )


def _first_match_fn(gamma: float, keep: list[str]):
    def run(epdf: pd.DataFrame, ppdf: pd.DataFrame) -> pd.DataFrame:
        out = epdf[keep].copy()
        if len(epdf) == 0:
            out["matched_slot"] = np.zeros(0, dtype=np.int64)
            return out
        if len(ppdf) == 0:
            out["matched_slot"] = -1
            return out
        ppdf = ppdf.sort_values("slot")
        E = np.stack(epdf["vec"].to_numpy()).astype(np.float64)
        S = np.stack(ppdf["embedding"].to_numpy()).astype(np.float64)
        if E.shape[1] != S.shape[1]:
            raise ValueError("Embeddings must have the same dimension")
        en = np.linalg.norm(E, axis=1)
        sn = np.linalg.norm(S, axis=1)
        denom = np.outer(en, sn)
        cos = np.divide(E @ S.T, denom, out=np.zeros((len(E), len(S))), where=denom != 0)
        hit = cos >= gamma
        first = np.argmax(hit, axis=1)
        slots = ppdf["slot"].to_numpy(dtype=np.int64)
        out["matched_slot"] = np.where(hit.any(axis=1), slots[first], -1)
        return out

    return run


def split_hot_keys(df: DataFrame, key: str, chunk: int) -> DataFrame:
    """Per-key bucket count ``ceil(rows / chunk)``: hot keys get many buckets."""
    return df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_nb"))


def first_similar_slot(events: DataFrame, profile: DataFrame, gamma: float, chunk: int = 4096) -> DataFrame:
    """For each event, the first profile slot (insertion order) with cosine >= gamma.

    Events are cogrouped with their user's profile by ``(user_id, bucket)``.  A user
    with many events is split into ``ceil(n / chunk)`` buckets and the profile
    (bounded by the profile capacity in normal use) is copied to each, so a hot user
    is spread over many tasks and no group holds more than ~``chunk`` events.
    Each group is one matrix product; ``-1`` when nothing matches.
    """
    keep = [c for c in events.columns if c != "vec"]
    ship_package(events.sparkSession)
    nb = split_hot_keys(events.select("user_id"), "user_id", chunk)
    ev = events.join(nb, "user_id").withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.col("_nb")).cast("int")).drop("_nb")
    prof = profile.select("user_id", "slot", "embedding").join(nb, "user_id").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("bucket")
    ).drop("_nb")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in events.select(*keep).schema.fields]
    return (
        ev.groupBy("user_id", "bucket")
        .cogroup(prof.groupBy("user_id", "bucket"))
        .applyInPandas(_first_match_fn(gamma, keep), ", ".join(fields + ["matched_slot long"]))
    )
