"""Registered retrieval queries (C1-C6) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.operators import knn, seen
from prefspark.plans.common import LIKED_QUERIES_SQL, liked_queries, rnd
from prefspark.sources import tables as T

K_L2 = 10
K_UNSEEN = 3
K_CANDIDATES = 10
GAMMA_C1 = 0.28
CELLS = 16  # so that the given catalogues, which fit one block, are partitioned too


def q_knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 nearest items (squared L2) to each user's latest liked item."""
    res = knn.block_topk(liked_queries(spark, sf), T.items(spark, sf), K_L2, metric="l2")
    return res.select("user_id", "item_id", "rank", rnd("score").alias("sq_dist"))


def q_knn_l2_cells(spark: SparkSession, sf: str) -> DataFrame:
    """C2 through pivot cells: the same neighbours, with cells that can't hold a nearer item left out."""
    res = knn.block_topk(liked_queries(spark, sf), T.items(spark, sf), K_L2, metric="l2", cells=CELLS)
    return res.select("user_id", "item_id", "rank", rnd("score").alias("sq_dist"))


def q_knn_unseen_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The 3 nearest items each user has never reacted to."""
    res = knn.knn_unseen_exact(liked_queries(spark, sf), T.items(spark, sf), T.seen(spark, sf), K_UNSEEN)
    return res.select("user_id", "item_id", "rank", rnd("score").alias("sq_dist"))


def q_knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Best available item by inner product (> -1), lowest id on ties."""
    res = knn.knn_cosine(liked_queries(spark, sf), T.items(spark, sf), T.seen(spark, sf))
    return res.select("user_id", "item_id", rnd("similarity").alias("similarity"))


def q_knn_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Reference mode: first unseen among min(2k, available) nearest, else lowest available."""
    res = knn.knn_unseen(
        liked_queries(spark, sf), T.items(spark, sf), T.seen(spark, sf), T.n_items(spark, sf), K_CANDIDATES
    )
    return res.select("user_id", "item_id", "fallback")


def q_available_items(spark: SparkSession, sf: str) -> DataFrame:
    """C4: per user, items seen, items still available, lowest available id."""
    return knn.available_items(T.seen(spark, sf), T.n_items(spark, sf)).select(
        "user_id", F.col("n_seen").cast("long").alias("n_seen"),
        F.col("n_available").cast("long").alias("n_available"), "first_available",
    )


def q_available_items_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    """C4 over seen sets that are bitmaps, built from the reactions as they are."""
    sets = seen.seen_bitmaps(T.reactions(spark, sf))
    return seen.available_items(sets, T.n_items(spark, sf)).select(
        "user_id", "n_seen", F.col("n_available").cast("long").alias("n_available"), "first_available",
    )


def q_knn_unseen_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    """C6 over seen sets that are bitmaps: each query row carries its user's."""
    res = knn.knn_unseen_bitmaps(liked_queries(spark, sf), T.items(spark, sf), seen.seen_bitmaps(T.reactions(spark, sf)), K_UNSEEN)
    return res.select("user_id", "item_id", "rank", rnd("score").alias("sq_dist"))


def q_first_similar_slot(spark: SparkSession, sf: str) -> DataFrame:
    """Each reaction against its user's profile: first slot with cosine >= gamma."""
    ev = T.reactions(spark, sf).join(
        T.items(spark, sf).select("item_id", F.col("embedding").alias("vec")), "item_id"
    )
    res = knn.first_similar_slot(ev, T.sql_profile(spark, sf), GAMMA_C1)
    return res.select("event_id", "user_id", "item_id", "matched_slot")


_SQDIST = "(list_inner_product(q.query::DOUBLE[], q.query::DOUBLE[]) + list_inner_product(i.embedding::DOUBLE[], i.embedding::DOUBLE[]) - 2 * list_inner_product(q.query::DOUBLE[], i.embedding::DOUBLE[]))"
_DOT = "list_inner_product(q.query::DOUBLE[], i.embedding::DOUBLE[])"


def sql_knn_unseen_ctes(q_cte: str) -> dict[str, str]:
    """CTEs of the C5 oracle over query CTE ``q_cte`` (user_id, query)."""
    return {
        "qk": f"""SELECT q.*, least({2 * K_CANDIDATES}, (SELECT count(*) FROM items) - coalesce(n.n_seen, 0)) AS k
                  FROM {q_cte} q LEFT JOIN (SELECT user_id, count(*) AS n_seen FROM seen GROUP BY user_id) n USING (user_id)
                  WHERE (SELECT count(*) FROM items) - coalesce(n.n_seen, 0) > 0""",
    }


def sql_knn_unseen(q_cte: str, cols: list[str]) -> str:
    """C5 in SQL: first unseen among the min(2k, available) nearest, else the lowest available id."""
    sel = ", ".join({"user_id": "u.user_id", "item_id": "coalesce(h.item_id, f.first_available) AS item_id",
                     "fallback": "h.item_id IS NULL AS fallback"}.get(c, f"u.{c}") for c in cols)
    return f"""SELECT {sel}
            FROM qk u
            LEFT JOIN (SELECT user_id, arg_min(item_id, rank) AS item_id FROM (
                  SELECT q.user_id, i.item_id,
                         row_number() OVER (PARTITION BY q.user_id ORDER BY {_SQDIST}, i.item_id) AS rank, q.k
                  FROM qk q, items i) c
                WHERE rank <= k AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = c.user_id AND s.item_id = c.item_id)
                GROUP BY user_id) h USING (user_id)
            LEFT JOIN (SELECT u2.user_id, min(i.item_id) AS first_available FROM qk u2, items i
                WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u2.user_id AND s.item_id = i.item_id)
                GROUP BY u2.user_id) f USING (user_id)"""


ORACLES = {
    "knn_l2": T.with_views(
        f"""SELECT user_id, item_id, rank, round(sq_dist, 6) AS sq_dist FROM (
              SELECT q.user_id, i.item_id, {_SQDIST} AS sq_dist,
                     row_number() OVER (PARTITION BY q.user_id ORDER BY {_SQDIST}, i.item_id) AS rank
              FROM lq q, items i) WHERE rank <= {K_L2}""",
        "items", "reactions", extra={"lq": LIKED_QUERIES_SQL},
    ),
    "knn_unseen_exact": T.with_views(
        f"""SELECT user_id, item_id, rank, round(sq_dist, 6) AS sq_dist FROM (
              SELECT q.user_id, i.item_id, {_SQDIST} AS sq_dist,
                     row_number() OVER (PARTITION BY q.user_id ORDER BY {_SQDIST}, i.item_id) AS rank
              FROM lq q, items i
              WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = q.user_id AND s.item_id = i.item_id))
            WHERE rank <= {K_UNSEEN}""",
        "items", "reactions", "seen", extra={"lq": LIKED_QUERIES_SQL},
    ),
    "knn_cosine": T.with_views(
        f"""SELECT user_id, item_id, round(sim, 6) AS similarity FROM (
              SELECT q.user_id, i.item_id, {_DOT} AS sim,
                     row_number() OVER (PARTITION BY q.user_id ORDER BY {_DOT} DESC, i.item_id) AS rn
              FROM lq q, items i
              WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = q.user_id AND s.item_id = i.item_id))
            WHERE rn = 1 AND sim > -1""",
        "items", "reactions", "seen", extra={"lq": LIKED_QUERIES_SQL},
    ),
    "knn_unseen": T.with_views(
        sql_knn_unseen("lq", ["user_id", "item_id", "fallback"]), "items", "reactions", "seen",
        extra={"lq": LIKED_QUERIES_SQL, **sql_knn_unseen_ctes("lq")},
    ),
    "available_items": T.with_views(
        """SELECT s.user_id, CAST(s.n_seen AS BIGINT) AS n_seen,
                  CAST((SELECT count(*) FROM items) - s.n_seen AS BIGINT) AS n_available, f.first_available
           FROM (SELECT user_id, count(*) AS n_seen FROM seen GROUP BY user_id) s
           LEFT JOIN (SELECT u.user_id, min(i.item_id) AS first_available
                      FROM (SELECT DISTINCT user_id FROM seen) u, items i
                      WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.user_id = u.user_id AND x.item_id = i.item_id)
                      GROUP BY u.user_id) f USING (user_id)""",
        "items", "reactions", "seen",
    ),
    "first_similar_slot": T.with_views(
        f"""SELECT r.event_id, r.user_id, r.item_id, coalesce(m.slot, -1) AS matched_slot
            FROM reactions r
            LEFT JOIN (SELECT r2.event_id, min(p.slot) AS slot
                       FROM reactions r2 JOIN items iv ON iv.item_id = r2.item_id
                       JOIN sql_profile p ON p.user_id = r2.user_id
                       WHERE list_cosine_similarity(iv.embedding::DOUBLE[], p.embedding::DOUBLE[]) >= {GAMMA_C1}
                       GROUP BY r2.event_id) m USING (event_id)""",
        "items", "reactions", "sql_profile",
    ),
}

ORACLES["knn_l2_cells"] = ORACLES["knn_l2"]
ORACLES["available_items_bitmaps"] = ORACLES["available_items"]
ORACLES["knn_unseen_bitmaps"] = ORACLES["knn_unseen_exact"]

QUERIES = {
    "knn_l2": q_knn_l2,
    "knn_l2_cells": q_knn_l2_cells,
    "knn_unseen_exact": q_knn_unseen_exact,
    "knn_cosine": q_knn_cosine,
    "knn_unseen": q_knn_unseen,
    "available_items": q_available_items,
    "available_items_bitmaps": q_available_items_bitmaps,
    "knn_unseen_bitmaps": q_knn_unseen_bitmaps,
    "first_similar_slot": q_first_similar_slot,
}
