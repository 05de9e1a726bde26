"""Registered recommendation queries (E1-E6) and their DuckDB oracles.

Profiles come from ``sql_profile`` so the oracle can rebuild them; the flagship
(``recommend_from_fold``) runs the same plan over the real fold snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.draws import sql_normal, sql_uniform
from prefspark.operators import recommend as R
from prefspark.operators import seen as SB
from prefspark.plans.common import rnd
from prefspark.plans.retrieval import K_CANDIDATES, sql_knn_unseen, sql_knn_unseen_ctes
from prefspark.session import materialize, scratch_path
from prefspark.sources import tables as T
from prefspark.sources.store import StateStore

SEED = 42
STEP = 0
EXP_RATE = 0.3
BETA = 2.0
TEMPERATURE = 1.0


def users(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "events").select("user_id").distinct()


def catalogue_dim(spark: SparkSession, sf: str):
    return T.items(spark, sf).select(F.max(F.size("embedding"))).scalar()


def q_slot_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """UCB softmax per user."""
    p = R.slot_probabilities(T.sql_profile(spark, sf), BETA, TEMPERATURE)
    return p.select("user_id", "slot", rnd("ucb").alias("ucb"), rnd("probability").alias("probability"))


def q_sample_slot(spark: SparkSession, sf: str) -> DataFrame:
    """The slot each user's draw selects."""
    return R.sample_slot(R.slot_probabilities(T.sql_profile(spark, sf), BETA, TEMPERATURE), SEED, STEP)


def q_explore_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which users explore at this step."""
    return R.explore_gate(users(spark, sf), SEED, STEP, EXP_RATE)


def q_random_unit_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's exploration vector, one row per component."""
    v = R.random_unit_vectors(users(spark, sf), catalogue_dim(spark, sf), SEED, STEP)
    return v.select("user_id", F.posexplode_outer("query").alias("dim_index", "value")).select(
        "user_id", F.col("dim_index").cast("long").alias("dim_index"), rnd("value").alias("value")
    )


def recommend_sql_profile(spark: SparkSession, sf: str) -> DataFrame:
    return R.recommend_batch(
        users(spark, sf), T.sql_profile(spark, sf), T.items(spark, sf), T.seen(spark, sf), T.n_items(spark, sf),
        catalogue_dim(spark, sf), BETA, EXP_RATE, SEED, STEP, K_CANDIDATES, TEMPERATURE,
    )


def q_recommend_batch(spark: SparkSession, sf: str) -> DataFrame:
    """E5: one recommendation per user."""
    return recommend_sql_profile(spark, sf).select("user_id", "mode", "slot", "item_id", "fallback")


def q_mark_consumed(spark: SparkSession, sf: str) -> DataFrame:
    """Seen-set sizes after consuming this step's recommendations."""
    after = R.mark_consumed(T.seen(spark, sf), recommend_sql_profile(spark, sf))
    return after.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_seen"))


def q_mark_consumed_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    """E6 over stored bitmaps: the step's recommendations are applied twice, as after a retry, and count once."""
    store = StateStore(spark, scratch_path(spark, "seen-store"))
    store.update(SB.seen_bitmaps(T.reactions(spark, sf)))
    answers = materialize(recommend_sql_profile(spark, sf), "answers")
    for _ in range(2):
        store.update(materialize(SB.mark_consumed(store.read_keys(answers), answers), "seen-increment"))
    return SB.sizes(store.read())


# ---------------------------------------------------------------------------

_U_SLOT = sql_uniform(str(SEED), "user_id", str(STEP), "'slot'")
_U_GATE = sql_uniform(str(SEED), "user_id", str(STEP), "'gate'")
_NORMAL = sql_normal(str(SEED), "user_id", str(STEP), "'explore'", "i")

_CTES = {
    "users": "SELECT DISTINCT user_id FROM events",
    "probs": f"""SELECT user_id, slot, ucb, z / sum(z) OVER (PARTITION BY user_id) AS probability FROM (
            SELECT user_id, slot, ucb, exp((ucb - max(ucb) OVER (PARTITION BY user_id)) / {TEMPERATURE}) AS z FROM (
              SELECT user_id, slot, {BETA} * ln(total_rewards) / rewards_received + preference AS ucb FROM sql_profile))""",
    "chosen": f"""SELECT user_id, coalesce(min(CASE WHEN cum > u THEN slot END), max(slot)) AS slot FROM (
            SELECT user_id, slot, {_U_SLOT} AS u,
                   sum(probability) OVER (PARTITION BY user_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
            FROM probs) GROUP BY user_id""",
    "gate": f"""SELECT u.user_id, ({_U_GATE} < {EXP_RATE}) OR d.dim IS NULL AS explore,
                   coalesce(d.dim, (SELECT max(len(embedding)) FROM items)) AS dim
            FROM users u LEFT JOIN (SELECT user_id, max(len(embedding)) AS dim FROM sql_profile GROUP BY user_id) d USING (user_id)""",
    "raw": f"""SELECT user_id, i, {_NORMAL} AS x FROM (SELECT user_id, unnest(range(dim)) AS i FROM gate)""",
    "rv": """SELECT user_id, i, x / CASE WHEN nrm = 0 THEN 1.0 ELSE nrm END AS x FROM (
            SELECT user_id, i, x, sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS nrm FROM raw)""",
    "qv": """SELECT g.user_id, CASE WHEN g.explore THEN 'explore' ELSE 'exploit' END AS mode,
                   CAST(CASE WHEN g.explore THEN -1 ELSE c.slot END AS BIGINT) AS slot,
                   CASE WHEN g.explore THEN v.vec ELSE p.embedding::DOUBLE[] END AS query
            FROM gate g LEFT JOIN chosen c USING (user_id)
            LEFT JOIN sql_profile p ON p.user_id = g.user_id AND p.slot = c.slot
            LEFT JOIN (SELECT user_id, list(x ORDER BY i) AS vec FROM rv GROUP BY user_id) v ON v.user_id = g.user_id""",
}


def _with(body: str, *ctes: str, more: dict | None = None) -> str:
    extra = {k: _CTES[k] for k in ctes}
    extra.update(more or {})
    return T.with_views(body, "items", "reactions", "seen", "sql_profile", extra=extra)


_REC_BODY = sql_knn_unseen("qv", ["user_id", "mode", "slot", "item_id", "fallback"])
_REC_CTES = ("users", "probs", "chosen", "gate", "raw", "rv", "qv")

ORACLES = {
    "slot_probabilities": _with("SELECT user_id, slot, round(ucb, 6) AS ucb, round(probability, 6) AS probability FROM probs", "probs"),
    "sample_slot": _with("SELECT user_id, slot FROM chosen", "probs", "chosen"),
    "explore_gate": _with(f"SELECT user_id, {_U_GATE} < {EXP_RATE} AS explore FROM users", "users"),
    "random_unit_vector": _with(
        "SELECT user_id, CAST(i AS BIGINT) AS dim_index, round(x, 6) AS value FROM rv",
        "users", "gate", "raw", "rv",
        more={},
    ),
    "recommend_batch": _with(_REC_BODY, *_REC_CTES, more=sql_knn_unseen_ctes("qv")),
    "mark_consumed": _with(
        """SELECT user_id, count(*) AS n_seen FROM (
              SELECT user_id, item_id FROM seen UNION SELECT user_id, item_id FROM rec) GROUP BY user_id""",
        *_REC_CTES, more={**sql_knn_unseen_ctes("qv"), "rec": _REC_BODY},
    ),
}

ORACLES["mark_consumed_bitmaps"] = ORACLES["mark_consumed"]

QUERIES = {
    "slot_probabilities": q_slot_probabilities,
    "sample_slot": q_sample_slot,
    "explore_gate": q_explore_gate,
    "random_unit_vector": q_random_unit_vector,
    "recommend_batch": q_recommend_batch,
    "mark_consumed": q_mark_consumed,
    "mark_consumed_bitmaps": q_mark_consumed_bitmaps,
}
