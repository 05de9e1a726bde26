"""Registered profile queries (D1-D11) and their DuckDB oracles.

The fold is checked against the same fold as recursive SQL (``foldsql``), with
matching, eviction and the gradient update's preferences.  Profile readers (D3, D5, D6) run over ``sql_profile``, the
SQL-derivable profile; in normal use they read the fold snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.operators import profile as P
from prefspark.operators.scan import ordered_scan
from prefspark.plans.common import rnd
from prefspark.plans.foldsql import fold_ctes
from prefspark.session import materialize, scratch_path
from prefspark.sources import tables as T
from prefspark.sources.store import StateStore

# Settings under which the fold's slots are SQL-derivable (FIXTURES.md section 3).
EXACT = P.FoldParams(alpha=0.2, gamma=0.999, beta=2.0, max_embeddings=100, min_samples=10)
# The recommender's defaults.
DEFAULT = P.FoldParams(alpha=0.2, gamma=0.95, beta=2.0, max_embeddings=100, min_samples=10)
# A setting with real matching and eviction (FIXTURES.md section 3 coverage table).
EVICTING = P.FoldParams(alpha=0.2, gamma=0.28, beta=2.0, max_embeddings=20, min_samples=3)

BETA = 2.0
MIN_SAMPLES = 3


def reactions_with_vec(spark: SparkSession, sf: str) -> DataFrame:
    return P.attach_vectors(T.reactions(spark, sf), T.items(spark, sf))


def folded(spark: SparkSession, sf: str, params: P.FoldParams) -> DataFrame:
    return P.fold_profiles(reactions_with_vec(spark, sf), params)


def _slot_cols(df: DataFrame) -> DataFrame:
    return df.select(
        "user_id", "slot", "item_id", rnd("preference").alias("preference"), "rewards_received", "total_rewards", rnd("reward_average").alias("reward_average")
    )


def q_profile_fold(spark: SparkSession, sf: str) -> DataFrame:
    """D8 (and D7): the fold's slots under SQL-derivable settings."""
    return _slot_cols(folded(spark, sf, EXACT))


def q_profile_fold_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Fold each user's first half, store, resume with the second half."""
    r = reactions_with_vec(spark, sf)
    n = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    halves = ordered_scan(r, "user_id", ["ts", "event_id"]).join(n, "user_id")
    first = halves.where((F.col("position") + 1) * 2 <= F.col("_n")).drop("position", "_n")
    second = halves.where((F.col("position") + 1) * 2 > F.col("_n")).drop("position", "_n")
    snap = materialize(P.fold_profiles(first, EVICTING), "profile-snapshot")
    return _slot_cols(P.resume_profiles(snap, second, EVICTING))


def add_reactions(store: StateStore, reactions: DataFrame, params: P.FoldParams) -> int:
    """D9 over a store: fold new reactions into their users' stored profiles; the new version."""
    stored = store.read_keys(reactions)
    folded_now = P.fold_profiles(reactions, params) if stored is None else P.resume_profiles(stored, reactions, params)
    return store.update(materialize(folded_now, "profile-increment"))


def q_profile_store_increments(spark: SparkSession, sf: str) -> DataFrame:
    """All reactions in three increments by time, each folded into a versioned store; the last version."""
    r = reactions_with_vec(spark, sf)
    edges = T.table(spark, sf, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    cuts = [edges["a"] + (edges["b"] - edges["a"]) * k / 3 for k in (1, 2)] if edges["a"] is not None else []
    store = StateStore(spark, scratch_path(spark, "profile-store"))
    part = sum((F.col("ts") > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    for k in range(3):
        add_reactions(store, r.where(part == k), EVICTING)
    return _slot_cols(store.read())




def q_profile_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Totals per user from the fold at the recommender's defaults."""
    snap = folded(spark, sf, DEFAULT)
    return snap.groupBy("user_id").agg(
        F.first("total_rewards").alias("total_rewards"),
        F.round(F.first("reward_average"), 6).alias("reward_average"),
        F.count(F.lit(1)).alias("n_slots"),
        F.first("matches").alias("matches"),
        F.first("evictions").alias("evictions"),
    )


def q_profile_fold_evicting(spark: SparkSession, sf: str) -> DataFrame:
    """D6-D8 with real matching and eviction."""
    snap = folded(spark, sf, EVICTING)
    return snap.select(
        "user_id", "slot", "item_id", rnd("preference").alias("preference"), "rewards_received",
        "total_rewards", rnd("reward_average").alias("reward_average"), "matches", "evictions",
    )


def q_profile_step(spark: SparkSession, sf: str) -> DataFrame:
    """D4 + D7: each user's latest reaction applied to the profile of all earlier ones.

    ``action`` is ``update`` (the reaction matched a slot: in-place gradient step) or
    ``add`` (a new slot, after evicting one when the profile was full).
    """
    r = reactions_with_vec(spark, sf)
    n = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    scanned = ordered_scan(r, "user_id", ["ts", "event_id"]).join(n, "user_id")
    earlier = scanned.where(F.col("position") + 1 < F.col("_n")).drop("position", "_n")
    latest = scanned.where(F.col("position") + 1 == F.col("_n")).drop("position", "_n")
    before_snap = materialize(P.fold_profiles(earlier, EVICTING), "profile-snapshot")  # read by both branches, folded once
    after_snap = P.resume_profiles(before_snap, latest, EVICTING)
    before = before_snap.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_slots_before"), F.first("matches").alias("_m0"), F.first("evictions").alias("_e0"),
    )
    after = after_snap.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_slots_after"), F.first("matches").alias("_m1"), F.first("evictions").alias("_e1"),
        F.first("total_rewards").alias("total_rewards"),
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "preference"))), lambda s: F.round(s["preference"], 6)).alias("preferences"),
    )
    j = after.join(before, "user_id", "left").fillna(0, ["n_slots_before", "_m0", "_e0"])
    return j.select(
        "user_id",
        F.when(F.col("_m1") > F.col("_m0"), F.lit("update")).otherwise(F.lit("add")).alias("action"),
        (F.col("_e1") > F.col("_e0")).alias("evicted"),
        F.col("n_slots_before").cast("long").alias("n_slots_before"), "n_slots_after", "total_rewards", "preferences",
    )


def q_running_reward_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline before each reaction (mean of the user's earlier rewards)."""
    return P.running_reward_avg(T.reactions(spark, sf)).select("user_id", "event_id", rnd("baseline").alias("baseline"))


def q_preference_decay(spark: SparkSession, sf: str) -> DataFrame:
    """D2 closed form: a slot's preference after the user's later reactions decay it."""
    r = T.reactions(spark, sf)
    pos = ordered_scan(r.select("user_id", "ts", "event_id", "item_id"), "user_id", ["ts", "event_id"]).select(
        "user_id", "item_id", (F.col("position") + 1).alias("pos")
    )
    last = pos.groupBy("user_id", "item_id").agg(F.max("pos").alias("last_pos"))
    n = pos.groupBy("user_id").agg(F.max("pos").alias("n_events"))
    prof = T.sql_profile(spark, sf).join(last, ["user_id", "item_id"]).join(n, "user_id")
    decayed = F.col("preference") * F.pow(F.lit(P.DECAY), (F.col("n_events") - F.col("last_pos")).cast("double"))
    return prof.select("user_id", "slot", rnd(decayed).alias("decayed_preference"))


def q_action_probability(spark: SparkSession, sf: str) -> DataFrame:
    """D3: softmax of preferences per user."""
    return P.action_probability(T.sql_profile(spark, sf)).select(
        "user_id", "slot", rnd("action_probability").alias("action_probability")
    )


def q_ucb_score(spark: SparkSession, sf: str) -> DataFrame:
    """UCB score per slot."""
    return P.ucb_scores(T.sql_profile(spark, sf), BETA).select("user_id", "slot", rnd("ucb").alias("ucb"))


def q_eviction_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """The slot each user would evict next."""
    return P.eviction_candidate(T.sql_profile(spark, sf), BETA, MIN_SAMPLES).select(
        "user_id", "slot", rnd("bound").alias("bound")
    )


_SLOTS_SQL = """SELECT user_id, slot, item_id, round(preference, 6) AS preference, rewards_received, total_rewards,
        round(reward_average, 6) AS reward_average FROM fold_slots"""


def fold_sql(body: str, params: P.FoldParams) -> str:
    """``body`` over ``fold`` (every step) and ``fold_slots`` (the final slots) at these settings."""
    return T.with_views(body, "items", "reactions", extra=fold_ctes(params))


ORACLES = {
    "profile_fold": fold_sql(_SLOTS_SQL, EXACT),
    "profile_fold_resume": fold_sql(_SLOTS_SQL, EVICTING),
    "profile_store_increments": fold_sql(_SLOTS_SQL, EVICTING),
    "profile_fold_evicting": fold_sql(
        """SELECT user_id, slot, item_id, round(preference, 6) AS preference, rewards_received, total_rewards,
                  round(reward_average, 6) AS reward_average, matches, evictions FROM fold_slots""",
        EVICTING,
    ),
    "profile_stats": T.with_views(
        """SELECT user_id, CAST(count(*) AS BIGINT) AS total_rewards, round(avg(reward), 6) AS reward_average,
                  CAST(count(DISTINCT item_id) AS BIGINT) AS n_slots,
                  CAST(count(*) - count(DISTINCT item_id) AS BIGINT) AS matches, CAST(0 AS BIGINT) AS evictions
           FROM reactions GROUP BY user_id""",
        "reactions",
    ),
    "profile_step": fold_sql(
        """SELECT l.user_id, CASE WHEN l.matches > b.matches THEN 'update' ELSE 'add' END AS action, l.evictions > b.evictions AS evicted,
                  CAST(len(b.items) AS BIGINT) AS n_slots_before, CAST(len(l.items) AS BIGINT) AS n_slots_after, l.total AS total_rewards,
                  list_transform(l.prefs, lambda x: round(x, 6)) AS preferences
           FROM fold_end l JOIN fold b ON b.user_id = l.user_id AND b.pos = l.pos - 1""",
        EVICTING,
    ),
    "running_reward_avg": T.with_views(
        """SELECT user_id, event_id, round(coalesce(avg(reward) OVER (PARTITION BY user_id ORDER BY ts, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS baseline FROM reactions""",
        "reactions",
    ),
    "preference_decay": T.with_views(
        f"""SELECT p.user_id, p.slot, round(p.preference * power({P.DECAY}, n.n_events - l.last_pos), 6) AS decayed_preference
            FROM sql_profile p
            JOIN (SELECT user_id, item_id, max(pos) AS last_pos FROM pos GROUP BY user_id, item_id) l USING (user_id, item_id)
            JOIN (SELECT user_id, max(pos) AS n_events FROM pos GROUP BY user_id) n USING (user_id)""",
        "sql_profile",
        extra={"pos": "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM reactions"},
    ),
    "action_probability": T.with_views(
        """SELECT user_id, slot, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS action_probability
           FROM (SELECT user_id, slot, exp(preference - max(preference) OVER (PARTITION BY user_id)) AS e
                 FROM sql_profile)""",
        "sql_profile",
    ),
    "ucb_score": T.with_views(
        f"""SELECT user_id, slot, round({BETA} * ln(total_rewards) / rewards_received + preference, 6) AS ucb
            FROM sql_profile""",
        "sql_profile",
    ),
    "eviction_candidate": T.with_views(
        f"""SELECT user_id, slot, round(bound, 6) AS bound FROM (
              SELECT user_id, slot, bound, row_number() OVER (PARTITION BY user_id ORDER BY bound, slot) AS rn FROM (
                SELECT user_id, slot, CASE WHEN max(CASE WHEN rewards_received >= {MIN_SAMPLES} THEN 1 ELSE 0 END)
                          OVER (PARTITION BY user_id) = 1
                        THEN CASE WHEN rewards_received >= {MIN_SAMPLES}
                                  THEN preference - {BETA} * sqrt(1.0 / rewards_received) END
                        ELSE preference END AS bound
                FROM sql_profile) WHERE bound IS NOT NULL) WHERE rn = 1""",
        "sql_profile",
    ),
}

QUERIES = {
    "profile_fold": q_profile_fold,
    "profile_fold_resume": q_profile_fold_resume,
    "profile_store_increments": q_profile_store_increments,
    "profile_stats": q_profile_stats,
    "profile_fold_evicting": q_profile_fold_evicting,
    "profile_step": q_profile_step,
    "running_reward_avg": q_running_reward_avg,
    "preference_decay": q_preference_decay,
    "action_probability": q_action_probability,
    "ucb_score": q_ucb_score,
    "eviction_candidate": q_eviction_candidate,
}
