"""Recommendation for all users at once.

One DataFrame plan: per user, a keyed draw decides explore or exploit; exploit
samples a slot from the UCB softmax by inverse CDF over a window ordered by slot;
explore (or an empty profile) draws a random unit vector; the query vectors then
go through the reference-mode nearest-unseen search (C5).  Every draw is keyed by
``(seed, user_id, step)``, so the result does not depend on partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions import draws
from prefspark.operators import knn
from prefspark.operators.profile import ucb_expr
from prefspark.session import materialize


def slot_probabilities(profile: DataFrame, beta: float, temperature: float = 1.0) -> DataFrame:
    """Softmax of UCB scores per user with temperature, max shifted."""
    if temperature <= 0:
        raise ValueError(f"a softmax needs a temperature above 0, not {temperature}")
    w = Window.partitionBy("user_id")
    ucb = ucb_expr(beta)
    z = F.exp((F.col("ucb") - F.max("ucb").over(w)) / F.lit(float(temperature)))
    return (
        profile.select("*", ucb.alias("ucb"))
        .select("*", z.alias("_z"))
        .select("*", (F.col("_z") / F.sum("_z").over(w)).alias("probability"))
        .drop("_z")
    )


def sample_slot(probs: DataFrame, seed: int, step: int) -> DataFrame:
    """One slot per user by inverse CDF; the last slot guards round-off."""
    cum_w = Window.partitionBy("user_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    u = draws.uniform(seed, F.col("user_id"), step, "slot")
    c = probs.select("user_id", "slot", F.sum("probability").over(cum_w).alias("cum"), u.alias("u"))
    return c.groupBy("user_id").agg(
        F.coalesce(F.min(F.when(F.col("cum") > F.col("u"), F.col("slot"))), F.max("slot")).alias("slot")
    )


def explore_gate(users: DataFrame, seed: int, step: int, exp_rate: float) -> DataFrame:
    """``u(seed, user, step, 'gate') < exp_rate`` means explore."""
    return users.select("user_id", (draws.uniform(seed, F.col("user_id"), step, "gate") < F.lit(exp_rate)).alias("explore"))


def random_unit_vectors(users: DataFrame, dim_col, seed: int, step: int) -> DataFrame:
    """A keyed random unit vector per user (dimension per row)."""
    dim = dim_col if isinstance(dim_col, Column) else F.lit(int(dim_col))
    with_dim = users.select("user_id", dim.alias("_dim"))  # a subquery may not sit inside a lambda
    return draws.with_random_unit_vector(with_dim, "query", seed, F.col("_dim"), F.col("user_id"), step, "explore").select(
        "user_id", "query"
    )


def query_vectors(
    users: DataFrame, profile: DataFrame, catalogue_dim: int, beta: float, exp_rate: float, seed: int, step: int,
    temperature: float = 1.0,
) -> DataFrame:
    """Per user: mode, chosen slot (-1 when exploring) and the query vector."""
    dims = profile.groupBy("user_id").agg(F.max(F.size("embedding")).alias("_dim"))
    gate = explore_gate(users, seed, step, exp_rate).join(dims, "user_id", "left")
    # An empty profile always explores, at the catalogue's dimension.
    gate = gate.select(
        "user_id",
        (F.col("explore") | F.col("_dim").isNull()).alias("explore"),
        F.coalesce(F.col("_dim"), catalogue_dim if isinstance(catalogue_dim, Column) else F.lit(catalogue_dim)).alias("_dim"),
    )
    chosen = sample_slot(slot_probabilities(profile, beta, temperature), seed, step)
    slot_vec = profile.select("user_id", "slot", F.col("embedding").alias("_vec"))
    exploit = chosen.join(slot_vec, ["user_id", "slot"])
    drawn = F.when(F.col("explore"), F.col("_dim")).otherwise(F.lit(1))  # who exploits needs no random vector
    gate = draws.with_random_unit_vector(gate.withColumn("_dim", drawn), "_rvec", seed, F.col("_dim"), F.col("user_id"), step, "explore")
    rnd_vec = F.col("_rvec")
    out = gate.join(exploit, "user_id", "left").select(
        "user_id",
        F.when(F.col("explore"), F.lit("explore")).otherwise(F.lit("exploit")).alias("mode"),
        F.when(F.col("explore"), F.lit(-1).cast("long")).otherwise(F.col("slot")).alias("slot"),
        F.when(F.col("explore"), rnd_vec).otherwise(F.transform("_vec", lambda x: x.cast("double"))).alias("query"),
    )
    return out


def recommend_batch(
    users: DataFrame, profile: DataFrame, items: DataFrame, seen: DataFrame, n_items_col, catalogue_dim: int,
    beta: float, exp_rate: float, seed: int = 42, step: int = 0, k_candidates: int = 10, temperature: float = 1.0,
) -> DataFrame:
    """E5: one recommendation per user: ``user_id, mode, slot, item_id, fallback``.

    Users with nothing left to recommend get no row.
    """
    # Written once: the search, its fallback and the answer all read the same draws.
    q = materialize(query_vectors(users, profile, catalogue_dim, beta, exp_rate, seed, step, temperature), "query-vectors")
    rec = knn.knn_unseen(q.select("user_id", "query"), items, seen, n_items_col, k_candidates)
    return q.select("user_id", "mode", "slot").join(rec, "user_id")


def mark_consumed(seen: DataFrame, recommended: DataFrame) -> DataFrame:
    """Add the recommended items to the users' seen sets."""
    return seen.select("user_id", "item_id").unionByName(recommended.select("user_id", "item_id")).dropDuplicates(
        ["user_id", "item_id"]
    )
