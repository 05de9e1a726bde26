"""What a join or a stream of reactions holds: no large catalogue on the driver, vectors shuffled once."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.operators import profile as P
from prefspark.operators import sweep as SW


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_limit_counts_the_bytes_of_doubles(spark):
    reactions = spark.range(50).select(F.col("id").alias("item_id"))
    items = spark.range(100).select(F.col("id").alias("item_id"), F.array_repeat(F.col("id").cast("double"), 4).alias("embedding"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in _plan(P.attach_vectors(reactions, items, 100 * 4 * 8))
        by_shuffle = P.attach_vectors(reactions, items, 100 * 4 * 8 - 1)
        assert "BroadcastHashJoin" not in _plan(by_shuffle)
        floats = items.withColumn("embedding", F.col("embedding").cast("array<float>"))
        assert "BroadcastHashJoin" in _plan(P.attach_vectors(reactions, floats, 100 * 4 * 4))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.item_id, list(r.vec)) for r in by_shuffle.collect()) == [(k, [float(k)] * 4) for k in range(50)]


def test_sweep_shuffles_vectors_once(spark):
    """Events with their vectors go to (block, user) and nowhere before; a user of none and one with many events too."""
    rows = [(u, k, 100 * u + k, [1.0, float(k % 3)], "c0", {"p": 10.0}) for u, n in ((1, 4), (2, 30)) for k in range(n)]
    rows.append((None, 0, 999, [1.0, 0.0], "c0", {"p": 10.0}))
    events = spark.createDataFrame(rows, "user_id long, ts long, event_id long, vec array<double>, category string, rewards map<string,double>")
    prefs = spark.createDataFrame([("p", "c0", 1.0)], "profile string, category string, p double")
    grid = SW.param_grid({"alpha": [0.2, 0.4], "gamma": [0.9], "beta": [2.0], "max_embeddings": [5], "exp_rate": [1.0, 0.5], "n_components": [0]})
    got = SW.sweep_replay(events, prefs, grid, configs_per_task=4, steps_per_task=40)
    assert "hashpartitioning(user_id" not in _plan(got)
    whole = SW.sweep_replay(events, prefs, grid)
    cols = ["config_id", "total_reward", "n_accepted", "n_events"]
    assert sorted(got.select(*cols).collect()) == sorted(whole.select(*cols).collect())
    assert {r.n_events for r in whole.collect()} == {34}
