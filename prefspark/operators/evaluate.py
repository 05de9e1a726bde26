"""Evaluation metrics and result analysis.

A *run* is any grouping of reactions (a user, a sweep configuration, ...).
All metrics are aggregates over per-(run, category) sums, so each is one
partial-aggregated shuffle.  Zero-filled category counts are built per run
from the (small, size-checked) category dimension, never from a users x
categories product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions import draws
from prefspark.session import materialize

REWARD_MAX = 10.0
MAX_BROADCAST_ROWS = 100_000  # a dimension is broadcast up to this many rows, joined by shuffle beyond
CATEGORY_BLOCK = 10_000  # categories that are zero-filled from one array
MAX_LOOKUP_ROWS = 2_000_000  # item -> category lookup (~30 bytes a row) broadcast only up to ~60 MB


def checked_broadcast(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A dimension, marked for broadcast if its size is proven; joined by shuffle otherwise."""
    n = dim.count()
    if n > max_rows:
        return dim
    return F.broadcast(dim)


def item_category_join(reactions: DataFrame, items: DataFrame) -> DataFrame:
    """attach each reacted item's category (broadcast dimension, size checked); ``unmatched`` has the rest."""
    cats = checked_broadcast(items.select("item_id", "category"), MAX_LOOKUP_ROWS)
    return reactions.join(cats, "item_id")


def unmatched(rows: DataFrame, dimension: DataFrame, key: str, reason: str) -> DataFrame:
    """Rows whose ``key`` the dimension doesn't have: what F1 and F2 leave out, with the reason."""
    return rows.join(checked_broadcast(dimension.select(key).distinct(), MAX_LOOKUP_ROWS), key, "left_anti").withColumn("reason", F.lit(reason))


def bernoulli_reward(events: DataFrame, preferences: DataFrame, seed: int, reward_max: float = REWARD_MAX) -> DataFrame:
    """per (profile, event): ``+R`` with probability ``p(category)``, else ``-R``.

    ``events`` needs ``event_id`` and ``category``; the draw is keyed by
    ``(seed, profile, event_id)``.
    """
    prefs = checked_broadcast(preferences.select("profile", "category", "p"))
    u = draws.uniform(seed, F.col("profile"), F.col("event_id"), "reward")
    return events.join(prefs, "category").withColumn(
        "sim_reward", F.when(u < F.col("p"), F.lit(reward_max)).otherwise(F.lit(-reward_max))
    )


def bernoulli_reward_map(events: DataFrame, preferences: DataFrame, seed: int, reward_max: float = REWARD_MAX) -> DataFrame:
    """F2 for every profile at once: ``rewards`` = map profile -> +-R (same draws as
    ``bernoulli_reward``), one row per event instead of one per (event, profile)."""
    by_cat = preferences.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("profile", "p"))).alias("_p"))
    j = events.join(checked_broadcast(by_cat), "category")
    u = lambda prof: draws.uniform(seed, prof, F.col("event_id"), "reward")
    rewards = F.transform_values("_p", lambda prof, p: F.when(u(prof) < p, F.lit(reward_max)).otherwise(F.lit(-reward_max)))
    return j.withColumn("rewards", rewards).drop("_p")


def validate_profile_keys(preferences: DataFrame, categories: DataFrame) -> DataFrame:
    """per profile, how its keys differ from the category set (both ways).

    ``n_missing`` = categories the profile does not name, ``n_extra`` = names that
    are not categories; the profile is valid when both are 0.
    """
    cats = categories.select("category").distinct()
    n_cat = cats.select(F.count(F.lit(1))).scalar()
    given = preferences.select("profile", "category").distinct()
    known = given.join(checked_broadcast(cats.withColumn("_known", F.lit(1))), "category", "left")
    per = known.groupBy("profile").agg(
        F.count(F.lit(1)).alias("n_given"), F.sum(F.coalesce(F.col("_known"), F.lit(0))).alias("n_known")
    )
    return per.select(
        "profile",
        F.col("n_given").cast("long").alias("n_given"),
        n_cat.cast("long").alias("n_expected"),
        (n_cat - F.col("n_known")).cast("long").alias("n_missing"),
        (F.col("n_given") - F.col("n_known")).cast("long").alias("n_extra"),
        ((F.col("n_given") == F.col("n_known")) & (F.col("n_known") == n_cat)).alias("valid"),
    )


def category_counts(runs: DataFrame, run_cols: list[str], categories: DataFrame) -> DataFrame:
    """zero-filled count per (run, category), long form.

    Observed counts are aggregated first. The categories lie in blocks (arrays of about
    CATEGORY_BLOCK of them); each run meets each block and fills it, so the output is
    runs x categories by definition, whatever their number.
    """
    cats = categories.select("category").distinct()
    n_blocks = max(1, -(-cats.count() // CATEGORY_BLOCK))
    block = F.pmod(F.xxhash64("category"), F.lit(n_blocks)).cast("int").alias("_block")
    blocks = cats.groupBy(block).agg(F.array_sort(F.collect_list("category")).alias("_cats"))
    obs = runs.groupBy(*run_cols, "category").agg(F.count(F.lit(1)).alias("n"))
    seen = obs.groupBy(*run_cols, block).agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("_m"))
    every = runs.select(*run_cols).distinct().select(*run_cols, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"))
    filled = every.join(blocks, "_block").join(seen, [*run_cols, "_block"], "left").select(*run_cols, F.explode("_cats").alias("category"), "_m")
    return filled.select(*run_cols, "category", F.coalesce(F.col("_m")[F.col("category")], F.lit(0)).cast("long").alias("n"))


def reward_history(runs: DataFrame, run_cols: list[str], reward_col: str = "sim_reward") -> DataFrame:
    """ordered (step, category, reward) per run, by a distributed ordered scan
    (a run with a huge history is spread over many tasks)."""
    from prefspark.operators.scan import ordered_scan

    keyed = runs.select(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in run_cols]).alias("_run"), *run_cols,
                        "ts", "event_id", "category", F.col(reward_col).alias("reward"))
    scanned = ordered_scan(keyed, "_run", ["ts", "event_id"])
    return scanned.select(*run_cols, (F.col("position") + 1).alias("step"), "category", "reward")


def reward_summary(runs: DataFrame, run_cols: list[str], reward_col: str = "sim_reward") -> DataFrame:
    """sum, mean and population std of rewards per run."""
    r = F.col(reward_col)
    return runs.groupBy(*run_cols).agg(
        F.sum(r).alias("total_reward"), F.avg(r).alias("avg_reward"), F.stddev_pop(r).alias("reward_std")
    )


def alignment_and_diversity(counts: DataFrame, run_cols: list[str], preferences: DataFrame, profile_col: Column) -> DataFrame:
    """F7 + F8 from observed (run, category, n) counts.

    Alignment ``-sum_c (p_c - n_c/N)^2`` over *all* categories equals
    ``-(sum_c p_c^2 + sum_{observed c} (q_c^2 - 2 p_c q_c))``, so only observed
    categories are needed.  Diversity ``-sum q ln q`` over non-zero categories;
    0 for an empty run.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*run_cols)
    obs = counts.where(F.col("n") > 0).select("*", (F.col("n") / F.sum("n").over(w)).alias("q"))
    # Sums over a run's categories (a small, bounded list) are taken in one fixed
    # order, so the result does not depend on how rows reached the aggregate: an
    # alignment whose exact value sits on a rounding boundary rounds the same way
    # every run (and in any engine that adds the same terms in the same order).
    def ordered_sum(term):
        return F.aggregate(F.array_sort(F.collect_list(term)), F.lit(0.0), lambda acc, x: acc + x)

    p2 = preferences.groupBy("profile").agg(ordered_sum(F.col("p") * F.col("p")).alias("sum_p2"))
    prefs = preferences.select("profile", "category", "p")
    j = obs.withColumn("profile", profile_col).join(prefs, ["profile", "category"], "left").fillna(0.0, ["p"])
    agg = j.groupBy(*run_cols, "profile").agg(
        ordered_sum(F.col("q") * F.col("q") - 2 * F.col("p") * F.col("q")).alias("_part"),
        (-ordered_sum(F.col("q") * F.log(F.col("q")))).alias("diversity_score"),
    )
    return agg.join(p2, "profile").select(
        *run_cols, (-(F.col("sum_p2") + F.col("_part"))).alias("preference_alignment"), "diversity_score"
    )


# ---------------------------------------------------------------------------
# Result analysis
# ---------------------------------------------------------------------------

PARAMS = ["alpha", "gamma", "beta", "max_embeddings", "exp_rate", "n_components"]
METRICS = ["avg_reward", "preference_alignment", "diversity_score"]


def flatten_results(results: DataFrame) -> DataFrame:
    """nested ``params`` struct to flat columns; configurations that failed have no row."""
    rest = [c for c in results.columns if c not in ("params", "error")]
    done = results.where("error is null") if "error" in results.columns else results
    return done.select("params.*", *rest)


def best_config(flat: DataFrame) -> DataFrame:
    """per preference type, the first row (lowest config_id) of maximal avg_reward."""
    from pyspark.sql import Window

    w = Window.partitionBy("preference_type").orderBy(F.col("avg_reward").desc(), F.col("config_id"))
    return flat.select("*", F.row_number().over(w).alias("_rn")).where("_rn = 1").drop("_rn")


def param_impact(flat: DataFrame) -> DataFrame:
    """mean avg_reward by each value of each parameter (one unpivot, one shuffle)."""
    long = flat.select(*[F.col(p).cast("double").alias(p) for p in PARAMS], "avg_reward").unpivot(
        "avg_reward", PARAMS, "param", "value"
    )
    return long.groupBy("param", "value").agg(F.avg("avg_reward").alias("mean_avg_reward"), F.count(F.lit(1)).alias("n"))


def boxplot_stats(flat: DataFrame) -> DataFrame:
    """quartiles, 1.5 IQR whiskers and outlier count of avg_reward per preference type.

    ``flat`` is read twice, so its rows (one a configuration and type) are written once.
    """
    flat = materialize(flat.select("preference_type", "avg_reward"), "boxplot-rows")
    q = flat.groupBy("preference_type").agg(
        F.percentile("avg_reward", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
    )
    q = q.select("preference_type", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    j = flat.select("preference_type", "avg_reward").join(q, "preference_type")
    inside = (F.col("avg_reward") >= lo) & (F.col("avg_reward") <= hi)
    return j.groupBy("preference_type", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("avg_reward"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("avg_reward"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def correlation_matrix(flat: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair, long form; NULL for a constant column.

    One aggregation pass computes every covariance and standard deviation; the
    pairs are laid out afterwards from that single row (no row pairs are formed).
    """
    cols = cols or PARAMS + METRICS
    x = flat.select(*[F.col(c).cast("double").alias(c) for c in cols])
    aggs = [F.stddev_pop(c).alias(f"sd__{c}") for c in cols]
    aggs += [F.covar_pop(a, b).alias(f"cv__{a}__{b}") for i, a in enumerate(cols) for b in cols[i:]]
    one = x.agg(*aggs)
    entries = []
    for a in cols:
        for b in cols:
            lo, hi = (a, b) if cols.index(a) <= cols.index(b) else (b, a)
            corr = F.try_divide(F.col(f"cv__{lo}__{hi}"), F.col(f"sd__{a}") * F.col(f"sd__{b}"))
            entries.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), corr.alias("corr")))
    return one.select(F.inline(F.array(*entries)))
