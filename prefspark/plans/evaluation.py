"""Registered evaluation queries (F1-F15) and their DuckDB oracles.

F1-F8 treat each (preference profile, user) as a run over all of the user's
reactions, scored with the profile's Bernoulli reward.  The sweep (F9, F10)
replays reactions over the FIXTURES grid, and F11-F15 analyse its results; the
oracle replays the grid as recursive SQL (``foldsql``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.draws import sql_uniform
from prefspark.operators import evaluate as EV
from prefspark.operators import profile as P
from prefspark.operators import sweep as SW
from prefspark.plans.catalogue import nested_catalogue
from prefspark.plans.common import rnd
from prefspark.plans.foldsql import replay_ctes
from prefspark.session import materialize
from prefspark.sources import tables as T
from prefspark.sources.profiles import NEWSGROUP_PROFILES, preferences_from_dict, preferences_sql

SEED = 42
GRID = {
    "alpha": [0.2, 0.4, 0.6],
    "gamma": [0.2, 0.28, 0.95],
    "beta": [2.0, 4.0],
    "max_embeddings": [20],
    "exp_rate": [0.2, 1.0],
    "n_components": [64],
}
COMPONENTS_GRID = {**GRID, "alpha": [0.2], "beta": [2.0], "exp_rate": [0.2], "n_components": [8, 16, 32, 64]}
RUN = ["profile", "user_id"]


def events_with_category(spark: SparkSession, sf: str) -> DataFrame:
    return EV.item_category_join(T.reactions(spark, sf), T.items(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return EV.bernoulli_reward(events_with_category(spark, sf), T.preferences(spark, sf), SEED)


def q_item_category_join(spark: SparkSession, sf: str) -> DataFrame:
    """each reaction with its item's category."""
    return events_with_category(spark, sf).select("event_id", "user_id", "item_id", "category")


def q_bernoulli_reward(spark: SparkSession, sf: str) -> DataFrame:
    """F2: each reaction scored under each preference profile (+10 / -10)."""
    return scored(spark, sf).select("profile", "event_id", "category", "sim_reward")


def q_unmatched_reactions(spark: SparkSession, sf: str) -> DataFrame:
    """reactions that find no item in the catalogue, or no probability in a profile, with the reason."""
    lost_item = EV.unmatched(T.reactions(spark, sf), T.items(spark, sf), "item_id", "no such item")
    lost_category = EV.unmatched(events_with_category(spark, sf), T.preferences(spark, sf), "category", "no such category")
    return lost_item.select("event_id", "item_id", "reason").unionByName(lost_category.select("event_id", "item_id", "reason"))


def q_validate_profile_keys(spark: SparkSession, sf: str) -> DataFrame:
    """how each profile's keys differ from the category set."""
    return EV.validate_profile_keys(T.preferences(spark, sf), T.items(spark, sf).select("category"))


def q_validate_newsgroup_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """F3 on the evaluation's four newsgroup profiles against the corpus's categories."""
    prefs = preferences_from_dict(spark, NEWSGROUP_PROFILES)
    return EV.validate_profile_keys(prefs, T.table(spark, sf, "documents").select(F.col("source").alias("category")))


def q_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    """zero-filled reaction counts per user and category."""
    return EV.category_counts(events_with_category(spark, sf), ["user_id"], T.items(spark, sf).select("category"))


def q_reward_history(spark: SparkSession, sf: str) -> DataFrame:
    """ordered steps with category and reward per (profile, user)."""
    return EV.reward_history(scored(spark, sf), RUN)


def q_reward_summary(spark: SparkSession, sf: str) -> DataFrame:
    """total, mean and population std of rewards per (profile, user)."""
    s = EV.reward_summary(scored(spark, sf), RUN)
    return s.select(*RUN, "total_reward", rnd("avg_reward").alias("avg_reward"), rnd("reward_std").alias("reward_std"))


def _observed_counts(spark: SparkSession, sf: str, preferences: DataFrame) -> DataFrame:
    runs = EV.bernoulli_reward(events_with_category(spark, sf), preferences, SEED)
    return runs.groupBy(*RUN, "category").agg(F.count(F.lit(1)).alias("n"))


def q_preference_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """squared-error alignment of observed shares with the profile."""
    prefs = T.preferences(spark, sf)
    a = EV.alignment_and_diversity(_observed_counts(spark, sf, prefs), RUN, prefs, F.col("profile"))
    return a.select(*RUN, rnd("preference_alignment").alias("preference_alignment"))


def q_diversity_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """F8: entropy of each user's category shares."""
    prefs = T.preferences(spark, sf).where("profile = 'balanced'")  # the score doesn't depend on the profile
    a = EV.alignment_and_diversity(_observed_counts(spark, sf, prefs), RUN, prefs, F.col("profile"))
    return a.select("user_id", rnd("diversity_score").alias("diversity_score"))


def sweep(spark: SparkSession, sf: str, grid: dict) -> DataFrame:
    ev = P.attach_vectors(events_with_category(spark, sf), T.items(spark, sf))
    ev = EV.bernoulli_reward_map(ev, T.preferences(spark, sf), SEED)
    return SW.sweep_replay(ev, T.preferences(spark, sf), SW.grid_frame(spark, grid), SEED)


def q_sweep_replay(spark: SparkSession, sf: str) -> DataFrame:
    """the replay of every configuration of the grid."""
    r = sweep(spark, sf, GRID)
    rounded = ("avg_reward", "reward_std", "preference_alignment", "diversity_score")
    return r.select("config_id", "preference_type", "total_reward", *[rnd(c).alias(c) for c in rounded],
                    F.map_values("result_preferences").alias("category_counts"), "n_accepted", "n_events", "error")


def q_sweep_components(spark: SparkSession, sf: str) -> DataFrame:
    """F10 over reduced catalogues (B6): one projection, of which each configuration reads its first components.

    Rows-only: principal axes are beyond SQL; tests compare with runs one by one.
    """
    cat = materialize(nested_catalogue(spark, sf), "nested-catalogue")
    ev = P.attach_vectors(events_with_category(spark, sf), cat)
    ev = EV.bernoulli_reward_map(ev, T.preferences(spark, sf), SEED)
    r = SW.sweep_replay(ev, T.preferences(spark, sf), SW.grid_frame(spark, COMPONENTS_GRID), SEED)
    flat = EV.flatten_results(r)
    return flat.select(*[rnd(c).alias(c) if c in ("avg_reward", "reward_std", "preference_alignment", "diversity_score") else c for c in _FLAT_COLS])


_FLAT_COLS = ["config_id", *SW.PARAM_ORDER, "preference_type", "total_reward", "avg_reward", "reward_std",
              "preference_alignment", "diversity_score", "n_accepted", "n_events"]


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return EV.flatten_results(sweep(spark, sf, GRID))


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    flat = _raw(spark, sf)
    return flat.select(*[rnd(c).alias(c) if c in ("avg_reward", "reward_std", "preference_alignment", "diversity_score") else c
                         for c in _FLAT_COLS])


def q_flatten_results(spark: SparkSession, sf: str) -> DataFrame:
    """sweep results with flat parameter columns."""
    return _flat(spark, sf)


def q_best_config(spark: SparkSession, sf: str) -> DataFrame:
    """the best configuration per preference type."""
    return EV.best_config(_flat(spark, sf))


def q_param_impact(spark: SparkSession, sf: str) -> DataFrame:
    """mean average reward by value of each parameter."""
    return EV.param_impact(_raw(spark, sf)).select(
        "param", "value", rnd("mean_avg_reward").alias("mean_avg_reward"), "n"
    )


def q_boxplot_stats(spark: SparkSession, sf: str) -> DataFrame:
    """quartiles, whiskers and outliers of average reward per preference type."""
    b = EV.boxplot_stats(_raw(spark, sf))
    return b.select("preference_type", *[rnd(c).alias(c) for c in ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high")],
                    "n_outliers", "n")


def q_correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson correlation of parameters and metrics (NULL for constant columns)."""
    return EV.correlation_matrix(_flat(spark, sf)).select("col_a", "col_b", (rnd("corr") + F.lit(0.0)).alias("corr"))


# ---------------------------------------------------------------------------

_U_REWARD = sql_uniform(str(SEED), "profile", "event_id", "'reward'")


def _grid_sql(grid: dict) -> str:
    names = [p for p in SW.PARAM_ORDER if p in grid]
    mult, m = {}, 1
    for n in reversed(names):
        mult[n] = m
        m *= len(grid[n])
    cast = {p: ("BIGINT" if p in ("max_embeddings", "n_components") else "DOUBLE") for p in names}
    froms = []
    for n in names:
        vals = ", ".join(f"({i}, CAST({v} AS {cast[n]}))" for i, v in enumerate(grid[n]))
        froms.append(f"(VALUES {vals}) t_{n}(i, v)")
    cid = " + ".join(f"t_{n}.i * {mult[n]}" for n in names)
    cols = ", ".join(f"t_{n}.v AS {n}" for n in names)
    return f"SELECT CAST({cid} AS BIGINT) AS config_id, {cols} FROM {', '.join(froms)}"


_EV_CTES = {
    "ev": "SELECT r.user_id, r.ts, r.event_id, r.item_id, i.category FROM reactions r JOIN items i USING (item_id)",
    "sim": f"""SELECT e.*, p.profile, p.p, CAST(CASE WHEN {_U_REWARD} < p.p THEN 10.0 ELSE -10.0 END AS DOUBLE) AS sim_reward
               FROM ev e JOIN preferences p USING (category)""",
    "obs": "SELECT profile, user_id, category, count(*) AS n FROM sim GROUP BY profile, user_id, category",
    "run_al": """SELECT o.profile, o.user_id,
                    -(s.sum_p2 + list_reduce(list_prepend(0.0::DOUBLE, list_sort(list((o.n / t.n) * (o.n / t.n) - 2 * pr.p * (o.n / t.n)))),
                                              lambda a, b: a + b)) AS preference_alignment,
                    -list_reduce(list_prepend(0.0::DOUBLE, list_sort(list((o.n / t.n) * ln(o.n / t.n)))), lambda a, b: a + b) AS diversity_score
                 FROM obs o JOIN (SELECT profile, user_id, sum(n) AS n FROM obs GROUP BY profile, user_id) t USING (profile, user_id)
                 JOIN preferences pr ON pr.profile = o.profile AND pr.category = o.category
                 JOIN (SELECT profile, list_reduce(list_prepend(0.0::DOUBLE, list_sort(list(p * p))), lambda a, b: a + b) AS sum_p2
                       FROM preferences GROUP BY profile) s ON s.profile = o.profile
                 GROUP BY o.profile, o.user_id, s.sum_p2""",
    **replay_ctes(_grid_sql(GRID), sql_uniform, SEED, SW.MIN_SAMPLES),
    "tot": """SELECT config_id, profile, sum(reward) FILTER (WHERE accepted) AS total_reward, avg(reward) FILTER (WHERE accepted) AS avg_reward,
                     stddev_pop(reward) FILTER (WHERE accepted) AS reward_std, count(*) FILTER (WHERE accepted) AS n_accepted, count(*) AS n_events
              FROM replayed WHERE pos > 0 GROUP BY config_id, profile""",
    "cc": "SELECT config_id, profile, category, count(*) AS n FROM replayed WHERE accepted GROUP BY config_id, profile, category",
    "al": """SELECT t.config_id, t.profile, -sum(power(pr.p - coalesce(cc.n, 0) / t.n_accepted, 2)) AS preference_alignment,
                    list(CAST(coalesce(cc.n, 0) AS BIGINT) ORDER BY pr.category) AS category_counts
             FROM tot t JOIN preferences pr USING (profile) LEFT JOIN cc ON cc.config_id = t.config_id AND cc.profile = t.profile AND cc.category = pr.category
             GROUP BY t.config_id, t.profile""",
    "dv": """SELECT config_id, profile, -sum(cc.n / t.n_accepted * ln(cc.n / t.n_accepted)) AS diversity_score
             FROM cc JOIN tot t USING (config_id, profile) GROUP BY config_id, profile""",
    "raw": "SELECT g.*, t.profile AS preference_type, t.avg_reward FROM grid g JOIN tot t USING (config_id)",
    "flat": """SELECT g.config_id, g.alpha, g.gamma, g.beta, g.max_embeddings, g.exp_rate, g.n_components,
                      t.profile AS preference_type, t.total_reward, round(t.avg_reward, 6) AS avg_reward,
                      round(t.reward_std, 6) AS reward_std, round(a.preference_alignment, 6) AS preference_alignment,
                      round(d.diversity_score, 6) AS diversity_score, t.n_accepted, t.n_events
               FROM grid g JOIN tot t USING (config_id) JOIN al a USING (config_id, profile) JOIN dv d USING (config_id, profile)""",
}


def _q(body: str, *ctes: str) -> str:
    return T.with_views(body, "items", "reactions", "preferences", extra={k: _EV_CTES[k] for k in ctes})


_RAW = ("ev", "sim", "similarities", "stepped", "grid", "replayed", "tot", "raw")
_FLAT = ("ev", "sim", "similarities", "stepped", "grid", "replayed", "tot", "cc", "al", "dv", "flat")
_CORR_COLS = SW.PARAM_ORDER + EV.METRICS


def _corr_sql() -> str:
    parts = []
    for a in _CORR_COLS:
        for b in _CORR_COLS:
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / "
                f"nullif(stddev_pop(CAST({a} AS DOUBLE)) * stddev_pop(CAST({b} AS DOUBLE)), 0), 6) + 0.0 AS corr FROM flat"
            )
    return " UNION ALL ".join(parts)


ORACLES = {
    "item_category_join": _q("SELECT event_id, user_id, item_id, category FROM ev", "ev"),
    "bernoulli_reward": _q("SELECT profile, event_id, category, sim_reward FROM sim", "ev", "sim"),
    "unmatched_reactions": _q(
        """SELECT event_id, item_id, 'no such item' AS reason FROM reactions WHERE item_id NOT IN (SELECT item_id FROM items)
           UNION ALL SELECT event_id, item_id, 'no such category' AS reason FROM ev WHERE category NOT IN (SELECT category FROM preferences)""",
        "ev",
    ),
    "validate_profile_keys": T.with_views(
        """SELECT profile, CAST(count(*) AS BIGINT) AS n_given,
                  CAST((SELECT count(DISTINCT category) FROM items) AS BIGINT) AS n_expected,
                  CAST((SELECT count(DISTINCT category) FROM items) - count(i.category) AS BIGINT) AS n_missing,
                  CAST(count(*) - count(i.category) AS BIGINT) AS n_extra,
                  count(*) = count(i.category) AND count(i.category) = (SELECT count(DISTINCT category) FROM items) AS valid
           FROM (SELECT DISTINCT profile, category FROM preferences) p
           LEFT JOIN (SELECT DISTINCT category FROM items) i USING (category) GROUP BY profile""",
        "items", "preferences",
    ),
    "validate_newsgroup_profiles": f"""WITH prefs AS ({preferences_sql(NEWSGROUP_PROFILES)}),
          cats AS (SELECT DISTINCT source AS category FROM documents)
        SELECT profile, CAST(count(*) AS BIGINT) AS n_given, CAST((SELECT count(*) FROM cats) AS BIGINT) AS n_expected,
               CAST((SELECT count(*) FROM cats) - count(c.category) AS BIGINT) AS n_missing,
               CAST(count(*) - count(c.category) AS BIGINT) AS n_extra,
               count(*) = count(c.category) AND count(c.category) = (SELECT count(*) FROM cats) AS valid
        FROM (SELECT DISTINCT profile, category FROM prefs) p LEFT JOIN cats c USING (category) GROUP BY profile""",
    "category_counts": _q(
        """SELECT u.user_id, c.category, CAST(coalesce(o.n, 0) AS BIGINT) AS n
           FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN (SELECT DISTINCT category FROM items) c
           LEFT JOIN (SELECT user_id, category, count(*) AS n FROM ev GROUP BY user_id, category) o USING (user_id, category)""",
        "ev",
    ),
    "reward_history": _q(
        """SELECT profile, user_id, row_number() OVER (PARTITION BY profile, user_id ORDER BY ts, event_id) AS step,
                  category, sim_reward AS reward FROM sim""",
        "ev", "sim",
    ),
    "reward_summary": _q(
        """SELECT profile, user_id, sum(sim_reward) AS total_reward, round(avg(sim_reward), 6) AS avg_reward,
                  round(stddev_pop(sim_reward), 6) AS reward_std FROM sim GROUP BY profile, user_id""",
        "ev", "sim",
    ),
    "preference_alignment": _q(
        "SELECT profile, user_id, round(preference_alignment, 6) AS preference_alignment FROM run_al",
        "ev", "sim", "obs", "run_al",
    ),
    "diversity_entropy": _q(
        "SELECT user_id, round(diversity_score, 6) AS diversity_score FROM run_al WHERE profile = 'balanced'",
        "ev", "sim", "obs", "run_al",
    ),
    "sweep_replay": _q(
        """SELECT f.config_id, f.preference_type, f.total_reward, f.avg_reward, f.reward_std, f.preference_alignment, f.diversity_score,
                  a.category_counts, f.n_accepted, f.n_events, NULL::VARCHAR AS error
           FROM flat f JOIN al a ON a.config_id = f.config_id AND a.profile = f.preference_type""",
        *_FLAT,
    ),
    "flatten_results": _q("SELECT * FROM flat", *_FLAT),
    "best_config": _q(
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY preference_type
                  ORDER BY avg_reward DESC, config_id) AS rn FROM flat) WHERE rn = 1""",
        *_FLAT,
    ),
    "param_impact": _q(
        " UNION ALL ".join(
            f"SELECT '{p}' AS param, CAST({p} AS DOUBLE) AS value, round(avg(avg_reward), 6) AS mean_avg_reward, "
            f"count(*) AS n FROM raw GROUP BY {p}"
            for p in SW.PARAM_ORDER
        ),
        *_RAW,
    ),
    "boxplot_stats": _q(
        """SELECT q.preference_type, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
                  round(q3 - q1, 6) AS iqr,
                  round(min(CASE WHEN f.avg_reward BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN f.avg_reward END), 6) AS whisker_low,
                  round(max(CASE WHEN f.avg_reward BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN f.avg_reward END), 6) AS whisker_high,
                  CAST(sum(CASE WHEN f.avg_reward BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
                  count(*) AS n
           FROM raw f JOIN (SELECT preference_type, quantile_cont(avg_reward, 0.25) AS q1, quantile_cont(avg_reward, 0.5) AS med,
                                    quantile_cont(avg_reward, 0.75) AS q3 FROM raw GROUP BY preference_type) q USING (preference_type)
           GROUP BY q.preference_type, q1, med, q3""",
        *_RAW,
    ),
    "correlation_matrix": _q(_corr_sql(), *_FLAT),
}

QUERIES = {
    "item_category_join": q_item_category_join,
    "bernoulli_reward": q_bernoulli_reward,
    "unmatched_reactions": q_unmatched_reactions,
    "validate_profile_keys": q_validate_profile_keys,
    "validate_newsgroup_profiles": q_validate_newsgroup_profiles,
    "category_counts": q_category_counts,
    "reward_history": q_reward_history,
    "reward_summary": q_reward_summary,
    "preference_alignment": q_preference_alignment,
    "diversity_entropy": q_diversity_entropy,
    "sweep_replay": q_sweep_replay,
    "sweep_components": q_sweep_components,
    "flatten_results": q_flatten_results,
    "best_config": q_best_config,
    "param_impact": q_param_impact,
    "boxplot_stats": q_boxplot_stats,
    "correlation_matrix": q_correlation_matrix,
}
