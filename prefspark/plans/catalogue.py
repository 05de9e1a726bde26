"""Registered catalogue and map queries (B1-B10) and their DuckDB oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions import vectors as V
from prefspark.operators import features as FE
from prefspark.operators import mapview as MV
from prefspark.operators import moments as MO
from prefspark.operators import profile as P
from prefspark.plans import profiles as PP
from prefspark.plans.common import LIKED_QUERIES_SQL, liked_queries, rnd
from prefspark.plans.foldsql import fold_ctes
from prefspark.session import materialize
from prefspark.sources import tables as T

N_COMPONENTS = 16
FIRST = "category in ('c0', 'c1', 'c2', 'c3', 'c4')"  # the items of the first fit; the others come later
SMALL = P.FoldParams(alpha=0.2, gamma=0.28, beta=2.0, max_embeddings=2, min_samples=3)


def grown_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state of a first part of the catalogue, stored, then merged with the state of the later items."""
    items = T.items(spark, sf)
    stored = materialize(MO.moments(items.where(FIRST)), "moments")
    return materialize(MO.merge(stored, MO.moments(items.where(f"not ({FIRST})"))), "moments")


def nested_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Items on all principal axes of the grown fit; every reduced catalogue is its first columns."""
    return MO.project(T.items(spark, sf), MO.solve(grown_state(spark, sf)))


def q_moments_merge(spark: SparkSession, sf: str) -> DataFrame:
    """B3 incremental: mean and covariance of every pair of dimensions, from merged states of two parts."""
    state = grown_state(spark, sf).select("dim", "n", F.posexplode("scatter").alias("dim_j", "s"), "means")
    return state.select(
        F.col("dim").cast("long").alias("dim_i"), F.col("dim_j").cast("long").alias("dim_j"), "n",
        (rnd(F.col("means")[F.col("dim")]) + F.lit(0.0)).alias("mean"), (rnd(F.col("s") / F.col("n")) + F.lit(0.0)).alias("covariance"),
    )


def q_standardise_new(spark: SparkSession, sf: str) -> DataFrame:
    """B2: all items, those that came later too, by the mean and scale of the first part's stored state."""
    items = T.items(spark, sf)
    fit = MO.solve(materialize(MO.moments(items.where(FIRST)), "moments"))
    z = MO.standardise(items.select("item_id", "embedding"), fit)
    return z.select("item_id", F.posexplode("embedding").alias("dim", "z")).select("item_id", F.col("dim").cast("long").alias("dim"), (rnd("z") + F.lit(0.0)).alias("z"))


def q_pca_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Trace of the solved matrix, variance that all axes and the projected items hold, largest
    departure of the axes from orthonormal, and largest residual of an axis."""
    fit = MO.solve(grown_state(spark, sf))
    lengths = MO.project(T.items(spark, sf), fit).agg((F.sum(V.dot("embedding", "embedding")) / F.count(F.lit(1))).alias("projected"))
    departure = abs(fit.axes.T @ fit.axes - np.eye(len(fit.mean))).max()
    residual = abs(fit.correlation @ fit.axes - fit.axes * fit.variances).max()
    values = {"n": F.lit(fit.n).cast("long"), "trace": F.lit(float(np.trace(fit.correlation))), "variances": F.lit(float(fit.variances.sum())), "projected": F.col("projected"),
              "departure": F.lit(float(departure)), "residual": F.lit(float(residual))}
    return lengths.select(*[(c if k == "n" else rnd(c)).alias(k) for k, c in values.items()])


def q_catalogue_products(spark: SparkSession, sf: str) -> DataFrame:
    """Inner product of each item with the next one in the catalogue of all components."""
    cat = MO.reduced(nested_catalogue(spark, sf).select("item_id", "embedding"), 1 << 20)
    following = cat.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("following"))
    return cat.join(following, "item_id").select("item_id", (rnd(V.dot("embedding", "following")) + F.lit(0.0)).alias("product"))


def q_project_2d_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distances on the map of profiles folded to at most three slots, which a plane holds exactly."""
    xy = FE.project_2d(materialize(PP.folded(spark, sf, SMALL), "small-profiles"))
    other = xy.select("user_id", F.col("slot").alias("slot_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"))
    d = F.sqrt((F.col("x") - F.col("x_b")) ** 2 + (F.col("y") - F.col("y_b")) ** 2)
    return xy.join(other, "user_id").where("slot < slot_b").select("user_id", F.col("slot").alias("slot_a"), "slot_b", rnd(d, 4).alias("distance"))


def q_standardise_fit(spark: SparkSession, sf: str) -> DataFrame:
    """B2: per-dimension mean and population std of the raw catalogue."""
    s = FE.standardise_fit(T.items(spark, sf))
    return s.select("dim", rnd("mean").alias("mean"), rnd("std").alias("std"))


def q_catalogue_build(spark: SparkSession, sf: str) -> DataFrame:
    """Reduced, unit-length catalogue (invariants: width k, unit norms)."""
    cat, _model = FE.catalogue_build(T.items(spark, sf), N_COMPONENTS)
    return cat.select("item_id", "category", F.size("embedding").cast("long").alias("dim"), rnd(V.norm("embedding")).alias("norm"))


def q_pca_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Explained variance ratio of each fitted component (rows-only; subspace checked in tests)."""
    model = FE.fit_catalogue(T.items(spark, sf), N_COMPONENTS)
    ev = [float(x) for x in model.stages[1].explainedVariance.toArray()]
    return spark.createDataFrame([(i, v) for i, v in enumerate(ev)], "component int, explained_variance double")


def q_cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """B1: cosine of each user's latest liked item with every slot of the user's profile."""
    q = liked_queries(spark, sf).select("user_id", "query")
    prof = T.sql_profile(spark, sf).select("user_id", "slot", "embedding")
    return prof.join(q, "user_id").select("user_id", "slot", rnd(V.cosine("query", "embedding")).alias("cosine"))


def q_l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """The hashing-encoded corpus vectors normalised again (norms stay 1 or 0)."""
    from prefspark.plans.ingestion import EMBED_DIM, corpus
    from prefspark.sources.ingest import dense_vectors, hashing_embed

    dense = dense_vectors(hashing_embed(corpus(spark, sf), EMBED_DIM), EMBED_DIM, vector_type="array<double>")
    unit = dense.select("doc_id", V.l2_normalise("embedding", as_float=False).alias("u"))
    return unit.select("doc_id", rnd(V.norm("u")).alias("norm"), rnd(F.aggregate("u", F.lit(0.0), lambda a, x: a + x)).alias("sum"))


def q_project_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's folded profile on a 2-D PCA map (rows-only; checked against numpy in tests)."""
    snap = PP.folded(spark, sf, PP.EVICTING)
    return FE.project_2d(snap).select("user_id", "slot", rnd("x").alias("x"), rnd("y").alias("y"))


def q_map_table(spark: SparkSession, sf: str) -> DataFrame:
    """The full plot-ready table of every user's folded profile (x, y, size, colour).

    Rows-only: x and y come from the per-user PCA of the real fold.
    """
    snap = materialize(PP.folded(spark, sf, PP.EVICTING), "map-snapshot")
    xy = FE.project_2d(snap)
    pts = MV.map_points(snap)
    return pts.join(xy, ["user_id", "slot"]).select(
        "user_id", "slot", rnd("x").alias("x"), rnd("y").alias("y"), rnd("preference").alias("preference"),
        rnd("size_value").alias("size_value"), rnd("point_size").alias("point_size"), rnd("color").alias("color"),
        "rewards_received",
    )


def q_map_points(spark: SparkSession, sf: str) -> DataFrame:
    """Point size, colour and shifted size value per slot."""
    m = MV.map_points(T.sql_profile(spark, sf))
    return m.select("user_id", "slot", rnd("preference").alias("preference"), rnd("size_value").alias("size_value"),
                    rnd("point_size").alias("point_size"), rnd("color").alias("color"), "rewards_received")


def q_map_legend(spark: SparkSession, sf: str) -> DataFrame:
    """Legend and info box per user."""
    m = MV.map_legend(T.sql_profile(spark, sf), PP.DEFAULT.gamma, PP.DEFAULT.min_samples)
    return m.select("user_id", rnd("legend_min").alias("legend_min"), rnd("legend_mid").alias("legend_mid"),
                    rnd("legend_max").alias("legend_max"), "total_embeddings", "similarity_threshold", "min_samples")


_ENTRIES = """SELECT item_id, category, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM items"""


def _scaled_sql(where: str) -> str:
    """Entries by the mean and population deviation (1 where it is 0) of the rows under ``where``."""
    return f"""SELECT e.item_id, e.dim, (e.x - s.m) / CASE WHEN s.d = 0 THEN 1 ELSE s.d END AS z, s.d FROM entries e
        JOIN (SELECT dim, avg(x) AS m, stddev_pop(x) AS d FROM entries WHERE {where} GROUP BY dim) s USING (dim)"""


ORACLES = {
    "moments_merge": T.with_views(
        """SELECT CAST(a.dim AS BIGINT) AS dim_i, CAST(b.dim AS BIGINT) AS dim_j, count(*) AS n, round(avg(a.x), 6) + 0.0 AS mean,
                  round(covar_pop(a.x, b.x), 6) + 0.0 AS covariance
           FROM entries a JOIN entries b USING (item_id) GROUP BY a.dim, b.dim""",
        "items", extra={"entries": _ENTRIES},
    ),
    "standardise_new": T.with_views(
        "SELECT item_id, CAST(dim AS BIGINT) AS dim, round(z, 6) + 0.0 AS z FROM scaled", "items", extra={"entries": _ENTRIES, "scaled": _scaled_sql(FIRST)}
    ),
    "pca_invariants": T.with_views(
        """SELECT (SELECT count(*) FROM items) AS n, round(CAST(count(*) AS DOUBLE), 6) AS trace, round(CAST(count(*) AS DOUBLE), 6) AS variances,
                  round(sum(v), 6) AS projected, CAST(0 AS DOUBLE) AS departure, CAST(0 AS DOUBLE) AS residual
           FROM (SELECT dim, var_pop(z) AS v FROM scaled WHERE d > 0 GROUP BY dim)""",
        "items", extra={"entries": _ENTRIES, "scaled": _scaled_sql("true")},
    ),
    "catalogue_products": T.with_views(
        """SELECT a.item_id, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS product FROM rows_ a JOIN rows_ b ON b.item_id = a.item_id + 1""",
        "items", extra={"entries": _ENTRIES, "scaled": _scaled_sql("true"), "rows_": "SELECT item_id, list(z ORDER BY dim) AS v FROM scaled GROUP BY item_id"},
    ),
    "project_2d_distances": T.with_views(
        """SELECT a.user_id, a.slot AS slot_a, b.slot AS slot_b, round(list_distance(i.embedding::DOUBLE[], j.embedding::DOUBLE[]), 4) AS distance
           FROM fold_slots a JOIN fold_slots b ON a.user_id = b.user_id AND a.slot < b.slot
           JOIN items i ON i.item_id = a.item_id JOIN items j ON j.item_id = b.item_id""",
        "items", "reactions", extra=fold_ctes(SMALL),
    ),
    "standardise_fit": """SELECT CAST(i - 1 AS BIGINT) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
        FROM (SELECT unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY i""",
    "catalogue_build": T.with_views(
        f"SELECT item_id, category, CAST({N_COMPONENTS} AS BIGINT) AS dim, CAST(1.0 AS DOUBLE) AS norm FROM items", "items"
    ),
    "cosine_similarity": T.with_views(
        """SELECT p.user_id, p.slot, round(list_cosine_similarity(q.query::DOUBLE[], p.embedding::DOUBLE[]), 6) AS cosine
           FROM sql_profile p JOIN lq q USING (user_id)""",
        "sql_profile", extra={"lq": LIKED_QUERIES_SQL},
    ),
    "l2_normalise": "SELECT doc_id, CAST(1.0 AS DOUBLE) AS norm, round(sum, 6) AS sum FROM (SELECT doc_id, sum(w) AS sum FROM ("
    + """SELECT doc_id, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS w FROM (
            SELECT doc_id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS tf FROM (
              SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM documents)
            WHERE length(t) > 0 GROUP BY ALL)) GROUP BY doc_id)""",
    "map_points": T.with_views(
        """SELECT user_id, slot, round(preference, 6) AS preference, round(preference - mn + 1.0, 6) AS size_value,
                  round(CASE WHEN (mx - mn + 0.1) = (mn - mn + 0.1) THEN 275.0
                             ELSE 50.0 + ((preference - mn + 0.1) - (mn - mn + 0.1)) / ((mx - mn + 0.1) - (mn - mn + 0.1)) * 450.0 END, 6)
                        AS point_size,
                  round(CASE WHEN nmx = nmn THEN 0.5 ELSE (rewards_received - nmn) / (nmx - nmn) END, 6) AS color,
                  rewards_received
           FROM (SELECT *, min(preference) OVER w AS mn, max(preference) OVER w AS mx,
                        min(rewards_received) OVER w AS nmn, max(rewards_received) OVER w AS nmx
                 FROM sql_profile WINDOW w AS (PARTITION BY user_id))""",
        "sql_profile",
    ),
    "map_legend": T.with_views(
        f"""SELECT user_id, round(CASE WHEN mn <> mx THEN mn END, 6) AS legend_min,
                   round(CASE WHEN mn <> mx THEN (mn + mx) / 2 END, 6) AS legend_mid,
                   round(CASE WHEN mn <> mx THEN mx END, 6) AS legend_max,
                   n AS total_embeddings, CAST({PP.DEFAULT.gamma} AS DOUBLE) AS similarity_threshold,
                   CAST({PP.DEFAULT.min_samples} AS BIGINT) AS min_samples
            FROM (SELECT user_id, min(preference) AS mn, max(preference) AS mx, count(*) AS n FROM sql_profile GROUP BY user_id)""",
        "sql_profile",
    ),
}

QUERIES = {
    "moments_merge": q_moments_merge,
    "standardise_new": q_standardise_new,
    "pca_invariants": q_pca_invariants,
    "catalogue_products": q_catalogue_products,
    "project_2d_distances": q_project_2d_distances,
    "standardise_fit": q_standardise_fit,
    "catalogue_build": q_catalogue_build,
    "pca_fit": q_pca_fit,
    "cosine_similarity": q_cosine_similarity,
    "l2_normalise": q_l2_normalise,
    "project_2d": q_project_2d,
    "map_table": q_map_table,
    "map_points": q_map_points,
    "map_legend": q_map_legend,
}
