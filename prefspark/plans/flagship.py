"""Flagship: fold every user's reactions into a profile, then recommend for all users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefspark.operators import recommend as R
from prefspark.plans import profiles as PP
from prefspark.plans import recommendation as RP
from prefspark.plans.foldsql import fold_ctes
from prefspark.plans.retrieval import K_CANDIDATES, sql_knn_unseen_ctes
from prefspark.session import materialize
from prefspark.sources import tables as T


def recommend_from_fold(spark: SparkSession, sf: str) -> DataFrame:
    """E5 over the real D8 snapshot (recommender defaults): one row per user."""
    # The snapshot is written once to the shared folder; recommendation reads it
    # (it is used by several branches of the plan and must not be re-folded).
    snap = materialize(PP.folded(spark, sf, PP.DEFAULT), "profile-snapshot")
    rec = R.recommend_batch(
        RP.users(spark, sf), snap, T.items(spark, sf), T.seen(spark, sf), T.n_items(spark, sf),
        RP.catalogue_dim(spark, sf), PP.DEFAULT.beta, RP.EXP_RATE, RP.SEED, RP.STEP, K_CANDIDATES,
    )
    return rec.select("user_id", "mode", "slot", "item_id", "fallback")


# The same recommendation as over the derived profile, over the slots of the recursive fold.
_CTES = fold_ctes(PP.DEFAULT) | {"fold_profile": "SELECT s.*, i.embedding FROM fold_slots s JOIN items i USING (item_id)"}
_CTES |= {name: RP._CTES[name].replace("sql_profile", "fold_profile") for name in RP._REC_CTES}

ORACLES = {"recommend_from_fold": T.with_views(RP._REC_BODY, "items", "reactions", "seen", extra=_CTES | sql_knn_unseen_ctes("qv"))}

QUERIES = {"recommend_from_fold": recommend_from_fold}
