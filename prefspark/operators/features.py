"""Catalogue build (B2-B7) with Spark ML.

Standardise -> exact PCA -> L2 normalise as one ``Pipeline``.  The fits are
distributed aggregates (column summaries, the Gramian by tree aggregation);
only the d x d eigenproblem runs on the driver, and d is the embedding width.
Spark ML's scaler uses the sample standard deviation where the reference uses
the population one; that is one common factor for every dimension and the final
normalisation removes it, so the catalogue is the same.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.session import ship_package


def standardise_fit(items: DataFrame, col: str = "embedding") -> DataFrame:
    """B2 fit: per-dimension mean and population std, one row per dimension.

    ``scale`` is the std, or 1 for a constant dimension (as the reference's scaler).
    """
    v = items.select(array_to_vector(F.col(col)).alias("v"))
    s = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*")
    arrs = s.select(
        vector_to_array("mean").alias("mean"), vector_to_array("variance").alias("var"), F.col("count").alias("n")
    )
    # Spark reports the sample variance; the population variance is (n - 1) / n of it.
    z = arrs.select(F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "mv"), "n")
    pop_std = F.sqrt(F.greatest(F.col("mv.var") * (F.col("n") - 1) / F.col("n"), F.lit(0.0)))
    return z.select(
        F.col("dim").cast("long").alias("dim"), F.col("mv.mean").alias("mean"), pop_std.alias("std"),
        F.when(pop_std == 0, F.lit(1.0)).otherwise(pop_std).alias("scale"),
    )


def catalogue_pipeline(k: int) -> Pipeline:
    """Standardise, reduce to ``k`` components, normalise to unit length."""
    return Pipeline(stages=[
        StandardScaler(inputCol="_v", outputCol="_std", withMean=True, withStd=True),
        PCA(k=k, inputCol="_std", outputCol="_pca"),
        Normalizer(inputCol="_pca", outputCol="_unit", p=2.0),
    ])


def fit_catalogue(items: DataFrame, k: int, col: str = "embedding") -> PipelineModel:
    """B2 + B3: fit the scaler and the exact PCA (``k <= min(n, d)``)."""
    return catalogue_pipeline(k).fit(items.select(array_to_vector(F.col(col)).alias("_v")))


def transform_catalogue(model: PipelineModel, items: DataFrame, col: str = "embedding") -> DataFrame:
    """B4 + B5: project (the scaler has centred the data already) and normalise; float vectors out."""
    keep = [c for c in items.columns if c != col]
    out = model.transform(items.select(*keep, array_to_vector(F.col(col)).alias("_v")))
    return out.select(*keep, vector_to_array("_unit", "float32").alias(col))


def catalogue_build(items: DataFrame, k: int, col: str = "embedding") -> tuple[DataFrame, PipelineModel]:
    """The reduced unit-length catalogue and its fitted model (write both as Parquet)."""
    model = fit_catalogue(items, k, col)
    return transform_catalogue(model, items, col), model


def pca_components(model: PipelineModel) -> np.ndarray:
    """The fitted principal axes as a ``d x k`` matrix (small, model-sized)."""
    return model.stages[1].pc.toArray()


# ---------------------------------------------------------------------------
# Per-user 2-D projection of profile slots
# ---------------------------------------------------------------------------

def _project_fn(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("slot")
    X = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    xy = np.zeros((len(X), 2))
    if len(X) > 1:
        C = X - X.mean(axis=0)
        _, _, vt = np.linalg.svd(C, full_matrices=False)
        comps = vt[:2]
        # Sign convention: the largest-magnitude loading of each axis is positive.
        signs = np.sign(comps[np.arange(len(comps)), np.argmax(np.abs(comps), axis=1)])
        signs[signs == 0] = 1.0
        proj = C @ (comps * signs[:, None]).T
        xy[:, : proj.shape[1]] = proj
    return pd.DataFrame({"user_id": pdf["user_id"].to_numpy(), "slot": pdf["slot"].to_numpy(), "x": xy[:, 0], "y": xy[:, 1]})


def project_2d(profile: DataFrame) -> DataFrame:
    """Centred PCA of each user's slots to 2-D; one slot maps to (0, 0).

    Groups are one user's profile, bounded by ``max_embeddings + 1`` slots.
    """
    ship_package(profile.sparkSession)
    return profile.select("user_id", "slot", "embedding").groupBy("user_id").applyInPandas(
        _project_fn, "user_id long, slot long, x double, y double"
    )
