"""Plot-ready map tables of a profile (B8-B10); drawing itself is not built.

All columns are window expressions over one user's slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_POINT_SIZE = 50.0
MAX_POINT_SIZE = 500.0


def map_points(profile: DataFrame, min_size: float = MIN_POINT_SIZE, max_size: float = MAX_POINT_SIZE) -> DataFrame:
    """B8 + B9 + B10: per slot: preference, shifted size value, point size and colour.

    Size: preferences shifted by ``min - 0.1`` and min-max scaled into
    ``[min_size, max_size]``, the midpoint when all are equal.  Colour: reward
    counts min-max scaled into [0, 1], 0.5 when all are equal.
    """
    w = Window.partitionBy("user_id")
    pmin, pmax = F.min("preference").over(w), F.max("preference").over(w)
    shifted = F.col("preference") - pmin + F.lit(0.1)
    smin, smax = pmin - pmin + F.lit(0.1), pmax - pmin + F.lit(0.1)
    size = F.when(smax == smin, F.lit((min_size + max_size) / 2)).otherwise(
        F.lit(min_size) + (shifted - smin) / (smax - smin) * F.lit(max_size - min_size)
    )
    nmin, nmax = F.min("rewards_received").over(w), F.max("rewards_received").over(w)
    color = F.when(nmax == nmin, F.lit(0.5)).otherwise((F.col("rewards_received") - nmin) / (nmax - nmin))
    return profile.select(
        "user_id", "slot", "preference", (F.col("preference") - pmin + F.lit(1.0)).alias("size_value"),
        size.alias("point_size"), color.alias("color"), "rewards_received",
    )


def map_legend(profile: DataFrame, gamma: float, min_samples: int) -> DataFrame:
    """B10 summary per user: min/mid/max preference (legend only when they differ),
    slot count, similarity threshold and min samples (the info box)."""
    g = profile.groupBy("user_id").agg(
        F.min("preference").alias("min_pref"), F.max("preference").alias("max_pref"), F.count(F.lit(1)).alias("total_embeddings")
    )
    differ = F.col("min_pref") != F.col("max_pref")
    return g.select(
        "user_id",
        F.when(differ, F.col("min_pref")).alias("legend_min"),
        F.when(differ, (F.col("min_pref") + F.col("max_pref")) / 2).alias("legend_mid"),
        F.when(differ, F.col("max_pref")).alias("legend_max"),
        "total_embeddings",
        F.lit(float(gamma)).alias("similarity_threshold"),
        F.lit(int(min_samples)).cast("long").alias("min_samples"),
    )
