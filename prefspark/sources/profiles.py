"""Category preference profiles given as configuration.

``preferences_from_dict`` turns ``{profile: {category: p}}`` into the
``preferences(profile, category, p)`` table every evaluation operator reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# How probable it is that each of the evaluation's four profiles likes an item of a category.
NEWSGROUP_PROFILES = {
    "computer_science": {
        "alt-atheism": 0.05,
        "comp-graphics": 0.8,
        "comp-os-ms-windows-misc": 0.8,
        "comp-sys-ibm-pc-hardware": 0.8,
        "comp-sys-mac-hardware": 0.9,
        "comp-windows-x": 0.8,
        "misc-forsale": 0.2,
        "rec-autos": 0.2,
        "rec-motorcycles": 0.2,
        "rec-sport-baseball": 0.2,
        "rec-sport-hockey": 0.2,
        "sci-crypt": 0.6,
        "sci-electronics": 0.5,
        "sci-med": 0.45,
        "sci-space": 0.5,
        "soc-religion-christian": 0.1,
        "talk-politics-guns": 0.15,
        "talk-politics-mideast": 0.1,
        "talk-politics-misc": 0.2,
        "talk-religion-misc": 0.1,
    },
    "sports": {
        "alt-atheism": 0.05,
        "comp-graphics": 0.1,
        "comp-os-ms-windows-misc": 0.15,
        "comp-sys-ibm-pc-hardware": 0.2,
        "comp-sys-mac-hardware": 0.2,
        "comp-windows-x": 0.1,
        "misc-forsale": 0.3,
        "rec-autos": 0.4,
        "rec-motorcycles": 0.5,
        "rec-sport-baseball": 0.8,
        "rec-sport-hockey": 0.9,
        "sci-crypt": 0.2,
        "sci-electronics": 0.1,
        "sci-med": 0.05,
        "sci-space": 0.1,
        "soc-religion-christian": 0.05,
        "talk-politics-guns": 0.3,
        "talk-politics-mideast": 0.1,
        "talk-politics-misc": 0.1,
        "talk-religion-misc": 0.05,
    },
    "religion": {
        "alt-atheism": 0.8,
        "comp-graphics": 0.1,
        "comp-os-ms-windows-misc": 0.15,
        "comp-sys-ibm-pc-hardware": 0.2,
        "comp-sys-mac-hardware": 0.2,
        "comp-windows-x": 0.1,
        "misc-forsale": 0.2,
        "rec-autos": 0.1,
        "rec-motorcycles": 0.1,
        "rec-sport-baseball": 0.2,
        "rec-sport-hockey": 0.1,
        "sci-crypt": 0.2,
        "sci-electronics": 0.1,
        "sci-med": 0.05,
        "sci-space": 0.1,
        "soc-religion-christian": 0.8,
        "talk-politics-guns": 0.3,
        "talk-politics-mideast": 0.6,
        "talk-politics-misc": 0.3,
        "talk-religion-misc": 0.9,
    },
    "balanced": {
        "alt-atheism": 0.5,
        "comp-graphics": 0.5,
        "comp-os-ms-windows-misc": 0.5,
        "comp-sys-ibm-pc-hardware": 0.5,
        "comp-sys-mac-hardware": 0.5,
        "comp-windows-x": 0.5,
        "misc-forsale": 0.5,
        "rec-autos": 0.5,
        "rec-motorcycles": 0.5,
        "rec-sport-baseball": 0.5,
        "rec-sport-hockey": 0.5,
        "sci-crypt": 0.5,
        "sci-electronics": 0.5,
        "sci-med": 0.5,
        "sci-space": 0.5,
        "soc-religion-christian": 0.5,
        "talk-politics-guns": 0.5,
        "talk-politics-mideast": 0.5,
        "talk-politics-misc": 0.5,
        "talk-religion-misc": 0.5,
    },
}


def preferences_from_dict(spark: SparkSession, profiles: dict[str, dict[str, float]]) -> DataFrame:
    """``{profile: {category: p}}`` as a small (configuration-sized) table."""
    rows = [(prof, cat, float(p)) for prof, cats in profiles.items() for cat, p in cats.items()]
    return spark.createDataFrame(rows, "profile string, category string, p double")


def preferences_sql(profiles: dict[str, dict[str, float]]) -> str:
    """The same table as SQL ``VALUES`` (for oracles)."""
    vals = ", ".join(f"('{prof}', '{cat}', CAST({p!r} AS DOUBLE))" for prof, cats in profiles.items() for cat, p in cats.items())
    return f"SELECT * FROM (VALUES {vals}) t(profile, category, p)"
