"""Shared query inputs: the query vectors every retrieval query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.sources import tables as T

ROUND = 6


def liked_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest liked reaction (reward > 0) and that item's vector as query."""
    r = T.reactions(spark, sf_dir, liked_only=True)
    latest = r.groupBy("user_id").agg(F.max_by("item_id", F.struct("ts", "event_id")).alias("query_item"))
    vecs = T.items(spark, sf_dir).select(F.col("item_id").alias("query_item"), F.col("embedding").alias("query"))
    return latest.join(vecs, "query_item")


LIKED_QUERIES_SQL = """SELECT q.user_id, q.query_item, i.embedding AS query FROM (
    SELECT user_id, item_id AS query_item FROM (
      SELECT user_id, item_id,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM reactions WHERE reward > 0) WHERE rn = 1) q
  JOIN items i ON i.item_id = q.query_item"""


def rnd(col, digits: int = ROUND):
    return F.round(F.col(col) if isinstance(col, str) else col, digits)
