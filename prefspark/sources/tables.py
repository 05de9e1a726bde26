"""Driver tables and the derived tables every operator reads.

Each derived table has a Spark form (a lazy DataFrame over the Parquet scan, so
filters and column pruning reach the scan) and the same definition as DuckDB SQL
text (``SQL_VIEWS``), which the oracle queries prepend as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.session import ship_package

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values (design, FIXTURES.md section 3): reward per event type.
REWARD_BY_EVENT = {"purchase": 10.0, "click": 5.0, "view": 1.0, "signup": 0.0, "error": -10.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)  # the plans built on these tables may run this package's code in Python workers
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reward_expr(event_type_col: str = "event_type"):
    c = F.col(event_type_col)
    expr = None
    for k, v in REWARD_BY_EVENT.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(F.lit(0.0))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue: dense ``item_id`` 0..n-1, string key, category, unit float vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("vec_id").cast("string").alias("item_key"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
        F.col("embedding"),
    )


def n_items(spark: SparkSession, sf_dir: str):
    """Catalogue size as a scalar subquery column (no driver round trip)."""
    return table(spark, sf_dir, "embeddings").select(F.count(F.lit(1))).scalar()


def liked_event_types() -> list[str]:
    """Event types with a positive reward (a raw-column predicate Parquet can apply)."""
    return [k for k, v in REWARD_BY_EVENT.items() if v > 0]


def reactions(spark: SparkSession, sf_dir: str, liked_only: bool = False) -> DataFrame:
    """Logged reactions: each event maps to item ``event_id % n_items``.

    ``liked_only`` keeps positive rewards with a filter on ``event_type`` itself, so
    it is pushed into the Parquet scan.
    """
    ev = table(spark, sf_dir, "events")
    if liked_only:
        ev = ev.where(F.col("event_type").isin(*liked_event_types()))
    return ev.select(
        "user_id",
        "ts",
        "event_id",
        (F.col("event_id") % n_items(spark, sf_dir)).alias("item_id"),
        reward_expr().alias("reward"),
    )


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactions(spark, sf_dir).select("user_id", "item_id").distinct()


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category preference profiles over the catalogue's categories.

    ``focused``: 0.9 for c0-c2, else 0.1; ``balanced``: 0.5 (FIXTURES.md section 3).
    """
    cats = items(spark, sf_dir).select("category").distinct()
    focused = cats.select(
        F.lit("focused").alias("profile"),
        "category",
        F.when(F.col("category").isin("c0", "c1", "c2"), F.lit(0.9)).otherwise(F.lit(0.1)).alias("p"),
    )
    balanced = cats.select(F.lit("balanced").alias("profile"), "category", F.lit(0.5).alias("p"))
    return focused.unionByName(balanced)


def sql_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile derivable in SQL: one slot per distinct (user, item), first-seen order.

    Columns: user_id, slot, item_id, embedding, preference, rewards_received,
    total_rewards, reward_average.  Input for every oracle-checked operator that
    reads a profile; in normal use the fold snapshot takes its place.
    """
    from prefspark.operators.scan import ordered_scan

    r = reactions(spark, sf_dir)
    per_item = r.groupBy("user_id", "item_id").agg(
        F.min(F.struct("ts", "event_id")).alias("first"),
        F.count(F.lit(1)).alias("rewards_received"),
        (F.avg("reward") / 10.0).alias("preference"),
    ).select("user_id", "item_id", "rewards_received", "preference",
             F.col("first.ts").alias("first_ts"), F.col("first.event_id").alias("first_event"))
    # Slot = first-seen order of the user's items: a distributed ordered scan, so a user
    # who has reacted to a large part of the catalogue is not one window task.
    slots = ordered_scan(per_item, "user_id", ["first_ts", "first_event"])
    stats = r.groupBy("user_id").agg(F.avg("reward").alias("reward_average"), F.count(F.lit(1)).alias("total_rewards"))
    vecs = items(spark, sf_dir).select("item_id", "embedding")
    return slots.join(stats, "user_id").join(vecs, "item_id").select(
        "user_id", F.col("position").alias("slot"), "item_id", "embedding", "preference", "rewards_received",
        "total_rewards", "reward_average",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("category"), "text"
    )


# ---------------------------------------------------------------------------
# The same tables as DuckDB SQL (views are pre-registered under TABLES names).
# ---------------------------------------------------------------------------

_REWARD_SQL = "CAST(CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in REWARD_BY_EVENT.items()
) + " ELSE 0.0 END AS DOUBLE)"  # DOUBLE like Spark (a bare 10.0 is DECIMAL in DuckDB)

SQL_VIEWS = {
    "items": """SELECT vec_id AS item_id, CAST(vec_id AS VARCHAR) AS item_key,
        'c' || CAST(label AS VARCHAR) AS category, embedding FROM embeddings""",
    "reactions": f"""SELECT user_id, ts, event_id,
        event_id % (SELECT count(*) FROM embeddings) AS item_id, {_REWARD_SQL} AS reward FROM events""",
    "seen": "SELECT DISTINCT user_id, item_id FROM reactions",
    "preferences": """SELECT 'focused' AS profile, category,
            CAST(CASE WHEN category IN ('c0','c1','c2') THEN 0.9 ELSE 0.1 END AS DOUBLE) AS p
        FROM (SELECT DISTINCT category FROM items)
        UNION ALL SELECT 'balanced', category, CAST(0.5 AS DOUBLE) FROM (SELECT DISTINCT category FROM items)""",
    "sql_profile": """SELECT p.user_id, p.slot, p.item_id, i.embedding, p.preference, p.rewards_received,
            p.total_rewards, s.reward_average
        FROM (SELECT user_id, item_id,
                CAST(row_number() OVER (PARTITION BY user_id ORDER BY min_ts, min_eid) - 1 AS BIGINT) AS slot,
                rewards_received, preference,
                CAST(sum(rewards_received) OVER (PARTITION BY user_id) AS BIGINT) AS total_rewards
              FROM (SELECT user_id, item_id, min(ts) AS min_ts,
                        arg_min(event_id, (ts, event_id)) AS min_eid,
                        count(*) AS rewards_received, avg(reward) / 10.0 AS preference
                    FROM reactions GROUP BY user_id, item_id)) p
        JOIN (SELECT user_id, avg(reward) AS reward_average FROM reactions GROUP BY user_id) s USING (user_id)
        JOIN items i USING (item_id)""",
    "corpus": "SELECT doc_id AS item_id, source AS category, text FROM documents",
}

_DEPENDS = {
    "items": [],
    "reactions": [],
    "seen": ["reactions"],
    "preferences": ["items"],
    "sql_profile": ["reactions", "items"],
    "corpus": [],
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with CTEs for the named derived tables (and what they need),
    followed by the query's own ``extra`` CTEs in the given order."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    if not parts:
        return body
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
