"""Registered preparation queries (A1-A13) and their DuckDB oracles.

Round trips write to the shared scratch folder (``spark.checkpoint.dir``) and
read the files back, so the sinks and sources are checked on the real tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from prefspark.functions import vectors as V
from prefspark.functions.draws import sql_uniform
from prefspark.operators import evaluate as EV
from prefspark.plans import evaluation as EP
from prefspark.plans.common import rnd
from prefspark.session import scratch_path
from prefspark.sources import ingest as I
from prefspark.sources import tables as T

EMBED_DIM = 64
DIM = 64  # of the catalogue's vectors
SEED = 42


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents_as_corpus(T.table(spark, sf, "documents"))


def q_corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A1 (table form): keyed, validated documents."""
    return corpus(spark, sf).select("doc_id", "item_key", "category", F.char_length("text").cast("long").alias("n_chars"))


def q_embed_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """A2: hashing encoder over whole texts, sparse long form."""
    return I.hashing_embed(corpus(spark, sf), EMBED_DIM).select("doc_id", "bucket", rnd("weight").alias("weight"))


def q_category_from_path(spark: SparkSession, sf: str) -> DataFrame:
    """The file-name category of every corpus key (last extension stripped)."""
    return corpus(spark, sf).select("doc_id", I.category_from_path(F.col("item_key")).alias("file_category"))


_ITEM_CSV_SCHEMA = Ty.StructType([
    Ty.StructField("item_id", Ty.LongType()), Ty.StructField("item_key", Ty.StringType()),
    Ty.StructField("category", Ty.StringType()), Ty.StructField("embedding", Ty.StringType()),
])


def q_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A3 + A4 + A10: items to quoted CSV, typed read back, vectors parsed strictly."""
    path = scratch_path(spark, "items-csv")
    I.write_item_csv(T.items(spark, sf), path)
    back = I.read_item_csv(spark, path, _ITEM_CSV_SCHEMA)
    good, _bad = I.split_valid_vectors(back, "embedding")
    return good.select(
        "item_id", "item_key", "category", F.size("embedding").cast("long").alias("dim"), rnd(V.norm("embedding")).alias("norm")
    )


def q_csv_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """A10: items whose CSV has rows and vectors of every fault, read back: the reason of each row, null for the good ones."""
    i, head = F.col("item_id"), F.slice("embedding", 1, DIM - 1).cast("array<string>")
    vector = (
        F.when(i % 11 == 3, F.lit("no vector")).when(i % 11 == 5, F.to_json(F.slice("embedding", 1, DIM - 1)))
        .when(i % 11 == 7, F.concat(F.lit("["), F.array_join(head, ","), F.lit(",null]")))
        .when(i % 11 == 9, F.concat(F.lit("["), F.array_join(head, ","), F.lit(",NaN]"))).otherwise(F.to_json("embedding"))
    )
    faulty = T.items(spark, sf).select(
        F.when(i % 13 == 1, F.concat(F.lit("x"), i)).otherwise(i.cast("string")).alias("item_id"), "item_key", "category", vector.alias("embedding")
    )
    path = scratch_path(spark, "faulty-csv")
    faulty.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    good, bad = I.read_quarantined(spark, path, _ITEM_CSV_SCHEMA, "embedding", DIM)
    return good.select("item_key", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("item_key", "reason"))


def q_input_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status and rows of every input table, one that isn't there, and one without a required column."""
    root = sf.rstrip("/")
    inputs = {t: (f"{root}/{t}.parquet", ()) for t in T.TABLES} | {"absent": (f"{root}/absent.parquet", ()), "untitled": (f"{root}/documents.parquet", ("doc_id", "title"))}
    return I.input_status(spark, inputs)


def q_csv_union_strings(spark: SparkSession, sf: str) -> DataFrame:
    """A5 + A7: two CSV files with different column sets, read as strings, aligned by name."""
    items = T.items(spark, sf)
    low = F.col("category").isin(*[f"c{i}" for i in range(5)])
    a, b = scratch_path(spark, "csv-a"), scratch_path(spark, "csv-b")
    I.write_item_csv(items.where(low).select("item_id", "item_key", "category", "embedding"), a)
    I.write_item_csv(items.where(~low).select("embedding", "category", "item_id"), b)
    cols = ["item_id", "item_key", "category", "embedding"]
    out = I.read_csv_strings(spark, [a, b], cols)
    vec = I.parse_vector(F.col("embedding"))
    return out.select("item_id", "item_key", "category", F.size(vec).cast("long").alias("dim"), rnd(V.norm(vec)).alias("norm"))


def q_seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed permutation of the catalogue."""
    return I.seeded_shuffle(T.items(spark, sf).select("item_id"), "item_id", SEED)


def q_assign_item_id(spark: SparkSession, sf: str) -> DataFrame:
    """Dense positions of the documents in (source, doc_id) order."""
    docs = T.table(spark, sf, "documents").select("doc_id", "source")
    return I.assign_positions(docs, [F.col("source"), F.col("doc_id")], "item_id").select("doc_id", "item_id")


def q_item_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents keyed by source: the last document wins."""
    docs = T.table(spark, sf, "documents").select(F.col("source").alias("item_key"), F.col("doc_id").alias("item_id"), F.col("lang"))
    return I.item_key_lookup(docs, "item_key", "lang", "item_id")


def q_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Sweep results to JSON and back (MAP and STRUCT kept), then flattened."""
    path = scratch_path(spark, "results-json")
    I.write_results_json(EP.sweep(spark, sf, EP.GRID), path)
    flat = EV.flatten_results(I.read_results_json(spark, path))
    return flat.select(*[rnd(c).alias(c) if c in ("avg_reward", "reward_std", "preference_alignment", "diversity_score") else c
                         for c in EP._FLAT_COLS])


# ---------------------------------------------------------------------------

_KEY = "source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang || '.txt'"

ORACLES = {
    "csv_quarantine": T.with_views(
        """SELECT item_key, CASE WHEN item_id % 13 = 1 THEN 'malformed row' WHEN item_id % 11 = 3 THEN 'malformed vector'
                  WHEN item_id % 11 = 5 THEN 'wrong length' WHEN item_id % 11 = 7 THEN 'null element'
                  WHEN item_id % 11 = 9 THEN 'non-finite element' END AS reason FROM items""",
        "items",
    ),
    "input_status": " UNION ALL ".join(f"SELECT '{t}' AS name, 'ok' AS status, count(*) AS n_rows FROM {t}" for t in T.TABLES)
    + " UNION ALL SELECT 'absent', 'missing', NULL UNION ALL SELECT 'untitled', 'no column title', count(*) FROM documents",
    "corpus_scan": f"SELECT doc_id, {_KEY} AS item_key, source AS category, CAST(length(text) AS BIGINT) AS n_chars FROM documents",
    "embed_corpus": f"""WITH tok AS (
            SELECT doc_id, t AS token FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{I.TOKEN_SPLIT}')) AS t
                                            FROM documents) WHERE length(t) > 0),
          c AS (SELECT doc_id, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % {EMBED_DIM} AS bucket, count(*) AS tf
                FROM tok GROUP BY ALL)
        SELECT doc_id, bucket, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""",
    "category_from_path": f"""SELECT doc_id, regexp_replace(regexp_extract({_KEY}, '([^/]*)$', 1), '^(\\.*[^.].*)\\.[^.]*$', '\\1') AS file_category
        FROM documents""",
    "csv_round_trip": T.with_views(
        """SELECT item_id, item_key, category, CAST(len(embedding) AS BIGINT) AS dim,
                  round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM items""",
        "items",
    ),
    "csv_union_strings": T.with_views(
        """SELECT CAST(item_id AS VARCHAR) AS item_id,
                  CASE WHEN category IN ('c0','c1','c2','c3','c4') THEN item_key ELSE '' END AS item_key,
                  category, CAST(len(embedding) AS BIGINT) AS dim,
                  round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM items""",
        "items",
    ),
    "seeded_shuffle": f"""SELECT item_id, row_number() OVER (ORDER BY {sql_uniform(str(SEED), 'item_id', "'shuffle'")}, item_id) - 1 AS position
        FROM (SELECT vec_id AS item_id FROM embeddings)""",
    "assign_item_id": "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS item_id FROM documents",
    "item_key_lookup": """SELECT source AS item_key, max(doc_id) AS item_id, arg_max(lang, doc_id) AS lang,
        count(*) AS n_duplicates FROM documents GROUP BY source""",
    "json_round_trip": EP.ORACLES["flatten_results"],
}

QUERIES = {
    "corpus_scan": q_corpus_scan,
    "embed_corpus": q_embed_corpus,
    "category_from_path": q_category_from_path,
    "csv_round_trip": q_csv_round_trip,
    "csv_quarantine": q_csv_quarantine,
    "input_status": q_input_status,
    "csv_union_strings": q_csv_union_strings,
    "seeded_shuffle": q_seeded_shuffle,
    "assign_item_id": q_assign_item_id,
    "item_key_lookup": q_item_key_lookup,
    "json_round_trip": q_json_round_trip,
}
