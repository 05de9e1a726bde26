"""Catalogue preparation (A1-A13): scans, encoders, sinks, ids.

Everything is a DataFrame job: a directory of text files is one ``binaryFile``
scan, the default encoder is token hashing in SQL, CSV/JSON go through Spark's
own sources and sinks, and dense ids come from a range-partitioned sort plus
per-partition offsets (no single-partition window).
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from prefspark.functions import draws
from prefspark.session import materialize, ship_package

VECTOR_TYPE = "array<float>"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


# -- A1 -----------------------------------------------------------------------

def scan_text_files(spark: SparkSession, root: str, keep_content: bool = False) -> DataFrame:
    """A1: every file under ``root`` as ``(item_key, text)``; bad UTF-8 bytes become U+FFFD.

    ``item_key`` is the path relative to ``root``.
    """
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    qualified = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hp).toString().rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.col("path").substr(F.lit(len(qualified) + 2), F.lit(1 << 30))
    if keep_content:
        return df.select(rel.alias("item_key"), "content")
    return df.select(rel.alias("item_key"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def documents_as_corpus(documents: DataFrame) -> DataFrame:
    """A1 table form: ``documents`` with a path-like key and validated text."""
    key = F.concat_ws("/", F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"), F.lit(".txt")))
    return documents.select(
        "doc_id", key.alias("item_key"), F.col("source").alias("category"), F.make_valid_utf8(F.col("text")).alias("text")
    )


# -- A2 -----------------------------------------------------------------------

def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: F.length(t) > 0)


def token_bucket(token: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(dim))


def hashing_embed(docs: DataFrame, dim: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A2 default encoder: token counts hashed into ``dim`` buckets, L2-normalised.

    Long form ``(id, bucket, weight)``. A text is one row, so its counts are array
    functions on that row: no shuffle, and the scan's columns go straight to the result.
    """
    buckets = docs.select(id_col, F.sort_array(F.transform(tokens(F.col(text_col)), lambda t: token_bucket(t, dim))).alias("all"))
    firsts = buckets.select(id_col, "all", F.array_distinct("all").alias("met"))
    firsts = firsts.select(id_col, "met", F.size("all").alias("n"), F.transform("met", lambda b: F.array_position("all", b)).alias("at"))
    ends = F.concat(F.slice("at", 2, dim), F.array((F.col("n") + 1).cast("long")))
    counts = firsts.select(id_col, "met", F.zip_with(ends, "at", lambda e, s: e - s).alias("tf"))
    squares = F.aggregate("tf", F.lit(0).cast("long"), lambda acc, x: acc + x * x)
    # Outer, then filtered: a filter on the arrays themselves would go below the projection and count twice.
    cells = counts.select(id_col, F.sqrt(squares).alias("_norm"), F.explode_outer(F.arrays_zip("met", "tf")).alias("_c"))
    return cells.where("_c.met is not null").select(id_col, F.col("_c.met").alias("bucket"), (F.col("_c.tf") / F.col("_norm")).alias("weight"))


def dense_vectors(sparse: DataFrame, dim: int, id_col: str = "doc_id", vector_type: str = VECTOR_TYPE, ids: DataFrame | None = None) -> DataFrame:
    """Long ``(id, bucket, weight)`` to one vector per id (zeros elsewhere); float32 at rest by default.

    ``ids`` names all ids: those without a row (texts without tokens) get the zero vector.
    """
    per = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_m"))
    if ids is not None:
        per = ids.select(id_col).distinct().join(per, id_col, "left")
    vec = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    return per.select(id_col, vec.cast(vector_type).alias("embedding"))


def embed_with(docs: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], dim: int,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A2 pluggable encoder: ``make_encoder()`` runs once per partition and encodes a batch of texts
    at a time; if that fails, each text of the batch by itself, and a failing document goes to
    the ``error`` column instead of stopping the job."""
    schema = Ty.StructType([
        Ty.StructField(id_col, Ty.LongType()),
        Ty.StructField("embedding", Ty.ArrayType(Ty.FloatType())),
        Ty.StructField("error", Ty.StringType()),
    ])

    def run(batches):
        enc = make_encoder()
        for pdf in batches:
            texts = pdf[text_col].tolist()
            try:
                whole = np.asarray(enc(texts), dtype=np.float32)
                if whole.shape != (len(texts), dim):
                    raise ValueError(f"encoder returned shape {whole.shape}")
                yield pd.DataFrame({id_col: pdf[id_col].astype("int64"), "embedding": list(whole), "error": [None] * len(texts)})
                continue
            except Exception:  # noqa: BLE001 - found out text by text below
                pass
            out_vec, out_err = [], []
            for t in texts:
                try:
                    v = np.asarray(enc([t])[0], dtype=np.float32)
                    if v.shape != (dim,):
                        raise ValueError(f"encoder returned shape {v.shape}")
                    out_vec.append(v)
                    out_err.append(None)
                except Exception as e:  # noqa: BLE001 - reported per document
                    out_vec.append(None)
                    out_err.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({id_col: pdf[id_col].astype("int64"), "embedding": out_vec, "error": out_err})

    ship_package(docs.sparkSession)
    return docs.select(id_col, text_col).mapInPandas(run, schema)


# -- A3, A4, A5, A7 -------------------------------------------------------------

def write_item_csv(items: DataFrame, path: str) -> None:
    """A3: every field quoted, header, vector as its JSON literal, standard ``""`` escaping."""
    out = items.select(*[F.to_json(F.col(c)).alias(c) if c == "embedding" else F.col(c).cast("string") for c in items.columns])
    (out.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path))


def read_item_csv(spark: SparkSession, path, schema: Ty.StructType, multi_line: bool = True) -> DataFrame:
    """A4: typed read with an explicit schema (never inference). Without ``multi_line`` (no field
    holds a line break) a large file is split over many tasks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


def data_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that paths stand for: a folder's own, but for names that begin with ``_`` or a dot."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        statuses = hp.getFileSystem(conf).listStatus(hp)
        out += sorted(s.getPath().toString() for s in statuses if s.isFile() and (not s.getPath().getName().startswith(("_", ".")) or len(statuses) == 1))
    return out


def csv_headers(spark: SparkSession, files: list[str], threads: int = 16) -> dict[tuple[str, ...], list[str]]:
    """Files by the column names of their first line (read alone, not the file). An empty file has no columns."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def header(path: str) -> tuple[str, ...]:
        hp = jvm.org.apache.hadoop.fs.Path(path)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(hp.getFileSystem(conf).open(hp), "UTF-8"))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        return tuple(next(csv.reader([line.removeprefix("\ufeff")]), ())) if line else ()

    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(threads) as pool:
        for path, names in zip(files, pool.map(header, files), strict=True):
            found.setdefault(names, []).append(path)
    return found


def read_csv_strings(spark: SparkSession, paths: list[str], columns: list[str], multi_line: bool = True) -> DataFrame:
    """A5 + A7: every column as string, missing values as ``''``, files aligned by column name.

    Files with the same header are one scan, so thousands of files of a few layouts are a
    handful of scans; ``unionByName`` aligns columns that come in different orders or are
    missing in some layouts. A column that no file has is empty.
    """
    frames = []
    for header, files in csv_headers(spark, data_files(spark, paths)).items():
        if not header:
            continue
        schema = Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in header])
        read = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(files)
        frames.append(read.select(*[F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in columns]))
    if not frames:
        return spark.createDataFrame([], Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in columns]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.na.fill("")


# -- A6 -------------------------------------------------------------------------

def category_from_path(path: Column) -> Column:
    """File name without its *last* extension (``alt.atheism.csv`` -> ``alt.atheism``); dots that begin a name begin none."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"^(\.*[^.].*)\.[^.]*$", "$1")


def with_category_from_file(df: DataFrame) -> DataFrame:
    """A6 over a file scan: the category of every row is its file's name."""
    return df.select("*", category_from_path(F.col("_metadata.file_name")).alias("category"))


# -- A8 -------------------------------------------------------------------------

def validate_inputs(spark: SparkSession, paths: list[str], df: DataFrame | None = None, required: tuple[str, ...] = ()) -> None:
    """Fail early on a missing input or a missing required column (no action run)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if not hp.getFileSystem(conf).exists(hp):
            raise FileNotFoundError(f"File not found: {p}")
    if df is not None:
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise KeyError(f"Column(s) {missing} not found")


def input_status(spark: SparkSession, inputs: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """A8 as data: ``name, status, n_rows`` of Parquet inputs (name -> path, required columns).

    ``status`` is ``ok``, ``missing`` (no such path), ``unreadable``, or ``no column`` with the
    required ones that are not there; ``n_rows`` is null unless the input can be read.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    frames = []
    for name, (path, required) in inputs.items():
        hp = jvm.org.apache.hadoop.fs.Path(path)
        status, rows = "missing", None
        if hp.getFileSystem(conf).exists(hp):
            try:
                df = spark.read.parquet(path)
            except Exception:  # noqa: BLE001 - reported as data
                status = "unreadable"
            else:
                lost = sorted(set(required) - set(df.columns))
                status, rows = f"no column {', '.join(lost)}" if lost else "ok", df
        n = F.lit(None).cast("long") if rows is None else F.count(F.lit(1))
        frames.append((spark.range(1) if rows is None else rows).select(F.lit(name).alias("name"), F.lit(status).alias("status"), n.alias("n_rows")) if rows is None
                      else rows.agg(n.alias("n_rows")).select(F.lit(name).alias("name"), F.lit(status).alias("status"), "n_rows"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def text_file_status(spark: SparkSession, root: str, expected: DataFrame | None = None) -> DataFrame:
    """A1 and A8 for files: ``item_key, status`` with ``ok``, ``repaired`` (bytes that are no UTF-8) and, for keys
    of ``expected`` (item_key) without a file, ``missing``. A file of no bytes has no row in Spark's scan, so it is missing."""
    found = scan_text_files(spark, root, keep_content=True)
    repaired = ~F.is_valid_utf8(F.col("content").cast("string"))
    status = F.when(repaired, "repaired").otherwise("ok")
    found = found.select("item_key", status.alias("status"))
    if expected is None:
        return found
    lost = expected.select("item_key").distinct().join(found, "item_key", "left_anti")
    return found.unionByName(lost.select("item_key", F.lit("missing").alias("status")))


# -- A9, A12 -----------------------------------------------------------------------

def assign_positions(df: DataFrame, order: list[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Dense 0..n-1 positions in ``order`` (which must be total).

    Range partitioning + a sort inside each partition gives increasing
    ``monotonically_increasing_id`` values (partition index in the high bits); the
    per-partition row counts (one row per partition) give each partition's
    offset.  One shuffle, no single-partition window; the numbered rows are
    written to the shared folder once so the offsets and the rows agree.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Stored once: the ids are physical (partition index, row index), so both uses
    # below must read the same rows rather than two recomputations of the exchange.
    mid = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()), "positions")
    parts = mid.select((F.col("_mid") / F.lit(1 << 33)).cast("long").alias("_pid"), "_mid")
    counts = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select("_pid", (F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt")).alias("_off"))
    pos = mid.select("*", (F.col("_mid") / F.lit(1 << 33)).cast("long").alias("_pid")).join(F.broadcast(offsets), "_pid")
    return pos.select(
        *[c for c in df.columns], (F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    )


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A full permutation by keyed uniform, stable under repartitioning and retries."""
    u = draws.uniform(seed, F.col(key), "shuffle")
    return assign_positions(df.withColumn("_u", u), [F.col("_u"), F.col(key)]).drop("_u")


# -- A10 -------------------------------------------------------------------------

def parse_vector(text: Column) -> Column:
    """A10: a JSON list literal to ``array<float>``; anything else is NULL (quarantined)."""
    return F.from_json(text, VECTOR_TYPE)


def split_valid_vectors(df: DataFrame, col: str, dim: int | None = None):
    """A10: (parsed rows, quarantined rows); a wrong length counts as malformed."""
    parsed = df.withColumn("_vec", parse_vector(F.col(col)))
    ok = F.col("_vec").isNotNull() & ~F.exists("_vec", lambda x: x.isNull())
    if dim is not None:
        ok = ok & (F.size("_vec") == dim)
    good = parsed.where(ok).withColumn(col, F.col("_vec")).drop("_vec")
    bad = parsed.where(~ok | ok.isNull()).drop("_vec")
    return good, bad


def read_quarantined(spark: SparkSession, path, schema: Ty.StructType, col: str, dim: int, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """A4 + A10: a typed CSV read that keeps both sides: (rows with a valid vector, the others with ``reason`` and ``record``).

    Reasons: ``malformed row`` (a field that its type can't hold, too few or too many fields),
    ``malformed vector`` (no list of numbers, or none at all), ``wrong length``, ``null element``,
    ``non-finite element``. ``record`` is the text of a malformed row.
    """
    typed = Ty.StructType([*schema.fields, Ty.StructField("_record", Ty.StringType())])
    read = spark.read.schema(typed).option("header", True).option("multiLine", multi_line).option("escape", '"')
    rows = read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record").csv(path)
    rows = rows.withColumn("_vec", F.from_json(F.col(col), "array<double>"))
    finite = F.forall("_vec", lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    # Spark parses the columns that a plan needs only; a row is malformed by any of them, so all are needed.
    parsed = F.xxhash64(*schema.fieldNames()) >= F.lit(-(1 << 63))
    reason = (
        F.when(F.col("_record").isNotNull() & parsed, "malformed row").when(F.col("_vec").isNull(), "malformed vector")
        .when(F.exists("_vec", lambda x: x.isNull()), "null element").when(F.size("_vec") != dim, "wrong length").when(~finite, "non-finite element")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").withColumn(col, F.col("_vec").cast(VECTOR_TYPE)).drop("_vec", "_record", "reason")
    return good, rows.where("reason is not null").drop("_vec").withColumnRenamed("_record", "record")


# -- A11 -------------------------------------------------------------------------

def item_key_lookup(items: DataFrame, key: str = "item_key", value: str = "category", pos: str = "item_id") -> DataFrame:
    """Key -> (last position, its value); the last duplicate wins."""
    return items.groupBy(key).agg(
        F.max(pos).alias(pos), F.max_by(value, pos).alias(value), F.count(F.lit(1)).alias("n_duplicates")
    )


# -- A13 -------------------------------------------------------------------------

RESULT_SCHEMA = Ty.StructType([
    Ty.StructField("config_id", Ty.LongType()),
    Ty.StructField("params", Ty.StructType([
        Ty.StructField("alpha", Ty.DoubleType()), Ty.StructField("gamma", Ty.DoubleType()),
        Ty.StructField("beta", Ty.DoubleType()), Ty.StructField("max_embeddings", Ty.LongType()),
        Ty.StructField("exp_rate", Ty.DoubleType()), Ty.StructField("n_components", Ty.LongType()),
    ])),
    Ty.StructField("preference_type", Ty.StringType()),
    Ty.StructField("total_reward", Ty.DoubleType()),
    Ty.StructField("avg_reward", Ty.DoubleType()),
    Ty.StructField("reward_std", Ty.DoubleType()),
    Ty.StructField("preference_alignment", Ty.DoubleType()),
    Ty.StructField("diversity_score", Ty.DoubleType()),
    Ty.StructField("result_preferences", Ty.MapType(Ty.StringType(), Ty.LongType())),
    Ty.StructField("n_accepted", Ty.LongType()),
    Ty.StructField("n_events", Ty.LongType()),
    Ty.StructField("error", Ty.StringType()),
])


def write_results_json(results: DataFrame, path: str) -> None:
    """A13 sink: results without histories, one JSON object per line."""
    results.select(*[f.name for f in RESULT_SCHEMA.fields]).write.mode("errorifexists").json(path)


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """A13 source: typed read, MAP and STRUCT columns restored."""
    return spark.read.schema(RESULT_SCHEMA).json(path)
