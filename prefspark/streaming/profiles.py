"""Streaming profile maintenance (D10) and streaming recommendation.

D10: reactions arrive as files; ``groupBy(user_id).applyInPandasWithState`` keeps
one state row per user (the bounded profile: at most ``max_embeddings + 1``
slots) and folds each micro-batch's rows in ``(ts, event_id)`` order with the
same state machine as the batch fold.  Every update emits the user's full
snapshot tagged with ``total_rewards`` (a per-user version), so the current
profile is the latest version per user.  Order policy: arrival order across
micro-batches; a row older than the user's last folded event is still folded
and counted in ``late_events``.  Results equal the batch fold when files arrive
in time order.

E7: requests arrive as files; ``foreachBatch`` runs the batch recommendation
(E5) for the batch's users against the current snapshot table.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming.state import GroupStateTimeout

from prefspark.operators.profile import FoldParams, ProfileState, attach_vectors
from prefspark.session import ship_package
from prefspark.streaming import packed as K

# Settings of the queries whose rows wait in state: it lies on disk (RocksDB) and not in the executors' memory, the stores
# of an executor share one cache, and only the last versions, which a restart needs, are kept and the others soon removed.
STORE = "spark.sql.streaming.stateStore.providerClass"
STORE_SETTINGS = {
    STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
}

STATE_SCHEMA = Ty.StructType([
    Ty.StructField("item_ids", Ty.ArrayType(Ty.LongType())),
    Ty.StructField("vecs", Ty.ArrayType(Ty.ArrayType(Ty.FloatType()))),
    Ty.StructField("prefs", Ty.ArrayType(Ty.DoubleType())),
    Ty.StructField("counts", Ty.ArrayType(Ty.LongType())),
    Ty.StructField("avg", Ty.DoubleType()),
    Ty.StructField("total", Ty.LongType()),
    Ty.StructField("matches", Ty.LongType()),
    Ty.StructField("evictions", Ty.LongType()),
    Ty.StructField("last_ts", Ty.LongType()),
    Ty.StructField("last_eid", Ty.LongType()),
    Ty.StructField("late", Ty.LongType()),
])

OUTPUT_SCHEMA = Ty.StructType([
    Ty.StructField("user_id", Ty.LongType()),
    Ty.StructField("slot", Ty.LongType()),
    Ty.StructField("item_id", Ty.LongType()),
    Ty.StructField("embedding", Ty.ArrayType(Ty.FloatType())),
    Ty.StructField("preference", Ty.DoubleType()),
    Ty.StructField("rewards_received", Ty.LongType()),
    Ty.StructField("total_rewards", Ty.LongType()),
    Ty.StructField("reward_average", Ty.DoubleType()),
    Ty.StructField("matches", Ty.LongType()),
    Ty.StructField("evictions", Ty.LongType()),
    Ty.StructField("late_events", Ty.LongType()),
])

REACTION_SCHEMA = Ty.StructType([
    Ty.StructField("user_id", Ty.LongType()),
    Ty.StructField("ts", Ty.TimestampNTZType()),
    Ty.StructField("event_id", Ty.LongType()),
    Ty.StructField("item_id", Ty.LongType()),
    Ty.StructField("reward", Ty.DoubleType()),
    Ty.StructField("vec", Ty.ArrayType(Ty.FloatType())),
])

# Reactions without vectors, which the stream gets from the catalogue.
BARE_SCHEMA = Ty.StructType(REACTION_SCHEMA.fields[:-1])


def _stream_fold_fn(p: FoldParams):
    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        st = ProfileState(p)
        last, late = None, 0
        if state.exists:
            (item_ids, vecs, prefs, counts, avg, total, matches, evictions, last_ts, last_eid, late) = state.get
            for i in range(len(prefs)):
                st.restore_slot(vecs[i], item_ids[i], prefs[i], counts[i])
            st.avg, st.total, st.matches, st.evictions = float(avg), int(total), int(matches), int(evictions)
            last = (int(last_ts), int(last_eid))
        # One micro-batch of one user: bounded by the trigger size (maxFilesPerTrigger).
        pdf = pd.concat(list(batches), ignore_index=True)
        pdf["_ts"] = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        pdf = pdf.sort_values(["_ts", "event_id"], kind="stable")
        for ts, eid, vec, r, item in zip(pdf["_ts"], pdf["event_id"], pdf["vec"], pdf["reward"], pdf["item_id"]):
            cur = (int(ts), int(eid))
            if last is not None and cur < last:
                late += 1
            else:
                last = cur
            st.react(vec, float(r), item)
        state.update((
            [int(x) for x in st.item_ids], [np.asarray(v, dtype=np.float32).tolist() for v in st.vecs],
            [float(x) for x in st.prefs], [int(x) for x in st.counts], float(st.avg), int(st.total),
            int(st.matches), int(st.evictions), last[0], last[1], int(late),
        ))
        m = len(st.prefs)
        yield pd.DataFrame({
            "user_id": np.full(m, key[0], dtype=np.int64),
            "slot": np.arange(m, dtype=np.int64),
            "item_id": np.asarray(st.item_ids, dtype=np.int64),
            "embedding": [np.asarray(v, dtype=np.float32) for v in st.vecs],
            "preference": np.asarray(st.prefs, dtype=np.float64),
            "rewards_received": np.asarray(st.counts, dtype=np.int64),
            "total_rewards": np.full(m, st.total, dtype=np.int64),
            "reward_average": np.full(m, st.avg, dtype=np.float64),
            "matches": np.full(m, st.matches, dtype=np.int64),
            "evictions": np.full(m, st.evictions, dtype=np.int64),
            "late_events": np.full(m, late, dtype=np.int64),
        })

    return run


def profile_stream(reactions: DataFrame, p: FoldParams) -> DataFrame:
    """A streaming DataFrame of versioned profile snapshots."""
    ship_package(reactions.sparkSession)
    return reactions.groupBy("user_id").applyInPandasWithState(
        _stream_fold_fn(p), OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def _files(spark: SparkSession, schema: Ty.StructType, source_dir: str, files_per_trigger: int | None) -> DataFrame:
    """New files of a folder, all that are there in one batch unless their number is bounded."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(source_dir)


@contextmanager
def stored_on_disk(spark: SparkSession) -> Iterator[None]:
    """``STORE_SETTINGS`` for the queries that are started inside; a query keeps the settings that it starts with."""
    before = {k: spark.conf.get(k, None) for k in STORE_SETTINGS}
    for k, v in STORE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def event_timed(reactions: DataFrame, delay: str, items: DataFrame | None) -> DataFrame:
    """Reactions with a watermark and, if ``items`` are given, the vector of their item.

    A reaction of no known item has no vector and is not folded, but moves the watermark (as a heartbeat does), so the
    join comes after the watermark and keeps all rows: a filter of ids would go below the watermark.
    """
    timed = reactions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)  # watermarks need TIMESTAMP
    return timed if items is None else attach_vectors(timed, items, how="left")


def run_profile_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, p: FoldParams,
                       files_per_trigger: int | None = 1) -> None:
    """Run D10 over every new file in ``source_dir`` until caught up (``availableNow``)."""
    src = _files(spark, REACTION_SCHEMA, source_dir, files_per_trigger)
    q = (
        profile_stream(src, p).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start(sink_dir)
    )
    q.awaitTermination()


def latest_snapshot(versions: DataFrame) -> DataFrame:
    """The current profile: each user's rows of the highest version."""
    w = Window.partitionBy("user_id")
    tagged = versions.withColumn("_latest", F.max("total_rewards").over(w))
    return tagged.where(F.col("total_rewards") == F.col("_latest")).drop("_latest")


def arrive_in_slices(df: DataFrame, path: str, ts_col: str, slices: int, catch_up: Callable[[], object]) -> None:
    """Let ``df`` arrive at ``path`` in ``slices`` parts by time, oldest first, and call ``catch_up`` after each.

    A part is written by all tasks, as files by range of time. Its bounds are approximate
    quantiles; every row is in exactly one part.
    """
    t = F.col(ts_col).cast("timestamp").cast("double") if dict(df.dtypes)[ts_col].startswith("timestamp") else F.col(ts_col).cast("double")
    bounds = df.select(t.alias("_t")).approxQuantile("_t", [i / slices for i in range(1, slices)], 0.001)
    edges = [None, *bounds, None]
    for i in range(slices):
        cond = F.lit(True)
        if edges[i] is not None:
            cond = cond & (t >= F.lit(edges[i]))
        if edges[i + 1] is not None:
            cond = cond & (t < F.lit(edges[i + 1]))
        df.where(cond).repartitionByRange(ts_col).write.mode("append").parquet(path)
        catch_up()
        _release_shuffles(df.sparkSession)


def _release_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver's garbage is collected, which may come late or never by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_heartbeat(spark: SparkSession, path: str, after) -> None:
    """A reaction of nobody, a second later than ``after``: it moves the watermark on and is never folded."""
    row = spark.createDataFrame([(None, after + timedelta(seconds=1), None, None, None, None)], REACTION_SCHEMA)
    row.write.mode("append").parquet(path)


# ---------------------------------------------------------------------------
# E7
# ---------------------------------------------------------------------------

def run_recommend_stream(spark: SparkSession, requests_dir: str, sink_dir: str, checkpoint_dir: str, recommend,
                         files_per_trigger: int | None = 1) -> None:
    """Each micro-batch of ``(user_id)`` requests is answered by ``recommend(batch_df)``
    (the batch plan over the current snapshot) and appended to ``sink_dir``."""
    schema = Ty.StructType([Ty.StructField("user_id", Ty.LongType())])
    src = _files(spark, schema, requests_dir, files_per_trigger)

    def answer(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch, overwritten on retry, so a re-run batch is not appended twice.
        recommend(batch).write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")

    q = src.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    q.awaitTermination()


# ---------------------------------------------------------------------------
# D10, strict event-time order
# ---------------------------------------------------------------------------

# Of a group of users: those with folded rows (id, time and id of the last one, late rows), their profiles one after
# another (see ``packed``) and the rows that wait.
STRICT_STATE_SCHEMA = Ty.StructType([
    Ty.StructField("users", Ty.BinaryType()),
    Ty.StructField("heads", Ty.BinaryType()),
    Ty.StructField("averages", Ty.BinaryType()),
    Ty.StructField("profiles", Ty.BinaryType()),
    Ty.StructField("n_waiting", Ty.LongType()),
    Ty.StructField("waiting", Ty.BinaryType()),
])


def _strict_state(last: dict[int, list[int]], profiles: dict[int, tuple], waiting: K.Rows) -> tuple:
    users = np.array([(u, *v) for u, v in last.items()], "<i8").tobytes()
    rows = [profiles[u] for u in last]
    heads = np.array([(p[1], p[3], p[4], p[6], len(p[7])) for p in rows], "<i8").tobytes()
    return users, heads, np.array([p[2] for p in rows], "<f8").tobytes(), b"".join(bytes(p[7]) for p in rows), len(waiting), waiting.packed()


def _strict_users(users: bytes, heads: bytes, averages: bytes, columns: bytes) -> tuple[dict[int, list[int]], dict[int, tuple]]:
    last, profiles, at = {}, {}, 0
    heads = np.frombuffer(bytes(heads), "<i8").reshape(-1, 5).tolist()
    rows = zip(np.frombuffer(bytes(users), "<i8").reshape(-1, 4).tolist(), heads, np.frombuffer(bytes(averages), "<f8").tolist(), strict=True)
    for (user, ts, event_id, late), (total, matches, evictions, slots, size), average in rows:
        last[user] = [ts, event_id, late]
        profiles[user] = user, total, average, matches, evictions, late, slots, columns[at : at + size]
        at += size
    return last, profiles


def _strict_fold_fn(p: FoldParams):
    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if K.no_group(key):
            for _ in batches:
                pass
            return
        last, profiles, waiting = {}, {}, []  # last: time and id of a user's last folded row, and the number of its late ones
        if state.exists:
            *held, n, rows = state.get
            last, profiles = _strict_users(*held)
            waiting.append(K.Rows.unpacked(n, rows))
        if not state.hasTimedOut:
            for pdf in batches:
                new = K.Rows.of(pdf, np.flatnonzero([v is not None for v in pdf["vec"]]))
                on_time = np.ones(len(new), bool)
                for i, (user, *at) in enumerate(zip(new.user.tolist(), new.ts.tolist(), new.event_id.tolist(), strict=True)):
                    if user in last and at < last[user][:2]:
                        last[user][2] += 1  # behind what was already folded: counted, not applied
                        on_time[i] = False
                waiting.append(new.at(np.flatnonzero(on_time)))
        wm_us = state.getCurrentWatermarkMs() * 1000
        rows = K.Rows.joined(waiting).ordered() if waiting else K.Rows.unpacked(0, b"")
        n_ready = int(np.searchsorted(rows.ts, wm_us, "right"))
        states: dict[int, ProfileState] = {}
        for t, e, user, item, r, v, unit in rows.at(np.arange(n_ready)).reactions():
            st = states.get(user)
            if st is None:
                st = states[user] = K.restored(p, profiles.get(user))
            st.react(v, r, item, unit)
            last[user] = [t, e, last[user][2] if user in last else 0]
        profiles |= {user: K.packed_profile(user, st, last[user][2]) for user, st in states.items()}
        rows = rows.at(np.arange(n_ready, len(rows)))
        state.update(_strict_state(last, profiles, rows))
        if len(rows):
            # Called again once the watermark passes the oldest buffered row.
            # (a timeout fires when the watermark passes it; rows are ready at wm_ms * 1000 >= ts_us)
            due_ms = -(-int(rows.ts[0]) // 1000) - 1
            state.setTimeoutTimestamp(max(due_ms, state.getCurrentWatermarkMs() + 1))
        if states:
            yield K.snapshots(profiles[user] for user in states)

    return run


def profile_stream_strict(reactions: DataFrame, p: FoldParams, delay: str = "0 seconds", items: DataFrame | None = None) -> DataFrame:
    """D10 in strict event-time order: rows wait in state until the watermark
    (``max ts - delay``) passes them, then fold in ``(ts, event_id)`` order.  Rows
    behind the watermark are dropped by Spark before the state function (reported
    as ``numRowsDroppedByWatermark``); rows behind a user's folded history but not
    behind the watermark are dropped here and counted in ``late_events``.  Reactions
    without ``vec`` get it from ``items``."""
    ship_package(reactions.sparkSession)
    return K.by_group(event_timed(reactions, delay, items)).groupBy(K.GROUP).applyInPandasWithState(
        _strict_fold_fn(p), OUTPUT_SCHEMA, STRICT_STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )


def run_profile_stream_strict(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, p: FoldParams,
                              delay: str = "0 seconds", files_per_trigger: int | None = 1, items: DataFrame | None = None) -> int:
    """Run strict D10 until caught up; returns the rows Spark dropped as behind the
    watermark (its standard late-data rule, applied before the state function)."""
    src = _files(spark, REACTION_SCHEMA if items is None else BARE_SCHEMA, source_dir, files_per_trigger)
    with stored_on_disk(spark):
        q = (
            profile_stream_strict(src, p, delay, items).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start(sink_dir)
        )
    q.awaitTermination()
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for prog in q.recentProgress for op in prog.get("stateOperators", []))
