"""Registered streaming queries (D10, E7): parity with the batch plans.

Inputs are staged from the driver tables into the shared scratch folder as
time-ordered files; the streams run until caught up (``availableNow``) and the
result tables are read back.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.operators import recommend as R
from prefspark.plans import profiles as PP
from prefspark.plans import recommendation as RP
from prefspark.plans.retrieval import K_CANDIDATES
from prefspark.session import materialize, scratch_path
from prefspark.sources import tables as T
from prefspark.streaming import profiles as S
from prefspark.streaming import timers as ST

SLICES = 3


def q_profile_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The streamed fold's current profiles, with matching and eviction."""
    src, sink, ck = scratch_path(spark, "reactions-in"), scratch_path(spark, "profiles-out"), scratch_path(spark, "profiles-ck")
    staged = PP.reactions_with_vec(spark, sf).select("user_id", "ts", "event_id", "item_id", "reward", "vec")
    S.arrive_in_slices(staged, src, "ts", SLICES, lambda: S.run_profile_stream(spark, src, sink, ck, PP.EVICTING, files_per_trigger=None))
    return PP._slot_cols(S.latest_snapshot(spark.read.parquet(sink)))


def _bare_reactions(spark: SparkSession, sf: str) -> DataFrame:
    """What arrives of a reaction; the stream looks the item's vector up."""
    return T.reactions(spark, sf).select("user_id", "ts", "event_id", "item_id", "reward")


def q_profile_stream_strict(spark: SparkSession, sf: str) -> DataFrame:
    """D10 in strict event-time order (watermark, delay 0); a closing heartbeat lets the watermark pass the last reaction."""
    src, sink, ck = scratch_path(spark, "reactions-in"), scratch_path(spark, "strict-out"), scratch_path(spark, "strict-ck")
    items = T.items(spark, sf)
    run = lambda: S.run_profile_stream_strict(spark, src, sink, ck, PP.EVICTING, files_per_trigger=None, items=items)
    S.arrive_in_slices(_bare_reactions(spark, sf), src, "ts", SLICES, run)
    S.write_heartbeat(spark, src, T.table(spark, sf, "events").agg(F.max("ts").alias("ts")).first()["ts"])
    run()
    return PP._slot_cols(S.latest_snapshot(spark.read.parquet(sink)))


def _timers_run(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Sink and checkpoint of the timer stream over all reactions and a heartbeat past the last bucket."""
    src, sink, ck = scratch_path(spark, "reactions-in"), scratch_path(spark, "timers-out"), scratch_path(spark, "timers-ck")
    items = T.items(spark, sf)
    run = lambda: ST.run_profile_stream_timers(spark, src, sink, ck, PP.EVICTING, files_per_trigger=None, items=items)
    S.arrive_in_slices(_bare_reactions(spark, sf), src, "ts", SLICES, run)
    last = T.table(spark, sf, "events").agg(F.max("ts").alias("ts")).first()["ts"]
    S.write_heartbeat(spark, src, last + timedelta(milliseconds=2 * ST.BUCKET_MS))
    run()
    return sink, ck


def q_profile_stream_timers(spark: SparkSession, sf: str) -> DataFrame:
    """D10 in event-time order by timers over separate state variables: the current profiles from the sink."""
    return PP._slot_cols(S.latest_snapshot(spark.read.parquet(_timers_run(spark, sf)[0])))


def q_profile_state_reader(spark: SparkSession, sf: str) -> DataFrame:
    """The same profiles, read back from the stopped stream's state."""
    return materialize(PP._slot_cols(ST.stored_profiles(spark, _timers_run(spark, sf)[1])), "state-read")


def q_recommend_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Per-request recommendations from a stored snapshot, answered batch by batch."""
    snapshot = materialize(T.sql_profile(spark, sf), "snapshot")
    first_seen = T.table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("ts"))
    req, sink, ck = scratch_path(spark, "requests-in"), scratch_path(spark, "recs-out"), scratch_path(spark, "recs-ck")
    items, seen, n_items, dim = T.items(spark, sf), T.seen(spark, sf), T.n_items(spark, sf), RP.catalogue_dim(spark, sf)

    def recommend(batch: DataFrame) -> DataFrame:
        return R.recommend_batch(batch.select("user_id"), snapshot, items, seen, n_items, dim, RP.BETA, RP.EXP_RATE,
                                 RP.SEED, RP.STEP, K_CANDIDATES, RP.TEMPERATURE)

    S.arrive_in_slices(first_seen, req, "ts", 2, lambda: S.run_recommend_stream(spark, req, sink, ck, recommend, files_per_trigger=None))
    return spark.read.parquet(sink).select("user_id", "mode", "slot", "item_id", "fallback")


ORACLES = {
    "profile_stream": PP.ORACLES["profile_fold_resume"],
    "profile_stream_strict": PP.ORACLES["profile_fold_resume"],
    "profile_stream_timers": PP.ORACLES["profile_fold_resume"],
    "profile_state_reader": PP.ORACLES["profile_fold_resume"],
    "recommend_stream": RP.ORACLES["recommend_batch"],
}

QUERIES = {
    "profile_stream": q_profile_stream,
    "profile_stream_strict": q_profile_stream_strict,
    "profile_stream_timers": q_profile_stream_timers,
    "profile_state_reader": q_profile_state_reader,
    "recommend_stream": q_recommend_stream,
}
