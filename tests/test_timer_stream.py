"""The timer stream against the batch fold: disorder, restarts, faulty and late rows, state read back."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from prefspark.operators import profile as P
from prefspark.streaming import profiles as S
from prefspark.streaming import timers as ST

PARAMS = P.FoldParams(alpha=0.2, gamma=0.6, beta=2.0, max_embeddings=4, min_samples=2)
START = datetime(2024, 1, 1)
COLUMNS = ["user_id", "slot", "item_id", "preference", "rewards_received", "total_rewards", "reward_average", "matches", "evictions"]


def _reactions(n: int) -> list[tuple]:
    """User 1 has most rows; some times repeat, and some buckets hold many rows."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        user = 1 if rng.random() < 0.6 else rng.randrange(2, 6)
        ts = START + timedelta(minutes=rng.randrange(600))
        rows.append((user, ts, i, rng.randrange(30), rng.choice([-1.0, 0.0, 1.0]), [rng.gauss(0, 1) for _ in range(3)]))
    return rows


def _rows(df, digits: int = 9) -> list[tuple]:
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.select(*COLUMNS).collect())


def test_timer_stream_equals_the_batch_fold(spark, tmp_path):
    rows = _reactions(150)
    faulty = [(1, START, 900, 1, 1.0, None), (None, START, 901, 1, 1.0, [1.0, 0.0, 0.0]), (2, START, None, 1, 1.0, [1.0, 0.0, 0.0])]
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    whole = _rows(P.fold_profiles(spark.createDataFrame(rows, S.REACTION_SCHEMA), PARAMS))
    run = lambda: ST.run_profile_stream_timers(spark, src, sink, ck, PARAMS, delay="1 day", files_per_trigger=None)
    random.Random(5).shuffle(rows)  # the stream gets them in no order, in two runs
    for part in (rows[:80] + faulty, rows[80:]):
        spark.createDataFrame(part, S.REACTION_SCHEMA).write.mode("append").parquet(src)
        assert run() == 0
    waiting = ST.still_waiting(spark, ck)
    assert waiting.agg({"n": "sum"}).first()[0] == 150  # each row once, none folded yet
    assert waiting.where("user_id = 1").count() <= 10  # one entry an hour
    assert spark.read.schema(S.OUTPUT_SCHEMA).parquet(sink).count() == 0
    S.write_heartbeat(spark, src, START + timedelta(days=1, hours=12))
    run()
    snapshots = S.latest_snapshot(spark.read.parquet(sink))
    assert _rows(snapshots) == whole and _rows(ST.stored_profiles(spark, ck)) == whole
    assert ST.still_waiting(spark, ck).count() == 0
    # A row behind the watermark is dropped and reported, and changes nothing.
    spark.createDataFrame([(1, START, 1000, 3, 1.0, [1.0, 0.0, 0.0])], S.REACTION_SCHEMA).write.mode("append").parquet(src)
    assert run() == 1
    assert _rows(ST.stored_profiles(spark, ck)) == whole


def test_buckets_end_one_by_one(spark, tmp_path):
    rows = _reactions(60)
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame(rows, S.REACTION_SCHEMA).write.parquet(src)
    S.write_heartbeat(spark, src, START + timedelta(hours=5, minutes=20))  # the stream's time is that of its last row
    run = lambda: ST.run_profile_stream_timers(spark, src, sink, ck, PARAMS, delay="5 hours", files_per_trigger=None)
    run()
    time = max(max(r[1] for r in rows), START + timedelta(hours=5, minutes=20)) - timedelta(hours=5)
    ended = START + timedelta(hours=int((time - START).total_seconds() // 3600))
    early = [r for r in rows if r[1] < ended]
    assert 0 < len(early) < len(rows)
    assert _rows(ST.stored_profiles(spark, ck)) == _rows(P.fold_profiles(spark.createDataFrame(early, S.REACTION_SCHEMA), PARAMS))
    assert ST.still_waiting(spark, ck).agg({"n": "sum"}).first()[0] == len(rows) - len(early)
    S.write_heartbeat(spark, src, START + timedelta(hours=30))
    run()
    assert _rows(ST.stored_profiles(spark, ck)) == _rows(P.fold_profiles(spark.createDataFrame(rows, S.REACTION_SCHEMA), PARAMS))


class _Store:
    """A user's state variables, with the number of calls."""

    def __init__(self):
        self.calls, self.value, self.entries = 0, None, {}

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    put = update

    def getValue(self, key):
        self.calls += 1
        return self.entries[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.entries[key]


class _Handle:
    def __init__(self):
        self.stores, self.timers, self.now = {}, [], 0

    def _store(self, name, *_):
        return self.stores.setdefault(name, _Store())

    getValueState = getListState = getMapState = _store

    def registerTimer(self, due):
        self.timers.append(due)

    def deleteTimer(self, due):
        self.timers.remove(due)

    def listTimers(self):
        return iter(self.timers)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return min(self.timers)


def test_calls_of_the_store_go_with_batches_and_chunks_are_merged(monkeypatch):
    """A batch of 60 rows in 60 buckets costs a few calls; small chunks that overlap are folded in order, also in part."""
    rng = random.Random(9)
    rows = [(7, START + timedelta(minutes=rng.randrange(6000)), i, i % 9, float(i % 3 - 1), [rng.gauss(0, 1) for _ in range(3)]) for i in range(240)]
    state = P.ProfileState(PARAMS)
    for _, _, _, item, reward, vec in sorted(rows, key=lambda r: r[1:3]):
        state.react(np.asarray(vec, np.float32), reward, item)
    for chunk_rows, most in ((512, 60), (7, None)):
        monkeypatch.setattr(ST, "CHUNK_ROWS", chunk_rows)
        handle, out = _Handle(), []
        processor = ST.ProfileProcessor(PARAMS)
        processor.init(handle)
        for part in range(4):
            pdf = pd.DataFrame(rows[part::4], columns=["user_id", "ts", "event_id", "item_id", "reward", "vec"])
            processor.handleInputRows((7,), iter([pdf]), handle)
            assert len(handle.timers) == 1
        for hours in (30, 31, 70, 101):
            handle.now = int((START - datetime(1970, 1, 1) + timedelta(hours=hours)).total_seconds() * 1000)
            while handle.timers and handle.timers[0] <= handle.now:
                out += list(processor.handleExpiredTimer((7,), handle, handle))
        got = out[-1]
        assert (got.item_id.tolist(), got.rewards_received.tolist(), got.total_rewards[0]) == (state.item_ids, state.counts, 240)
        assert got.preference.tolist() == state.prefs and not handle.timers and not handle.stores["waiting"].entries
        assert most is None or sum(s.calls for s in handle.stores.values()) <= most
