"""The event-time streams for groups of users: calls of the store, vectors from the catalogue, faulty rows beside others."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from prefspark.operators import profile as P
from prefspark.plans import streams as Q
from prefspark.streaming import packed as K
from prefspark.streaming import profiles as S
from prefspark.streaming import timers as ST
from tests.test_timer_stream import PARAMS, START, _Handle, _rows

BIG = (1 << 60) + 1  # an id that a double can't hold


def _reactions(n: int) -> list[tuple]:
    """Of 25 users and 12 items, the last of which the catalogue lacks."""
    rng = random.Random(11)
    return [(BIG + rng.randrange(25), START + timedelta(minutes=rng.randrange(900)), BIG + i, rng.randrange(12), rng.choice([-1.0, 0.0, 1.0])) for i in range(n)]


def _catalogue(spark):
    rng = random.Random(12)
    return spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(11)], "item_id long, embedding array<float>")


@pytest.mark.parametrize("run", [S.run_profile_stream_strict, ST.run_profile_stream_timers])
def test_vectors_come_from_the_catalogue(spark, tmp_path, run):
    """Bare reactions in two runs, users many to a group, heartbeats and rows without ids among them: the batch fold's profiles."""
    rows, items = _reactions(260), _catalogue(spark)
    faulty = [(None, START, BIG, 1, 1.0), (BIG, START, None, 1, 1.0), (BIG, START, BIG, None, 1.0)]
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    before = {k: spark.conf.get(k, None) for k in S.STORE_SETTINGS}
    patch = pytest.MonkeyPatch()
    patch.setattr(K, "GROUPS", 3)
    try:
        for part in (rows[:150] + faulty, rows[150:]):
            spark.createDataFrame(part, S.BARE_SCHEMA).write.mode("append").parquet(src)
            assert run(spark, src, sink, ck, PARAMS, delay="1 day", files_per_trigger=None, items=items) == 0
        S.write_heartbeat(spark, src, START + timedelta(days=3))
        run(spark, src, sink, ck, PARAMS, delay="1 day", files_per_trigger=None, items=items)
    finally:
        patch.undo()
    assert {k: spark.conf.get(k, None) for k in S.STORE_SETTINGS} == before
    whole = _rows(P.fold_profiles(P.attach_vectors(spark.createDataFrame(rows, S.BARE_SCHEMA), items), PARAMS))
    assert whole and _rows(S.latest_snapshot(spark.read.parquet(sink))) == whole
    if run is ST.run_profile_stream_timers:
        assert _rows(ST.stored_profiles(spark, ck)) == whole and ST.still_waiting(spark, ck).count() == 0


@pytest.mark.parametrize("query", ["profile_stream_strict", "profile_stream_timers", "profile_state_reader"])
def test_reactions_are_staged_without_vectors(spark, monkeypatch, query):
    """A vector is eight times as large as the rest of a reaction."""
    class Staged(Exception):
        pass

    def arrive(df, *_):
        raise Staged(df.columns)

    monkeypatch.setattr(S, "arrive_in_slices", arrive)
    with pytest.raises(Staged) as staged:
        Q.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert staged.value.args[0] == ["user_id", "ts", "event_id", "item_id", "reward"]


def test_calls_of_the_store_go_with_groups():
    """40 users of a group in two batches cost the calls of one; a late row counts for its user only."""
    rng = random.Random(9)
    rows = [(rng.randrange(40), START + timedelta(minutes=i), i, i % 9, float(i % 3 - 1), [rng.gauss(0, 1) for _ in range(3)]) for i in range(600)]
    states = {}
    for user, _, _, item, reward, vec in rows:
        states.setdefault(user, P.ProfileState(PARAMS)).react(np.asarray(vec, np.float32), reward, item)
    handle, out = _Handle(), {}
    processor = ST.ProfileProcessor(PARAMS)
    processor.init(handle)
    for part, hours in ((rows[:300], 5), (rows[300:] + rows[:1], 20)):
        pdf = pd.DataFrame(random.Random(1).sample(part, len(part)), columns=["user_id", "ts", "event_id", "item_id", "reward", "vec"])
        processor.handleInputRows((7,), iter([pdf]), handle)
        handle.now = int((START - datetime(1970, 1, 1) + timedelta(hours=hours)).total_seconds() * 1000)
        for snapshot in processor.handleExpiredTimer((7,), handle, handle):
            out |= dict(list(snapshot.groupby("user_id")))
    assert set(out) == set(states) and not handle.timers and not handle.stores["waiting"].entries
    for user, st in states.items():
        assert (out[user].item_id.tolist(), out[user].rewards_received.tolist()) == (st.item_ids, st.counts)
        assert out[user].preference.tolist() == pytest.approx(st.prefs) and set(out[user].late_events) == {int(user == rows[0][0])}
    assert sum(s.calls for s in handle.stores.values()) <= 24
