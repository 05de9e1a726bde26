"""Profile maintenance with separate state variables and timers.

``transformWithState`` keeps three variables a group of users (``packed.by_group``): ``totals``
(one row, with a list of the chunks that wait and each user's first bucket that isn't folded),
``slots`` (a list, the profile of a user a row) and ``waiting`` (the rows that wait, in chunks).
What a batch brings for a group is a few chunks of at most ``CHUNK_ROWS`` rows in ``(ts,
event_id)`` order, so the calls of the state store go with groups and batches, not with users or
rows.  A chunk is written once and removed when its last row is folded; between these it is read
by each timer that ends one of its buckets.  The group's one timer stands at the end of the first
bucket that waits.  When the watermark has passed it, the rows of all buckets that ended are
folded in ``(ts, event_id)`` order by merging chunks: a chunk is read when the merge comes to its
first row, so memory holds the chunks that overlap in time.

Equal to the batch fold whatever the order of arrival within the watermark's delay.  Rows with
a null user (heartbeats), time, id, item, reward or vector only move the watermark.  Rows behind
the watermark are dropped by Spark (``numRowsDroppedByWatermark``); a row whose bucket was folded
already is counted in ``late_events`` and not applied.  Users whose rows all wait have no
snapshot yet.  The state can be read back at any time as a table (``stored_profiles``).
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prefspark.operators.profile import FoldParams, ProfileState
from prefspark.session import ship_package
from prefspark.streaming import packed as K
from prefspark.streaming.profiles import BARE_SCHEMA, OUTPUT_SCHEMA, REACTION_SCHEMA, _files, event_timed, stored_on_disk

BUCKET_MS = 3_600_000

CHUNK_ROWS = 512

# ``chunks``: number, first and last bucket that waits of each; ``users``: id and first bucket not folded of each that has a profile.
TOTALS = "next_chunk bigint, wakes_at bigint, bucket_ms bigint, chunks binary, users binary"
WAITING = "n bigint, columns binary"
NEVER = -(1 << 62)


def _packed(rows: list[tuple], width: int) -> bytes:
    return np.array(rows, "<i8").reshape(-1, width).tobytes()


def _unpacked(packed: bytes, width: int) -> list[list[int]]:
    return np.frombuffer(bytes(packed), "<i8").reshape(-1, width).tolist()


def _folded_to(users: np.ndarray, folded: dict[int, int]) -> np.ndarray:
    """The first bucket not folded, for each of the rows' users."""
    if not folded:
        return np.full(len(users), NEVER)
    known, at = np.unique(users, return_inverse=True)
    return np.array([folded.get(u, NEVER) for u in known.tolist()], np.int64)[at]


class ProfileProcessor(StatefulProcessor):
    """Folds a group's reactions bucket by bucket as the watermark passes them."""

    def __init__(self, params: FoldParams, bucket_ms: int = BUCKET_MS) -> None:
        self.params, self.bucket_ms = params, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.slots = handle.getListState("slots", K.PROFILE)
        self.waiting = handle.getMapState("waiting", "chunk bigint", WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if K.no_group(key):
            for _ in rows:
                pass
            return iter(())
        next_chunk, wakes_at, chunks, folded = self._totals()
        before, late = next_chunk, Counter()
        bucket_us = 1000 * self.bucket_ms
        for pdf in rows:
            lacks = [pd.isna(pdf[c].to_numpy()) for c in ("user_id", "ts", "event_id", "item_id", "reward")] + [[v is None for v in pdf["vec"]]]
            new = K.Rows.of(pdf, np.flatnonzero(~np.any(lacks, axis=0)))
            on_time = new.ts // bucket_us >= _folded_to(new.user, folded)
            late.update(new.user[~on_time].tolist())
            new = new.at(np.flatnonzero(on_time)).ordered()
            for at in range(0, len(new), CHUNK_ROWS):
                chunk = new.at(np.arange(at, min(at + CHUNK_ROWS, len(new))))
                self.waiting.updateValue((next_chunk,), (len(chunk), chunk.packed()))
                chunks.append((next_chunk, int(chunk.ts[0]) // bucket_us, int(chunk.ts[-1]) // bucket_us))
                next_chunk += 1
        if late:  # their users have profiles
            self.slots.put([(*p[:5], int(p[5]) + late[p[0]], *p[6:]) for p in self.slots.get()])
        if next_chunk != before:
            self._put_totals(next_chunk, self._wake_at(chunks, wakes_at), chunks, folded)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ended = timerValues.getCurrentWatermarkInMs() // self.bucket_ms  # the first bucket that hasn't
        next_chunk, _, chunks, folded = self._totals()
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        profiles = {int(p[0]): p for p in self.slots.get()} if folded else {}
        states: dict[int, ProfileState] = {}
        left: dict[int, int] = {}  # chunks that have been read and wait on: their first bucket that does
        now = dict(folded)
        for ts, _, user, item, reward, vec, unit in self._merged(chunks, folded, ended, left):
            st = states.get(user)
            if st is None:
                st = states[user] = K.restored(self.params, profiles.get(user))
            st.react(vec, reward, item, unit)
            now[user] = ts // (1000 * self.bucket_ms) + 1
        chunks = [(c, left.get(c, first), last) for c, first, last in chunks if last >= ended]
        self._put_totals(next_chunk, self._wake_at(chunks, NEVER), chunks, now)
        if states:
            profiles |= {user: K.packed_profile(user, st, profiles[user][5] if user in profiles else 0) for user, st in states.items()}
            self.slots.put(list(profiles.values()))
            yield K.snapshots(profiles[user] for user in states)

    def _totals(self) -> tuple[int, int, list, dict[int, int]]:
        row = self.totals.get()
        if row is None:
            return 0, NEVER, [], {}
        next_chunk, wakes_at, _, chunks, users = row
        return int(next_chunk), int(wakes_at), _unpacked(chunks, 3), dict(_unpacked(users, 2))

    def _put_totals(self, next_chunk: int, wakes_at: int, chunks: list, folded: dict[int, int]) -> None:
        self.totals.update((next_chunk, wakes_at, self.bucket_ms, _packed(chunks, 3), _packed(list(folded.items()), 2)))

    def _wake_at(self, chunks: list, wakes_at: int) -> int:
        """One timer a group, at the end of the first bucket that waits; when it is due."""
        if not chunks:
            return NEVER
        due_ms = (min(first for _, first, _ in chunks) + 1) * self.bucket_ms
        if wakes_at == NEVER or due_ms < wakes_at:
            if wakes_at != NEVER:
                self.handle.deleteTimer(wakes_at)
            self.handle.registerTimer(due_ms)
            return due_ms
        return wakes_at

    def _merged(self, chunks: list, folded: dict[int, int], ended: int, left: dict[int, int]) -> Iterator[tuple]:
        """Rows that wait of the buckets to ``ended``, in ``(ts, event_id)`` order; chunks whose buckets all ended are removed."""
        bucket_us = 1000 * self.bucket_ms
        unread = sorted((first, chunk, last) for chunk, first, last in chunks if first < ended)[::-1]
        heads: list[tuple] = []  # the next row of each chunk that has been read
        while unread or heads:
            while unread and (not heads or unread[-1][0] * bucket_us <= heads[0][0]):
                _, chunk, last = unread.pop()
                value = K.Rows.unpacked(*self.waiting.getValue((chunk,)))
                buckets = value.ts // bucket_us
                if last < ended:
                    self.waiting.removeKey((chunk,))
                else:
                    left[chunk] = int(buckets[np.searchsorted(buckets, ended)])
                rows = iter(value.at(np.flatnonzero((buckets < ended) & (buckets >= _folded_to(value.user, folded)))).reactions())
                row = next(rows, None)
                if row is not None:
                    heapq.heappush(heads, (row[0], row[1], chunk, row, rows))
            if heads:
                _, _, chunk, row, rows = heads[0]
                yield row
                row = next(rows, None)
                if row is None:
                    heapq.heappop(heads)
                else:
                    heapq.heapreplace(heads, (row[0], row[1], chunk, row, rows))

    def close(self) -> None:
        pass


def profile_stream_timers(reactions: DataFrame, p: FoldParams, delay: str = "0 seconds", bucket_ms: int = BUCKET_MS, items: DataFrame | None = None) -> DataFrame:
    """Streaming snapshots of the profiles of all users whose buckets ended; reactions without ``vec`` get it from ``items``."""
    ship_package(reactions.sparkSession)
    groups = K.by_group(event_timed(reactions, delay, items)).groupBy(K.GROUP)
    return groups.transformWithStateInPandas(ProfileProcessor(p, bucket_ms), OUTPUT_SCHEMA, "append", "EventTime")


def run_profile_stream_timers(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, p: FoldParams,
                              delay: str = "0 seconds", files_per_trigger: int | None = 1, bucket_ms: int = BUCKET_MS,
                              items: DataFrame | None = None) -> int:
    """Run until caught up; the number of rows that Spark dropped as behind the watermark."""
    src = _files(spark, REACTION_SCHEMA if items is None else BARE_SCHEMA, source_dir, files_per_trigger)
    with stored_on_disk(spark):  # several state variables need this store
        q = (
            profile_stream_timers(src, p, delay, bucket_ms, items).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start(sink_dir)
        )
    q.awaitTermination()
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for prog in q.recentProgress for op in prog.get("stateOperators", []))


def _state(spark: SparkSession, checkpoint_dir: str, variable: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint_dir)


def _profile_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield K.snapshots(pdf.itertuples(index=False, name=None))


def stored_profiles(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """The profiles as a stopped stream's state has them, one row a slot."""
    ship_package(spark)
    return _state(spark, checkpoint_dir, "slots").select("list_element.*").mapInPandas(_profile_rows, OUTPUT_SCHEMA)


def _waiting_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for n, columns, bucket_ms, users in zip(pdf["n"], pdf["columns"], pdf["bucket_ms"], pdf["users"], strict=True):
            rows = K.Rows.unpacked(int(n), columns)
            bucket = rows.ts // (1000 * int(bucket_ms))
            waits = bucket >= _folded_to(rows.user, dict(_unpacked(users, 2)))
            yield pd.DataFrame({"user_id": rows.user[waits], "bucket": bucket[waits]})


def still_waiting(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """user_id, bucket and n of the rows that wait for the watermark."""
    ship_package(spark)
    totals = _state(spark, checkpoint_dir, "totals").select(f"key.{K.GROUP}", "value.bucket_ms", "value.users")
    chunks = _state(spark, checkpoint_dir, "waiting").select(f"key.{K.GROUP}", "user_map_value.n", "user_map_value.columns")
    rows = chunks.join(totals, K.GROUP).select("n", "columns", "bucket_ms", "users").mapInPandas(_waiting_rows, "user_id bigint, bucket bigint")
    return rows.groupBy("user_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
