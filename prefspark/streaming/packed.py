"""State of the event-time streams (D10) in packed form, for a group of users at a time.

A call of a state store costs far more than folding a reaction, so a key of these streams is not
a user but a group of users (``by_group``), dealt by a hash; a group's reactions and profiles are
little-endian columns in binary values.  A batch that brings rows for some users of a group reads
and writes the profiles of all of them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.operators.profile import FoldParams, ProfileState, unit_rows

GROUPS = 4096  # fixed: a checkpoint holds its users by it
GROUP = "user_group"
NO_GROUP = -1
# A user's profile; ``columns``: item ids, preferences, counts and vectors of the slots.
PROFILE = "user_id bigint, total bigint, average double, matches bigint, evictions bigint, late bigint, slots bigint, columns binary"


def by_group(reactions: DataFrame) -> DataFrame:
    """With the user's group.

    What can't be folded for want of an id (heartbeats) is in group NO_GROUP, with NO_GROUP for the ids that lack: an
    id that is null makes a whole batch of ids and keys doubles on the way to Python.
    """
    ids = ["user_id", "event_id", "item_id"]
    whole = F.col("user_id").isNotNull() & F.col("event_id").isNotNull() & F.col("item_id").isNotNull()
    keyed = reactions.withColumn(GROUP, F.when(whole, F.pmod(F.xxhash64("user_id"), F.lit(GROUPS))).otherwise(NO_GROUP))
    return keyed.withColumns({c: F.coalesce(c, F.lit(NO_GROUP).cast("long")) for c in ids})


def no_group(key: tuple) -> bool:
    return key[0] == NO_GROUP


class Rows:
    """Reactions as columns."""

    def __init__(self, user: np.ndarray, ts: np.ndarray, event_id: np.ndarray, item: np.ndarray, reward: np.ndarray, vecs: list[np.ndarray]) -> None:
        self.user, self.ts, self.event_id, self.item, self.reward, self.vecs = user, ts, event_id, item, reward, vecs

    def __len__(self) -> int:
        return len(self.user)

    @staticmethod
    def of(pdf: pd.DataFrame, where: np.ndarray) -> Rows:
        """A frame's rows at these places; ``ts`` in microseconds."""
        user, event_id, item = (pdf[c].to_numpy()[where].astype(np.int64) for c in ("user_id", "event_id", "item_id"))
        ts = pdf["ts"].to_numpy()[where].astype("datetime64[us]").astype(np.int64)
        vecs = [np.asarray(v, dtype=np.float32) for v in pdf["vec"].to_numpy()[where]]
        return Rows(user, ts, event_id, item, pdf["reward"].to_numpy()[where].astype(np.float64), vecs)

    @staticmethod
    def unpacked(n: int, columns: bytes) -> Rows:
        columns = bytes(columns)
        user, ts, event_id, item = np.frombuffer(columns, "<i8", 4 * n).reshape(4, n)
        sizes = np.frombuffer(columns, "<i4", n, 40 * n)
        vecs = np.split(np.frombuffer(columns, "<f4", offset=44 * n), np.cumsum(sizes)[:-1]) if n else []
        return Rows(user, ts, event_id, item, np.frombuffer(columns, "<f8", n, 32 * n), vecs)

    @staticmethod
    def joined(parts: Iterable[Rows]) -> Rows:
        parts = list(parts)
        columns = [np.concatenate([getattr(p, c) for p in parts]) for c in ("user", "ts", "event_id", "item", "reward")]
        return Rows(*columns, [v for p in parts for v in p.vecs])

    def packed(self) -> bytes:
        sizes = np.array([len(v) for v in self.vecs], "<i4")
        columns = [*(c.astype("<i8") for c in (self.user, self.ts, self.event_id, self.item)), self.reward.astype("<f8"), sizes]
        return b"".join([c.tobytes() for c in columns] + [v.astype("<f4", copy=False).tobytes() for v in self.vecs])

    def at(self, where: np.ndarray) -> Rows:
        vecs = [self.vecs[i] for i in where.tolist()]
        return Rows(self.user[where], self.ts[where], self.event_id[where], self.item[where], self.reward[where], vecs)

    def ordered(self) -> Rows:
        return self.at(np.lexsort((self.event_id, self.ts)))

    def reactions(self) -> Iterable[tuple]:
        """ts, event_id, user, item, reward, vec, unit vector of each row."""
        return zip(self.ts.tolist(), self.event_id.tolist(), self.user.tolist(), self.item.tolist(), self.reward.tolist(), self.vecs, unit_rows(self.vecs), strict=True)


def packed_profile(user: int, st: ProfileState, late: int) -> tuple:
    """A PROFILE row."""
    columns = [np.asarray(st.item_ids, "<i8"), np.asarray(st.prefs, "<f8"), np.asarray(st.counts, "<i8"), *(np.asarray(v, "<f4") for v in st.vecs)]
    return int(user), int(st.total), float(st.avg), int(st.matches), int(st.evictions), int(late), len(st.prefs), b"".join(c.tobytes() for c in columns)


def _slots(profile: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, columns = int(profile[6]), bytes(profile[7])
    items, prefs, counts = (np.frombuffer(columns, kind, n, 8 * n * k) for k, kind in enumerate(("<i8", "<f8", "<i8")))
    return items, prefs, counts, np.frombuffer(columns, "<f4", offset=24 * n).reshape(n, -1)


def restored(params: FoldParams, profile: tuple | None) -> ProfileState:
    st = ProfileState(params)
    if profile is not None:
        items, prefs, counts, vecs = _slots(profile)
        for slot in zip(vecs, items.tolist(), prefs.tolist(), counts.tolist(), unit_rows(vecs), strict=True):
            st.restore_slot(*slot)
        st.total, st.avg, st.matches, st.evictions = int(profile[1]), float(profile[2]), int(profile[3]), int(profile[4])
    return st


def snapshots(profiles: Iterable[tuple]) -> pd.DataFrame:
    """PROFILE rows as rows of the streams' output, one for each slot."""
    profiles = list(profiles)
    each = [_slots(p) for p in profiles]
    n = [len(items) for items, *_ in each]
    user, total, average, matches, evictions, late = ([p[k] for p in profiles] for k in range(6))
    whole = lambda values, kind=np.int64: np.repeat(np.array(values, dtype=kind), n)
    items, prefs, counts = (np.concatenate([e[k] for e in each]) if each else np.zeros(0) for k in range(3))
    return pd.DataFrame({
        "user_id": whole(user), "slot": np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0, np.int64), "item_id": items,
        "embedding": pd.Series([v for e in each for v in e[3]], dtype=object), "preference": prefs, "rewards_received": counts, "total_rewards": whole(total),
        "reward_average": whole(average, np.float64), "matches": whole(matches), "evictions": whole(evictions), "late_events": whole(late),
    })
