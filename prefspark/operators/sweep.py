"""Parameter sweep by offline replay of logged reactions.

The reference plays a policy against an invented user; the data job here is
*which settings would have done well on the reactions we logged*.  Per
(configuration, preference profile, user), in event order, the current profile
draws the explore gate and a slot (keyed draws); the event is accepted when the
gate explores, when the profile is empty, or when the event's item matches the
drawn slot (cosine >= gamma).  Accepted events are scored with the profile's
Bernoulli reward and folded into the state; the rest are skipped (replay
evaluation at slot granularity).

Layout: reactions (with one reward per profile in a map) are shuffled once per
configuration block, behind one row with the block's configurations; a task streams
its users' events in order and steps all runs of a block at once (``replay``).
Block sizes are chosen per user from its event count, so a hot user's configurations
are spread over several tasks. A task adds up its users' sums by (config, profile,
category) before they are shuffled; SQL makes them one row per (config, profile).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.operators.evaluate import MAX_LOOKUP_ROWS, checked_broadcast
from prefspark.operators.replay import PARAMS, Lanes, Replay
from prefspark.session import materialize, ship_package

PARAM_ORDER = PARAMS
MIN_SAMPLES = 10  # the evaluation fixes min_samples_before_removal at 10
CONFIGS_PER_TASK = 512
STEPS_PER_TASK = 20_000_000  # of an event under one configuration
HELD_CONFIGS = 65_536  # configurations whose sums a task collects before it gives them out
LANE_EVENTS = 512  # a user with more is replayed as its events come, the others many at a time
LANE_RUNS = 8192  # runs that are stepped together
LANE_PLACES = 65_536  # users x events of the longest of them that are held for it
_WHOLE = ("max_embeddings", "n_components")


def param_grid(grid: dict[str, list]) -> list[dict]:
    """Cartesian product in the grid's parameter order; ``config_id`` = position."""
    names = [p for p in PARAM_ORDER if p in grid]
    out = []
    for i, combo in enumerate(itertools.product(*[grid[n] for n in names])):
        cfg = dict(zip(names, combo))
        cfg["config_id"] = i
        out.append(cfg)
    return out


def grid_frame(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """F9 as a table: the parameters' values crossed; ``config_id`` is the position in the product's order."""
    crossed = spark.range(1)
    for p in PARAM_ORDER:
        values = [F.lit(int(v) if p in _WHOLE else float(v)).cast("long" if p in _WHOLE else "double") for v in grid[p]]
        crossed = crossed.select("*", F.posexplode(F.array(*values)).alias(f"_{p}", p))
    place = reduce(lambda acc, p: acc * len(grid[p]) + F.col(f"_{p}"), PARAM_ORDER, F.lit(0).cast("long"))
    return crossed.select(place.alias("config_id"), *PARAM_ORDER)


def _listed(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """Chosen configurations (dicts as ``param_grid`` gives them) as a table."""
    kinds = ", ".join(f"{p} {'long' if p in _WHOLE else 'double'}" for p in PARAM_ORDER)
    rows = [(int(c["config_id"]), *(int(c[p]) if p in _WHOLE else float(c[p]) for p in PARAM_ORDER)) for c in configs]
    return spark.createDataFrame(rows, f"config_id long, {kinds}")


_CELLS = (
    "config_id long, profile string, category string, n_events long, n_accepted long, "
    "sum_reward double, sum_sq_reward double, error string"
)


class _Held:
    """Sums of one block of configurations over a task's users."""

    def __init__(self, ids: list[int]):
        self.ids, self.sums, self.errors = ids, {}, {}

    def add(self, replay: Replay | Lanes) -> None:
        for key, part in replay.sums().items():
            self.sums[key] = self.sums.get(key, 0.0) + part
        for key, error in replay.failures().items():
            self.errors[key] = max(error, self.errors.get(key, error))

    def rows(self) -> pd.DataFrame:
        out = []
        for (profile, category), (n, accepted, total, squares) in self.sums.items():
            met = np.flatnonzero(n)
            out.append(pd.DataFrame({
                "config_id": np.array(self.ids)[met], "profile": profile, "category": pd.Series([category] * len(met), dtype=object),
                "n_events": n[met].astype(np.int64), "n_accepted": accepted[met].astype(np.int64), "sum_reward": total[met], "sum_sq_reward": squares[met],
                "error": pd.Series([self.errors.get((profile, c)) for c in met.tolist()], dtype=object),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in _CELLS.split(", ")])


class _Task:
    """The replays of a task: users with few events wait until enough of them can be stepped together."""

    def __init__(self, seed: int, min_samples: int):
        self.seed, self.min_samples = seed, min_samples
        self.held: dict[tuple[int, int], _Held] = {}
        self.size = 0
        self.ids: list[int] = []
        self.waiting: list[tuple[int, list[tuple]]] = []
        self.longest = 0
        self.user, self.events, self.replay = 0, [], None

    def begin(self, configs: list[dict], user: int) -> Iterator[pd.DataFrame]:
        """A user's events follow, under these configurations; what was collected, if that has become too much."""
        self.end()
        ids = [int(c["config_id"]) for c in configs]
        if ids != self.ids:
            self.play()
            self.ids, self.params = ids, np.array([[c[p] for p in PARAMS] for c in configs], np.float64)
        block = ids[0], len(ids)  # blocks are runs of the grid
        if block not in self.held:
            self.size += len(ids)
            if self.size > HELD_CONFIGS:
                yield from self.rows()
                self.held, self.size = {}, len(ids)
            self.held[block] = _Held(ids)
        self.here, self.user = self.held[block], user

    def event(self, *event) -> None:
        if self.replay:
            self.replay.step(*event)
            return
        self.events.append(event)
        if len(self.events) > LANE_EVENTS:
            self._alone()

    def _prefix(self, user: int) -> list[str]:
        return [f"{self.seed}:{i}:{user}:" for i in self.ids]

    def _alone(self) -> None:
        self.replay = Replay(self.ids, self.params, self._prefix(self.user), self.min_samples)
        for event in self.events:
            self.replay.step(*event)
        self.events = []

    def end(self) -> None:
        """The user has no more events."""
        if self.events and len({np.shape(vec) for vec, *_ in self.events}) > 1:
            self._alone()  # which reports what doesn't fit
        if self.replay:
            self.here.add(self.replay)
        elif self.events:
            self.waiting.append((self.user, self.events))
            profiles = {name for _, events in self.waiting[:1] for *_, rewards in events for name in rewards}
            self.longest = max(self.longest, len(self.events))
            if len(self.waiting) * len(self.ids) * max(1, len(profiles)) >= LANE_RUNS or len(self.waiting) * self.longest >= LANE_PLACES:
                self.play()
        self.events, self.replay = [], None

    def play(self) -> None:
        if self.waiting:
            self.here.add(Lanes(self.ids, self.params, [self._prefix(u) for u, _ in self.waiting], [events for _, events in self.waiting], self.min_samples))
            self.waiting, self.longest = [], 0

    def rows(self) -> Iterator[pd.DataFrame]:
        return (h.rows() for h in self.held.values())


def _replays(seed: int, min_samples: int):
    """Rows sorted by (block, user, configurations first, time): every user's replay, summed up over the task's users."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, group = _Task(seed, min_samples), None
        for pdf in batches:
            blocks, users = pdf["cfg_block"].to_numpy(), pdf["user_id"].to_numpy()
            columns = [pdf[c].to_numpy() for c in ("configs", "vec", "event_id", "category", "rewards")]
            for j, (configs, vec, event_id, category, rewards) in enumerate(zip(*columns, strict=True)):
                if (blocks[j], users[j]) != group:
                    group = (blocks[j], users[j])
                    yield from task.begin(configs, int(users[j]))
                else:
                    task.event(np.asarray(vec, np.float64), int(event_id), category, dict(rewards))
        task.end()
        task.play()
        yield from task.rows()

    return run


def sweep_replay(
    events: DataFrame, preferences: DataFrame, grid: DataFrame | list[dict], seed: int = 42, configs_per_task: int = CONFIGS_PER_TASK,
    min_samples: int = MIN_SAMPLES, partitions: int | None = None, steps_per_task: int = STEPS_PER_TASK,
) -> DataFrame:
    """one result row per (configuration, preference profile).

    ``events``: user_id, ts, event_id, vec, category, ``rewards`` (map profile ->
    reward, see ``evaluate.bernoulli_reward_map``): one row per event, so each
    event and its vector are shuffled once per configuration block only. ``grid``:
    the configurations (``grid_frame``), or a list of chosen ones.

    ``n_components`` takes that many leading coordinates of ``vec`` (0: all) and
    normalises them; over ``features.nested_catalogue`` these are the reduced
    catalogues of that many components.
    """
    spark = events.sparkSession
    ship_package(spark)
    grid = _listed(spark, grid) if isinstance(grid, list) else grid
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Configurations per task, per user: a user with many events gets fewer per task
    # (down to one), so a hot user's replay is spread over up to one task per
    # configuration; ordinary users keep ``configs_per_task`` and are replicated less.
    # Users with fewer are listed by themselves, so that the events, which carry the
    # vectors, meet a small table and are shuffled once only.
    per_user = events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    cpt = F.greatest(F.lit(1), F.least(F.lit(configs_per_task), (F.lit(steps_per_task) / F.col("_n")).cast("int")))
    sized = materialize(per_user.select("user_id", cpt.alias("_cpt")), "sweep-users")
    hot = checked_broadcast(sized.where(F.col("_cpt") < configs_per_task))
    placed = grid.withColumn("_at", F.row_number().over(Window.orderBy("config_id")) - 1)  # the grid is configuration, not data
    # One row for each block of each block size that occurs, with its (at most ``configs_per_task``) configurations.
    blocks = sized.select("_cpt").distinct().crossJoin(placed).groupBy("_cpt", F.floor(F.col("_at") / F.col("_cpt")).cast("int").alias("cfg_block"))
    blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("config_id", *PARAM_ORDER))).alias("configs"))
    by_user = sized.join(blocks, "_cpt").select("user_id", "cfg_block", "configs")
    event_cols = ["ts", "event_id", "vec", "category", "rewards"]
    kinds = {f.name: f.dataType for f in events.select(*event_cols).schema.fields}
    heads = by_user.select("cfg_block", "user_id", F.lit(0).alias("kind"), "configs", *[F.lit(None).cast(kinds[c]).alias(c) for c in event_cols])
    n_blocks = F.ceil(F.lit(grid.count()) / F.coalesce("_cpt", F.lit(configs_per_task))).cast("int")
    each = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1))
    steps = events.where(F.col("user_id").isNotNull()).join(hot, "user_id", "left").select(
        F.explode(each).alias("cfg_block"), "user_id", F.lit(1).alias("kind"), F.lit(None).cast(heads.schema["configs"].dataType).alias("configs"), *event_cols,
    )
    ordered = heads.unionByName(steps).repartition(n, "cfg_block", "user_id").sortWithinPartitions("cfg_block", "user_id", "kind", "ts", "event_id")
    return summarise(ordered.mapInPandas(_replays(seed, min_samples), _CELLS), preferences, grid)


def summarise(cells: DataFrame, preferences: DataFrame, grid: DataFrame) -> DataFrame:
    """F4-F8 per (config, profile) from the tasks' (config, profile, category) sums.

    The replay's output has a single consumer (one aggregate), and each
    (config, profile) row then carries its bounded per-category list, so the
    replay runs exactly once; alignment, diversity and the zero-filled counts are
    array expressions on that row.
    """
    per_cat = cells.groupBy("config_id", "profile", "category").agg(
        F.sum("n_events").alias("n_events"), F.sum("n_accepted").alias("n_acc"),
        F.sum("sum_reward").alias("s"), F.sum("sum_sq_reward").alias("s2"), F.max("error").alias("error"),
    )
    per_run = per_cat.groupBy("config_id", "profile").agg(
        F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "n_events", "n_acc", "s", "s2"))).alias("cats"),
        F.max("error").alias("error"),
    )
    prof = preferences.groupBy("profile").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "p"))).alias("p_map"),
        F.sum(F.col("p") * F.col("p")).alias("sum_p2"),
        F.array_sort(F.collect_set("category")).alias("all_cats"),
    )
    small = preferences.limit(MAX_LOOKUP_ROWS + 1).count() <= MAX_LOOKUP_ROWS  # ``prof`` holds them all, by profile
    cats = F.col("cats")

    def total(field):
        return F.aggregate(cats, F.lit(0.0), lambda acc, c: acc + c[field].cast("double"))

    n_acc = total("n_acc")
    ok = F.col("error").isNull()  # a configuration that failed has no metrics, only its counts so far
    q = lambda c: c["n_acc"] / n_acc
    part = F.aggregate(cats, F.lit(0.0), lambda acc, c: acc + q(c) * q(c) - 2 * F.coalesce(F.col("p_map")[c["category"]], F.lit(0.0)) * q(c))
    entropy = F.aggregate(F.filter(cats, lambda c: c["n_acc"] > 0), F.lit(0.0), lambda acc, c: acc + q(c) * F.log(q(c)))
    obs = F.map_from_entries(F.transform(cats, lambda c: F.struct(c["category"], c["n_acc"])))
    avg = F.try_divide(F.col("total_reward"), F.col("n_accepted"))
    var = F.try_divide(F.col("_s2"), F.col("n_accepted")) - avg * avg
    params = F.struct(*[F.col(p) for p in PARAM_ORDER]).alias("params")
    res = per_run.join(F.broadcast(prof) if small else prof, "profile").join(checked_broadcast(grid), "config_id").select(
        "*",
        total("s").alias("total_reward"), total("s2").alias("_s2"),
        n_acc.cast("long").alias("n_accepted"), total("n_events").cast("long").alias("n_events"),
    )
    return res.select(
        "config_id",
        params,
        F.col("profile").alias("preference_type"),
        F.when(ok, F.col("total_reward")).alias("total_reward"),
        F.when(ok, avg).alias("avg_reward"),
        F.when(ok, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("reward_std"),
        F.when(ok & (F.col("n_accepted") > 0), -(F.col("sum_p2") + part)).alias("preference_alignment"),
        F.when(ok, F.when(F.col("n_accepted") > 0, -entropy).otherwise(F.lit(0.0))).alias("diversity_score"),
        F.map_from_arrays(
            F.col("all_cats"), F.transform("all_cats", lambda k: F.coalesce(obs[k], F.lit(0)).cast("long"))
        ).alias("result_preferences"),
        "n_accepted",
        "n_events",
        "error",
    )
