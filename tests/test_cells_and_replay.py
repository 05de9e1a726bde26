"""Pruned nearest neighbours and the array replay: brute force, skipped cells, step-by-step equality."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefspark.functions.draws import py_uniform_text
from prefspark.operators import knn, knn_cells
from prefspark.operators import sweep as SW
from prefspark.operators.profile import FoldParams, ProfileState
from prefspark.operators.replay import PARAMS, Lanes, Replay


def clustered(n: int, d: int = 6, clusters: int = 12, seed: int = 0) -> np.ndarray:
    """Well separated clusters, one of which has a third of all rows, with repeated rows."""
    draw = np.random.default_rng(seed)
    centre = draw.standard_normal((clusters, d)) * 40
    home = np.where(draw.random(n) < 0.33, 0, draw.integers(0, clusters, n))
    x = (centre[home] + draw.standard_normal((n, d))).astype(np.float32)
    x[draw.integers(0, n, n // 10)] = x[draw.integers(0, n, n // 10)]
    return x.astype(np.float64)


def brute(q, x, ids, k, metric, seen=()):
    score = ((x - q) ** 2).sum(1) if metric == "l2" else -(x @ q)
    keep = np.array([i not in seen for i in ids])
    order = np.lexsort((ids[keep], score[keep]))[:k]
    return ids[keep][order].tolist()


@pytest.mark.parametrize(("metric", "cells"), [("l2", 12), ("dot", 12), ("l2", 40)])
def test_cells_against_brute_force(spark, metric, cells):
    x = clustered(600)
    ids = np.random.default_rng(1).permutation(5000)[:600]
    queries = {u: (x[u * 7] if u % 3 else x[u * 7] + 30.0, u % 5 + 1) for u in range(60)}
    draw = np.random.default_rng(2)
    seen = {u: set(draw.choice(ids, 500 if u == 0 else 20, replace=False).tolist()) for u in queries}
    items = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "item_id long, embedding array<double>")
    q = spark.createDataFrame([(u, v.tolist(), k) for u, (v, k) in queries.items()], "user_id long, query array<double>, k long")
    s = spark.createDataFrame([(u, int(i)) for u in seen for i in seen[u]], "user_id long, item_id long")
    for exclude in (None, s):
        rows = knn.block_topk(q, items, "k", metric=metric, query_block=16, item_block=50, exclude=exclude, cells=cells).collect()
        got = {u: [r.item_id for r in sorted((r for r in rows if r.user_id == u), key=lambda r: r.rank)] for u in queries}
        for u, (v, k) in queries.items():
            assert got[u] == brute(v, x, ids, k, metric, seen[u] if exclude is not None else ())


def test_most_cells_are_skipped(spark):
    x = clustered(2000)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, ivec array<double>")
    cells, _ = knn_cells.build(items, 24, 500)
    third = np.sort(((x[:, None, :200] - x[None, :300, :]) ** 2).sum(-1), axis=0)[3] ** 0.5
    q = spark.createDataFrame([(x[i].tolist(), float(third[i])) for i in range(300)], "qvec array<double>, reach double")
    met, pairs = knn_cells.n_met(q, cells)
    assert cells.n.sum() == 2000 and pairs == 300 * (len(cells.n) - 1)
    assert met < pairs / 4  # three of four cells are never compared
    everything, _ = knn_cells.n_met(q.withColumn("reach", F.lit(float("inf"))), cells)
    assert everything == pairs


def test_bounds_never_hide_an_item():
    for seed in range(6):
        x = clustered(400, d=3 + seed, seed=seed)
        pivots = knn_cells.fit_pivots(x[:150], 9)
        d = knn_cells.distances(x, pivots)
        home = d.argmin(1)
        near = d[np.arange(len(x)), home]
        n = np.bincount(home, minlength=len(pivots))
        low, high = (np.array([f(near[home == c]) if n[c] else 0.0 for c in range(len(pivots))]) for f in (np.min, np.max))
        cells = knn_cells.Cells(pivots, n, low, high, n, None)
        q = np.concatenate([x[::9], x[::17] * 1.3, np.zeros((1, x.shape[1]))])
        between = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(-1))
        for reach in (0.0, 1.0, 20.0):
            may = knn_cells.may_hold(q, np.full(len(q), reach), cells)
            own = np.where(n > 0, knn_cells.distances(q, pivots), np.inf).argmin(1)
            for i, j in zip(*np.nonzero(between <= reach), strict=True):
                assert may[i, home[j]] or own[i] == home[j]


def test_no_items_and_no_queries(spark):
    items = spark.createDataFrame([], "item_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "user_id long, query array<double>")
    one = spark.createDataFrame([(5, [1.0, 1.0])], "item_id long, embedding array<double>")
    for cells in (None, 3):
        assert knn.block_topk(q, items, 2, cells=cells).count() == 0
        assert knn.block_topk(q.limit(0), one, 2, cells=cells).count() == 0
        assert [r.item_id for r in knn.block_topk(q, one, 2, cells=cells).collect()] == [5]


# --- replay --------------------------------------------------------------------------------------


def one_by_one(configs, events, user, seed, min_samples):
    """Each run on its own, with the profile that the fold uses."""
    out = {}
    for config_id, (alpha, gamma, beta, most, rate, size) in configs:
        for profile in sorted({name for *_, rewards in events for name in rewards}):
            state = ProfileState(FoldParams(alpha=alpha, gamma=gamma, beta=beta, max_embeddings=int(most), min_samples=min_samples))
            for vec, event_id, category, rewards in events:
                if profile not in rewards:
                    continue
                cell = out.setdefault((config_id, profile, category), [0, 0, 0.0, 0.0])
                cell[0] += 1
                v = np.asarray(vec[: int(size)] if 0 < size < len(vec) else vec)
                unit = state.unit_of(v)
                key = f"{seed}:{config_id}:{user}:{event_id}"
                accept = not state.prefs or py_uniform_text(f"{key}:gate") < rate
                if not accept:
                    u, cum, chosen = py_uniform_text(f"{key}:slot"), 0.0, len(state.prefs) - 1
                    for s, p in enumerate(state.probabilities()):
                        cum += p
                        if cum > u:
                            chosen = s
                            break
                    accept = float(state.unit[chosen] @ unit) >= gamma
                if accept:
                    state.react(v, rewards[profile], None, unit)
                    cell[1] += 1
                    cell[2] += rewards[profile]
                    cell[3] += rewards[profile] ** 2
    return out


def all_cells(replay: Replay) -> dict:
    return {(replay.config_ids[c], profile, category): part[:, c].tolist() for (profile, category), part in replay.sums().items() for c in np.flatnonzero(part[0])}


@pytest.mark.parametrize("slack", [0, 1024])
def test_replay_equals_runs_one_by_one(monkeypatch, slack):
    monkeypatch.setattr("prefspark.operators.replay.STORE_SLACK", slack)
    draw = np.random.default_rng(7)
    grid = list(itertools.product([0.1, 0.5], [0.2, 0.8, 0.99], [0.5, 2.0], [0, 1, 6], [0.0, 0.3, 1.0], [0, 2, 5]))
    vectors = np.concatenate([draw.standard_normal((25, 5)), np.zeros((1, 5))])
    events = [(vectors[draw.integers(26)], k, f"c{k % 3}", {"p": float(draw.choice([10, -10])), **({"q": float(draw.choice([1, -3]))} if k % 4 else {})}) for k in range(120)]
    replay = Replay(list(range(len(grid))), np.array(grid), [f"9:{i}:3:" for i in range(len(grid))], 3)
    for e in events:
        replay.step(*e)
    assert not replay.failures()
    want = one_by_one(list(enumerate(grid)), events, 3, 9, 3)
    got = all_cells(replay)
    assert set(got) == set(want)
    for key, cell in want.items():
        assert got[key] == pytest.approx(cell, abs=1e-9), key
    assert replay.n_stored <= 2 * replay.m.sum() + slack + 1


def test_users_side_by_side_equal_runs_one_by_one():
    draw = np.random.default_rng(8)
    grid = list(itertools.product([0.1, 0.5], [0.2, 0.99], [2.0], [0, 1, 6], [0.0, 0.3, 1.0], [0, 2, 5]))
    vectors = np.concatenate([draw.standard_normal((25, 5)), np.zeros((1, 5))])
    users = {u: [(vectors[draw.integers(26)], k, f"c{k % 3}" if k % 5 else None, {"p": float(draw.choice([10, -10])), **({"q": float(draw.choice([1, -3]))} if k % 4 else {})})
                 for k in range(n)] for u, n in {4: 1, 7: 40, 9: 17, 11: 40, 12: 2}.items()}
    lanes = Lanes(list(range(len(grid))), np.array(grid), [[f"9:{i}:{u}:" for i in range(len(grid))] for u in users], list(users.values()), 3)
    assert not lanes.failures()
    want = {}
    for user, events in users.items():
        for key, cell in one_by_one(list(enumerate(grid)), events, user, 9, 3).items():
            want[key] = [a + b for a, b in zip(want.get(key, [0] * 4), cell, strict=True)]
    got = all_cells(lanes)
    assert set(got) == set(want)
    for key, cell in want.items():
        assert got[key] == pytest.approx(cell, abs=1e-9), key
    steps = Lanes([0, 1], np.array([[1e308, 0.5, 2, 3, 1.0, 0], [0.2, 0.5, 2, 3, 1.0, 0]]), [["1:0:1:", "1:1:1:"]], [[(np.array([1.0, k]), k, "c", {"p": 10.0 * (-1) ** k}) for k in range(6)]], 10)
    assert set(steps.failures()) == {("p", 0)} and all_cells(steps)[1, "p", "c"][1] == 6


def test_a_task_steps_users_together_and_long_histories_alone(monkeypatch):
    """The sums are the same whether users are replayed one by one or side by side."""
    from prefspark.plans import evaluation as EP

    together = []
    monkeypatch.setattr(SW, "Lanes", lambda *a: together.append(len(a[3])) or Lanes(*a))
    draw = np.random.default_rng(2)
    grid = EP.GRID | {"alpha": [0.2]}
    configs = SW.param_grid(grid)
    rows = []
    for user in range(30):
        head = {"cfg_block": 0, "user_id": user, "configs": configs, "vec": None, "event_id": None, "category": None, "rewards": None}
        rows += [head, *({**head, "configs": None, "vec": draw.standard_normal(4), "event_id": 100 * user + k, "category": f"c{k % 2}", "rewards": {"p": 10.0}} for k in range(1 + user))]
    pdf = pd.DataFrame(rows)
    cells = lambda: pd.concat(list(SW._replays(1, 3)(iter([pdf[:100], pdf[100:]])))).sort_values(["config_id", "category"]).reset_index(drop=True)
    side_by_side = cells()
    assert max(together) > 10
    together.clear()
    monkeypatch.setattr(SW, "LANE_EVENTS", 0)
    pd.testing.assert_frame_equal(side_by_side, cells())
    assert not together


def test_runs_that_overflow_are_reported():
    replay = Replay([0, 1], np.array([[1e308, 0.5, 2, 3, 1.0, 0], [0.2, 0.5, 2, 3, 1.0, 0]]), ["1:0:1:", "1:1:1:"], 10)
    for k in range(6):
        replay.step(np.array([1.0, k]), k, "c", {"p": 10.0 * (-1) ** k})
    assert set(replay.failures()) == {("p", 0)} and all_cells(replay)[1, "p", "c"][1] == 6


def test_grid_is_the_product_in_order(spark):
    grid = {"alpha": [0.2, 0.4], "gamma": [0.1, 0.2, 0.3], "beta": [2], "max_embeddings": [20, 5], "exp_rate": [0.5], "n_components": [8, 64]}
    rows = [tuple(r) for r in SW.grid_frame(spark, grid).orderBy("config_id").collect()]
    assert rows == [(c["config_id"], *(c[p] for p in PARAMS)) for c in SW.param_grid(grid)]


def test_unmatched_reactions_have_a_reason(spark):
    from prefspark.operators import evaluate as EV
    from prefspark.sources import tables as T

    from .conftest import SF001

    items, reactions = T.items(spark, SF001), T.reactions(spark, SF001)
    lost = EV.unmatched(reactions, items.where("item_id % 7 != 0"), "item_id", "no such item")
    assert {r.reason for r in lost.collect()} == {"no such item"}
    assert sorted(r.event_id for r in lost.collect()) == sorted(r.event_id for r in reactions.where("item_id % 7 = 0").collect())
    assert EV.unmatched(reactions, items, "item_id", "no such item").count() == 0
