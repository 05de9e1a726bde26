"""A block of the exact search: memory bounded whatever the number of items, ties by id, exclusions."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from prefspark.operators import knn


def _frames(x, q, k):
    queries = pd.DataFrame({"user_id": np.arange(len(q)), "qvec": list(q), "k": k})
    return queries, pd.DataFrame({"item_id": np.arange(len(x)), "ivec": list(x)})


def test_scores_of_a_large_block_are_never_held_at_once():
    draw = np.random.default_rng(1)
    x, q = draw.standard_normal((60_000, 4)), draw.standard_normal((256, 4))
    queries, items = _frames(x, q, 3)
    tracemalloc.start()
    found = knn._block_fn("l2", ["user_id"])(queries, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20  # 256 x 60,000 scores are 123 MB
    for u in (0, 100, 255):
        near = np.argsort(((x - q[u]) ** 2).sum(1), kind="stable")[:3]
        assert found[found.user_id == u].item_id.tolist() == near.tolist()


def test_tiles_ties_and_exclusions(monkeypatch):
    monkeypatch.setattr(knn, "TILE", 7)
    monkeypatch.setattr(knn, "SCORE_BYTES", 200)
    draw = np.random.default_rng(2)
    x = np.tile(draw.standard_normal((20, 3)), (3, 1))  # each vector three times
    q = np.concatenate([x[:5], draw.standard_normal((4, 3))])
    for metric in ("l2", "dot"):
        queries, items = _frames(x, q, [0, 1, 2, 4, 5, 7, 59, 60, 100])
        items["item_id"] = items["item_id"].where(items["item_id"] != 41, 1)  # an id that two rows have
        gone = [None, [], [2], [3, 23], [1], list(range(30)), [0, 59], list(range(60)), [5]]
        queries["ex_ids"] = pd.Series([None if g is None else np.array(g) for g in gone], dtype=object)
        found = knn._block_fn(metric, ["user_id"])(queries, items)
        for u in range(len(q)):
            score = ((x - q[u]) ** 2).sum(1) if metric == "l2" else -(x @ q[u])
            left = [i for i in range(60) if items.item_id[i] not in (gone[u] or [])]
            want = sorted((round(float(score[i]), 9), int(items.item_id[i])) for i in left)[: queries.k[u]]
            assert found[found.user_id == u].item_id.tolist() == [i for _, i in want], (metric, u)
