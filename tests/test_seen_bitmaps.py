"""Seen sets as bitmaps against Python sets."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from prefspark.operators import knn, seen

PAIR = "user_id long, item_id long"
N = 3 * seen.BLOCK_ITEMS


def _sets() -> dict[int, set[int]]:
    rng = random.Random(1)
    edge = [0, 1, 7, 8, 32766, 32767, 32768, 32769, 65535, 65536, N - 1]
    return {
        1: set(edge),
        2: set(range(32768)),  # the first block is full, the others have no row
        3: set(range(40000)),
        4: {5},
        5: set(range(32768)) | set(range(65536, N)),  # a gap of one block
        6: set(range(N)),  # everything
        7: {rng.randrange(N) for _ in range(20000)} | set(range(300)),
    }


def _table(spark, sets):
    whole = {u: s for u, s in sets.items() if s}
    parts = None
    for u, s in whole.items():
        ids = spark.createDataFrame([(u, sorted(s))], "user_id long, ids array<long>").select("user_id", F.explode("ids").alias("item_id"))
        parts = ids if parts is None else parts.unionByName(ids)
    return parts


def test_sizes_and_first_available(spark):
    sets = _sets()
    rows = _table(spark, sets)
    noise = spark.createDataFrame([(None, 1), (4, None), (4, 5), (8, None)], PAIR)
    bitmaps = seen.seen_bitmaps(rows.unionByName(noise)).cache()
    found = {r.user_id: (r.n_seen, r.n_available, r.first_available) for r in seen.available_items(bitmaps, F.lit(N)).collect()}
    want = {u: (len(s), N - len(s), next((i for i in range(N) if i not in s), None)) for u, s in sets.items()}
    assert found == want
    pairs = {u: set() for u in sets}
    for r in seen.seen_pairs(bitmaps).groupBy("user_id").agg(F.collect_list("item_id").alias("ids")).collect():
        assert len(r.ids) == len(set(r.ids))
        pairs[r.user_id] = set(r.ids)
    assert pairs == sets
    for u in (1, 7):
        held = bitmaps.where(F.col("user_id") == u).collect()
        hit = seen.contains([r.block for r in held], [bytes(r.bitmap) for r in held], np.arange(N))
        assert set(np.flatnonzero(hit).tolist()) == sets[u]


def test_merging_again_changes_nothing(spark):
    a = spark.createDataFrame([(1, 3), (1, 40000), (2, 9)], PAIR)
    run = spark.createDataFrame([(1, 3), (1, 4), (3, 0)], PAIR)
    once = seen.mark_consumed(seen.seen_bitmaps(a), run)
    twice = seen.mark_consumed(once, run)
    rows = lambda df: sorted((r.user_id, r.block, bytes(r.bitmap)) for r in df.collect())
    assert rows(once) == rows(twice) == rows(seen.merge(twice, once))
    assert sorted(tuple(r) for r in seen.sizes(once).collect()) == [(1, 3), (2, 1), (3, 1)]
    empty = seen.seen_bitmaps(spark.createDataFrame([], PAIR))
    assert empty.collect() == [] and seen.available_items(empty, F.lit(5)).collect() == [] and seen.seen_pairs(empty).collect() == []
    assert rows(seen.mark_consumed(empty, run)) == rows(seen.seen_bitmaps(run))


def test_search_without_seen_items(spark):
    """By bitmaps, by ids and by brute force; in one item block and through pivot cells."""
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((400, 4)), rng.standard_normal((5, 4))
    sets = {0: set(range(0, 400, 2)), 1: set(range(397)), 2: set(), 3: {1, 2, 3}, 4: set(range(400))}
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")
    queries = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(q)], "user_id long, query array<double>")
    pairs = spark.createDataFrame([(u, i) for u, s in sets.items() for i in s], PAIR)
    want = []
    for u in range(5):
        near = sorted((float(((x[i] - q[u]) ** 2).sum()), i) for i in range(400) if i not in sets[u])[:6]
        want += [(u, i, rank) for rank, (_, i) in enumerate(near, 1)]
    want.sort()
    rows = lambda df: sorted(tuple(r) for r in df.select("user_id", "item_id", "rank").collect())
    bitmaps = seen.seen_bitmaps(pairs)
    assert rows(knn.knn_unseen_bitmaps(queries, items, bitmaps, 6)) == want == rows(knn.knn_unseen_exact(queries, items, pairs, 6))
    assert rows(knn.block_topk(queries, items, 6, cells=8, exclude_bitmaps=bitmaps)) == want


def test_a_set_of_few_items_is_a_few_bytes(spark):
    """Ten bytes a word of 64 items that holds any, whatever the block; every bit of a word counts."""
    few = [0, 63, 64, 20000, 5 * seen.BLOCK_ITEMS + 1]
    rows = [(1, i) for i in few] + [(2, i) for i in range(63)] + [(3, i) for i in range(128)]
    bitmaps = seen.seen_bitmaps(spark.createDataFrame(rows, PAIR)).cache()
    assert {(r.user_id, r.block): len(r.bitmap) for r in bitmaps.collect()} == {(1, 1): 30, (1, 6): 10, (2, 1): 10, (3, 1): 20}
    found = {r.user_id: (r.n_seen, r.first_available) for r in seen.available_items(bitmaps, F.lit(N)).collect()}
    assert found == {1: (5, 1), 2: (63, 63), 3: (128, 128)}
