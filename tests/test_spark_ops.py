"""Spark operators against brute force, fixtures and their own invariants."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.functions import draws
from prefspark.functions import vectors as V
from prefspark.operators import evaluate as EV
from prefspark.operators import knn
from prefspark.operators import mapview as MV
from prefspark.operators import profile as P
from prefspark.plans import profiles as PP
from prefspark.sources import ingest as I
from prefspark.sources import tables as T

from .conftest import SF001, SF01


def _items_np(spark, sf):
    rows = T.items(spark, sf).select("item_id", "embedding").orderBy("item_id").collect()
    return np.array([r.item_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)


def test_block_topk_matches_brute_force_with_many_blocks(spark):
    ids, X = _items_np(spark, SF001)
    queries = T.items(spark, SF001).select(F.col("item_id").alias("user_id"), F.col("embedding").alias("query"))
    res = knn.block_topk(queries, T.items(spark, SF001), 5, metric="l2", query_block=37, item_block=60).collect()
    got = {}
    for r in res:
        got.setdefault(r.user_id, []).append((r.rank, r.item_id))
    d = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    for qi, q in enumerate(ids):
        order = np.lexsort((ids, d[qi]))[:5]
        assert [i for _, i in sorted(got[q])] == list(ids[order])


def test_dot_metric_and_per_query_k(spark):
    ids, X = _items_np(spark, SF001)
    queries = T.items(spark, SF001).select(
        F.col("item_id").alias("user_id"), F.col("embedding").alias("query"), (F.col("item_id") % 4 + 1).alias("k")
    )
    res = knn.block_topk(queries, T.items(spark, SF001), "k", metric="dot", query_block=50, item_block=90).collect()
    counts = {}
    for r in res:
        counts[r.user_id] = counts.get(r.user_id, 0) + 1
    assert all(counts[q] == q % 4 + 1 for q in ids)
    s = X @ X.T
    for r in res:
        if r.rank == 1:
            assert r.item_id == ids[np.lexsort((ids, -s[list(ids).index(r.user_id)]))[0]]


def test_unseen_modes_agree_when_nothing_seen(spark):
    items = T.items(spark, SF001)
    q = items.where(F.col("item_id") < 30).select(F.col("item_id").alias("user_id"), F.col("embedding").alias("query"))
    empty_seen = spark.createDataFrame([], "user_id long, item_id long")
    exact = knn.knn_unseen_exact(q, items, empty_seen, 1).select("user_id", "item_id")
    ref = knn.knn_unseen(q, items, empty_seen, T.n_items(spark, SF001), 10).select("user_id", "item_id")
    assert sorted(exact.collect()) == sorted(ref.collect())


def test_user_who_has_seen_everything_gets_no_row(spark):
    items = T.items(spark, SF001).where(F.col("item_id") < 5)
    q = spark.createDataFrame([(1, [1.0] + [0.0] * 63)], "user_id long, query array<double>")
    seen = spark.createDataFrame([(1, i) for i in range(5)], "user_id long, item_id long")
    out = knn.knn_unseen(q, items, seen, F.lit(5), 10)
    assert out.count() == 0


def test_fallback_is_lowest_available_id(spark):
    items = T.items(spark, SF001)
    q = items.where("item_id = 7").select(F.lit(1).cast("long").alias("user_id"), F.col("embedding").alias("query"))
    top = knn.block_topk(q, items, 30, metric="l2").select("item_id").collect()
    seen = spark.createDataFrame([(1, r.item_id) for r in top], "user_id long, item_id long")
    out = knn.knn_unseen(q, items, seen, T.n_items(spark, SF001), 10).collect()
    expect = min(set(range(500)) - {r.item_id for r in top})
    assert out[0].item_id == expect and out[0].fallback


def test_draws_identical_in_python_spark_duckdb(spark):
    df = spark.range(200).select(F.col("id").alias("k"), draws.uniform(42, F.col("id"), "x").alias("u"),
                                 draws.normal(42, F.col("id"), "x").alias("z"))
    got = {r.k: (r.u, r.z) for r in df.collect()}
    duck = duckdb.sql(f"SELECT range AS k, {draws.sql_uniform('42', 'range', repr('x'))} AS u, "
                      f"{draws.sql_normal('42', 'range', repr('x'))} AS z FROM range(200)").fetchall()
    for k, u, z in duck:
        assert got[k][0] == u == draws.py_uniform(42, k, "x")
        assert got[k][1] == pytest.approx(z, abs=1e-12) and got[k][1] == pytest.approx(draws.py_normal(42, k, "x"), abs=1e-12)


def test_random_unit_vector_has_unit_norm(spark):
    df = draws.with_random_unit_vector(spark.range(20).withColumnRenamed("id", "user_id"), "v", 42, 16, F.col("user_id"))
    for r in df.collect():
        assert len(r.v) == 16 and np.linalg.norm(r.v) == pytest.approx(1.0)


def test_vector_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine("a", "b").alias("c"), V.l2_normalise("b", as_float=False).alias("n")).first()
    assert r.c == 0.0 and r.n == [0.0, 0.0]
    bad = spark.createDataFrame([([1.0, 0.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception):
        bad.select(V.cosine("a", "b")).collect()


def test_parse_vector_quarantine(spark):
    df = spark.createDataFrame([("[0.1, -2e-05, 1]",), ("[0.1, x]",), ("(1,2)",)], "s string")
    good, bad = I.split_valid_vectors(df, "s")
    g = good.collect()
    assert len(g) == 1 and g[0].s == pytest.approx([0.1, -2e-05, 1.0], rel=1e-6)
    assert bad.count() == 2


def test_csv_empty_string_and_file_category(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "alt.atheism.csv").write_text('"filename","embedding"\n"1",""\n"2","[1, 2]"\n')
    out = I.read_csv_strings(spark, [str(d)], ["filename", "embedding"]).collect()
    assert sorted((r.filename, r.embedding) for r in out) == [("1", ""), ("2", "[1, 2]")]
    cat = I.with_category_from_file(spark.read.option("header", True).csv(str(d))).select("category").distinct().collect()
    assert [r.category for r in cat] == ["alt.atheism"]


def test_scan_text_files_relative_keys(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.txt").write_bytes(b"caf\xc3\xa9 ok")
    (root / "y.txt").write_bytes(b"bad \xff byte")
    got = {r.item_key: r.text for r in I.scan_text_files(spark, str(root)).collect()}
    assert got == {"a/x.txt": "café ok", "y.txt": "bad � byte"}


def test_validate_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        I.validate_inputs(spark, [str(tmp_path / "missing.csv")])
    df = spark.createDataFrame([(1,)], "filename long")
    with pytest.raises(KeyError):
        I.validate_inputs(spark, [], df, ("filename", "category"))


def test_duplicate_key_last_wins(spark):
    df = spark.createDataFrame([("k", "a", 0), ("k", "b", 1), ("j", "c", 2)], "item_key string, category string, item_id long")
    got = {r.item_key: (r.item_id, r.category) for r in I.item_key_lookup(df).collect()}
    assert got == {"k": (1, "b"), "j": (2, "c")}


def test_assign_positions_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    pos = I.assign_positions(df, [F.col("x")], partitions=7).orderBy("x").collect()
    assert [r.position for r in pos] == list(range(1000))


def test_map_edge_cases(spark):
    prof = spark.createDataFrame([(1, 0, 0.3, 2), (1, 1, 0.3, 2)], "user_id long, slot long, preference double, rewards_received long")
    pts = MV.map_points(prof).collect()
    assert all(p.point_size == 275.0 and p.color == 0.5 for p in pts)


def test_metric_edge_cases(spark):
    counts = spark.createDataFrame([("r", "a", 2), ("r", "b", 2)], "run string, category string, n long")
    prefs = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.5), ("p", "c", 0.5)], "profile string, category string, p double")
    out = EV.alignment_and_diversity(counts, ["run"], prefs, F.lit("p")).first()
    assert out.diversity_score == pytest.approx(np.log(2))
    counts2 = spark.createDataFrame([("r", "a", 1), ("r", "b", 3)], "run string, category string, n long")
    prefs2 = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.5)], "profile string, category string, p double")
    assert EV.alignment_and_diversity(counts2, ["run"], prefs2, F.lit("p")).first().preference_alignment == pytest.approx(-0.125)


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(0.1 * i, 1.0, float(i % 3)) for i in range(10)], "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.corr for r in EV.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] is None and got[("a", "a")] == pytest.approx(1.0)


def test_fold_coverage_table(spark):
    """FIXTURES.md section 3: matches, evictions and slots at sf0.01."""
    expect = {(0.95, 100): (581, 0, 47, 81), (0.28, 20): (2130, 4720, 21, 21), (0.28, 10): (1259, 7091, 11, 11),
              (0.2, 20): (5823, 1032, 18, 21)}
    for (g, m), want in expect.items():
        snap = PP.folded(spark, SF01, P.FoldParams(alpha=0.2, gamma=g, beta=2, max_embeddings=m, min_samples=3))
        u = snap.groupBy("user_id").agg(F.first("matches").alias("m"), F.first("evictions").alias("e"), F.count("*").alias("s"))
        r = u.agg(F.sum("m"), F.sum("e"), F.min("s"), F.max("s")).first()
        assert tuple(r) == want


def test_fold_independent_of_partitioning(spark):
    rv = PP.reactions_with_vec(spark, SF001)
    a = P.fold_profiles(rv, PP.EVICTING, partitions=3).select("user_id", "slot", "item_id", F.round("preference", 9).alias("p"))
    b = P.fold_profiles(rv.repartition(11), PP.EVICTING, partitions=11).select(
        "user_id", "slot", "item_id", F.round("preference", 9).alias("p"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_resume_equals_full_fold(spark):
    rv = PP.reactions_with_vec(spark, SF001)
    cut = rv.approxQuantile("event_id", [0.5], 0.0)[0]
    snap = P.fold_profiles(rv.where(F.col("event_id") < cut), PP.EVICTING)
    resumed = P.resume_profiles(snap, rv.where(F.col("event_id") >= cut), PP.EVICTING)
    full = P.fold_profiles(rv, PP.EVICTING)
    cols = ["user_id", "slot", "item_id", "rewards_received", "total_rewards"]
    sel = lambda d: sorted(d.select(*cols, F.round("preference", 9)).collect())
    assert sel(resumed) == sel(full)


def test_pca_subspace_matches_numpy(spark):
    from prefspark.operators import features as FE

    _ids, X = _items_np(spark, SF001)
    k = 8
    model = FE.fit_catalogue(T.items(spark, SF001), k)
    pc = FE.pca_components(model)  # d x k
    Z = (X - X.mean(0)) / np.where(X.std(0) == 0, 1, X.std(0))
    w, v = np.linalg.eigh(np.cov(Z, rowvar=False))
    top = v[:, np.argsort(w)[::-1][:k]]
    assert np.allclose(pc @ pc.T, top @ top.T, atol=1e-8)  # same subspace, signs free
    cat = FE.transform_catalogue(model, T.items(spark, SF001)).select("embedding").collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 and len(r.embedding) == k for r in cat)


def test_project_2d_matches_numpy(spark):
    from prefspark.operators import features as FE

    prof = spark.createDataFrame(
        [(1, i, [float(i), float(i * i % 5), 1.0]) for i in range(6)] + [(2, 0, [1.0, 2.0, 3.0])],
        "user_id long, slot long, embedding array<float>",
    )
    got = {(r.user_id, r.slot): (r.x, r.y) for r in FE.project_2d(prof).collect()}
    assert got[(2, 0)] == (0.0, 0.0)
    X = np.array([[float(i), float(i * i % 5), 1.0] for i in range(6)])
    C = X - X.mean(0)
    _, _, vt = np.linalg.svd(C)
    proj = C @ vt[:2].T
    for i in range(6):
        assert abs(abs(got[(1, i)][0]) - abs(proj[i, 0])) < 1e-6 and abs(abs(got[(1, i)][1]) - abs(proj[i, 1])) < 1e-6


def test_ordered_scan_with_hot_key_matches_window(spark):
    from pyspark.sql import Window

    from prefspark.operators.scan import mean_before, ordered_scan

    # key 0 holds 6,000 of 6,300 rows: it must span several range partitions.
    df = spark.range(6300).select(
        F.when(F.col("id") < 6000, F.lit(0)).otherwise(F.col("id") % 7 + 1).cast("long").alias("k"),
        (F.col("id") * 7919 % 6300).alias("t"),
        (F.col("id") % 13).cast("double").alias("v"),
    )
    got = ordered_scan(df, "k", ["t"], "v", partitions=9).select("k", "t", "position", mean_before().alias("m"))
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", (F.row_number().over(w) - 1).alias("position"),
                     F.coalesce(F.avg("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("m"))
    g = sorted((r.k, r.t, r.position, round(r.m, 9)) for r in got.collect())
    e = sorted((r.k, r.t, r.position, round(r.m, 9)) for r in want.collect())
    assert g == e
    pids = df.repartitionByRange(9, "k", "t").where("k = 0").select(F.spark_partition_id()).distinct().count()
    assert pids > 1


def test_sweep_invariants(spark):
    from prefspark.plans import evaluation as EP

    res = EP.sweep(spark, SF001, {**EP.GRID, "alpha": [0.2], "beta": [2.0]}).collect()
    assert len(res) == 3 * 2 * 2  # gamma x exp_rate x profile
    totals = {r.profile: (r.n, r.s) for r in EP.scored(spark, SF001).groupBy("profile").agg(
        F.count("*").alias("n"), F.sum("sim_reward").alias("s")).collect()}
    for r in res:
        assert r.n_accepted <= r.n_events and r.error is None
        assert sum(r.result_preferences.values()) == r.n_accepted
        if r.params.exp_rate == 1.0:
            assert (r.n_accepted, r.total_reward) == totals[r.preference_type]
        else:
            assert r.n_accepted < r.n_events


def test_stream_counts_late_events(spark, tmp_path):
    from prefspark.streaming import profiles as S

    base = PP.reactions_with_vec(spark, SF001).select("user_id", "ts", "event_id", "item_id", "reward", "vec")
    cut = base.approxQuantile("event_id", [0.5], 0.0)[0]
    src = str(tmp_path / "src")
    # Newer half first, older half second: the older rows arrive late.
    base.where(F.col("event_id") >= cut).coalesce(1).write.parquet(src)
    base.where(F.col("event_id") < cut).coalesce(1).write.mode("append").parquet(src)
    S.run_profile_stream(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), PP.EXACT)
    snap = S.latest_snapshot(spark.read.parquet(str(tmp_path / "out")))
    late = snap.groupBy("user_id").agg(F.first("late_events").alias("late"), F.first("total_rewards").alias("t"))
    r = late.agg(F.sum("late"), F.sum("t")).first()
    assert r[1] == base.count() and r[0] > 0


def test_exclusion_exact_when_most_items_are_seen(spark):
    ids, X = _items_np(spark, SF001)
    rng = np.random.default_rng(3)
    users = list(range(12))
    seen = {u: set(rng.choice(ids, size=(450 if u == 0 else 30), replace=False).tolist()) for u in users}
    qv = {u: X[rng.integers(0, len(ids))] for u in users}
    q = spark.createDataFrame([(u, qv[u].tolist()) for u in users], "user_id long, query array<double>")
    s = spark.createDataFrame([(u, int(i)) for u in users for i in seen[u]], "user_id long, item_id long")
    got = knn.block_topk(q, T.items(spark, SF001), 4, metric="l2", query_block=5, item_block=70, exclude=s).collect()
    res = {}
    for r in got:
        res.setdefault(r.user_id, []).append((r.rank, r.item_id))
    for u in users:
        d = ((X - qv[u]) ** 2).sum(1)
        keep = np.array([i not in seen[u] for i in ids])
        order = np.lexsort((ids[keep], d[keep]))[:4]
        assert [i for _, i in sorted(res[u])] == list(ids[keep][order])


def test_fold_identical_across_tiny_arrow_batches(spark):
    """A user's rows split over many Arrow batches (the hot-user path) fold the same."""
    rv = PP.reactions_with_vec(spark, SF001)
    cols = ["user_id", "slot", "item_id", "rewards_received", "total_rewards", "matches", "evictions"]
    full = sorted(P.fold_profiles(rv, PP.EVICTING).select(*cols, F.round("preference", 9)).collect())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        tiny = sorted(P.fold_profiles(rv, PP.EVICTING).select(*cols, F.round("preference", 9)).collect())
    finally:
        spark.conf.set(key, old)
    assert tiny == full


def test_strict_stream_drops_rows_behind_the_fold(spark, tmp_path):
    import time

    from prefspark.streaming import profiles as S

    base = PP.reactions_with_vec(spark, SF001).select("user_id", "ts", "event_id", "item_id", "reward", "vec")
    lo, hi = base.approxQuantile("event_id", [1 / 3, 2 / 3], 0.0)
    src = str(tmp_path / "src")
    # Newest third, then the middle third (the watermark now lets users fold past it),
    # then the oldest third, which is behind every user's folded history.
    for i, cond in enumerate([F.col("event_id") >= hi, (F.col("event_id") >= lo) & (F.col("event_id") < hi),
                              F.col("event_id") < lo]):
        base.where(cond).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # distinct file times: the file source reads oldest first
    dropped = S.run_profile_stream_strict(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), PP.EXACT)
    snap = S.latest_snapshot(spark.read.parquet(str(tmp_path / "out")))
    per_user = snap.groupBy("user_id").agg(F.first("late_events").alias("late"), F.first("total_rewards").alias("t"))
    late, folded = per_user.agg(F.sum("late"), F.sum("t")).first()
    assert late + dropped > 0 and folded + late + dropped <= base.count()


def test_user_without_reactions_explores(spark):
    from prefspark.operators import recommend as R

    items = T.items(spark, SF001)
    prof = T.sql_profile(spark, SF001).where("user_id = 0")
    users = spark.createDataFrame([(0,), (10_000_000,)], "user_id long")
    seen = spark.createDataFrame([], "user_id long, item_id long")
    q = {r.user_id: r for r in R.query_vectors(users, prof, 64, 2.0, 0.0, 42, 0).collect()}
    assert q[10_000_000].mode == "explore" and q[10_000_000].slot == -1
    assert len(q[10_000_000].query) == 64 and np.linalg.norm(q[10_000_000].query) == pytest.approx(1.0)
    assert q[0].mode == "exploit"  # exp_rate 0 and a profile: always exploit
    rec = R.recommend_batch(users, prof, items, seen, T.n_items(spark, SF001), 64, 2.0, 0.0).collect()
    assert {r.user_id for r in rec} == {0, 10_000_000}


def test_sweep_split_per_configuration_is_identical(spark):
    """Forcing the hot-user layout (one configuration per task) changes nothing."""
    from prefspark.operators import sweep as SW
    from prefspark.plans import evaluation as EP

    grid = {**EP.GRID, "alpha": [0.2, 0.6], "beta": [2.0]}
    ev = P.attach_vectors(EP.events_with_category(spark, SF001), T.items(spark, SF001))
    ev = EV.bernoulli_reward_map(ev, T.preferences(spark, SF001), EP.SEED)
    cols = ["config_id", "preference_type", "total_reward", "n_accepted", "n_events"]
    a = SW.sweep_replay(ev, T.preferences(spark, SF001), SW.param_grid(grid), EP.SEED).select(*cols, F.round("avg_reward", 9))
    b = SW.sweep_replay(ev, T.preferences(spark, SF001), SW.param_grid(grid), EP.SEED, steps_per_task=10).select(
        *cols, F.round("avg_reward", 9))
    assert sorted(a.collect()) == sorted(b.collect())


def test_pluggable_encoder_reports_failures(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "boom"), (3, "")], "doc_id long, text string")

    def make_encoder():
        def enc(texts):
            if texts[0] == "boom":
                raise RuntimeError("cannot encode")
            v = np.zeros(4)
            v[len(texts[0]) % 4] = 1.0
            return [v]
        return enc

    out = {r.doc_id: r for r in I.embed_with(docs, make_encoder, 4).collect()}
    assert out[1].error is None and out[1].embedding == [0.0, 1.0, 0.0, 0.0]
    assert out[2].embedding is None and "cannot encode" in out[2].error
    assert out[3].error is None


def test_names_that_begin_with_dots_keep_them(spark):
    from prefspark.sources import ingest as I

    names = {"a/b/.hidden": ".hidden", "alt.atheism.csv": "alt.atheism", "x": "x", "a..b": "a.", "..c": "..c", ".d.txt": ".d"}
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", I.category_from_path(F.col("name")).alias("c")).collect()
    assert {r.name: r.c for r in rows} == names


def test_texts_without_tokens_get_the_zero_vector(spark):
    from prefspark.sources import ingest as I

    docs = spark.createDataFrame([(1, "some words"), (2, "..."), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r.embedding for r in I.dense_vectors(I.hashing_embed(docs, 8), 8, ids=docs).collect()}
    assert set(rows) == {1, 2, 3} and any(rows[1]) and not any(rows[2]) and not any(rows[3])


def test_zero_fill_in_blocks(spark, monkeypatch):
    from prefspark.operators import evaluate as EV

    monkeypatch.setattr(EV, "CATEGORY_BLOCK", 3)
    runs = spark.createDataFrame([(1, "c0"), (1, "c0"), (2, "c7")], "user_id long, category string")
    cats = spark.createDataFrame([(f"c{k}",) for k in range(10)], "category string")
    got = {(r.user_id, r.category): r.n for r in EV.category_counts(runs, ["user_id"], cats).collect()}
    assert len(got) == 20 and got[1, "c0"] == 2 and got[2, "c7"] == 1 and sum(got.values()) == 3


def test_failed_configuration_has_no_metrics(spark):
    from prefspark.operators import evaluate as EV
    from prefspark.operators import sweep as SW

    ev = [(1, k, k, [1.0, float(k)] if k != 5 else [1.0], "c0", {"p": 10.0}) for k in range(8)]
    events = spark.createDataFrame(ev, "user_id long, ts long, event_id long, vec array<double>, category string, rewards map<string,double>")
    prefs = spark.createDataFrame([("p", "c0", 1.0)], "profile string, category string, p double")
    grid = SW.param_grid({"alpha": [0.2], "gamma": [0.9], "beta": [2.0], "max_embeddings": [5], "exp_rate": [1.0], "n_components": [0]})
    results = SW.sweep_replay(events, prefs, grid)
    row = results.first()
    assert row.error and row.avg_reward is None and row.total_reward is None
    assert EV.flatten_results(results).count() == 0
