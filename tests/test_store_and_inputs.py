"""The versioned store, the mergeable moment state, and inputs as data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from prefspark.functions import vectors as V
from prefspark.operators import features as FE
from prefspark.operators import moments as MO
from prefspark.sources import ingest as I
from prefspark.sources import tables as T
from prefspark.sources.store import StateStore

from .conftest import SF001


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_store_versions_and_touched_buckets(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"), "user_id", 4)
    with pytest.raises(FileNotFoundError):
        store.read()
    frame = lambda rows: spark.createDataFrame(rows, "user_id long, slot long, x double")
    first = [(u, s, float(u)) for u in range(20) for s in range(2)]
    assert store.update(frame(first)) == 1
    assert store.update(frame([(3, 0, -1.0), (99, 0, 5.0)])) == 2  # user 3 loses a slot, user 99 is new
    want = sorted([r for r in first if r[0] != 3] + [(3, 0, -1.0), (99, 0, 5.0)])
    assert rows_of(store.read()) == want and rows_of(store.read(1)) == sorted(first)
    old, new = store._manifest(1)["buckets"], store._manifest(2)["buckets"]
    touched = {r["b"] for r in frame([(3, 0, 0.0), (99, 0, 0.0)]).select(store.bucket().alias("b")).collect()}
    assert {b for b in new if old.get(b) != new[b]} == {str(b) for b in touched}  # the others' files are shared
    assert rows_of(store.read_keys(frame([(3, 0, 0.0), (5, 0, 0.0), (7000, 0, 0.0)]))) == [(3, 0, -1.0), (5, 0, 5.0), (5, 1, 5.0)]
    assert store.update(frame([]), keys=frame([(3, 0, 0.0)])) == 3  # all rows of a key go
    assert rows_of(store.read()) == [r for r in want if r[0] != 3]
    store.vacuum()
    assert store.versions() == [3] and rows_of(store.read()) == [r for r in want if r[0] != 3]


def test_failed_and_rival_writes_leave_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store = StateStore(spark, path, "user_id", 4)
    frame = lambda rows: spark.createDataFrame(rows, "user_id long, x double")
    store.update(frame([(1, 1.0), (2, 2.0)]))
    broken = frame([(1, 9.0)]).withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.update(broken)
    monkeypatch.setattr(store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        store.update(frame([(1, 8.0)]))
    monkeypatch.undo()
    assert store.versions() == [1] and rows_of(store.read()) == [(1, 1.0), (2, 2.0)]
    rival = StateStore(spark, path, "user_id", 4)
    manifest = store._manifest(1)
    rival.update(frame([(1, 3.0)]))
    with pytest.raises(Exception, match="(?i)exist"):  # the same version again
        store._publish(2, manifest)
    assert rows_of(store.read()) == [(1, 3.0), (2, 2.0)]
    store.vacuum()
    assert rows_of(store.read()) == [(1, 3.0), (2, 2.0)]
    with pytest.raises(ValueError, match="buckets"):
        StateStore(spark, path, "user_id", 5).update(frame([(1, 1.0)]))


def test_merged_state_equals_the_whole(spark):
    items = T.items(spark, SF001)
    parts = [MO.moments(items.where(F.col("item_id") % 3 == k)) for k in range(3)]
    x = np.array([r.embedding for r in items.collect()], np.float64)
    for state in (MO.moments(items), MO.merge(*parts), MO.merge(parts[2], MO.merge(parts[0], parts[1]))):
        rows = sorted(state.collect(), key=lambda r: r["dim"])
        assert {r["n"] for r in rows} == {len(x)}
        assert np.allclose([r["means"] for r in rows], x.mean(0), atol=1e-12)
        assert np.allclose([r["scatter"] for r in rows], np.cov(x.T, bias=True) * len(x), atol=1e-9)
    assert MO.moments(items.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        MO.solve(MO.moments(items.limit(0)))


def test_constant_dimension_and_nulls(spark):
    rows = [(1, [1.0, 5.0, 2.0]), (2, [3.0, 5.0, 1.0]), (3, None), (4, [2.0, 5.0, 6.0])]
    df = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    fit = MO.solve(MO.moments(df))
    assert fit.n == 3 and fit.scale[1] == 1.0
    z = {r.item_id: r.embedding for r in MO.standardise(df, fit).collect()}
    x = np.array([r[1] for r in rows if r[1]])
    assert np.allclose([z[i] for i in (1, 2, 4)], (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))) and z[3] is None


def test_first_components_are_the_smaller_catalogues(spark):
    items = T.items(spark, SF001)
    projected = MO.project(items, MO.solve(MO.moments(items)))
    for k in (4, 16):
        ours = {r.item_id: np.array(r.embedding) for r in MO.reduced(projected, k).collect()}
        theirs = {r.item_id: np.array(r.embedding) for r in FE.catalogue_build(items, k)[0].collect()}
        for i in ours:  # axes may point the other way
            assert np.allclose(np.abs(ours[i]), np.abs(theirs[i]), atol=1e-5)
        pairs = [(0, 1), (5, 17), (3, 99)]
        assert np.allclose([ours[a] @ ours[b] for a, b in pairs], [theirs[a] @ theirs[b] for a, b in pairs], atol=1e-5)
    norms = MO.reduced(projected, 7).select(V.norm("embedding").alias("n"), F.size("embedding").alias("k")).distinct().collect()
    assert {(round(r.n, 9), r.k) for r in norms} == {(1.0, 7)}


def test_many_files_of_few_layouts(spark, tmp_path, monkeypatch):
    for k in range(300):
        names = [["a", "b"], ["b", "a"], ["a"], ["c", "a", "b"]][k % 4]
        lines = [",".join(names), ",".join(f'"{n}{k}, ""x"""' for n in names)]
        (tmp_path / f"f{k}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_skip").write_text("not data")
    files = I.data_files(spark, [str(tmp_path)])
    assert len(files) == 301 and len(I.csv_headers(spark, files)) == 5
    got = sorted(tuple(r) for r in I.read_csv_strings(spark, [str(tmp_path)], ["a", "b"]).collect())
    want = [(f'a{k}, "x"', "" if k % 4 == 2 else f'b{k}, "x"') for k in range(300)]
    assert got == sorted(want)
    assert I.read_csv_strings(spark, [str(tmp_path / "empty.csv")], ["a"]).collect() == []


def test_quarantine_keeps_both_sides(spark, tmp_path):
    rows = ['id,v', '1,"[1.0, 2.0]"', 'x,"[1.0, 2.0]"', '3,', '4,"[1.0]"', '5,"[1.0, null]"', '6,"[1.0, Infinity]"', '7,"oops"', '8,"[1.0, 2.0]",more', '9,"[]"']
    (tmp_path / "x.csv").write_text("\n".join(rows) + "\n")
    schema = Ty.StructType([Ty.StructField("id", Ty.LongType()), Ty.StructField("v", Ty.StringType())])
    good, bad = I.read_quarantined(spark, str(tmp_path / "x.csv"), schema, "v", 2)
    assert [(r.id, list(r.v)) for r in good.collect()] == [(1, [1.0, 2.0])]
    reasons = {(r.id, r.reason) for r in bad.collect()}
    assert reasons == {(None, "malformed row"), (8, "malformed row"), (3, "malformed vector"), (7, "malformed vector"), (4, "wrong length"), (9, "wrong length"), (5, "null element"), (6, "non-finite element")}
    assert {r.record for r in bad.where("id = 8").collect()} == {'8,"[1.0, 2.0]",more'}


def test_status_of_inputs_and_files(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("no parquet")
    status = {r.name: (r.status, r.n_rows) for r in I.input_status(spark, {
        "a": (f"{SF001}/nation.parquet", ("n_name",)), "b": (f"{SF001}/nation.parquet", ("n_name", "zz")), "c": (str(tmp_path / "none"), ()), "d": (str(tmp_path / "bad.parquet"), ())}).collect()}
    assert status == {"a": ("ok", 25), "b": ("no column zz", 25), "c": ("missing", None), "d": ("unreadable", None)}
    root = tmp_path / "texts"
    (root / "x").mkdir(parents=True)
    (root / "x" / "1.txt").write_text("fine")
    (root / "2.txt").write_bytes(b"caf\xe9")
    (root / "3.txt").write_text("")
    expected = spark.createDataFrame([("x/1.txt",), ("3.txt",), ("4.txt",)], "item_key string")
    assert rows_of(I.text_file_status(spark, str(root), expected)) == [("2.txt", "repaired"), ("3.txt", "missing"), ("4.txt", "missing"), ("x/1.txt", "ok")]


def test_encoder_is_given_whole_batches(spark):
    docs = spark.createDataFrame([(i, "boom" if i == 7 else f"text {i}") for i in range(40)], "doc_id long, text string").coalesce(1)

    def make():
        def encode(texts):
            if "boom" in texts:
                raise RuntimeError("cannot read")
            return np.full((len(texts), 3), len(texts), np.float32)
        return encode

    whole = I.embed_with(docs.where("doc_id != 7"), make, 3).collect()
    assert {tuple(r.embedding) for r in whole} == {(39.0, 39.0, 39.0)}
    singly = {r.doc_id: r for r in I.embed_with(docs, make, 3).collect()}
    assert singly[7].embedding is None and "cannot read" in singly[7].error and list(singly[8].embedding) == [1.0, 1.0, 1.0]
