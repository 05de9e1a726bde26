"""Operators 5, 6, 7, 10 and the pipeline against brute force, and their edge cases."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from prefspark.llm import ann, blocks, line_dedup, near_dedup, paragraph_dedup, queries, shingles
from prefspark.llm.components import components
from tests.conftest import SF001, SF01

SCHEMA = "doc_id bigint, text string, key string, line int, n bigint, root string, column_1 int"


def text_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def shingle_set(text: str) -> frozenset:
    w = text.split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def similar(sets: list[frozenset], threshold: float = 0.8) -> set[tuple[int, int]]:
    """All pairs with a Jaccard of at least the threshold: a prefix filter in arbitrary order, then the definition."""
    found, index = set(), defaultdict(list)
    for i, s in enumerate(sets):
        n = len(s) - math.ceil(threshold * len(s) - 1e-9) + 1
        prefix = sorted(s)[:n]
        for j in {j for q in prefix for j in index[q]}:
            if len(s & sets[j]) >= threshold * len(s | sets[j]) - 1e-9:
                found.add((j, i))
        for q in prefix:
            index[q].append(i)
    return found


def roots_of(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 3, 4, "r", 5) for i, t in rows], SCHEMA)


PASSAGE = "\n".join(" ".join(f"p{j}w{k}" for k in range(20)) for j in range(3))


def hard_rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies, passages, hot lines."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(4)]
    rows = [(0, base[0]), (0, base[0]), (0, "another text under id zero that has more than five words"), (None, base[1]), (None, base[1]), (1, None), (2, ""), (3, " \n \n"), (4, "short"), (5, "short"), (6, " short ")]
    for k in range(7, 40):  # near copies of the first two
        w = base[k % 2].split()
        w[draw.randrange(60)] = "changed"
        rows.append((k, " ".join(w)))
    for k in range(40, 60):
        rows.append((k, f"own line {k} begins this one and no other {base[2][:50]} {k}\n{PASSAGE}\nthe same hot line everywhere\nlast {k} of its kind here today"))
    rows.append((60, "repeat after me now please " * 4000))
    rows.append((61, "\n".join(["the same hot line everywhere"] * 50)))
    return rows


# --- helpers -------------------------------------------------------------------------------------


def test_words_don_t_depend_on_slices(monkeypatch):
    texts = ["a b c d e f", "", "one two\nthree\n\nfour  five six", None, " lead\t tail ", "x" * 50 + " y", "é ü\n日本 語"]
    seen = []
    for size in (2_000_000, 7):
        monkeypatch.setattr(shingles, "SLICE_BYTES", size)
        found = []
        for w in shingles.words(pa.array(["skipped", *texts]).slice(1)):
            found += [(int(r) + w.first_row, int(line), int(h)) for r, line, h in zip(w.row, w.line, w.hashes, strict=True)]
        seen.append(found)
    assert seen[0] == seen[1]
    expected = [(r, n, word) for r, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) for word in line.split()]
    assert [x[:2] for x in seen[0]] == [x[:2] for x in expected]
    by_word = defaultdict(set)
    for (_, _, word), (_, _, h) in zip(expected, seen[0], strict=True):
        by_word[word].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(pairs, "a int, b int")).collect())
    real = [(a, b) for a, b in pairs if a is not None]
    expected = roots_of(1100, real)
    assert got == {x: r for x, r in enumerate(expected) if r != x}
    assert components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_bitmap(spark):
    keys = [0, 1, 32767, 32768, -1, 1 << 40, (1 << 24) - 1, 5 << 24]
    got = blocks.bitmap(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k")
    assert set(np.flatnonzero(got)) == {k & (1 << 24) - 1 for k in keys}


# --- 10: near-duplicates -------------------------------------------------------------------------


def subsequence(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_banded_alignment_is_exact():
    draw = np.random.default_rng(0)
    pairs, expected = [], []
    for _ in range(150):
        a = draw.integers(0, 40, draw.integers(0, 70)).astype("<u4")
        b = a.copy()
        for _ in range(draw.integers(0, 14)):
            k = int(draw.integers(0, len(b) + 1))
            b = np.insert(b, k, draw.integers(0, 40)) if draw.random() < 0.5 or len(b) < 2 else np.delete(b, min(k, len(b) - 1))
        common = subsequence(a.tolist(), b.tolist())
        if len(a) and len(b):
            assert near_dedup.common_in_band([a], [b], 200)[0] == common
        pairs.append((a, b))
        expected.append(common >= 0.8 * (len(a) + len(b) - common))
    assert near_dedup.verify(pairs) == expected


def test_near_classes_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in queries.op10_near_dedup(spark, SF01).collect()}
    pairs = similar([shingle_set(t) for _, t in docs])
    lost = [(docs[a][0], docs[b][0]) for a, b in pairs if got[docs[a][0]].class_id != got[docs[b][0]].class_id]
    assert pairs and len(got) == len(docs) and not lost
    # No class is larger than its links allow: each member is similar to another one, nearly.
    loose = similar([shingle_set(t) for _, t in docs], 0.75)
    roots = roots_of(len(docs), loose)
    assert all(roots[i] == roots[got[d].class_id] for i, (d, _) in enumerate(docs))
    kept = [r for r in got.values() if r.kept]
    assert {r.doc_id for r in kept} == {r.class_id for r in got.values()}


def test_near_dedup_edges(spark):
    rows = hard_rows()
    docs = frame(spark, rows)
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len({(r.class_id, r.class_size) for r in got})
    first = [r for r in got if r.doc_id in range(7, 40) and r.doc_id % 2 == 0]
    assert {r.class_id for r in first} == {0}
    assert {r.class_id for r in got if r.doc_id in (4, 5, 6)} == {4}  # equal words
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert kept.where("doc_id = 0").count() == 2  # two texts under one id; the repeated row went
    assert near_dedup.classes(docs.limit(0)).collect() == [] and near_dedup.keep_one(docs.limit(0)).count() == 0


def template_rows(n_pairs: int) -> list[tuple[int, str]]:
    """Texts that share 85 of 100 shingles with all others (0.739) and 5 more with one other (0.818)."""
    template = " ".join(f"t{k}" for k in range(89))
    return [(2 * p + side, f"{template} " + " ".join([f"p{p}w{k}" for k in range(5)] + [f"p{p}s{side}w{k}" for k in range(10)])) for p in range(n_pairs) for side in (0, 1)]


def test_overlaps():
    draw = np.random.default_rng(1)
    sides = [[np.unique(np.concatenate([draw.integers(0, 40, 30), draw.integers(0, 5000, n)])).astype(np.uint64) for n in draw.integers(0, 60, m)] for m in (90, 70)]
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in sides[1]] for a in sides[0]]
    for dense, cells in ((0, 1000), (64, 1000), (64, 10), (10**9, 1000)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(near_dedup, "DENSE", dense)
            patch.setattr(near_dedup, "CELLS", cells)
            patch.setattr(near_dedup, "STEP", 7)
            assert near_dedup.overlaps(*sides).tolist() == expected


@pytest.mark.parametrize("tile", [2048, 100])
def test_near_pairs_in_crowded_bands(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rows = template_rows(300)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()}
    assert similar([shingle_set(t) for _, t in rows]) == {(2 * p, 2 * p + 1) for p in range(300)}
    assert got == {i: i // 2 * 2 for i, _ in rows}


# --- 5: passages ---------------------------------------------------------------------------------


def repeated_lines(rows, min_words=50) -> dict:
    """Lines to remove of each (id, text), by definition."""
    order = sorted({(i is None, i or 0, text_hash(t or ""), t or "") for i, t in rows if t is not None})
    lines = [((unnamed, i, digest), n, number, tuple(line.split())) for unnamed, i, digest, t in order for number, (n, line) in enumerate((n, x) for n, x in enumerate(t.split("\n")) if x.split())]
    place = {}
    for *_, w in lines:
        place.setdefault(w, len(place))
    roots = roots_of(len(place), similar([shingle_set(" ".join(w)) for w in place]))
    first, per_doc = {}, defaultdict(list)
    for doc, _, _, w in lines:
        first.setdefault(roots[place[w]], doc)
    for doc, n, _, w in lines:
        per_doc[doc].append((n, len(w), first[roots[place[w]]] != doc))
    out = {}
    for doc, own in per_doc.items():
        run = []
        for n, size, repeats in [*own, (0, 0, False)]:
            if repeats:
                run.append((n, size))
                continue
            if sum(s for _, s in run) >= min_words:
                out.setdefault(doc, set()).update(n for n, _ in run)
            run = []
    return out


def test_passages_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    expected = {doc[1]: lines for doc, lines in repeated_lines(rows).items()}
    got = {r.doc_id: r for r in queries.op5_paragraph_dedup(spark, SF01).collect()}
    assert len(got) == len(rows) and expected
    assert {d: set(r.removed_lines) for d, r in got.items() if r.n_removed} == expected
    cut = {r.doc_id: r.text for r in paragraph_dedup.without_repeats(spark.read.parquet(f"{SF01}/documents.parquet")).collect()}
    for d, text in rows:
        assert cut[d] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in expected.get(d, ()))


def test_passage_edges(spark):
    rows = hard_rows()
    docs = frame(spark, rows)
    expected = repeated_lines(rows)
    texts = sorted((i is None, i or 0, t or "") for i, t in rows)
    out = paragraph_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    want = []
    for unnamed, i, t in texts:
        lines = expected.get((unnamed, i, text_hash(t)), ())
        want.append((unnamed, i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lines)))
    assert got == sorted(want)
    assert any("p0w0" in t and i == 40 for _, i, t in got) and not any("p0w0" in t and 40 < i < 60 for _, i, t in got)
    assert out.where("text is null").count() == 1
    assert paragraph_dedup.report(docs).count() == len(rows)
    assert paragraph_dedup.report(docs.limit(0)).collect() == []


@pytest.mark.parametrize("tile", [2048, 50])
def test_similar_paragraphs_in_crowded_bands(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rows = template_rows(150)
    got = {r.doc_id: (r.removed_lines, r.kept_in) for r in paragraph_dedup.report(frame(spark, rows)).collect()}
    assert repeated_lines(rows).keys() == {(False, i, text_hash(t)) for i, t in rows if i % 2}
    assert got == {i: ([0], [i - 1]) if i % 2 else ([], []) for i, _ in rows}


def repeated_words(rows, n=50) -> dict:
    """Words of each (id, text) in a window of ``n`` words that an earlier document has."""
    order = sorted({(i is None, i or 0, text_hash(t or ""), t or "") for i, t in rows if t is not None})
    first, out = {}, {}
    for *doc, t in order:
        w = t.split()
        gone = {k + j for k in range(len(w) - n + 1) if first.setdefault(tuple(w[k : k + n]), doc) != doc for j in range(n)}
        if gone:
            out[doc[0], doc[1]] = out.get((doc[0], doc[1]), set()) | gone
    return out


def test_passages_within_lines(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    part = " ".join(f"q{k}" for k in range(50))
    own = [" ".join(f"o{n}w{k}" for k in range(60)) for n in range(3)]  # so that no whole lines are similar
    rows += [(10_000, f"{own[0]} {part} and ends"), (10_001, f"another line\nhere  {part.replace('q27 ', 'q27' + chr(10))} stays\nlast"), (10_002, f"{own[1]} {part[:-4]} of it"), (None, f"{own[2]} {part}"), (10_003, None)]
    expected = repeated_words(rows)
    got = {(r.doc_id is None, r.doc_id or 0): {k for p in r.passages for k in range(p.first_word, p.first_word + p.n_words)} for r in paragraph_dedup.report(frame(spark, rows)).collect()}
    assert {d: s for d, s in got.items() if s} == expected and expected[False, 10_001] == set(range(3, 53))
    text = {r.doc_id: r.text for r in paragraph_dedup.without_passages(frame(spark, rows)).where("doc_id >= 10000 or doc_id is null").collect()}
    assert text == {10_000: rows[-5][1], 10_001: "another line\nhere\nstays\nlast", 10_002: rows[-3][1], None: own[2], 10_003: None}


# --- 7: lines ------------------------------------------------------------------------------------


def word_set(text: str) -> frozenset:
    """Words numbered by occurrence."""
    met: dict = defaultdict(int)
    out = []
    for word in text.split():
        met[word] += 1
        out.append((word, met[word]))
    return frozenset(out)


def line_decisions(rows) -> dict:
    order = sorted({(i is None, i or 0, text_hash(t or ""), t or "") for i, t in rows if t is not None})
    lines = [((unnamed, i, digest, n), word_set(x)) for unnamed, i, digest, t in order for n, x in enumerate(t.split("\n")) if x.split()]
    first = {}
    for place, s in lines:
        first.setdefault(s, place)
    sets = list(first)
    links = defaultdict(set)
    for a, b in similar(sets):
        links[sets[a]].add(sets[b])
        links[sets[b]].add(sets[a])
    return {place: (len(links[s]), place != first[s] or any(first[o] < first[s] for o in links[s])) for place, s in lines}


@pytest.mark.parametrize("scan", [4096, 1])
def test_filters_keep_every_similar_pair(monkeypatch, scan):
    monkeypatch.setattr(line_dedup, "SCAN", scan)
    draw = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    for _ in range(300):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(4, 25))]
        other = [draw.choice(vocabulary) if draw.random() < 0.08 else x for x in base]
        if draw.random() < 0.3:
            other.insert(draw.randrange(len(other)), draw.choice(vocabulary))
        a, b = word_set(" ".join(base)), word_set(" ".join(other))
        w = next(shingles.words(pa.array([" ".join(base) + "\n" + " ".join(other)])))
        h, starts, _, keys, word = line_dedup._token_sets(w, np.arange(1 << 20, dtype=np.uint64).astype(np.uint8) & 127)
        sets = np.split(h, starts[1:])
        assert [len(s) for s in sets] == [len(a), len(b)] and len(np.intersect1d(*sets)) == len(a & b)
        assert (keys[0] == keys[1]).all() == (a == b) and set(word.tolist()) == set(w.hashes.tolist())
        if a == b or len(a & b) < 0.8 * len(a | b):
            continue
        prefix = [s[: len(s) - math.ceil(0.8 * len(s) - 1e-9) + 1].tolist() for s in sets]
        token = next(t for t in sets[0].tolist() if t in set(sets[1].tolist()))
        assert token in prefix[0] and token in prefix[1]
        size, place = np.array([len(a), len(b)]), np.array([p.index(token) for p in prefix])
        order = np.argsort(size, kind="stable")
        parity = line_dedup._parity(h, starts)
        before = np.array([int(s[max(0, k - 1)]) >> 32 for s, k in zip(sets, place, strict=True)], "<u4")
        assert line_dedup.with_partner(line_dedup.Entries(np.zeros(2, np.uint64), size[order], place[order], parity[order], before[order])).all()


@pytest.mark.parametrize("tile", [4096, 3])
def test_lines_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    source = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in source.collect()] + [(10_000 + (i or 0), t) for i, t in hard_rows()]
    docs = frame(spark, rows)
    got = {(r.doc_id is None, r.doc_id or 0, r.doc, r.line): (r.n_links, r.removed) for r in line_dedup.joined(docs).collect()}
    expected = line_decisions(rows)
    assert any(n for n, _ in expected.values()) and got == expected


def test_line_edges(spark):
    rows = hard_rows()
    docs = frame(spark, rows)
    expected = line_decisions(rows)
    out = line_dedup.without_similar(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    want = []
    for i, t in rows:
        key = (i is None, i or 0, text_hash(t or ""))
        want.append((i is None, i or 0, "\n".join(x for n, x in enumerate((t or "").split("\n")) if not expected.get((*key, n), (0, False))[1])))
    assert got == sorted(want)
    assert line_dedup.joined(docs.limit(0)).collect() == []


# --- 6: nearest vectors --------------------------------------------------------------------------


def brute_neighbours(rows, every, k):
    usable = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)})
    x = np.array([v for _, v in usable])
    ids, norms = np.array([i for i, _ in usable]), np.linalg.norm(x, axis=1)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(axis=1) / (norms * norms[q])
        out[ids[q]] = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != ids[q])[:k]
    return out


@pytest.mark.parametrize(("sf", "settings"), [("sf0.1", {"part_rows": 100}), ("sf0.1", {}), ("sf0.01", {})])
def test_recall_against_brute_force(spark, sf, settings):
    """With parts of 100 rows, where the routing has to choose among many, and with the registered settings."""
    sf = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected = brute_neighbours(rows, 50, 5)
    got = defaultdict(list)
    for r in ann.search(spark.read.parquet(f"{sf}/embeddings.parquet"), 50, **settings).collect():
        got[r.query_id].append(r)
    assert set(got) == set(expected)
    hit = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 6)) and found == sorted(found, key=lambda r: (-r.score, r.vec_id))
        hit += len({r.vec_id for r in found} & {i for _, i in expected[q]})
    print("recall", sf, settings, hit / sum(map(len, expected.values())))
    assert hit >= 0.9 * sum(map(len, expected.values()))


def test_vector_edges(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), draw.standard_normal(4).tolist()) for i in range(40)]
    rows += [(int(i), rows[0][1]) for i in range(100, 120)] + [rows[0]] * 3  # copies and repeated rows
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 1.0]), (203, [float("nan"), 1.0, 0.0, 0.0]), (204, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), (205, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, key int, vector string")
    expected = brute_neighbours([r for r in rows if r[0] != 205], 10, 5)
    got = defaultdict(list)
    for r in ann.search(vectors, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in expected.items()}
    assert all(np.allclose([s for s, _ in got[q]], [s for s, _ in expected[q]], rtol=0, atol=1e-15) for q in got)
    few = spark.createDataFrame([(10, [1.0, 0.0]), (20, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert sorted((r.query_id, r.vec_id) for r in ann.search(few, 10).collect()) == [(10, 20), (20, 10)]
    assert ann.search(few.limit(1), 10).collect() == [] and ann.search(few.limit(0), 10).collect() == []


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    held = docs.withColumn("extra", F.lit("x")).withColumn("line", F.lit(1))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, SF001)
        if name != "packing":
            assert out.columns == held.columns and out.schema.simpleString() == held.schema.simpleString()
            out = corpus_pipeline.materialize(out, "test-stage")
            assert out.count() <= held.count()
        seen.append(name)
        held, before = out, held
    assert seen == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    assert {r.doc_id for r in held.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    whole = corpus_pipeline.run(spark, SF001)
    assert whole.agg(F.sum("length")).first()[0] == held.agg(F.sum("length")).first()[0]


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF001), "test-empty")
        assert docs.count() == 0
