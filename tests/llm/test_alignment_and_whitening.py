"""Operators 11, 12, 13: brute force, the libraries' own results, hot groups and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefspark.llm import queries, rank_encoder, simhash_dedup, token_alignment, whitening
from tests.conftest import SF001, SF01

SCHEMA = "doc_id bigint, text string, fp string, least string, row string, x string"
BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "f", "l", "r", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, and further columns with clashing names."""
    rows = [(1, "A b\tc d"), (1, "A b\tc d"), (2, "a B c\nd"), (1, "another text under this id"), (None, "no id"), (3, None), (4, ""), (5, " \n "), (6, "one two"), (7, "word " * 300_000), (8, "x" * 120_000), (9, "a <s> b <|endoftext|> </s>"), (10, "two▁words"), (11, "日本語 😀 é")]
    return docs_of(spark, rows)


# --- 11: SimHash ---------------------------------------------------------------------------------


def brute_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(prints: list[int]) -> list[int]:
    """Least index that chains of prints at most 2 bits apart reach."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    u = np.array(prints, np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2), strict=True):
        a, b = find(int(i)), find(int(j))
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_classes_of_documents(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect())
    ids, prints = [i for i, _ in rows], [brute_fingerprint(t) for _, t in rows]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, prints, brute_classes(prints), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op11_simhash_dedup(spark, SF01).collect()} == want


def test_pieces_don_t_change_a_fingerprint(monkeypatch):
    text = "".join(random.Random(5).choice(["Ab ", "c\n", "dé  ", "\t", "éf"]) for _ in range(4000))
    whole = simhash_dedup.fingerprint(text.encode())
    assert whole == brute_fingerprint(text)
    for size in (1, 7, 1000):
        monkeypatch.setattr(simhash_dedup, "PIECE_BYTES", size)
        assert simhash_dedup.fingerprint(text.encode()) == whole


def test_near_fingerprints_always_pass_the_ring():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 1 << 63, 4000, dtype=np.uint64) * 2 + 1
    for bits in range(5):
        b = a.copy()
        for _ in range(bits):
            b ^= np.uint64(1) << draw.integers(0, 64, len(a), dtype=np.uint64)
        near = np.bitwise_count(a ^ b) <= simhash_dedup.DISTANCE
        same = simhash_dedup.chain_keys(a) == simhash_dedup.chain_keys(b)
        held = np.stack([same[:, s] & simhash_dedup.ring_viable(a ^ b, s) for s in range(simhash_dedup.SEGMENTS)]).any(axis=0)
        assert (held == near).all()


@pytest.mark.parametrize("crowd", [2, 40, 10_000])
def test_crowded_keys_lose_no_link(spark, crowd):
    draw = random.Random(11)
    prints = set()
    for _ in range(6):  # clusters that share most segments, and chains of small steps
        base = draw.getrandbits(64)
        for _ in range(60):
            prints.add(base ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(4))}))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    links = {(r["a"], r["b"]) for r in simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), crowd).collect()}
    u = np.array(prints, np.uint64)
    place = {s: i for i, s in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert a != b
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
        # A crowded key links through a value between, so its ends are at most two links apart.
        assert np.bitwise_count(u[place[a]] ^ u[place[b]]) <= 2
    assert [find(i) for i in range(len(prints))] == brute_classes(prints)


def test_simhash_edges(spark, edge_docs):
    got = simhash_dedup.classes(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add((r["fingerprint"], r["component_id"], r["copies"]))
    assert by_id[1] == {(f"{brute_fingerprint('a b c d'):016x}", 1, 3), (f"{brute_fingerprint('another text under this id'):016x}", 1, 1)}
    assert by_id[2] == {(f"{brute_fingerprint('a b c d'):016x}", 1, 3)}
    assert by_id[3] == by_id[4] == by_id[5] == {("0" * 16, 3, 3)}
    assert by_id[None] == {(f"{brute_fingerprint('no id'):016x}", None, 1)}
    assert by_id[6] == {(f"{xxhash.xxh64_intdigest(b'one two', 42):016x}", 6, 1)}
    assert simhash_dedup.classes(edge_docs.limit(0)).collect() == []


# --- 12: alignment -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def json():
    with open(BPE, encoding="utf-8") as f:
        return f.read()


def test_rank_encoder_equals_the_library(json):
    assert rank_encoder.is_plain(json)
    draw = random.Random(2)
    alphabet = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", " ", "a", "B", "é", "日", "1", "Ⅷ", "²", "!", "'", "'s", "<|endoftext|>", "́", "😀", "x y", "the", "​", "ª", "͸"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(1500)] + ["", "x" * 60_000, " " * 60_000, "word " * 20_000]
    for as_text in (True, False):
        library = Tokenizer.from_str(json)
        library.encode_special_tokens = as_text
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        for plain in (True, False):
            assert [ids.tolist() for ids in rank_encoder.RankEncoder(json, plain, as_text).encode(texts)] == want


def test_unlike_characters_go_through_the_library(json):
    encoder = rank_encoder.RankEncoder(json, True, True)
    encoder.unlike.add("q")
    assert not encoder._agrees("a q") and encoder._agrees("a b")
    assert encoder.encode(["a q b"])[0].tolist() == encoder.library.encode("a q b", add_special_tokens=False).ids


def test_other_files_are_not_plain():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        assert not rank_encoder.is_plain(f.read())


@pytest.mark.parametrize("work", [1, 2, 7, 1 << 16])
def test_merge_path_against_all_pairs(work):
    draw = random.Random(work)
    for _ in range(60):
        end = draw.randint(1, 40)
        a, b = (np.array(sorted({end, *(draw.randint(1, end) for _ in range(draw.randint(0, 30)))})) for _ in range(2))
        spans = [list(zip([0, *side[:-1]], side, strict=True)) for side in (a, b)]
        want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        got = token_alignment.overlaps(a, b, work)
        assert list(zip(got.a.tolist(), got.b.tolist(), strict=True)) == want
        assert a[got.a[got.cut]].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        diagonals = np.arange(len(a) + len(b) + 1)
        merged = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
        assert token_alignment.crossings(a, b, diagonals).tolist() == [sum(1 - side for _, side in merged[:d]) for d in diagonals]


def brute_alignment(rows):
    """Contract columns of each row by its own definitions, one text at a time."""
    a, b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    alphabet = rank_encoder.byte_alphabet()
    found, documents = [], Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        spelled = [[bytes(alphabet[c] for c in a.id_to_token(k)) for k in ids[0]], [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids[1]]]
        if any(b"".join(s) != raw for s in spelled):
            ids, spelled = [[], []], [[], []]
        ends = [np.cumsum([len(t) for t in s]).astype(int).tolist() for s in spelled]
        owner = [[k for k, t in enumerate(s) for _ in t] for s in spelled]
        links = [(ids[0][p], ids[1][q]) for p, q in sorted(set(zip(*owner, strict=True)))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for cut in cuts:
            to = [ends[s].index(cut) + 1 for s in (0, 1)]
            groups.append("|".join(",".join(map(str, ids[s][at[s] : to[s]])) for s in (0, 1)))
            at = to
        documents.update(set(links))
        found.append((i, len(ids[0]), len(ids[1]), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    highest = defaultdict(int)
    for (p, _), n in documents.items():
        highest[p] = max(highest[p], n)
    return Counter((i, n_a, n_b, n_g, len(links), sum(documents[k] == highest[k[0]] for k in links), sum(documents[k] for k in links), digest) for i, n_a, n_b, n_g, links, digest in found)


@pytest.mark.parametrize("lookup_pairs", [token_alignment.LOOKUP_PAIRS, 700])
def test_alignments_against_brute_force(spark, lookup_pairs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("length(text) < 6000")
    want = brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = token_alignment.alignments(docs, BPE, PIECES, lookup_pairs=lookup_pairs, work=50)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_counting_in_several_rounds(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_alignment, "HELD_PAIRS", 8)
    draw = random.Random(4)
    rows = [sorted(draw.sample(range(30), draw.randint(0, 12))) for _ in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([np.array(r, "<u4").tobytes() for r in rows[k::5]], pa.binary())], names=["pairs"]) for k in range(5)]
    total = Counter()
    for batch in token_alignment._counted("<u4")(iter(batches)):
        for pair, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[pair] += n
    assert total == Counter(x for r in rows for x in r)


def test_alignment_edges(spark, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 1000]
    got = token_alignment.alignments(docs_of(spark, short), BPE, PIECES)
    assert Counter(tuple(r) for r in got.collect()) == brute_alignment(short)
    whole = {r["doc_id"]: r for r in token_alignment.alignments(edge_docs, BPE, PIECES).collect()}
    a = Tokenizer.from_file(BPE)
    assert whole[7]["n_a"] == len(a.encode(" " + "word " * 300_000).ids) and whole[8]["n_a"] == len(a.encode(" " + "x" * 120_000).ids)
    assert whole[10]["n_a"] == 0 and whole[10]["groups_sha256"] == ""  # U+2581 comes back as a space
    assert token_alignment.alignments(edge_docs.limit(0), BPE, PIECES).collect() == []


# --- 13: whitening -------------------------------------------------------------------------------


def check_whitening(vectors: dict, got: list, rank: int) -> None:
    """Rows against numpy's own eigenvectors, and exact sums in Python integers."""
    x = {k: [int(np.floor(256 * float(c))) for c in v] for k, v in vectors.items()}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    table = defaultdict(dict)
    for r in got:
        table[r["component"]][r["vec_id"]] = r
    assert set(table) == set(range(1, min(4, rank) + 1))
    for k, rows in table.items():
        assert set(rows) == set(vectors)
        want = {i: float((np.array(v, float) - mean) @ directions[:, k - 1] / np.sqrt(values[k - 1])) for i, v in x.items()}
        sign = np.sign(sum(want[i] * r["whitened"] for i, r in rows.items()))
        for i, r in rows.items():
            assert r["n"] == n and r["identity_error"] < 1e-9
            assert r["whitened"] == pytest.approx(sign * want[i], abs=1e-8)
            assert r["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
            exact = sum((n * c - s) ** 2 for c, s in zip(x[i], sums, strict=True))
            assert r["deviation"] == (exact if exact < 1 << 63 else None) and int(r["deviation_wide"]) == exact


def test_whitening_of_embeddings(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()}
    check_whitening(vectors, queries.op13_embedding_whitening(spark, SF001).collect(), 64)


@pytest.mark.parametrize("rank", [1, 2, 3, 5])
def test_rank_of_the_scatter_bounds_the_components(spark, rank):
    draw = np.random.default_rng(rank)
    base = draw.integers(-40, 40, (rank, 7))
    vectors = {i: ((draw.integers(-9, 9, rank) * 2 ** np.arange(rank)) @ base / 256).tolist() for i in range(60)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    check_whitening(vectors, whitening.whiten(table).collect(), rank)


def test_factor_and_rotations():
    draw = np.random.default_rng(3)
    for d, scale in ((1, 1), (2, 1), (9, 1e8), (30, 1e-8)):
        a = draw.standard_normal((d, 2 * d)) * np.logspace(0, 3, d)[:, None] * scale
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert np.abs(factor @ factor.T - v).max() <= 1e-12 * np.abs(v).max()
        values, vectors = whitening.eigen(v)
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
        assert values == pytest.approx(np.linalg.eigvalsh(v)[::-1], rel=1e-9)
        assert np.abs(v @ vectors - vectors * values).max() <= 1e-12 * values[0]
    for n in (1, 2, 5, 6):
        met = Counter((int(p), int(q)) for ps, qs in whitening._rounds(n) for p, q in zip(ps, qs, strict=True))
        assert met == Counter((p, q) for p in range(n) for q in range(p + 1, n))


def test_whitening_edges(spark):
    schema = "vec_id bigint, embedding array<double>, x string, component string"
    good = {1: [0.1, 0.2], 2: [-0.0, 0.5], 3: [0.1, 0.2], 4: [-0.7, 0.001], 5: [40.0, -40.0]}
    bad = [(6, None), (7, [0.1, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, []), (11, [0.1, 0.2, 0.3]), (12, [0.4])]
    rows = [(i, v, "x", "c") for i, v in [*good.items(), *bad]]
    got = whitening.whiten(spark.createDataFrame(rows + [(None, [0.1, 0.2], "x", "c")], schema)).collect()
    check_whitening(good, [r for r in got if r["vec_id"] is not None], 2)
    assert sum(r["vec_id"] is None for r in got) == 2
    for some in ([], [(1, [0.5, 0.5], "x", "c")] * 3, [(1, None, "x", "c")]):
        assert whitening.whiten(spark.createDataFrame(some, schema)).collect() == []
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0], "x", "c"), (2, [0.0, 1.0], "x", "c")], schema)).collect()
    assert len(huge) == 2 and all(r["deviation"] is None for r in huge)


def test_whitening_counts_repeated_vectors_once(spark):
    vectors = spark.read.parquet(f"{SF001}/embeddings.parquet")
    copies = vectors.unionByName(vectors.withColumn("vec_id", F.col("vec_id") + 10_000)).unionByName(vectors.withColumn("vec_id", F.col("vec_id") + 20_000))
    once, thrice = whitening.whiten(vectors).first(), whitening.whiten(copies).where("vec_id < 10000").first()
    assert once["n"] == thrice["n"] == vectors.select("embedding").distinct().count()
