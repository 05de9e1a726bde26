"""Operators 1, 2, 3, 4, 8, 9: brute force, library results, round trips, held-out accuracy, edge cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib
from html import unescape

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefspark.llm import bpe, grams, html_extract, langid, order_minhash, packing, queries, toxicity
from tests.conftest import SF001, SF01

ALPHABET = [" ", "  ", "\n", "\t", " ", "\x1c", " ", "a", "B", "é", "日", "1", "Ⅷ", "!", "'", "'s", "<|endoftext|>", "́", "😀", "x y", "..", "the"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, row bigint, part int"


def odd_texts(n: int = 400) -> list[str]:
    draw = random.Random(3)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 30))) for _ in range(n)] + ["", " ", "word " * 5000, "x" * 20000]


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, and further columns with clashing names."""
    rows = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (1, "other text under the same id", "en"), (2, None, None), (None, "no id here at all, sorry", "fr"), (3, "", "de"), (4, "word " * 30000, "en"), (5, "123 ... 456", "en")]
    return spark.createDataFrame([(i, t, lang, None, None, "k", 7, 1) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 2: byte-level BPE ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe._codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_perfect_hash_is_minimal_and_exact(codec):
    keys = [t for t in codec.rank]
    table = codec.table
    assert len(table.slots) == len(keys) and all(table.slots)
    assert [codec.ids[table.find(k)] for k in keys[:5000]] == [codec.rank[k] for k in keys[:5000]]
    assert table.find(b"certainly no token of this vocabulary") == -1
    assert bpe.MinimalPerfectHash([]).n == 0 and bpe.MinimalPerfectHash([]).find(b"a") == -1


@pytest.mark.parametrize("n", [1, 2, 3, 17, 257, 1000, 8000])
def test_perfect_hash_is_found_at_every_size(n):
    draw = random.Random(n)
    for _ in range(3 if n > 1000 else 10):
        keys = list({draw.randbytes(draw.randint(1, 12)) for _ in range(n)})
        table = bpe.MinimalPerfectHash(keys)
        assert [table.find(k) for k in keys] == list(range(len(keys)))
        assert all(table.slots) and len(table.slots) == len(keys) and table.find(b"not one of the keys") == -1


def test_other_patterns_split_as_they_say(codec):
    capitals = r" ?[A-Z]?[a-z]+| ?[^a-z]"
    other = bpe.BpeCodec(list(codec.rank.items()), capitals)
    library = tiktoken.Encoding("own", pat_str=capitals, mergeable_ranks=codec.rank, special_tokens={})
    encoder = bpe.TextEncoder(other.pretoken, capitals)
    for text in ("one camelCase andSoOn", "A b CD e", "plain words only", "x Y1 zZ"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_encoder_equals_the_library(codec):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.rank, special_tokens={})
    encoder = bpe.TextEncoder(codec.pretoken, codec.pattern, entries=50)  # so small that both generations turn over
    for text in odd_texts():
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text), repr(text[:80])


def test_digests_on_documents(spark, codec, edge_docs):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.rank, special_tokens={})
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_byte_bpe(spark, SF001).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    path = P.path("byte_bpe_multi_50k.tiktoken")
    edge = bpe.encode_digests(edge_docs, path, P.PATTERN).collect()
    assert len(edge) == 8 and sum(r.n_tokens == 0 for r in edge) == 2
    back = bpe.decode(bpe.encode(edge_docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted((r.text or "") for r in edge_docs.collect())


# --- 4: packing ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("d", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    key = packing.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def packed_ok(docs, pieces, size):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = sorted([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs)
    by_sequence: dict = {}
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_sequence.setdefault(p.sequence_id, []).append(p)
    whole = sum(p.length for p in pieces)
    stream = []
    for s in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            stream += np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert at == size or at.bit_count() == 1  # no padding at all
    assert len(stream) == whole == sum(map(len, expected))
    laid, doc = [], []
    for i in stream:  # documents lie one after another
        doc.append(i)
        if i == 0:
            laid.append(doc)
            doc = []
    assert not doc and sorted(laid) == expected


def test_pack(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    path = P.path("byte_bpe_50k.json")
    odd = [t.replace("!", "?") for t in ["hello <|endoftext|> world", *odd_texts(60)]]  # "!" has id 0, the end's
    odd = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    for frame, size in ((docs, 1024), (edge_docs, 64), (odd, 32), (docs.limit(1), 1 << 20)):
        packed_ok(frame.collect(), packing.pack(frame, path, size).collect(), size)
    assert packing.pack(no_docs, path).collect() == []


# --- 3: Order MinHash ----------------------------------------------------------------------------


def chained(values: list[tuple[bytes, int]]) -> int:
    h = 42
    for raw in values:
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def brute_signature(text: str, k: int, slots: int, width: int) -> list[int]:
    long = lambda x: (x & (1 << 64) - 1).to_bytes(8, "little")
    words = [w for w in re.split("[ \t\n\r\f\x0b]+", text.strip(" \t\n\r\f\x0b")) if w]
    if not words:
        return []
    hashes = [chained([w.encode()]) for w in words]
    low = (1 << order_minhash.POSITION_BITS) - 1
    seen: dict[int, int] = {}
    entries = []
    for i in range(max(1, len(words) - k + 1)):
        h = signed(chained([long(x) for x in hashes[i : i + k]])) & ~low
        top = h >> order_minhash.POSITION_BITS
        number = seen.get(top, 0)
        seen[top] = number + 1
        if number:
            h = signed(chained([long(top), number.to_bytes(4, "little")])) & ~low
        entries.append(h | i)
    entries.sort()
    out = []
    for j in range(slots):
        point = ((2 * j + 1) << 63) // slots - (1 << 63)
        start = sum(e < point for e in entries)
        chosen = [entries[(start + c) % len(entries)] for c in range(min(width, len(entries)))]
        placed = sorted(((e & low) << 40) | ((e & (1 << 64) - 1) >> 24) for e in chosen)
        out.append(chained([long(p & (1 << 40) - 1) for p in placed]) & 0x7FFFFFFF)
    return out


def test_order_minhash_equals_brute_force(spark):
    draw = random.Random(1)
    texts = ["", "   ", "one", "a b c", " lead and trail ", "x " * 40, "a b c d e " * 9] + [" ".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 120))) for _ in range(30)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for k, slots, width in ((5, 64, 2), (2, 8, 3)):
        got = frame.select("text", order_minhash.signature(F.col("text"), k, slots, width).alias("s")).collect()
        for r in got:
            assert r.s == brute_signature(r.text, k, slots, width), (r.text, k)


def test_fingerprints_follow_the_ring(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {r.doc_id: r for r in order_minhash.fingerprints(docs).collect()}
    ring = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), reverse=True)
    prints: dict[str, set] = {}
    for k, (i, text) in enumerate(ring):
        n = len(text) // 3
        following = ring[(k + 1) % len(ring)]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - n] + following[1][:n]).encode()).hexdigest()
        assert (got[i].near_next == 1) == (got[i].fingerprint == got[following[0]].fingerprint)
        prints.setdefault(text, set()).add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r.near_edited for r in got.values()]) > 0.15 > 0.02 > np.mean([r.near_next for r in got.values()])
    edge = order_minhash.fingerprints(edge_docs).collect()
    assert len(edge) == 8 and sum(r.fingerprint == "-" for r in edge) == 2
    assert len({tuple(r) for r in edge if r.doc_id == 1}) == 2
    assert order_minhash.fingerprints(no_docs).collect() == []


# --- 8: main text --------------------------------------------------------------------------------


def test_pages_give_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    for r in queries.op8_main_text(spark, SF01).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        ("<article>abc<script>if(a<b){'</p>'}</script>def<!-- x > y --> ghi</article>", "abcdef ghi"),
        ("<article><p>One.</p><aside>rel</aside><div class='ad'>buy</div><p>Two.</p><section class=comments><article>me too</article></section></article>", "One.\n\nTwo."),
        ("<nav><p>never closed <article>body &amp; soul&nbsp;&#233;</article>", "body & soul é"),
        ("<div class=menu><a>x</a></div><h1>Title</h1><p>Some long text that goes on<p>and on, with <b>mark</b>up<footer>f</footer>", "Title\n\nSome long text that goes on\n\nand on, with markup"),
        ("<article><p title='a > b'>kept</p><p>cut off <a hre", "kept\n\ncut off"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


LONG = "Long enough a text to be the main one of any page, with some commas, and more words than a menu has. " * 5


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body class='single no-sidebar'><p>{LONG}</p></body>", LONG.strip()),
        (f"<body class='sidebar-left'><article class='post has-comments'><p>{LONG}</p></article><div class='comments'>me too</div></body>", LONG.strip()),
        (f"<body><div class='layout no-sidebar'><main id='menu'><p>{LONG}</p><div class='share-bar--no-count'>Share</div></main></div></body>", LONG.strip()),
        (f"<body><div><div><div><h1>Title</h1></div></div></div><div><div><div><div><p>{LONG}</p></div></div></div></div></body>", f"Title\n\n{LONG.strip()}"),
    ],
)
def test_names_of_states_and_nested_blocks_lose_no_text(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><div class='ad-free content'><p>{LONG}</p></div></article>", LONG.strip()),
        (f"<div class='topic social-science'><p>{LONG}</p></div>", LONG.strip()),
        (f"<article><p>{LONG}</p><section id='related-work'><p>Others did it.</p></section></article>", f"{LONG.strip()}\n\nOthers did it."),
        (f"<article><p>{LONG}</p><p class='share-price'>It fell.</p></article>", f"{LONG.strip()}\n\nIt fell."),
        (f"<div class='entry-header'><h1>Title</h1></div><div><p>{LONG}</p></div>", f"Title\n\n{LONG.strip()}"),
        (f"<div><p>{LONG}</p></div><article><p>A small card.</p></article>", LONG.strip()),
        (f"<article><p>Short.</p></article><div class='related-posts'><p>{LONG}</p></div><div id='comments-area'><p>{LONG}</p></div>", "Short."),
        (f"<div class='site-header'><p>{LONG}</p></div><article><p>Story.</p></article><div class='newsletter-signup-box'>{LONG}</div>", "Story."),
        (f"<article><p>{LONG}</p></article><div>A line of nobody's.</div>", LONG.strip()),
    ],
)
def test_names_and_cards_lose_no_text(html, text):
    assert html_extract.main_text(html) == text


def test_stretches_against_brute_force():
    draw = random.Random(2)
    for _ in range(300):
        weights = [draw.choice([0, 0, 0, 0, 1, 5, 90]) for _ in range(draw.randrange(30))]
        windows = [sum(weights[j] for j in range(i - html_extract.WINDOW + 1, i + 1) if 0 <= j < len(weights)) for i in range(len(weights) + html_extract.WINDOW)]
        runs, want = "".join("x" if w else " " for w in windows), []
        for m in re.finditer("x+", runs):
            want.append((m.start(), min(m.end(), len(weights)), max(windows[m.start() : m.end()])))
        assert html_extract.stretches(weights) == want


def test_main_text_keeps_rows(spark):
    pages = spark.createDataFrame([(1, None, "<p>a</p>", "x"), (1, None, "<p>a</p>", "x"), (None, "u", None, "y")], "page_id bigint, url string, html string, text string")
    assert sorted(r.text for r in html_extract.extract(pages).collect()) == ["", "a", "a"]
    assert html_extract.extract(pages.limit(0)).collect() == []


# --- 9: language ---------------------------------------------------------------------------------


def test_windows_equal_brute_force():
    texts = ["", None, "a", "Ab, cd!", "Été 1 z", "xyz" * 7]
    full = {}
    usual = grams.CHUNK_CHARS
    for size in (10**6, 5):
        grams.CHUNK_CHARS, found = size, []
        try:
            for codes, starts, rows, counted in grams.chunks(texts, 3):
                for n in (1, 2, 4):
                    buckets, valid = grams.windows(codes, starts, counted, n, 16)
                    owner = rows[np.searchsorted(starts, np.arange(len(codes)), "right") - 1]
                    found += [(int(o), n, int(b)) for o, b in zip(owner[valid], buckets[valid], strict=True)]
        finally:
            grams.CHUNK_CHARS = usual
        full[size] = sorted(found)
    assert full[10**6] == full[5]
    number = 0
    for t in texts:
        folded = "".join(c.lower() if c.isalpha() else " " for c in f" {t or ''} ")
        number += sum(" " not in folded[i + (n > 1) : i + n] for n in (1, 2, 4) for i in range(len(folded) - n + 1))
    assert number == len(full[5])


def test_language_is_learned_from_the_rest(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = langid.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    # Labels of held-out rows and other columns are no inputs.
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(map(tuple, langid.identify(other).collect())) == sorted(map(tuple, got))
    edge = langid.identify(edge_docs).collect()
    assert len(edge) == 8 and sum(r.lang_pred == "und" and r.score == 0 for r in edge) == 3
    assert {r.lang_pred for r in langid.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(no_docs).collect() == []


# --- 1: toxicity ---------------------------------------------------------------------------------


def test_ordinal_fit_recovers_order():
    draw = np.random.default_rng(0)
    x = draw.standard_normal((3000, 3))
    grade = np.digitize(x @ [2.0, -1.0, 0.0] + draw.logistic(size=3000), [0.5, 2.5])
    rows, features = np.indices(x.shape).reshape(2, -1)
    w, t = toxicity.fit_ordinal(rows, features, x.ravel(), grade, 3, l2=0, steps=600)
    assert np.allclose(w, [2, -1, 0], atol=0.2) and np.allclose(t, [0.5, 2.5], atol=0.25)


def test_toxicity_generalises(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    model = toxicity.fit(docs, even)
    assert (np.diff(model.thresholds) > 0).all()
    scored = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    toxic, clean = [[r for r in scored if r.label == y] for y in (1, 0)]
    assert np.mean([r.toxic for r in toxic]) > 0.85 and np.mean([r.toxic for r in clean]) < 0.01
    pairs = [(a.expected_severity > b.expected_severity) for a in toxic for b in clean]
    assert np.mean(pairs) > 0.95
    assert all(abs(r.expected_severity - 0) >= r.toxic_probability - 1e-9 for r in scored)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {r.doc_id for r in toxicity.score(docs, model).where("not toxic").collect()}


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (4, 1, 0), (None, 0, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(edge_docs, labels)
    assert toxicity.score(edge_docs, model).count() == 8
    assert toxicity.keep_clean(edge_docs, model).columns == edge_docs.columns
    for frame, marks in ((edge_docs, labels.limit(0)), (no_docs, labels), (edge_docs, labels.where("toxic = 0"))):
        nothing = toxicity.fit(frame, marks)
        assert not any(r.toxic for r in toxicity.score(frame, nothing).collect())
        assert toxicity.keep_clean(frame, nothing).count() == frame.count()


def test_rank_file_is_a_parameter(tmp_path):
    path = tmp_path / "tiny.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)) + f"{base64.b64encode(b'ab').decode()} 256\n")
    codec = bpe.BpeCodec.from_tiktoken(str(path), P.PATTERN)
    assert codec.pretoken("abab") == [256, 256] and codec.pretoken("ab") == [256] and codec.decode([256, 97]) == b"aba"
