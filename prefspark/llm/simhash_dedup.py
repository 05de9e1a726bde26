"""Operator 11: SimHash near-dedup with pigeonring filtering.

A text's words are what ASCII white space separates, A-Z in lower case; its features are its
three-word shingles, repeats included (fewer words are one shingle), hashed with XXH64. A
fingerprint bit is 1 if more than half of the features have it. Fingerprints that differ in at
most DISTANCE bits are linked; a document's class is its connected component.

The 64 bits are a ring of SEGMENTS segments. If two fingerprints differ in at most DISTANCE
bits, then some segment starts a chain in which the first 1, 2, 3, ... segments together differ
in no more than that number times DISTANCE / SEGMENTS bits: the pigeonring. As bits are whole, the
first KEYED segments of the chain must be equal, which makes them a join key (25 or 26 bits);
the longer chains prune what meets there, and only the rest is compared in full.

1. Fingerprints, written once; then each distinct one is handled once, with how many share it.
2. Each is an entry under its SEGMENTS chain keys. Keys with a single entry are done.
3. Keys with up to CROWD entries come together as one row; a task tries all of a row's pairs.
4. Entries under larger keys are linked exactly without trying pairs: each gives its 65 values at
   a distance of at most 1, and two fingerprints share such a value if and only if they differ
   in at most 2 bits. At most 65 fingerprints share one value, so
   work grows in proportion to the entries however many share a key.
5. Components of the links; the least document id of each.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other.
Rows that repeat an id are returned as often as they come, each with its own text's
fingerprint. A row with a null id is returned, but never names a component; a component of null ids alone has a null
component_id. Long texts are hashed in pieces cut at words. An empty table gives an empty result.
Only the id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.components import components
from prefspark.session import materialize, ship_package

BITS = 64
DISTANCE = 2
SHINGLE_WORDS = 3
SEED = 42
SEGMENTS = 5
CROWD = 256  # entries of a key that are paired directly
PIECE_BYTES = 1 << 20  # of a text handled at once
_SPACE = b" \t\n\r\x0b\x0c"
_EDGES = [BITS * i // SEGMENTS for i in range(SEGMENTS + 1)]
KEYED = (SEGMENTS - 1) // DISTANCE  # longest chain whose budget is below one bit


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut after white space into pieces of about PIECE_BYTES."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(raw) and raw[end - 1] not in _SPACE:  # up to the word's end
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of the shingles of ``words``, at least SHINGLE_WORDS of them."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - SHINGLE_WORDS + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, n)


def fingerprint(raw: bytes) -> int:
    """Fingerprint of a text in UTF-8, as an unsigned integer."""
    ones, n = np.zeros(BITS, np.int64), 0
    carried: list[bytes] = []
    for piece in _pieces(raw):
        words = carried + piece.lower().split()  # bytes: A-Z and ASCII white space only
        if len(words) >= SHINGLE_WORDS:
            h = _hashes(words)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for at in range(0, len(bits), 1 << 15):
                ones += bits[at : at + (1 << 15)].sum(axis=0, dtype=np.uint16)
            n += len(h)
            carried = words[1 - SHINGLE_WORDS :]
        else:
            carried = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
        prints = np.fromiter((fingerprint(t.as_py() or b"") for t in raw), np.uint64, len(raw))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long."""
    ship_package(docs.sparkSession)
    pairs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return pairs.mapInArrow(_fingerprints, f"doc_id {pairs.schema[0].dataType.simpleString()}, fp bigint")


def chain_keys(fp: np.ndarray) -> np.ndarray:
    """Key of the chain that each segment starts, one column for each start; bits outside the chain are 0."""
    out = np.zeros((len(fp), SEGMENTS), np.uint64)
    for start in range(SEGMENTS):
        mask = sum((((1 << _EDGES[(start + i) % SEGMENTS + 1]) - (1 << _EDGES[(start + i) % SEGMENTS])) for i in range(KEYED)))
        out[:, start] = fp & np.uint64(mask)
    return out


def ring_viable(differ: np.ndarray, start: int) -> np.ndarray:
    """Which differences hold every chain from ``start`` to its share of the budget, the whole ring last."""
    total, viable = np.zeros(len(differ), np.uint8), np.ones(len(differ), bool)
    for i in range(SEGMENTS):
        k = (start + i) % SEGMENTS
        segment = np.uint64((1 << _EDGES[k + 1]) - (1 << _EDGES[k]))
        at = np.flatnonzero(viable)
        total[at] += np.bitwise_count(differ[at] & segment)
        viable[at] = total[at] <= (i + 1) * DISTANCE // SEGMENTS
    return viable


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (start, fingerprints under one key): the links among them."""
    for batch in batches:
        found: list[np.ndarray] = []
        offsets = batch.column(1).offsets.to_numpy()
        members = batch.column(1).values.to_numpy().view(np.uint64)
        sizes = np.diff(offsets)
        # Keys of the same start and size go through numpy together.
        starts = batch.column(0).to_numpy()
        for start, size in sorted(set(zip(starts.tolist(), sizes.tolist(), strict=True))):
            rows = np.flatnonzero((starts == start) & (sizes == size))
            i, j = np.triu_indices(size, 1)
            step = max(1, (1 << 20) // max(1, len(i)))
            for at in range(0, len(rows), step):
                block = members[offsets[rows[at : at + step]][:, None] + np.arange(size)]
                a, b = block[:, i].ravel(), block[:, j].ravel()
                held = ring_viable(a ^ b, int(start))
                found.append(np.stack([a[held], b[held]]))
        both = np.concatenate([np.zeros((2, 0), np.uint64), *found], axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        keys = chain_keys(fp)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(SEGMENTS, dtype=np.int32), len(fp))), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, SEGMENTS).view(np.int64))],
            names=["start", "key", "fp"],
        )


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, fp): each fingerprint's values at a distance of at most 1, half of DISTANCE."""
    flips = np.concatenate([[0], np.uint64(1) << np.arange(BITS, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fp), 1000):
            some = fp[at : at + 1000]
            near = (some[:, None] ^ flips[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64))], names=["value", "fp"])


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) over the distinct ``fp``: links that connect all fingerprints which a chain of links of at most DISTANCE bits connects."""
    entries = distinct.select("fp").mapInArrow(_keyed, "start int, key bigint, fp bigint")
    sizes = entries.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(entries.join(sizes, ["start", "key"]), "simhash-entries")
    few = met.where(F.col("n") <= crowd).groupBy("start", "key").agg(F.collect_list("fp").alias("members"))
    paired = few.select("start", "members").mapInArrow(_pairs, "a bigint, b bigint")
    # The crowded keys: their fingerprints once each, linked through the values between them.
    many = met.where(F.col("n") > crowd).select("fp").distinct()
    near = many.mapInArrow(_ball, "value bigint, fp bigint").groupBy("value").agg(F.collect_list("fp").alias("members")).where("size(members) > 1")
    through = near.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a != b").distinct()
    return paired.unionByName(through)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least id of the class) and copies
    (documents with the same fingerprint) of every document."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-distinct")
    roots = components(links(distinct, crowd))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "copies", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id", "copies")
