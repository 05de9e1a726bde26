"""Operator 12: alignment of two tokenizers' tokens by merge-path partitioning.

Each text, after a space, is encoded by A (a byte-level BPE file) and B (a piece model that adds
the space itself). Both token lists spell the same bytes, so both have an ascending list of byte
ends. Texts of a slice are laid end to end; every text's end is an end on both sides, so nothing
spans two texts.

1. Merging the two lists of ends is a path of steps right (an A end) and down (a B end, after an
   equal A end). Every WORK-th diagonal crosses it once; a binary search, for all diagonals at
   once, finds where. The pieces between diagonals have equal work and are merged independently.
2. A piece emits one overlap for each distinct end in it: between two neighbouring ends lies
   exactly one A token and one B token, and each overlapping pair has exactly one such stretch.
   Ends on both sides are cuts.
3. At a boundary a token may go on into the next piece, and equal ends may be parted: the next
   piece leaves out an end that the last A end before it equals, and cuts are numbered on from
   piece to piece, which stitches the groups.

Corpus counts: a text gives each linked id pair once, with its number of links, packed in one
row; rows are written once. Counts are merged in the tasks and then by pair, and each A id's
highest is found among its pairs (at most B's vocabulary). The counts meet the rows by ranges of
pairs: while all pairs fit LOOKUP_PAIRS the one range is broadcast; beyond that packed rows are
shuffled by (range, part of the rows), each range's counts ahead of them, and read as a stream.

Edge cases: null and empty texts, and texts that either tokenizer doesn't give back byte for byte,
have no tokens: zeros and an empty ``groups_sha256``. Special tokens' strings are ordinary text.
Rows that repeat an id or text are documents of their own. Long texts are encoded whole, by
themselves. An empty table gives an empty result. Only the id and text columns are read, so
further columns never clash.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm import rank_encoder
from prefspark.session import materialize, ship_package

WORK = 1 << 16  # steps of a piece
SLICE_CHARS = 500_000  # of the texts aligned at once
LOOKUP_PAIRS = 1 << 21  # id pairs whose counts a task holds at once, 16 bytes each
HELD_PAIRS = 1 << 22  # id pairs that a counting task collects before it merges them


class Overlaps(NamedTuple):
    """Links in byte order (A index, B index) and which of them end a group."""

    a: np.ndarray
    b: np.ndarray
    cut: np.ndarray


def crossings(a_ends: np.ndarray, b_ends: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """A ends among the first ``d`` steps of the merge, for each diagonal ``d``; an A end goes before an equal B end."""
    low, high = np.maximum(diagonals - len(b_ends), 0), np.minimum(diagonals, len(a_ends))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        right = np.zeros(len(diagonals), bool)
        right[open_] = a_ends[mid[open_]] <= b_ends[diagonals[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def piece_overlaps(a_ends: np.ndarray, b_ends: np.ndarray, a_span: tuple[int, int], b_span: tuple[int, int]) -> Overlaps:
    """What one piece emits; of the ends outside it, it sees the A end before it and one end after it on each side."""
    a, b = a_ends[slice(*a_span)], b_ends[slice(*b_span)]
    ends = np.sort(np.concatenate([a, b]), kind="stable")
    fresh = np.ones(len(ends), bool)
    fresh[1:] = ends[1:] != ends[:-1]
    if a_span[0] and len(ends):
        fresh[0] = ends[0] != a_ends[a_span[0] - 1]  # the piece before has emitted it
    ends = ends[fresh]
    of_a, of_b = a_span[0] + np.searchsorted(a, ends), b_span[0] + np.searchsorted(b, ends)
    return Overlaps(of_a, of_b, (a_ends[of_a] == ends) & (b_ends[of_b] == ends))


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray, work: int = WORK) -> Overlaps:
    """All links of two lists of ascending ends with the same last end, piece by piece."""
    if not len(a_ends):
        return Overlaps(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    steps = len(a_ends) + len(b_ends)
    diagonals = np.concatenate([np.arange(0, steps, work), [steps]])
    i = crossings(a_ends, b_ends, diagonals)
    j = diagonals - i
    pieces = [piece_overlaps(a_ends, b_ends, (i[k], i[k + 1]), (j[k], j[k + 1])) for k in range(len(diagonals) - 1)]
    return Overlaps(*map(np.concatenate, zip(*pieces, strict=True)))


class Vocabularies:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, json: str, plain: bool, model: bytes):
        import sentencepiece

        self.encoder_a = rank_encoder.encoder(json, plain, True)
        self.encoder_b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a = [b or b"" for b in rank_encoder.vocabulary(json)]
        self.bytes_a += [b""] * (self.encoder_a.n_ids - len(self.bytes_a))
        self.bytes_b = [self._piece(i) for i in range(self.encoder_b.get_piece_size())]
        self.table_a, self.table_b = np.array(self.bytes_a, object), np.array(self.bytes_b, object)
        self.long_a, self.long_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        # How a token reads in the groups' text, by whether it is the last of its side in the group.
        sides = [(len(self.bytes_a), ",", "|"), (len(self.bytes_b), ",", ";")]
        self.read = np.array([f"{i}{mark}".encode() for n, *marks in sides for i in range(n) for mark in marks], object)
        self.bits_b = max(1, (len(self.bytes_b) - 1).bit_length())

    def _piece(self, i: int) -> bytes:
        sp = self.encoder_b
        if sp.is_control(i) or sp.is_unknown(i):
            return b""
        piece = sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and by B of each text; both empty where the text is empty or either doesn't spell it."""
        a = self.encoder_a.encode([" " + t for t in texts])
        b = [np.array(ids, np.int64) for ids in self.encoder_b.encode(texts, num_threads=1)]
        none = np.zeros(0, np.int64)
        for k, text in enumerate(texts):
            raw = b" " + text.encode()
            if not text or b"".join(self.table_a[a[k]].tolist()) != raw or b"".join(self.table_b[b[k]].tolist()) != raw:
                a[k] = b[k] = none
        return a, b


@functools.lru_cache(maxsize=1)
def _vocabularies(json: str, plain: bool, model: bytes) -> Vocabularies:
    """The Python worker's tokenizers, kept between tasks."""
    return Vocabularies(json, plain, model)


def _before(counts: np.ndarray) -> np.ndarray:
    """Sum of the counts before each place, and of all at the end."""
    return np.concatenate([[0], np.cumsum(counts)])


class Aligned(NamedTuple):
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]  # digests
    pairs: list[np.ndarray]  # linked id pairs, ascending
    times: list[np.ndarray]  # links of each


def align(v: Vocabularies, texts: list[str], work: int = WORK) -> Aligned:
    """Alignment of some texts, laid end to end."""
    a_of, b_of = v.encode(texts)
    n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a_of, b_of))
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]).astype(np.int64) for side in (a_of, b_of))
    a_ends, b_ends = np.cumsum(v.long_a[a]), np.cumsum(v.long_b[b])
    links = overlaps(a_ends, b_ends, work)
    text_of = np.repeat(np.arange(len(texts)), n_a)[links.a]
    n_links, n_groups = np.bincount(text_of, minlength=len(texts)), np.bincount(text_of[links.cut], minlength=len(texts))
    # Groups: the cuts before a token number its group; a group's A tokens stand before its B tokens.
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[links.a[links.cut]] = last_b[links.b[links.cut]] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    ends_a, ends_b = np.flatnonzero(last_a) + 1, _before(np.bincount(group_b))
    spoken = np.zeros(len(a) + len(b), np.int64)
    spoken[np.arange(len(a)) + ends_b[group_a]] = 2 * a + last_a
    if len(b):
        spoken[np.arange(len(b)) + ends_a[group_b]] = 2 * len(v.bytes_a) + 2 * b + last_b
    read = v.read[spoken].tolist()
    edges = _before(n_a + n_b).tolist()
    groups = [hashlib.sha256(b"".join(read[s:e])[:-1]).hexdigest() if e > s else "" for s, e in itertools.pairwise(edges)]
    # Each text's linked pairs, once each.
    bits = v.bits_b + max(1, (len(v.bytes_a) - 1).bit_length())
    keys = (a[links.a] << v.bits_b | b[links.b]).astype(np.uint64) | text_of.astype(np.uint64) << np.uint64(bits)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    cuts = np.searchsorted(keys >> np.uint64(bits), np.arange(1, len(texts), dtype=np.uint64))
    pairs = (keys & np.uint64((1 << bits) - 1)).astype("<u4" if bits <= 32 else "<u8")
    return Aligned(n_a, n_b, n_groups, n_links, groups, np.split(pairs, cuts), np.split(times, cuts))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


_ROW = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def _aligned(vocabularies: Callable[[], Vocabularies], work: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies()
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for s, e in _slices(texts):
                    r = align(v, texts[s:e], work)
                    small = [t.astype("<u1" if not len(t) or t.max() < 256 else "<u4").tobytes() for t in r.times]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).slice(s, e - s), *map(pa.array, (r.n_a, r.n_b, r.n_groups, r.n_links)), pa.array(r.groups, pa.string()), pa.array([p.tobytes() for p in r.pairs], pa.binary()), pa.array(small, pa.binary())],
                        names=_ROW,
                    )

    return run


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, and the sums of their counts."""
    keys, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate(counts), len(keys)).astype(np.int64)


def _counted(dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pair, n) of a task's rows, merged whenever HELD_PAIRS are waiting; given out when many distinct ones are held."""

    def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for raw in batch.column(0):
                found = np.frombuffer(raw.as_py(), dtype)
                keys.append(found)
                counts.append(np.ones(len(found), np.int64))
                held += len(found)
                if held >= HELD_PAIRS:
                    k, n = _merged(keys, counts)
                    keys, counts, held = [k], [n], len(k)
                    if held >= HELD_PAIRS // 2:
                        yield batch_of(k, n)
                        keys, counts, held = [], [], 0
        if held:
            yield batch_of(*_merged(keys, counts))

    return run


class Lookup(NamedTuple):
    """Counts of some pairs, ascending; ``best`` says that no pair of the same A id counts more."""

    pairs: np.ndarray
    n: np.ndarray
    best: np.ndarray

    def sums(self, rows: Iterator[tuple[bytes, bytes]], dtype: str) -> Iterator[tuple[int, int]]:
        """(n_best, count_sum) of rows of (pairs, times), over the pairs held here."""
        for pairs, times in rows:
            keys = np.frombuffer(pairs, dtype)
            wide = "<u1" if len(times) == len(keys) else "<u4"
            at = np.searchsorted(self.pairs, keys)
            at[at == len(self.pairs)] = 0
            t = np.frombuffer(times, wide).astype(np.int64) * (self.pairs[at] == keys) if len(self.pairs) else np.zeros(len(keys), np.int64)
            yield (int(t[self.best[at]].sum()), int((t * self.n[at]).sum())) if len(self.pairs) else (0, 0)


def _lookup(rows: list[tuple[int, int, bool]] | np.ndarray, dtype: str) -> Lookup:
    pairs, n, best = (np.asarray(c) for c in rows)
    order = np.argsort(pairs)
    return Lookup(pairs[order].astype(dtype), n[order].astype(np.int64), best[order].astype(bool))


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a pair: by a multiplicative hash, so that ranges are of equal size."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(ranges)


def _split(dtype: str, ranges: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row, pairs, times) once for each range that they have pairs in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pairs, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.frombuffer(pairs, dtype)
                wide = "<u1" if len(times) == len(keys) else "<u4"
                t, of = np.frombuffer(times, wide), _range_of(keys, ranges)
                out = [(int(r), row % parts, 1, row, keys[of == r].tobytes(), t[of == r].tobytes()) for r in np.unique(of)]
                if out:
                    columns = list(zip(*out, strict=True))
                    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(columns, types, strict=True)], names=["range", "rows_part", "kind", "row", "pairs", "times"])

    return run


def _streamed(dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted by (range, part, kind): a group's counts (kind 0) come first and are held, its rows (kind 1) pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, lookup = None, [], None
        for batch in batches:
            out = []
            for r, part, kind, row, pairs, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r, part) != group:
                    group, blocks, lookup = (r, part), [], None
                if kind == 0:
                    blocks.append((np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i8")))
                    continue
                if lookup is None:
                    keys, packed = (np.concatenate([b[c] for b in blocks]) for c in (0, 1))
                    lookup = _lookup((keys, packed >> 1, packed & 1), dtype)
                out.append((row, *next(lookup.sums(iter([(pairs, times)]), dtype))))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "n_best", "count_sum"])

    return run


def _packed_counts(ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (pair, n, best) as a few packed blocks for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, best = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            of = _range_of(keys, ranges)
            rows = [(int(r), keys[of == r].astype("<i8").tobytes(), (n[of == r] << 1 | best[of == r]).astype("<i8").tobytes()) for r in np.unique(of)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["range", "pairs", "times"])

    return run


def alignments(docs: DataFrame, json_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", lookup_pairs: int = LOOKUP_PAIRS, work: int = WORK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(json_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        json, model = f.read(), g.read()
    held = spark.sparkContext.broadcast((json, rank_encoder.is_plain(json), model))  # the vocabulary files' size, not the data's
    here = Vocabularies(json, False, model)
    dtype = "<u4" if here.bits_b + max(1, (len(here.bytes_a) - 1).bit_length()) <= 32 else "<u8"
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = texts.schema[0].dataType.simpleString()
    rows = texts.mapInArrow(_aligned(lambda: _vocabularies(*held.value), work), f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "alignments")
    counts = rows.select("pairs").mapInArrow(_counted(dtype), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", here.bits_b))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    counts = materialize(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-counts")
    total = counts.count()
    ranges = -(-total // lookup_pairs)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if ranges <= 1:
        table = counts.toPandas()  # at most ``lookup_pairs`` rows
        shared = spark.sparkContext.broadcast(_lookup((table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()), dtype))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = list(shared.value.sums(((p.as_py(), t.as_py()) for p, t in zip(batch.column("pairs"), batch.column("times"), strict=True)), dtype))
                best, total_of = ([s[k] for s in sums] for k in (0, 1))
                columns = {c: batch.column(c) for c in out if c in _ROW} | {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total_of, pa.int64())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in out], names=out)

        return rows.select(*_ROW).mapInArrow(look_up, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    parts = -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // ranges)
    tables = counts.mapInArrow(_packed_counts(ranges), "range int, pairs binary, times binary")
    tables = tables.select("range", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("rows_part"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("row"), "pairs", "times")
    split = rows.select("row", "pairs", "times").mapInArrow(_split(dtype, ranges, parts), "range int, rows_part int, kind int, row bigint, pairs binary, times binary")
    met = tables.unionByName(split).repartition("range", "rows_part").sortWithinPartitions("range", "rows_part", "kind")
    sums = met.mapInArrow(_streamed(dtype), "row bigint, n_best bigint, count_sum bigint").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = rows.drop("pairs", "times").join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return joined.select(*out)
