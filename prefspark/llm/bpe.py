"""Operator 2: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary (hash and displace): a whole
pre-token that is itself a token is resolved with one probe and one byte comparison.
Tier two, for the misses, merges bytes with a heap over a doubly linked list, lowest rank
first and leftmost on ties.

Each match of the split pattern is encoded on its own, so a run of text between two single
spaces always splits in the same way; its ids are kept in a bounded two-generation cache.
Text with other white space around a space goes through the pattern as a whole.

Edge cases: null text is encoded as the empty text (no ids, hash of no bytes); text of any
length is encoded whole; repeated rows give repeated results; an empty table gives an empty
result; only the id and the text column are read, so further columns never clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

CACHE_ENTRIES = 300_000  # pieces in one cache generation; memory only, results don't depend on it
CACHED_CHARS = 64  # longer pieces are rarely seen twice


class MinimalPerfectHash:
    """Hash-and-displace: ``n`` byte strings to the slots ``0..n-1`` without gaps.

    Keys are grouped in buckets by one half of a 64-bit hash. Larger buckets go first and look
    for a displacement that sends all their keys to free slots; a bucket of one key stores its
    slot itself (as ``-slot - 1``). Tries are bounded: a build that finds no displacement for a
    bucket starts again with another seed and, every few seeds, twice the buckets, until few
    hold several keys.
    """

    PER_BUCKET = 4
    SEEDS = 4  # for each number of buckets

    def __init__(self, keys: list[bytes]):
        if len(keys) != len(set(keys)):
            raise ValueError("keys of a perfect hash must be distinct")
        self.n, self.seed = len(keys), 0
        self.n_buckets = max(1, self.n // self.PER_BUCKET)
        while not self._build(keys):
            self.seed += 1
            self.n_buckets <<= self.seed % self.SEEDS == 0

    def _build(self, keys: list[bytes]) -> bool:
        n = self.n
        self.displace = [0] * self.n_buckets
        self.slots: list[tuple[bytes, int] | None] = [None] * n
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.n_buckets)]
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key, self.seed)
            buckets[h % self.n_buckets].append((h, i))
        used = bytearray(n)
        singles = []
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            group = buckets[b]
            if len(group) <= 1:
                singles += [(b, i) for _, i in group]
                continue
            for d in range(n + 64):
                places = [self._place(h, d) for h, _ in group]
                if len(set(places)) == len(places) and not any(used[p] for p in places):
                    break
            else:
                return False
            self.displace[b] = d
            for (_, i), p in zip(group, places, strict=True):
                used[p] = 1
                self.slots[p] = (keys[i], i)
        free = (p for p in range(n) if not used[p])
        for b, i in singles:
            p = next(free)
            self.displace[b] = -p - 1
            self.slots[p] = (keys[i], i)
        return True

    def _place(self, h: int, d: int) -> int:
        return ((h >> 32) + d * ((h >> 20 & 0xFFF) * 2 + 1) + (d * d)) % self.n

    def find(self, key: bytes) -> int:
        """Index of ``key`` among the keys, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = self.displace[h % self.n_buckets]
        held = self.slots[-d - 1 if d < 0 else self._place(h, d)]
        return held[1] if held[0] == key else -1


class BpeCodec:
    """Encoder and decoder for one rank table and split pattern (pickled to the tasks)."""

    def __init__(self, tokens: list[tuple[bytes, int]], pattern: str):
        self.pattern = pattern
        self.ids = [i for _, i in tokens]
        self.table = MinimalPerfectHash([t for t, _ in tokens])
        self.rank = dict(tokens)
        self.bytes_of = {i: t for t, i in tokens}
        self.byte_rank = [self.rank[bytes([b])] for b in range(256)]

    @classmethod
    def from_tiktoken(cls, path: str, pattern: str) -> BpeCodec:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return cls([(base64.b64decode(t), int(i)) for t, i in pairs], pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: merge neighbouring parts, always the pair of lowest rank, leftmost first.

        A heap entry holds a pair's rank and the start of its left part in one integer; it is
        out of date if the pair that starts there now has another rank.
        """
        n, rank = len(piece), self.rank.get
        bits = n.bit_length()
        after = list(range(1, n + 1))  # start of the part to the right; n: none
        before = list(range(-1, n))
        tokens = list(map(self.byte_rank.__getitem__, piece))
        pair = [rank(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [(r << bits) + i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        here = (1 << bits) - 1
        while heap:
            entry = heappop(heap)
            i, r = entry & here, entry >> bits
            if pair[i] != r:
                continue
            mid = after[i]
            end = after[mid]
            tokens[i], tokens[mid], pair[mid] = r, -1, -1
            after[i] = end
            if end < n:
                before[end] = i
                r = pair[i] = rank(piece[i : after[end]], -1)
                if r >= 0:
                    heappush(heap, (r << bits) + i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                r = pair[left] = rank(piece[left:end], -1)
                if r >= 0:
                    heappush(heap, (r << bits) + left)
        return [t for t in tokens if t >= 0]

    def pretoken(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        k = self.table.find(raw)
        return [self.ids[k]] if k >= 0 else self.merge(raw)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PieceCache(dict):
    """Ids (as packed bytes) by piece of text; at most two generations of entries are held."""

    def __init__(self, encode: Callable[[str], bytes | None], entries: int):
        super().__init__()
        self.encode, self.entries, self.older = encode, entries, {}

    def __missing__(self, piece: str) -> bytes | None:
        packed = self.older.get(piece)
        if packed is None:
            packed = self.encode(piece)
        if packed is not None and len(piece) <= CACHED_CHARS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class TextEncoder:
    """Whole texts to packed little-endian ids. ``words`` gives the ids of one pattern match;
    ``typecode`` is that of ``array`` (I: 32 bits, H: 16 bits)."""

    def __init__(self, words: Callable[[str], list[int]], pattern: str, typecode: str = "I", entries: int = CACHE_ENTRIES):
        self.ids_of, self.typecode = words, typecode
        self.split = regex.compile(pattern).findall
        self.letters_alone = pattern == public_tokenizers.PATTERN  # in it, a space and letters are one match
        self.words = PieceCache(self._word, entries)
        self.spaced = PieceCache(self._spaced, entries)

    def _word(self, word: str) -> bytes:
        return array(self.typecode, self.ids_of(word)).tobytes()

    def _spaced(self, piece: str) -> bytes | None:
        """Ids of a space and ``piece``; None if its white space may join that around it."""
        if self.letters_alone and piece.isalpha() and max(piece) < "\u0250":
            return self._word(" " + piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        first, *rest = self.split(" " + piece)
        if not rest:
            return self._word(first)
        return (self.spaced[first[1:]] if first[1:] else self.words[first]) + b"".join(map(self.words.__getitem__, rest))

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.spaced.__getitem__, rest))
        except TypeError:  # a piece without ids of its own: white space next to a space
            return self.whole(text)


def _digests(codec_of: Callable[[], BpeCodec]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        encoder = TextEncoder(codec.pretoken, codec.pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                packed = encoder.encode(text.as_py() or "")
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                ids = np.frombuffer(packed, "<u4").tolist()
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _arrays(codec_of: Callable[[], BpeCodec]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        encoder = TextEncoder(codec.pretoken, codec.pattern)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t.as_py() or ""), "<u4").astype("<i4") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoded(codec_of: Callable[[], BpeCodec]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            raw = [codec.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return run


@functools.lru_cache(maxsize=4)
def _codec(path: str, pattern: str) -> BpeCodec:
    return BpeCodec.from_tiktoken(path, pattern)


def shared_codec(spark: SparkSession, path: str, pattern: str) -> Callable[[], BpeCodec]:
    """The codec as a broadcast value (its size is the vocabulary file's, not the data's)."""
    held = spark.sparkContext.broadcast(_codec(path, pattern))
    return lambda: held.value


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) of every whole text."""
    pairs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    codec = shared_codec(docs.sparkSession, path, pattern)
    return pairs.mapInArrow(_arrays(codec), f"doc_id {pairs.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``decoded`` (binary: the UTF-8 bytes that the ids stand for)."""
    pairs = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    codec = shared_codec(encoded.sparkSession, path, pattern)
    return pairs.mapInArrow(_decoded(codec), f"doc_id {pairs.schema[0].dataType.simpleString()}, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass; lengths and hashes of both sides."""
    pairs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    codec = shared_codec(docs.sparkSession, path, pattern)
    return pairs.mapInArrow(
        _digests(codec),
        f"doc_id {pairs.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
