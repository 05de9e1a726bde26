"""Operator 4: packing along a space-filling curve.

Each text is tokenised (the plain library call's ids, ``rank_encoder``), its hashed bag of tokens is projected to three dimensions, and the
place there becomes a Hilbert key. Documents are range-sorted by that key, so neighbours on the
curve are alike, and the ids are laid end to end in this order and cut every ``size`` tokens.
Sequences are full but for the end of the whole corpus, which is cut into powers of two, where
no padding is needed.

The order is found on keys and lengths alone: a range sort (ties by id and row), running sums
in each partition, one total for each partition. Only then do the ids move, once.

Edge cases: a null or empty text consists of its end id; equal keys and repeated rows are told
apart by a row number given when the ids are written; texts of any length are cut over as many
sequences as they need; an empty table gives no pieces; only the id and text columns are read,
so further columns never clash.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm import rank_encoder
from prefspark.session import materialize

DIMENSIONS = 3
KEY_BITS = 16  # of each dimension
HASHED = 4096  # token ids are hashed to so many features before the projection


@functools.lru_cache(maxsize=1)
def projection(n_ids: int, dimensions: int = DIMENSIONS, hashed: int = HASHED, seed: int = 7) -> np.ndarray:
    """Row of each id: its hashed feature's place in a fixed Gaussian projection."""
    ids = np.arange(n_ids, dtype=np.uint64)
    bucket = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % hashed
    sign = 1 - 2 * ((ids * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(np.int64)
    return np.random.default_rng(seed).standard_normal((hashed, dimensions))[bucket] * sign[:, None]


def hilbert_key(cells: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows of ``d`` coordinates below 2**bits).

    The curve's index is found digit by digit from the top: each level's orthant, reflected and
    exchanged as the levels above demand, gives ``d`` bits in Gray-code order.
    """
    x = cells.astype(np.int64).copy()
    d = x.shape[1]
    # Undo the turns of each level, from the highest bit down.
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for j in range(d):
            high = (x[:, j] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[:, 0] ^ x[:, j]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, j] ^= swap if j else 0
    # Gray code of the orthants, then their bits interleaved.
    for j in range(1, d):
        x[:, j] ^= x[:, j - 1]
    flip = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, d - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for j in range(d):
            key = (key << 1) | ((x[:, j] >> bit) & 1)
    return key


def id_type(n_ids: int) -> str:
    """Packed unsigned integers of 16 or 32 bits."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def _tokenise(file_of: Callable[[], tuple[str, bool]], end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder.encoder(*file_of(), specials_as_text=False)
        n_ids = max(end_id + 1, encoder.n_ids)
        table, dtype = projection(n_ids), id_type(n_ids)
        end = np.array([end_id], dtype)
        for batch in batches:
            packed, lengths = [], []
            places = np.zeros((len(batch), table.shape[1]))
            for row, text in enumerate(batch.column(1)):
                ids = np.concatenate([encoder.encode([text.as_py() or ""])[0].astype(dtype), end])
                packed.append(ids.tobytes())
                places[row] = table[ids].sum(axis=0) / np.sqrt(len(ids))
                lengths.append(len(ids))
            scale = 1 << KEY_BITS
            squashed = 0.5 + np.arctan(places / 4) / np.pi
            cells = np.minimum((squashed * scale).astype(np.int64), scale - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hilbert_key(cells)), pa.array(lengths, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "curve", "n", "ids"],
            )

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start of each row within its sorted partition."""
    part = TaskContext.get().partitionId()
    done = 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = done + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - n), pa.array(np.full(len(n), part, np.int32))], names=["row", "n", "within", "part"])
        done = int(ends[-1]) if len(n) else done


def _cuts(total: int, size: int) -> list[int]:
    """Ends of the short sequences after the last full one: powers of two, largest first."""
    at = total // size * size
    ends = []
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        ends.append(at)
    return ends


def _cut(size: int, dtype: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    width = np.dtype(dtype).itemsize

    def pieces(doc_id, packed: bytes, at: int, total: int) -> Iterator[tuple]:
        n, start, full = len(packed) // width, 0, total // size
        ends = _cuts(total, size)
        while start < n:
            place = at + start
            if place < full * size:
                sequence = place // size
                first, end = sequence * size, (sequence + 1) * size
            else:
                k = next(k for k, e in enumerate(ends) if place < e)
                sequence, first, end = full + k, ends[k - 1] if k else full * size, ends[k]
            length = min(n - start, end - place)
            wide = np.frombuffer(packed, dtype, length, start * width).astype("<u4").tobytes()
            yield (doc_id, start, length, zlib.crc32(wide), n, sequence, place - first) + (wide,) * with_ids
            start += length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p for doc_id, packed, at, total in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in pieces(doc_id, packed, at, total)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            types = [batch.schema.field(0).type, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def pack(docs: DataFrame, json_path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` ids, neighbours on the curve together.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    ``with_ids``, ids (binary, little-endian unsigned 32-bit integers). Concatenating a
    sequence's pieces by offset gives its ids.
    """
    spark = docs.sparkSession
    with open(json_path, encoding="utf-8") as f:
        json = f.read()
    held = spark.sparkContext.broadcast((json, rank_encoder.is_plain(json)))  # the vocabulary file's size, not the data's
    dtype = id_type(max(end_id + 1, rank_encoder.encoder(json, False, False).n_ids))
    pairs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = pairs.schema[0].dataType.simpleString()
    tokens = pairs.mapInArrow(_tokenise(lambda: held.value, end_id), f"doc_id {kind}, curve bigint, n bigint, ids binary")
    # Written once: tokens are not made twice, and the row numbers can't change on a retry.
    tokens = materialize(tokens.withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    order = tokens.select("row", "n", "curve", "doc_id").repartitionByRange("curve", "doc_id", "row").sortWithinPartitions("curve", "doc_id", "row")
    placed = materialize(order.select("row", "n").mapInArrow(_running, "row bigint, n bigint, within bigint, part int"), "pack-order")
    sums = placed.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each partition
    by_part = Window.orderBy("part")
    sums = sums.select("part", (F.sum("n").over(by_part) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    starts = placed.join(F.broadcast(sums), "part").select("row", (F.col("base") + F.col("within")).alias("at"), "total")
    laid = tokens.select("row", "doc_id", "ids").join(starts, "row").select("doc_id", "ids", "at", "total")
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"
    return laid.mapInArrow(_cut(size, dtype, with_ids), schema + ", ids binary" * with_ids)
