"""Seen sets as bitmaps (C4, E6): one row for each user and block of 32,768 items.

A row is ``user_id, block, bitmap`` for dense ids from 0; block ``b`` begins at item
``(b - 1) * 32768``.  ``bitmap`` has the block's words of 64 items that hold any, ascending: two
bytes for the word's number, eight for its bits (bit ``i`` is its item ``i``), both big-endian.
So a row takes ten bytes for each such word: never more than ten for an item, and 5 KB for a
full block.  Sets are built by a partial aggregate of words, so a user with a third of all
reactions is combined before the shuffle, and merged by OR: merging the same run twice, or
rows that repeat, changes nothing.  Sizes, the lowest unseen item and merges are JVM expressions;
only ``seen_pairs`` opens bitmaps to ids.

Null users and items are no part of a set; a user without items has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ITEMS = 32768
WORD_ITEMS = 64
WORDS = BLOCK_ITEMS // WORD_ITEMS
ENTRY = np.dtype([("word", ">u2"), ("bits", ">u8")])
OPENED = 65_536  # words that seen_pairs opens at a time


def _packed(words: DataFrame) -> DataFrame:
    """Bitmaps of (user_id, word, bits) rows, which may repeat; words are numbered through all blocks."""
    merged = words.groupBy("user_id", "word").agg(F.bit_or("bits").alias("bits"))
    entry = F.struct(F.col("word").bitwiseAND(WORDS - 1).alias("word"), "bits")
    blocks = merged.groupBy("user_id", (F.shiftright("word", 9) + 1).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # at most WORDS
    digits = F.transform("entries", lambda e: F.concat(F.lpad(F.hex(e["word"]), 4, "0"), F.lpad(F.hex(e["bits"]), 16, "0")))
    return blocks.select("user_id", "block", F.unhex(F.array_join(digits, "")).alias("bitmap"))


def _entries(bitmap: Column) -> Column:
    """A bitmap as an array of (word in its block, bits)."""
    part = lambda at, length, to: F.conv(F.hex(F.substring(bitmap, at, F.lit(length))), 16, to).cast("long")
    places = F.sequence(F.lit(0), (F.length(bitmap) / ENTRY.itemsize).cast("int") - 1)
    return F.transform(places, lambda i: F.struct(part(i * ENTRY.itemsize + 1, 2, 10).alias("word"), part(i * ENTRY.itemsize + 3, 8, -10).alias("bits")))


def seen_bitmaps(seen: DataFrame) -> DataFrame:
    """Bitmaps of (user_id, item_id) rows, which may repeat."""
    rows = seen.where("user_id is not null and item_id is not null").select("user_id", F.col("item_id").cast("long").alias("item"))
    return _packed(rows.select("user_id", F.shiftright("item", 6).alias("word"), F.expr("shiftleft(1L, cast(item & 63 as int))").alias("bits")))


def merge(*sets: DataFrame) -> DataFrame:
    """Union of bitmap tables."""
    rows = sets[0].select("user_id", "block", "bitmap")
    for other in sets[1:]:
        rows = rows.unionByName(other.select("user_id", "block", "bitmap"))
    opened = rows.select("user_id", "block", F.explode(_entries(F.col("bitmap"))).alias("e"))
    return _packed(opened.select("user_id", ((F.col("block") - 1) * WORDS + F.col("e.word")).alias("word"), "e.bits"))


def sizes(bitmaps: DataFrame) -> DataFrame:
    """n_seen of each user."""
    count = F.aggregate(_entries(F.col("bitmap")), F.lit(0).cast("long"), lambda n, e: n + F.bit_count(e["bits"]))
    return bitmaps.groupBy("user_id").agg(F.sum(count).alias("n_seen"))


def _lowest_zero(bitmap: Column) -> Column:
    """Position of the lowest item of the block that isn't in it; null if all are."""

    def ones(bits: Column) -> Column:  # at the low end; there is no sum for 63 of them
        return F.coalesce(F.bit_count(bits.bitwiseAND(F.bitwise_not(F.try_add(bits, F.lit(1).cast("long"))))), F.lit(WORD_ITEMS - 1))

    low = F.aggregate(_entries(bitmap), F.lit(0).cast("long"), lambda n, e: F.when(n == e["word"] * WORD_ITEMS, n + ones(e["bits"])).otherwise(n))
    return F.when(low < BLOCK_ITEMS, low)


def first_available(bitmaps: DataFrame, n_items_col: Column) -> DataFrame:
    """Lowest of the ids 0..n-1 that each user hasn't seen; null if there is none.

    It lies in the first block that isn't full: one with a row, the one after such a block,
    or the first.  So each row adds two places without a bitmap.
    """
    rows = bitmaps.select("user_id", "block", "bitmap")
    none = F.lit(None).cast("binary").alias("bitmap")
    after = rows.select("user_id", F.explode(F.array(F.lit(1).cast("long"), F.col("block") + 1)).alias("block"), none)
    places = rows.unionByName(after).groupBy("user_id", "block").agg(F.max("bitmap").alias("bitmap"))
    low = F.when(F.col("bitmap").isNull(), F.lit(0).cast("long")).otherwise(_lowest_zero(F.col("bitmap")))
    lowest = places.groupBy("user_id").agg(F.min((F.col("block") - 1) * BLOCK_ITEMS + low).alias("lowest"))
    return lowest.select("user_id", F.when(F.col("lowest") < n_items_col, F.col("lowest")).alias("first_available"))


def available_items(bitmaps: DataFrame, n_items_col: Column) -> DataFrame:
    """C4 per user: n_seen, n_available, first_available."""
    counted = sizes(bitmaps).select("user_id", "n_seen", (n_items_col - F.col("n_seen")).alias("n_available"))
    return counted.join(first_available(bitmaps, n_items_col), "user_id", "left")


def mark_consumed(bitmaps: DataFrame, recommended: DataFrame) -> DataFrame:
    """The sets with the recommended items; the same answers applied again change nothing."""
    return merge(bitmaps, seen_bitmaps(recommended))


def items_of(blocks: list[int], bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place in the list, item) of every item that these rows hold."""
    words = np.frombuffer(b"".join(bitmaps), ENTRY)
    row = np.repeat(np.arange(len(blocks)), [len(b) // ENTRY.itemsize for b in bitmaps])
    first = (np.asarray(blocks, np.int64)[row] - 1) * BLOCK_ITEMS + words["word"].astype(np.int64) * WORD_ITEMS
    at, bit = np.nonzero(np.unpackbits(words["bits"].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[at], first[at] + bit


def contains(blocks: list[int], bitmaps: list[bytes], item_ids: np.ndarray) -> np.ndarray:
    """Whether one user's bitmaps hold each item."""
    return np.isin(item_ids, items_of(blocks, bitmaps)[1])


def seen_pairs(bitmaps: DataFrame) -> DataFrame:
    """user_id, item_id of every item of the sets."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, rows = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            upto = np.cumsum([len(b) // ENTRY.itemsize for b in rows])
            cuts = np.unique([0, *np.searchsorted(upto, np.arange(OPENED, upto[-1] if len(upto) else 0, OPENED)).tolist(), len(rows)])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                row, items = items_of(blocks[a:b], rows[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(items, pa.int64())], names=["user_id", "item_id"])

    rows = bitmaps.select("user_id", "block", "bitmap")
    return rows.mapInArrow(opened, f"user_id {rows.schema['user_id'].dataType.simpleString()}, item_id bigint")
