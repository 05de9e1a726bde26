"""Passages of at least MIN_WORDS equal words that an earlier document has, wherever lines end.

1. Each window of MIN_WORDS words has a fingerprint, the least hash of its grams of half as many
   words. Equal windows have equal fingerprints, and neighbouring windows mostly share theirs, so
   a text has few. Those that only one text has are left out by a bitmap.
2. The other windows' hashes go by fingerprint, in columnar blocks, to the task that finds the
   first document of each. A window repeats if that is an earlier document (by id, nulls last,
   then by the text's hash).

Windows that overlap or touch make one passage. The result is exact but for equal 64-bit hashes.

Edge cases: a text with fewer words has no passage; null text has none and stays null; rows that
repeat id and text are one document; ids are longs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm import blocks
from prefspark.llm.lines import document_hash
from prefspark.llm.shingles import Words, windows, words

MIN_WORDS = 50
_WORD = re.compile(rb"[^ \t\n\r\f\v]+")


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive values."""
    size = 1
    while 2 * size <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :])


def _fingerprints(w: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, whether it lies in one text) of the window that begins at each word."""
    k = max(1, min_words // 2)
    whole = w.row[: len(w.row) - min_words + 1] == w.row[min_words - 1 :]
    return _least(windows(w.hashes, k), min_words - k + 1), whole


def _fingerprint_blocks(buckets: int, min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries (fingerprint, whether several texts of a slice have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0)):
                if len(w.hashes) < min_words:
                    continue
                h, whole = _fingerprints(w, min_words)
                h, row = h[whole], w.row[: len(whole)][whole]
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                found, n = np.unique(h[fresh], return_counts=True)
                if len(found):
                    yield blocks.packed((found % np.uint64(buckets)).astype(np.int64), [found, (n > 1).astype(np.uint8)], ["x", "y"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints that several texts have."""
    h, several = blocks.unpacked(batches, ["<u8", "u1"])
    order = np.argsort(h)
    h, more = h[order], several[order] > 0
    more[1:] |= h[1:] == h[:-1]
    yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[more]).view(np.int64))], names=["fingerprint"])


def _window_blocks(wanted: Callable[[], np.ndarray], buckets: int, min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of windows with one fingerprint (id, unnamed, document, first word, number) and the windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = wanted()
        for batch in batches:
            ids = batch.column(0)
            unnamed = ids.is_null().to_numpy(zero_copy_only=False)
            ids, docs = ids.fill_null(0).to_numpy(), batch.column(1).to_numpy()
            for w in words(batch.column(2)):
                if len(w.hashes) < min_words:
                    continue
                mark, whole = _fingerprints(w, min_words)
                at = np.flatnonzero(whole & hit[(mark & np.uint64(len(hit) - 1)).astype(np.int64)])
                if not len(at):
                    continue
                mark, row = mark[at], w.row[at]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (at[1:] != at[:-1] + 1) | (mark[1:] != mark[:-1]) | (row[1:] != row[:-1])
                starts = np.flatnonzero(fresh)
                source = row[starts] + w.first_row
                place = at[starts] - np.searchsorted(w.row, row[starts])
                bucket = (mark % np.uint64(buckets)).astype(np.int64)
                number = np.diff(np.concatenate([starts, [len(at)]]))
                runs = blocks.packed(bucket[starts], [ids[source].astype("<i8"), unnamed[source].astype(np.uint8), docs[source].astype("<i8"), place.astype("<u4"), number.astype("<u4")], list("abcde"))
                hashes = blocks.packed(bucket, [windows(w.hashes, min_words)[at]], ["f"])  # the same buckets, in the same order
                yield pa.RecordBatch.from_arrays([*runs.columns, hashes.column(1)], names=["bucket", *"abcdef"])

    return run


def _repeats(min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stretches of windows that one earlier document has first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unnamed, docs, place, number, hashes = blocks.unpacked(batches, ["<i8", "u1", "<i8", "<u4", "<u4", "<u8"])
        if not len(hashes):
            return
        order = np.lexsort((docs, ids, unnamed))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (docs[order][1:] != docs[order][:-1]) | (ids[order][1:] != ids[order][:-1]) | (unnamed[order][1:] != unnamed[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh) - 1
        of_rank = order[fresh]  # a run of each document
        number = number.astype(np.int64)
        owner = np.repeat(np.arange(len(number)), number)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        order = np.lexsort((rank[owner], hashes))
        begins = np.ones(len(order), bool)
        begins[1:] = hashes[order][1:] != hashes[order][:-1]
        first = np.empty(len(order), np.int64)
        first[order] = rank[owner[order][begins]][np.cumsum(begins) - 1]
        at = np.flatnonzero(first != rank[owner])
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (owner[at][1:] != owner[at][:-1]) | (first[at][1:] != first[at][:-1])
        starts = np.flatnonzero(fresh)
        begin = at[starts]
        n = np.diff(np.concatenate([starts, [len(at)]])) + min_words - 1
        mine, kept = owner[begin], of_rank[first[begin]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[mine], mask=unnamed[mine] > 0), pa.array(docs[mine]), pa.array((place[mine] + inside[begin]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(ids[kept], mask=unnamed[kept] > 0)],
            names=["doc_id", "doc", "at", "n", "kept_in"],
        )

    return run


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages to remove: doc_id, doc (hash of the text), first_word (from 0), n_words, kept_in (id of the first document that has its begin)."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), document_hash(docs[text_col]).alias("doc"), docs[text_col].alias("text")).where("text is not null")
    buckets = blocks.n_buckets(spark)
    marks = texts.select("text").mapInArrow(_fingerprint_blocks(buckets, min_words), "bucket int, x binary, y binary").repartition("bucket")
    wanted = spark.sparkContext.broadcast(blocks.bitmap(marks.mapInArrow(_met, "fingerprint bigint"), "fingerprint"))  # 2**BITMAP_BITS bytes
    entries = texts.mapInArrow(_window_blocks(lambda: wanted.value, buckets, min_words), "bucket int, a binary, b binary, c binary, d binary, e binary, f binary")
    found = entries.repartition("bucket").mapInArrow(_repeats(min_words), "doc_id bigint, doc bigint, at int, n int, kept_in bigint").distinct()
    by_doc = Window.partitionBy("doc_id", "doc")
    before = F.max(F.col("at") + F.col("n")).over(by_doc.orderBy("at", "n", "kept_in").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("fresh", F.when(F.col("at") <= before, 0).otherwise(1))
    found = found.withColumn("passage", F.sum("fresh").over(by_doc.orderBy("at", "n", "kept_in").rowsBetween(Window.unboundedPreceding, 0)))
    merged = found.groupBy("doc_id", "doc", "passage").agg(F.min(F.struct("at", "kept_in")).alias("first"), F.max(F.col("at") + F.col("n")).alias("end"))
    return blocks.settle(merged.select("doc_id", "doc", F.col("first.at").alias("first_word"), (F.col("end") - F.col("first.at")).alias("n_words"), F.col("first.kept_in").alias("kept_in")), "passages")


def cut(text: str, lines: set[int], spans: list[tuple[int, int]]) -> str:
    """``text`` without these lines and spans (first word, number of words); a line that loses all its words goes."""
    gone = {k for first, n in spans for k in range(first, first + n)}
    kept, at = [], 0
    for number, line in enumerate(text.encode().split(b"\n")):
        found = list(_WORD.finditer(line))
        out = [k for k in range(len(found)) if at + k in gone]
        at += len(found)
        if number in lines or out and len(out) == len(found):
            continue
        if out:
            ends = [m.start() for m in found[1:]] + [len(line)]
            parts, begin = [], 0
            for k in out:
                parts.append(line[begin : found[k].start()])
                begin = ends[k]
            line = b"".join([*parts, line[begin:]])
            line = line.rstrip(b" \t\r\f\v") if out[-1] == len(found) - 1 else line
        kept.append(line)
    return b"\n".join(kept).decode()


def cut_passages(docs: DataFrame, gone_lines: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the lines of ``gone_lines`` (doc_id, doc, line) and the ``passages`` of ``gone``."""
    cuts = gone_lines.select(F.col("doc_id").cast("bigint").alias("doc_id"), "doc", "line", F.lit(None).cast("int").alias("first_word"), F.lit(None).cast("int").alias("n_words"))
    cuts = cuts.unionByName(gone.select("doc_id", "doc", F.lit(None).cast("int").alias("line"), "first_word", "n_words"))
    ordered = lambda c: F.sort_array(F.collect_list(F.when(F.col("first_word").isNotNull(), F.struct("first_word", "n_words"))))[c]
    per_doc = cuts.groupBy("doc_id", "doc").agg(F.collect_set("line").alias("lines"), ordered("first_word").alias("firsts"), ordered("n_words").alias("counts"))

    @F.pandas_udf("string")
    def without(text: pd.Series, lines: pd.Series, firsts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([t if n is None else cut(t, set(n), list(zip(f, c, strict=True))) for t, n, f, c in zip(text, lines, firsts, counts, strict=True)], dtype=object)

    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}  # no clash with the names here
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    text = F.col(names[text_col])
    joined = rows.join(per_doc, F.col(names[id_col]).eqNullSafe(per_doc["doc_id"]) & (document_hash(text) == per_doc["doc"]), "left")
    return joined.withColumn(names[text_col], without(text, "lines", "firsts", "counts")).select(*[F.col(n).alias(c) for c, n in names.items()])
