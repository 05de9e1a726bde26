"""Operator 5: passages that repeat across documents, by paragraph MinHash banding.

A paragraph is a line. Paragraphs of equal words are one key from the start. The distinct ones
are sketched by MinHash over 5-word shingles with BANDS bands of ROWS rows (at a Jaccard of 0.8
a pair shares a band with probability 1 - (1 - 0.8**4)**12 = 0.998). Bands that one paragraph
alone has are dropped in columnar blocks; in the others all paragraphs are compared that aren't
in one class already, as ``near_dedup.band_components`` says. Pairs hold if the exact Jaccard of their shingle sets is at
least THRESHOLD. Components of these pairs are the classes.

A paragraph repeats if its class occurs in an earlier document (by id, nulls last, then by the
text's hash). A run of repeating paragraphs, one after the other, is removed if it has at
least MIN_WORDS words: shorter repeats are no passages, and stay. Equal passages that begin or
end within a line are found by ``passages``, by their words alone.

Edge cases: lines without words are neither paragraphs nor gaps of a run, and stay; a null text
has no paragraphs and stays null; rows that repeat id and text are one document, so they don't
repeat each other; a text whose every line goes becomes the empty text; an empty table gives an
empty result. Further columns of the input stay, under any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm import blocks
from prefspark.llm.lines import cut_lines, document_hash, line_units, order_keys
from prefspark.llm.near_dedup import band_components, pairs_in_bands, shared_bands
from prefspark.llm.passages import cut_passages, passages
from prefspark.llm.shingles import mix, shingles, unit_starts, words

THRESHOLD = 0.8
BANDS, ROWS = 12, 4
MIN_WORDS = 50
# Sets of up to three shingles are similar to at least 0.8 only if they are equal.
LEAST_SHINGLES = 4


def _bands(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(units, BANDS) hashes of the MinHash rows of each unit's shingles."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for row in range(ROWS):
            odd = np.uint64((2 * (band * ROWS + row) + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF | 1)
            key = mix(key * np.uint64(0x94D049BB133111EB) + np.minimum.reduceat((h ^ (odd >> np.uint64(5))) * odd, starts))
        out[:, band] = key
    return out


def _sketch_blocks(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries (band, key, another band) in blocks; equal paragraphs of a slice give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0)):
                unit, starts = line_units(w)
                if not len(starts):
                    continue
                keys = order_keys(w.hashes, starts)[:, 0]
                h, shingled = shingles(w.hashes, unit)
                first = unit_starts(shingled)
                _, distinct = np.unique(keys, return_index=True)
                distinct = distinct[np.diff(np.concatenate([first, [len(h)]]))[distinct] >= LEAST_SHINGLES]
                if len(distinct):
                    bands = _bands(h, first)[distinct]
                    band, other = bands.ravel(), np.roll(bands, 1, axis=1).ravel()
                    yield blocks.packed((band % np.uint64(buckets)).astype(np.int64), [band, np.repeat(keys[distinct], BANDS), other], ["x", "y", "z"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct entries of the bands that more than one key has."""
    band, key, other = blocks.unpacked(batches, ["<u8"] * 3)
    order = np.lexsort((key, band))
    band, key, other = band[order], key[order], other[order]
    fresh = np.ones(len(band), bool)
    fresh[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1])
    band, key, other = band[fresh], key[fresh], other[fresh]
    more = np.zeros(len(band), bool)
    more[1:] = band[1:] == band[:-1]
    more[:-1] |= more[1:]
    yield pa.RecordBatch.from_arrays([pa.array(x[more].view(np.int64)) for x in (band, key, other)], names=["band", "key", "other"])


def _lines(wanted: Callable[[], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every paragraph: document, line, number among the paragraphs, words, key; shingles of those that may be in a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = wanted()
        for batch in batches:
            for w in words(batch.column(2)):
                unit, starts = line_units(w)
                if not len(starts):
                    continue
                counts = np.diff(np.concatenate([starts, [len(unit)]]))
                keys = order_keys(w.hashes, starts)
                h, shingled = shingles(w.hashes, unit)
                first = unit_starts(shingled)
                ends = np.concatenate([first[1:], [len(h)]])
                enough = (ends - first >= LEAST_SHINGLES) & hit[(keys[:, 0] & np.uint64(len(hit) - 1)).astype(np.int64)]
                low = (h >> np.uint64(32)).astype("<u4")
                row = w.row[starts]
                number = np.arange(len(row)) - np.searchsorted(row, row)
                take = pa.array(row + w.first_row)
                sets = [np.unique(low[s:e]).tobytes() if ok else None for s, e, ok in zip(first, ends, enough, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), pa.array(w.line[starts], pa.int32()), pa.array(number, pa.int32()),
                        pa.array(counts, pa.int32()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(keys[:, 0].view(np.int64)), pa.array(sets, pa.binary()),
                    ],
                    names=["doc_id", "doc", "line", "number", "n_words", "key", "half", "set"],
                )

    return run


def similar_sets(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[bool]:
    """Whether each pair of sets has a Jaccard of at least THRESHOLD."""
    holds = []
    for a, b in pairs:
        common = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= THRESHOLD * max(len(a), len(b)) else 0
        holds.append(common >= THRESHOLD * (len(a) + len(b) - common))
    return holds


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        keep = pa.array(similar_sets(pairs), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all paragraphs: doc_id, doc (hash of the text), line, number, n_words, key; key and root of those in a larger class)."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].alias("doc_id"), document_hash(docs[text_col]).alias("doc"), docs[text_col].alias("text")).where("text is not null")
    buckets = blocks.n_buckets(spark)
    shuffled = texts.select("text").mapInArrow(_sketch_blocks(buckets), "bucket int, x binary, y binary, z binary").repartition("bucket")
    shared = shared_bands(shuffled.mapInArrow(_shared, "band bigint, key bigint, other bigint"))
    pairs = blocks.settle(pairs_in_bands(shared), "paragraph-pairs")
    wanted = spark.sparkContext.broadcast(blocks.bitmap(pairs.select(F.explode(F.array("a", "b")).alias("half")), "half"))
    kind = texts.schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, doc bigint, line int, number int, n_words int, key binary, half bigint, `set` binary"
    lines = blocks.settle(texts.mapInArrow(_lines(lambda: wanted.value), schema), "paragraphs")
    sets = lines.where("`set` is not null").select("key", "half", "set").dropDuplicates(["key"])
    # Halves of keys stand for paragraphs until the classes are known.
    sequences = blocks.settle(sets.groupBy("half").agg(F.min("key").alias("full"), F.min("set").alias("sequence")).withColumnRenamed("half", "key"), "paragraph-sets")
    left = pairs.join(sequences.select(F.col("key").alias("a"), F.col("sequence").alias("x")), "a")
    both = left.join(sequences.select(F.col("key").alias("b"), F.col("sequence").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_similar, "a bigint, b bigint")
    roots = band_components(shared, links, sequences.select("key", "sequence"), similar_sets, THRESHOLD)
    full = sequences.select("key", "full")
    roots = roots.join(full.select(F.col("key").alias("node"), F.col("full").alias("own")), "node").join(full.select(F.col("key").alias("root"), F.col("full").alias("of")), "root")
    return lines.drop("set", "half"), roots.select(F.col("own").alias("key"), F.col("of").alias("root"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Paragraphs to remove: doc_id, doc, line, n_words, class (key) and kept_in (id of the first document that has it)."""
    lines, roots = paragraphs(docs, id_col, text_col)
    lines = lines.join(roots, "key", "left").withColumn("class", F.coalesce("root", "key")).drop("root", "key")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "doc")
    shared = lines.groupBy("class").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first != last").select("class", "first")
    later = lines.join(shared, "class").where(order != F.col("first"))
    later = later.select("doc_id", "doc", "line", "number", "n_words", "class", F.col("first.doc_id").alias("kept_in")).dropDuplicates(["doc_id", "doc", "line"])
    by_doc = Window.partitionBy("doc_id", "doc")
    later = later.withColumn("run", F.col("number") - F.row_number().over(by_doc.orderBy("number")))
    return later.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "doc", "run"))).where(F.col("run_words") >= min_words).drop("run", "run_words", "number")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_removed, removed_words, removed_lines (from 0),
    classes and kept_in (for each removed line: its class, and the document in which it stays);
    passages (first_word from 0, n_words, kept_in), which may lie in removed lines too."""
    gone = removals(docs, id_col, text_col, min_words)
    item = F.struct("line", F.hex("class").alias("class"), "kept_in")
    per_doc = gone.groupBy("doc_id", "doc").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("n_words").alias("removed_words"))
    spans = passages(docs, id_col, text_col, min_words).groupBy("doc_id", "doc").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words", "kept_in"))).alias("passages"))
    per_doc = per_doc.join(spans.withColumnsRenamed({"doc_id": "s_id", "doc": "s_doc"}), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("doc") == F.col("s_doc")), "full")
    per_doc = per_doc.withColumn("doc_id", F.coalesce("doc_id", "s_id")).withColumn("doc", F.coalesce("doc", "s_doc")).drop("s_id", "s_doc")
    rows = docs.select(docs[id_col].alias("doc_id"), document_hash(docs[text_col]).alias("doc"))
    r, g = rows.alias("r"), per_doc.alias("g")
    joined = r.join(g, F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.doc") == F.col("g.doc")), "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<struct<line:int,class:string,kept_in:bigint>>"))
    return joined.select(
        F.col("r.doc_id").alias("doc_id"), F.size(items).cast("long").alias("n_removed"), F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"),
        items["line"].alias("removed_lines"), items["class"].alias("classes"), items["kept_in"].alias("kept_in"),
        F.coalesce("passages", F.array().cast("array<struct<first_word:int,n_words:int,kept_in:bigint>>")).alias("passages"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all its columns, the removed paragraphs (whole lines only) cut from the text column."""
    return cut_lines(docs, removals(docs, id_col, text_col, min_words), id_col, text_col)


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all its columns, the removed paragraphs and the passages of earlier documents cut from the text column."""
    return cut_passages(docs, removals(docs, id_col, text_col, min_words), passages(docs, id_col, text_col, min_words), id_col, text_col)
