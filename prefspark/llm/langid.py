"""Operator 9: language identification by multinomial naive Bayes over hashed character n-grams.

Counting runs over all training texts: each task counts its n-grams by language in a dense
table of fixed size, and the tables are added up by blocks. The model is a matrix of log
probabilities (buckets x languages) whose size depends on the number of languages only; it is
broadcast, and texts are scored in batches by summing the matrix rows of their n-grams.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any training
row all texts are ``und``; of equally probable languages the first by name wins; rows repeat as
given; null ids are kept (their remainder is null: they are neither held out nor learned from);
only the id, text and language columns are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.grams import SPACE, chunks, windows

SIZES = (1, 2, 3, 4)
BITS = 16
BLOCK = 4096
SMOOTHING = 0.5
MAX_LANGUAGES = 500  # bound of the model: a row of counts each


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # (len(SIZES) << BITS) + 1 rows; the last one, of zeros, is for windows that don't count
    log_prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        total = np.tile(self.log_prior, (len(texts), 1))
        letters = np.zeros(len(texts), np.int64)
        for codes, starts, rows, counted in chunks(texts, max(SIZES) - 1):
            np.add.at(letters, rows, np.add.reduceat((codes != SPACE).astype(np.int64), starts))
            for k in range(len(SIZES)):
                picked = self.log_prob[_indices(codes, starts, counted, k)]
                np.add.at(total, rows, np.add.reduceat(picked, starts, axis=0))
        best = total.argmax(axis=1)
        shifted = np.exp(total - total[np.arange(len(texts)), best][:, None])
        score = np.where(letters > 0, 1 / shifted.sum(axis=1), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)], score


def _indices(codes: np.ndarray, starts: np.ndarray, counted: int, k: int) -> np.ndarray:
    buckets, valid = windows(codes, starts, counted, SIZES[k], BITS)
    return np.where(valid, buckets.astype(np.int64) + (k << BITS), len(SIZES) << BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: number of texts (block -1) and n-gram counts in blocks."""
    counts: dict[str, np.ndarray] = {}
    texts_of: dict[str, int] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            texts_of[lang] = texts_of.get(lang, 0) + len(texts)
            table = counts.setdefault(lang, np.zeros((len(SIZES) << BITS) + 1, np.int64))
            for codes, starts, _, counted in chunks(texts, max(SIZES) - 1):
                for k in range(len(SIZES)):
                    table += np.bincount(_indices(codes, starts, counted, k), minlength=len(table))
    for lang, table in counts.items():
        blocks = [np.array([texts_of[lang]], np.int64), *table[:-1].reshape(-1, BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(blocks)), pa.array(range(-1, len(blocks) - 1), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())],
            names=["lang", "block", "counts"],
        )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the count blocks of each key; holds this partition's share of the model only."""
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for lang, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = np.frombuffer(raw, np.int64)
            key = (lang, block)
            total[key] = total[key] + counts if key in total else counts
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["lang", "block", "counts"],
        )


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Model of all rows of ``docs`` whose text and language are not null."""
    pairs = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("text is not null and lang is not null")
    schema = "lang string, block int, counts binary"
    summed = pairs.mapInArrow(_count, schema).repartition("lang", "block").mapInArrow(_add, schema)
    rows = summed.collect()  # languages x buckets: the model itself
    languages = sorted({r["lang"] for r in rows})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model is bounded to {MAX_LANGUAGES}")
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), len(SIZES) << BITS))
    texts = np.zeros(len(languages))
    for r in rows:
        got = np.frombuffer(r["counts"], np.int64)
        if r["block"] < 0:
            texts[place[r["lang"]]] = got[0]
        else:
            counts[place[r["lang"]], r["block"] * BLOCK :][:BLOCK] = got
    smooth = counts + SMOOTHING
    for k in range(len(SIZES)):  # each n-gram size is a distribution of its own
        part = smooth[:, k << BITS : (k + 1) << BITS]
        part /= part.sum(axis=1, keepdims=True)
    log_prob = np.vstack([np.log(smooth).T, np.zeros((1, len(languages)))]).astype(np.float32)
    return LanguageModel(languages, log_prob, np.log(texts / texts.sum()) if languages else texts)


def _predict(model_of: Callable[[], LanguageModel]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            langs, score = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32 of the id as text leaves 2 on division by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out; predict every row's language."""
    out = F.coalesce(held_out(docs[id_col]), F.lit(False))
    model = fit(docs.where(~held_out(docs[id_col])), text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # (buckets x languages) floats
    rows = docs.select(docs[id_col].alias("doc_id"), out.alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(_predict(lambda: held.value), f"doc_id {rows.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
