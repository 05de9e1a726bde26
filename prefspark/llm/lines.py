"""Lines of texts: their units in a slice of words, their keys, and cutting lines from texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.shingles import Words, mix, unit_starts


def line_units(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(unit of each word, first word of each unit): the lines that have words, numbered through a slice."""
    before = np.concatenate([[0], np.cumsum(w.n_lines)[:-1]])
    unit = before[w.row] + w.line
    return unit, unit_starts(unit)


def order_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of the words of each unit, in order."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
    out = np.empty((len(starts), 2), np.uint64)
    for c, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        spread = mix(hashes + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(salt))
        out[:, c] = mix(np.add.reduceat(spread, starts)) if len(starts) else 0
    return out


def document_hash(text: Column) -> Column:
    """Long that tells apart the texts under one id."""
    return F.xxhash64(text)


def cut_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the lines that ``gone`` (doc_id, doc: the text's hash, line) names."""
    per_doc = gone.groupBy("doc_id", "doc").agg(F.collect_set("line").alias("lines"))
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}  # no clash with the names here
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    text = F.col(names[text_col])
    joined = rows.join(per_doc, F.col(names[id_col]).eqNullSafe(per_doc["doc_id"]) & (document_hash(text) == per_doc["doc"]), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col("lines"), i)), "\n")
    return joined.withColumn(names[text_col], F.when(F.col("lines").isNull(), text).otherwise(kept)).select(*[F.col(n).alias(c) for c, n in names.items()])
