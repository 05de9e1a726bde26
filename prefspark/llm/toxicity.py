"""Operator 1: toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the distinct hashed 5-character windows of the folded text and, at the start of
words, those of 6 to 10 characters (a leading space marks the start of a word; in a text of over
``grams.CHUNK_CHARS`` characters they are distinct within each such slice). Only features that tell toxic from
other rows count: each has its z-score as scale, over the fourth root of the text's number of
features, so that a few words tell in a long text, too. All grades
share one weight vector w: P(grade > k) = sigmoid(w.x - t_k) with rising thresholds t_k. The
output is the expected severity, the sum of these probabilities.

The model is fitted on a bounded sample of labelled rows (``max_toxic`` and ``max_clean``, by
hash of the id); scoring covers every whole text, in batches, with the dense weight table as a
broadcast of fixed size. Labels say toxic or not; the grade of a toxic row is 1, or 2 if its
share of toxic-marked features is over the median of the toxic rows.

Edge cases: a null or empty text has no feature and the severity of the intercept; label rows
that repeat an id count once, toxic if any says so; null labels and ids don't train; without
both kinds of labelled rows nothing is rejected (severity 0). Rows repeat as given, and only the
id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.grams import SPACE, chunks, windows
from prefspark.session import materialize

ANYWHERE = 5
AT_WORDS = (5, 6, 7, 8, 9, 10)  # with the leading space
BITS = 20
MAX_TOXIC, MAX_CLEAN = 3000, 5000
FEATURES = 20_000  # at most, the most telling ones by the z-score of their document frequencies
LEAST_Z, MOST_Z = 2.5, 8.0  # a feature's least z-score, and the most that counts as its scale
GRADES = 3
REJECT_AT = 0.5  # probability of any toxic grade


@dataclass
class OrdinalModel:
    weight: np.ndarray  # of every bucket
    thresholds: np.ndarray  # rising

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) of each text and threshold."""
        margin, n = np.zeros(len(texts)), np.zeros(len(texts))
        for rows, buckets in _found(texts):
            margin += np.bincount(rows, self.weight[buckets], minlength=len(texts))
            n += np.bincount(rows, minlength=len(texts))
        margin /= np.maximum(n, 1) ** 0.25
        return _sigmoid(margin[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _found(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the distinct windows of some texts at a time."""
    for codes, starts, rows, counted in chunks(texts, max(AT_WORDS) - 1):
        text = np.repeat(rows, np.diff(np.concatenate([starts, [len(codes)]]))).astype(np.uint64) << np.uint64(BITS)
        keys = []
        begins = codes == SPACE
        for size in AT_WORDS:
            buckets, valid = windows(codes, starts, counted, size, BITS)
            if size != ANYWHERE:
                valid &= begins
            keys.append(text[valid] | buckets[valid])
        keys = np.unique(np.concatenate(keys))
        yield (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: in how many toxic and how many other texts of this task it occurs."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        toxic = np.array(batch.column(0).to_pylist(), bool)
        for rows, buckets in _found(batch.column(1).to_pylist()):
            for side, own in enumerate((toxic[rows], ~toxic[rows])):
                counts[side] += np.bincount(buckets[own], minlength=1 << BITS).astype(np.int32)
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0, some].astype(np.int64)), pa.array(counts[1, some].astype(np.int64))], names=["bucket", "f1", "f0"])


def _entries(place_of: Callable[[], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chosen features of every text, and its number of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = place_of()
        for batch in batches:
            features, sizes = [], []
            for text in batch.column(1).to_pylist():
                found = np.concatenate([np.zeros(0, np.int64), *(buckets for _, buckets in _found([text]))])
                features.append(place[found][place[found] >= 0])
                sizes.append(max(1, len(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], names=["toxic", "features", "size"])

    return run


def severity_grades(toxic: np.ndarray, marked_share: np.ndarray) -> np.ndarray:
    """0 for clean rows; 1 or, over the median share of marked features, 2 for toxic ones."""
    if not toxic.any():
        return np.zeros(len(toxic), np.int64)
    return np.where(toxic, 1 + (marked_share > np.median(marked_share[toxic])), 0)


def fit_ordinal(rows: np.ndarray, features: np.ndarray, values: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int = GRADES, l2: float = 1e-3, steps: int = 150, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model of sparse (row, feature, value) entries.

    Adam on the mean negative log-likelihood with an L2 penalty. Thresholds are the first one
    plus positive gaps, exp(.), so they always rise.
    """
    n, k = len(grade), n_grades - 1
    gap_start = np.concatenate([[1.0], np.zeros(k - 1)])
    theta = np.concatenate([np.zeros(n_features), gap_start])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    over = (grade[:, None] > np.arange(k)[None, :]).astype(float)  # what P(grade > k) should be
    at = np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], axis=1)  # indicator of grade >= k
    own = at[:, :-1] - at[:, 1:]  # one-hot grade
    for step in range(1, steps + 1):
        w, t = theta[:n_features], theta[n_features:]
        thresholds = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
        margin = np.bincount(rows, values * w[features], minlength=n)
        p = _sigmoid(margin[:, None] - thresholds[None, :])
        upper = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        prob = np.maximum((own * (upper[:, :-1] - upper[:, 1:])).sum(axis=1), 1e-12)
        slope = p * (1 - p)
        # d(prob of own grade)/d(p_k): +1 where k closes it from below, -1 from above
        sign = own[:, 1:] - own[:, :-1]
        d_margin = -(sign * slope).sum(axis=1) / prob / n
        d_threshold = (sign * slope / prob[:, None] / n).sum(axis=0)
        grad = np.empty_like(theta)
        grad[:n_features] = np.bincount(features, values * d_margin[rows], minlength=n_features) + l2 * w / n_features**0.5
        grad[n_features] = d_threshold.sum()
        for j in range(1, k):
            grad[n_features + j] = d_threshold[j:].sum() * np.exp(t[j])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) / (1 + step / 50)
        theta[n_features + 1 :] = np.clip(theta[n_features + 1 :], -4, 3)
    t = theta[n_features:]
    return theta[:n_features], t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> OrdinalModel:
    """Fit on at most ``max_toxic`` toxic and ``max_clean`` other labelled rows, by hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    by_hash = known.orderBy(F.xxhash64("id"), "id")
    sample = by_hash.where("toxic").limit(max_toxic).unionByName(by_hash.where("not toxic").limit(max_clean))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    labelled = texts.join(F.broadcast(sample), "id")  # at most max_toxic + max_clean pairs
    # Repeated ids in ``docs`` could exceed the bound: it holds for rows, too.
    labelled = labelled.orderBy(F.xxhash64("id"), "id").limit(max_toxic + max_clean).select("toxic", "text")
    labelled = materialize(labelled.repartition(16), "toxicity-sample")
    n1, n0 = labelled.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not n1 or not n0:
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, 50.0))
    # The most telling features, by the z-score of their shares of toxic and of clean rows.
    present = labelled.mapInArrow(_presence, "bucket int, f1 bigint, f0 bigint").groupBy("bucket").agg(F.sum("f1").alias("f1"), F.sum("f0").alias("f0"))
    share = (F.col("f1") + F.col("f0") + 1) / (n1 + n0 + 2)
    z = (F.col("f1") / n1 - F.col("f0") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    told = present.where("f1 + f0 > 1").select("bucket", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "bucket").limit(FEATURES).toPandas()
    place = np.full(1 << BITS, -1, np.int32)
    place[told["bucket"]] = np.arange(len(told))
    held = labelled.sparkSession.sparkContext.broadcast(place)
    got = labelled.mapInArrow(_entries(lambda: held.value), "toxic boolean, features array<int>, size bigint").toPandas()
    toxic = got["toxic"].to_numpy(bool)
    rows = np.repeat(np.arange(len(got)), got["features"].map(len).to_numpy())
    features, scale = np.concatenate(got["features"]).astype(np.int64), np.minimum(told["z"].to_numpy(), MOST_Z)
    values = scale[features] / (got["size"].to_numpy() ** 0.25)[rows]
    marked = np.bincount(rows, values * (told["z"].to_numpy()[features] > 4), minlength=len(got))
    w, thresholds = fit_ordinal(rows, features, values, severity_grades(toxic, marked), len(told))
    weight = np.zeros(1 << BITS, np.float32)
    weight[told["bucket"]] = w * scale
    return OrdinalModel(weight, thresholds)


def _score(model_of: Callable[[], OrdinalModel]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            above = model.above(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array((above >= REJECT_AT).sum(axis=1), pa.int32()), pa.array(above[:, 0] >= REJECT_AT)],
                names=["doc_id", "expected_severity", "toxic_probability", "grade", "toxic"],
            )

    return run


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Expected severity, probability of any toxic grade, grade and decision of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, expected_severity double, toxic_probability double, grade int, toxic boolean"
    return rows.mapInArrow(_score(lambda: held.value), schema)


def keep_clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model doesn't reject."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = held.value.above(batch.column(at).to_pylist())
            yield batch.filter(pa.array(above[:, 0] < REJECT_AT))

    return docs.mapInArrow(run, docs.schema)
