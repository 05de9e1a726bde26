"""Registered queries of this subpackage, one for each operator, over the whole given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prefspark.llm import ann, bpe, html_extract, langid, line_dedup, near_dedup, order_minhash, packing, paragraph_dedup, simhash_dedup, token_alignment, toxicity, whitening
from prefspark.sources.tables import table


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number of ids, hashes of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and decision of every document; the model is fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 ids, in the order of a Hilbert curve."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeating passages of every document: the lines to remove, and the document in which each stays."""
    return paragraph_dedup.report(table(spark, sf_dir, "documents"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found vectors of every fiftieth vector, by cosine."""
    return ann.search(table(spark, sf_dir, "embeddings"), every=50)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of similar lines of other classes and decision of every line of every document."""
    return line_dedup.joined(table(spark, sf_dir, "documents")).select("doc_id", "line", "class_id", "n_links", "removed")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that aren't held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document, and which one of each class stays."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the least id of the documents that chains of near fingerprints connect it to."""
    return simhash_dedup.classes(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of every document, with the links' corpus-wide counts."""
    return token_alignment.alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four principal components, scaled to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_OPERATORS = (
    op1_toxicity, op2_byte_bpe, op3_order_minhash, op4_packing, op5_paragraph_dedup, op6_nearest_vectors, op7_line_dedup,
    op8_main_text, op9_language_id, op10_near_dedup, op11_simhash_dedup, op12_token_alignment, op13_embedding_whitening,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES: dict[str, str] = {}
