"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the last return the columns of documents.

Nulls, repeats and the like. A null, an empty and a short text fail the quality rules, so later stages see none of them
here; on their own they keep them (a text without words is its own group, has no spans, and adds no words to the mix).
Rows that repeat a doc_id, or have none, are rows of their own: of those with much the same text one stays. Columns beyond
those of documents stay until the last stage, whatever their names. An empty table gives an empty result of the same
schema. A long text is used whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import fertility, jaccard, mixing, pieces, pii
from larkspur.llm._store import drop, read_table, save


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go."""
    return fertility.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that the n-gram Jaccard join links, one with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, score, n_pieces, pieces, other_scores, other_pieces, round_trip): the best segmentation of each document,
    the others of the N_BEST, and whether all decode to the text; copies stay rows of their own."""
    return pieces.encode_decode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", source_mix),
    ("SentencePiece encoding", sentencepiece_ids),
]

#: The stages' models (fertility bands, the piece lattice) cannot be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over documents. The table of a stage goes when the next one's is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
        if before is not None:
            drop(before)
        before = docs
    return docs
