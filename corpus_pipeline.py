"""A training corpus from raw documents, stage by stage; each calls one operator of loam.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm import line_crf, ngram_join, packing, quality_fm, secrets
from loam.llm.common import materialize, table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be good; it learns from the raw table's labels.

    Null and empty texts are scored by their statistics, long ones whole; equal rows stay or go together; columns are
    those of docs; an empty table gives an empty one. Without labels every score is 0.5, and all documents stay.
    """
    return quality_fm.keep_good(docs, quality_fm.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are content by most of their words.

    Null and empty texts and those of under 50 words go; long ones are read whole; equal rows stay or go together;
    columns are those of docs; an empty table gives an empty one.
    """
    return line_crf.keep_content(docs, line_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Null texts and texts without words are no copies of anything and stay, as do rows without a doc_id; of repeated rows
    one stays; texts of one doc_id in different groups all stay; columns are those of docs.
    """
    return ngram_join.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars counted anew.

    Null texts and texts without secrets stay as they are, repeated rows are masked alike, long texts are scanned whole;
    columns are those of docs; an empty table gives an empty one.
    """
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: length bucket, batch and place.

    Null and empty texts have their end id alone; each of repeated rows has a place of its own; a text over the budget has
    a batch of its own; an empty table gives an empty one.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Trained models, hashes and a tokenizer are beyond SQL; tests/llm/ holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again by the next. The result is lazy and reads
    the last of these tables; loam.llm.common.remove_tables removes them all when it has been written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
