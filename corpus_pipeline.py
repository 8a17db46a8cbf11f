"""From raw documents to packed training sequences: five stages, each one operator of ``quillon.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import mixing, neardup, packing, pii, toxicity
from quillon.llm.common import read_table, save


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the classifier on all labels and drops the documents that it predicts toxic.

    Null and empty texts get the score of no words and stay unless that is toxic; each row counts by itself, whatever
    its doc_id; without labels of both kinds every text has the same score; an empty table stays empty.
    """
    model = toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8) stays: the one of least doc_id.

    Of rows that repeat that doc_id one stays, as does one of a group without any doc_id; rows of null, empty and blank
    texts, which are linked with nothing, all stay; an empty table stays empty.
    """
    return neardup.distinct_documents(docs, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets, and n_chars follows.

    Null texts stay null, empty ones empty; doc_ids play no part; every row stays.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated or left out, so that sources have their weights' shares of words.

    Each row has its own number of copies, whatever its doc_id; null sources are one source; rows without words count as
    size 0 and are taken at their source's rate; a source of no words is left out; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in sequences of at most 2048.

    Null and empty texts are a single end id; repeated rows and null doc_ids are packed like others; an empty table
    gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, sketches and tokenizer have no SQL form; tests hold each stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"stage-{name}")
    return docs
