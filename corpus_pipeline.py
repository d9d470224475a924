"""A corpus pipeline of five stages; each result is written as Parquet and read again as the next one's documents.

Toxic documents go, then exact copies, then near copies (five words, similarity 0.8); personal data is replaced by its
kind, and what is left is packed into token windows. Every stage works on all rows that the one before it kept; an empty
table passes through all of them. Other columns stay, whatever their names, until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard, packing, pii, toxicity
from tidemark.llm.chunks import vocabulary_path
from tidemark.llm.common import settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. The classifier learns from the labelled rows of the whole table. A null
    text counts as empty; repeated rows and null ids are scored like others."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays. Rows are told apart by id and text; repeated rows all stay if
    one does; a null text equals an empty one; null ids go where the group has another."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest doc_id stays. Texts without words all stay; repeated and
    null ids are told apart by their place in the order of ids."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced; n_chars follows the text. A null text stays null."""
    out = pii.redacted(docs, pii.train(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens. A null text has the end id alone; repeated rows are packed as
    often as they occur."""
    return packing.packed(docs, vocabulary_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: SQL cannot express the classifier, the random field and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
