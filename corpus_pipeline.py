"""A corpus pipeline of five operators; every stage works on all that the stage before it kept.

Stages take (spark, docs, sf_dir).  All but the last return the columns of documents; the last returns packed pieces.
Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns have the results that each stage's
operator states; a document that is empty from the start passes through and is packed as its end token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import line_dedup, ngram_join, packing, pii, toxicity
from cairn.llm.common import load, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.reject_toxic(docs, load(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within two edits of an earlier line go, short ones if they are equal; documents of which no word is left go whole."""
    return line_dedup.dedup_lines(docs, short=True, emptied=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, the one of smallest id stays."""
    return ngram_join.keep_one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to placeholders."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: SQL cannot express the trained and the edit-distance stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read back."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
