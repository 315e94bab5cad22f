"""The corpus pipeline: each stage's rows are written as Parquet and reread as the next one's documents.

Stages take (spark, docs, sf_dir), work on all rows that the one before kept, and return the columns of
``docs``; the last one returns the index of the token files it has written.

Defined cases: a row whose text is null, empty or without a letter has no language and goes in the first stage; a
row without doc_id can't be judged as a duplicate and goes in the second; rows that share a doc_id are one document with
the least text, stay or go together until the last stage, and give one row there; ties go to the least doc_id; other
columns pass through all stages but the last, whatever their names; an empty table gives no rows; texts of any length
are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import common
from quillgraph.llm import op2_target_mixing as op2
from quillgraph.llm import op6_ngram_jaccard as op6
from quillgraph.llm import op7_language_id as op7
from quillgraph.llm import op8_decontamination as op8
from quillgraph.llm import op10_token_output as op10


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return op7.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return op6.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op8.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix to target weights takes stay."""
    return op2.take(docs, common.table(spark, sf_dir, "labels"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in order of doc_id; returns what reading them back gives for each document."""
    return op10.tokens(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token output", token_output),
]

#: SQL can't express these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
