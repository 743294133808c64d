"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``; the last returns one row of digests per document left.

Rows without an id pass the stages that compare documents untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm import bpe, decontaminate, lines, ngram, toxicity
from patternloom.llm._common import table, tidy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents that consist of nothing else."""
    return lines.clean_documents(docs, length="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the least id stays."""
    groups = ngram.near_duplicate_groups(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and round trip of every document left, as digests."""
    return bpe.encode_documents(docs, bpe.vocabulary_path(), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenise),
]

#: SQL cannot express the model, run naming and merge stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again, and goes once the next is written."""
    docs = table(spark, sf_dir, "documents")
    with tidy(spark) as tables:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            kept = tables.keep(stage(spark, docs, sf_dir))
            if k:
                tables.drop(docs)
            docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
