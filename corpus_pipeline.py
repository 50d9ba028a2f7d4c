"""A corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns the columns of ``documents``; the last returns packed pieces.

Rows without doc_id are judged by themselves: language ID may reject them, the joins by doc_id leave them as they are. A doc_id names one document: of rows that repeat it with equal texts the
n-gram join keeps one. null and blank texts go with language ID. Other columns pass through, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notelake.llm.common import prepared, stage
from notelake.llm.langid import keep_identified
from notelake.llm.ngram_join import one_of_each
from notelake.llm.packing import pack
from notelake.llm.suffix import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    prepared(spark)
    return keep_identified(docs).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepared(spark)
    return one_of_each(docs).select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that stand in an earlier place."""
    prepared(spark)
    return without_repeats(docs).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 tokens."""
    prepared(spark)
    return pack(docs)


STAGES = [("language_id", language_id), ("ngram_jaccard_join", ngram_jaccard_join), ("suffix_dedup", suffix_dedup), ("best_fit_packing", best_fit_packing)]

#: Language ID and packing have no SQL form; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written as Parquet and read again."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
