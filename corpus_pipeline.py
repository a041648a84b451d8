"""Corpus pipeline over documents: language ID, near duplicates, repeated substrings, benchmark passages, mixing.

A stage takes (spark, docs, sf_dir) and returns a table that is written before the next one reads it. All but the last return the
columns of documents; the last adds n_tokens. In every stage other columns pass through whatever their names, an empty table gives an
empty one, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doclake.llm import budget, crf, jaccard, recompress, spaced
from doclake.llm.common import documents, forget_since, stash, stashed, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field accepts as text in a language. Null and empty texts and texts without words go; null ids and repeated rows are judged as they stand."""
    return crf.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of least id; of repeated rows of an id one. Null ids and texts without words stay."""
    return jaccard.keep_one(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less passages of 50 words or more that occur before, by id, then place. Null ids and texts stay; what is left without a word goes."""
    return recompress.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null ids and texts stay; repeated rows are judged each."""
    return spaced.without_hits(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens left, equal shares for the sources. Texts without tokens go; null ids and sources take part; of rows equal in id and text as many as are needed."""
    return budget.fit(docs, total=0.5, keep=docs.columns)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: No SQL for the classifier, recompression or the knapsack; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = documents(spark, sf_dir), stashed()
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        forget_since(mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
