"""A training corpus from documents: quality, near duplicates, repeats, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
``documents``. ``run`` writes each stage's rows to the cluster's shared folder and reads them as the
next stage's documents.

In every stage null ids and repeated rows are rows like others but for what is said below, columns of any name come
through, whole texts count however long, and empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, line_quality, packing, suffix_dedup
from tidemark.llm.base import fold, stored, table

#: Documents whose quality score is below this go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts; it learns from the labels of four folds of five.

    Null and empty texts have no lines and the score of quality 0, so they go once the model has learnt that those
    are rejected. Repeated rows are judged each.
    """
    model = line_quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return line_quality.accept(docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the least id.

    A null id is the least. Repeated rows are copies: one stays. Of texts of one id with equal shingles the least
    text stays. Texts without words are no copies of anything and stay.
    """
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of length 100 that stand earlier; what is left empty goes.

    Earlier is the smaller id (null least), in one id the smaller hash of the text. Null and empty texts stay.
    """
    return suffix_dedup.remove(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages (at most 6 % edits). Null and short texts stay."""
    return decontamination.drop(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece. Null and empty texts are one piece, their end; repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("leaks", leaks),
    ("packed", packed),
]

#: SQL can't train or tokenise; tests/llm/test_pipeline.py holds each stage beside a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
