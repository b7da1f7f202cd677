"""A corpus through five operators: quality, toxicity, near-duplicates, mixing by source, packing.

Every stage takes what the one before it kept, written as Parquet and read again. The first four return the columns
of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import mixing, ngram_join, packing, quality, toxicity
from panelkit.llm.common import drop_since, free_name, mark, materialize, read
from panelkit.llm.queries import WORD_BPE


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts to be label 1; it learns from the labelled ones of these documents.

    A null text is judged as an empty one; null and repeated ids are judged row by row; further columns stay. Without
    labels of both kinds, the share of label 1 decides (without any, all rows stay). An empty table gives no rows.
    """
    model, score = quality.fit_quality(docs, read(spark, sf_dir, "labels")), free_name(docs, "quality_score")
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose expected severity is below the threshold.

    A null text is judged as an empty one; null and repeated ids are judged row by row; further columns stay. Without
    labels of both kinds all rows stay. An empty table gives no rows.
    """
    model, score = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels")), free_name(docs, "severity")
    return toxicity.score_toxicity(docs, model, score_col=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles link at 0.8 or more: that with the smallest id.

    Null and empty texts link with nothing and stay. Of rows that repeat in id and text one stays, and of rows with a null id
    that are linked with others none, or one where all ids are null. Further columns stay. An empty table gives no rows.
    """
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the schedule passes over them: not at all, once or twice.

    A null source is a source. Null, empty and blank texts have no words to take and go. Rows that share an id, or have
    none, are taken each on its own. Further columns stay. An empty table gives no rows.
    """
    return mixing.take_whole(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens: a piece or more for every row, one for a null or empty text."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing_sources", mix_by_source),
    ("best_fit_packing", pack),
]

#: SQL expresses neither classifier; tests hold every stage against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`. A stage's scratch tables go when its result has been written."""
    docs, began = read(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_since(spark, began, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
