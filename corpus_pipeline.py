"""From raw documents to a mix: quality, repeated lines, near duplicates, benchmark leaks, source weights.

Each stage reads what the one before it wrote and returns the columns of ``documents``; the last returns the mix, one row per
document with the words taken of it.

Defined cases: null and empty texts have no words; they pass or fall by the classifier's score, stay through the other stages, and
are never taken by the mix. Rows equal in id and text are one document from near dedup on; ids that repeat with other texts, and null
ids, are documents of their own. Very long texts are worked on whole. Ties in a group of near copies go to the smaller id, then to the
smaller hash of the text. An empty table gives an empty one. Further columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.llm import decontaminate, lines, minhash, mixing, quality
from tablecloak.llm.frames import cut
from tablecloak.llm.labelled import fold
from tablecloak.llm.q_quality import FOLDS, HELD_OUT
from tablecloak.llm.registry import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is fitted on these documents, outside the held-out fold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("id"), FOLDS) != HELD_OUT)
    return quality.keep_good(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines and of single long lines go; a document that loses all of its lines goes with them."""
    return lines.dedup_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the smallest id."""
    return minhash.dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mix to target weights", mixed),
]

# The classifier is a trained network, so SQL cannot say which documents reach the later stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
