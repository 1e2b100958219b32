from pyspark.sql import functions as F

from . import quality as Q
from .labelled import fold
from .registry import query, table

FOLDS, HELD_OUT = 5, 0


def fitted(spark, sf_dir, docs=None):
    """The production model: learnt from rows outside the held-out fold only."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return Q.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("id"), FOLDS) != HELD_OUT)


@query("op10_quality_random_indexing")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = Q.score(docs, fitted(spark, sf_dir, docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= Q.THRESHOLD).cast("int").alias("predicted"))
