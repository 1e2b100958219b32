from pyspark.sql import functions as F

from . import toxicity as X
from .labelled import fold
from .registry import query, table

FOLDS, HELD_OUT = 4, 2


@query("op9_toxicity_bigru")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = X.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("id"), FOLDS) != HELD_OUT)
    return X.score(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                                       "score", (F.col("score") >= X.THRESHOLD).cast("int").alias("predicted"), "top_window")
