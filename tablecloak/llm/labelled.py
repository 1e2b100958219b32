"""A bounded, documented sample of labelled documents to learn from, and crc32 folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, text, label) of about ``bound`` labelled documents at most, the same ones in each run.

    Ids are drawn by a hash threshold, so nothing is sorted and no task gathers them; ``usable`` is a condition on the id
    alone. Ids with contradicting labels take the more frequent one (ties: 0), ids with several texts the first of them in
    order; null labels and ids are left out.
    """
    one = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    one = one.where(usable).groupBy("id").agg((F.avg("y") > 0.5).cast("int").alias("y"))
    total = one.count()
    space = 1 << 40
    kept = one.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(space)) < int(space * min(1.0, bound / max(total, 1))))
    # about ``bound`` ids and labels: a size that is fixed by the parameter
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    return text.join(F.broadcast(kept), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
