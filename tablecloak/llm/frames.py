"""Small helpers the operators of this folder share on the Spark side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# Bytes of one Arrow batch; a single longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches to Python are cut by bytes, so that a task's memory does not depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast an object of bounded size, its class included; the result gives it inside a task. A worker process unpacks it
    once and keeps it for its later tasks, on the broadcast itself, so tasks must not change it. ``release`` takes it off the
    executors when what was made with it is written; a task that needs it again fetches it again."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        if "unpacked" not in packed.__dict__:
            packed.__dict__["unpacked"] = cloudpickle.loads(packed.value)
        return packed.__dict__["unpacked"]

    get.release = packed.unpersist
    return get


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: survives lost executors and is computed once."""
    return materialize(df, label)


def free_name(columns: Sequence[str], wanted: str) -> str:
    """A column name that no column of the frame has, in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def digest(words: Column) -> Column:
    """Lowercase hex SHA-256 of a text."""
    return F.sha2(words.cast("binary"), 256)
