"""Session settings the library wants, and the scratch folder it writes cut points to."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# A 64 byte key pad is 128 hex digits; only derived subkeys ever reach a plan, and this hides those.
REDACT_HEX = r"(?i)(0x|X')?[0-9a-f]{64,}"


def build_session(app: str = "tablecloak", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.redaction.string.regex": REDACT_HEX,
        "spark.ui.enabled": "false",
        # call-site capture costs several driver round trips per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A session whose executors are threads of the driver gets its own
    without the setting; any other is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    own = tempfile.mkdtemp(prefix="tablecloak-")
    # this process made it and nothing else knows it
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut lineage: write to the shared folder, read back. Survives executor loss, keeps column pruning,
    and freezes anything that depends on partition layout."""
    path = f"{scratch_dir(df.sparkSession)}/tablecloak/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out over the shuffle partitions, before work that costs far more than a shuffle of them: a table of few
    bytes is read by a few tasks however many rows it has. A stream stays as it comes."""
    return df if df.isStreaming else df.repartition(shuffle_partitions(df.sparkSession))


def together(jobs: Sequence[Callable[[], object]]) -> list:
    """Run independent Spark jobs at the same time; results in order, the first failure is raised."""
    if len(jobs) < 2:
        return [j() for j in jobs]
    session = SparkSession.getActiveSession()
    with ThreadPoolExecutor(min(len(jobs), 8)) as pool:
        futures = [pool.submit(inheritable_thread_target(session)(j) if session is not None else j) for j in jobs]
        return [f.result() for f in futures]
