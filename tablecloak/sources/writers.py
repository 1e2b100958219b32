"""Writers, and the staged publish that never leaves half a target."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CodecUnavailable, InvalidRule, LossyWrite
from .readers import Field

# File suffix -> Spark codec. xz and zst have no codec in a plain Spark build.
CODECS = {"gz": "gzip", "bz2": "bzip2"}
REFUSED_CODECS = ("xz", "zst")


def codec_of(suffix: str | None) -> str | None:
    if suffix in REFUSED_CODECS:
        raise CodecUnavailable(f"csv as .{suffix} is not available in this Spark build")
    if suffix is not None and suffix not in CODECS:
        raise InvalidRule(f"unknown compression suffix {suffix!r}")
    return CODECS.get(suffix)


def write_csv(df: DataFrame, path: str, compression: str | None = None, delimiter: str = ",", mode: str = "errorifexists") -> None:
    """Header always; an integer with nulls stays an integer because Spark types allow null."""
    w = df.write.mode(mode).option("header", True).option("sep", delimiter)
    codec = codec_of(compression)
    (w.option("compression", codec) if codec else w).csv(path)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 0, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_fixed_width(df: DataFrame, path: str, layout: Sequence[Field], mode: str = "errorifexists") -> None:
    """Lossless or nothing: over-wide values and numbers that are not whole are counted first and refused."""
    ends, width = 0, 0
    cells = []
    for f in sorted(layout, key=lambda f: f.start):
        if f.start < ends:
            raise InvalidRule(f"field {f.name!r} overlaps the one before")
        c = F.col(f.name)
        if f.type == "int" and isinstance(df.schema[f.name].dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c == F.floor(c), F.floor(c).cast("bigint"))
        text = c.cast("string")
        cells.append((f, text, f.start - ends))
        ends = f.start + f.width
    bad = [F.count_if((F.length(t) > f.width) | (F.col(f.name).isNotNull() & t.isNull())).alias(f.name) for f, t, _ in cells]
    worst = df.agg(*bad).first()
    wrong = [f.name for f, _, _ in cells if worst[f.name]]
    if wrong:
        raise LossyWrite(f"values do not fit their fields: {', '.join(wrong)}")
    parts = []
    for f, t, gap in cells:
        if gap:
            parts.append(F.lit(" " * gap))
        parts.append(F.rpad(F.coalesce(t, F.lit("")), f.width, " "))
    df.select(F.concat(*parts).alias("value")).write.mode(mode).text(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def publish_outputs(spark: SparkSession, tables: Mapping[str, DataFrame], targets: Mapping[str, str],
                    delivery: str = "strict", format: str = "parquet") -> dict[str, str]:
    """Write every table beside its target, then rename. ``strict``: all tables are staged before any target
    changes. ``best_effort``: a failed table is reported and its old target stays. On an object store the rename
    is a copy, so use a committed table format there."""
    if delivery not in ("strict", "best_effort"):
        raise InvalidRule(f"unknown delivery {delivery!r}")
    run = uuid.uuid4().hex
    status, staged = {}, {}
    for name, df in tables.items():
        stage = f"{targets[name].rstrip('/')}.staging-{run}"
        try:
            write_csv(df, stage) if format == "csv" else write_parquet(df, stage)
            staged[name] = stage
        except Exception:
            fs, path = _fs(spark, stage)
            fs.delete(path(stage), True)
            if delivery == "strict":
                for s in staged.values():
                    fs, path = _fs(spark, s)
                    fs.delete(path(s), True)
                raise
            status[name] = "failed"
    # earlier outputs stay beside the new ones until every rename went through
    done: list[tuple[str, str, bool]] = []

    def undo(target: str, old: str, had: bool, new: bool) -> None:
        fs, path = _fs(spark, target)
        if new:
            fs.delete(path(target), True)
        if had:
            fs.rename(path(old), path(target))

    for name, stage in staged.items():
        target = targets[name].rstrip("/")
        fs, path = _fs(spark, target)
        old = f"{target}.old-{run}"
        had = fs.exists(path(target))
        try:
            if had and not fs.rename(path(target), path(old)):
                had = False
                raise OSError(f"could not set the earlier output of table {name!r} aside")
            if not fs.rename(path(stage), path(target)):
                raise OSError(f"could not publish table {name!r}")
        except Exception:
            undo(target, old, had, False)
            if delivery == "best_effort":
                fs.delete(path(stage), True)
                status[name] = "failed"
                continue
            for t, o, h in reversed(done):
                undo(t, o, h, True)
            for other in staged.values():
                fs, path = _fs(spark, other)
                fs.delete(path(other), True)
            raise
        done.append((target, old, had))
        status[name] = "published"
    for _, old, had in done:
        if had:
            fs, path = _fs(spark, old)
            fs.delete(path(old), True)
    return status
