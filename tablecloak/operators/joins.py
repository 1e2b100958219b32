"""Equi-joins that keep one hot key from filling one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HOT_ROWS = 1_000_000      # a key with fewer rows than this is ordinary work for one task
BROADCAST_KEYS = 100_000  # bound of the broadcast: where more keys are hot, hot means more rows


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(keys, __splits): the keys, null included, with at least ``hot_rows`` rows, and into how many parts of that size each
    is cut. None when there are none.

    Counted with map-side combine over the key columns only. A table has at most rows / hot_rows such keys; the limit is
    doubled until there are ``BROADCAST_KEYS`` or fewer, so on a huge table hot is what exceeds its hundred-thousandth part.
    """
    counts = df.groupBy(*on).agg(F.count("*").alias("__n"))
    while True:
        hot = counts.where(F.col("__n") >= hot_rows).select(*on, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__splits"))
        rows = hot.limit(BROADCAST_KEYS + 1).collect()
        if len(rows) <= BROADCAST_KEYS:
            return df.sparkSession.createDataFrame(rows, hot.schema) if rows else None
        hot_rows *= 2


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``big`` to ``small``, which holds each key at most once; how is left, inner, left_semi or left_anti.

    Where keys are hot, ``big`` is written once, which freezes its layout, and a row of a hot key is dealt to one of the key's
    parts by its place in the written files: rows that are all alike are dealt out as evenly as any. The key's row of
    ``small`` is there once for each part. Without hot keys this is a plain join; ``big`` is read once more for the count of its
    keys. Columns of ``big`` come first, then the others of ``small``. Rows that hold only the key need no dealing out, see
    ``counted_join``.
    """
    on = list(on)
    hot = hot_keys(big, on, hot_rows)
    if hot is None:
        return big.join(small, on, how).select(*_columns(big, small, on, how))

    def marked(df: DataFrame) -> DataFrame:
        marks = F.broadcast(hot.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(on)], "__splits"))
        cond = F.lit(True)
        for i, k in enumerate(on):
            cond = cond & df[k].eqNullSafe(marks[f"__h{i}"])
        return df.join(marks, cond, "left").drop(*[f"__h{i}" for i in range(len(on))])

    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    placed = materialize(big, "dealt").select("*", place.alias("__place"))
    part = F.coalesce(F.pmod("__place", F.col("__splits")).cast("int"), F.lit(0))
    dealt = marked(placed).withColumn("__part", part).drop("__splits", "__place")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__splits"), F.lit(1)) - 1))
    there = marked(small).withColumn("__part", parts).drop("__splits")
    return dealt.join(there, [*on, "__part"], how).select(*_columns(big, small, on, how))


def counted_join(keys: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """(on..., __n, other columns of ``small``): each distinct key of ``keys`` once, with the number of its rows, beside its row of
    ``small``. Counted with map-side combine before the join, so a key is one row however many rows hold it."""
    counts = keys.groupBy(*on).agg(F.count("*").alias("__n"))
    return counts.join(small, list(on), how)


def _columns(big: DataFrame, small: DataFrame, on: list[str], how: str) -> list[str]:
    extra = [] if how in ("left_semi", "left_anti") else [c for c in small.columns if c not in on]
    return big.columns + extra
