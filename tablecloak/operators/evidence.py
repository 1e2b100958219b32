"""Fingerprints and comparisons of runs: counts and hashes, never cell values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import row_message
from .fidelity import marginal
from .fit import stack, union_all
from .masks import Rule


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(rows, content_hash): the sum of the rows' digests, so order and partitioning do not matter and a repeated
    row counts twice. One aggregate, exact in decimal."""
    cells = row_message(*[F.col(c) for c in (columns or df.columns)])
    word = F.conv(F.substring(F.sha2(cells, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(word), F.lit(0)).cast("decimal(38,0)").cast("string").alias("content_hash"))


def manifest(inputs: Mapping[str, DataFrame], outputs: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]] | None = None) -> DataFrame:
    """(side, table, rows, content_hash, strategies)"""
    parts = []
    for side, tables in (("input", inputs), ("output", outputs)):
        for name, df in tables.items():
            kinds: dict[str, int] = {}
            for r in (rules or {}).get(name, ()):
                kinds[r.strategy] = kinds.get(r.strategy, 0) + len(r.columns)
            text = ",".join(f"{k}={v}" for k, v in sorted(kinds.items()))
            parts.append(content_hash(df).select(F.lit(side).alias("side"), F.lit(name).alias("table"), "rows", "content_hash", F.lit(text).alias("strategies")))
    return union_all(parts)


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, table, row_delta, changed)"""
    x = a.select("side", "table", F.col("rows").alias("ra"), F.col("content_hash").alias("ha"))
    y = b.select("side", "table", F.col("rows").alias("rb"), F.col("content_hash").alias("hb"))
    j = x.join(y, ["side", "table"], "full_outer")
    return j.select("side", "table", (F.col("rb") - F.col("ra")).alias("row_delta"), (~F.col("ha").eqNullSafe(F.col("hb"))).alias("changed"))


def _profile(df: DataFrame, columns: Sequence[str], exact: bool) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"),
                               F.approx_count_distinct(c).alias("unique"), F.lit(df.schema[c].dataType.typeName()).alias("type")) for c in columns])
    base = df.agg(cells.alias("r")).select(F.explode("r").alias("r")).select("r.*")
    if not exact:
        return base
    counts = stack(df, columns, "string").where("value is not null").distinct().groupBy("column").agg(F.count("*").alias("u"))
    return base.drop("unique").join(F.broadcast(counts), "column", "left").withColumn("unique", F.coalesce("u", F.lit(0))).drop("u")


def data_diff(a: DataFrame, b: DataFrame, exact: bool = True) -> DataFrame:
    """(column, change, row_delta, null_delta, unique_delta, type_changed) of b against a."""
    p = _profile(a, a.columns, exact).select("column", *[F.col(c).alias(f"{c}_a") for c in ("rows", "nulls", "unique", "type")])
    q = _profile(b, b.columns, exact).select("column", *[F.col(c).alias(f"{c}_b") for c in ("rows", "nulls", "unique", "type")])
    j = p.join(q, "column", "full_outer")
    change = F.when(F.col("rows_a").isNull(), "added").when(F.col("rows_b").isNull(), "removed").otherwise("common")
    return j.select("column", change.alias("change"), (F.col("rows_b") - F.col("rows_a")).alias("row_delta"), (F.col("nulls_b") - F.col("nulls_a")).alias("null_delta"),
                    (F.col("unique_b") - F.col("unique_a")).alias("unique_delta"), (F.col("type_a") != F.col("type_b")).alias("type_changed"))


def distribution_warnings(source: DataFrame, output: DataFrame, columns: Sequence[str], max_drop: float = 0.2) -> DataFrame:
    """(column, similarity, warn): after a run, columns whose distribution moved more than allowed. Warns only."""
    return marginal(source, output, columns).where("comparable").select("column", "similarity", (1 - F.col("similarity") > max_drop).alias("warn"))
