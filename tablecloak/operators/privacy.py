"""Attack-side measures of a masked or synthetic table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRule
from ..session import materialize
from .joins import counted_join, lookup_join

LEVELS = 10


def distance_to_closest(source: DataFrame, output: DataFrame, row_key: Sequence[str], columns: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """(row_key, dcr): how near the closest source record is, as a bound (D).

    Columns are scaled to [0, 1] by the source's range and cut into grids of side 1, 1/2, 1/4 ... An output row gets
    the side of the finest grid cell it shares with some source record, so a source record is at most that far away
    in the largest coordinate; 0 is an exact copy; 1 means none nearer was found. Occupied cells are distinct
    before they meet the output, so no pair of rows is ever formed.
    """
    ends = source.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns], *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns]).first()

    def cells(df: DataFrame, extra: Sequence[str]) -> DataFrame:
        scaled = []
        for c in columns:
            lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
            x = F.col(c).cast("double")
            scaled.append(((x - F.lit(lo)) / F.lit(hi - lo) if hi is not None and hi > lo else F.when(x == F.lit(lo), 0.0).otherwise(2.0)).alias(f"__x_{c}"))
        base = df.select(*extra, *scaled).dropna(subset=[f"__x_{c}" for c in columns])
        exploded = base.select(*extra, *[f"__x_{c}" for c in columns], F.explode(F.sequence(F.lit(1), F.lit(levels + 1))).alias("__lvl"))
        # the last level is the value itself
        grid = [F.when(F.col("__lvl") > levels, F.col(f"__x_{c}")).otherwise(F.floor(F.col(f"__x_{c}") * F.pow(F.lit(2.0), F.col("__lvl"))).cast("double")).alias(f"__c_{c}") for c in columns]
        return exploded.select(*extra, "__lvl", *grid)

    on = ["__lvl", *[f"__c_{c}" for c in columns]]
    occupied = cells(source, []).distinct().withColumn("__hit", F.lit(True))
    hit = lookup_join(cells(output, row_key), occupied, on)
    best = hit.groupBy(*row_key).agg(F.max(F.when(F.col("__hit"), F.col("__lvl"))).alias("__best"))
    side = F.when(F.col("__best").isNull(), 1.0).when(F.col("__best") > levels, 0.0).otherwise(F.pow(F.lit(2.0), -F.col("__best")))
    return best.select(*row_key, side.alias("dcr"))


LEAF = 32        # distinct records of a cell that an output record is compared with one by one
CELL_BITS = 6    # bits by which a level of the grid is finer than the one above, over all columns
MOST_COLUMNS = 8
DEEPEST = 48     # bits of a column that tell cells apart; closer records share a cell, and are compared in pieces of LEAF


def closest_record(source: DataFrame, output: DataFrame, row_key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(row_key, distance): the exact distance of every output row to the closest source record, the largest difference of any
    column, in units of the source's range (in a column where the source has one value, any other is 1 away).

    The source's distinct records lie in a pyramid of grids, each cell with the bounds of the records inside it; a cell of at most
    ``LEAF`` records is not parted further. Level by level an output record keeps the cells whose near side is no farther than
    the nearest far side it has met, which bounds its distance from above; so its ring of cells closes in until only leaves are
    left, and their records decide. Equal records are looked at once, on both sides; rows with a null in a column are left out.
    Without source records there is no row. Up to ``MOST_COLUMNS`` columns, which bound the parts of a cell.
    """
    if not 1 <= len(columns) <= MOST_COLUMNS:
        raise InvalidRule(f"the distance is over 1 to {MOST_COLUMNS} columns")
    ends = source.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)]).first()

    def points(df: DataFrame, *extra: str) -> DataFrame:
        scaled = []
        for i, c in enumerate(columns):
            lo, hi, x = ends[2 * i], ends[2 * i + 1], F.col(c).cast("double")
            scaled.append(((x - F.lit(lo)) / F.lit(hi - lo) if lo != hi else F.when(x == F.lit(lo), 0.0).when(x.isNotNull(), 1.0)).alias(f"__x{i}"))
        kept = df.select(*extra, *scaled).dropna(subset=[f"__x{i}" for i in range(len(columns))])
        # minus zero is zero
        return kept.select(*extra, F.array(*[F.col(f"__x{i}") + F.lit(0.0) for i in range(len(columns))]).alias("x"))

    rows = points(output, *row_key)
    if ends[0] is None:
        return rows.select(*row_key, F.lit(None).cast("double").alias("distance")).where(F.lit(False))
    levels, leaves = _pyramid(points(source).distinct(), len(columns))
    asked = rows.select("x").distinct()
    found = materialize(_closest(asked, levels, leaves), "closest")
    return lookup_join(rows, found, ["x"], "inner").select(*row_key, "distance")


def _cell(x: Column, bits: int) -> Column:
    return F.transform(x, lambda v: F.floor(v * F.lit(float(2**bits))).cast("bigint"))


def _pyramid(records: DataFrame, width: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels (parent, cells): the occupied cells of each cell that is parted, as an array of (cell, n, low, high); and the leaves
    (cell, level, piece, records)."""
    step, bits = max(1, CELL_BITS // width), 0
    none = F.array().cast("array<bigint>")
    left = materialize(records.select("x", none.alias("parent"), _cell(F.col("x"), 0).alias("cell")), "records")
    levels, leaves = [], []
    while True:
        sized = materialize(left.groupBy("cell").agg(F.first("parent").alias("parent"), F.count("*").alias("n"),
                                                     F.array(*[F.min(F.col("x")[i]) for i in range(width)]).alias("low"),
                                                     F.array(*[F.max(F.col("x")[i]) for i in range(width)]).alias("high")), "cells")
        levels.append(sized.groupBy("parent").agg(F.collect_list(F.struct("cell", "n", "low", "high")).alias("cells")))
        last = bits + step > DEEPEST
        marked = materialize(lookup_join(left.select("x", "cell"), sized.select("cell", "n"), ["cell"], "inner"), "marked")
        done = marked if last else marked.where(F.col("n") <= LEAF)
        pieces = F.ceil(F.col("n") / LEAF)
        # records of a cell that is not parted any more, dealt over pieces
        leaves.append(done.withColumn("piece", F.pmod(F.xxhash64("x"), pieces)).groupBy("cell", "piece").agg(
            F.collect_list("x").alias("records")).withColumn("level", F.lit(len(levels) - 1)))
        if last or marked.where(F.col("n") > LEAF).isEmpty():
            return [materialize(x, "level") for x in levels], materialize(reduce(lambda a, b: a.unionByName(b), leaves), "leaves")
        bits += step
        left = marked.where(F.col("n") > LEAF).select("x", F.col("cell").alias("parent"), _cell(F.col("x"), bits).alias("cell"))


def _closest(asked: DataFrame, levels: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """(x, distance) of every asked record."""
    last = len(levels) - 1

    def near(x: Column, cell: Column) -> Column:
        """How far the nearest corner of a cell's bounds is."""
        gap = F.zip_with(F.zip_with(cell["low"], x, lambda a, v: a - v), F.zip_with(x, cell["high"], lambda v, b: v - b), lambda p, q: F.greatest(p, q, F.lit(0.0)))
        return F.array_max(gap)

    def far(x: Column, cell: Column) -> Column:
        span = F.zip_with(F.zip_with(x, cell["low"], lambda v, a: F.abs(v - a)), F.zip_with(x, cell["high"], lambda v, b: F.abs(v - b)), lambda p, q: F.greatest(p, q))
        return F.array_max(span)

    open_ = asked.select("x", F.array().cast("array<bigint>").alias("parent"))
    kept = asked.select("x", F.lit(None).cast("double").alias("upper"), F.array().cast("array<struct<near:double,cell:array<bigint>,n:bigint,level:int>>").alias("cells"))
    for k, level in enumerate(levels):
        met = lookup_join(open_, level, ["parent"], "inner")
        each = met.select("x", F.explode("cells").alias("c"))
        each = each.select("x", far(F.col("x"), F.col("c")).alias("upper"), F.struct(
            near(F.col("x"), F.col("c")).alias("near"), F.col("c.cell").alias("cell"), F.col("c.n").alias("n"), F.lit(k).alias("level")).alias("c"))
        each = each.groupBy("x").agg(F.min("upper").alias("upper"), F.collect_list("c").alias("cells"))
        both = kept.unionByName(each).groupBy("x").agg(F.min("upper").alias("upper"), F.flatten(F.collect_list("cells")).alias("cells"))
        # a cell that was parted is replaced by its parts
        alive = F.filter("cells", lambda c: (c["near"] <= F.col("upper")) & ((c["n"] <= LEAF) | (c["level"] == k)))
        kept = materialize(both.select("x", "upper", alive.alias("cells")), "ring")
        if k < last:
            open_ = kept.select("x", F.explode(F.filter("cells", lambda c: c["n"] > LEAF)).alias("c")).select("x", F.col("c.cell").alias("parent"))
    pairs = kept.select("x", F.explode("cells").alias("c")).select(
        "x", F.col("c.cell").alias("cell"), F.col("c.level").alias("level"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("c.n") / LEAF) - 1)).alias("piece"))
    met = lookup_join(pairs, leaves, ["cell", "level", "piece"], "inner")
    nearest = F.array_min(F.transform("records", lambda r: F.array_max(F.zip_with(F.col("x"), r, lambda a, b: F.abs(a - b)))))
    return met.groupBy("x").agg(F.min(nearest).alias("distance"))


def linkage(source: DataFrame, output: DataFrame, qi: Sequence[str]) -> DataFrame:
    """(rows, linked, share): output rows whose quasi-identifier values point at exactly one source row (D)."""
    single = source.dropna(subset=list(qi)).groupBy(*qi).agg(F.count("*").alias("__n")).where("__n = 1").select(*qi, F.lit(True).alias("__hit"))
    hit = counted_join(output.select(*qi), single, qi)
    sums = hit.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("__hit"), F.col("__n"))), F.lit(0)).alias("linked"))
    return sums.withColumn("share", F.col("linked") / F.when(F.col("rows") > 0, F.col("rows")))
