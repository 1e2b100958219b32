"""Row order, exact and distributed: dense indexes and running totals without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

SHIFT = 33  # monotonically_increasing_id keeps the partition above bit 33


def with_row_index(df: DataFrame, order_by: Sequence[str | Column], out: str = "_rid", start: int = 0) -> DataFrame:
    """Add a dense index in the given order. ``order_by`` should identify a row; ties are broken by layout once
    and then frozen, because the sorted frame is written before it is numbered.

    One range shuffle. A hot order key only matters if it fills a partition, so pass a tie break.
    """
    n = shuffle_partitions(df.sparkSession)
    cut = materialize(
        df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
        .withColumn("__xm", F.monotonically_increasing_id()),
        "index",
    )
    part = F.shiftright("__xm", SHIFT)
    sizes = cut.groupBy(part.alias("__xp")).agg(F.count("*").alias("__xn"))
    # at most one row per shuffle partition, so both the window and the broadcast are bounded by n
    before = Window.partitionBy(F.lit(1)).orderBy("__xp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__xp", F.coalesce(F.sum("__xn").over(before), F.lit(0)).alias("__xoff"))
    pos = F.col("__xm").bitwiseAND(F.lit((1 << SHIFT) - 1))
    return (
        cut.withColumn("__xp", part)
        .join(F.broadcast(offsets), "__xp")
        .withColumn(out, pos + F.col("__xoff") + F.lit(start))
        .drop("__xm", "__xp", "__xoff")
    )


def first_rows(df: DataFrame, order_by: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows in order. Every partition keeps its own first n, without a shuffle; what is left is sorted by
    ranges and cut by row number, so no task holds more than its range."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << SHIFT) - 1))
    own = df.sortWithinPartitions(*order_by).withColumn("__place", place).where(F.col("__place") < n).drop("__place")
    return with_row_index(own, order_by, "__head").where(F.col("__head") < n).drop("__head")


def running_total(
    df: DataFrame, order_by: Sequence[str], weight: Column | None = None, group_by: Sequence[str] = (),
    out: str = "_run",
) -> DataFrame:
    """Add the sum of ``weight`` over the rows up to and including this one, per group, in order."""
    return running_totals(df, order_by, {out: F.lit(1).cast("bigint") if weight is None else weight}, group_by)


def running_totals(df: DataFrame, order_by: Sequence[str], weights: Mapping[str, Column], group_by: Sequence[str] = ()) -> DataFrame:
    """Add running sums, one for each name and weight, over the rows up to and including this one, per group, in order.

    A group may hold any share of the rows: it is cut over many range partitions. Each piece is summed on its
    own and the totals of earlier pieces are added. Only the first group of a partition can continue an earlier
    piece, so the offsets that are not zero number at most one per partition and are safe to broadcast.
    """
    keys, outs = list(group_by), list(weights)
    n = shuffle_partitions(df.sparkSession)
    cut = materialize(
        df.select("*", *[w.alias(f"__yw{i}") for i, w in enumerate(weights.values())])
        .repartitionByRange(n, *keys, *order_by).withColumn("__yp", F.spark_partition_id()),
        "run",
    )
    inside = Window.partitionBy(*keys, "__yp").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(f"__yw{i}").over(inside).alias(f"__yl{i}") for i in range(len(outs))])
    pieces = cut.groupBy(*keys, "__yp").agg(*[F.sum(f"__yw{i}").alias(f"__ys{i}") for i in range(len(outs))])
    earlier = (
        Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__yp").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = pieces.select(*keys, "__yp", *[F.sum(f"__ys{i}").over(earlier).alias(f"__yo{i}") for i in range(len(outs))],
                            F.count("*").over(earlier).alias("__ye")).where("__ye > 0")
    offsets = offsets.select(*[F.col(k).alias(f"__yg{i}") for i, k in enumerate(keys)], F.col("__yp").alias("__yq"), *[f"__yo{i}" for i in range(len(outs))])
    on = F.col("__yp") == F.col("__yq")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__yg{i}"))
    found = local.join(F.broadcast(offsets), on, "left")
    sums = {out: F.col(f"__yl{i}") + F.coalesce(F.col(f"__yo{i}"), F.lit(0)) for i, out in enumerate(outs)}
    return found.select(*[c for c in df.columns if c not in sums], *[c.alias(out) for out, c in sums.items()])


def rank_in_group(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str], out: str = "_rank") -> DataFrame:
    """0-based position inside the group. ``order_by`` must be total inside a group."""
    return running_total(df, order_by, None, group_by, out).withColumn(out, F.col(out) - 1)


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first in order. An aggregate with map-side combine, so a hot key is one row per task
    before the shuffle; a window would send the whole group to one task."""
    names = df.columns
    first = F.min_by(F.struct(*names), F.struct(*order_by)).alias("__r")
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(first).select(
        *[F.col("__r")[c].alias(c) for c in names]
    )


ACCURACY = 10_000   # the summary that brackets a rank is off by at most a share 1 / ACCURACY of the rows


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, q0, q1, ...) with linear interpolation between the two nearest ranks, exact at any size.

    A summary of bounded size brackets every rank between two values; then the rows below each bracket are counted, and only
    values inside the brackets, a few in ten thousand rows, are counted one by one and summed up in order. A value that fills
    a bracket is one row. Columns without values are left out.
    """
    spark = df.sparkSession
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sizes = numbers.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    # percentile_approx guarantees the rank to within a share 1 / ACCURACY; the room is twice that, and the next rank on either side
    room = [2 / ACCURACY + 3 / max(1, sizes[f"n{i}"]) for i in range(len(columns))]
    edge = lambda i: [min(1.0, max(0.0, p + d)) for p in probs for d in (-room[i], room[i])]
    summary = numbers.agg(*[F.percentile_approx(f"c{i}", edge(i), ACCURACY).alias(f"e{i}") for i in range(len(columns))]).first()
    brackets = []   # (column, probability, first value, last value, rank, fraction): one for each column and probability
    for i, _ in enumerate(columns):
        for j, p in enumerate(probs if sizes[f"n{i}"] else ()):
            first, last = summary[f"e{i}"][2 * j:2 * j + 2]
            at = (sizes[f"n{i}"] - 1) * float(p)
            brackets.append((i, j, first, last, int(at), at - int(at)))
    schema = "column string, " + ", ".join(f"q{j} double" for j in range(len(probs)))
    if not brackets:
        return spark.createDataFrame([], schema)
    below = numbers.agg(*[F.count_if(F.col(f"c{i}") < F.lit(first)).alias(f"b{k}") for k, (i, _, first, *_) in enumerate(brackets)]).first()
    inside = F.array(*[F.when(F.col(f"c{i}").between(F.lit(first), F.lit(last)), F.struct(F.lit(k).alias("k"), F.col(f"c{i}").alias("value")))
                       for k, (i, _, first, last, *_) in enumerate(brackets)])
    near = numbers.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x")).select("x.k", "x.value")
    run = running_total(near.groupBy("k", "value").agg(F.count("*").alias("n")), ["value"], F.col("n"), ["k"], "upto")
    known = spark.createDataFrame([(k, i, j, below[f"b{k}"], r, f) for k, (i, j, _, _, r, f) in enumerate(brackets)],
                                  "k int, i int, j int, below bigint, r bigint, f double")
    ranked = run.join(F.broadcast(known), "k").withColumn("end", F.col("below") + F.col("upto")).withColumn("begin", F.col("end") - F.col("n"))
    covers = lambda r: F.max(F.when((F.col("end") > r) & (F.col("begin") <= r), F.col("value")))
    each = ranked.groupBy("i", "j").agg(covers(F.col("r")).alias("a"), covers(F.col("r") + 1).alias("b"), F.max("f").alias("f"))
    value = F.when(F.col("f") > 0, F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).otherwise(F.col("a"))
    got = each.groupBy("i").agg(*[F.max(F.when(F.col("j") == j, value)).alias(f"q{j}") for j in range(len(probs))])
    names = spark.createDataFrame(list(enumerate(columns)), "i int, column string")
    return got.join(F.broadcast(names), "i").select("column", *[f"q{j}" for j in range(len(probs))])
