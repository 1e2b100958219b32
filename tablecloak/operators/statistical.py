"""Draw cells from a snapshot. A snapshot is a few hundred numbers, so its steps are literals of the expression."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRule
from ..functions.providers import LOREM
from ..keys import pick, unit
from . import alias
from .fit import Snapshot
from .joins import counted_join, lookup_join
from .masks import cumulative, weighted_pick

OTHER = "__other__"
FILLER = " ".join(LOREM) + " "


def _values(stats: dict, other_mode: str) -> tuple[list, list]:
    values = [v for v, _ in stats.get("top_values", [])]
    counts = [n for _, n in stats.get("top_values", [])]
    if other_mode == "emit" and stats.get("other_count"):
        values, counts = [*values, OTHER], [*counts, stats["other_count"]]
    if not values or sum(counts) <= 0:
        raise InvalidRule("statistical_stats_degenerate: the snapshot holds no value of this column")
    return values, counts


def draw(snap: Snapshot, column: str, h: Column, o: dict) -> Column:
    col = snap.columns[column]
    s, kind = col["stats"], col["kind"]
    u1, u2 = unit(h, 0), unit(h, 1)
    if kind == "categorical":
        if snap.epsilon is None and not o.get("allow_real_categories"):
            raise InvalidRule(f"{column!r}: real values would appear; set allow_real_categories")
        return weighted_pick(u1, *_values(s, o.get("other_mode", "redistribute")))
    hist = s.get("histogram") or []
    if kind == "numeric":
        if not hist or sum(n for *_, n in hist) <= 0:
            raise InvalidRule("statistical_stats_degenerate: the snapshot holds no bucket of this column")
        weights = [n for *_, n in hist]
        lo = weighted_pick(u1, [float(a) for a, _, _ in hist], weights)
        hi = weighted_pick(u1, [float(b) for _, b, _ in hist], weights)
        x = lo + u2 * (hi - lo)
        d = col["format"].get("decimals")
        return x if d is None else F.round(x, d).cast("bigint") if d == 0 else F.round(x, d)
    if kind == "datetime":
        years = s["years"]
        weights = [n for _, n in years]
        first = [int(dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc).timestamp()) for y, _ in years]
        after = [int(dt.datetime(y + 1, 1, 1, tzinfo=dt.timezone.utc).timestamp()) for y, _ in years]
        a, b = weighted_pick(u1, first, weights), weighted_pick(u1, after, weights)
        lo, hi = (int(x.replace(tzinfo=dt.timezone.utc).timestamp()) for x in (s["earliest"], s["latest"]))
        sec = F.greatest(F.least(F.floor(a + u2 * (b - a)).cast("bigint"), F.lit(hi)), F.lit(lo))
        ts = F.timestamp_seconds(sec)
        return ts.cast("date") if col["format"].get("resolution") == "date" else ts
    weights = [n for *_, n in hist]
    lo = weighted_pick(u1, [float(a) for a, _, _ in hist], weights)
    hi = weighted_pick(u1, [float(b) for _, b, _ in hist], weights)
    n = F.greatest(F.round(lo + u2 * (hi - lo)).cast("int"), F.lit(0))
    skip = pick(h, len(FILLER), 2).cast("int")
    times = F.ceil((n + skip) / len(FILLER)).cast("int")
    return F.repeat(F.lit(FILLER), times).substr(skip + 1, n)


def conditional_table(snap: Snapshot, parent: str, child: str) -> list[tuple[str, list[str], list[float]]]:
    pairs = snap.joints.get((parent, child))
    flip = pairs is None
    if flip:
        pairs = snap.joints.get((child, parent))
    if pairs is None:
        raise InvalidRule(f"the pair {parent},{child} was not fitted")
    by: dict[str, list[tuple[str, int]]] = {}
    for a, b, n in pairs:
        p, c = (b, a) if flip else (a, b)
        by.setdefault(p, []).append((c, n))
    return [(p, [c for c, _ in sorted(cs)], cumulative([c for c, _ in cs], [n for _, n in sorted(cs)])) for p, cs in sorted(by.items())]


def draw_released(df: DataFrame, snap: Snapshot, column: str, out: str, h: Column) -> DataFrame:
    """Draw a category of a private release by its noisy count. The release is a frame of any size, so is its alias table."""
    return alias.draw(df, alias.alias_table(snap.released[column], "value", F.col("n")), h, out)


def _draw_all(df: DataFrame, cells: DataFrame, parent: str, out: str, h: Column) -> DataFrame:
    """Draw the child from every cell (parent, child, n) of the row's parent value, by one alias table with a group for each
    parent value, and one for the overall counts that unseen and null parents draw from."""
    every = cells.groupBy("child").agg(F.sum("n").alias("n")).select(F.lit(False).alias("seen"), F.lit("").alias("parent"), "child", "n")
    table = alias.alias_table(cells.select(F.lit(True).alias("seen"), "parent", "child", "n").unionByName(every), "child", F.col("n"), ["seen", "parent"])
    known = table.totals.where("seen").select(F.col("parent").alias("__parent"), F.lit(True).alias("__seen"))
    asked = lookup_join(df.withColumn("__parent", F.col(parent).cast("string")).withColumn("__digest", h), known, ["__parent"])
    asked = asked.withColumn("__parent", F.when(F.col("__seen"), F.col("__parent")).otherwise(F.lit(""))).withColumn("__seen", F.coalesce("__seen", F.lit(False)))
    return alias.draw(asked, table, F.col("__digest"), out, {"seen": "__seen", "parent": "__parent"}).drop("__parent", "__seen", "__digest")


def joint_cells(snap: Snapshot, parent: str, child: str) -> DataFrame | None:
    """(parent, child, n) of a pair of which every cell was kept."""
    for pair, names in (((parent, child), ("parent", "child")), ((child, parent), ("child", "parent"))):
        if pair in snap.joint_frames:
            return snap.joint_frames[pair].select(F.col("a").alias(names[0]), F.col("b").alias(names[1]), "n")
    return None


def draw_conditional(df: DataFrame, snap: Snapshot, parent: str, child: str, out: str, h: Column) -> DataFrame:
    """Draw from the pair row of the parent value; an unseen parent falls back to the overall counts. A pair table of at most
    1,000 cells is broadcast; one of which every cell was kept is a frame, see ``_draw_all``."""
    cells = joint_cells(snap, parent, child)
    if cells is not None:
        return _draw_all(df, cells, parent, out, h)
    rows = conditional_table(snap, parent, child)
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "__parent string, __vals array<string>, __cum array<double>"))
    u = unit(h)
    joined = df.withColumn("__u", u).join(table, F.col(parent).cast("string") == F.col("__parent"), "left")
    at = F.size(F.filter("__cum", lambda c: c <= F.col("__u")))
    fallback = weighted_pick(F.col("__u"), *_values(snap.columns[child]["stats"], "redistribute"))
    picked = F.when(F.col("__vals").isNotNull(), F.get("__vals", F.least(at, F.size("__vals") - 1))).otherwise(fallback)
    return joined.withColumn(out, picked).drop("__parent", "__vals", "__cum", "__u")


def fallback_rows(df: DataFrame, snap: Snapshot, parent: str, child: str) -> int:
    """Rows whose parent value has no pair, for the run warning."""
    cells = joint_cells(snap, parent, child)
    if cells is not None:
        known = cells.select(F.col("parent").alias("__parent")).distinct()
        keys = df.select(F.col(parent).cast("string").alias("__parent"))
        return counted_join(keys, known, ["__parent"], "left_anti").agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    seen = [p for p, _, _ in conditional_table(snap, parent, child)]
    return df.where(F.col(parent).isNull() | ~F.col(parent).cast("string").isin(seen)).count()
