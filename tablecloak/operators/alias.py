"""Weighted draws from a table of any size: alias tables (Walker 1977) built by prefix sums, and looked up by an equi-join.

Every item is a slot, and all slots of a group hold the same: the group's total weight W, where K slots share K * W. An item of
weight w brings w * K. What a small item lacks is taken from the large ones in slot order; what is taken of a large one beyond its
surplus the next large one makes good. Laid end to end, lacks and surpluses are two running totals, and who gives to whom is
where they cross (Huebschle-Schneider and Sanders 2022). So the table takes a few range shuffles, no step looks at a
whole group in one task, and all numbers are integers: each item's share of its group is exactly its weight.

A draw picks a slot and a number below W, and takes the slot's own item below ``cut`` and the other one from there on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRule
from ..keys import never_null, pick
from ..session import materialize
from .joins import lookup_join
from .ordering import rank_in_group, running_totals

MOST_WEIGHT = 10**18  # of a group, so that a number below the total is drawn from a 60 bit word


def whole_weight(df: DataFrame, column: str) -> Column:
    """A weight column as whole numbers: integers as they are, decimals without their point; a null weighs nothing."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.col(column).cast("bigint"), F.lit(0))
    if isinstance(kind, T.DecimalType):
        return F.coalesce((F.col(column) * F.lit(10**kind.scale).cast("decimal(38,0)")).cast("bigint"), F.lit(0))
    raise InvalidRule(f"the weights {column!r} are neither whole numbers nor decimals")


@dataclass
class AliasTable:
    """``slots``: group columns, slot, cut, item, other. ``totals``: group columns, slots and total of each group."""

    slots: DataFrame
    totals: DataFrame
    group: tuple[str, ...]


def alias_table(items: DataFrame, item: str, weight: Column, group: Sequence[str] = ()) -> AliasTable:
    """``items`` holds each item of a group once; items without weight are left out, negative weights are refused, and so are null
    groups: they would be drawn by nobody."""
    group = list(group)
    base = materialize(items.select(*group, F.col(item).alias("item"), weight.cast("bigint").alias("w")), "weights")
    ends = base.groupBy(*group).agg(F.min("w").alias("low"), F.sum(F.col("w").cast("decimal(38,0)")).alias("total"))
    known = F.lit(True)
    for g in group:
        known = known & F.col(g).isNotNull()
    if not ends.where((F.col("low") < 0) | (F.col("total") > MOST_WEIGHT) | ~known).isEmpty():
        raise InvalidRule(f"weights are 0 or more, up to {MOST_WEIGHT} in all, of a known group")
    ranked = materialize(rank_in_group(base.where("w > 0"), group, ["item"], "slot"), "ranked")
    totals = ranked.groupBy(*group).agg(F.count("*").alias("slots"), F.sum("w").alias("total"))
    if group:
        sized = lookup_join(ranked, totals, group, "inner")
    else:
        one = totals.first()
        sized = ranked.withColumn("slots", F.lit(one["slots"])).withColumn("total", F.lit(one["total"] or 0).cast("bigint"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    brings, total = (wide("w") * wide("slots")).cast("decimal(38,0)"), F.col("total").cast("decimal(38,0)")
    sized = sized.withColumn("small", brings < total).withColumn("amount", F.abs(brings - total)).withColumn("brings", brings)
    one = F.lit(1).cast("bigint")
    run = running_totals(sized, ["slot"], {"upto": F.col("amount"), "nth": one}, [*group, "small"])
    run = run.withColumn("at", F.when(F.col("small"), F.col("upto") - F.col("amount")).otherwise(F.col("upto")))
    # a large item whose surplus ends where a lack begins gives nothing to it, so it comes first
    met = running_totals(run, ["at", "small", "slot"], {"larges": F.when(~F.col("small"), one).otherwise(F.lit(0).cast("bigint")),
                                                        "lack": F.when(F.col("small"), F.col("amount")).otherwise(F.lit(0).cast("decimal(38,0)"))}, group)
    taken = F.greatest(F.col("lack") - F.col("upto"), F.lit(0))
    cut = F.when(F.col("small"), F.col("brings")).otherwise(total - taken)
    giver = F.when(F.col("small"), F.col("larges")).when(taken > 0, F.col("nth")) + 1
    met = materialize(met.select(*group, "slot", "item", "small", "nth", cut.cast("bigint").alias("cut"), never_null(giver).alias("giver")), "alias")
    large = met.where("NOT small").select(*group, F.col("nth").alias("giver"), F.col("item").alias("other"))
    found = lookup_join(met, large, [*group, "giver"]).select(*group, "slot", "cut", "item", "other")
    return AliasTable(materialize(found, "alias"), materialize(totals, "alias_totals"), tuple(group))


def draw(df: DataFrame, table: AliasTable, digest: Column, out: str, group: Mapping[str, str] = {}) -> DataFrame:
    """Add ``out``: an item for each row by its digest, of the row's own group where the table has groups (column of the
    table -> column of ``df``). A group without items draws null."""
    names = {g: group[g] for g in table.group}
    own = {g: F.col(g).alias(c) for g, c in names.items()}
    if names:
        staged = lookup_join(df, table.totals.select(*own.values(), F.col("slots").alias("__slots"), F.col("total").alias("__total")), list(names.values()))
        slots, total = F.col("__slots"), F.col("__total")
    else:
        one = table.totals.first()
        if one is None or not one["slots"]:
            raise InvalidRule("no item to draw has a weight")
        staged, slots, total = df, int(one["slots"]), int(one["total"])
    staged = staged.withColumn("__slot", never_null(pick(digest, slots))).withColumn("__v", pick(digest, total, 1))
    held = table.slots.select(*own.values(), F.col("slot").alias("__slot"), F.col("cut").alias("__cut"), F.col("item").alias("__item"), F.col("other").alias("__other"))
    found = lookup_join(staged, held, [*names.values(), "__slot"])
    return found.withColumn(out, F.when(F.col("__v") < F.col("__cut"), F.col("__item")).otherwise(F.col("__other"))).select(
        *[c for c in df.columns if c != out], out)


def sql_alias(items: str, group: str = "") -> str:
    """CTEs for DuckDB, the last called ``alias_``: (group, slot, cut, item, other, slots, total) of ``items``: (group, item, w)."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    both = f"PARTITION BY {g}small"
    same = f"l.{group} = s.{group} AND " if group else ""
    return f"""a1 AS (SELECT *, row_number() OVER ({part} ORDER BY item) - 1 AS slot, count(*) OVER ({part}) AS slots, CAST(sum(w) OVER ({part}) AS HUGEINT) AS total FROM {items} WHERE w > 0),
 a2 AS (SELECT *, w::HUGEINT * slots < total AS small, abs(w::HUGEINT * slots - total) AS amount FROM a1),
 a3 AS (SELECT *, sum(amount) OVER ({both} ORDER BY slot) AS upto, row_number() OVER ({both} ORDER BY slot) AS nth FROM a2),
 a4 AS (SELECT *, CASE WHEN small THEN upto - amount ELSE upto END AS at_ FROM a3),
 a5 AS (SELECT *, sum(CASE WHEN small THEN 0 ELSE 1 END) OVER ({part} ORDER BY at_, small, slot) AS larges, sum(CASE WHEN small THEN amount ELSE 0 END) OVER ({part} ORDER BY at_, small, slot) AS lack FROM a4),
 alias_ AS (SELECT s.*, CASE WHEN s.small THEN s.w::HUGEINT * s.slots ELSE s.total - greatest(s.lack - s.upto, 0) END AS cut, l.item AS other FROM a5 s
  LEFT JOIN (SELECT * FROM a5 WHERE NOT small) l ON {same}l.nth = CASE WHEN s.small THEN s.larges ELSE s.nth END + 1)"""
