"""Referentially complete slices.

The closure works on key columns only: every table is reduced to its distinct key tuples (primary key, foreign
keys, and the columns its seeds look at) with their row counts. Rows with equal tuples share their fate, so a table
without a primary key is fine.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BudgetExceeded, InvalidRule, OrphansFound
from ..functions import expressions as X
from ..keys import hmac_hex, row_message, seed_key, subkey, unit
from ..session import materialize, together
from .joins import lookup_join
from .ordering import first_rows
from .relations import Link, orphan_count

ROWS, EDGE = "__rows", "__edge"
DIRECTIONS = ("both", "downward", "upward", "none")
OPS = {"eq": X.eq, "ne": X.ne, "lt": X.lt, "le": X.le, "gt": X.gt, "ge": X.ge, "in": X.is_in,
       "is_null": lambda c, _: X.is_null(c), "is_not_null": lambda c, _: X.is_not_null(c)}


@dataclass(frozen=True)
class Seed:
    """sample by key (fraction or count), filter by predicates, or an explicit key list."""

    table: str
    mode: str
    key_columns: tuple[str, ...] = ()
    fraction: str | float | None = None
    count: int | None = None
    where: tuple[tuple[str, str, object], ...] = ()
    keys: tuple = ()


@dataclass(frozen=True)
class SubsetPlan:
    seeds: tuple[Seed, ...]
    links: tuple[Link, ...]
    # (parent, child) or (parent, parent columns, child, child columns) -> both, downward or upward
    directions: Mapping[tuple, str] = field(default_factory=dict)
    primary_keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    seed: int = 42
    max_total_rows: int | None = None
    max_table_seed_multiple: float | None = None
    allow_dangling: bool = False


def seed_unit(plan_seed: int, table: str, columns: Sequence[str]) -> Column:
    return unit(hmac_hex(subkey(seed_key(plan_seed), "subset", table), row_message(*[F.col(c) for c in columns])))


def complete_key(columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond


def seed_rows(df: DataFrame, s: Seed, plan_seed: int) -> DataFrame:
    if s.mode == "filter":
        cond = X.and_(*[OPS[op](F.col(c), v) for c, op, v in s.where])
        return df.where(cond)
    if not s.key_columns:
        raise InvalidRule(f"seed {s.mode} on {s.table!r} needs key columns")
    keyed = df.where(complete_key(s.key_columns))
    if s.mode == "keys":
        rows = [k if isinstance(k, (tuple, list)) else (k,) for k in s.keys]
        schema = T.StructType([df.schema[c] for c in s.key_columns])
        wanted = df.sparkSession.createDataFrame([tuple(r) for r in rows], T.StructType(
            [T.StructField(f.name, f.dataType) for f in schema])).distinct()
        return lookup_join(df, wanted, list(s.key_columns), "left_semi")
    if s.mode != "sample":
        raise InvalidRule(f"unknown seed mode {s.mode!r}")
    u = seed_unit(plan_seed, s.table, s.key_columns)
    if s.fraction is not None:
        # decimals as written: 33.3% is 0.333, never a binary neighbour
        return keyed.where(u < F.lit(float(Decimal(str(s.fraction)))))
    chosen = first_rows(keyed.select(*s.key_columns).distinct().withColumn("__u", u), ["__u", *s.key_columns], int(s.count)).drop("__u")
    return lookup_join(df, chosen, list(s.key_columns), "left_semi")


def _key_columns(plan: SubsetPlan, table: str) -> list[str]:
    cols = list(plan.primary_keys.get(table, ()))
    for k in plan.links:
        cols += [c for c in (k.parent_columns if k.parent == table else ()) if c not in cols]
        cols += [c for c in (k.child_columns if k.child == table else ()) if c not in cols]
    for s in plan.seeds:
        if s.table == table:
            cols += [c for c in (*s.key_columns, *(w[0] for w in s.where)) if c not in cols]
    return cols


def preflight(tables: Mapping[str, DataFrame], plan: SubsetPlan, check_orphans: bool = True) -> list[str]:
    """Key columns exist, types agree, composites are whole, orphans obey the policy. Returns warnings."""
    warnings = []
    for k in plan.links:
        for t, cols in ((k.parent, k.parent_columns), (k.child, k.child_columns)):
            missing = [c for c in cols if c not in tables[t].columns]
            if missing:
                raise InvalidRule(f"{t} lacks key columns {missing}")
        for p, c in zip(k.parent_columns, k.child_columns):
            a, b = tables[k.parent].schema[p].dataType, tables[k.child].schema[c].dataType
            if a != b and not (isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)):
                raise InvalidRule(f"{k.parent}.{p} and {k.child}.{c} have different types")
        if check_orphans:
            n = orphan_count(tables[k.parent], tables[k.child], k)
            if n and k.orphans == "fail":
                raise OrphansFound(f"{k.child} has keys without a parent in {k.parent}")
            if n:
                warnings.append(f"{k.child}->{k.parent}: {n} orphan keys")
    for d in plan.directions.values():
        if d not in DIRECTIONS:
            raise InvalidRule(f"unknown direction {d!r}")
    return warnings


@dataclass
class Closure:
    """Surviving key tuples per table, plus what each edge added."""

    keys: dict[str, DataFrame | None]
    surviving: dict[str, DataFrame]
    edges: list[dict]
    rounds: int


def close(tables: Mapping[str, DataFrame], plan: SubsetPlan) -> Closure:
    """Follow every edge from the last round's new keys until no table grows. A round writes each table's new keys
    once, marked with the edge that found them, so the plan stays flat; rounds are at most the longest path.

    Children found downward over an edge have their parent over that edge already, so they do not ask for it again. A table that
    refers to itself is followed all the way in one round, by pointers that double in length: rounds grow with the logarithm of
    the depth.
    """
    keys: dict[str, DataFrame] = {}

    def key_frame(t: str) -> DataFrame:
        # written on first use: tables the closure never reaches are not read
        if t not in keys:
            counted = tables[t].groupBy(*_key_columns(plan, t)).agg(F.count("*").alias(ROWS))
            keys[t] = materialize(counted, f"keys-{t}")
        return keys[t]

    frontier: dict[str, tuple[DataFrame, set[int]]] = {}
    together([lambda t=t: key_frame(t) for t in sorted({s.table for s in plan.seeds})])
    for t in tables:
        picked = [seed_rows(tables[t], s, plan.seed).select(*_key_columns(plan, t)) for s in plan.seeds if s.table == t]
        if picked:
            both = reduce(lambda a, b: a.unionByName(b), picked)
            frontier[t] = materialize(_semi(key_frame(t), both.distinct()).withColumn(EDGE, F.lit(-1)), f"seed-{t}"), {-1}
    surviving = {t: f.drop(EDGE) for t, (f, _) in frontier.items()}
    # two links may join the same tables: their columns tell them apart
    way_of = lambda k: plan.directions.get((k.parent, tuple(k.parent_columns), k.child, tuple(k.child_columns)),
                                           plan.directions.get((k.parent, k.child), "both"))
    stats = [{"edge": f"{k.parent}->{k.child}", "direction": way_of(k), "rows_added_downward": 0, "rows_added_upward": 0} for k in plan.links]
    rounds = 0
    single = {i for i, k in enumerate(plan.links) if k.parent == k.child and _one_parent(key_frame, k)}
    while frontier:
        rounds += 1
        moves = []
        for i, k in enumerate(plan.links):
            down, up = 2 * i, 2 * i + 1
            way = way_of(k)
            if i in single and k.parent in frontier:
                # rows that came over this edge in this direction have all that lies beyond them
                rows, origins = frontier[k.parent]
                if way in ("both", "downward") and origins - {down}:
                    reach, n = _doubled(key_frame(k.parent), k, rows.where(F.col(EDGE) != down), upward=False)
                    moves.append((k.child, k.child_columns, reach, k.child_columns, down))
                    rounds += n
                if way in ("both", "upward") and not (plan.allow_dangling and way != "upward") and origins - {down, up}:
                    reach, n = _doubled(key_frame(k.parent), k, rows.where(~F.col(EDGE).isin(down, up)), upward=True)
                    moves.append((k.parent, k.parent_columns, reach, k.parent_columns, up))
                    rounds += n
                continue
            if k.parent in frontier and way in ("both", "downward"):
                moves.append((k.child, k.child_columns, frontier[k.parent][0], k.parent_columns, down))
            if k.child in frontier and way in ("both", "upward") and not (plan.allow_dangling and way != "upward"):
                rows, origins = frontier[k.child]
                if origins - {down}:
                    moves.append((k.parent, k.parent_columns, rows.where(F.col(EDGE) != down), k.child_columns, up))
        targets = sorted({m[0] for m in moves})
        together([lambda t=t: key_frame(t) for t in targets])

        def grow(t: str) -> tuple[DataFrame, dict[int, int]]:
            parts = [_reached(key_frame(t), to, rows, frm, e) for (name, to, rows, frm, e) in moves if name == t]
            new = reduce(lambda a, b: a.unionByName(b), parts)
            if len(parts) > 1:
                new = new.groupBy(*[c for c in new.columns if c != EDGE]).agg(F.min(EDGE).alias(EDGE))
            new = materialize(_minus(new, surviving[t]) if t in surviving else new, f"frontier-{t}")
            return new, {r[EDGE]: r["n"] for r in new.groupBy(EDGE).agg(F.sum(ROWS).alias("n")).collect()}

        grown = dict(zip(targets, together([lambda t=t: grow(t) for t in targets])))
        frontier = {}
        for t, (new, added) in grown.items():
            for e, n in added.items():
                stats[e // 2]["rows_added_upward" if e % 2 else "rows_added_downward"] += n
            if added:
                frontier[t] = new, set(added)
                plain = new.drop(EDGE)
                surviving[t] = surviving[t].unionByName(plain) if t in surviving else plain
    return Closure({t: keys.get(t) for t in tables}, surviving, stats, rounds)


def _one_parent(key_frame: Callable[[str], DataFrame], k: Link) -> bool:
    """Does every key of a table that refers to itself name one parent key at most?"""
    pairs = key_frame(k.parent).select(*k.parent_columns, *k.child_columns).where(complete_key(k.parent_columns)).distinct()
    return pairs.groupBy(*k.parent_columns).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _doubled(keys: DataFrame, k: Link, rows: DataFrame, upward: bool) -> tuple[DataFrame, int]:
    """Values whose rows a self reference reaches from ``rows``, and the rounds it took. Upward they are the parent keys of all
    ancestors; downward the keys of the rows and of all descendants, which are the parents that children name.

    A pointer leads from a key to that of an ancestor, first one step up and twice as far after each round, so a round reaches
    all that lies less than twice as far as before. A round without a new key is the last: a path has no gaps.
    """
    names = [f"__n{i}" for i in range(len(k.parent_columns))]
    ups = [f"__u{i}" for i in range(len(names))]
    out = k.parent_columns if upward else k.child_columns
    whole = lambda cols: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    jump = keys.select(*[F.col(c).alias(n) for c, n in zip(k.parent_columns, names)], *[F.col(c).alias(u) for c, u in zip(k.child_columns, ups)]).distinct()
    jump = materialize(jump.where(whole(names) & whole(ups)), "jump")
    start = k.child_columns if upward else k.parent_columns
    found = materialize(rows.select(*[F.col(c).alias(n) for c, n in zip(start, names)]).where(whole(names)).distinct(), "found")
    size, rounds = found.count(), 0
    while True:
        rounds += 1
        if upward:
            more = lookup_join(jump, found, names, "left_semi").select(*[F.col(u).alias(n) for u, n in zip(ups, names)])
        else:
            more = lookup_join(jump, found.toDF(*ups), ups, "left_semi").select(*names)
        found = materialize(found.unionByName(more).distinct(), "found")
        last, size = size, found.count()
        if size == last:
            return found.toDF(*out), rounds
        far = [f"__f{i}" for i in range(len(names))]
        step = jump.toDF(*ups, *far)
        jump = materialize(lookup_join(jump, step, ups, "inner").select(*names, *[F.col(f).alias(u) for f, u in zip(far, ups)]), "jump")


def _reached(keys: DataFrame, to: Sequence[str], frontier: DataFrame, frm: Sequence[str], edge: int) -> DataFrame:
    reach = frontier.select(*[F.col(a).alias(b) for a, b in zip(frm, to)]).where(complete_key(to)).distinct()
    return lookup_join(keys, reach, list(to), "left_semi").withColumn(EDGE, F.lit(edge))


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a not in b, nulls equal: key tuples are unique on each side."""
    cols = [c for c in a.columns if c not in (ROWS, EDGE)]
    cond = F.lit(True)
    right = b.select(*[F.col(c).alias(f"__b_{c}") for c in cols])
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    return a.join(right, cond, "left_anti")


def cut(tables: Mapping[str, DataFrame], closure: Closure) -> dict[str, DataFrame]:
    """The rows whose key tuple survived."""
    out = {}
    for t, df in tables.items():
        if t not in closure.surviving:
            out[t] = df.limit(0)
            continue
        s = closure.surviving[t]
        out[t] = _semi(df, s)
    return out


def _semi(df: DataFrame, s: DataFrame) -> DataFrame:
    """Semi join on whole key tuples. Tuples compare as structs, where a null part equals a null part."""
    cols = [c for c in s.columns if c != ROWS]
    keyed = df.withColumn("__k", F.struct(*cols))
    return lookup_join(keyed, s.select(F.struct(*cols).alias("__k")), ["__k"], "left_semi").drop("__k")


def estimates(tables: Mapping[str, DataFrame], plan: SubsetPlan, closure: Closure) -> DataFrame:
    """Dry run: rows per table before, seeded and after, and seed rows left out for a null key. Keys only."""
    out = None
    for t, df in tables.items():
        seeds = [s for s in plan.seeds if s.table == t]
        rows = lambda f: f.agg(F.coalesce(F.sum(ROWS), F.lit(0)).alias("input_rows"))
        counted = closure.keys[t]
        row = (rows(counted) if counted is not None else df.agg(F.count("*").alias("input_rows"))).withColumn("table", F.lit(t))
        alive = closure.surviving.get(t)
        row = row.withColumn("surviving_rows", rows(alive).scalar() if alive is not None else F.lit(0).cast("bigint"))
        n_seed, n_null = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        for s in seeds:
            n_seed = n_seed + seed_rows(df, s, plan.seed).agg(F.count("*")).scalar()
            if s.key_columns:
                n_null = n_null + df.agg(F.count_if(~complete_key(s.key_columns))).scalar()
        row = row.select("table", "input_rows", n_seed.alias("seed_rows"), "surviving_rows", n_null.alias("seed_null_excluded"))
        out = row if out is None else out.unionByName(row)
    return out


def check_budget(plan: SubsetPlan, counts: DataFrame) -> None:
    """Raised before any write. ``counts`` is the dry-run frame: one row per table."""
    rows = counts.collect()
    total = sum(r["surviving_rows"] for r in rows)
    if plan.max_total_rows is not None and total > plan.max_total_rows:
        raise BudgetExceeded(f"the subset has {total} rows, the budget is {plan.max_total_rows}")
    if plan.max_table_seed_multiple is not None:
        seeded = max(1, sum(r["seed_rows"] for r in rows))
        for r in rows:
            if r["surviving_rows"] > plan.max_table_seed_multiple * seeded:
                raise BudgetExceeded(f"table {r['table']} exceeds its seed multiple")


def subset(tables: Mapping[str, DataFrame], plan: SubsetPlan) -> dict[str, DataFrame]:
    preflight(tables, plan, check_orphans=any(k.orphans == "fail" for k in plan.links))
    closure = close(tables, plan)
    if plan.max_total_rows is not None or plan.max_table_seed_multiple is not None:
        check_budget(plan, estimates(tables, plan, closure))
    return cut(tables, closure)
