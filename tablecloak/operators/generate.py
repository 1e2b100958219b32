"""Synthetic tables from column types.

A cell is a function of (seed, table, column, row number), so a column grows or moves without touching the others
and any cell can be worked out alone. That is how references work: a child draws a parent's row number and
evaluates the parent's column there; no join. Only real tables and computed parents need one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CycleRefused, InvalidRule, UniquenessImpossible
from ..functions.fpe import let
from ..functions.providers import get_provider, value_from_digest
from ..keys import hmac_hex, int_div, never_null, permute, pick, row_message, seed_key, subkey, unit
from .alias import alias_table, draw as draw_alias, whole_weight
from .joins import lookup_join
from .masks import cumulative, table_scalar, weighted_pick, window_days
from .ordering import rank_in_group, running_total, with_row_index


@dataclass(frozen=True)
class Gen:
    name: str
    type: str
    options: dict = field(default_factory=dict)


def gen(name: str, type: str, **options: object) -> Gen:
    if type not in TYPES:
        raise InvalidRule(f"unknown column type {type!r}")
    return Gen(name, type, options)


@dataclass(frozen=True)
class GenTable:
    name: str
    rows: int
    columns: tuple[Gen, ...]
    unique_together: tuple[tuple[str, str], ...] = ()


class Source:
    """A parent that already exists as a table: numbered once, in key order."""

    def __init__(self, df: DataFrame, order_by: Sequence[str]):
        self.df = with_row_index(df, order_by, "__p")
        self.rows = self.df.count()


class Generator:
    def __init__(self, spark: SparkSession, tables: Sequence[GenTable] = (), sources: Mapping[str, Source] | None = None,
                 seed: int = 42, master: bytes | None = None, label: str = "", default_locale: str | None = None):
        self.locale = default_locale
        self.spark, self.sources = spark, dict(sources or {})
        self.key = seed_key(seed, master, label)
        self.tables = {t.name: t for t in tables}
        self.order = generation_order(list(self.tables.values()), self.sources)
        self.warnings: list[str] = []

    def cell_key(self, table: str, column: str) -> bytes:
        return subkey(self.key, table, column)

    def digest(self, table: str, column: str, i: Column) -> Column:
        return hmac_hex(self.cell_key(table, column), i.cast("string"))

    def rows_of(self, table: str) -> int:
        if table in self.tables:
            return self.tables[table].rows
        if table in self.sources:
            return self.sources[table].rows
        raise InvalidRule(f"unknown reference table {table!r}")

    # ---- one column

    def value(self, t: GenTable, g: Gen, i: Column, h: Column) -> Column:
        """The cell of a self-contained column at row number ``i`` with digest ``h``."""
        o, n = g.options, t.rows
        if g.type == "sequence":
            return self._sequence(g, i)
        if g.type == "constant":
            return F.lit(o["value"])
        if g.type == "faker":
            p = get_provider(o.get("faker_type") or o["provider"], **{"locale": o.get("locale", self.locale), **o.get("faker_kwargs", {})})
            if o.get("unique"):
                self._fits(t, g, p.size)
                return p.at(permute(self.cell_key(t.name, g.name), i, p.size))
            return value_from_digest(p, h)
        if g.type == "categorical":
            cats, weights = self._categories(o)
            if o.get("unique"):
                self._fits(t, g, len(cats))
                at = permute(self.cell_key(t.name, g.name), i, len(cats))
                return F.element_at(F.array(*[F.lit(c) for c in cats]), (at + 1).cast("int"))
            return weighted_pick(unit(h), cats, weights)
        if g.type == "distribution":
            return distribution(unit(h, 0), unit(h, 1), **o)
        if g.type == "group_key":
            raise InvalidRule("group_key is computed over its group columns")
        if g.type == "statistical":
            from .statistical import draw
            return draw(o["snapshot"], o.get("source_column", g.name), h, o)
        raise InvalidRule(f"{g.type} is not self-contained")

    def _categories(self, o: dict):
        c = o["categories"]
        return (list(c), list(c.values())) if isinstance(c, dict) else (list(c), o.get("weights"))

    def _sequence(self, g: Gen, i: Column) -> Column:
        o = g.options
        step = int(o.get("step", 1))
        if o.get("unique") and step == 0:
            raise UniquenessImpossible(f"{g.name!r} repeats with step 0")
        x = F.lit(int(o["start"])).cast("bigint") + i * F.lit(step).cast("bigint")
        if not any(k in o for k in ("prefix", "suffix", "pad_length")):
            return x
        s = x.cast("string")
        if "pad_length" in o:
            s = F.lpad(s, F.greatest(F.lit(int(o["pad_length"])), F.length(s)), F.lit("0"))
        return F.concat(F.lit(o.get("prefix", "")), s, F.lit(o.get("suffix", "")))

    def _fits(self, t: GenTable, g: Gen, domain: int) -> None:
        if t.rows > domain:
            raise UniquenessImpossible(f"{t.name}.{g.name}: {t.rows} rows but {domain} values")

    # ---- references: which parent row does row i take

    def parent_row(self, t: GenTable, g: Gen, i: Column, h: Column) -> Column:
        o = g.options
        parents = self.rows_of(o["reference_table"])
        if parents == 0:
            raise InvalidRule(f"{t.name}.{g.name}: the reference table {o['reference_table']!r} is empty")
        key = self.cell_key(t.name, g.name)
        if o.get("unique"):
            self._fits(t, g, parents)
            return permute(key, i, parents)
        lo, hi = o.get("min_per_parent"), o.get("max_per_parent")
        if lo is not None or hi is not None:
            return self._bounded(t, g, i, parents, int(lo or 0), hi, key, h)
        how = o.get("distribution", "random")
        if how == "sequential":
            return i % parents
        if how == "weighted":
            if len(o["weights"]) > LITERAL_WEIGHTS:
                raise InvalidRule(f"{t.name}.{g.name}: over {LITERAL_WEIGHTS} weights go in a column of the parent, named by weight_column")
            steps = cumulative(range(parents), o["weights"])
            return let(unit(h), lambda u: F.size(F.filter(F.array(*[F.lit(x) for x in steps[:-1]]), lambda x: x <= u))).cast("bigint")
        if how == "random":
            return pick(h, parents)
        raise InvalidRule(f"unknown reference distribution {how!r}")

    def _bounded(self, t: GenTable, g: Gen, i: Column, parents: int, lo: int, hi: int | None, key: bytes, h: Column) -> Column:
        """The first lo * P rows serve every parent lo times; the rest take distinct spare slots, hi - lo a parent."""
        base = lo * parents
        if t.rows < base or (hi is not None and (hi < lo or t.rows > hi * parents)):
            raise InvalidRule(f"{t.name}.{g.name}: {t.rows} rows cannot give {parents} parents {lo} to {hi} children each")
        if hi is None:
            spare = pick(h, parents)
        elif hi == lo:
            spare = i % parents
        else:
            # past the last row nothing is asked of the permutation
            spare = permute(key, F.greatest(i - base, F.lit(0)), parents * (hi - lo)) % parents
        return F.when(i < base, i % parents).otherwise(spare)

    def _pure(self, table: str, column: str) -> Gen | None:
        t = self.tables.get(table)
        g = next((c for c in t.columns if c.name == column), None) if t else None
        return g if g is not None and g.type in PURE and not _joined(g) and not g.options.get("null_probability") else None

    # ---- one table

    def build(self, name: str, frames: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """Columns in declared order. ``frames`` are the tables built so far, for computed parents."""
        t, frames = self.tables[name], dict(frames or {})
        i = F.col("_rid")
        pairs = {c: p for p in t.unique_together for c in p}
        staged = [self.digest(t.name, g.name, i).alias(f"__h_{g.name}") for g in t.columns if g.type in PURE | {"reference", "lookup", "windowed_date"}]
        df = self.spark.range(t.rows).select(F.col("id").alias("_rid"), *staged)
        pure, later = [], []
        for g in t.columns:
            h = F.col(f"__h_{g.name}")
            if g.type in PURE and not _joined(g):
                pure.append(self._nulls(g, self.value(t, g, i, h), h).alias(g.name))
            elif g.type in ("reference", "lookup") and not _joined(g):
                row = self._pair_row(t, g, pairs[g.name], i) if g.name in pairs else self.parent_row(t, g, i, h)
                pure.append(never_null(row).alias(f"__p_{g.name}"))
                later.append(g)
            else:
                later.append(g)
        df = df.select("*", *pure)
        for g in later:
            df = self._later(t, g, df, frames)
        return df.select("_rid", *[g.name for g in t.columns])

    def _pair_row(self, t: GenTable, g: Gen, pair: tuple[str, str], i: Column) -> Column:
        """Distinct pairs: a permutation of all |A| * |B| pairs, split in two."""
        a, b = [next(c for c in t.columns if c.name == x) for x in pair]
        na, nb = (self.rows_of(x.options["reference_table"]) for x in (a, b))
        self._fits(t, g, na * nb)
        q = permute(self.cell_key(t.name, "+".join(pair)), i, na * nb)
        return F.floor(q / nb).cast("bigint") if g.name == pair[0] else q % nb

    def _nulls(self, g: Gen, value: Column, h: Column) -> Column:
        p = g.options.get("null_probability")
        if p is None and g.type == "statistical":
            p = g.options["snapshot"].null_rate(g.options.get("source_column", g.name))
        return value if not p else F.when(unit(h, 3) >= F.lit(float(p)), value)

    def _later(self, t: GenTable, g: Gen, df: DataFrame, frames: Mapping[str, DataFrame]) -> DataFrame:
        o, h = g.options, F.col(f"__h_{g.name}")
        if g.type in ("reference", "lookup"):
            table, column = o["reference_table"], o["reference_column"]
            p = f"__p_{g.name}"
            if o.get("distribution") == "fitted":
                df = df.join(fitted_parents(self, t, g), "_rid")
            elif _joined(g):
                df = self._weighted(t, g, df, frames)
            parent = self._pure(table, column)
            if parent is not None:
                at = self.value(self.tables[table], parent, F.col(p), self.digest(table, column, F.col(p)))
                df = df.withColumn(g.name, at)
            else:
                source = self._numbered(table, frames)
                small = source.select(F.col("__p").alias(p), F.col(column).alias(g.name))
                df = lookup_join(df, small, [p])
            return df.withColumn(g.name, self._nulls(g, F.col(g.name), h)) if o.get("null_probability") else df
        if g.type in ("formula", "derived"):
            return df.withColumn(g.name, _bounded_value(o))
        if g.type == "derived_aggregate":
            return df.withColumn(g.name, table_scalar(df, o["op"], o["column"]))
        if g.type == "group_key":
            cols = [o["group_by"]] if isinstance(o["group_by"], str) else list(o["group_by"])
            d = hmac_hex(self.cell_key(t.name, g.name), row_message(*[F.col(c) for c in cols]))
            return df.withColumn(g.name, F.concat(F.lit(o.get("prefix", "")), F.substring(d, 1, int(o.get("length", 16)))))
        if g.type == "windowed_date":
            days = window_days(unit(h), int(o.get("min_days", 0)), int(o["max_days"]), o.get("distribution", "uniform"))
            return df.withColumn(g.name, self._nulls(g, F.date_add(F.col(o["anchor"]).cast("date"), days), h))
        if g.type == "grouped_series":
            group = [o["group_by"]] if isinstance(o["group_by"], str) else list(o["group_by"])
            order = [o["order_by"]] if isinstance(o["order_by"], str) else list(o["order_by"])
            order = list(dict.fromkeys([*order, "_rid"]))
            start, step = o.get("start", 0), o.get("step", 1)
            if o.get("generator", "cumcount") == "cumcount":
                return rank_in_group(df, group, order, g.name).withColumn(g.name, F.lit(start) + F.col(g.name) * F.lit(step))
            u = unit(self.digest(t.name, g.name, F.col("_rid")))
            steps = df.withColumn("__s", F.floor(u * F.lit(int(o.get("max_step", 10)) + 1)).cast("bigint"))
            return running_total(steps, order, F.col("__s"), group, g.name).withColumn(g.name, F.lit(start) + F.col(g.name)).drop("__s")
        if g.type == "statistical":
            from .statistical import draw_released
            return draw_released(df, o["snapshot"], o.get("source_column", g.name), g.name, h).withColumn(g.name, self._nulls(g, F.col(g.name), h))
        if g.type == "statistical_conditional":
            from .statistical import draw_conditional
            df = df.withColumn(f"__h_{g.name}", self.digest(t.name, g.name, F.col("_rid")))
            return draw_conditional(df, o["snapshot"], o["condition_on"], o.get("source_column", g.name), g.name, F.col(f"__h_{g.name}"))
        raise InvalidRule(f"unknown column type {g.type!r}")

    def _numbered(self, table: str, frames: Mapping[str, DataFrame]) -> DataFrame:
        """A parent's rows with their numbers in ``__p``."""
        return self.sources[table].df if table in self.sources else frames[table].withColumnRenamed("_rid", "__p")

    def _weighted(self, t: GenTable, g: Gen, df: DataFrame, frames: Mapping[str, DataFrame]) -> DataFrame:
        """The parent of each row by the weights in a column of the parent: drawn from an alias table, which is a frame, so
        parents may be as many as rows."""
        o, p = g.options, f"__p_{g.name}"
        if o.get("unique") or o.get("min_per_parent") is not None or o.get("max_per_parent") is not None:
            raise InvalidRule(f"{t.name}.{g.name}: weights and bounds on the children of a parent exclude each other")
        parents = self._numbered(o["reference_table"], frames)
        table = alias_table(parents, "__p", whole_weight(parents, o["weight_column"]))
        drawn = draw_alias(df, table, F.col(f"__h_{g.name}"), p)
        return drawn.withColumn(p, never_null(F.col(p)))

    def run(self) -> dict[str, DataFrame]:
        frames: dict[str, DataFrame] = {}
        for name in self.order:
            frames[name] = self.build(name, frames)
        return {n: f.drop("_rid") for n, f in frames.items()}


def _joined(g: Gen) -> bool:
    """Is the cell drawn from a frame, by a join, and not worked out from the row's digest alone?"""
    o = g.options
    if g.type == "statistical":
        return o.get("source_column", g.name) in o["snapshot"].released
    return g.type in ("reference", "lookup") and (o.get("distribution") == "fitted" or o.get("distribution") == "weighted" and "weight_column" in o)


def _bounded_value(o: dict) -> Column:
    e = o["expression"]
    if "bounds" in o:
        lo, hi = o["bounds"]
        e = F.when(e.between(lo, hi), e)
    if o.get("null_propagation") is False:
        e = F.coalesce(e, F.lit(o.get("default", 0)))
    return e


LITERAL_WEIGHTS = 1000  # weights that may stand in the rule itself
PURE = {"sequence", "faker", "categorical", "constant", "distribution", "statistical"}
TYPES = PURE | {"reference", "lookup", "formula", "derived", "derived_aggregate", "grouped_series", "windowed_date",
                "group_key", "statistical_conditional"}


def distribution(u1: Column, u2: Column, family: str = "uniform", **o: float) -> Column:
    """Inverse CDFs. Only uniform is the contract; the others are ours (D)."""
    if family == "uniform":
        lo, hi = float(o.get("min", 0.0)), float(o.get("max", 1.0))
        return F.lit(lo) + u1 * F.lit(hi - lo)
    if family == "exponential":
        return -F.log(F.lit(1.0) - u1) * F.lit(float(o.get("mean", 1.0)))
    if family in ("normal", "lognormal"):
        z = F.sqrt(-2.0 * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(6.283185307179586) * u2)
        x = F.lit(float(o.get("mean", 0.0))) + z * F.lit(float(o.get("std", 1.0)))
        return F.exp(x) if family == "lognormal" else x
    if family == "zipf":
        n, a = int(o.get("n", 100)), float(o.get("a", 1.0))
        return weighted_pick(u1, list(range(1, n + 1)), [k**-a for k in range(1, n + 1)])
    raise InvalidRule(f"unknown distribution family {family!r}")


def generation_order(tables: Sequence[GenTable], sources: Mapping[str, object] = {}) -> list[str]:
    """Parents before children; a circle is refused."""
    needs = {t.name: {g.options["reference_table"] for g in t.columns if g.type in ("reference", "lookup")}
             - {t.name} - set(sources) for t in tables}
    out: list[str] = []
    while needs:
        ready = [t for t, d in needs.items() if not (d - set(out))]
        if not ready:
            raise CycleRefused(f"tables in a circle: {', '.join(sorted(needs))}")
        out += ready
        for t in ready:
            del needs[t]
    return out


def preview(tables: Sequence[GenTable], rows: int) -> list[GenTable]:
    """Scale so that the largest table has ``rows`` rows and the ratios hold."""
    if not 1 <= rows <= 1000:
        raise InvalidRule("a preview has 1 to 1000 rows")
    largest = max(t.rows for t in tables)
    return [GenTable(t.name, max(1, round(t.rows * rows / largest)), t.columns, t.unique_together) for t in tables]


PIECE = 4096  # children of one parent that one row is exploded to


def fitted_parents(g: Generator, t: GenTable, col: Gen) -> DataFrame:
    """(_rid, __p_<col>): children per parent drawn from a fan-out histogram {children: parents}, then cut or
    extended to the row count (D). Every child has a parent; the numbering is a distributed running total."""
    hist: Mapping[int, int] = col.options["fanout"]
    parents = g.rows_of(col.options["reference_table"])
    ks = sorted(hist)
    draw = weighted_pick(unit(g.digest(t.name, col.name, F.col("id"))), ks, [hist[k] for k in ks]).cast("bigint")
    per = running_total(g.spark.range(parents).select("id", draw.alias("k")), ["id"], F.col("k"), (), "upto")
    total = per.agg(F.max("upto")).first()[0] or 0
    # a parent with very many children is cut into pieces, dealt out before their rows are written out
    pieces = per.where("k > 0").select("id", "upto", (F.col("upto") - F.col("k")).alias("from"), F.explode(
        F.sequence(F.lit(0).cast("bigint"), int_div(F.col("k") - 1, PIECE))).alias("piece")).repartition("id", "piece")
    first = F.col("from") + F.col("piece") * PIECE
    slots = pieces.select(F.col("id").alias(f"__p_{col.name}"), F.explode(F.sequence(first, F.least(first + PIECE, F.col("upto")) - 1)).alias("_rid"))
    if total > t.rows:
        # which slots stay is a keyed permutation, and it numbers the ones that stay
        slots = slots.withColumn("_rid", permute(subkey(g.cell_key(t.name, col.name), "cut"), F.col("_rid"), total)).where(F.col("_rid") < t.rows)
    if total < t.rows:
        extra = g.spark.range(total, t.rows).select(pick(hmac_hex(subkey(g.cell_key(t.name, col.name), "more"), F.col("id").cast("string")), parents)
                                                    .alias(f"__p_{col.name}"), F.col("id").alias("_rid"))
        slots = slots.unionByName(extra)
    return slots


def check_fidelity(scores: Mapping[str, float], threshold: float = 0.80) -> list[str]:
    """Warnings for statistical columns below ``fidelity_warn_threshold``."""
    return [f"column {c} scores {s:.3f}, under {threshold}" for c, s in sorted(scores.items()) if s < threshold]
