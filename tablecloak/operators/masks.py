"""Masking one table: rules in, one projection out.

Every value-keyed strategy is a column expression of the cell alone, so one scan masks the whole table and the
same expressions run on a stream. Strategies that need the whole column (shuffle, geography, code sets, donors,
unique values, series) are frame steps that run first and leave their result beside the source columns.
Details the contract leaves open are marked (D) and tested as ours.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRule, NamespaceRequired, UndeclaredColumn, UniquenessImpossible
from ..functions import dates, ff1, fpe
from ..functions.providers import COMPOSITES, get_provider, value_from_digest
from ..keys import check_secret, hmac_hex, never_null, permute, pick, row_message, subkey, unit
from .joins import lookup_join
from .ordering import exact_quantiles, rank_in_group, running_total, with_row_index

REDACTED = "REDACTED"


@dataclass(frozen=True)
class Rule:
    """One column's rule. ``columns`` has several names for a coherent or joint group."""

    columns: tuple[str, ...]
    strategy: str
    options: dict = field(default_factory=dict)
    namespace: str | None = None
    deterministic: bool = False
    when: Column | None = None
    vault: bool = False
    cast: str | None = None

    @property
    def column(self) -> str:
        return self.columns[0]


def rule(columns: str | Sequence[str], strategy: str, namespace: str | None = None, deterministic: bool = False,
         when: Column | None = None, vault: bool = False, cast: str | None = None, **options: object) -> Rule:
    cols = (columns,) if isinstance(columns, str) else tuple(columns)
    if strategy not in STRATEGIES:
        raise InvalidRule(f"{strategy!r} is not a strategy")
    if STRATEGIES[strategy].needs_namespace and not namespace:
        raise NamespaceRequired(f"{strategy} on {cols[0]!r} needs a namespace")
    if strategy == "faker" and options.get("cardinality_mode") == "unique":
        strategy = "unique_faker"
    return Rule(cols, strategy, dict(options), namespace, deterministic, when, vault, cast)


def keep(*columns: str) -> list[Rule]:
    return [Rule((c,), "passthrough") for c in columns]


class Context:
    """What a strategy needs besides its column. Digests are staged in a projection of their own: used many
    times, computed once."""

    def __init__(self, schema: T.StructType, secret: bytes, table: str, row_key: Sequence[str] = (),
                 columns: Sequence[str] | None = None, stage: bool = True):
        self.schema, self.secret, self.table = schema, check_secret(secret), table
        self.row_key = tuple(row_key)
        self.stage = stage
        self.staged: dict[str, Column] = {}
        self._by_text: dict[str, str] = {}
        self.format_errors: dict[str, Column] = {}

    def kind(self, column: str) -> str:
        return self.schema[column].dataType.typeName()

    def key(self, rule: Rule, purpose: str) -> bytes:
        space = rule.namespace or f"{self.table}.{'+'.join(rule.columns)}"
        return subkey(self.secret, purpose, space)

    def digest(self, key: bytes, msg: Column) -> Column:
        expr = hmac_hex(key, msg)
        if not self.stage:
            return expr
        text = key.hex() + str(msg)
        if text not in self._by_text:
            name = f"__h{len(self.staged)}"
            self._by_text[text] = name
            self.staged[name] = expr
        return F.col(self._by_text[text])

    def row_digest(self, rule: Rule, purpose: str) -> Column:
        """Randomness of a row: fresh values do not follow the cell."""
        if not self.row_key:
            raise InvalidRule(f"{rule.strategy} on {rule.column!r} draws by row: name the row_key of {self.table!r}")
        key = subkey(self.secret, purpose, self.table, "+".join(rule.columns), "by-row")
        return self.digest(key, row_message(*[F.col(c) for c in self.row_key]))

    def cell_or_row(self, rule: Rule, purpose: str, c: Column) -> Column:
        if rule.deterministic or rule.namespace:
            return self.digest(self.key(rule, purpose), c.cast("string"))
        return self.row_digest(rule, purpose)

    def format_error(self, rule: Rule, bad: Column) -> None:
        self.format_errors[rule.column] = F.coalesce(bad, F.lit(False))


# ---- value-keyed strategies: (context, rule, column) -> column


def passthrough(ctx: Context, r: Rule, c: Column) -> Column:
    return c


def redact(ctx: Context, r: Rule, c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(r.options.get("with_value", REDACTED)))


def hash_(ctx: Context, r: Rule, c: Column) -> Column:
    """32 hex digits of the keyed digest (D)."""
    return F.substring(ctx.digest(ctx.key(r, "hash"), c.cast("string")), 1, int(r.options.get("length", 32)))


def fpe_(ctx: Context, r: Rule, c: Column, inverse: bool = False) -> Column:
    o, key = r.options, ctx.key(r, "fpe")
    if o.get("method", "feistel") not in ("feistel", "ff1"):
        raise InvalidRule("fpe knows the methods feistel and ff1")
    if o.get("method") == "ff1":
        if not isinstance(ctx.schema[r.column].dataType, T.StringType) or "checksum" in o:
            raise InvalidRule("the method ff1 is for text columns, with a charset")
        charset, luhn = o.get("charset", "digits"), bool(o.get("validate_luhn"))
        ctx.format_error(r, ff1.unfit(c, charset, int(luhn)))
        return ff1.ff1_text(c, key, charset, luhn, str(o.get("tweak", "")).encode(), inverse)
    if isinstance(ctx.schema[r.column].dataType, T.IntegralType):
        default = 18 if ctx.kind(r.column) == "long" else 9
        width = int(o.get("width", default))
        out = fpe.fpe_number(c, key, width, inverse).cast(ctx.schema[r.column].dataType)
        ctx.format_error(r, F.abs(c.cast("bigint")) >= 10**width)
        return out
    if "checksum" in o:
        out = fpe.fpe_checksum(c, key, o["checksum"], inverse)
        ctx.format_error(r, c.isNotNull() & out.isNull())
        return out
    charset, luhn = o.get("charset", "digits"), bool(o.get("validate_luhn"))
    ctx.format_error(r, fpe.too_short(c, charset, int(luhn)))
    return fpe.fpe_text(c, key, charset, luhn, inverse)


def faker(ctx: Context, r: Rule, c: Column) -> Column:
    o = dict(r.options)
    name = o.pop("provider", None)
    if name is None:
        raise InvalidRule(f"faker on {r.column!r} needs a provider")
    return F.when(c.isNotNull(), value_from_digest(get_provider(name, **o), ctx.cell_or_row(r, "faker", c)))


def _shift_days(digest: Column, lo: int, hi: int) -> Column:
    """Uniform in [lo, hi] without 0, so the output differs from the input (D)."""
    if hi < lo or (lo == hi == 0):
        raise InvalidRule("date_shift needs min_days < max_days")
    if not lo <= 0 <= hi:
        return (pick(digest, hi - lo + 1) + lo).cast("int")
    k = pick(digest, hi - lo) + lo
    return F.when(k >= 0, k + 1).otherwise(k).cast("int")


def shift_bounds(o: dict) -> tuple[int, int]:
    if "jitter_days" in o:
        n = int(o["jitter_days"])
        return -n, n
    return int(o.get("min_days", -365)), int(o.get("max_days", 365))


def date_shift(ctx: Context, r: Rule, c: Column) -> Column:
    o, kind = r.options, ctx.kind(r.column)
    fmt = o.get("date_format")
    if kind == "string" and not fmt:
        raise InvalidRule(f"date_shift on {r.column!r} needs a date_format")
    ts = dates.parse(c, fmt, kind)
    ctx.format_error(r, c.isNotNull() & ts.isNull())
    # keyed by the day itself, so one day written in two formats moves alike; or by the entity
    msg = F.col(o["group_by"]).cast("string") if "group_by" in o else F.date_format(ts, "yyyy-MM-dd")
    days = _shift_days(ctx.digest(ctx.key(r, "date_shift"), msg), *shift_bounds(o))
    # whole days in microseconds: keeps the time of day
    out = dates.render(F.timestamp_micros(F.unix_micros(ts) + days.cast("bigint") * F.lit(86_400_000_000)), fmt, kind)
    return _preserving(ctx, r, c, ts, out)


def _preserving(ctx: Context, r: Rule, c: Column, ts: Column, out: Column) -> Column:
    keep_values = r.options.get("preserve_values")
    if not keep_values:
        return out
    days = [dt.date.fromisoformat(str(v)) for v in keep_values]
    return F.when(ts.cast("date").isin(days), c).otherwise(out)


def truncate(ctx: Context, r: Rule, c: Column) -> Column:
    return F.substring(c.cast("string"), 1, int(r.options["length"]))


def _plain(x: Column) -> Column:
    """Number as text without a trailing .0"""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def bucketize(ctx: Context, r: Rule, c: Column) -> Column:
    """Band label lo-hi, hi exclusive (D)."""
    w = float(r.options["width"])
    x = c.try_cast("double")
    ctx.format_error(r, c.isNotNull() & x.isNull())
    lo = F.floor(x / F.lit(w)) * F.lit(w)
    return F.when(x.isNotNull(), F.concat(_plain(lo), F.lit("-"), _plain(lo + F.lit(w))))


def bucket_perturb(ctx: Context, r: Rule, c: Column) -> Column:
    """A keyed place inside the cell's own bucket: numbers by width, dates by bucket_days."""
    o, kind = r.options, ctx.kind(r.column)
    if "bucket_days" in o:
        fmt, size = o.get("date_format"), int(o["bucket_days"])
        ts = dates.parse(c, fmt, kind)
        ctx.format_error(r, c.isNotNull() & ts.isNull())
        day = F.datediff(ts.cast("date"), F.lit(dt.date(1970, 1, 1)))
        u = unit(ctx.digest(ctx.key(r, "bucket_perturb"), F.date_format(ts, "yyyy-MM-dd")))
        start = F.floor(day / F.lit(size)) * size
        moved = F.date_add(F.lit(dt.date(1970, 1, 1)), (start + F.floor(u * size)).cast("int"))
        return _preserving(ctx, r, c, ts, dates.render(moved.cast("timestamp"), fmt, kind))
    w = float(o["width"])
    x = c.try_cast("double")
    ctx.format_error(r, c.isNotNull() & x.isNull())
    u = unit(ctx.digest(ctx.key(r, "bucket_perturb"), c.cast("string")))
    return F.floor(x / F.lit(w)) * F.lit(w) + u * F.lit(w)


def top_code(ctx: Context, r: Rule, c: Column) -> Column:
    """Cap at a threshold, and at a floor when given."""
    o = r.options
    out = F.when(c > F.lit(o["threshold"]), F.lit(o["threshold"])).otherwise(c)
    if "floor" in o:
        out = F.when(c < F.lit(o["floor"]), F.lit(o["floor"])).otherwise(out)
    return out.cast(ctx.schema[r.column].dataType)


def cumulative(categories: Sequence, weights: Sequence[float] | None) -> list[float]:
    w = [1.0] * len(categories) if weights is None else [float(x) for x in weights]
    if len(w) != len(categories) or not categories:
        raise InvalidRule("categories and weights differ in length, or are empty")
    if min(w) < 0 or sum(w) <= 0:
        raise InvalidRule("weights must not be negative or all zero")
    total, run, out = sum(w), 0.0, []
    for x in w:
        run += x
        out.append(run / total)
    out[-1] = 1.0
    return out


def weighted_pick(u: Column, categories: Sequence, weights: Sequence[float] | None = None) -> Column:
    out = F
    steps = cumulative(categories, weights)
    for value, upto in zip(categories[:-1], steps[:-1]):
        out = out.when(u < F.lit(upto), F.lit(value))
    return F.lit(categories[-1]) if out is F else out.otherwise(F.lit(categories[-1]))


def categorical(ctx: Context, r: Rule, c: Column) -> Column:
    """A null cell may land in the closed set: it is hashed like any other value."""
    o = r.options
    cats = list(o["categories"])
    weights = o.get("weights")
    if isinstance(o["categories"], dict):
        cats, weights = list(o["categories"]), list(o["categories"].values())
    u = unit(ctx.digest(ctx.key(r, "categorical"), F.coalesce(c.cast("string"), F.lit("\\N"))))
    return weighted_pick(u, cats, weights)


def text_redact(ctx: Context, r: Rule, c: Column) -> Column:
    from .text import redact_text
    return redact_text(c, r.options.get("detectors"), r.options.get("token"))


def text_mask(ctx: Context, r: Rule, c: Column) -> Column:
    from .text import mask_text
    return mask_text(c, subkey(ctx.secret, "text_mask", r.namespace or f"{ctx.table}.{r.column}"),
                     r.options["detectors"], r.options.get("unmatched", "passthrough"), r.options.get("token"))


def formula(ctx: Context, r: Rule, c: Column) -> Column:
    """``expression`` is a column built from functions.expressions; never text."""
    expr = r.options["expression"]
    return expr


def group_key(ctx: Context, r: Rule, c: Column) -> Column:
    o = r.options
    group = [o["group_by"]] if isinstance(o["group_by"], str) else list(o["group_by"])
    d = ctx.digest(ctx.key(r, "group_key"), row_message(*[F.col(g) for g in group]))
    return F.concat(F.lit(o.get("prefix", "")), F.substring(d, 1, int(o.get("length", 16))))


def window_days(u: Column, lo: int, hi: int, distribution: str = "uniform") -> Column:
    """Days in [lo, hi] by inverse CDF: uniform, exponential_decay (mean a third of the span, cut) or
    linear_decay (D)."""
    span = hi - lo + 1
    if distribution == "uniform":
        x = u * span
    elif distribution == "exponential_decay":
        x = -F.log(F.lit(1.0) - u * F.lit(1.0 - 2.718281828459045 ** -3.0)) / 3.0 * span
    elif distribution == "linear_decay":
        x = (F.lit(1.0) - F.sqrt(F.lit(1.0) - u)) * span
    else:
        raise InvalidRule(f"unknown window distribution {distribution!r}")
    return (F.least(F.floor(x), F.lit(span - 1)) + lo).cast("int")


def windowed_date(ctx: Context, r: Rule, c: Column) -> Column:
    o = r.options
    anchor = F.col(o["anchor"]).cast("date")
    d = ctx.row_digest(r, "windowed_date") if not r.namespace else ctx.digest(ctx.key(r, "windowed_date"), c.cast("string"))
    days = window_days(unit(d), int(o.get("min_days", 0)), int(o["max_days"]), o.get("distribution", "uniform"))
    return F.when(c.isNotNull(), F.date_add(anchor, days))


def nested(ctx: Context, r: Rule, c: Column) -> Column:
    """Child rules inside a structured value. JSON text is read with the declared schema and written back;
    a struct column is edited in place; an array of structs is edited item by item."""
    o = r.options
    children: dict[str, Rule] = o["fields"]
    source_type = ctx.schema[r.column].dataType
    as_json = isinstance(source_type, T.StringType)
    if as_json:
        struct_type = T.StructType.fromDDL(o["schema"]) if isinstance(o["schema"], str) else o["schema"]
    else:
        struct_type = source_type.elementType if isinstance(source_type, T.ArrayType) else source_type
    sub = Context(struct_type, ctx.secret, f"{ctx.table}.{r.column}", ctx.row_key, stage=False)

    def edit(v: Column) -> Column:
        for name, child in children.items():
            child = replace(child, columns=(name,))
            v = v.withField(name, STRATEGIES[child.strategy].apply(sub, child, v[name]))
        return v

    if as_json:
        return F.to_json(edit(F.from_json(c, struct_type)))
    if isinstance(source_type, T.ArrayType):
        return F.transform(c, edit)
    return F.when(c.isNotNull(), edit(c))


def composite(ctx: Context, r: Rule) -> dict[str, Column]:
    """Columns that stay consistent inside a row share one index."""
    size, fields = COMPOSITES[r.options["provider"]]
    mapping = r.options.get("fields") or _match_fields(r.columns, tuple(fields))
    d = ctx.cell_or_row(r, "composite", row_message(*[F.col(x) for x in r.columns]))
    return {c: F.when(F.col(c).isNotNull(), fields[mapping[c]](pick(d, size))) for c in r.columns}


def _match_fields(columns: Sequence[str], fields: Sequence[str]) -> dict[str, str]:
    out = {}
    for i, c in enumerate(columns):
        out[c] = c if c in fields else fields[i]
    return out


# ---- whole-column strategies: (frame, context, rule) -> frame with __b_<column>


def _out(column: str) -> str:
    return f"__b_{column}"


def shuffle(df: DataFrame, ctx: Context, r: Rule) -> DataFrame:
    """Same multiset of values, other rows; null cells stay null. Cells are numbered in row-key order and row i
    takes the value of row p(i), p a keyed permutation: one equi-join on a unique number, so no skew. With
    ``deterministic`` and a namespace the permutation is the namespace's own."""
    if not ctx.row_key:
        raise InvalidRule(f"shuffle on {r.column!r} needs the row_key of {ctx.table!r}")
    if r.deterministic and not r.namespace:
        raise NamespaceRequired(f"deterministic shuffle on {r.column!r} needs a namespace")
    c = r.column
    cells = with_row_index(df.where(F.col(c).isNotNull()).select(*dict.fromkeys([*ctx.row_key, c])), ctx.row_key, "__i")
    n = cells.count()
    if not cells.groupBy(*ctx.row_key).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty():
        raise InvalidRule(f"the row_key of {ctx.table!r} does not tell its rows apart")
    marks = [f"__k{i}" for i in range(len(ctx.row_key))]
    to = cells.select(*[F.col(k).alias(m) for k, m in zip(ctx.row_key, marks)], never_null(permute(ctx.key(r, "shuffle"), F.col("__i"), n)).alias("__i"))
    moved = to.join(cells.select("__i", F.col(c).alias(_out(c))), "__i").drop("__i")
    # a null in the key is a key like any other
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(ctx.row_key, marks)])
    return df.join(moved, on, "left").withColumn(_out(c), F.when(F.col(c).isNotNull(), F.col(_out(c)))).drop(*marks)


def geo_generalize(df: DataFrame, ctx: Context, r: Rule) -> DataFrame:
    """The finest level of the cascade whose population reaches k. Populations are given as (zip5, population),
    else the table's own counts (D). A zip has five digits, so the level table has at most 100,000 rows."""
    o, c = r.options, r.column
    if o.get("type", "zip") != "zip":
        raise InvalidRule("geo_generalize knows type zip")
    cascade, k = list(o.get("cascade", ("zip5", "zip3", "state", "suppress"))), int(o.get("k_threshold", 20_000))
    zip5 = F.regexp_extract(F.col(c).cast("string"), r"^\s*([0-9]{5})", 1)
    pop = o.get("population")
    if pop is None:
        base = df.where(zip5 != "").groupBy(zip5.alias("zip5")).agg(F.count("*").alias("population"))
    else:
        base = pop.where(F.col("zip5").rlike("^[0-9]{5}$")).groupBy("zip5").agg(F.sum("population").alias("population"))
    state = o.get("states")  # (zip3, state), at most 1,000 rows
    base = base.withColumn("zip3", F.substring("zip5", 1, 3))
    if state is not None:
        state = state.where(F.col("zip3").rlike("^[0-9]{3}$")).groupBy("zip3").agg(F.min("state").alias("state"))
    base = base.join(F.broadcast(state), "zip3", "left") if state is not None else base.withColumn(
        "state", F.lit(None).cast("string"))
    per = {lvl: base.groupBy(lvl).agg(F.sum("population").alias(f"n_{lvl}")) for lvl in ("zip5", "zip3", "state")}
    levels = base.select("zip5", "zip3", "state").join(per["zip5"], "zip5").join(per["zip3"], "zip3").join(
        per["state"], "state", "left")
    out = F
    for lvl in cascade:
        if lvl == "suppress":
            break
        out = out.when(F.coalesce(F.col(f"n_{lvl}"), F.lit(0)) >= k, F.col(lvl))
    chosen = (F.lit(None).cast("string") if out is F else out.otherwise(F.lit(None)))
    table = levels.select(F.col("zip5").alias("__zip5"), chosen.alias(_out(c)))
    return df.withColumn("__zip5", zip5).join(F.broadcast(table), "__zip5", "left").drop("__zip5")


def code_set(df: DataFrame, ctx: Context, r: Rule) -> DataFrame:
    """Another code of the set, of the same chapter with ``chapter_preserve``. The replacement is worked out once
    per code; rows then look it up. A cell that is no code of the set is a mask_error."""
    o, c = r.options, r.column
    codes: DataFrame = o["codes"]  # (code, chapter)
    chapter = "chapter" if o.get("chapter_preserve") else None
    base = codes.select("code", (F.col("chapter") if chapter else F.lit("all")).alias("chapter")).distinct()
    ranked = rank_in_group(base, ["chapter"], ["code"], "__r")
    sizes = base.groupBy("chapter").agg(F.count("*").alias("__n"))
    key = ctx.key(r, "code_set")
    want = lookup_join(ranked, sizes, ["chapter"], "inner").select(
        F.col("code").alias("__code"), "chapter",
        # a step of 1 to n-1 along the chapter, so a code never stands for itself unless it is alone
        F.when(F.col("__n") > 1, (F.col("__r") + 1 + pick(hmac_hex(key, F.col("code")), F.col("__n") - 1)) % F.col("__n"))
        .otherwise(F.col("__r")).alias("__r"))
    swap = want.join(ranked, ["chapter", "__r"]).select(
        F.col("__code"), F.col("code").alias(_out(c)))
    out = lookup_join(df.withColumn("__code", F.col(c).cast("string")), swap, ["__code"], "left").drop("__code")
    ctx.format_errors[c] = F.col(c).isNotNull() & F.col(_out(c)).isNull()
    return out


def joint_mask(df: DataFrame, ctx: Context, r: Rule) -> DataFrame:
    """The columns of a group come together from one donor row, so combinations stay real. With ``match_on`` the
    donor has the same value there."""
    o = r.options
    match = [o["match_on"]] if isinstance(o.get("match_on"), str) else list(o.get("match_on") or [])
    donors: DataFrame = o.get("donors") if o.get("donors") is not None else df
    tuples = donors.select(*match, *r.columns).dropna().distinct()
    d = ctx.row_digest(r, "joint") if not r.deterministic else ctx.digest(
        ctx.key(r, "joint"), row_message(*[F.col(c) for c in r.columns]))
    staged = df.select("*", *[e.alias(n) for n, e in ctx.staged.items()])
    if not match:
        indexed = with_row_index(tuples, list(r.columns), "__i")
        total = indexed.count()
        drawn = staged.withColumn("__i", never_null(pick(d, total))).drop(*ctx.staged)
        named = indexed.select("__i", *[F.col(c).alias(_out(c)) for c in r.columns])
        return drawn.join(named, "__i", "left").drop("__i")
    ranked = rank_in_group(tuples, match, list(r.columns), "__i")
    sizes = ranked.groupBy(*match).agg(F.count("*").alias("__n"))
    drawn = lookup_join(staged, sizes, match).withColumn("__i", never_null(pick(d, F.col("__n")))).drop("__n", *ctx.staged)
    named = ranked.select(*match, "__i", *[F.col(c).alias(_out(c)) for c in r.columns])
    return lookup_join(drawn, named, [*match, "__i"]).drop("__i")


def unique_faker(df: DataFrame, ctx: Context, r: Rule) -> DataFrame:
    """cardinality_mode unique: no two inputs share an output. Distinct inputs are numbered, the number is permuted
    over the provider's domain, and the provider is a formula of it."""
    o = dict(r.options)
    provider = get_provider(o.pop("provider"), **{k: v for k, v in o.items() if k != "cardinality_mode"})
    c = r.column
    values = with_row_index(df.select(F.col(c).alias("__v")).where("__v is not null").distinct(), ["__v"], "__i")
    n = values.count()
    if n > provider.size:
        raise UniquenessImpossible(f"{r.column!r} has more distinct values than its provider")
    table = values.select("__v", permute(ctx.key(r, "unique"), F.col("__i"), provider.size).alias("__i")).select(
        "__v", provider.at(F.col("__i")).alias(_out(c)))
    return lookup_join(df.withColumn("__v", F.col(c)), table, ["__v"]).drop("__v")


def grouped_series(df: DataFrame, ctx: Context, r: Rule) -> DataFrame:
    o, c = r.options, r.column
    group = [o["group_by"]] if isinstance(o["group_by"], str) else list(o["group_by"])
    order = [o["order_by"]] if isinstance(o["order_by"], str) else list(o["order_by"])
    order = list(dict.fromkeys([*order, *ctx.row_key]))
    start, step = o.get("start", 0), o.get("step", 1)
    if o.get("generator", "cumcount") == "cumcount":
        run = rank_in_group(df, group, order, "__k")
        return run.withColumn(_out(c), F.lit(start) + F.col("__k") * F.lit(step)).drop("__k")
    # monotone walk: steps of 0 to max_step, summed along the order
    u = unit(hmac_hex(subkey(ctx.secret, "walk", ctx.table, c), row_message(*[F.col(k) for k in (*group, *order)])))
    stepped = df.withColumn("__s", F.floor(u * F.lit(int(o.get("max_step", 10)) + 1)).cast("bigint"))
    run = running_total(stepped, order, F.col("__s"), group, "__k")
    return run.withColumn(_out(c), F.lit(start) + F.col("__k")).drop("__k", "__s")


@dataclass(frozen=True)
class Strategy:
    apply: Callable
    whole_column: bool = False
    needs_namespace: bool = False
    join_safe: bool = False
    group: bool = False
    late: bool = False       # evaluated over the masked columns


STRATEGIES: dict[str, Strategy] = {
    "passthrough": Strategy(passthrough), "redact": Strategy(redact),
    "hash": Strategy(hash_, needs_namespace=True, join_safe=True),
    "fpe": Strategy(fpe_, needs_namespace=True, join_safe=True),
    "faker": Strategy(faker), "date_shift": Strategy(date_shift), "truncate": Strategy(truncate),
    "bucketize": Strategy(bucketize), "bucket_perturb": Strategy(bucket_perturb), "top_code": Strategy(top_code),
    "categorical": Strategy(categorical), "text_redact": Strategy(text_redact), "text_mask": Strategy(text_mask),
    "formula": Strategy(formula), "derived": Strategy(formula, late=True), "group_key": Strategy(group_key),
    "windowed_date": Strategy(windowed_date), "nested": Strategy(nested),
    "composite": Strategy(composite, group=True),
    "shuffle": Strategy(shuffle, whole_column=True), "geo_generalize": Strategy(geo_generalize, whole_column=True),
    "code_set": Strategy(code_set, whole_column=True), "joint_mask": Strategy(joint_mask, whole_column=True),
    "unique_faker": Strategy(unique_faker, whole_column=True),
    "grouped_series": Strategy(grouped_series, whole_column=True),
    "derived_aggregate": Strategy(formula, whole_column=True, late=True),
    "tokenize": Strategy(formula, whole_column=True, needs_namespace=True),
    "from_parent": Strategy(passthrough, whole_column=True),
}
# run cell by cell, so a chunk, a partition and a stream batch give the same bytes as a whole run
STREAMABLE = frozenset({"passthrough", "hash", "fpe", "redact", "truncate", "text_redact", "text_mask", "date_shift",
                        "bucketize", "bucket_perturb", "top_code", "faker", "categorical", "group_key", "nested",
                        "formula", "derived", "composite"})


def check_declared(df: DataFrame, rules: Sequence[Rule], table: str, unconfigured: str = "error") -> list[str]:
    """Every source column has a rule and every rule a column. Schema only; no job runs. Returns warnings."""
    ruled = [c for r in rules for c in r.columns]
    twice = sorted({c for c in ruled if ruled.count(c) > 1})
    if twice:
        raise InvalidRule(f"{table}: columns with two rules: {', '.join(twice)}")
    made = {c for r in rules if STRATEGIES[r.strategy].late or r.strategy in ("group_key", "formula", "grouped_series")
            for c in r.columns}
    absent = sorted(set(ruled) - set(df.columns) - made)
    if absent:
        raise UndeclaredColumn(f"{table}: rules name columns the source lacks: {', '.join(absent)}")
    left = sorted(set(df.columns) - set(ruled))
    if left and unconfigured == "error":
        raise UndeclaredColumn(f"{table}: source columns without a rule: {', '.join(left)}")
    return [f"{table}: column {c} has no rule and is left out" for c in left]


def mask_table(df: DataFrame, rules: Sequence[Rule], secret: bytes, table: str = "t", row_key: Sequence[str] = (),
               unconfigured: str = "error", with_errors: bool = False) -> DataFrame:
    """Mask a table. Output has the ruled columns in source order. ``with_errors`` adds ``__errors``, the rule ids
    that failed on a row, and ``__row``, the source row, for the quarantine split."""
    check_declared(df, rules, table, unconfigured)
    ctx = Context(df.schema, secret, table, row_key)
    by_col = {c: r for r in rules for c in r.columns}
    ordered = [c for c in df.columns if c in by_col] + [c for c in by_col if c not in df.columns]
    work = df
    if with_errors:
        work = work.withColumn("__row", F.struct(*df.columns))
    rules = [_with_threshold(df, r) for r in rules]
    by_col = {c: r for r in rules for c in r.columns}
    for r in rules:
        s = STRATEGIES[r.strategy]
        if s.whole_column and not s.late and r.strategy != "from_parent":
            if r.strategy == "tokenize":
                raise InvalidRule("tokenize needs a vault: use operators.vault.tokenize")
            work = s.apply(work, Context(df.schema, secret, table, row_key) if r.strategy != "code_set" else ctx, r)
    groups = {r.columns: composite(ctx, r) for r in rules if STRATEGIES[r.strategy].group}
    out: dict[str, Column] = {}
    for name in ordered:
        r = by_col[name]
        s = STRATEGIES[r.strategy]
        c = F.col(name) if name in df.columns else F.lit(None)
        if s.late:
            continue
        if s.group:
            e = groups[r.columns][name]
        elif s.whole_column:
            e = F.col(_out(name)) if r.strategy != "from_parent" else c
        else:
            e = s.apply(ctx, r, c)
        if r.when is not None:
            e = F.when(F.coalesce(r.when, F.lit(False)), e.cast("string") if r.strategy in ("hash", "redact") else e).otherwise(
                c.cast("string") if r.strategy in ("hash", "redact") else c)
        if r.cast:
            e = e.try_cast(r.cast)
        out[name] = e
    errors = F.filter(F.array(*[F.when(bad, F.lit(f"format_error:{col}")) for col, bad in ctx.format_errors.items()]
                              or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    extra = [errors.alias("__errors"), F.col("__row")] if with_errors else []
    staged = work.select("*", *[e.alias(n) for n, e in ctx.staged.items()]) if ctx.staged else work
    masked = staged.select(*[e.alias(n) for n, e in out.items()], *extra)
    late = [r for r in rules if STRATEGIES[r.strategy].late]
    once = _aggregates(masked, late)
    for r in late:
        if r.strategy == "derived":
            e = r.options["expression"]
            if "bounds" in r.options:
                lo, hi = r.options["bounds"]
                e = F.when(e.between(lo, hi), e)
            if r.options.get("null_propagation") is False:
                e = F.coalesce(e, F.lit(r.options.get("default", 0)))
            masked = masked.withColumn(r.column, e)
        else:
            masked = masked.withColumn(r.column, once[r.options["op"], r.options["of"]] if (r.options["op"], r.options["of"]) in once
                                       else table_scalar(masked, r.options["op"], r.options["of"]))
    return masked.select(*ordered, *(["__errors", "__row"] if with_errors else []))


def _aggregates(masked: DataFrame, late: Sequence[Rule]) -> dict[tuple[str, str], Column]:
    """The table-wide aggregates over columns that are masked already, all from one pass: one row with a field for each, as one scalar
    subquery. An aggregate of a column that is itself worked out late is not among them."""
    made = {c for r in late for c in r.columns}
    asked = list(dict.fromkeys((r.options["op"], r.options["of"]) for r in late if r.strategy == "derived_aggregate" and r.options["of"] not in made))
    if not asked:
        return {}
    for op, _ in asked:
        if op not in AGGREGATES:
            raise InvalidRule(f"unknown aggregate {op!r}")
    row = masked.agg(F.struct(*[AGGREGATES[op](of).alias(f"a{i}") for i, (op, of) in enumerate(asked)]).alias("all")).scalar()
    return {key: row[f"a{i}"] for i, key in enumerate(asked)}


def _with_threshold(df: DataFrame, r: Rule) -> Rule:
    """top_code by quantile: the threshold is the exact quantile of the column."""
    if r.strategy != "top_code" or "quantile" not in r.options:
        return r
    q = exact_quantiles(df, [r.column], [float(r.options["quantile"])]).first()
    return replace(r, options={**r.options, "threshold": q["q0"] if q else 0})


AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def table_scalar(df: DataFrame, op: str, column: str) -> Column:
    """A table-wide aggregate as a scalar subquery: one extra aggregate, no join."""
    if op not in AGGREGATES:
        raise InvalidRule(f"unknown aggregate {op!r}")
    return df.select(AGGREGATES[op](column)).scalar()


def unmask_fpe(df: DataFrame, rules: Sequence[Rule], secret: bytes, table: str = "t") -> DataFrame:
    """Reverse the fpe columns; a wrong secret gives plausible wrong values, not an error."""
    ctx = Context(df.schema, secret, table)
    by_col = {r.column: r for r in rules if r.strategy == "fpe"}
    return df.select(*[fpe_(ctx, by_col[c], F.col(c), inverse=True).alias(c) if c in by_col else F.col(c)
                       for c in df.columns])


# fixed values: what can be told about a column's reversal from its strategy alone
REVERSAL = {"fpe": "reversed_unverified", "tokenize": "vault_reversed", "passthrough": "untouched"}


def unmask_status(rules: Sequence[Rule]) -> dict[str, str]:
    return {c: ("vault_reversed" if r.vault else REVERSAL.get(r.strategy, "irreversible")) for r in rules for c in r.columns}
