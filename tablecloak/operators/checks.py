"""Validators, quarantine and integrity checks over a masked table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRule
from ..functions import checksums, dates
from ..functions.detectors import BY_ID
from ..keys import check_secret, subkey
from ..session import materialize, spread
from .fit import stack, union_all
from .joins import counted_join, lookup_join
from .masks import STRATEGIES, Context, Rule, _with_threshold, shift_bounds
from .relations import Link, orphan_keys
from .text import find_entities

TRIGGERS = ("validation_fail", "format_error", "mask_error")


@dataclass(frozen=True)
class Check:
    """A row check: true means the cell is fine; a null cell is fine."""

    id: str
    column: str
    ok: Column


def check(kind: str, column: str, **o: object) -> Check:
    c = F.col(column)
    if kind in checksums.VALIDATORS:
        ok = checksums.VALIDATORS[kind](c.cast("string"))
    elif kind == "regex_match":
        ok = c.cast("string").rlike(str(o["pattern"]))
    elif kind == "column_in_set":
        ok = c.isin(list(o["values"]))
    else:
        raise InvalidRule(f"unknown check {kind!r}")
    return Check(f"{kind}:{column}", column, F.coalesce(ok, F.lit(True)))


def failures(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check, checked, failed), one pass for all."""
    cells = F.array(*[F.struct(F.lit(k.id).alias("check"), F.count(F.col(k.column)).alias("checked"), F.count_if(~k.ok).alias("failed")) for k in checks])
    return df.agg(cells.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def _paired(source: DataFrame, output: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every row of either side beside its partner, as structs ``s`` and ``o``; a null in the key is a key like any other, and
    a side without the row is null. A key that repeats would pair rows at random, so it is refused."""
    for side, frame in (("source", source), ("output", output)):
        if not frame.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise InvalidRule(f"the key does not tell the rows of the {side} apart")
    s, o = (f.select(F.struct(*f.columns).alias(n)) for f, n in ((source, "s"), (output, "o")))
    same = F.lit(True)
    for k in on:
        same = same & F.col("s")[k].eqNullSafe(F.col("o")[k])
    return s.join(o, same, "full_outer")


def _unpaired() -> Column:
    return F.count_if(F.col("s").isNull() | F.col("o").isNull())


def leak_check(source: DataFrame, output: DataFrame, on: Sequence[str], columns: Sequence[str], max_identical_ratio: float = 0.0,
               min_rows: int = 1) -> DataFrame:
    """(column, rows, identical, lost, ratio, ok): the share of non-null cells that come out as they went in. ``lost`` rows, in
    one side only, are never ok."""
    both = _paired(source.select(*dict.fromkeys([*on, *columns])), output.select(*dict.fromkeys([*on, *columns])), on)
    same = lambda c: F.col("s")[c].cast("string") == F.col("o")[c].cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.col("s")[c]).alias("rows"), F.count_if(same(c)).alias("identical"), _unpaired().alias("lost")) for c in columns])
    r = both.agg(cells.alias("r")).select(F.explode("r").alias("r")).select("r.*")
    ratio = F.when(F.col("rows") > 0, F.col("identical") / F.col("rows")).otherwise(0.0)
    return r.withColumn("ratio", ratio).withColumn("ok", (F.col("lost") == 0) & ((F.col("ratio") <= max_identical_ratio) | (F.col("rows") < min_rows)))


def value_leaks(source: DataFrame, output: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, leaked): output cells equal to any source cell of the column."""
    parts = []
    for c in columns:
        known = source.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct()
        cells = output.select(F.col(c).cast("string").alias("v")).where("v is not null")
        parts.append(counted_join(cells, known, ["v"], "left_semi").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("leaked")).select(F.lit(c).alias("column"), "leaked"))
    return union_all(parts)


def fk_intact(parent: DataFrame, child: DataFrame, link: Link) -> DataFrame:
    """(edge, orphans, ok)"""
    return orphan_keys(parent, child, link).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("orphans")).select(
        F.lit(f"{link.parent}->{link.child}").alias("edge"), "orphans", (F.col("orphans") == 0).alias("ok"))


def fk_preserved(link: Link, src_parent: DataFrame, src_child: DataFrame, out_parent: DataFrame, out_child: DataFrame,
                 on: Sequence[str]) -> DataFrame:
    """(edge, lost, gained, missing, ok): children that joined in the source and no longer do, and the other way round, row by
    row over the child key ``on``; ``missing`` children are in one side only. Under remap and fail no output child may be an
    orphan."""
    def joins(parent: DataFrame, child: DataFrame, name: str) -> DataFrame:
        complete = F.lit(True)
        for c in link.child_columns:
            complete = complete & F.col(c).isNotNull()
        keys = parent.select(*[F.col(p).alias(c) for p, c in zip(link.parent_columns, link.child_columns)], F.lit(True).alias("__hit")).distinct()
        hit = lookup_join(child.select(*dict.fromkeys([*on, *link.child_columns])), keys, link.child_columns)
        return hit.select(*on, F.when(complete, F.coalesce("__hit", F.lit(False))).alias(name))
    a = joins(src_parent, src_child, "a")
    b = joins(out_parent, out_child, "b")
    j = _paired(a, b, on).select("s.a", "o.b", (F.col("s").isNull() | F.col("o").isNull()).alias("missing"))
    lost, gained = F.count_if(F.col("a") & ~F.col("b")), F.count_if(~F.col("a") & F.col("b"))
    orphans = F.count_if(~F.col("b"))
    ok = (F.col("lost") + F.col("gained") == 0) if link.orphans in ("preserve", "warn") else F.col("orphans") == 0
    return j.agg(lost.alias("lost"), gained.alias("gained"), orphans.alias("orphans"), F.count_if("missing").alias("missing")).select(
        F.lit(f"{link.parent}->{link.child}").alias("edge"), "lost", "gained", "missing", (ok & (F.col("missing") == 0)).alias("ok"))


SWAP_ROWS = 20  # fixed value: with fewer cells a swap cannot be told from chance
CHECKED = frozenset({"hash", "redact", "tokenize", "faker", "fpe", "date_shift", "truncate", "bucketize", "passthrough", "categorical", "shuffle", "unique_faker",
                     "top_code", "text_redact", "bucket_perturb", "windowed_date", "text_mask", "geo_generalize", "code_set", "joint_mask"})


def own_values(source: DataFrame, output: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, cells, own): cells of the source that are not null, and how many output cells can be matched with equal ones of
    the source, each with one: the overlap of the two multisets, counted value by value."""
    def side(df: DataFrame, a: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        return df.select(cells.alias("cells"), F.lit(a).alias("a"))

    # dealt out first: what a task counts before the shuffle follows from the rows, not from how files are cut; one count for both
    # sides needs no join of them
    rows = spread(side(source, 1).unionAll(side(output, 0))).select(F.explode("cells").alias("s"), "a").select("s.*", "a").where("value is not null")
    both = rows.groupBy("column", "value").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b"))
    return both.groupBy("column").agg(F.sum("a").alias("cells"), F.sum(F.least("a", "b")).alias("own")).where("cells > 0")


def _writable(df: DataFrame) -> DataFrame:
    """Columns of kinds that no file can hold become text."""
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() in ("void", "interval") else F.col(f"`{f.name}`") for f in df.schema])


def _shared_outputs(both: DataFrame, column: str) -> DataFrame:
    """(column, more): output values that stand for more than one input value."""
    pairs = both.select(F.col("s")[column].alias("a"), F.col("o")[column].alias("b")).dropna().distinct()
    return pairs.groupBy("b").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("more")).select(
        F.lit(column).alias("column"), "more")


def _strangers(output: DataFrame, rule: Rule, source: DataFrame) -> DataFrame:
    """(column, more): outputs of a code set that are no code, or of a joint mask that no donor has."""
    if rule.strategy == "code_set":
        known, on = rule.options["codes"].select(F.col("code").cast("string").alias("__0")).distinct(), ["__0"]
        cells = output.select(F.col(rule.columns[0]).cast("string").alias("__0"))
    else:
        donors = rule.options.get("donors")
        on = [f"__{i}" for i in range(len(rule.columns))]
        known = (source if donors is None else donors).select(*[F.col(c).alias(n) for c, n in zip(rule.columns, on)]).dropna().distinct()
        cells = output.select(*[F.col(c).alias(n) for c, n in zip(rule.columns, on)])
    lost = counted_join(cells.dropna(), known, on, "left_anti").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("more"))
    return lost.select(F.lit(rule.columns[0]).alias("column"), "more")


def check_policy(source: DataFrame, output: DataFrame, rules: Sequence[Rule], on: Sequence[str], unchecked: Sequence[str] = ()) -> DataFrame:
    """(column, strategy, broken): does each column's output obey what its strategy promises?

    hash, redact, tokenize, faker: null stays null, nothing equals its own input; for the first three no output is an input
    cell of the column. fpe: the same, but its own input may come back on up to a tenth of the rows. fpe and faker: from
    ``SWAP_ROWS`` cells on, a column of which nine tenths are its own input values, wherever they stand, is broken in those cells.
    shuffle: exactly the input values. unique_faker: nothing equals its own input, no two inputs share an output. date_shift:
    moved by 1 to the rule's bound in the rule's format, kept days kept, what is no date gone. truncate, bucketize, top_code,
    text_redact, passthrough: exactly what the rule gives. bucket_perturb: still in the input's bucket. windowed_date: inside its
    anchor's window. text_mask: no entity survives that the rule does not let pass. geo_generalize: a part of the input's zip code,
    a state or nothing. code_set: a code of the set. joint_mask: a combination of the donors. categorical: inside the
    closed set. Other strategies have no rule that can be checked without their secret or inputs: naming one is refused
    unless its column is in ``unchecked``. The row ``*`` counts rows that are in one side only.
    """
    cols = [(r, c) for r in rules for c in r.columns if c not in on and c not in unchecked and c in source.columns and c in output.columns]
    blind = sorted({r.strategy for r, _ in cols} - CHECKED)
    if blind:
        raise InvalidRule(f"no policy check for the strategies {', '.join(blind)}; name their columns as unchecked")
    anchors = [r.options["anchor"] for r, _ in cols if r.strategy == "windowed_date"]
    names = list(dict.fromkeys([*on, *[c for _, c in cols]]))
    beside = list(dict.fromkeys([*names, *anchors]))
    # written once: the output is worked out once, whatever it takes, and every check below reads it from there
    both = materialize(_paired(_writable(source.select(*beside)), _writable(output.select(*names)), on), "paired")
    sides = [both.where(F.col(x).isNotNull()).select(f"{x}.*") for x in ("s", "o")]
    cells = [F.struct(F.lit("*").alias("column"), F.lit("rows").alias("strategy"), _unpaired().alias("broken"))]
    paired = F.col("s").isNotNull() & F.col("o").isNotNull()
    ctx = Context(source.schema, b"\0" * 32, "check", stage=False)
    for r, c in cols:
        s, o = F.col("s")[c], F.col("o")[c]
        null_bad = s.isNull() != o.isNull()
        same = s.cast("string") == o.cast("string")
        if r.strategy in ("hash", "redact", "tokenize", "faker", "unique_faker"):
            bad = null_bad | same
        elif r.strategy in ("fpe", "shuffle", "code_set", "joint_mask"):
            bad = null_bad
        elif r.strategy == "bucket_perturb":
            bad = null_bad | _left_bucket(r, source.schema[c].dataType.typeName(), output.schema[c].dataType.typeName(), s, o)
        elif r.strategy == "windowed_date":
            gap = F.datediff(o.cast("date"), F.col("s")[r.options["anchor"]].cast("date"))
            bad = null_bad | ~gap.between(int(r.options.get("min_days", 0)), int(r.options["max_days"]))
        elif r.strategy == "text_mask":
            hidden = [d for d, how in r.options["detectors"].items() if how != "passthrough"]
            bad = null_bad | F.exists(find_entities(s, hidden), lambda e: F.contains(F.lower(o), F.lower(e["span"])))  # noqa: B023
        elif r.strategy == "geo_generalize":
            code = F.regexp_extract(s.cast("string"), r"^\s*([0-9]{5})", 1)
            bad = (s.isNull() & o.isNotNull()) | (o.rlike("^[0-9]") & ~F.startswith(code, o))
        elif r.strategy == "date_shift":
            lo, hi = shift_bounds(r.options)
            day = lambda x, f: dates.parse(x, r.options.get("date_format"), f.schema[c].dataType.typeName()).cast("date")  # noqa: B023, E731
            was, now = day(s, source), day(o, output)
            gap = F.datediff(now, was)
            kept = was.isin([dt.date.fromisoformat(str(v)) for v in r.options.get("preserve_values") or ()] or [None])
            bad = F.when(was.isNull(), o.isNotNull()).when(kept, ~same).otherwise(now.isNull() | (gap == 0) | (gap < lo) | (gap > hi))
        elif r.strategy in ("truncate", "bucketize", "passthrough", "top_code", "text_redact"):
            r = _with_threshold(source, r)
            bad = ~o.cast("string").eqNullSafe(STRATEGIES[r.strategy].apply(ctx, r, s).cast("string"))
        else:  # categorical
            bad = ~F.coalesce(o.isin(list(r.options["categories"])), s.isNull())
        broken = F.count_if(paired & F.coalesce(bad, F.lit(False)))
        if r.strategy == "fpe":
            again = F.count_if(paired & F.coalesce(same, F.lit(False)))
            broken = broken + F.when(again * 10 > F.count_if(paired & s.isNotNull()), again).otherwise(0)
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(r.strategy).alias("strategy"), broken.alias("broken")))
    rows = both.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    exact = [c for r, c in cols if r.strategy in ("hash", "redact", "tokenize")]
    if exact:
        rows = rows.join(F.broadcast(value_leaks(*sides, exact)), "column", "left").withColumn(
            "broken", F.col("broken") + F.coalesce("leaked", F.lit(0))).drop("leaked")
    more = [_shared_outputs(both, c) for r, c in cols if r.strategy == "unique_faker"]
    more += [_strangers(output, r, source) for r in {id(r): r for r, _ in cols if r.strategy in ("code_set", "joint_mask")}.values()]
    swapped = {c: r.strategy for r, c in cols if r.strategy in ("fpe", "faker", "shuffle")}
    if swapped:
        kept = F.col("column").isin([c for c, k in swapped.items() if k == "shuffle"] or [None])
        many = (F.col("cells") >= SWAP_ROWS) & (F.col("own") * 10 >= F.col("cells") * 9)
        found = own_values(*sides, list(swapped))
        more.append(found.select("column", F.when(kept, F.col("cells") - F.col("own")).when(many, F.col("own")).otherwise(0).alias("more")))
    if more:
        # a row for each checked column
        rows = rows.join(F.broadcast(union_all(more)), "column", "left").withColumn("broken", F.col("broken") + F.coalesce("more", F.lit(0))).drop("more")
    return rows


def _left_bucket(r: Rule, was: str, now: str, s: Column, o: Column) -> Column:
    """Is the output outside the bucket of its input?"""
    if "bucket_days" in r.options:
        fmt, size = r.options.get("date_format"), int(r.options["bucket_days"])
        day = lambda x, kind: F.datediff(dates.parse(x, fmt, kind).cast("date"), F.lit(dt.date(1970, 1, 1)))
        kept = dates.parse(s, fmt, was).cast("date").isin([dt.date.fromisoformat(str(v)) for v in r.options.get("preserve_values") or ()] or [None])
        return F.when(kept, s.cast("string") != o.cast("string")).otherwise(F.floor(day(s, was) / size) != F.floor(day(o, now) / size))
    width = float(r.options["width"])
    return F.floor(s.try_cast("double") / width) != F.floor(o.try_cast("double") / width)


def residual_pii(source: DataFrame, output: DataFrame, shaped: Mapping[str, str] | None = None) -> DataFrame:
    """(column, detector, source_rate, output_rate, severity): what detectors still see. ``shaped`` names the columns
    masked to a shape a detector knows (column -> detector), which is expected and left out."""
    from .scan import detect
    a = detect(source).select("column", "detector", F.col("match_rate").alias("source_rate"))
    b = detect(output).select("column", "detector", F.col("match_rate").alias("output_rate"))
    j = b.join(a, ["column", "detector"], "left").na.fill(0.0, ["source_rate"])
    for c, d in (shaped or {}).items():
        j = j.where(~((F.col("column") == c) & (F.col("detector") == d)))
    sev = F.when((F.col("output_rate") >= 0.5) & (F.col("source_rate") >= 0.5), "high").when(F.col("output_rate") >= 0.1, "medium").otherwise("low")
    return j.withColumn("severity", sev)


def detector_of_provider(provider: str) -> str | None:
    return next((d.id for d in BY_ID.values() if d.provider == provider), None)


def quarantine(masked: DataFrame, checks: Sequence[Check] = (), triggers: Sequence[str] = TRIGGERS) -> tuple[DataFrame, DataFrame]:
    """Split a frame from ``mask_table(..., with_errors=True)``: clean rows, and (row, reasons) of the failed ones.
    Input rows = clean + quarantined."""
    unknown = sorted(set(triggers) - set(TRIGGERS))
    if unknown:
        raise InvalidRule(f"unknown quarantine triggers: {', '.join(unknown)}")
    reasons = F.filter(F.col("__errors"), lambda e: F.split(e, ":")[0].isin(*triggers))
    if "validation_fail" in triggers and checks:
        failed = F.filter(F.array(*[F.when(~k.ok, F.lit(f"validation_fail:{k.id}")) for k in checks]), lambda e: e.isNotNull())
        reasons = F.concat(reasons, failed)
    marked = masked.withColumn("__reasons", reasons)
    clean = marked.where(F.size("__reasons") == 0).drop("__reasons", "__errors", "__row")
    bad = marked.where(F.size("__reasons") > 0).select(F.col("__row").alias("row"), F.col("__reasons").alias("reasons"))
    return clean, bad


def write_quarantine(bad: DataFrame, path: str, secret: bytes | None = None, max_rows: int | None = None, max_bytes: int | None = None) -> None:
    """JSON lines of unmasked rows. With a secret each row is sealed with AES-GCM. Caps refuse, they never drop."""
    text = bad.select(F.to_json("row").alias("row"), "reasons")
    if max_rows is not None or max_bytes is not None:
        size = text.agg(F.count("*").alias("n"), F.sum(F.octet_length("row")).alias("b")).first()
        if (max_rows is not None and size["n"] > max_rows) or (max_bytes is not None and (size["b"] or 0) > max_bytes):
            raise InvalidRule("the quarantine is larger than its cap")
    if secret is not None:
        key = F.lit(subkey(check_secret(secret), "quarantine"))
        text = text.select(F.base64(F.aes_encrypt("row", key, F.lit("GCM"))).alias("sealed"), "reasons")
    text.write.mode("errorifexists").json(path)
