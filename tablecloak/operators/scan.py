"""Value-free profiles: counts, rates, labels and detector ids per column, and re-identification risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DriftRefused, InvalidRule
from ..functions import dates
from ..functions.detectors import DETECTORS, cell_hit
from ..keys import hmac_hex, row_message, seed_key, subkey
from ..session import materialize
from .evidence import content_hash
from .fit import stack, union_all
from .ordering import first_rows
from .singles import Singles
from .text import count_entities, find_entities

SAMPLE = 10_000
# Score buckets and the confident match rate.
HIGH, MED, CONFIDENT, CLOSE = 0.6, 0.3, 0.5, 0.1
# Weight of a detector in the score (D): structured ids count in full, shapes that ordinary data shares count less.
WEIGHTS = {"person_name": 0.6, "iso_date": 0.5, "us_date": 0.5, "eu_date": 0.5, "us_zip": 0.5, "address_street": 0.8,
           "address_city": 0.6, "ndc": 0.6, "icd10": 0.6, "cvv": 0.2, "url": 0.4}
# Sentinel literals looked for in every column.
SENTINELS = ("999", "9999", "99999", "-1", "-999", "99/99/9999", "9999-12-31", "1900-01-01", "NA", "N/A", "NULL", "null",
             "None", "none", "nan", "NaN", "-", "?", "unknown", "UNKNOWN")
# Cell shapes told apart from text alone, most specific first.
TYPE_SHAPES = (("bool", r"^(true|false|TRUE|FALSE|True|False)$"), ("integer", r"^[+-]?[0-9]+$"),
               ("number", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"),
               ("date", r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"))
MAX_SET = 3
SETS_AT_ONCE = 64   # grouping sets of one job
# Formats a date column is read in, the first that most cells fit (D).
DATE_FORMATS = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y%m%d")


def text_cell(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("string")


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column: rows, nulls, distinct, range of numbers, lengths of text. One pass, and a
    shuffle of the distinct values for their exact number; without ``exact`` that is a sketch."""
    cols = list(columns or scalar_columns(df))
    out = []
    for c in cols:
        num = isinstance(df.schema[c].dataType, T.NumericType)
        x, s = F.col(c), text_cell(df, c)
        null = F.lit(None).cast("double")
        out.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(x.isNull()).alias("nulls"),
            F.approx_count_distinct(x).alias("distinct_approx"),
            (F.min(x.cast("double")) if num else null).alias("min"), (F.max(x.cast("double")) if num else null).alias("max"),
            (F.avg(x.cast("double")) if num else null).alias("mean"),
            F.min(F.length(s)).alias("min_length"), F.max(F.length(s)).alias("max_length"), F.avg(F.length(s)).alias("mean_length")))
    base = df.agg(F.array(*out).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    if exact:
        counts = stack(df, cols, "string").where("value is not null").distinct().groupBy("column").agg(F.count("*").alias("distinct"))
        base = base.join(F.broadcast(counts), "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    else:
        base = base.withColumn("distinct", F.col("distinct_approx"))
    filled = F.col("rows") - F.col("nulls")
    return base.drop("distinct_approx").withColumn("null_rate", F.col("nulls") / F.col("rows")).withColumn(
        "unique_rate", F.when(filled > 0, F.col("distinct") / filled))


def top_values(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """(column, value, n, rank); rank 1 is the mode. For a report that is allowed to show values."""
    counts = stack(df, columns, "string").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, inferred_type): the most specific shape that fits every non-blank text cell."""
    cols = list(columns or scalar_columns(df))
    s = F.when(F.col("value") != "", F.col("value"))
    filled = F.count(s)
    label = F.when(filled == 0, F.lit("empty"))
    for name, pattern in TYPE_SHAPES:
        label = label.when(F.count_if(s.rlike(pattern)) == filled, F.lit(name))
    return stack(df, cols, "string").groupBy("column").agg(label.otherwise(F.lit("string")).alias("inferred_type"))


def detect(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, detector, hits, filled, match_rate, confidence) for every detector with a hit. One pass: cells are
    stacked as (column, value), so the plan does not grow with the width of the table."""
    cols = list(columns or scalar_columns(df))
    s = F.col("value")
    hits = F.array(*[F.struct(F.lit(d.id).alias("detector"), F.count_if(F.coalesce(cell_hit(d, s), F.lit(False))).alias("hits")) for d in DETECTORS])
    counted = stack(df.select(*cols), cols, "string").where("value is not null").groupBy("column").agg(F.count("*").alias("filled"), hits.alias("h"))
    flat = counted.select("column", "filled", F.explode("h").alias("h")).select("column", "h.detector", "h.hits", "filled").where("hits > 0")
    rate = F.col("hits") / F.col("filled")
    return flat.withColumn("match_rate", rate).withColumn(
        "confidence", F.when(rate >= 0.8, "high").when(rate >= CONFIDENT, "medium").otherwise("low"))


def weight_of(detector: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, detector), F.lit(1.0))


def bucket(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MED, "med").when(score > 0, "low").otherwise("none")


def pii_scores(detected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, detector, pii_score, pii_bucket): the best weighted match rate (D); 0 without a hit."""
    spark = detected.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    scored = detected.withColumn("score", F.col("match_rate") * weight_of(F.col("detector")))
    best = scored.groupBy("column").agg(F.max(F.struct("score", "detector")).alias("b"))
    s = F.coalesce(F.col("b.score"), F.lit(0.0))
    return names.join(best, "column", "left").select("column", F.col("b.detector").alias("detector"), s.alias("pii_score"), bucket(s).alias("pii_bucket"))


def sentinels(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, sentinel, n)"""
    cols = list(columns or scalar_columns(df))
    long = stack(df, cols, "string").where(F.col("value").isin(*SENTINELS))
    return long.groupBy("column", F.col("value").alias("sentinel")).agg(F.count("*").alias("n"))


def key_candidates(df: DataFrame, columns: Sequence[str] | None = None, sampled: bool = False) -> DataFrame:
    """Columns without nulls and with as many values as rows, over all rows; a sample lists none."""
    cols = list(columns or scalar_columns(df))
    if sampled:
        return df.sparkSession.createDataFrame([], "column string")
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(cols)]).first()
    maybe = [c for i, c in enumerate(cols) if nulls[f"z{i}"] == 0]
    if not maybe:
        return df.sparkSession.createDataFrame([], "column string")
    per = stack(df, maybe, "string").groupBy("column", "value").agg(F.count("*").alias("n"))
    return per.groupBy("column").agg(F.max("n").alias("m")).where("m = 1").select("column")


def class_sizes(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    return df.groupBy(*qi).agg(F.count("*").alias("size"))


def k_anonymity(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    """(k, classes, rows, singletons): k is the smallest class."""
    return class_sizes(df, qi).agg(F.min("size").alias("k"), F.count("*").alias("classes"), F.sum("size").alias("rows"),
                                   F.count_if(F.col("size") == 1).alias("singletons"))


def reid_risk(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    """(reid_risk, k): 0 to 100, the mean over rows of 1 / class size (prosecutor average, D)."""
    return k_anonymity(df, qi).select((F.lit(100.0) * F.col("classes") / F.col("rows")).alias("reid_risk"), "k")


def qi_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """All columns with at least two values and at most a tenth as many as rows, most values first, counted exactly."""
    cols = list(columns or scalar_columns(df))
    counts = stack(df, cols, "string").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    total = df.count()
    d = counts.groupBy("column").agg(F.count("*").alias("d")).where((F.col("d") >= 2) & (F.col("d") <= 0.1 * total))
    return [r["column"] for r in sorted(d.collect(), key=lambda r: (-r["d"], r["column"]))]


def quasi_identifiers(df: DataFrame, candidates: Sequence[str] | None = None, max_set: int = MAX_SET) -> DataFrame:
    """(columns, k, classes, rows, singleton_share) for every set of 2 to ``max_set`` candidates.

    Rows are counted once per full combination with map-side combine; all sets are then grouped over those counts, many at once.
    """
    cand = list(candidates or qi_candidates(df))
    if len(cand) < 2:
        raise InvalidRule("fewer than two quasi-identifier candidates")
    base = df.groupBy(*cand).agg(F.count("*").alias("__n"))
    sets = [list(s) for size in range(2, max_set + 1) for s in combinations(sorted(cand), size)]
    if len(sets) > SETS_AT_ONCE:
        base = materialize(base, "combinations")
    parts = []
    for a in range(0, len(sets), SETS_AT_ONCE):
        part = sets[a:a + SETS_AT_ONCE]
        label = F.element_at(F.array(*[F.lit(",".join(s)) for s in part]), F.col("at") + 1)
        parts.append(set_sizes(base, part).select(label.alias("columns"), "k", "classes", "rows", "singleton_share"))
    return union_all(parts)


def identifying_sets(df: DataFrame, candidates: Sequence[str] | None = None, min_singletons: float = 0.05, max_set: int = MAX_SET) -> list[tuple[str, ...]]:
    """The smallest sets of candidates that single out at least this share of rows (D), level by level: a set that holds one
    already found is not grouped again, so many candidates do not mean every combination of them."""
    cand = sorted(candidates or qi_candidates(df))
    base = materialize(df.groupBy(*cand).agg(F.count("*").alias("__n")), "combinations")
    found: list[tuple[str, ...]] = []
    for size in range(1, max_set + 1):
        level = [s for s in combinations(cand, size) if not any(set(f) <= set(s) for f in found)]
        for a in range(0, len(level), SETS_AT_ONCE):
            part = level[a:a + SETS_AT_ONCE]
            found += [part[i] for i, share in sorted(singleton_shares(base, part).items()) if share >= min_singletons]
    return sorted(found, key=lambda s: (len(s), s))


def minimal_identifying_sets(df: DataFrame, candidates: Sequence[str] | None = None, min_singletons: float = 1.0) -> list[tuple[str, ...]]:
    """All minimal sets of candidate columns that single out at least this share of rows; 1 asks for unique sets. Of any size.

    More columns never single out fewer rows, so sets that do lie above a border and those that do not lie below it. Every
    set above must hold a column outside each largest set below: the smallest ways to do so are tried next. One that fails is
    widened column by column to a largest set below; when none fails, those tried are all the minimal sets. Sets inside a known
    set below, or around a known one above, are never counted, and neither are those whose columns have too few values. The rows are
    counted once per full combination and dealt out once into blocks (``singles``); a trial counts in the blocks, many sets in one
    job. Sets that no block holds the classes of are grouped. The sets themselves are all the driver holds.
    """
    cand = sorted(candidates or qi_candidates(df))
    base = materialize(df.groupBy(*cand).agg(F.count("*").alias("__n")), "combinations")
    counts = Singles(base, cand)
    known: dict[frozenset[str], bool] = {}

    def above(sets: Sequence[frozenset[str]]) -> list[bool]:
        todo = [s for s in dict.fromkeys(sets) if s not in known]
        yes, no = [s for s, v in known.items() if v], [s for s, v in known.items() if not v]
        for s in todo:
            if any(y <= s for y in yes) or any(s <= n for n in no):
                known[s] = any(y <= s for y in yes)
        known.update({s: False for s in todo if s not in known and counts.at_most(sorted(s)) < min_singletons})
        todo = [s for s in todo if s not in known]
        for a in range(0, len(todo), SETS_AT_ONCE):
            part = [sorted(s) for s in todo[a:a + SETS_AT_ONCE]]
            shares = dict(enumerate(counts.shares(part)))
            left = [i for i, share in shares.items() if share is None]
            if left:
                grouped = singleton_shares(base, [part[i] for i in left])
                shares.update({i: grouped.get(j, 1.0) for j, i in enumerate(left)})
            known.update({frozenset(part[i]): share >= min_singletons for i, share in shares.items()})
        return [known[s] for s in sets]

    whole = frozenset(cand)
    if not above([whole])[0]:
        return []
    below: list[frozenset[str]] = []
    while True:
        tried = _smallest_hits([whole - b for b in below])
        failed = [s for s, ok in zip(tried, above(tried)) if not ok]
        if not failed:
            return sorted((tuple(sorted(s)) for s in tried), key=lambda s: (len(s), s))
        # all that failed are widened side by side, one column a step
        for c in cand:
            wider = [s | {c} for s in failed]
            failed = [s if ok else w for s, w, ok in zip(failed, wider, above(wider))]
        below += [s for s in dict.fromkeys(failed) if s not in below]


def _smallest_hits(sets: Sequence[frozenset[str]]) -> list[frozenset[str]]:
    """The minimal sets that share a member with each of ``sets``."""
    hits: list[frozenset[str]] = [frozenset()]
    for s in sets:
        fine, short = [h for h in hits if h & s], [h for h in hits if not h & s]
        wider = {h | {c} for h in short for c in s}
        hits = fine + [w for w in wider if not any(f <= w for f in fine) and not any(o < w for o in wider)]
    return sorted(hits, key=lambda s: (len(s), sorted(s)))


def set_sizes(base: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(at, k, classes, rows, singleton_share) of each set of columns, by its place. ``base`` has a row count ``__n`` for each
    combination. Any number of columns, with any names; the empty set has one class."""
    # the cells themselves are the key, each in a place of its own: as text they would take most of the time and of the shuffle
    cols = list(dict.fromkeys(c for s in sets for c in s))
    kinds = [f.dataType for f in base.select(*[F.col(f"`{c}`") for c in cols]).schema]
    cell = lambda c, kind, s: F.col(f"`{c}`") if c in s else F.lit(None).cast(kind)
    keys = F.array(*[F.struct(F.lit(i).alias("at"), *[cell(c, kind, s).alias(f"k{j}") for j, (c, kind) in enumerate(zip(cols, kinds))]) for i, s in enumerate(sets)])
    sizes = base.select(F.explode(keys).alias("x"), "__n").groupBy("x.at", *[f"x.k{j}" for j in range(len(cols))]).agg(F.sum("__n").alias("size"))
    return sizes.groupBy("at").agg(F.min("size").alias("k"), F.count("*").alias("classes"), F.sum("size").alias("rows"),
                                   (F.sum(F.when(F.col("size") == 1, 1).otherwise(0)) / F.sum("size")).alias("singleton_share"))


def singleton_shares(base: DataFrame, sets: Sequence[Sequence[str]]) -> dict[int, float]:
    """By place of the set: the share of rows that are alone in their class."""
    return {r["at"]: r["singleton_share"] for r in set_sizes(base, sets).select("at", "singleton_share").collect()}


def profile_fields(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, casing_pattern, alphabet, date_format, date_min, date_max, invalid_count, mode_freq): how the non-blank cells
    are written. casing_pattern: upper, lower, title or mixed, null without letters. alphabet: digits, letters, alphanum or
    mixed. A column is a date in the first format that more than half of its cells fit; the rest of them are invalid. No cell
    value is given away but the ends of a date range."""
    cols = list(columns or scalar_columns(df))
    cells = stack(df, cols, "string").where("value is not null and value <> ''")
    # a repeated value is looked at once
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n")
    cased = F.upper(v) != F.lower(v)
    every = lambda cond: F.count_if(cased & ~cond) == 0
    casing = F.when(F.count_if(cased) == 0, F.lit(None)).when(every(v == F.upper(v)), "upper").when(every(v == F.lower(v)), "lower").when(
        every(v == F.initcap(F.lower(v))), "title").otherwise("mixed")
    fits = lambda pattern: F.count_if(~v.rlike(pattern)) == 0
    alphabet = F.when(fits("^[0-9]+$"), "digits").when(fits("^[A-Za-z]+$"), "letters").when(fits("^[A-Za-z0-9]+$"), "alphanum").otherwise("mixed")
    days = [dates.parse(v, f).cast("date") for f in DATE_FORMATS]
    seen = [x for i, day in enumerate(days) for x in (F.sum(F.when(day.isNotNull(), n).otherwise(0)).alias(f"n{i}"), F.min(day).alias(f"lo{i}"), F.max(day).alias(f"hi{i}"))]
    out = counts.groupBy("column").agg(casing.alias("casing_pattern"), alphabet.alias("alphabet"), F.sum(n).alias("filled"), (F.max(n) / F.sum(n)).alias("mode_freq"), *seen)
    pick = lambda of: F.coalesce(*[F.when(2 * F.col(f"n{i}") > F.col("filled"), of(i, f)) for i, f in enumerate(DATE_FORMATS)])
    return out.select("column", "casing_pattern", "alphabet", pick(lambda i, f: F.lit(f)).alias("date_format"), pick(lambda i, f: F.col(f"lo{i}")).alias("date_min"),
                      pick(lambda i, f: F.col(f"hi{i}")).alias("date_max"), pick(lambda i, f: F.col("filled") - F.col(f"n{i}")).alias("invalid_count"), "mode_freq")


def sample_head(df: DataFrame, order_by: Sequence[str], rows: int = SAMPLE) -> DataFrame:
    return first_rows(df, order_by, rows)


def sample_random(df: DataFrame, row_key: Sequence[str], rows: int = SAMPLE, seed: int = 42) -> DataFrame:
    """The rows with the smallest keyed digest: seeded, and the same whatever the layout."""
    h = hmac_hex(subkey(seed_key(seed), "scan-sample"), row_message(*[F.col(c) for c in row_key]))
    return first_rows(df.withColumn("__h", h), ["__h", *row_key], rows).drop("__h")


def freetext_entities(df: DataFrame, column: str) -> DataFrame:
    """(detector, rows, hits) over a whole text column."""
    counts = count_entities(F.col(column))
    long = df.select(column).select(F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), n.cast("bigint").alias("n")) for d, n in counts.items()])).alias("s")).select("s.*")
    return long.where("n > 0").groupBy("detector").agg(F.count("*").alias("rows"), F.sum("n").alias("hits"))


def entity_spans(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, column).select(key, F.explode(find_entities(F.col(column))).alias("e")).select(key, "e.detector", "e.span")


def scan(df: DataFrame, table: str = "t", columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """The scan set of a table: one row per column, no cell values."""
    cols = list(columns or scalar_columns(df))
    found = materialize(detect(df, cols), "detect")
    matches = found.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("detector", "match_rate", "confidence"))).alias("detector_matches"))
    return (column_stats(df, cols, exact).drop("min", "max", "mean")
            .join(F.broadcast(infer_types(df, cols)), "column").join(F.broadcast(pii_scores(found, cols)), "column")
            .join(F.broadcast(matches), "column", "left").withColumn("table", F.lit(table)))


@dataclass(frozen=True)
class ScanSet:
    """The whole scan of a table: ``columns`` and ``sentinels`` are frames; the rest is one value, or a few names."""

    columns: DataFrame
    sentinels: DataFrame
    keys: tuple[str, ...]
    groups: tuple[tuple[str, ...], ...]
    k_anonymity: int | None
    reid_risk: float | None


def scan_set(df: DataFrame, table: str = "t", columns: Sequence[str] | None = None, candidates: Sequence[str] | None = None,
             min_singletons: float = 0.05) -> ScanSet:
    """Column profiles with how cells are written, sentinels, key candidates, identifying sets, and k and risk over all of the
    sets' columns (D)."""
    cols = list(columns or scalar_columns(df))
    found = scan(df, table, cols).join(F.broadcast(profile_fields(df, cols)), "column", "left")
    keys = tuple(sorted(r["column"] for r in key_candidates(df, cols).collect()))
    near = [c for c in (candidates or qi_candidates(df, cols)) if c not in keys]
    groups = tuple(identifying_sets(df, near, min_singletons)) if near else ()
    members = sorted({c for g in groups for c in g})
    risk = reid_risk(df, members).first() if members else None
    return ScanSet(found, sentinels(df, cols), keys, groups, risk["k"] if risk else None, risk["reid_risk"] if risk else None)


def scan_set_diff(old: ScanSet, new: ScanSet) -> DataFrame:
    """(change, name, old, new): column changes as in ``scan_diff``, quasi-identifier groups and keys added and removed, and the
    change of risk and of k, all as text."""
    rows = [("qi_group_" + what, ",".join(g), None, None) for what, gs in zip(("added", "removed"), qi_diff(old.groups, new.groups)) for g in gs]
    rows += [("key_" + what, c, None, None) for what, cs in (("added", set(new.keys) - set(old.keys)), ("removed", set(old.keys) - set(new.keys))) for c in sorted(cs)]
    if old.reid_risk is not None and new.reid_risk is not None:
        rows.append(("reid_risk_delta", f"{new.reid_risk - old.reid_risk:.6f}", f"{old.reid_risk:.6f}", f"{new.reid_risk:.6f}"))
    if old.k_anonymity != new.k_anonymity:
        rows.append(("k_anonymity", "", *[None if k is None else str(k) for k in (old.k_anonymity, new.k_anonymity)]))
    spark = old.columns.sparkSession
    fields = scan_diff(old.columns, new.columns)
    high = fields.where("change = 'added' AND new_bucket = 'high'").withColumn("change", F.lit("new_high_pii"))
    both = fields.unionByName(high).select("change", F.col("column").alias("name"), F.col("old_bucket").alias("old"), F.col("new_bucket").alias("new"))
    return both.unionByName(spark.createDataFrame(rows, "change string, name string, old string, new string"))


def scan_tables(tables: Mapping[str, DataFrame], exact: bool = True) -> DataFrame:
    """One scan set over several tables."""
    return union_all([scan(df, name, exact=exact) for name, df in tables.items()])


def qi_groups(sets: DataFrame, min_singletons: float = 0.05) -> list[tuple[str, ...]]:
    """The smallest column sets that single out at least this share of rows (D). ``sets`` has a row per column set."""
    found: list[tuple[str, ...]] = []
    for r in sorted(sets.where(F.col("singleton_share") >= min_singletons).collect(), key=lambda r: (r["columns"].count(","), r["columns"])):
        group = tuple(r["columns"].split(","))
        if not any(set(g) <= set(group) for g in found):
            found.append(group)
    return found


def scan_fields(scanned: DataFrame, bucket: str | None = None, groups: Sequence[Sequence[str]] = (), in_group: bool | None = None) -> DataFrame:
    """Rows of a saved profile by score bucket, or by membership of a quasi-identifier group."""
    out = scanned if bucket is None else scanned.where(F.col("pii_bucket") == bucket)
    members = sorted({c for g in groups for c in g})
    if in_group is not None:
        hit = F.col("column").isin(members) if members else F.lit(False)
        out = out.where(hit if in_group else ~hit)
    return out


def scan_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(column, change, old_bucket, new_bucket) between two scans: added, removed, pii_increased, pii_decreased."""
    rank = lambda b: F.element_at(F.create_map(*[F.lit(x) for x in ("none", 0, "low", 1, "med", 2, "high", 3)]), b)
    a = old.select("column", F.col("pii_bucket").alias("old_bucket"))
    b = new.select("column", F.col("pii_bucket").alias("new_bucket"))
    change = (F.when(F.col("old_bucket").isNull(), "added").when(F.col("new_bucket").isNull(), "removed")
              .when(rank(F.col("new_bucket")) > rank(F.col("old_bucket")), "pii_increased")
              .when(rank(F.col("new_bucket")) < rank(F.col("old_bucket")), "pii_decreased"))
    return a.join(b, "column", "full_outer").withColumn("change", change).where("change is not null")


def qi_diff(old: Sequence[Sequence[str]], new: Sequence[Sequence[str]]) -> tuple[list, list]:
    """Quasi-identifier groups added and removed, order-free."""
    a, b = ({tuple(sorted(map(str, g))) for g in gs} for gs in (old, new))
    return sorted(b - a), sorted(a - b)


def has_drift(diff: DataFrame, qi_added: Sequence = ()) -> bool:
    bad = diff.where((F.col("change") == "pii_increased") | ((F.col("change") == "added") & (F.col("new_bucket") == "high")))
    return bool(qi_added) or not bad.isEmpty()


def drift_gate_sets(baseline: ScanSet, current: ScanSet, on_drift: str = "refuse", pinned: str | None = None) -> list[str]:
    """``drift_gate`` over whole scans: quasi-identifier groups that are new, and a higher risk, are drift too."""
    added = qi_diff(baseline.groups, current.groups)[0]
    worse = (current.reid_risk or 0) > (baseline.reid_risk or 0) + 1e-9
    return drift_gate(baseline.columns, current.columns, on_drift, [*added, *(["risk"] if worse else [])], pinned)


def drift_gate(baseline: DataFrame, current: DataFrame, on_drift: str = "refuse", qi_added: Sequence = (),
               pinned: str | None = None) -> list[str]:
    """Refuse, or warn, when the scan drifted from its baseline. ``pinned`` is the content hash the baseline must
    still have."""
    if pinned is not None and content_hash(baseline, ["column", "pii_bucket"]).first()["content_hash"] != pinned:
        raise DriftRefused("the baseline is not the one that was pinned")
    if on_drift not in ("refuse", "warn"):
        raise InvalidRule("on_drift is refuse or warn")
    if not has_drift(scan_diff(baseline, current), qi_added):
        return []
    if on_drift == "refuse":
        raise DriftRefused("the scan drifted from its baseline")
    return ["the scan drifted from its baseline"]


def suggest(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, detector, strategy, provider, ambiguous). The best confident detector decides; two within 0.1 are
    ambiguous; a unique integer without a hit is hashed as a possible key; everything else is redacted. A date is
    shifted only when every hit is a real date."""
    cols = list(columns or scalar_columns(df))
    spark = df.sparkSession
    table = spark.createDataFrame([(d.id, d.strategy, d.provider) for d in DETECTORS], "detector string, strategy string, provider string")
    found = detect(df, cols).where(F.col("match_rate") >= CONFIDENT)
    w = Window.partitionBy("column").orderBy(F.desc("match_rate"), "detector")
    ranked = found.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("match_rate").over(w)).where("r = 1")
    best = ranked.join(F.broadcast(table), "detector").select(
        "column", "detector", "strategy", "provider", F.coalesce(F.col("match_rate") - F.col("next") < CLOSE, F.lit(False)).alias("ambiguous"))
    real = df.agg(*[(F.count_if(F.to_date(F.try_to_timestamp(text_cell(df, c), F.lit("yyyy-MM-dd"))).isNotNull())
                     == F.count_if(text_cell(df, c).rlike(TYPE_SHAPES[3][1]))).alias(f"d{i}") for i, c in enumerate(cols)])
    flags = real.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("real")) for i, c in enumerate(cols)])).alias("s")).select("s.*")
    # a key, like a key candidate, has no nulls and no repeats
    ints = infer_types(df, cols).where("inferred_type = 'integer'").select("column")
    stats = column_stats(df, cols, exact).where((F.col("nulls") == 0) & (F.col("unique_rate") >= (1.0 if exact else 0.95))).select("column")
    keys = ints.join(stats, "column").withColumn("is_key", F.lit(True))
    names = spark.createDataFrame([(c,) for c in cols], "column string")
    j = names.join(best, "column", "left").join(keys, "column", "left").join(flags, "column", "left")
    strategy = (F.when((F.col("strategy") == "date_shift") & ~F.col("real"), "redact").when(F.col("strategy").isNotNull(), F.col("strategy"))
                .when(F.col("is_key"), "hash").otherwise("redact"))
    return j.select("column", "detector", strategy.alias("strategy"), "provider", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


