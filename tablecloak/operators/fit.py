"""Distribution snapshots: what generation needs to know of a table, in a few hundred numbers."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import secrets
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRule, PrivacyBudget
from ..functions import dates, noise
from ..keys import hmac_hex, row_message, seed_key, subkey
from ..session import materialize, together
from .ordering import exact_quantiles, first_rows

# executors need not have this package installed
cloudpickle.register_pickle_by_value(noise)

CATEGORICAL_MAX = 30
TOP_VALUES = CATEGORICAL_MAX  # all values of a categorical column
BUCKETS = 10
JOINT_CELLS = 25
JOINT_CELLS_MAX = 1000
FLOOR_ROWS = 10           # values, years, joint cells and bins under this are dropped
SAMPLE_ROWS = 1_000_000
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


@dataclass
class Snapshot:
    """Column name -> {kind, stats, nulls, rows, format}; plus joints, fan-outs and warnings.

    What may be as large as the data is a frame: ``joint_frames`` (a, b, n) for joints of which every cell is kept, and
    ``released`` (value, n) for the categories of a private release."""

    columns: dict[str, dict] = field(default_factory=dict)
    joints: dict[tuple[str, str], list[tuple]] = field(default_factory=dict)
    joint_frames: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    released: dict[str, DataFrame] = field(default_factory=dict)
    redacted: tuple[str, ...] = ()
    warnings: list[str] = field(default_factory=list)
    epsilon: float | None = None
    delta: float | None = None
    release: str | None = None

    def null_rate(self, column: str) -> float:
        c = self.columns[column]
        return c["nulls"] / c["rows"] if c["rows"] else 0.0


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def column_kinds(df: DataFrame, date_columns: Sequence[str] = ()) -> dict[str, str]:
    """numeric, categorical, datetime or freetext. Text is told apart by how many distinct hashes of 64 bits it has, counted and not
    estimated; only hashes are shuffled, each once a task."""
    kinds, texts = {}, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) or f.name in date_columns:
            kinds[f.name] = "datetime"
        elif isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "numeric"
        elif isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "categorical"
        else:
            texts.append(f.name)
    if texts:
        hashes = df.select(*[F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string"))).alias(c) for c in texts])
        values = stack(hashes, texts, "bigint").where("value is not null").distinct()
        counts = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count("*").alias("n")).collect()}
        for c in texts:
            kinds[c] = "categorical" if counts.get(c, 0) <= CATEGORICAL_MAX else "freetext"
    return {c: kinds[c] for c in df.columns}


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: counts, min, max, mean, std and five exact percentiles."""
    x = F.col("value")
    long = stack(df, columns)
    base = long.groupBy("column").agg(
        F.count("*").alias("rows"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    q = exact_quantiles(df, columns, PERCENTILES)
    return base.join(F.broadcast(q), "column", "left").select(
        "column", "rows", "nulls", "min", "max", "mean", "std", *[F.col(f"q{i}").alias(f"p{round(p * 100)}") for i, p in enumerate(PERCENTILES)])


def stack(df: DataFrame, columns: Sequence[str], cast: str = "double") -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns])).alias("s")).select("s.*")


def numeric_histogram(df: DataFrame, columns: Sequence[str], buckets: int = BUCKETS,
                      bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """(column, bucket, lo, hi, n): equal widths from min to max, the top edge inclusive."""
    long = stack(df, columns).where("value is not null")
    if bounds is None:
        ends = F.broadcast(long.groupBy("column").agg(F.min("value").alias("lo0"), F.max("value").alias("hi0")))
    else:
        ends = F.broadcast(df.sparkSession.createDataFrame([(c, float(a), float(b)) for c, (a, b) in bounds.items()], "column string, lo0 double, hi0 double"))
    x = F.greatest(F.least(F.col("value"), F.col("hi0")), F.col("lo0"))
    width = (F.col("hi0") - F.col("lo0")) / F.lit(float(buckets))
    at = F.when(width > 0, F.least(F.floor((x - F.col("lo0")) / width), F.lit(buckets - 1))).otherwise(0).cast("int")
    counts = long.join(ends, "column").select("column", "lo0", "hi0", at.alias("bucket")).groupBy("column", "lo0", "hi0", "bucket").agg(F.count("*").alias("n"))
    w = (F.col("hi0") - F.col("lo0")) / F.lit(float(buckets))
    return counts.select("column", "bucket", (F.col("lo0") + F.col("bucket") * w).alias("lo"), (F.col("lo0") + (F.col("bucket") + 1) * w).alias("hi"), "n")


def top_values(df: DataFrame, columns: Sequence[str], top: int = TOP_VALUES) -> DataFrame:
    """(column, value, n, is_other): the most common values, ties by value, and one row for the rest.

    Counted with map-side combine; only the counted values are ranked.
    """
    long = stack(df, columns, "string").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    # a rank filter keeps `top` rows per task and column before the shuffle, so no task sees a whole column
    kept = counts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top).drop("__r")
    totals = counts.groupBy("column").agg(F.sum("n").alias("all"))
    other = kept.groupBy("column").agg(F.sum("n").alias("top")).join(F.broadcast(totals), "column").select(
        "column", F.lit(None).cast("string").alias("value"), (F.col("all") - F.col("top")).alias("n"), F.lit(True).alias("is_other"))
    return kept.withColumn("is_other", F.lit(False)).unionByName(other)


def datetime_stats(df: DataFrame, columns: Sequence[str], fmt: str | None = None) -> DataFrame:
    """(column, year, n, earliest, latest)"""
    parsed = df.select(*[dates.parse(F.col(c), fmt or "%Y-%m-%d", df.schema[c].dataType.typeName()).alias(c) for c in columns])
    long = stack(parsed, columns, "timestamp").where("value is not null")
    years = long.groupBy("column", F.year("value").alias("year")).agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
    ends = years.groupBy("column").agg(F.min("a").alias("earliest"), F.max("b").alias("latest"))
    return years.select("column", "year", "n").join(F.broadcast(ends), "column")


def freetext_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, bucket, lo, hi, n) over text lengths, never the text."""
    return numeric_histogram(df.select(*[F.length(c).alias(c) for c in columns]), columns)


def joint_counts(df: DataFrame, a: str, b: str, cells: int | None = JOINT_CELLS) -> DataFrame:
    """(a, b, n): the most common pairs, ties by value; with None every pair, in no order."""
    if cells is not None and not 1 <= cells <= JOINT_CELLS_MAX:
        raise InvalidRule(f"a joint table keeps 1 to {JOINT_CELLS_MAX} cells, or all of them as a frame with None")
    counts = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))
    return counts if cells is None else counts.orderBy(F.desc("n"), "a", "b").limit(cells)


def joint_dropped(df: DataFrame, a: str, b: str, cells: int = JOINT_CELLS) -> int:
    """How many pairs the cap leaves out, for the warning."""
    return max(0, df.select(a, b).dropna().distinct().count() - cells)


def fanout(df: DataFrame, key: Sequence[str], parents: DataFrame | None = None, parent_key: Sequence[str] = ()) -> DataFrame:
    """(children, parents): how many parents have how many children; counts only. With the parent table, parents
    without children count as 0."""
    per = df.select(*key).dropna().groupBy(*key).agg(F.count("*").alias("children"))
    hist = per.groupBy("children").agg(F.count("*").alias("parents"))
    if parents is not None:
        total = parents.select(*parent_key).dropna().distinct().agg(F.count("*")).scalar()
        none = per.agg((total - F.count("*")).alias("parents")).select(F.lit(0).cast("bigint").alias("children"), "parents").where("parents > 0")
        hist = hist.unionByName(none)
    return hist


def cell_formats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, decimals, resolution, blanks): decimals of numbers, the finest part a date column uses."""
    cols = list(columns or df.columns)
    rows = []
    for c in cols:
        f, x = df.schema[c], F.col(c)
        null = F.lit(None)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # digits after the point as the shortest text of the number shows them
            frac = F.regexp_extract(F.format_number(x, 9), r"\.([0-9]*?)0*$", 1)
            dec, res = F.max(F.length(frac)), null.cast("string")
        elif isinstance(f.dataType, T.IntegralType):
            dec, res = F.max(F.when(x.isNotNull(), 0)), null.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            us = F.unix_micros(x.cast("timestamp"))
            worst = F.max(F.when(us % 1_000_000 != 0, 2).when(us % 86_400_000_000 != 0, 1).when(x.isNotNull(), 0))
            dec, res = null.cast("int"), F.element_at(F.array(F.lit("date"), F.lit("second"), F.lit("microsecond")), worst + 1)
        else:
            dec, res = null.cast("int"), null.cast("string")
        blank = x.isNull() | (x == "") if isinstance(f.dataType, T.StringType) else x.isNull()
        rows.append(F.struct(F.lit(c).alias("column"), dec.cast("int").alias("decimals"), res.alias("resolution"), F.count_if(blank).alias("blanks")))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def sample_for_fit(df: DataFrame, row_key: Sequence[str], rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """Seeded random rows, never the first ones: the rows with the smallest keyed digest. Whole table when it fits."""
    total = df.count()
    if total <= rows:
        return df
    h = hmac_hex(subkey(seed_key(seed), "fit-sample"), row_message(*[F.col(c) for c in row_key]))
    # a fixed share a little over the target first, so that few rows are sorted
    share = min(1.0, 1.05 * rows / total + 20 * math.sqrt(rows) / total)
    cut = "%016x" % min(int(share * 2**64), 2**64 - 1)
    staged = df.withColumn("__h", h)
    few = staged if share >= 1.0 else staged.where(F.substring("__h", 1, 16) <= cut)
    return first_rows(few, ["__h", *row_key], rows).drop("__h")


def fit(df: DataFrame, date_columns: Sequence[str] = (), joints: Sequence[tuple[str, str]] = (), joint_cells: int | None = JOINT_CELLS,
        flagged: Sequence[str] = (), include_values: bool = False, row_key: Sequence[str] = (), max_rows: int | None = None, top: int = TOP_VALUES) -> Snapshot:
    """A snapshot of all rows; with a row key and ``max_rows``, a larger table is fitted on seeded random rows. ``top`` values of a category are kept. Flagged columns keep no values; other values, years and bins under ten rows are dropped unless
    ``include_values``. Everything collected is bounded by the number of columns and the caps above; with ``joint_cells=None``
    every cell of a joint is kept, in a frame that is written and not collected."""
    if row_key and max_rows is not None:
        df = sample_for_fit(df, row_key, max_rows)
    snap = Snapshot(redacted=tuple(c for c in df.columns if c in flagged and not include_values))
    kinds = column_kinds(df, date_columns)
    of = lambda k: [c for c in df.columns if kinds[c] == k]
    floor = 0 if include_values else FLOOR_ROWS

    def rows_of(kind: str, make: Callable[[], DataFrame]) -> Callable[[], list]:
        return lambda: make().collect() if of(kind) else []

    base, formats, numbers, bins, tops, years, lengths = together([
        lambda: df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)]).first(),
        lambda: {r["column"]: r.asDict() for r in cell_formats(df).collect()},
        rows_of("numeric", lambda: numeric_stats(df, of("numeric"))),
        rows_of("numeric", lambda: numeric_histogram(df, of("numeric")).orderBy("column", "bucket")),
        rows_of("categorical", lambda: top_values(df, of("categorical"), top).orderBy("column", F.desc("n"), "value")),
        rows_of("datetime", lambda: datetime_stats(df, of("datetime")).orderBy("column", "year")),
        rows_of("freetext", lambda: freetext_stats(df, of("freetext")).orderBy("column", "bucket"))])
    for i, c in enumerate(df.columns):
        f = formats[c]
        snap.columns[c] = {"kind": kinds[c], "rows": base["n"], "nulls": base[f"null_{i}"], "stats": {},
                           "format": {"decimals": f["decimals"], "resolution": f["resolution"]}}
    stats = {c: col["stats"] for c, col in snap.columns.items()}
    for r in numbers:
        stats[r["column"]].update({k: v for k, v in r.asDict().items() if k not in ("column", "rows", "nulls")})
    for r in bins:
        if r["n"] >= floor:
            stats[r["column"]].setdefault("histogram", []).append((r["lo"], r["hi"], r["n"]))
    for r in tops:
        s = stats[r["column"]]
        s.setdefault("top_values", [])
        s.setdefault("other_count", 0)
        if r["is_other"] or r["n"] < floor or r["column"] in snap.redacted:
            s["other_count"] += r["n"]
        else:
            s["top_values"].append((r["value"], r["n"]))
    for r in years:
        s = stats[r["column"]]
        s.update(earliest=r["earliest"], latest=r["latest"])
        if r["n"] >= floor:
            s.setdefault("years", []).append((r["year"], r["n"]))
    for r in lengths:
        stats[r["column"]].setdefault("histogram", []).append((r["lo"], r["hi"], r["n"]))
    if not include_values:
        _coarsen(snap)
    for a, b in joints:
        if {a, b} & set(snap.redacted):
            snap.joints[(a, b)] = []
            continue
        if (joint_cells is None or joint_cells > JOINT_CELLS) and not include_values and not {kinds[a], kinds[b]} <= {"categorical"}:
            raise InvalidRule("contingency_top_k_kind_unsupported: more joint cells need plain categories")
        if joint_cells is None:
            snap.joint_frames[(a, b)] = materialize(joint_counts(df, a, b, None).where(F.col("n") >= floor), "joint")
            continue
        snap.joints[(a, b)] = [(r["a"], r["b"], r["n"]) for r in joint_counts(df, a, b, joint_cells).collect() if r["n"] >= floor]
        n = joint_dropped(df, a, b, joint_cells)
        if n:
            all_ = n + joint_cells if n + joint_cells <= JOINT_CELLS_MAX else None
            snap.warnings.append(f"joint {a},{b}: {n} pairs dropped; keep them all with joint_cells={all_}")
    return snap


def _coarsen(snap: Snapshot) -> None:
    """No exact extreme: ends move out to the edges of the kept histogram rounded to two digits; a withheld number
    column keeps one coarse range, a withheld date column its years."""
    for c, col in snap.columns.items():
        s = col["stats"]
        if col["kind"] == "numeric" and s.get("histogram"):
            lo, hi = _round_out(s["histogram"][0][0], -1), _round_out(s["histogram"][-1][1], 1)
            s["min"], s["max"] = lo, hi
            if c in snap.redacted:
                n = sum(x[2] for x in s["histogram"])
                col["stats"] = {"min": lo, "max": hi, "histogram": [(lo, hi, n)]}
        elif col["kind"] == "datetime" and s.get("years"):
            ys = [y for y, _ in s["years"]]
            s["earliest"], s["latest"] = dt.datetime(min(ys), 1, 1), dt.datetime(max(ys), 12, 31, 23, 59, 59)


def _round_out(x: float, way: int) -> float:
    if x == 0:
        return 0.0
    unit_ = 10.0 ** (math.floor(math.log10(abs(x))) - 1)
    return (math.floor if way < 0 else math.ceil)(x / unit_) * unit_


# ---- differential privacy
# An independent implementation with no certification. Neighbouring tables differ by one row.


@dataclass(frozen=True)
class DPColumn:
    name: str
    kind: str  # number, text or flag
    lo: float = 0.0
    hi: float = 0.0


def geometric_noise(epsilon: float) -> int:
    """Two-sided geometric noise for a count of sensitivity 1 (Ghosh, Roughgarden, Sundararajan 2009), from the operating
    system's randomness, exactly for the binary number that ``epsilon`` is; see ``functions.noise``."""
    return noise.discrete_laplace(Fraction(epsilon))


def release_threshold(epsilon: float, delta: float) -> int:
    """What a noisy count has to exceed: a value of one row clears it with probability ``delta`` at most.

    1 + x > tau has probability alpha ** tau / (1 + alpha), alpha = exp(-epsilon), and 1 + ln(1 / (2 delta)) / epsilon is enough for
    that. Worked out with 60 digits and rounded up."""
    with decimal.localcontext() as context:
        context.prec = 60
        return 1 + int(((1 / (2 * Decimal(delta))).ln() / Decimal(epsilon)).to_integral_value(decimal.ROUND_CEILING))


def parse_flag(c: Column) -> Column:
    """Exactly true/false or 1/0 as values; other text counts as empty."""
    return c.try_cast("boolean")


def fit_dp(df: DataFrame, columns: Sequence[DPColumn], epsilon: float, delta: float, allow_omit: bool = False,
           bins: int = BUCKETS) -> Snapshot:
    """(epsilon, delta) release of declared columns. The budget is split evenly over the row count and the columns
    (basic composition); a category appears only when its noisy count clears the threshold of partition selection
    (Korolova et al. 2009). Counting runs on Spark; noise is added to the small result."""
    if epsilon <= 0 or not 0 < delta < 1:
        raise InvalidRule("a release needs epsilon > 0 and 0 < delta < 1")
    omitted = sorted(set(df.columns) - {c.name for c in columns})
    if omitted and not allow_omit:
        raise InvalidRule(f"undeclared columns: {', '.join(omitted)}")
    eps, dlt = epsilon / (len(columns) + 1), delta / max(1, sum(c.kind == "text" for c in columns))
    snap = Snapshot(epsilon=epsilon, delta=delta, release=secrets.token_hex(8),
                    warnings=[f"omitted: {', '.join(omitted)}"] if omitted else [])
    rows = max(0, df.count() + geometric_noise(eps))
    numbers = [c for c in columns if c.kind == "number"]
    hist = {}
    if numbers:
        for c in numbers:
            if not c.lo < c.hi:
                raise InvalidRule(f"declare a range for {c.name!r}")
        cast = df.select(*[F.col(c.name).try_cast("double").alias(c.name) for c in numbers])
        for r in numeric_histogram(cast, [c.name for c in numbers], bins, {c.name: (c.lo, c.hi) for c in numbers}).collect():
            hist[(r["column"], r["bucket"])] = r["n"]
    for c in columns:
        col = {"rows": rows, "nulls": 0, "format": {"decimals": None, "resolution": None}}
        if c.kind == "number":
            w = (c.hi - c.lo) / bins
            noisy = [max(0, hist.get((c.name, b), 0) + geometric_noise(eps)) for b in range(bins)]
            col.update(kind="numeric", stats={"min": c.lo, "max": c.hi, "histogram": [(c.lo + b * w, c.lo + (b + 1) * w, n) for b, n in enumerate(noisy)]})
        elif c.kind == "flag":
            got = {r["v"]: r["count"] for r in df.select(parse_flag(F.col(c.name)).alias("v")).where("v is not null").groupBy("v").count().collect()}
            col.update(kind="categorical", stats={"top_values": [(str(v).lower(), max(0, got.get(v, 0) + geometric_noise(eps))) for v in (True, False)], "other_count": 0})
        else:
            # noise and threshold per value in the tasks that counted them: values under the threshold never leave those
            counts = df.select(F.col(c.name).cast("string").alias("v")).where("v is not null").groupBy("v").count()
            kept = threshold_release(counts, eps, release_threshold(eps, dlt))
            all_ = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            top = [(r["value"], r["n"]) for r in kept.orderBy(F.desc("n"), "value").limit(TOP_VALUES).collect()]
            snap.released[c.name] = kept
            col.update(kind="categorical", stats={"top_values": top, "other_count": all_ - sum(n for _, n in top)})
        snap.columns[c.name] = col
    return snap


def threshold_release(counts: DataFrame, epsilon: float, tau: int) -> DataFrame:
    """(value, n): noisy counts of (v, count) that clear the threshold, as a written frame: the noise is drawn once, however
    often the frame is read. A retried task draws anew, and only the rows of one attempt are kept."""
    rate, draw = Fraction(epsilon), noise.discrete_laplace

    def noisy(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            pairs = [(v, n + draw(rate)) for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            pairs = [(v, n) for v, n in pairs if n > tau]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], names=["value", "n"])

    return materialize(counts.select("v", "count").mapInArrow(noisy, "value string, n bigint"), "released")


def dp_cost(snapshots: Sequence[Snapshot]) -> tuple[float, float]:
    """Costs of different releases add; the same release counts once."""
    seen = {s.release: s for s in snapshots if s.release}
    return sum(s.epsilon for s in seen.values()), sum(s.delta for s in seen.values())


def check_dp_budget(snapshots: Sequence[Snapshot], epsilon: float, delta: float) -> tuple[float, float]:
    if any(s.release is None for s in snapshots):
        raise PrivacyBudget("a snapshot is not a private release")
    e, d = dp_cost(snapshots)
    if e > epsilon + 1e-12 or d > delta + 1e-18:
        raise PrivacyBudget(f"snapshots cost epsilon {e:g}, delta {d:g}; the ceiling is {epsilon:g}, {delta:g}")
    return e, d
