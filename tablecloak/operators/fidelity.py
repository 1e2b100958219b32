"""How much of a table's shape the output kept. Similarity, never privacy: a copy scores 1."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRule, PolicyFailed
from .fit import PERCENTILES, column_kinds, stack, union_all
from .ordering import exact_quantiles, running_total, with_row_index

# Grades from the overall score, and the minimum similarity expected of a strategy.
GRADES = (("A", 0.95), ("B", 0.85), ("C", 0.70), ("D", 0.50))
STRATEGY_MIN = {"shuffle": 0.85, "bucketize": 0.30, "faker": 0.05}
POLICY_KEYS = ("overall", "marginal", "pairwise", "columns", "diagnostic", "strategies")


def _named(spark, columns: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in columns], "column string")


def numeric(source: DataFrame, output: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, quantile_rmse, similarity): RMSE of five percentiles over the source's IQR; p95 - p5 when that is 0,
    then max - min; a constant column is 1 on a match, else 0."""
    probs = [*PERCENTILES, 0.0, 1.0]
    s = exact_quantiles(source, columns, probs).select("column", *[F.col(f"q{i}").alias(f"s{i}") for i in range(7)])
    o = exact_quantiles(output, columns, probs).select("column", *[F.col(f"q{i}").alias(f"o{i}") for i in range(7)])
    j = s.join(o, "column", "full_outer")
    rmse = F.sqrt(sum(((F.col(f"s{i}") - F.col(f"o{i}")) * (F.col(f"s{i}") - F.col(f"o{i}")) for i in range(5)), F.lit(0.0)) / 5)
    spread = F.coalesce(*[F.when(x > 0, x) for x in (F.col("s3") - F.col("s1"), F.col("s4") - F.col("s0"), F.col("s6") - F.col("s5"))])
    score = F.when(spread.isNull(), F.when(F.col("rmse") == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("rmse") / spread))
    return j.withColumn("rmse", rmse).select("column", F.col("rmse").alias("quantile_rmse"), F.when(F.col("rmse").isNotNull(), score).alias("similarity"))


def _shares(df: DataFrame, columns: Sequence[str], name: str, exprs: Mapping[str, Column] | None = None) -> DataFrame:
    """(column, value, share) over non-null cells."""
    picked = df.select(*[(exprs or {}).get(c, F.col(c)).cast("string").alias(c) for c in columns])
    counts = stack(picked, columns, "string").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = F.broadcast(counts.groupBy("column").agg(F.sum("n").alias("t")))
    return counts.join(totals, "column").select("column", "value", (F.col("n") / F.col("t")).alias(name))


def tvd(source: DataFrame, output: DataFrame, columns: Sequence[str], exprs: Mapping[str, Column] | None = None) -> DataFrame:
    """(column, tvd, similarity): 1 - total variation distance of the value shares."""
    j = _shares(source, columns, "p", exprs).join(_shares(output, columns, "q", exprs), ["column", "value"], "full_outer")
    gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return j.groupBy("column").agg((0.5 * F.sum(gap)).alias("tvd")).withColumn("similarity", 1 - F.col("tvd"))


def categorical(source: DataFrame, output: DataFrame, columns: Sequence[str]) -> DataFrame:
    return tvd(source, output, columns)


def datetimes(source: DataFrame, output: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shares of rows per year."""
    return tvd(source, output, columns, {c: F.year(F.col(c).cast("timestamp")) for c in columns})


def freetext(source: DataFrame, output: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, length_mean_diff, similarity): mean length difference relative to the source mean (D)."""
    mean = lambda df, n: stack(df.select(*[F.length(F.col(c).cast("string")).alias(c) for c in columns]), columns).groupBy("column").agg(F.avg("value").alias(n))
    j = mean(source, "a").join(mean(output, "b"), "column")
    diff = F.abs(F.col("a") - F.col("b"))
    return j.select("column", diff.alias("length_mean_diff"), F.when(F.col("a") > 0, F.greatest(F.lit(0.0), 1 - diff / F.col("a")))
                    .otherwise(F.when(diff == 0, 1.0).otherwise(0.0)).alias("similarity"))


def null_factor(source: DataFrame, output: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, source_nulls, output_nulls, factor): 1 - |difference of null shares|."""
    share = lambda df, n: df.agg(F.array(*[F.struct(F.lit(c).alias("column"), (F.count_if(F.col(c).isNull()) / F.count("*")).alias(n)) for c in columns]).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return share(source, "source_nulls").join(share(output, "output_nulls"), "column").withColumn("factor", 1 - F.abs(F.col("source_nulls") - F.col("output_nulls")))


def pairwise(source: DataFrame, output: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(joint, similarity): TVD over pair combinations."""
    packed = lambda df: df.select(*[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.to_json(F.struct(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")))).alias(f"{a}x{b}") for a, b in pairs])
    names = [f"{a}x{b}" for a, b in pairs]
    return tvd(packed(source), packed(output), names).select(F.col("column").alias("joint"), "similarity")


def _group(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else t.typeName()


def marginal(source: DataFrame, output: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, comparable, value_similarity, missing_similarity, similarity) for every column of either side.
    Not comparable: one-sided, empty on a side, or of another type."""
    cols = [c for c in (columns or source.columns) if c in source.columns and c in output.columns
            and _group(source.schema[c].dataType) == _group(output.schema[c].dataType)]
    kinds = column_kinds(source.select(*cols))
    of = lambda k: [c for c in cols if kinds[c] == k]
    parts = []
    for kind, fn in (("numeric", numeric), ("categorical", categorical), ("datetime", datetimes), ("freetext", freetext)):
        if of(kind):
            parts.append(fn(source, output, of(kind)).select("column", F.lit(kind).alias("kind"), F.col("similarity").alias("value_similarity")))
    scored = union_all(parts).join(null_factor(source, output, cols), "column")
    ok = F.col("value_similarity").isNotNull() & (F.col("source_nulls") < 1) & (F.col("output_nulls") < 1)
    names = sorted(set(columns or [*source.columns, *output.columns]))
    return _named(source.sparkSession, names).join(scored, "column", "left").select(
        "column", "kind", F.coalesce(ok, F.lit(False)).alias("comparable"), F.when(ok, F.col("value_similarity")).alias("value_similarity"),
        F.when(ok, F.col("factor")).alias("missing_similarity"), F.when(ok, F.col("value_similarity") * F.col("factor")).alias("similarity"))


def grade(score: Column) -> Column:
    out = F.when(score.isNull(), "unavailable")
    for name, least in GRADES:
        out = out.when(score >= least, name)
    return out.otherwise("F")


def overall(marg: DataFrame, pair: DataFrame | None = None) -> DataFrame:
    """(marginal_score, pairwise_score, overall_score, grade): the mean of marginal and pairwise when there are pairs."""
    m = marg.where("comparable").agg(F.avg("similarity").alias("marginal_score"))
    m = m.withColumn("pairwise_score", pair.agg(F.avg("similarity")).scalar() if pair is not None else F.lit(None).cast("double"))
    score = F.when(F.col("pairwise_score").isNull(), F.col("marginal_score")).otherwise((F.col("marginal_score") + F.col("pairwise_score")) / 2)
    return m.withColumn("overall_score", score).withColumn("grade", grade(F.col("overall_score")))


BRACKETS = 4096  # of one column, counted at once


def ks(source: DataFrame, output: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, ks, similarity): 1 - the largest gap of the two cumulative shares, exact.

    A column's range is cut in brackets of equal width, and the cells of both sides are counted per bracket. At a bracket's end
    the gap is then known; inside, it cannot rise above what it is at the start and the source's cells, nor fall below that less the
    output's. Only brackets that could hold a larger gap than the largest known are cut again, and the values of those that are left
    are counted one by one. Whole numbers throughout: a gap is s * total(o) - o * total(s). Columns that one side has no value of
    are left out.
    """
    spark = source.sparkSession
    side = lambda df, n: stack(df, columns).where("value is not null").select("column", "value", F.lit(n).alias("s"))
    both = side(source, 1).unionByName(side(output, 0))
    number = F.when(~F.isnan("value"), F.col("value"))
    ends = {r["column"]: r for r in both.groupBy("column").agg(F.min(number).alias("low"), F.max(number).alias("high"), F.sum("s").alias("ts"), F.sum(1 - F.col("s")).alias("tos")).collect()}
    ends = {c: r for c, r in ends.items() if r["ts"] and r["tos"]}
    best = dict.fromkeys(ends, 0)

    def cut(cells: DataFrame, brackets: list[tuple], names: list[str]) -> DataFrame:
        """Cells of the brackets (column, place..., low, high, parts), with the place inside it. At most BRACKETS rows a column."""
        kinds = ", ".join(f"{n} int" for n in names[:-1])
        asked = spark.createDataFrame(brackets, f"column string, {kinds + ', ' if kinds else ''}low double, high double, parts int")
        return cells.join(F.broadcast(asked), ["column", *names[:-1]]).withColumn(names[-1], _place(F.col("value"))).drop("low", "high", "parts")

    def count(cells: DataFrame, names: list[str], before: dict[tuple, int]) -> list[tuple]:
        """The brackets that may hold a larger gap than any known: (column, place..., gap before, low, high). ``before`` has the gap
        before the first bracket of each column and outer place."""
        rows = cells.groupBy("column", *names).agg(F.sum("s").alias("s"), F.sum(1 - F.col("s")).alias("o"), F.min(number).alias("low"), F.max(number).alias("high")).collect()
        seen, outer, run = [], None, 0
        for r in sorted(rows, key=lambda r: (r["column"], *[r[n] for n in names])):
            c, at = r["column"], tuple(r[n] for n in names)
            if outer != (c, *at[:-1]):
                outer = (c, *at[:-1])
                run = before[outer]
            start, run = run, run + r["s"] * ends[c]["tos"] - r["o"] * ends[c]["ts"]
            best[c] = max(best[c], abs(run))
            seen.append(((c, *at, start, r["low"], r["high"]), max(start + r["s"] * ends[c]["tos"], r["o"] * ends[c]["ts"] - start)))
        return [x for x, most in seen if most > best[x[0]]]

    cells = cut(both, [(c, r["low"], r["high"], BRACKETS) for c, r in ends.items()], ["b1"])
    left = count(cells, ["b1"], {(c,): 0 for c in ends})
    share = {c: max(1, BRACKETS // max(1, sum(x[0] == c for x in left))) for c in ends}
    cells = cut(cells, [(c, b, low, high, share[c]) for c, b, _, low, high in left], ["b1", "b2"])
    left = count(cells, ["b1", "b2"], {(c, b): start for c, b, start, _, _ in left})
    known = spark.createDataFrame([(c, b1, b2, Decimal(start), ends[c]["ts"], ends[c]["tos"]) for c, b1, b2, start, _, _ in left],
                                  "column string, b1 int, b2 int, start decimal(38,0), ts bigint, tos bigint")
    values = cells.join(F.broadcast(known), ["column", "b1", "b2"]).groupBy("column", "b1", "b2", "start", "ts", "tos", "value").agg(
        F.sum("s").alias("s"), F.sum(1 - F.col("s")).alias("o"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    step = (wide("s") * wide("tos") - wide("o") * wide("ts")).cast("decimal(38,0)")
    run = running_total(values, ["value"], step, ["column", "b1", "b2"], "run")
    inner = run.groupBy("column").agg(F.max(F.abs(F.col("start") + F.col("run"))).alias("inner"))
    found = spark.createDataFrame([(c, Decimal(best[c]), r["ts"], r["tos"]) for c, r in ends.items()], "column string, best decimal(38,0), ts bigint, tos bigint")
    most = F.greatest("best", F.coalesce("inner", F.lit(0).cast("decimal(38,0)"))).cast("double")
    gap = most / (F.col("ts").cast("double") * F.col("tos").cast("double"))
    # one row a column
    return found.join(F.broadcast(inner), "column", "left").select("column", gap.alias("ks")).withColumn("similarity", 1 - F.col("ks"))


def _place(value: Column) -> Column:
    """Which of ``parts`` equal widths from ``low`` to ``high`` a value lies in; what is no number comes last."""
    width = (F.col("high") - F.col("low")) / F.col("parts")
    inside = F.floor((value - F.col("low")) / width)
    even = (width > 0) & (width < float("inf"))
    return F.when(F.isnan(value), F.col("parts")).when(even, F.greatest(F.lit(0), F.least(inside, F.col("parts") - 1))).otherwise(0).cast("int")


def cramers_v(source: DataFrame, output: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, cramers_v, similarity): association of the value with the side it came from. Chi-square is
    n * (sum of o^2 / (row * column) - 1), so empty cells of the table need no row."""
    side = lambda df, n: stack(df, columns, "string").where("value is not null").groupBy("column", "value").agg(F.count("*").alias(n))
    j = side(source, "s").join(side(output, "o"), ["column", "value"], "full_outer").na.fill(0, ["s", "o"])
    totals = F.broadcast(j.groupBy("column").agg(F.sum("s").alias("ts"), F.sum("o").alias("tos"), F.count("*").alias("k")))
    row = F.col("s") + F.col("o")
    term = F.col("s") * F.col("s") / (row * F.col("ts").cast("double")) + F.col("o") * F.col("o") / (row * F.col("tos").cast("double"))
    agg = j.join(totals, "column").groupBy("column", "k").agg(F.sum(term).alias("t"))
    v = F.when(F.col("k") > 1, F.sqrt(F.greatest(F.col("t") - 1, F.lit(0.0)))).otherwise(0.0)
    return agg.select("column", v.alias("cramers_v"), (1 - v).alias("similarity"))


def shape(source: DataFrame, output: DataFrame, column: str, out_column: str | None = None) -> DataFrame:
    """(column, similarity): values forgotten, only the frequency pattern compared, rank by rank (D)."""
    def ranked(df: DataFrame, c: str, name: str) -> DataFrame:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n")).scalar()
        return with_row_index(counts.select((-F.col("n")).alias("m"), (F.col("n") / total).alias(name)), ["m"], "rank").drop("m")
    j = ranked(source, column, "p").join(ranked(output, out_column or column, "q"), "rank", "full_outer")
    gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return j.agg((1 - 0.5 * F.sum(gap)).alias("similarity")).select(F.lit(column).alias("column"), "similarity")


def diagnostic(source: DataFrame, output: DataFrame, generated: bool = False) -> DataFrame:
    """(check, column, ok): every column present, of the same type; row count equal unless the output is generated."""
    rows = []
    for c in source.columns:
        rows.append(("column_present", c, c in output.columns))
        if c in output.columns:
            rows.append(("type_kept", c, _group(source.schema[c].dataType) == _group(output.schema[c].dataType)))
    out = source.sparkSession.createDataFrame(rows, "check string, column string, ok boolean")
    if generated:
        return out
    n = source.agg(F.count("*").alias("a")).withColumn("b", output.agg(F.count("*")).scalar())
    return out.unionByName(n.select(F.lit("row_count").alias("check"), F.lit(None).cast("string").alias("column"), (F.col("a") == F.col("b")).alias("ok")))


def policy_violations(marg: DataFrame, total: DataFrame, thresholds: Mapping[str, object], strategies: Mapping[str, str] | None = None,
                      pair: DataFrame | None = None, diag: DataFrame | None = None) -> DataFrame:
    """(rule, subject, minimum, actual). Unknown keys are refused."""
    unknown = sorted(set(thresholds) - set(POLICY_KEYS))
    if unknown:
        raise InvalidRule(f"unknown policy keys: {', '.join(unknown)}")
    spark, parts = marg.sparkSession, []
    row = lambda df, rule, subject, least, actual: df.select(F.lit(rule).alias("rule"), subject.alias("subject"), least.cast("double").alias("minimum"), actual.cast("double").alias("actual")).where(F.col("actual") < F.col("minimum"))
    for key, col in (("overall", "overall_score"), ("marginal", "marginal_score"), ("pairwise", "pairwise_score")):
        if key in thresholds:
            parts.append(row(total, key, F.lit("table"), F.lit(float(thresholds[key])), F.col(col)))
    if thresholds.get("columns"):
        least = F.broadcast(spark.createDataFrame([(c, float(m)) for c, m in thresholds["columns"].items()], "column string, m double"))
        parts.append(row(marg.join(least, "column"), "column", F.col("column"), F.col("m"), F.col("similarity")))
    mins = {**STRATEGY_MIN, **thresholds.get("strategies", {})} if strategies else {}
    wanted = [(c, float(mins[s])) for c, s in (strategies or {}).items() if s in mins]
    if wanted:
        least = F.broadcast(spark.createDataFrame(wanted, "column string, m double"))
        parts.append(row(marg.join(least, "column"), "strategy", F.col("column"), F.col("m"), F.col("similarity")))
    if thresholds.get("diagnostic") and diag is not None:
        parts.append(row(diag, "diagnostic", F.coalesce("column", F.col("check")), F.lit(1.0), F.col("ok").cast("int")))
    if not parts:
        return spark.createDataFrame([], "rule string, subject string, minimum double, actual double")
    return union_all(parts)


def enforce(violations: DataFrame, mode: str = "report") -> str:
    if mode not in ("report", "warn", "fail"):
        raise InvalidRule("mode is report, warn or fail")
    if mode == "report":
        return "REPORT ONLY"
    bad = not violations.isEmpty()
    if bad and mode == "fail":
        raise PolicyFailed("fidelity is under its thresholds")
    return "WARN" if bad else "PASS"
