"""The parts that exist for size: hot keys, hot groups, layout independence."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablecloak.operators import fidelity, fit, joins, ordering
from tablecloak.operators.masks import keep, mask_table, rule
from tablecloak.plans.registry import SECRET


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows have key 0, a tenth have none."""
    k = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 50)
    return spark.range(3000).select("id", k.cast("bigint").alias("k"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_keys_take_their_own_way_with_equal_results(spark, skewed, how):
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert {r.k for r in joins.hot_keys(skewed, ["k"], 200).collect()} >= {0, None}
    assert rows(joins.lookup_join(skewed, small, ["k"], how, hot_rows=200)) == rows(skewed.join(small, ["k"], how).select(
        *joins._columns(skewed, small, ["k"], how)))


def test_running_total_over_a_hot_group(spark, skewed):
    got = ordering.running_total(skewed, ["id"], F.col("id"), ["k"], "run")
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got) == rows(skewed.withColumn("run", F.sum("id").over(w)))


def test_hot_group_is_cut_over_partitions(spark, skewed):
    cut = skewed.repartitionByRange(4, "k", "id").withColumn("p", F.spark_partition_id())
    assert cut.where("k = 0").select("p").distinct().count() > 1


def test_row_index_is_dense_for_any_layout(spark):
    for parts in (1, 7):
        df = spark.range(501).select((F.col("id") * 37 % 501).alias("x")).repartition(parts)
        got = ordering.with_row_index(df, ["x"], "i")
        assert got.where("x <> i").count() == 0


def test_many_hot_keys_are_all_split(spark, monkeypatch):
    """More hot keys than the broadcast may hold: hot then means more rows, and the join stays exact."""
    big = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 1500).alias("k"))
    assert joins.hot_keys(big, ["k"], 2).count() == 751
    monkeypatch.setattr(joins, "BROADCAST_KEYS", 10)
    assert joins.hot_keys(big, ["k"], 2).count() == 1
    small = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert rows(joins.lookup_join(big, small, ["k"], "left", hot_rows=2)) == rows(big.join(small, ["k"], "left").select("id", "k", "v"))


def test_repeated_values_in_a_small_file_are_found_hot(spark, tmp_path):
    """A file that looks small because its values repeat still has its hot key split."""
    spark.range(3_000_000).select(F.lit(7).cast("bigint").alias("k")).write.parquet(f"{tmp_path}/t")
    assert [r.k for r in joins.hot_keys(spark.read.parquet(f"{tmp_path}/t"), ["k"]).collect()] == [7]


@pytest.mark.parametrize("n", [0, 1, 17, 5000])
def test_first_rows_of_any_number(spark, n):
    df = spark.range(3000).select((F.col("id") * 37 % 3000).alias("x")).repartition(5)
    assert sorted(r.x for r in ordering.first_rows(df, [F.desc("x")], n).collect()) == sorted(range(3000), reverse=True)[:n][::-1]
    assert "TakeOrdered" not in ordering.first_rows(df, ["x"], 5)._jdf.queryExecution().executedPlan().toString()


def test_quantiles_are_exact_with_repeats(spark, t):
    df = t.lineitem.select("l_quantity", "l_extendedprice")
    got = {r["column"]: r for r in ordering.exact_quantiles(df, df.columns, [0.0, 0.05, 0.5, 1.0]).collect()}
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in (0.0, 0.05, 0.5, 1.0)])).alias(c) for c in df.columns]).first()
    for c in df.columns:
        assert [got[c][f"q{i}"] for i in range(4)] == pytest.approx(want[c])


def test_masks_do_not_depend_on_layout(spark, t):
    rules = [rule("c_custkey", "hash", "c"), rule("c_name", "faker", "n", deterministic=True, provider="person_email"),
             rule("c_acctbal", "shuffle", "b", deterministic=True), rule("c_mktsegment", "categorical", categories=["a", "b"]), *keep("c_nationkey")]
    # the row key is masked too, so the shuffle must use the source key
    one, many = (rows(mask_table(t.customer.repartition(n), rules, SECRET, "customer", ["c_custkey"])) for n in (1, 7))
    assert one == many


def test_generation_does_not_depend_on_layout_or_growth(spark):
    from tablecloak.operators.generate import Generator, GenTable, gen

    def make(rows_, *more, seed=42):
        cols = (gen("id", "sequence", start=1), gen("a", "faker", faker_type="email"), gen("b", "faker", faker_type="email"), *more)
        return Generator(spark, [GenTable("g", rows_, cols)], seed=seed).run()["g"]

    small = rows(make(50).select("id", "a"))
    grown = rows(make(80, gen("c", "constant", value=1)).where("id <= 50").select("id", "a"))
    assert small == grown
    assert make(50).where("a = b").count() == 0                      # equal settings, other stream
    assert make(50).join(make(50, seed=43), ["id", "a"]).count() == 0  # other seed


def test_ks_and_cramers_against_brute_force(spark, t):
    a, b = t.orders.where("o_orderkey % 2 = 0"), t.orders.where("o_orderkey % 3 = 0")
    x, y = ([r[0] for r in f.select("o_totalprice").collect()] for f in (a, b))
    ks = max(abs(sum(v <= p for v in x) / len(x) - sum(v <= p for v in y) / len(y)) for p in sorted(set(x) | set(y))[::7])
    got = fidelity.ks(a, b, ["o_totalprice"]).first()["ks"]
    assert got >= ks - 1e-12 and got < ks + 0.05
    assert fidelity.cramers_v(a, a, ["o_orderstatus"]).first()["cramers_v"] == pytest.approx(0, abs=1e-6)


def test_top_values_keep_few_rows_per_task(spark, t):
    plan = fit.top_values(t.lineitem, ["l_partkey"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark, t):
    df = mask_table(t.orders.where("o_totalprice > 100000").select("o_orderkey", "o_custkey"), [rule("o_custkey", "hash", "c"), *keep("o_orderkey")], SECRET, "orders")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_orderdate" not in plan
    assert "Exchange" not in plan and "Python" not in plan


def test_quantiles_of_awkward_columns(spark):
    """A value that fills most of the column, one row, no row, negative and huge values."""
    rows_ = [(7.0 if i % 10 else float(i * i - 40_000), None if i else 3.0, None, (-1.0) ** i * 10.0 ** (i % 300)) for i in range(700)]
    df = spark.createDataFrame(rows_, "a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.9995, 1.0]
    got = {r["column"]: r for r in ordering.exact_quantiles(df, df.columns, probs).collect()}
    assert set(got) == {"a", "b", "d"}
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in got]).first()
    for c in got:
        assert [got[c][f"q{i}"] for i in range(len(probs))] == pytest.approx(want[c], rel=1e-9)


def test_rows_that_are_all_alike_are_dealt_out_evenly(spark, monkeypatch):
    """Ten million rows that hold nothing but one key: no part of it, and no task, has more than its share."""
    big = spark.range(10_000_000).select(F.lit(7).cast("bigint").alias("k"))
    small = spark.createDataFrame([(7, "seven"), (8, "eight")], "k bigint, v string")
    sizes = []
    real = joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, label: sizes.append(label) or real(df, label))
    out = joins.lookup_join(big, small, ["k"])
    assert sizes == ["dealt"] and out.columns == ["k", "v"]
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    dealt = real(big, "again").select(F.pmod(place, F.lit(10)).alias("part")).groupBy("part").count().collect()
    assert len(dealt) == 10 and max(r["count"] for r in dealt) <= 1.2 * 1_000_000
    assert out.groupBy("v").count().collect()[0]["count"] == 10_000_000


def test_keys_are_counted_before_they_are_looked_up(spark, skewed):
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = joins.counted_join(skewed.select("k"), small, ["k"], how)
        want = skewed.select("k").join(small, ["k"], how)
        assert rows(got.drop("__n")) == rows(want.distinct()) and got.agg(F.sum("__n")).first()[0] == want.count()


def test_running_totals_of_several_weights(spark, skewed):
    got = ordering.running_totals(skewed, ["id"], {"a": F.col("id"), "b": F.when(F.col("id") % 2 == 0, 1).otherwise(0)}, ["k"])
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got) == rows(skewed.select("*", F.sum("id").over(w).alias("a"), F.sum(F.when(F.col("id") % 2 == 0, 1).otherwise(0)).over(w).alias("b")))


def test_ks_by_brackets_is_exact(spark, monkeypatch):
    """Few brackets, so that cutting goes on: smooth, discrete, far-out, one-valued and not-a-number columns."""
    import random
    r = random.Random(6)
    make = lambda n, shift: [(r.gauss(shift, 1), float(r.choice([1, 2, 2, 3])) + (shift > 0 and r.random() < 0.1), r.choice([1e300, -1e300, 0.0, float("inf"), r.random()]), 5.0,
                              r.choice([float("nan"), 1.0, None, r.random()]), None if shift else 1.0) for _ in range(n)]
    kinds = ", ".join(f"c{i} double" for i in range(6))
    x, y = make(700, 0), make(900, 0.1)
    a, b = (spark.createDataFrame(rows_, kinds).repartition(4) for rows_ in (x, y))

    def gap(i):
        key = lambda v: (v != v, v if v == v else 0.0)
        s, o = sorted(key(r[i]) for r in x if r[i] is not None), sorted(key(r[i]) for r in y if r[i] is not None)
        return max(abs(sum(v <= p for v in s) * len(o) - sum(v <= p for v in o) * len(s)) for p in set(s + o)) / (len(s) * len(o))
    for brackets in (4, 64, 4096):
        monkeypatch.setattr(fidelity, "BRACKETS", brackets)
        got = {row["column"]: row["ks"] for row in fidelity.ks(a, b, [f"c{i}" for i in range(6)]).collect()}
        assert got == {f"c{i}": pytest.approx(gap(i), abs=1e-15) for i in range(5)}


def test_ks_shuffles_few_values(spark, t):
    """What is counted one by one is a small part of the distinct values."""
    a, b = t.lineitem.where("l_orderkey % 2 = 0"), t.lineitem.where("l_orderkey % 2 = 1")
    seen = []
    real = fidelity.running_total
    fidelity.running_total = lambda df, *rest: seen.append(df.count()) or real(df, *rest)
    try:
        fidelity.ks(a, b, ["l_extendedprice"]).collect()
    finally:
        fidelity.running_total = real
    assert sum(seen) <= 0.05 * t.lineitem.select("l_extendedprice").distinct().count()
