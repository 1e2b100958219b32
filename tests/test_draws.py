"""Weighted draws from frames, joints of every size, exact noise."""

import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tablecloak.errors import InvalidRule
from tablecloak.functions import noise
from tablecloak.keys import hmac_hex
from tablecloak.operators import alias, fit, joins
from tablecloak.operators.generate import Generator, GenTable, Source, gen
from tablecloak.operators.statistical import fallback_rows


def shares(table, group=()):
    """What each item gets of its group: slots hold the total, an item its own part and what others pass to it."""
    totals = {tuple(r[g] for g in group): (r["slots"], r["total"]) for r in table.totals.collect()}
    got, slots = Counter(), Counter()
    for r in table.slots.collect():
        g = tuple(r[x] for x in group)
        slots[g] += 1
        assert 0 <= r["cut"] <= totals[g][1] and (r["other"] is not None or r["cut"] == totals[g][1])
        got[g, r["item"]] += r["cut"]
        if r["cut"] < totals[g][1]:
            got[g, r["other"]] += totals[g][1] - r["cut"]
    assert {g: n for g, (n, _) in totals.items()} == dict(slots)
    return {k: Fraction(v, totals[k[0]][0]) for k, v in got.items()}


@pytest.mark.parametrize("weights", [[1], [5, 5, 5], [0, 1, 0, 9, 3, 0, 1, 1, 30, 2], [10**6, *[1] * 60], [*[1] * 60, 10**6], [*range(90)], [7, 0, 7, 1, 13, 7, 7], [10**17, 3, 10**17]])
def test_alias_tables_are_exact(spark, weights):
    items = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "i bigint, w bigint").repartition(3)
    assert shares(alias.alias_table(items, "i", F.col("w"))) == {((), i): w for i, w in enumerate(weights) if w}


def test_alias_tables_by_group(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    data = [(f"g{k % 3}", f"i{k}", (k * k * 7) % 11) for k in range(120)] + [("one", "x", 4)]
    table = alias.alias_table(spark.createDataFrame(data, "g string, i string, w int"), "i", F.col("w"), ["g"])
    assert shares(table, ["g"]) == {((g,), i): w for g, i, w in data if w}
    df = spark.range(3000).select("id", F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("k"))
    out = alias.draw(df, table, hmac_hex(b"k" * 32, F.col("id").cast("string")), "d", {"g": "k"})
    assert out.columns == ["id", "k", "d"] and out.count() == 3000
    assert out.where("k = 'g3'").select("d").distinct().collect() == [(None,)] and out.where("k <> 'g3' AND d IS NULL").isEmpty()
    own = {i: g for g, i, _ in data}
    assert all(own[r["d"]] == r["k"] for r in out.where("k <> 'g3'").collect())


def test_weights_that_cannot_be_drawn_are_refused(spark):
    for rows_, kind in (([(1, -1), (2, 5)], "i int, w int"), ([(1, 10**18), (2, 1)], "i int, w bigint")):
        with pytest.raises(InvalidRule):
            alias.alias_table(spark.createDataFrame(rows_, kind), "i", F.col("w"))
    with pytest.raises(InvalidRule):
        alias.whole_weight(spark.createDataFrame([(1.5,)], "w double"), "w")
    prices = spark.createDataFrame([("1.50",), (None,)], "w string").select(F.col("w").cast("decimal(9,2)").alias("w"))
    assert [r[0] for r in prices.select(alias.whole_weight(prices, "w")).collect()] == [150, 0]
    with pytest.raises(InvalidRule):
        none = alias.alias_table(spark.createDataFrame([(1, 0)], "i int, w int"), "i", F.col("w"))
        alias.draw(spark.range(3), none, F.sha2(F.col("id").cast("string"), 256), "d")


def test_a_million_weighted_parents(spark):
    """Weights of a million parents stay a frame; the children follow them."""
    parents = spark.range(1_000_000).select(F.col("id").alias("k"), F.when(F.col("id") == 777, 1_000_000).otherwise(F.col("id") % 3).cast("int").alias("w"))
    t = GenTable("g", 200_000, (gen("c", "reference", reference_table="p", reference_column="k", distribution="weighted", weight_column="w"),))
    out = Generator(spark, [t], {"p": Source(parents, ["k"])}).run()["g"]
    n, heavy, none, two = out.agg(F.count("*"), F.count_if(F.col("c") == 777), F.count_if((F.col("c") % 3 == 0) & (F.col("c") != 777)), F.count_if(F.col("c") % 3 == 2)).first()
    assert n == 200_000 and none == 0
    # half of the weight is that of one parent, a third that of the parents of weight two
    assert abs(heavy - 100_000) < 5 * math.sqrt(50_000) and abs(two - 200_000 / 3) < 5 * math.sqrt(200_000 * 2 / 9)


def test_weighted_generated_parents_and_long_lists(spark):
    tables = [GenTable("p", 50, (gen("id", "sequence", start=100), gen("w", "faker", faker_type="random_int", faker_kwargs={"min": 0, "max": 3}))),
              GenTable("g", 400, (gen("c", "reference", reference_table="p", reference_column="id", distribution="weighted", weight_column="w"),))]
    out = Generator(spark, tables).run()
    light = {r["id"] for r in out["p"].where("w = 0").collect()}
    drawn = {r["c"] for r in out["g"].collect()}
    assert light and drawn and not light & drawn and drawn <= set(range(100, 150))
    with pytest.raises(InvalidRule):
        long = GenTable("g", 4, (gen("c", "reference", reference_table="p", reference_column="id", distribution="weighted", weights=[1.0] * 1001),))
        Generator(spark, [tables[0], long]).run()


def test_joints_keep_every_cell(spark):
    src = spark.range(6000).select((F.col("id") % 40).cast("string").alias("a"), ((F.col("id") * 7) % 60).cast("string").alias("b"))
    small = fit.fit(src, joints=[("a", "b")], include_values=True)
    assert len(small.joints[("a", "b")]) == 25 and "joint_cells=" in small.warnings[0]
    big = src.select("a", F.concat("a", F.col("b")).alias("b")).withColumn("b", F.concat("b", F.lit("-"), F.monotonically_increasing_id() % 400))
    assert "joint_cells=None" in fit.fit(big, joints=[("a", "b")], include_values=True).warnings[0]
    snap = fit.fit(src, joints=[("a", "b")], joint_cells=None, include_values=True)
    assert snap.joint_frames[("a", "b")].count() == src.distinct().count() == 120
    pairs = {(r["a"], r["b"]) for r in src.distinct().collect()}
    t = GenTable("g", 3000, (gen("x", "categorical", categories=["1", "2", "none of them"]), gen("b", "statistical_conditional", snapshot=snap, condition_on="x"),))
    # the pair is found by the names of the snapshot
    snap.joint_frames[("x", "b")] = snap.joint_frames.pop(("a", "b"))
    out = Generator(spark, [t]).run()["g"]
    assert {r["x"] for r in out.collect()} == {"1", "2", "none of them"} and out.where("b IS NULL").isEmpty()
    assert all((r["x"], r["b"]) in pairs for r in out.where("x <> 'none of them'").distinct().collect())
    assert out.where("x = 'none of them'").select("b").distinct().count() > 20
    assert fallback_rows(out, snap, "x", "b") == out.where("x = 'none of them'").count()
    with pytest.raises(InvalidRule):
        fit.fit(src, joints=[("a", "b")], joint_cells=None)


def branches(run, least):
    """Every outcome of ``run(below)`` and its probability, as fractions, along all paths likelier than ``least``."""
    found, open_, lost = Counter(), [((), Fraction(1))], Fraction(0)

    class Split(Exception):
        pass

    while open_:
        path, p = open_.pop()
        if p < least:
            lost += p
            continue
        step = iter(path)

        def below(n):
            try:
                return next(step)
            except StopIteration:
                raise Split(n) from None

        try:
            found[run(below)] += p
        except Split as s:
            open_ += [((*path, i), p / s.args[0]) for i in range(s.args[0])]
    return found, lost


@pytest.mark.parametrize("n, d", [(0, 1), (1, 1), (1, 2), (2, 3)])
def test_exponential_chance_is_exact(n, d):
    found, lost = branches(lambda below: noise.bernoulli_exp(n, d, below), Fraction(1, 10**7))
    assert lost < Fraction(1, 10**3) and abs(float(found[True]) - math.exp(-n / d)) <= float(lost)


@pytest.mark.parametrize("epsilon, most", [(Fraction(1), 0.01), (Fraction(2), 0.04), (Fraction(1, 2), 0.05), (Fraction(3, 2), 0.15)])
def test_noise_is_exact(epsilon, most):
    """The probabilities of all paths, added up as fractions, are those of the distribution, but for the share of unlikely paths that
    is left out."""
    found, lost = branches(lambda below: noise.discrete_laplace(epsilon, below), Fraction(1, 5 * 10**6))
    e = float(epsilon)
    for x in range(-4, 5):
        want = math.exp(-e * abs(x)) * (1 - math.exp(-e)) / (1 + math.exp(-e))
        assert float(found[x]) <= want + 1e-12 and want <= float(found[x] + lost) + 1e-12
    assert lost < most and all(found[x] == found[-x] or abs(found[x] - found[-x]) <= lost for x in range(1, 5))


def test_noise_of_a_real_epsilon():
    draws = [fit.geometric_noise(0.3) for _ in range(20_000)]
    a = math.exp(-0.3)
    assert abs(sum(draws) / len(draws)) < 5 * math.sqrt(2 * a / (1 - a) ** 2 / len(draws))
    assert abs(draws.count(0) / len(draws) - (1 - a) / (1 + a)) < 0.02


def test_threshold_keeps_its_promise():
    for epsilon, delta in ((1.0, 1e-6), (0.01, 1e-9), (5.0, 0.2), (1 / 3, 1e-12)):
        tau, a = fit.release_threshold(epsilon, delta), math.exp(-epsilon)
        assert a ** tau / (1 + a) <= delta * (1 + 1e-9)


def test_a_million_categories_are_released_as_a_frame(spark):
    """A release is written by the tasks; of a million categories the driver sees thirty."""
    df = spark.range(3_000_000).select(F.when(F.col("id") < 1_000_000, F.concat(F.lit("rare"), F.col("id"))).otherwise(F.concat(F.lit("v"), F.col("id") % 5000)).alias("v"))
    snap = fit.fit_dp(df, [fit.DPColumn("v", "text")], 8.0, 1e-6)
    frame = snap.released["v"]
    rare, kept = frame.agg(F.count_if(F.col("value").startswith("rare")), F.count_if(F.col("value").startswith("v"))).first()
    assert kept == 5000 and rare <= 20
    assert len(snap.columns["v"]["stats"]["top_values"]) == 30 and snap.columns["v"]["stats"]["other_count"] > 0
    assert frame.agg(F.sum("n")).first() == frame.agg(F.sum("n")).first()
    out = Generator(spark, [GenTable("g", 4000, (gen("v", "statistical", snapshot=snap),))]).run()["g"]
    assert out.where("v IS NULL").isEmpty() and out.distinct().count() > 2000
