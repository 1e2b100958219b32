"""Faults that earlier versions had: joined texts that collide, lost rows, patterns, rounding, publishing."""

import uuid

import pytest
from pyspark.sql import functions as F

from tablecloak import errors as E
from tablecloak.functions import expressions as X
from tablecloak.keys import row_message
from tablecloak.operators import checks, evidence, presets, shape, subset, vault
from tablecloak.operators.masks import keep, mask_table, rule
from tablecloak.operators.relations import Link
from tablecloak.plans.registry import SECRET
from tablecloak.session import scratch_dir
from tablecloak.sources import writers


def test_row_messages_differ_whatever_the_cells_hold(spark):
    cells = [("a|b", "c"), ("a", "b|c"), (None, "1:a"), ("-", "1:a"), ("1:a", None), ("", ""), (None, None), ("\\N", "c"), ("1:", ":a")]
    df = spark.createDataFrame(cells, "x string, y string")
    assert df.select(row_message(F.col("x"), F.col("y")).alias("m")).where("m is not null").distinct().count() == len(cells)
    one, two = (spark.createDataFrame([r], "x string, y string") for r in cells[:2])
    assert evidence.content_hash(one).first()["content_hash"] != evidence.content_hash(two).first()["content_hash"]


def test_floor_division_is_exact(spark):
    pairs = [(7, 2), (-7, 2), (7, -2), (-7, -2), (2**53 + 1, 1), (2**62 + 1, 3), (-(2**62) - 1, 3), (2**62 - 1, 2**61), (0, 5), (3 * 2**60 - 1, 2**60)]
    got = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", X.floor_div(F.col("a"), F.col("b")).alias("q")).collect()
    assert all(r.q == r.a // r.b for r in got)
    halves = spark.createDataFrame([(7.5, 2.0), (-7.5, 2.0)], "a double, b double")
    assert [r.q for r in halves.select(X.floor_div(F.col("a"), F.col("b")).alias("q")).collect()] == [3, -4]
    assert spark.range(1).select(X.floor_div(F.col("id"), 0).alias("q")).first().q is None


def test_policy_patterns_stand_for_themselves(spark):
    facts = {"t.col"}
    assert presets._matches("t.col", facts) and presets._matches("t.*", facts) and presets._matches("*", facts)
    assert not presets._matches("tXcol", facts) and not presets._matches("t.co", facts) and not presets._matches("t?col", facts)


def test_limit_after_steps_between(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("g"))
    got = shape.shape(df, [shape.sort_rows("id", ascending=False), shape.filter_rows(F.col("g") == 3), shape.derive_column("x", F.lit(1)), shape.limit_rows(3)])
    assert sorted(r.id for r in got.collect()) == [80, 87, 94]


def test_two_links_of_one_pair_have_their_own_directions(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "p bigint")
    orders = spark.createDataFrame([(10, 1, 2), (11, 3, 1)], "o bigint, bill bigint, ship bigint")
    bill = Link("people", ("p",), "orders", ("bill",), "preserve")
    ship = Link("people", ("p",), "orders", ("ship",), "preserve")
    plan = subset.SubsetPlan((subset.Seed("people", "filter", where=(("p", "eq", 1),)),), (bill, ship), {
        ("people", ("p",), "orders", ("bill",)): "both", ("people", ("p",), "orders", ("ship",)): "upward"}, {"people": ("p",), "orders": ("o",)})
    out = subset.subset({"people": people, "orders": orders}, plan)
    assert {r.o for r in out["orders"].collect()} == {10} and {r.p for r in out["people"].collect()} == {1, 2}


def test_strict_publish_rolls_back(spark, monkeypatch):
    root = f"{scratch_dir(spark)}/publish-{uuid.uuid4().hex}"
    targets = {n: f"{root}/{n}" for n in "abc"}
    writers.publish_outputs(spark, {n: spark.range(1) for n in "abc"}, targets)
    real = writers._fs

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, old, new):
            return False if "staging" in str(old) and str(new).endswith("/c") else self.fs.rename(old, new)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(writers, "_fs", lambda s, p: (lambda fs, path: (Broken(fs), path))(*real(s, p)))
    with pytest.raises(OSError):
        writers.publish_outputs(spark, {n: spark.range(5) for n in "abc"}, targets)
    assert [spark.read.parquet(targets[n]).count() for n in "abc"] == [1, 1, 1]
    status = writers.publish_outputs(spark, {n: spark.range(5) for n in "abc"}, targets, delivery="best_effort")
    assert status == {"a": "published", "b": "published", "c": "failed"}
    assert [spark.read.parquet(targets[n]).count() for n in "abc"] == [5, 5, 1]


def test_checks_see_lost_rows_and_refuse_repeated_keys(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k bigint, v string")
    out = mask_table(src, [rule("v", "redact"), *keep("k")], SECRET, "t")
    assert [r.ok for r in checks.leak_check(src, out, ["k"], ["v"]).collect()] == [True]
    lost = checks.leak_check(src, out.where("k IS NOT NULL"), ["k"], ["v"]).first()
    assert lost.lost == 1 and not lost.ok
    with pytest.raises(E.InvalidRule):
        checks.leak_check(src.union(src), out, ["k"], ["v"])


def test_shuffle_keeps_every_cell_of_a_table_with_a_null_key(spark):
    src = spark.createDataFrame([(1, 10), (2, 20), (None, 30), (4, None)], "k bigint, v bigint")
    out = mask_table(src, [rule("v", "shuffle", "n", deterministic=True), *keep("k")], SECRET, "t", ["k"])
    assert sorted((r.v for r in out.collect() if r.v is not None)) == [10, 20, 30]
    assert [r.v for r in out.where("k = 4").collect()] == [None]


def test_tokens_of_forms_that_normalise_alike(spark):
    df = spark.createDataFrame([("é", "x"), ("é", "é"), (None, "x")], "a string, b string")
    out, grown = vault.tokenize(df, ["a", "b"], "n", SECRET, vault.empty_vault(spark))
    assert grown.count() == 2
    got = out.collect()
    assert got[0].a == got[1].a == got[1].b and got[2].a is None and got[0].b == got[2].b


def test_vault_refuses_rows_it_could_not_reverse(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k bigint, v string")
    masked = src.select("k", F.concat(F.lit("m"), "v").alias("v"))
    sealed = vault.vault_write(src, masked, ["k"], ["v"], "n", SECRET)
    back = vault.vault_read(masked, ["v"], "n", SECRET, sealed)
    assert sorted((r.v, r.v_status) for r in back.collect()) == [("a", "vault_reversed"), ("b", "vault_reversed"), ("c", "vault_reversed")]
    with pytest.raises(E.VaultMiss):
        vault.vault_write(src, masked.where("k = 1"), ["k"], ["v"], "n", SECRET)
    with pytest.raises(E.InvalidRule):
        vault.vault_write(src.union(src), masked, ["k"], ["v"], "n", SECRET)


def test_aggregates_of_a_masked_table_take_one_pass(spark):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("x"))
    rules = [rule("top", "derived_aggregate", op="max", of="x"), rule("n", "derived_aggregate", op="count", of="x"), rule("low", "derived_aggregate", op="min", of="id"),
             rule("most", "derived_aggregate", op="max", of="top"), *keep("id", "x")]
    out = mask_table(df, rules, SECRET, "t", unconfigured="warn")
    assert out.select("top", "n", "low", "most").distinct().collect() == [(98, 50, 0, 98)]
    three = mask_table(df, [*rules[:3], *keep("id", "x")], SECRET, "t", unconfigured="warn")._jdf.queryExecution().optimizedPlan().toString()
    assert three.count("Aggregate [") <= 3


def test_kinds_are_counted(spark):
    from tablecloak.operators import fit
    df = spark.range(400).select((F.col("id") % 30).cast("string").alias("few"), (F.col("id") % 31).cast("string").alias("many"), F.lit(None).cast("string").alias("none"))
    assert fit.column_kinds(df) == {"few": "categorical", "many": "freetext", "none": "categorical"}


def _staff(spark, parents):
    return spark.createDataFrame([(i, p, f"e{i}") for i, p in enumerate(parents)], "id bigint, boss bigint, name string").repartition(3)


def _reach(parents, seeds, way):
    """Step by step."""
    up, down = way in ("both", "upward"), way in ("both", "downward")
    alive, todo = set(seeds), [(s, "seed") for s in seeds]
    while todo:
        x, how = todo.pop()
        if up and how != "down" and parents[x] is not None and parents[x] < len(parents) and parents[x] not in alive:
            alive.add(parents[x])
            todo.append((parents[x], "up"))
        if down:
            for c, p in enumerate(parents):
                if p == x and c not in alive:
                    alive.add(c)
                    todo.append((c, "down"))
    return alive


@pytest.mark.parametrize("way", ["both", "downward", "upward"])
def test_self_references_are_followed_by_doubling(spark, way):
    import random
    r = random.Random(5)
    forest = [None if i % 17 == 0 else r.choice([i - 1, r.randrange(i), i - 1]) if i else None for i in range(140)]
    forest[40], forest[41], forest[90] = 41, 40, 999   # a circle, and a parent that is not there
    link = Link("staff", ("id",), "staff", ("boss",), "preserve")
    for seeds in ([139], [60, 61], [40]):
        plan = subset.SubsetPlan((subset.Seed("staff", "keys", ("id",), keys=tuple((s,) for s in seeds)),), (link,), {("staff", "staff"): way}, {"staff": ("id",)})
        got = subset.subset({"staff": _staff(spark, forest)}, plan)["staff"]
        assert {x.id for x in got.collect()} == _reach(forest, seeds, way)


def test_a_chain_of_a_thousand_takes_few_rounds(spark):
    chain = [None, *range(999)]
    link = Link("staff", ("id",), "staff", ("boss",), "preserve")
    for seed, way in ((999, "upward"), (0, "downward")):
        plan = subset.SubsetPlan((subset.Seed("staff", "keys", ("id",), keys=((seed,),)),), (link,), {("staff", "staff"): way}, {"staff": ("id",)})
        closure = subset.close({"staff": _staff(spark, chain)}, plan)
        assert closure.surviving["staff"].count() == 1000 and closure.rounds <= 14
        assert closure.edges[0]["rows_added_upward" if way == "upward" else "rows_added_downward"] == 999


def test_keys_with_several_parents_go_step_by_step(spark):
    """Two rows of one key with different parents: no single pointer leads on."""
    rows_ = [(1, None), (2, 1), (2, 3), (3, None), (4, 2)]
    df = spark.createDataFrame(rows_, "id bigint, boss bigint")
    plan = subset.SubsetPlan((subset.Seed("t", "keys", ("id",), keys=((4,),)),), (Link("t", ("id",), "t", ("boss",), "preserve"),), {("t", "t"): "upward"}, {})
    assert sorted(x.id for x in subset.subset({"t": df}, plan)["t"].collect()) == [1, 2, 2, 3, 4]
