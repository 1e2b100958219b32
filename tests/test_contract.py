"""Invariants of a correct run and the refusals."""

import uuid

import pytest
from pyspark.sql import functions as F

import tablecloak
from tablecloak import errors as E
from tablecloak.functions import expressions as X
from tablecloak.operators import checks, fit, presets, relations, scan, shape, subset, vault
from tablecloak.operators.generate import Generator, GenTable, Source, gen, generation_order, preview
from tablecloak.operators.masks import keep, mask_table, rule, unmask_status
from tablecloak.operators.relations import Link
from tablecloak.plans.registry import SECRET
from tablecloak.session import scratch_dir
from tablecloak.sources import readers, writers
from tablecloak.streaming import masking


def folder(spark):
    return f"{scratch_dir(spark)}/test-{uuid.uuid4().hex}"


def people(spark, n=300):
    """Every text cell carries a marker, so a leak is a substring; every seventh row is null."""
    mark = F.concat(F.lit("qm"), F.lpad(F.col("id").cast("string"), 9, "0"))
    return spark.range(n).select("id", *[F.when(F.col("id") % 7 != 0, x).alias(c) for c, x in {
        "name": F.concat(F.lit("Name "), mark), "note": mark, "code": F.lpad((F.col("id") * 7919).cast("string"), 9, "0"),
        "day": F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")}.items()])


RULES = [rule("id", "hash", "ids"), rule("name", "faker", "names", deterministic=True, provider="person_full_name"), rule("note", "redact"),
         rule("code", "fpe", "codes"), rule("day", "date_shift", "days", min_days=-30, max_days=30, date_format="%Y-%m-%d")]


def test_no_original_survives_and_nulls_stay(spark):
    src = people(spark)
    out = mask_table(src, RULES, SECRET, "people")
    assert out.columns == src.columns
    assert out.where(" or ".join(f"{c} like '%qm0%'" for c in out.columns)).count() == 0
    both = checks.check_policy(src.withColumn("k", F.col("id")), mask_table(src.withColumn("k", F.col("id")), [*RULES, *keep("k")], SECRET, "people"),
                               [*RULES, *keep("k")], ["k"])
    assert both.where("broken > 0").count() == 0
    assert out.where("name is null").count() == src.where("name is null").count()


def test_fpe_is_not_a_swap_of_its_own_inputs(spark):
    src = people(spark)
    out = mask_table(src, RULES, SECRET, "people")
    mine = src.select("code").join(out.select("code"), "code", "left_semi").count()
    assert mine < 0.9 * src.where("code is not null").count()


def test_namespaces_join_only_inside(spark):
    df = people(spark).select("id", F.col("id").alias("a"), F.col("id").alias("b"))
    out = mask_table(df, [rule("id", "hash", "x"), rule("a", "hash", "x"), rule("b", "hash", "y")], SECRET, "p")
    assert out.where("id <> a").count() == 0 and out.where("id = b").count() == 0


def test_refusals_name_no_value(spark):
    df = people(spark)
    cases = [(E.UndeclaredColumn, lambda: mask_table(df, [rule("id", "hash", "x")], SECRET)),
             (E.UndeclaredColumn, lambda: mask_table(df, [*RULES, rule("ghost", "redact")], SECRET)),
             (E.NamespaceRequired, lambda: rule("id", "hash")), (E.InvalidRule, lambda: rule("id", "scramble")),
             (E.InvalidRule, lambda: mask_table(df, [*RULES[:-1], rule("day", "date_shift", "d")], SECRET)),
             (E.NumberUsedAsText, lambda: X.check_text_operands(df, "id")),
             (E.CycleRefused, lambda: relations.table_order(["a", "b"], [Link("a", ("x",), "b", ("x",), "fail"), Link("b", ("x",), "a", ("x",), "fail")])),
             (E.CodecUnavailable, lambda: writers.write_csv(df, "/nowhere", compression="zst")),
             (E.InvalidRule, lambda: readers.read_database_table(spark, "jdbc:x", "t; drop table t")),
             (E.InvalidRule, lambda: readers.read_database_table(spark, "jdbc:x", "t", query="select 1")),
             (E.InvalidRule, lambda: readers.read_csv(spark, "/nowhere", has_header=False)),
             (E.InvalidRule, lambda: shape.shape(df, [shape.limit_rows(3)])), (E.InvalidRule, lambda: shape.shape(df, [shape.dedupe_rows()] * 33)),
             (E.PolicyFailed, lambda: presets.resolve_policy(presets.Policy(default="passthrough").forbid("passthrough", "column", "code"), "p", df.schema)),
             (E.InvalidRule, lambda: X.col("between"))]
    for kind, call in cases:
        with pytest.raises(kind) as e:
            call()
        assert "qm0" not in str(e.value) and kind.code in str(e.value)


def test_blank_logic_truth_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    v = X.col("v")
    got = [tuple(r) for r in df.select(X.ne(v, "a"), X.not_in(v, ["a"]), X.not_(X.eq(v, "a")), X.eq(v, "a"), X.if_(X.eq(v, "a"), 1, 2)).collect()]
    assert got == [(False, False, False, True, 1), (True, True, True, False, 2), (True, True, True, False, 2)]


def test_rows_in_equal_rows_out_plus_quarantined(spark):
    src = people(spark).withColumn("day", F.when(F.col("id") % 5 == 0, "2023-02-30").otherwise(F.col("day")))
    masked = mask_table(src, RULES, SECRET, "people", with_errors=True)
    clean, bad = checks.quarantine(masked, [checks.check("regex_match", "code", pattern="^[0-9]{9}$")])
    assert clean.count() + bad.count() == src.count() and bad.count() == 60
    assert clean.columns == src.columns
    with pytest.raises(E.InvalidRule):
        checks.write_quarantine(bad, folder(spark), max_rows=10)
    p = folder(spark)
    checks.write_quarantine(bad, p, SECRET)
    assert spark.read.text(p).where("value like '%qm0%'").count() == 0


def test_vault_outlives_a_key_change_and_misses_fail(spark):
    df = people(spark).select("id", "name")
    out, v = vault.tokenize(df, ["name"], "n", SECRET, vault.empty_vault(spark))
    again, grown = vault.tokenize(df.unionByName(spark.createDataFrame([(999, "new one")], "id long, name string")), ["name"], "n", bytes(range(1, 33)), v)
    assert out.join(again, ["id", "name"]).count() == out.where("name is not null").count()
    assert grown.count() == v.count() + 1
    back = vault.detokenize(again, ["name"], "n", grown)
    assert back.where("id <> 999").exceptAll(df).count() == 0
    with pytest.raises(E.VaultMiss):
        vault.detokenize(again, ["name"], "n", v)
    with pytest.raises(E.VaultMiss):
        vault.detokenize(out, ["name"], "other", v)
    p = folder(spark)
    vault.save_vault(v, p)
    assert vault.load_vault(spark, p).count() == v.count()
    with pytest.raises(E.VaultExists):
        vault.save_vault(v, p)


def test_composed_and_decomposed_text_share_a_token(spark):
    df = spark.createDataFrame([("é",), ("é",)], "v string")
    out, v = vault.tokenize(df, ["v"], "n", SECRET, vault.empty_vault(spark))
    assert out.distinct().count() == 1 and v.count() == 1


def test_sealed_vault_needs_its_secret(spark):
    src = people(spark).select("id", "name")
    masked = mask_table(src, [rule("name", "redact", when=F.col("id") < 0), *keep("id")], SECRET, "p").withColumn("name", F.concat(F.lit("m"), F.col("id").cast("string")))
    sealed = vault.vault_write(src, masked, ["id"], ["name"], "n", SECRET)
    wrong = vault.vault_read(masked, ["name"], "n", bytes(range(1, 33)), sealed)
    assert wrong.where("name_status = 'vault_reversed'").count() == 0 and wrong.count() == src.count()
    assert unmask_status(RULES) == {"id": "irreversible", "name": "irreversible", "note": "irreversible", "code": "reversed_unverified", "day": "irreversible"}


def test_orphan_policies(spark, t):
    parent = t.customer.where("c_custkey % 10 > 1")
    link = Link("customer", ("c_custkey",), "orders", ("o_custkey",), "fail", "c")
    with pytest.raises(E.OrphansFound):
        relations.mask_linked({"customer": parent.select("c_custkey"), "orders": t.orders.select("o_orderkey", "o_custkey")},
                              {"customer": [rule("c_custkey", "hash", "c")], "orders": keep("o_orderkey", "o_custkey")}, [link], SECRET)
    with pytest.raises(E.InvalidRule):
        Link("a", ("x",), "b", ("y",), "ignore")
    with pytest.raises(E.InvalidRule):
        relations.child_rules(link, [rule("c_custkey", "redact")])


def test_null_child_keys_are_not_orphans(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    child = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b"), (2, None)], "x int, y string")
    assert relations.orphan_count(parent, child, Link("p", ("x", "y"), "c", ("x", "y"), "warn")) == 1


def test_subset_has_no_dangling_key(spark, t):
    from tablecloak.plans.queries_relations import LINKS, WAYS, world
    tabs = world(t)
    out = subset.subset(tabs, subset.SubsetPlan((subset.Seed("lineitem", "sample", ("l_orderkey",), count=5),), LINKS, {**WAYS, ("customer", "orders"): "upward"}))
    for k in LINKS:
        assert relations.orphan_count(out[k.parent], out[k.child], k) == 0
    assert 0 < out["orders"].count() and out["region"].count() <= 5


def test_subset_loops_end(spark):
    """Departments have heads, employees have departments: a circle."""
    dept = spark.range(20).select(F.col("id").alias("d"), (F.col("id") * 5).alias("head"))
    emp = spark.range(100).select(F.col("id").alias("e"), (F.col("id") % 20).alias("dept"))
    links = (Link("dept", ("d",), "emp", ("dept",), "preserve"), Link("emp", ("e",), "dept", ("head",), "preserve"))
    plan = subset.SubsetPlan((subset.Seed("emp", "keys", ("e",), keys=(7,)),), links, {("dept", "emp"): "upward", ("emp", "dept"): "upward"})
    out = subset.subset({"dept": dept, "emp": emp}, plan)
    todo, emps, depts = [7], set(), set()
    while todo:
        e = todo.pop()
        if e not in emps:
            emps.add(e)
            depts.add(e % 20)
            todo.append((e % 20) * 5)
    assert {r.e for r in out["emp"].collect()} == emps and {r.d for r in out["dept"].collect()} == depts
    with pytest.raises(E.BudgetExceeded):
        subset.subset({"dept": dept, "emp": emp}, subset.SubsetPlan(plan.seeds, links, plan.directions, max_total_rows=1))


def test_generator_refusals(spark):
    three = GenTable("p", 3, (gen("id", "sequence", start=1),))
    ref = lambda **o: gen("r", "reference", reference_table="p", reference_column="id", **o)
    make = lambda n, *c, **o: Generator(spark, [three, GenTable("g", n, c, **o)]).run()["g"]
    for kind, call in [
        (E.UniquenessImpossible, lambda: make(4, ref(unique=True))), (E.UniquenessImpossible, lambda: make(4, gen("c", "categorical", categories=["a"], unique=True))),
        (E.InvalidRule, lambda: make(10, ref(min_per_parent=4))), (E.InvalidRule, lambda: make(10, ref(min_per_parent=1, max_per_parent=3))),
        (E.InvalidRule, lambda: make(3, gen("c", "categorical", categories=["a", "b"], weights=[0, 0]))),
        (E.InvalidRule, lambda: make(3, gen("c", "categorical", categories=["a", "b"], weights=[-1, 2]))),
        (E.CycleRefused, lambda: generation_order([GenTable("a", 1, (gen("r", "reference", reference_table="b", reference_column="x"),)),
                                                   GenTable("b", 1, (gen("x", "reference", reference_table="a", reference_column="r"),))])),
        (E.InvalidRule, lambda: preview([three], 5000)),
    ]:
        with pytest.raises(kind):
            call().count()
    with pytest.raises(E.InvalidRule):
        empty = Source(spark.range(0), ["id"])
        Generator(spark, [GenTable("g", 2, (gen("r", "reference", reference_table="e", reference_column="id"),))], {"e": empty}).run()
    assert {r["count"] for r in make(6, ref(min_per_parent=1, max_per_parent=3)).groupBy("r").count().collect()} <= {1, 2, 3}
    assert make(3, ref(unique=True)).distinct().count() == 3


def test_unique_together_uses_every_pair_once(spark):
    t = [GenTable("a", 6, (gen("id", "sequence", start=1),)), GenTable("b", 7, (gen("id", "sequence", start=1),)),
         GenTable("g", 42, tuple(gen(c, "reference", reference_table=c, reference_column="id") for c in ("a", "b")), (("a", "b"),))]
    assert Generator(spark, t).run()["g"].distinct().count() == 42


def test_fitted_children_keep_the_fan_out(spark):
    t = [GenTable("p", 500, (gen("id", "sequence", start=0),)),
         GenTable("g", 900, (gen("r", "reference", reference_table="p", reference_column="id", distribution="fitted", fanout={0: 1, 1: 2, 3: 1}),))]
    out = Generator(spark, t).run()["g"]
    assert out.count() == 900 and out.where("r is null or r < 0 or r >= 500").count() == 0


def test_fit_keeps_no_flagged_value_and_no_exact_extreme(spark):
    src = people(spark, 2000).withColumn("amount", F.col("id") * 1.37 + 3.21).withColumn("tier", F.when(F.col("id") % 100 == 0, "rare").otherwise("common"))
    snap = fit.fit(src, flagged=["tier"])
    assert snap.columns["tier"]["stats"]["top_values"] == [] and snap.redacted == ("tier",)
    assert snap.columns["amount"]["stats"]["max"] != pytest.approx(1999 * 1.37 + 3.21)
    assert "qm0" not in str(snap)
    plain = fit.fit(src.withColumn("tier", F.when(F.col("id") == 5, "solo").otherwise("common")))
    assert [v for v, _ in plain.columns["tier"]["stats"]["top_values"]] == ["common"]
    with pytest.raises(E.InvalidRule):
        fit.fit(src, joints=[("tier", "amount")], joint_cells=30)


def test_private_release(spark):
    df = spark.range(20_000).select((F.col("id") % 2 == 0).alias("flag"), F.when(F.col("id") == 3, "solo").otherwise("many").alias("v"), (F.col("id") % 100).alias("n"))
    cols = [fit.DPColumn("flag", "flag"), fit.DPColumn("v", "text"), fit.DPColumn("n", "number", 0, 100)]
    snap = fit.fit_dp(df, cols, 2.0, 1e-6)
    assert [v for v, _ in snap.columns["v"]["stats"]["top_values"]] == ["many"]
    assert sum(n for *_, n in snap.columns["n"]["stats"]["histogram"]) == pytest.approx(20_000, rel=0.05)
    with pytest.raises(E.InvalidRule):
        fit.fit_dp(df, cols[:2], 1.0, 1e-6)
    with pytest.raises(E.PrivacyBudget):
        fit.check_dp_budget([fit.Snapshot()], 1.0, 1e-6)


def test_stream_equals_batch_and_refuses_whole_columns(spark):
    p, out, cp = folder(spark), folder(spark), folder(spark)
    src = people(spark)
    src.repartition(5).write.parquet(p)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(p)
    masking.run_available(masking.mask_stream(stream, RULES, SECRET, "people"), out, cp)
    batch = mask_table(src, RULES, SECRET, "people")
    assert spark.read.parquet(out).exceptAll(batch).count() == 0 and spark.read.parquet(out).count() == batch.count()
    for call in (lambda: masking.check_streamable([rule("note", "shuffle")]), lambda: masking.check_streamable(RULES, quarantine=True)):
        with pytest.raises(E.NotStreamable):
            call()


def test_replayed_batch_changes_no_token(spark):
    root = folder(spark)
    v = masking.VaultTable(spark, root, "n", SECRET)
    a = spark.createDataFrame([("x",), ("y",)], "value string")
    v.add(a, 0)
    v.add(spark.createDataFrame([("y",), ("z",)], "value string"), 1)
    before = sorted(map(tuple, v.read().collect()))
    v.add(spark.createDataFrame([("y",), ("z",)], "value string"), 1)
    assert sorted(map(tuple, v.read().collect())) == before and len(before) == 3


def test_writers_refuse_what_they_cannot_keep(spark):
    layout = [readers.Field("a", 0, 3, "int"), readers.Field("b", 3, 2)]
    with pytest.raises(E.LossyWrite):
        writers.write_fixed_width(spark.createDataFrame([(1.5, "x")], "a double, b string"), folder(spark), layout)
    with pytest.raises(E.LossyWrite):
        writers.write_fixed_width(spark.createDataFrame([(1.0, "xyz")], "a double, b string"), folder(spark), layout)


def test_failed_publish_leaves_the_old_target(spark):
    target, other = folder(spark), folder(spark)
    good = spark.range(5)
    writers.publish_outputs(spark, {"a": good}, {"a": target})
    bad = spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):
        writers.publish_outputs(spark, {"a": spark.range(9), "b": bad}, {"a": target, "b": other})
    assert spark.read.parquet(target).count() == 5
    status = writers.publish_outputs(spark, {"a": spark.range(9), "b": bad}, {"a": target, "b": other}, delivery="best_effort")
    assert status == {"a": "published", "b": "failed"} and spark.read.parquet(target).count() == 9


def test_scan_frames_hold_no_value(spark):
    s = tablecloak.scan(people(spark), "people")
    assert "qm0" not in str(s.collect())
    assert scan.key_candidates(people(spark), sampled=True).count() == 0


def test_text_mask_refuses_odd_pairs_and_keeps_separators(spark):
    from tablecloak.operators.text import mask_text, redact_text
    with pytest.raises(E.InvalidRule):
        mask_text(F.lit("x"), b"k" * 32, {"ipv4": "fpe"})
    df = spark.createDataFrame([("call (415) 555-0101, mail a.b@example.com; ip 10.0.0.1. card 4111 1111 1111 1111 / 4111 1111 1111 1112",)], "v string")
    out = df.select(redact_text(F.col("v")), mask_text(F.col("v"), b"k" * 32, {"email": "redact", "ipv4": "redact"}, "redact", "#")).first()
    assert out[0] == "call [PHONE], mail [EMAIL]; ip [IP]. card [CARD] / 4111 1111 1111 1112"
    assert out[1] == "# (#) #-#, # [EMAIL]; # [IP]. # # # # # / # # # #"


def test_preserved_orphans_keep_their_key_through_a_chain(spark):
    a = spark.range(3).select(F.col("id").alias("a"))
    b = spark.createDataFrame([(10, 0), (11, 1), (12, 99)], "b long, a long")
    c = spark.createDataFrame([(1, 10, 0), (2, 12, 99), (3, 12, 1), (4, None, 0)], "c long, b long, a long")
    links = [Link("a", ("a",), "b", ("a",), "preserve", "a"), Link("b", ("b", "a"), "c", ("b", "a"), "preserve", "b")]
    out = relations.mask_linked({"a": a, "b": b, "c": c}, {"a": [rule("a", "hash", "a")], "b": [rule("b", "hash", "b"), *keep("a")], "c": keep("c", "b", "a")}, links, SECRET)
    got = {r.b_src: r.a for r in out["b"].join(b.select(F.col("a").cast("string").alias("x"), F.col("b").alias("b_src")), out["b"].a == F.col("x"), "left").collect()}
    assert out["b"].where("a = '99'").count() == 1 and out["b"].where("length(a) = 32").count() == 2 and got
    assert out["c"].join(out["b"], ["b", "a"], "left_semi").select("c").orderBy("c").collect() == [(1,), (2,)]
    assert out["c"].where("c = 3").first()["b"] == "12" and out["c"].where("c = 4").first()["b"] is None


def test_job_runs_end_to_end(spark, t):
    from tablecloak.plans.job import Job, MaskTable, run, validate
    target = {n: folder(spark) for n in ("customer", "orders", "extra")}
    job = Job(
        secret=SECRET, links=[Link("customer", ("c_custkey",), "orders", ("o_custkey",), "remap", "c")],
        masks={"customer": MaskTable(t.customer, [rule("c_custkey", "hash", "c"), rule("c_name", "faker", "names", vault=True, deterministic=True, provider="person_email"), *keep("c_nationkey", "c_acctbal")],
                                     [shape.drop_columns("c_mktsegment")]),
               "orders": MaskTable(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), keep("o_orderkey", "o_orderstatus"))},
        generates=[GenTable("extra", 25, (gen("id", "sequence", start=1), gen("cust", "reference", reference_table="customer", reference_column="c_custkey")))],
        subset=subset.SubsetPlan((subset.Seed("customer", "sample", ("c_custkey",), count=10),), (Link("customer", ("c_custkey",), "orders", ("o_custkey",), "preserve"),)),
        expects={"orders": [checks.check("column_in_set", "o_orderstatus", values=["O", "F"])]}, quarantine_path=folder(spark), vault_path=folder(spark), targets=target)
    r = run(spark, job)
    assert r.published == dict.fromkeys(target, "published") and r.outputs["customer"].count() == 10
    assert r.outputs["orders"].where("o_orderstatus = 'P'").count() == 0
    assert r.outputs["orders"].join(r.outputs["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti").count() == 0
    assert r.outputs["extra"].join(r.outputs["customer"], F.col("cust") == F.col("c_custkey"), "left_anti").count() == 0
    assert "Customer#" not in str(r.evidence.collect())
    back = vault.vault_read(r.outputs["customer"].select("c_custkey", "c_name"), ["c_name"], "names", SECRET, spark.read.parquet(f"{job.vault_path}/customer").withColumn("ns", F.lit("names")))
    assert back.where("c_name like 'Customer#%' and c_name_status = 'vault_reversed'").count() == 10
    with pytest.raises(E.InvalidRule):
        validate(Job(masks=job.masks))


def test_scan_of_several_tables_and_identifying_sets(spark, t):
    both = scan.scan_tables({"customer": t.customer, "nation": t.nation})
    assert {(r["table"], r["column"]) for r in both.collect()} >= {("customer", "c_name"), ("nation", "n_name")}
    sets = scan.quasi_identifiers(t.part, ["p_brand", "p_size", "p_type"])
    groups = scan.qi_groups(sets, 0.01)
    assert all(not set(a) < set(b) for a in groups for b in groups)


def test_unmask_reverses_only_with_the_right_secret(spark):
    from tablecloak.operators.masks import unmask_fpe
    src = people(spark).select("id", "code")
    rules = [rule("code", "fpe", "codes"), *keep("id")]
    out = mask_table(src, rules, SECRET, "p")
    assert unmask_fpe(out, rules, SECRET, "p").exceptAll(src).count() == 0
    wrong = unmask_fpe(out, rules, bytes(range(1, 33)), "p")
    assert wrong.where("code is null").count() == src.where("code is null").count()
    assert wrong.join(src, ["id", "code"], "left_semi").count() < 3
