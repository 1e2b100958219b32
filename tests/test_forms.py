"""Locales, pinned presets, spans of every kind."""

import pytest
from pyspark.sql import functions as F

from tablecloak.errors import InvalidRule
from tablecloak.functions import locales
from tablecloak.functions.providers import PROVIDERS, get_provider
from tablecloak.operators import presets
from tablecloak.operators.generate import Generator, GenTable, gen
from tablecloak.operators.masks import keep, mask_table, rule
from tablecloak.plans.registry import SECRET


@pytest.mark.parametrize("locale", sorted(locales.LOCALES))
def test_locales_write_their_own_forms(spark, locale):
    w = locales.LOCALES[locale]
    t = GenTable("g", 300, tuple(gen(c, "faker", faker_type=f, locale=locale) for c, f in (("name", "name"), ("city", "city"), ("zip", "zipcode"), ("phone", "phone_number"), ("all", "address"))))
    out = Generator(spark, [t]).run()["g"].collect()
    towns = {c.split(",")[0]: c.split(",")[1] for c in w.cities}
    assert {r["city"] for r in out} <= set(towns) and len({r["name"] for r in out}) > 60
    assert all(len(r["zip"]) == w.postal_digits and r["zip"].startswith(tuple(towns.values())) for r in out)
    assert all(len(r["phone"]) == len(w.phone) and r["phone"][:4] == w.phone[:4] for r in out)
    assert all(any(r["all"].endswith(f"{t}") and f" {t}" in r["all"] and z in r["all"] for t, z in towns.items()) for r in out)
    for name, (size, at) in locales.localized(locale).items():
        ids = [0, 1, size // 2, size - 1]
        got = spark.createDataFrame([(i,) for i in ids], "i bigint").select(at(F.col("i"))).collect()
        assert len({r[0] for r in got}) == len(set(ids)) and all(r[0] for r in got), name


def test_a_default_locale_and_kinds_without_words(spark):
    t = GenTable("g", 50, (gen("a", "faker", faker_type="first_name"), gen("b", "faker", faker_type="first_name", locale="fr_FR"), gen("c", "faker", faker_type="ssn")))
    out = Generator(spark, [t], default_locale="es_ES").run()["g"].collect()
    assert {r["a"] for r in out} <= set(locales.LOCALES["es_ES"].first) and {r["b"] for r in out} <= set(locales.LOCALES["fr_FR"].first)
    assert get_provider("ssn", locale="de_DE") is PROVIDERS["synthetic_ssn"] and get_provider("name", locale="en_US") is PROVIDERS["person_full_name"]
    with pytest.raises(InvalidRule):
        get_provider("name", locale="xx_XX")
    masked = mask_table(spark.createDataFrame([("Ada",)], "n string"), [rule("n", "faker", "x", deterministic=True, provider="person_last_name", locale="de_DE")], SECRET, "t").first()
    assert masked["n"] in locales.LOCALES["de_DE"].last


def test_presets_are_pinned():
    columns = ["full_name", "email", "zip", "other"]
    assert presets.preset_rules(presets.pinned("ccpa"), columns) == presets.preset_rules("ccpa", columns)
    assert [r.strategy for r in presets.preset_rules("ccpa@2026-06-28", columns)] == ["faker", "faker", "truncate", "redact"]
    for bad in ("ccpa@2020-01-01", "none@2026-06-28"):
        with pytest.raises(InvalidRule):
            presets.preset_rules(bad, columns)
    assert len({presets.preset_digest(n) for n in presets.PRESETS}) == len(presets.PRESETS)


def test_a_span_that_fails_its_check_is_text(spark):
    df = spark.createDataFrame([(1, "pay 4111 1111 1111 1112 to GB83WEST12345698765432"), (2, "pay 4111 1111 1111 1111 to DE89370400440532013000")], "k int, t string")
    how = {"pan": "redact", "iban": "redact"}
    hidden = mask_table(df, [rule("t", "text_mask", detectors=how, unmatched="redact"), *keep("k")], SECRET, "t")
    assert {r["k"]: r["t"] for r in hidden.collect()} == {1: "[TEXT] [TEXT] [TEXT] [TEXT] [TEXT] [TEXT] [TEXT]", 2: "[TEXT] [CARD] [TEXT] [IBAN]"}
    plain = mask_table(df, [rule("t", "text_mask", detectors=how), *keep("k")], SECRET, "t")
    assert {r["k"]: r["t"] for r in plain.collect()} == {1: "pay 4111 1111 1111 1112 to GB83WEST12345698765432", 2: "pay [CARD] to [IBAN]"}


@pytest.mark.parametrize("name", ["mask_fpe", "mask_fpe_checksum", "mask_fpe_ff1", "unmask_fpe", "mask_text_redact_kinds", "mask_text_mask_kinds"])
def test_dear_masks_of_a_small_file_have_many_tasks(spark, tmp_path, name):
    """One file of few bytes is one task to read; the masks must not run in it."""
    from tablecloak.plans.catalog import QUERIES
    spark.range(40).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and out.count() == 40


def test_spread_keeps_every_row(spark):
    from tablecloak.session import shuffle_partitions, spread
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "k long, t string")
    out = spread(df)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert out.rdd.getNumPartitions() == shuffle_partitions(spark)


def test_ff1_works_a_round_out_once(spark):
    """Every round is one call of the cipher, in the plan and so for each row."""
    from tablecloak.functions import ff1
    df = spark.createDataFrame([("0123456789",)], "t string")
    plan = df.select(ff1.ff1_text(F.col("t"), bytes(range(16))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("aesencrypt") == 1


def test_sets_of_columns_are_counted_by_their_cells(spark):
    """No text is made of the cells: kinds that read alike as text stay apart, and nulls are a class."""
    from tablecloak.operators import scan
    df = spark.createDataFrame([(["a, b"], 1.5, None), (["a", "b"], 1.5, None), (["a", "b"], 2.5, "x")], "l array<string>, d double, t string")
    base = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    got = scan.set_sizes(base, [["l"], ["d", "t"], []])
    assert {(r["at"], r["k"], r["classes"], r["rows"]) for r in got.collect()} == {(0, 1, 2, 3), (1, 1, 2, 3), (2, 3, 1, 3)}


def test_policy_check_works_the_output_out_once(spark):
    """The masked frame may cost much: each of its rows is made once, whatever the number of checks."""
    from tablecloak.operators import checks
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    src = spark.range(50).select("id", F.concat(F.lit("n"), "id").alias("a"), F.lpad(F.col("id").cast("string"), 8, "7").alias("b"), F.lit(None).alias("c"))
    rules = [rule("a", "hash", "x"), rule("b", "fpe", "y"), *keep("id", "c")]
    out = mask_table(src, rules, SECRET, "t").select("id", "a", "b").mapInArrow(count, "id long, a string, b string").withColumn("c", F.lit(None))
    got = checks.check_policy(src, out, rules, ["id"]).collect()
    assert {(r["column"], r["broken"]) for r in got} == {("*", 0), ("a", 0), ("b", 0), ("c", 0)}
    # once for the check of the keys and once for the rest
    assert made.value <= 100


def test_own_values_are_dealt_out(spark, tmp_path):
    from tablecloak.operators import checks
    spark.range(1000).select(F.col("id").cast("string").alias("v")).coalesce(1).write.parquet(f"{tmp_path}/one")
    df = spark.read.parquet(f"{tmp_path}/one")
    found = checks.own_values(df, df, ["v"])
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("v", 1000, 1000)]
