"""Exact distances, identifying sets of any size, and what a policy check has to see."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tablecloak.errors import InvalidRule
from tablecloak.operators import checks, joins, privacy, scan, singles
from tablecloak.operators.masks import keep, mask_table, rule
from tablecloak.plans.registry import SECRET


def brute(source, output, width):
    """By all pairs."""
    ends = [(min(r[i] for r in source if r[i] is not None), max(r[i] for r in source if r[i] is not None)) for i in range(width)]

    def at(r):
        return None if None in r else [((x - lo) / (hi - lo) if lo != hi else float(x != lo)) for x, (lo, hi) in zip(r, ends)]
    points = [p for p in map(at, source) if p]
    return {k: min(max(abs(a - b) for a, b in zip(at(r), p)) for p in points) for k, r in enumerate(output) if at(r)}


def pairs(spark, rows, width):
    names = [f"c{i}" for i in range(width)]
    return spark.createDataFrame([(k, *map(lambda v: None if v is None else float(v), r)) for k, r in enumerate(rows)], "k bigint, " + ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize("width, seed", [(1, 1), (2, 2), (2, 3), (3, 4), (4, 5)])
def test_distances_are_those_of_all_pairs(spark, width, seed, monkeypatch):
    """Clusters of every density, copies, records far outside, nulls, and both sides of a cell's border."""
    monkeypatch.setattr(privacy, "LEAF", 3)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    r = random.Random(seed)
    near = lambda s: [r.gauss(r.choice([0, 1, 1.001, 50]), s) for _ in range(width)]
    source = [near(r.choice([0, 1e-9, 0.01, 3])) for _ in range(300)] + [[7.0] * width] * 40 + [[None] + [1.0] * (width - 1), [0.0] * width, [100.0] * width]
    output = [near(r.choice([0, 1e-9, 0.5, 30])) for _ in range(120)] + source[:20] + [[None] * width, [50.0 - 1e-12] * width, [50.0 + 1e-12] * width, [-400.0] * width]
    got = {x["k"]: x["distance"] for x in privacy.closest_record(pairs(spark, source, width), pairs(spark, output, width), ["k"], [f"c{i}" for i in range(width)]).collect()}
    assert got == brute(source, output, width)


def test_records_closer_than_any_cell(spark, monkeypatch):
    """More records than a leaf holds share the finest cell: they are compared in pieces."""
    monkeypatch.setattr(privacy, "LEAF", 2)
    monkeypatch.setattr(privacy, "DEEPEST", 12)
    source = [[0.0], [1.0]] + [[0.5 + i * 1e-9] for i in range(40)]
    output = [[0.5 + 7.4e-9], [0.25], [0.5 + 1e-6]]
    got = {x["k"]: x["distance"] for x in privacy.closest_record(pairs(spark, source, 1), pairs(spark, output, 1), ["k"], ["c0"]).collect()}
    assert got == brute(source, output, 1)


def test_distances_of_awkward_tables(spark):
    one, none = pairs(spark, [[3.0, 5.0]] * 3, 2), pairs(spark, [], 2)
    got = privacy.closest_record(one, pairs(spark, [[3.0, 5.0], [3.0, 6.0], [None, 5.0]], 2), ["k"], ["c0", "c1"])
    assert sorted(tuple(x) for x in got.collect()) == [(0, 0.0), (1, 1.0)]
    assert privacy.closest_record(none, one, ["k"], ["c0", "c1"]).count() == 0 and privacy.closest_record(one, none, ["k"], ["c0", "c1"]).count() == 0
    with pytest.raises(InvalidRule):
        privacy.closest_record(one, one, ["k"], [])


def minimal(rows, names, share):
    """By every set."""
    def above(s):
        at = [tuple(r[names.index(c)] for c in s) for r in rows]
        return sum(at.count(x) == 1 for x in at) >= share * len(rows)
    good = [set(s) for n in range(len(names) + 1) for s in itertools.combinations(names, n) if above(s)]
    return sorted((tuple(sorted(s)) for s in good if not any(o < s for o in good)), key=lambda s: (len(s), s))


@pytest.mark.parametrize("share", [1.0, 0.5, 0.1])
def test_minimal_sets_are_those_of_every_set(spark, share):
    r = random.Random(3)
    names = ["a", "b,c", "d e", "f", "g", "h"]
    rows = [tuple(r.choice([None, 0, 1, 2]) if i else r.randrange(9) for i in range(6)) for _ in range(60)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names))
    assert scan.minimal_identifying_sets(df, names, share) == minimal(rows, names, share)


def test_a_planted_set_of_five_columns(spark):
    """Ten columns; five bits tell the rows apart together, no four of them and none of the others do."""
    bits = [F.col("id").bitwiseAND(1 << k).cast("boolean").cast("int").alias(f"bit{k}") for k in range(5)]
    df = spark.range(32).select(*bits, *[(F.lit(7) + k).alias(f"same{k}") for k in range(3)], (F.col("id") % 2).alias("odd, or not"), F.lit(None).cast("int").alias("none"))
    found = scan.minimal_identifying_sets(df, df.columns)
    assert found == [("bit0", "bit1", "bit2", "bit3", "bit4"), ("bit1", "bit2", "bit3", "bit4", "odd, or not")]


def test_trials_group_no_rows(spark, monkeypatch):
    """Rows are dealt out once, in many blocks; no trial groups them again."""
    monkeypatch.setattr(singles, "BLOCK_CELLS", 40)
    monkeypatch.setattr(scan, "set_sizes", None)
    r = random.Random(5)
    names = ["a", "b", "c", "d"]
    rows = [(r.randrange(200), r.randrange(60), r.choice([None, *range(30)]), r.randrange(25)) for _ in range(150)] * 2
    rows = rows[:-100]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    for share in (0.2, 0.3, 0.34):
        assert scan.minimal_identifying_sets(df, names, share) == minimal(rows, names, share)


@pytest.mark.parametrize("cells", [9, 100, 10**6])
def test_minimal_sets_over_blocks_of_any_size(spark, monkeypatch, cells):
    """Cells of every plain kind, equal ones written differently, rows that come twice, and columns that no block holds a value of."""
    monkeypatch.setattr(singles, "BLOCK_CELLS", cells)
    r = random.Random(cells)
    kinds = ["float", "double", "decimal(9,2)", "string", "binary", "date", "timestamp", "boolean", "bigint"]
    numbers = [(r.choice([None, *range(9)]), r.randrange(30), r.choice([None, *range(20)]), *[r.randrange(4) for _ in range(6)]) for _ in range(90)]
    numbers += numbers[:9]
    raw = spark.createDataFrame(numbers, ", ".join(f"x{i} int" for i in range(9)))
    made = [F.when(F.col("x0") == 3, float("nan")).when(F.col("x0") == 4, -0.0).when(F.col("x0") == 5, 0.0).otherwise(F.col("x0")), F.when(F.col("x1") == 7, float("nan")).otherwise(F.col("x1")),
            F.col("x2") / 2, F.concat(F.lit("\u00e9"), "x3"), F.col("x4").cast("string").cast("binary"), F.date_add(F.lit("1960-01-01").cast("date"), F.col("x5")),
            F.timestamp_seconds(F.col("x6") - 2), F.col("x7") == 0, F.col("x8")]
    names = [f"k{i}" for i in range(9)]
    df = raw.select(*[x.cast(k).alias(n) for x, k, n in zip(made, kinds, names)])
    plain = [(0 if n[0] in (4, 5) else n[0], *n[1:7], n[7] == 0, n[8]) for n in numbers]
    for share in (0.4, 0.75):
        assert scan.minimal_identifying_sets(df, names, share) == minimal(plain, names, share)


def test_sets_that_no_block_holds_are_grouped(spark, monkeypatch):
    """Two values a column, so none deals the rows out; and a list, which has no place in a block."""
    monkeypatch.setattr(singles, "BLOCK_CELLS", 20)
    bits = spark.range(32).select(*[F.col("id").bitwiseAND(1 << k).alias(f"b{k}") for k in range(5)], (F.col("id") % 2).alias("odd"))
    assert scan.minimal_identifying_sets(bits, bits.columns) == [("b0", "b1", "b2", "b3", "b4"), ("b1", "b2", "b3", "b4", "odd")]
    lists = spark.range(40).select(F.array(F.col("id") % 8).alias("l"), F.floor(F.col("id") / 8).alias("n"), (F.col("id") % 4).alias("q"))
    assert scan.minimal_identifying_sets(lists, lists.columns) == [("l", "n")]


def test_shares_of_more_combinations_than_a_number_holds(spark):
    """Five columns of thousands of values each: their product does not fit 64 bits."""
    cols = [F.floor(F.col("id") * p % 30011 / 2).alias(f"v{i}") for i, p in enumerate((1, 3, 7, 11, 13))]
    df = spark.range(30011).select(*cols, F.lit(1).alias("one"))
    base = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    found = singles.Singles(base, df.columns).shares([["v0"], df.columns[:5], df.columns, ["one"], []])
    want = [df.groupBy(*s).count().where("count = 1").count() / 30011 for s in (["v0"], df.columns[:5], df.columns)]
    assert found == [*want, 0.0, 0.0]


def test_blocks_of_long_texts_are_smaller(spark, monkeypatch):
    monkeypatch.setattr(singles, "BLOCK_BYTES", 1000)
    df = spark.range(50).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"), (F.col("id") % 5).alias("n"))
    found = singles.Singles(df.withColumn("__n", F.lit(1).cast("bigint")), df.columns)
    assert (found.blocks, found.most) == (2, 25) and found.shares([["t"], ["n"]]) == [1.0, 0.0]


def test_the_bound_of_batches_is_put_back(spark):
    was = spark.conf.get(singles.BATCH_BYTES)
    scan.minimal_identifying_sets(spark.range(9).select("id", (F.col("id") % 3).alias("m")), ["id", "m"])
    assert spark.conf.get(singles.BATCH_BYTES) == was


def test_cells_of_many_batches_share_their_codes():
    """Equal cells have one code in a block, whichever batch they come with; null and not-a-number are cells of their own."""
    import numpy as np
    import pyarrow as pa
    r = random.Random(2)
    cells = {"c0": [r.choice([None, 1.5, 2.5, float("nan")]) for _ in range(50)], "c1": [r.choice([None, "", "a", "b"]) for _ in range(50)],
             "c2": [r.choice([None, True, False]) for _ in range(50)], "c3": [None] * 50, "c4": list(range(49)) + [None]}
    kinds = {"c0": pa.float64(), "c1": pa.string(), "c2": pa.bool_(), "c3": pa.int32(), "c4": pa.int64()}
    t = pa.table({c: pa.array(v, kinds[c]) for c, v in cells.items()} | {"again": pa.array([False] * 50)})
    (block,) = singles._encoder(list(cells))(iter(t.to_batches(max_chunksize=7)))
    assert block.column("rows").to_pylist() == [50] and block.column("again").to_pylist() == [bytes(50)]
    for c, v in cells.items():
        codes = np.frombuffer(block.column(c)[0].as_py(), np.uint8).tolist()
        assert len(set(zip(codes, map(repr, v)))) == len(set(codes)) == len(set(map(repr, v)))
    counted = list(singles._counter([["c4"], ["c0", "c1"], []])(iter([block, block])))
    pairs_ = list(zip(map(repr, cells["c0"]), cells["c1"]))
    assert counted[0].column("alone").to_pylist() == [100, 2 * sum(pairs_.count(x) == 1 for x in pairs_), 0]


def test_rows_that_nothing_tells_apart(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    assert scan.minimal_identifying_sets(df, ["a", "b"]) == []
    assert scan.minimal_identifying_sets(df, ["a", "b"], 0.3) == [("a",), ("b",)]
    assert scan.minimal_identifying_sets(df, ["a", "b"], 0.0) == [()]
    assert scan.minimal_identifying_sets(df.limit(0), ["a"]) == [()]


def test_sets_of_columns_with_any_names(spark):
    """A name with a comma, and more columns than a grouping number has bits."""
    wide = [(F.col("id") % 2).alias(f"p{k}") for k in range(66)]
    df = spark.range(8).select((F.col("id") % 4).alias("a,b"), F.floor(F.col("id") / 4).alias("c"), *wide)
    assert scan.identifying_sets(df, ["a,b", "c", "p0"], 1.0) == [("a,b", "c")]
    two = {r["columns"]: (r["k"], r["classes"], r["rows"]) for r in scan.quasi_identifiers(df, ["a,b", "c", "p1", "p65"], 2).collect()}
    assert two["a,b,c"] == (1, 8, 8) and two["p1,p65"] == (4, 2, 8) and len(two) == 6
    base = df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count("*").alias("__n"))
    assert scan.singleton_shares(base, [df.columns, ["p65"]]) == {0: 1.0, 1: 0.0}


def test_many_columns_stop_by_themselves(spark):
    """Seventy columns, more than the bits of a number: two of them are keys, pairs of two others are, nothing else."""
    wide = [(F.col("id") % 2).alias(f"p{k}") for k in range(66)]
    df = spark.range(64).select("id", (F.col("id") * 3).alias("key"), F.floor(F.col("id") / 8).alias("row"), (F.col("id") % 8).alias("col"), *wide)
    assert scan.minimal_identifying_sets(df, df.columns) == [("id",), ("key",), ("col", "row")]


def moved(df, column, key):
    """The column moved down by one row."""
    rows = sorted(df.select(key, column).collect(), key=lambda r: r[key])
    cells = [r[column] for r in rows]
    new = df.sparkSession.createDataFrame([(r[key], c) for r, c in zip(rows, cells[-1:] + cells[:-1])], df.select(key, column).schema)
    return df.drop(column).join(new, key).select(*df.columns)


def test_a_rotated_column_is_no_mask(spark):
    src = spark.range(100).select("id", F.lpad((F.col("id") * 7919 + 10**9).cast("string"), 12, "0").alias("code"), F.concat(F.lit("n"), "id").alias("name"))
    rules = [rule("code", "fpe", "codes"), rule("name", "faker", "people", deterministic=True, provider="person_full_name"), *keep("id")]
    good = mask_table(src, rules, SECRET, "t")
    broken = lambda out: {r["column"]: r["broken"] for r in checks.check_policy(src, out, rules, ["id"]).collect()}
    assert broken(good) == {"*": 0, "code": 0, "name": 0, "id": 0} or broken(good) == {"*": 0, "code": 0, "name": 0}
    assert broken(moved(src, "code", "id").drop("name").join(good.select("id", "name"), "id"))["code"] == 100
    assert broken(moved(src, "name", "id").drop("code").join(good.select("id", "code"), "id"))["name"] == 100


def test_every_checked_strategy_sees_its_fault(spark):
    src = spark.range(60).select(
        "id", (F.col("id") * 1.5).alias("amount"), (F.col("id") % 7 * 10).cast("int").alias("income"), F.concat(F.lit("u"), "id").alias("login"),
        F.concat(F.lit("write to u"), "id", F.lit("@example.com or 4111 1111 1111 1111")).alias("note"), F.concat(F.lit("mail u"), "id", F.lit("@example.com")).alias("memo"),
        F.lit("2024-03-01").cast("date").alias("start"), F.lit("2024-03-05").cast("date").alias("stop"), F.lpad((F.col("id") % 3 + 10001).cast("string"), 5, "0").alias("zip"),
        F.element_at(F.array(F.lit("A1"), F.lit("A2"), F.lit("B1")), (F.col("id") % 3 + 1).cast("int")).alias("code"), F.col("id").cast("string").alias("price"))
    codes = spark.createDataFrame([("A1", "A"), ("A2", "A"), ("A3", "A"), ("B1", "B"), ("B2", "B")], "code string, chapter string")
    rules = [rule("amount", "bucket_perturb", "b", width=10), rule("income", "top_code", threshold=40), rule("login", "faker", "l", deterministic=True, provider="person_email", cardinality_mode="unique"),
             rule("note", "text_redact"), rule("memo", "text_mask", "m", detectors={"email": "fake"}), rule("stop", "windowed_date", anchor="start", min_days=1, max_days=9),
             rule("zip", "geo_generalize", k_threshold=5), rule("code", "code_set", "codes", codes=codes, chapter_preserve=True), rule("price", "shuffle", "p", deterministic=True), *keep("id", "start")]
    try:
        out = mask_table(src, rules, SECRET, "t", ["id"])
    except InvalidRule:
        rules[2] = rule("login", "unique_faker", "l", provider="person_email")
        out = mask_table(src, rules, SECRET, "t", ["id"])
    found = lambda o: {r["column"]: r["broken"] for r in checks.check_policy(src, o, rules, ["id"]).collect()}
    assert not any(found(out).values())
    third = F.col("id") % 3 == 0
    same = src.select("id", *[F.col(c).alias(f"was_{c}") for c in src.columns if c != "id"])
    bad = {"amount": F.col("amount") + 10, "income": F.lit(99), "note": F.col("was_note"), "memo": F.concat(F.lit("MAIL U"), "id", F.lit("@EXAMPLE.COM")),
           "stop": F.date_add("was_start", 30), "zip": F.lit("999"), "code": F.lit("Z9"), "price": F.lit("none")}
    faults = out.join(same, "id")
    for c, x in bad.items():
        faults = faults.withColumn(c, F.when(third, x.cast(out.schema[c].dataType)).otherwise(F.col(c)))
    got = found(faults.select(*out.columns))
    assert {c: got[c] for c in bad} == dict.fromkeys(bad, 20)
    with pytest.raises(InvalidRule):
        checks.check_policy(src, out, [*rules[:-2], rule("start", "formula", expression=F.lit(None).cast("date"))], ["id"])
    spared = checks.check_policy(src, out, [*rules[:-2], rule("start", "formula", expression=F.lit(None).cast("date"))], ["id"], ["start"])
    assert "start" not in {r["column"] for r in spared.collect()}
