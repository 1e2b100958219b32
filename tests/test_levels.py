"""The levelled vault of token streams."""

import uuid

import pytest
from pyspark.sql import functions as F

from tablecloak.operators.vault import token_of
from tablecloak.plans.registry import SECRET
from tablecloak.session import scratch_dir
from tablecloak.streaming.masking import VaultTable


@pytest.fixture
def vault(spark):
    return VaultTable(spark, f"{scratch_dir(spark)}/levels-{uuid.uuid4().hex}", "user", SECRET, fan=3)


def values(spark, names):
    return spark.createDataFrame([(n,) for n in names], "value string")


def test_many_batches_read_few_runs(spark, vault):
    """Every batch has values of its own and some of one earlier batch: it reads the runs that hold those, never all files."""
    batches, most = 45, 0
    for n in range(batches):
        old = [f"b{(n * 7) % max(n, 1)}-{k}" for k in range(3)] if n else []
        entries = vault.add(values(spark, [*[f"b{n}-{k}" for k in range(6)], *old, None]), n)
        got = {r["value"]: r["token"] for r in entries.collect()}
        assert set(old) <= set(got) and f"b{n}-5" in got
        alive = vault.runs(before=n + 1)
        assert len(alive) <= 2 * 5  # fan - 1 runs a level, levels grow with the logarithm
        most = max(most, len(vault.read_runs))
        assert sum(r.rows for r in alive) == 6 * (n + 1)
    assert most <= 2
    whole = vault.read()
    assert whole.count() == whole.select("value").distinct().count() == 6 * batches
    assert whole.where(F.col("token") != token_of(SECRET, "user", F.col("value"))).isEmpty()
    files = [f for r in vault.runs() for f in vault._open([r]).inputFiles()]
    assert len(files) == len(vault.runs()) < 12
    # what was merged is named for removal, nothing that a list still has is
    gone = vault.superseded()
    assert gone and not {r.name for r in vault.runs()} & set(gone)


def test_a_replayed_batch_changes_nothing(spark, vault):
    for n in range(5):
        vault.add(values(spark, [f"v{n}", "same"]), n)
    before = sorted(map(tuple, vault.read().collect()))
    runs = vault.runs()
    fresh = VaultTable(spark, vault.root, "user", SECRET, fan=3)   # a restarted writer
    fresh.add(values(spark, ["v4", "same"]), 4)
    assert sorted(map(tuple, fresh.read().collect())) == before and fresh.runs() == runs
    fresh.add(values(spark, ["v9"]), 5)
    assert {r["value"] for r in fresh.read().collect()} == {"same", "v9", *(f"v{n}" for n in range(5))}


def test_batches_without_values(spark, vault):
    assert vault.read().count() == 0 and vault.superseded() == []
    vault.add(values(spark, [None]), 0)
    vault.add(values(spark, []), 1)
    assert vault.runs() == [] and vault.read().count() == 0
    vault.add(values(spark, ["x"]), 2)
    assert [r["value"] for r in vault.read().collect()] == ["x"]


def test_filters_hold_what_was_put_in(spark, vault):
    vault.add(values(spark, [f"in{k}" for k in range(3000)]), 0)
    runs = vault.runs()
    assert vault.holding(values(spark, ["in2999"]), runs) == runs and vault.holding(values(spark, [None]), runs) == []
    out = sum(bool(vault.holding(values(spark, [f"out{k}"]), runs)) for k in range(12))
    assert out <= 2
