"""Masks on streams. A cell's mask depends on the cell alone, so a stream gives the bytes a batch would; no state
and no watermark are needed. Strategies that need the whole column are refused before anything starts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..errors import NotStreamable
from ..operators.masks import STREAMABLE, Rule, mask_table
from ..operators.vault import VAULT_SCHEMA, normalized


def check_streamable(rules: Sequence[Rule], row_key: Sequence[str] = (), subset: bool = False, quarantine: bool = False,
                     integrity: bool = False) -> None:
    whole = sorted({r.strategy for r in rules if r.strategy not in STREAMABLE})
    if whole:
        raise NotStreamable(f"needs the whole column: {', '.join(whole)}")
    for name, on in (("subset", subset), ("quarantine", quarantine), ("integrity", integrity)):
        if on:
            raise NotStreamable(f"{name} does not run on a stream")


def mask_stream(stream: DataFrame, rules: Sequence[Rule], secret: bytes, table: str, row_key: Sequence[str] = ()) -> DataFrame:
    check_streamable(rules, row_key)
    return mask_table(stream, rules, secret, table, row_key)


def run_available(masked: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything there is now to a Parquet folder, exactly once."""
    q = masked.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


FAN = 4                # runs of a level that are merged to one of the next
FILTER_BITS = 1 << 17  # of a run's Bloom filter; beyond some ten thousand values it lets most batches through
FILTER_HASHES = 4
BUCKET = 1 << 15       # bits of one bitmap of Spark's
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Run:
    """A written part of the vault: the entries of batches ``first`` to ``last``."""

    name: str
    level: int
    first: int
    last: int
    rows: int
    low: int      # of the hashes of its values
    high: int
    bits: bytes   # Bloom filter


RUN_SCHEMA = "name string, level int, first bigint, last bigint, rows bigint, low bigint, high bigint, bits binary"


class VaultTable:
    """A growing vault in levels, under ``root``.

    A batch writes the entries the vault lacks as a run of level 0. ``FAN`` runs of a level are merged to one of the next, so there
    are at most ``FAN - 1`` a level and an entry is rewritten once a level. A run is in files by ranges of the hashes of
    its values, and is known with their range and a Bloom filter; a batch reads only the runs that can hold one of its values.

    The runs alive after a batch are listed in a manifest of that batch. Names of runs follow from batch numbers, so a replayed batch
    writes the same runs and the same list again, which is a no-op for readers. Runs that were merged stay until they are removed by
    whoever owns the folder: ``superseded`` names those that neither of the last two lists has. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, ns: str, secret: bytes, fan: int = FAN):
        self.spark, self.root, self.ns, self.secret, self.fan = spark, root.rstrip("/"), ns, secret, fan
        self._known: dict[int, list[Run]] = {}
        self.read_runs: list[str] = []  # those that the last batch looked into

    # ---- lists of runs

    def _lists(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{RUN_SCHEMA}, batch bigint").parquet(f"{self.root}/lists")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs alive after the last batch, or after the last one before a batch. A list is a few rows."""
        if before is not None and before - 1 in self._known:
            return self._known[before - 1]
        lists = self._lists()
        if lists is None:
            return []
        if before is not None:
            lists = lists.where(F.col("batch") < before)
        last = lists.agg(F.max("batch")).first()[0]
        if last is None:
            return []
        rows = lists.where((F.col("batch") == last) & F.col("name").isNotNull()).drop("batch").collect()
        return sorted((Run(**{**r.asDict(), "bits": bytes(r["bits"])}) for r in rows), key=lambda r: r.first)

    def superseded(self) -> list[str]:
        """Names of runs that only lists before the last two have."""
        lists = self._lists()
        if lists is None:
            return []
        kept = [r["batch"] for r in lists.select("batch").distinct().orderBy(F.desc("batch")).limit(2).collect()]
        alive = lists.where(F.col("batch").isin(kept)).select("name")
        return sorted(r["name"] for r in lists.where("name IS NOT NULL").select("name").distinct().join(alive, "name", "left_anti").collect())

    # ---- entries

    def _open(self, runs: Sequence[Run]) -> DataFrame:
        schema = T.StructType([*VAULT_SCHEMA.fields, T.StructField("h", T.LongType())])
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/runs/{r.name}" for r in runs])

    def read(self, before: int | None = None) -> DataFrame:
        return self._open(self.runs(before)).select("ns", "value", "token")

    def _write(self, entries: DataFrame, name: str, level: int, first: int, last: int, rows: int) -> Run | None:
        """Write a run and measure it; None for one without entries."""
        path = f"{self.root}/runs/{name}"
        files = max(1, -(-rows // FILE_ROWS))
        entries.repartitionByRange(files, "h").sortWithinPartitions("h").write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(T.StructType([*VAULT_SCHEMA.fields, T.StructField("h", T.LongType())])).parquet(path)
        ends = written.agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).first()
        if not ends["n"]:
            return None
        places = written.select(F.explode(F.array(*_places(F.col("value")))).alias("p"))
        maps = {r["b"]: bytes(r["m"]) for r in places.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("m")).collect()}
        bits = b"".join(maps.get(b + 1, b"").ljust(BUCKET // 8, b"\0") for b in range(FILTER_BITS // BUCKET))
        return Run(name, level, first, last, ends["n"], ends["low"], ends["high"], bits)

    def holding(self, values: DataFrame, runs: Sequence[Run]) -> list[Run]:
        """The runs that can hold one of the values: some hash in the run's range whose places are all set in its filter."""
        if not runs:
            return []
        asked = values.select(F.col("value"), F.xxhash64("value").alias("h"))
        hits = [F.max(F.col("h").between(r.low, r.high) & _may_hold(F.lit(r.bits), F.col("value"))).alias(f"r{i}") for i, r in enumerate(runs)]
        found = asked.where("value IS NOT NULL").agg(*hits).first()
        return [r for i, r in enumerate(runs) if found[f"r{i}"]]

    def add(self, values: DataFrame, batch: int) -> DataFrame:
        """Give the values of a batch that the vault lacks their tokens; returns the entries of all its values' runs."""
        from ..operators.vault import new_entries
        alive = self.runs(before=batch)
        held = self.holding(values, alive)
        self.read_runs = [r.name for r in held]
        known = self._open(held).select("ns", "value", "token")
        fresh = new_entries(values, known, self.ns, self.secret).withColumn("h", F.xxhash64("value"))
        new = self._write(fresh, f"l0-{batch}", 0, batch, batch, 1)
        after = [*alive, *([new] if new else [])]
        entries = self._open([*held, *([new] if new else [])]).select("ns", "value", "token")
        while True:
            full = next((v for v in sorted({r.level for r in after}) if sum(r.level == v for r in after) >= self.fan), None)
            if full is None:
                break
            parts = [r for r in after if r.level == full]
            first, last = min(r.first for r in parts), max(r.last for r in parts)
            merged = self._write(self._open(parts), f"l{full + 1}-{first}-{last}", full + 1, first, last, sum(r.rows for r in parts))
            after = [r for r in after if r not in parts] + [merged]
        rows = [tuple(vars(r).values()) for r in after] or [(None,) * 8]
        self.spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/lists/batch={batch}")
        self._known = {batch: sorted(after, key=lambda r: r.first)}
        return entries


def _places(value: Column) -> list[Column]:
    """Bits of a value in a Bloom filter."""
    return [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(FILTER_BITS)) for k in range(FILTER_HASHES)]


def _may_hold(bits: Column, value: Column) -> Column:
    def one(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (p % 8).cast("int")).bitwiseAND(1) == 1
    return reduce(lambda a, b: a & b, [one(p) for p in _places(value)])


def tokenize_stream(stream: DataFrame, column: str, vault: VaultTable, path: str, checkpoint: str) -> StreamingQuery:
    """Per batch: add the values the vault lacks, then write tokens. Both writes are keyed by the batch number, so a
    replay changes nothing."""
    def each(batch: DataFrame, number: int) -> None:
        norm = normalized(batch, [column])
        entries = vault.add(norm.select(F.col(column).alias("value")), number)
        from ..operators.joins import lookup_join
        pairs = entries.where(F.col("ns") == vault.ns).select(F.col("value").alias(column), F.col("token").alias("__t"))
        out = lookup_join(norm, pairs, [column]).select(*[F.col("__t").alias(c) if c == column else F.col(c) for c in batch.columns])
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


__all__ = ["VaultTable", "check_streamable", "mask_stream", "run_available", "tokenize_stream"]
