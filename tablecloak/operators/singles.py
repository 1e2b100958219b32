"""Rows that are alone in their class, for many sets of columns over the same rows.

The rows are dealt out once by a column that no value fills (the pivot), into blocks that hold whole classes of every set with that
column. A block is one row of a written table: per column, the places of its cells in the block's own list of values. A trial of any
number of sets then reads the columns it needs and counts in the blocks, without a shuffle. Codes are exact, no digest of a cell is taken.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .fit import union_all

# Cells of a block, and bytes of the texts in it: what a task holds at once.
BLOCK_CELLS, BLOCK_BYTES = 2_000_000, 64 << 20
COLUMNS_AT_ONCE = 64
# Kinds whose cells are the same to Arrow exactly where they are the same to a grouping.
PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BinaryType,
         T.DateType, T.TimestampType, T.TimestampNTZType)
TEXTS = (T.StringType, T.BinaryType)
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_setting = Lock()


def _plain(kind: T.DataType) -> bool:
    return isinstance(kind, PLAIN) or kind == T.StringType()


@contextmanager
def _batches_by_rows(spark: SparkSession, kinds: Sequence[T.DataType]):
    """Without a bound in bytes for batches of cells of fixed width, which their number of rows bounds: Spark works the bytes out
    anew for each row, which takes three times as long as to hand the row over."""
    if any(isinstance(k, TEXTS) for k in kinds):
        yield
        return
    with _setting:
        was = spark.conf.get(BATCH_BYTES, None)
        spark.conf.set(BATCH_BYTES, str(2**31 - 1))
        try:
            yield
        finally:
            spark.conf.unset(BATCH_BYTES) if was is None else spark.conf.set(BATCH_BYTES, was)


class Singles:
    """``base`` is a written frame with a row count ``__n`` (1 or more) for each combination of ``columns``, as a grouping gives it.

    Where the combinations fill more than a block, the values of each column are counted first. A column of which a value has more
    combinations than a block is no pivot; sets without a pivot, and all sets where a column is of another kind than ``PLAIN`` or
    plain text, are left to the caller (``None``). A written table a pivot, of the columns that can be needed with it; it is made
    when a set asks for it.
    """

    def __init__(self, base: DataFrame, columns: Sequence[str]):
        self.columns = list(columns)
        self.base = base.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.columns)], "__n")
        self.plain = all(_plain(f.dataType) for f in self.base.drop("__n").schema)
        n = F.col("__n")
        texts = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in self.base.schema if isinstance(f.dataType, TEXTS)]
        r = self.base.agg(F.count("*").alias("combinations"), F.sum(n).alias("rows"), F.count_if(n == 1).alias("alone"),
                          sum(texts, F.lit(0).cast("bigint")).alias("bytes")).first()
        self.combinations, self.rows, self.alone = r["combinations"], r["rows"] or 0, r["alone"]
        self.blocks = max(1, -(-self.combinations * len(self.columns) // BLOCK_CELLS), -(-r["bytes"] // BLOCK_BYTES))
        self.most = -(-self.combinations // self.blocks)
        self.values: dict[int, int] = {}
        self.pivots: list[int] = []
        self.laid: dict[int | None, DataFrame] = {}
        if self.blocks > 1:
            self._count_values()

    def _count_values(self) -> None:
        fullest = {}
        for a in range(0, len(self.columns), COLUMNS_AT_ONCE):
            each = [self.base.groupBy(f"c{i}").agg(F.count("*").alias("n")).agg(F.lit(i).alias("at"), F.count("*").alias("values"), F.max("n").alias("fullest"))
                    for i in range(a, min(a + COLUMNS_AT_ONCE, len(self.columns)))]
            for r in union_all(each).collect():
                self.values[r["at"]], fullest[r["at"]] = r["values"], r["fullest"]
        self.pivots = sorted((i for i, n in fullest.items() if n <= self.most), key=lambda i: (fullest[i], i))

    def at_most(self, columns: Sequence[str]) -> float:
        """A bound of the share, without counting: there are no more classes than the columns' values allow."""
        if not self.rows or not self.values:
            return 1.0
        classes = 1
        for c in columns:
            classes *= self.values[self.columns.index(c)]
        return min(classes, self.rows) / self.rows

    def shares(self, sets: Sequence[Sequence[str]]) -> list[float | None]:
        """By set: the share of rows that are alone in their class, 1 where there are no rows."""
        if not self.rows:
            return [1.0] * len(sets)
        places = [frozenset(self.columns.index(c) for c in s) for s in sets]
        out: list[float | None] = [self.alone / self.rows if len(p) == len(self.columns) else None for p in places]
        todo: dict[int | None, list[int]] = {}
        for k, p in enumerate(places):
            pivot = next((i for i in self.pivots if i in p), None)
            if out[k] is None and self.plain and (self.blocks == 1 or pivot is not None):
                todo.setdefault(pivot, []).append(k)
        for pivot, ks in todo.items():
            for k, alone in zip(ks, self._alone(pivot, [sorted(places[k]) for k in ks])):
                out[k] = alone / self.rows
        return out

    def _laid(self, pivot: int | None) -> DataFrame:
        if pivot not in self.laid:
            # a set with a pivot that comes before is counted by that one
            before = self.pivots[:self.pivots.index(pivot)] if pivot is not None else []
            names = [f"c{i}" for i in range(len(self.columns)) if i not in before]
            by = [] if pivot is None else [F.col(f"c{pivot}")]
            dealt = self.base.select(*names, (F.col("__n") > 1).alias("again")).repartition(self.blocks, *by)
            kinds = "rows bigint, again binary, " + ", ".join(f"{c} binary" for c in names)
            with _batches_by_rows(self.base.sparkSession, [f.dataType for f in dealt.schema]):
                self.laid[pivot] = materialize(dealt.mapInArrow(_encoder(names), kinds), "blocks")
        return self.laid[pivot]

    def _alone(self, pivot: int | None, sets: Sequence[Sequence[int]]) -> list[int]:
        names = [f"c{i}" for i in sorted({i for s in sets for i in s})]
        counted = self._laid(pivot).select("rows", "again", *names).mapInArrow(_counter([[f"c{i}" for i in s] for s in sets]), "at int, alone bigint")
        found = {r["at"]: r["alone"] for r in counted.groupBy("at").agg(F.sum("alone").alias("alone")).collect()}
        return [found[k] for k in range(len(sets))]


# Tasks get these functions by value.
def _encoder(names: Sequence[str]):
    def encode(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        cells = [pa.array([t.num_rows], pa.int64()), pa.array([t.column("again").combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary())]
        for name in names:
            # one list of values for all batches; a null is a value of its own, after the others
            parts = t.column(name).dictionary_encode().unify_dictionaries().chunks
            codes = np.concatenate([np.asarray(p.indices.fill_null(len(p.dictionary))) for p in parts])
            cells.append(pa.array([codes.astype(np.min_scalar_type(int(codes.max()))).tobytes()], pa.binary()))
            t = t.drop_columns([name])
        yield pa.RecordBatch.from_arrays(cells, names=["rows", "again", *names])
    return encode


def _counter(sets: Sequence[Sequence[str]]):
    def count(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        alone = [0] * len(sets)
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column("rows")[k].as_py()
                again = np.frombuffer(batch.column("again")[k].as_buffer(), np.uint8) != 0
                codes = {}
                for c in {c for s in sets for c in s}:
                    cells = batch.column(c)[k].as_buffer()
                    codes[c] = np.frombuffer(cells, f"u{len(cells) // rows}").astype(np.int64)
                for at, s in enumerate(sets):
                    key, span = np.zeros(rows, np.int64), 1
                    for c in s:
                        size = int(codes[c].max()) + 1
                        if span * size > 1 << 62:
                            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                            span = int(key.max()) + 1
                        key, span = key * size + codes[c], span * size
                    # a combination of several rows comes twice, so it is not alone
                    key = np.sort(np.concatenate([key, key[again]]))
                    new = np.concatenate([[True], key[1:] != key[:-1], [True]])
                    alone[at] += int(np.count_nonzero(new[1:] & new[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int32()), pa.array(alone, pa.int64())], names=["at", "alone"])
    return count
