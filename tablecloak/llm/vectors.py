"""Sums of long dense vectors, one from each task, by a tree of small groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16  # places of a vector that travel as one row
FAN = 16         # rows that one group of a round adds up
SCHEMA = "part int, block int, vector binary"


def block_rows(part: int, vector: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(part, block, bytes) of the blocks of a task's vector that are not all zero."""
    for block, at in enumerate(range(0, len(vector), BLOCK)):
        piece = vector[at:at + BLOCK]
        if piece.any():
            yield part, block, piece.tobytes()


def block_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, block, vector = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array(vector, pa.binary())], names=["part", "block", "vector"])


def tree_sum(rows: DataFrame, size: int, kind: str = "<i8", cap: int | None = None) -> np.ndarray:
    """The sum of the vectors of all parts; with ``cap`` no place exceeds it. ``rows`` should be cut, they are read twice.

    A round adds ``FAN`` parts of one block in a group, so no task holds more than that many blocks; the result, ``size``
    numbers of ``kind``, comes to the driver.
    """
    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_buffer(), kind) for v in table.column("vector")], axis=0, dtype=np.int64)
        total = (total if cap is None else np.minimum(total, cap)).astype(kind)
        return pa.table({"part": table.column("part")[:1], "block": table.column("block")[:1], "vector": pa.array([total.tobytes()], pa.binary())})

    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        rows = rows.select(F.floor(F.col("part") / FAN).cast("int").alias("part"), "block", "vector").groupBy("block", "part").applyInArrow(add, SCHEMA)
        parts = -(-parts // FAN)
    out = np.zeros(size, kind)
    for row in rows.select("block", "vector").toLocalIterator():
        piece = np.frombuffer(row["vector"], kind)
        out[row["block"] * BLOCK:row["block"] * BLOCK + len(piece)] = piece
    return out
