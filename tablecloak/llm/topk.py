"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Every shard of candidates has one list per component, sorted by its value; a query reads list d from the top where its own
component is positive, from the bottom where it is negative, and not at all where it is zero. All lists of a query are read to the same
depth, one of ``MARKS``. A candidate not met by then scores at most the threshold, the sum of what stands at the reading positions; one
that was met is bounded by what was read of it, and for the rest by the reading position from above and by the list's
far end from below. The k-th best score known, that of earlier shards or of the lower bounds, is the floor. A query first reads
to the mark where the threshold falls under its floor, for before that any candidate may qualify; it stops when no more than ``FEW`` of
those it met can reach the floor, or reads on. What is left then gets its final score.

The bounds of all candidates for the queries at one mark are matrix products, and queries that have stopped take no part in later ones.
Queries come in blocks of a fixed number of rows, broadcast one after another, each with one read of the candidates; a task
returns its k best per query, one window keeps the best of those, and the block's result is added to a table in the shared
folder, so neither plan nor memory grows with the number of blocks.

Defined cases: vectors that are null, empty, or hold a null or a non-finite component take no part; a query meets candidates of
its own length; rows with the query's id are its own; a repeated id asks once, with its smallest vector, and each of its rows
can be found; ties go to the smaller id; fewer candidates than k are all returned; an empty table gives an empty one. Ids are whole
numbers, others are refused; null ids take no part. Only the two named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir
from .frames import bounded_batches, cut, share

K = 20
QUERY_BLOCK = 16_384    # queries in one broadcast
QUERIES_AT_ONCE = 2048  # of them whose bounds are worked out together
SHARD_ROWS = 2048       # candidates whose lists are read together
MARKS = 16              # depths at which a query looks at its bounds, in equal steps
FEW = 1 / 32            # share of candidates at which reading stops and final scores are taken


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): ids and vectors of whole numbers, floor(scale * x)."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    fine = F.forall(F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), v.alias("v"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, length of each row)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())


def by_length(ids: np.ndarray, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    flat, size = _matrix(column)
    start = np.cumsum(size) - size
    out = {}
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        out[int(n)] = (ids[rows], flat[start[rows][:, None] + np.arange(n)])
    return out


class Lists:
    """The sorted lists of one shard, and what stands at their reading positions at each mark."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, exact=np.float64):
        self.ids, self.values = ids, values.astype(exact)
        ordered, n = np.sort(self.values, axis=0), len(values)
        self.depth = np.maximum(1, -(-n * np.arange(1, MARKS + 1) // MARKS))
        self.top, self.bottom = ordered[n - self.depth], ordered[self.depth - 1]
        self.low, self.high = ordered[0], ordered[-1]

    def upper(self, positive: np.ndarray, negative: np.ndarray, mark: int) -> np.ndarray:
        """Highest possible score of every (query, candidate): read components as they are, the others at the reading position."""
        if mark == MARKS - 1:
            return (positive + negative) @ self.values.T
        return positive @ np.maximum(self.values, self.top[mark]).T + negative @ np.minimum(self.values, self.bottom[mark]).T

    def lower(self, positive: np.ndarray, negative: np.ndarray, mark: int) -> np.ndarray:
        """Lowest possible score: components not read stand at the far end of their list."""
        v = self.values
        return positive @ np.where(v >= self.top[mark], v, self.low).T + negative @ np.where(v <= self.bottom[mark], v, self.high).T


def search(query_ids: np.ndarray, queries: np.ndarray, shard: Lists, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, candidate index, score) of all that can be among the k best, and the number of list cells read; ``floor``: scores
    known to be reached by k others."""
    work = shard.values.dtype
    positive, negative = np.maximum(queries, 0).astype(work), np.minimum(queries, 0).astype(work)
    threshold = positive @ shard.top.T + negative @ shard.bottom.T
    threshold[:, -1] = -np.inf  # read to the end, nothing is unseen
    own = query_ids[:, None] == shard.ids[None, :] if np.isin(query_ids, shard.ids).any() else None
    n, last = len(shard.ids), MARKS - 1
    floor = floor.astype(np.float64)
    # the first mark at which the unseen fall under the floor; without a floor an eighth of the lists
    mark = np.where(np.isfinite(floor), (threshold >= floor[:, None]).sum(axis=1), MARKS // 8 - 1)
    cells, found = 0, []
    todo = np.arange(len(queries))
    while len(todo):
        m = int(mark[todo].min())
        rows = todo[mark[todo] == m]
        upper = shard.upper(positive[rows], negative[rows], m)
        if own is not None:
            upper[own[rows]] = -np.inf
        if n >= k and (m == last or not np.isfinite(floor[rows]).all()):
            lower = upper if m == last else shard.lower(positive[rows], negative[rows], m)
            if own is not None and m < last:
                lower[own[rows]] = -np.inf
            floor[rows] = np.maximum(floor[rows], np.partition(lower, n - k, axis=1)[:, n - k])
        alive = (upper >= floor[rows, None]) & (upper > -np.inf)
        done = (threshold[rows, m] < floor[rows]) & (alive.sum(axis=1) <= FEW * n) if m < last else np.ones(len(rows), bool)
        cells += int(shard.depth[m]) * int(np.count_nonzero(queries[rows[done]]))
        i, j = np.nonzero(alive[done])
        found.append((rows[done][i], j, upper[done][i, j] if m == last else None))
        on = rows[~done]
        # twice as deep, or to where the unseen fall under the floor by now
        mark[on] = np.minimum(last, np.maximum(2 * m + 1, (threshold[on] >= floor[on, None]).sum(axis=1)))
        todo = np.setdiff1d(todo, rows[done], assume_unique=True)
    whole, own_values = queries.astype(np.int64), shard.values.astype(np.int64)
    i, j = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    score = np.empty(len(i), np.int64)
    start = 0
    for rows, columns, known in found:
        part = slice(start, start + len(rows))
        start += len(rows)
        score[part] = known if known is not None else np.concatenate([np.zeros(0, np.int64), *(
            np.einsum("nd,nd->n", whole[rows[a:a + (1 << 16)]], own_values[columns[a:a + (1 << 16)]]) for a in range(0, len(rows), 1 << 16))])
    return i, j, score, cells


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, i))
    i, ids, score = i[order], ids[order], score[order]
    first = np.searchsorted(i, i, "left")
    keep = np.arange(len(i)) - first < k
    return i[keep], ids[keep], score[keep]


def _scan(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        asked = {(n, a): (ids[a:a + QUERIES_AT_ONCE], values[a:a + QUERIES_AT_ONCE]) for n, (ids, values) in by_length(*block()).items()
                 for a in range(0, len(ids), QUERIES_AT_ONCE)}
        largest = {n: max(float(np.abs(q).max(initial=0)) for (m, _), (_, q) in asked.items() if m == n) for n, _ in asked}
        found = {n: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for n in asked}
        # rows of small batches are put together, so that lists are worth reading
        wait: dict[int, list] = {n: [] for n, _ in asked}

        def read(n: int) -> None:
            ids, values = (np.concatenate(x) for x in zip(*wait[n]))
            wait[n] = []
            for a in range(0, len(ids), SHARD_ROWS):
                part = values[a:a + SHARD_ROWS]
                # single numbers are exact while every sum stays under 2^23
                single = largest[n] * float(np.abs(part).max(initial=0)) * n < 1 << 23
                shard = Lists(ids[a:a + SHARD_ROWS], part, np.float32 if single else np.float64)
                for some in (x for x in asked if x[0] == n):
                    query_ids, queries = asked[some]
                    i, x, s = found[some]
                    floor = np.full(len(queries), -np.inf)
                    full = np.flatnonzero(np.bincount(i, minlength=len(queries)) >= k)
                    floor[full] = s[np.searchsorted(i, full, "right") - 1]
                    i2, j2, s2, _ = search(query_ids, queries, shard, k, floor)
                    found[some] = _best(np.concatenate([i, i2]), np.concatenate([x, shard.ids[j2]]), np.concatenate([s, s2]), k)

        for batch in batches:
            for n, part in by_length(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)).items():
                if n in wait:
                    wait[n].append(part)
                    if sum(len(p[0]) for p in wait[n]) >= SHARD_ROWS:
                        read(n)
        for n in wait:
            if wait[n]:
                read(n)
        for some, (i, x, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[some][0][i]), pa.array(x), pa.array(s)], names=["query_id", "id", "score"])
    return run


def top_k(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = 64.0,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): for every row for which ``asks``, a condition on the column ``id``, holds, its k best."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise TypeError("ids of vectors are whole numbers")
    rows = usable(vectors, id_col, vector_col, scale)
    # worked out once and not for every block
    queries = cut(rows.where(asks).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n = max(1, -(-queries.count() // query_block))
    path, schema = f"{scratch_dir(spark)}/tablecloak/top-{uuid.uuid4().hex}", "query_id bigint, rank int, id bigint, score bigint"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    for b in range(n):
        got = queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).orderBy("id").toArrow()
        block = share(spark, (got.column("id").to_numpy(), got.column("v").combine_chunks()))
        part = rows.mapInArrow(_scan(block, k), "query_id bigint, id bigint, score bigint")
        part.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score").write.mode("append").parquet(path)
        block.release()
    return spark.read.schema(schema).parquet(path).withColumnRenamed("id", id_col)
