"""Benchmark decontamination by suffix arrays over shards of the training text.

Every task cuts its documents into shards of a bounded size and builds for each the (sparse) suffix array of its words:
the suffixes that share their first words with some test suffix, sorted by their next ``window`` words. Each test suffix
is then binary-searched in it; the interval it narrows to holds every verbatim match of at least a window, and comparing
on from there gives the longest match of each location. Nothing is shuffled.

The test set is sent to the tasks in blocks of a fixed number of words, one after another; what a block has found is written
before the next one is sent and the last is released, so plan and broadcasts are those of one block whatever the size of the benchmark.

Defined cases: a null or empty text has no words; an item without id or without words takes no part; repeated rows give
repeated result rows; an item with fewer words than a window is one window; an empty benchmark hits nothing; a null id is carried
along; an empty table gives an empty one; long texts are searched whole, in shards of a few megabytes or one row; ties cannot occur,
every match counts. ``matches`` replaces columns of its result's names, see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import bounded_batches, cut, share
from .words import ALNUM, Words, slices, window_hashes

WINDOW = 10
# Words of test items in one broadcast block.
BLOCK_WORDS = 1_000_000
HIT = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.IntegerType()),
                    T.StructField("length", T.IntegerType())])


class TestBlock:
    """The suffixes of some test items that start a window: their words, and how many of them make the window."""

    def __init__(self, ids: list[str], column: pa.Array, window: int):
        w = Words(column, ALNUM, lower=True)
        h = w.hashes()
        sizes = w.counts[w.row] if len(w) else np.zeros(0, np.int64)
        need = np.minimum(window, sizes)
        at = np.flatnonzero(w.left >= need)
        self.ids = np.array(ids, dtype=object)
        self.words, self.at, self.need, self.item, self.left = h, at, need[at], w.row[at], w.left[at]
        self.window = window
        # every window shares its first q words with a match, so other training suffixes need no sorting
        self.q = int(min(3, self.need.min())) if len(at) else 0
        self.heads = np.unique(_heads(h, self.q)[at]) if self.q else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(self.heads >> np.uint64(48)).astype(np.int64)] = True

    def matches(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test suffix, training word position, words matched) of every window match in one shard."""
        none = np.zeros(0, np.int64)
        if not self.q or len(h) < self.q:
            return none, none, none
        heads = _heads(h, self.q)
        near = np.flatnonzero(self.bits[(heads >> np.uint64(48)).astype(np.int64)])
        near = near[w.left[near] >= self.q]
        found = np.searchsorted(self.heads, heads[near])
        near = near[self.heads[np.minimum(found, len(self.heads) - 1)] == heads[near]]
        if not len(near):
            return none, none, none
        # suffix array of the shard, to the depth of a window; a row's end sorts before any word
        ahead = np.arange(self.window)
        inside = ahead[None, :] < w.left[near][:, None]
        keys = np.where(inside, h[np.minimum(near[:, None] + ahead, len(h) - 1)], np.uint64(0))
        order = np.lexsort(keys.T[::-1])
        suffixes, keys = near[order], keys[order]
        lo, hi = np.zeros(len(self.at), np.int64), np.full(len(self.at), len(suffixes), np.int64)
        for k in range(self.window):
            live = np.flatnonzero((self.need > k) & (lo < hi))
            if not len(live):
                break
            word = self.words[self.at[live] + k]
            lo[live], hi[live] = _bounds(keys[:, k], word, lo[live], hi[live])
        size = np.where(lo < hi, hi - lo, 0)
        test = np.repeat(np.arange(len(self.at)), size)
        inner = np.arange(len(test)) - np.repeat(np.cumsum(size) - size, size)
        train = suffixes[np.repeat(lo, size) + inner]
        # the longest verbatim match at each location
        length = self.need[test].copy()
        open_ = np.arange(len(test))
        while len(open_):
            n = length[open_]
            more = (n < self.left[test[open_]]) & (n < w.left[train[open_]])
            open_ = open_[more]
            n = length[open_]
            open_ = open_[self.words[self.at[test[open_]] + n] == h[train[open_] + n]]
            length[open_] += 1
        return test, train, length


def _heads(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of the first q words of each suffix; the last suffixes, too short for it, get zero."""
    out = np.zeros(len(h), np.uint64)
    got = window_hashes(h, q)
    out[:len(got)] = got
    return out


def _bounds(keys: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in its own sorted interval of ``keys``: all binary searches at once."""
    out = []
    for upper in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            key = keys[np.minimum(mid, len(keys) - 1)]
            right = open_ & ((key <= words) if upper else (key < words))
            a = np.where(right, mid + 1, a)
            b = np.where(open_ & ~right, mid, b)
        out.append(a)
    return out[0], out[1]


def _blocks(bench: DataFrame, id_col: str, text_col: str, window: int, block_words: int):
    """Blocks of test items, each collected on its own; a block's size is measured before it is."""
    items = bench.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    # a word takes a character and what parts it from the next one
    total = items.agg(F.sum((F.length("t") + 1) / 2)).first()[0] or 0
    n = max(1, -(-int(total) // block_words))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        # without any item the words are still counted
        if rows or n == 1:
            yield TestBlock([r.i for r in rows], pa.array([r.t for r in rows], pa.large_string()), window)


def _probe(block, text_at: int):
    """(slice of a batch, its words, matches) for each shard of a task."""
    def run(batches: Iterator[pa.RecordBatch]):
        test = block()
        for batch in batches:
            for part in slices(batch, text_at):
                w = Words(part.column(text_at), ALNUM, lower=True)
                yield part, w, test, test.matches(w, w.hashes())
    return run


def matches(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
            bench_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` but those named n_words, n_hit and hits, which are added: the number of words, of words
    inside a window match, and the longest match of every (item, start) as (item_id, start word, length in words)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.drop("n_words", "n_hit", "hits")
    out = base.withColumns({"n_words": F.lit(0).cast("bigint"), "hits": F.array().cast(T.ArrayType(HIT)),
                            "n_hit": F.array().cast("array<int>")})
    schema = out.schema
    text_at = schema.names.index(text_col)
    held = None
    for block in _blocks(bench, item_col, bench_text, window, block_words):
        if held is not None:
            out = _written(out, held)
        held = share(spark, block)
        probe = _probe(held, text_at)

        def run(batches, probe=probe):
            for part, w, test, (suffix, train, length) in probe(batches):
                new = {"n_words": pa.array(w.counts, pa.int64())}
                new["hits"] = _hits(part.column("hits"), w, test, suffix, train, length)
                new["n_hit"] = _covered(part.column("n_hit"), w, train, test.need[suffix])
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(i)) for i, n in enumerate(part.schema.names)],
                                                 names=part.schema.names)

        out = out.mapInArrow(run, schema)
    if out.columns and "n_hit" in out.columns:
        out = out.withColumn("n_hit", F.size("n_hit").cast("bigint"))
    return out.select(*base.columns, "n_words", "n_hit", "hits")


def _written(out: DataFrame, held) -> DataFrame:
    """What the blocks so far have found, written: the plan holds one block at a time, and so do the executors."""
    out = cut(out, "block")
    held.release()
    return out


def _covered(old: pa.Array, w: Words, train: np.ndarray, need: np.ndarray) -> pa.Array:
    """Positions in their row of the words inside a match, with those of earlier blocks."""
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, train, 1)
    np.add.at(edge, train + need, -1)
    hit = np.cumsum(edge[:-1]) > 0
    past = old.flatten().to_numpy(zero_copy_only=False)
    if len(past):
        rows = np.repeat(np.arange(w.rows), np.diff(old.offsets.to_numpy()))
        hit[w.first[rows] + past] = True
    at = np.flatnonzero(hit)
    per_row = np.bincount(w.row[at], minlength=w.rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()),
                                    pa.array(at - w.first[w.row[at]], pa.int32()))


def _hits(old: pa.Array, w: Words, test: TestBlock, suffix: np.ndarray, train: np.ndarray, length: np.ndarray) -> pa.Array:
    """Longest matches per row: one for each (item, start), those contained in the match one word earlier left out."""
    item = test.item[suffix]
    place = {(int(i), int(t), int(s)) for i, t, s in zip(item, train, test.at[suffix])}
    rows: list[list] = [list(x) for x in old.to_pylist()]
    for i, t, s, n in zip(item.tolist(), train.tolist(), test.at[suffix].tolist(), length.tolist()):
        if (i, t - 1, s - 1) in place and w.row[t] == w.row[max(t - 1, 0)] and t:
            continue
        rows[w.row[t]].append({"item_id": str(test.ids[i]), "start": int(t - w.first[w.row[t]]), "length": n})
    return pa.array(rows, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32())])))


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  bench_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a window of any test item, with their own columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out, text_at, held = docs, docs.columns.index(text_col), None
    for block in _blocks(bench, item_col, bench_text, window, block_words):
        if held is not None:
            out = _written(out, held)
        held = share(spark, block)
        probe = _probe(held, text_at)

        def run(batches, probe=probe):
            for part, w, _, (_, train, _) in probe(batches):
                clean = np.ones(w.rows, bool)
                clean[w.row[train]] = False
                yield part.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """Digest per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    text = kw.get("text_col", "text")
    found = matches(docs.select(F.col(id_col), F.col(text)), bench, **kw)
    items = F.array_sort(F.array_distinct(F.col("hits.item_id")))
    return found.select(
        id_col, "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
