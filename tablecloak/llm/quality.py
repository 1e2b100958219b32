"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Random indexing: every token has a fixed sparse vector of +1 and -1, derived from its hash; the vector of a word is the sum
of those of its neighbours over the whole corpus. Words share ``BUCKETS`` hash buckets, so the table has a fixed size
whatever the vocabulary, and every task's partial sums are added up by one aggregate. A document is the mean of the
normalised vectors of its tokens. The network is fitted on a bounded labelled sample, and a temperature fitted on a
part of it that the weights have not seen turns its output into calibrated probabilities.

Defined cases: a null or empty text has no tokens and pools to zeros, which is scored like any other; null labels teach
nothing; without labels of both classes every score is the share of label 1, or 0.5; equal texts get equal scores, so there are no
ties to break; a null id is scored like any other and never learnt from; an empty table gives an empty one; very long texts are pooled
whole, in slices of a few megabytes or one row. ``score`` replaces a column of the name it is given for its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, free_name, share
from .labelled import sample
from .words import ODD, TOKENS, Words, mix, slices

BUCKETS = 1 << 14
DIMS = 32
SIGNS = 4           # non-zero places of an index vector
REACH = 2           # neighbours on either side
TRAIN_ROWS = 20_000  # bound of the labelled sample
THRESHOLD = 0.3


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of each bucket."""
    h = mix((np.arange(BUCKETS * SIGNS, dtype=np.uint64) + np.uint64(1)) * np.uint64(ODD)).reshape(BUCKETS, SIGNS)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _buckets(w: Words) -> np.ndarray:
    return (w.hashes() >> np.uint64(20)).astype(np.int64) % BUCKETS


def _gather(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]):
        place, sign = _index_vectors()
        total = np.zeros(BUCKETS * DIMS)
        for batch in batches:
            for part in slices(batch, text_at):
                w = Words(part.column(text_at), TOKENS)
                b = _buckets(w)
                for k in range(1, REACH + 1):
                    near = np.flatnonzero(w.left > k)
                    for of, by in ((b[near], b[near + k]), (b[near + k], b[near])):
                        for j in range(SIGNS):
                            total += np.bincount(of * DIMS + place[by, j], weights=sign[by, j], minlength=len(total))
        total = total.reshape(BUCKETS, DIMS)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32())] + [pa.array(total[some, d]) for d in range(DIMS)],
                                         names=["bucket"] + [f"v{d}" for d in range(DIMS)])
    return run


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors, one per bucket, over all documents. Its size is fixed: BUCKETS x DIMS."""
    bounded_batches(docs.sparkSession)
    schema = "bucket int, " + ", ".join(f"v{d} double" for d in range(DIMS))
    parts = docs.select(text_col).mapInArrow(_gather(0), schema)
    rows = parts.groupBy("bucket").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMS)]).toArrow()
    table = np.zeros((BUCKETS, DIMS), np.float32)
    got = np.stack([c.to_numpy() for c in rows.columns[1:]], axis=1) if rows.num_rows else np.zeros((0, DIMS))
    # counts follow Zipf's law; damped, a word's vector is not that of its most frequent neighbour
    got = np.sign(got) * np.log1p(np.abs(got))
    table[rows.column(0).to_numpy()] = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-9)
    return table


def pool(table: np.ndarray, column: pa.Array) -> np.ndarray:
    """Mean word vector of each text."""
    w = Words(column, TOKENS)
    out = np.zeros((w.rows, DIMS), np.float32)
    some = np.flatnonzero(w.counts)
    if len(some):
        out[some] = np.add.reduceat(table[_buckets(w)], w.first[some], axis=0) / w.counts[some, None]
    return out


@dataclass
class Network:
    """tanh layer, logistic output, inputs scaled, output divided by the temperature."""
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        # row by row sums do not depend on what else is in the batch, as a matrix product's may
        x = ((x - self.mean) / self.scale).astype(np.float64)
        hidden = np.tanh(np.einsum("ij,jk->ik", x, self.w1) + self.b1)
        return np.einsum("ik,k->i", hidden, self.w2) + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 16, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the log loss of 85 % of the rows; the temperature minimises that of the rest."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(DIMS), np.ones(DIMS))
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Network(mean, scale, np.zeros((DIMS, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    z = (x - mean) / scale
    order = rng.permutation(len(y))
    check, learn = order[:len(y) * 15 // 100], order[len(y) * 15 // 100:]
    p = [rng.normal(0, 0.3, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40)))
            d = (out - y[rows]) / len(rows)
            back = d[:, None] * p[2] * (1 - h * h)
            step += 1
            for a, g, mm, vv in zip(p, (z[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)), m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= 0.01 * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.999 ** step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(check):
        raw = net.logit(x[check])
        margin, grid = np.where(y[check] > 0.5, raw, -raw), np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, -margin / t)) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    table: np.ndarray
    net: Network


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", text_col: str = "text",
        id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Word vectors from all documents, the network from about ``train_rows`` labelled ones at most for which ``usable``,
    a condition on the column ``id``, holds. What reaches the driver is of a size fixed by the parameters."""
    table = word_vectors(docs, text_col)
    few = sample(docs, labels, label, usable, train_rows, id_col, text_col)
    shared = share(docs.sparkSession, table)

    def pooled(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 1):
                x = pool(shared(), part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)] + [pa.array(c) for c in x.T],
                                                 names=["id", "y"] + [f"x{d}" for d in range(DIMS)])

    kind = dict(few.dtypes)["id"]
    got = few.select("id", "text", "y").mapInArrow(pooled, f"id {kind}, y int, " + ", ".join(f"x{d} float" for d in range(DIMS))).toArrow()
    got = got.sort_by("id")
    x = np.stack([c.to_numpy() for c in got.columns[2:]], axis=1) if got.num_rows else np.zeros((0, DIMS))
    return Model(table, fit_network(x, got.column("y").to_numpy()))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """The documents with their columns and ``out``, which replaces a column of that name."""
    bounded_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)
    frame = docs.drop(out).withColumn(out, F.lit(0.0))
    text_at = frame.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_at):
                x = pool(shared().table, part.column(text_at))
                yield part.set_column(part.num_columns - 1, out, pa.array(shared().net.score(x)))

    return frame.mapInArrow(run, frame.schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with their own columns."""
    name = free_name(docs.columns, "quality_score")
    return score(docs, model, text_col, name).where(F.col(name) >= threshold).drop(name)
