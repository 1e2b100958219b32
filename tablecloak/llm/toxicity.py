"""Toxicity classifier: a bidirectional gated recurrent network with attention pooling, in numpy, over overlapping windows.

A word enters with its word inputs (hash-bucket embedding, log odds of toxicity and frequency among the training documents)
and its character inputs (embeddings of its first and last bytes, and the same statistics of its beginnings). Every window of ``WINDOW`` words, one for each
``STRIDE`` words of the text, is read in both directions; attention pools the states; a document scores as its highest
window. Training is by back-propagation through time: in each round every training document is represented by the window
that scores highest at present, so the label of a document teaches the window that carries it. Log odds leave the document
itself out while training, so a word that only this document has says nothing about it.

Defined cases: a null or empty text is one window without words, whose score is that of the output bias; null labels teach
nothing; without labels of both classes every score is the share of label 1, or 0.5; equal texts get equal scores, and of equal
windows the first counts; a null id is scored like any other and never learnt from; an empty table gives an empty one; all windows of
very long texts are scored, in slices of a few megabytes or one row. ``score`` replaces columns of the names it is given for its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, share
from .labelled import sample
from .words import ALNUM, Words, slices, span_hashes

WINDOW, STRIDE = 32, 16
BUCKETS = 1 << 16       # of word statistics
EMBEDDED = 1 << 12      # of trained word embeddings
WORD, CHAR, EDGE, HIDDEN, ATTENTION = 4, 3, 3, 8, 8
BEGIN = (4, 6)          # bytes of a word's beginnings that have statistics of their own
STATS = 2 * (1 + len(BEGIN))
INPUTS = STATS + WORD + 2 * EDGE * CHAR
PRIOR = 4.0
DECAY = 2e-3            # of the word embeddings, per step: rare words should not be learnt by heart
TRAIN_ROWS = 5_000      # bound of the labelled sample
THRESHOLD = 0.3


@dataclass
class Parameters:
    word: np.ndarray
    char: np.ndarray
    w: np.ndarray       # (2, INPUTS, 3 H): reset, update, candidate of each direction
    u: np.ndarray       # (2, H, 3 H)
    b: np.ndarray       # (2, 3 H)
    a: np.ndarray       # (2 H, ATTENTION)
    v: np.ndarray       # (ATTENTION,)
    o: np.ndarray       # (2 H,)
    bias: np.ndarray    # (1,)

    @staticmethod
    def new(seed: int = 11) -> Parameters:
        rng = np.random.default_rng(seed)
        r = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        z = lambda *s: np.zeros(s, np.float32)
        return Parameters(r(EMBEDDED, WORD) / 3, r(256, CHAR), r(2, INPUTS, 3 * HIDDEN), r(2, HIDDEN, 3 * HIDDEN), z(2, 3 * HIDDEN),
                          r(2 * HIDDEN, ATTENTION), r(ATTENTION), r(2 * HIDDEN), z(1))

    def arrays(self) -> dict[str, np.ndarray]:
        return dict(vars(self))


@dataclass
class Statistics:
    """Documents of each label that hold a word, or a beginning, of a bucket: arrays (1 + len(BEGIN), BUCKETS)."""
    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: int
    n_clean: int

    def columns(self, bucket: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Log odds and log frequency; ``own`` is the label of the document itself, which is then left out."""
        kind = np.arange(bucket.shape[1])
        a, b = self.toxic[kind, bucket].astype(np.float32), self.clean[kind, bucket].astype(np.float32)
        if own is not None:
            a, b = a - own[:, None], b - (1 - own[:, None])
        # PRIOR more documents of the usual share: what was never seen has odds of zero
        share = (self.n_toxic + 1) / (self.n_toxic + self.n_clean + 2)
        odds = np.log((a + PRIOR * share) / (b + PRIOR * (1 - share)) * ((1 - share) / share))
        return np.concatenate([odds, np.log1p(a + b) / 4], axis=1).astype(np.float32)


class Text:
    """Word and byte indexes of the words of one slice, and the windows of its rows."""

    def __init__(self, column: pa.Array):
        w = Words(column, ALNUM, lower=True)
        self.rows = w.rows
        spans = [w.ends] + [np.minimum(w.ends, w.starts + k) for k in BEGIN]
        self.bucket = np.stack([(span_hashes(w.data, w.starts, e) >> np.uint64(17)).astype(np.int64) % BUCKETS for e in spans], axis=1)
        last = w.ends - 1
        self.edge = np.stack([w.data[np.minimum(w.starts + k, last)] for k in range(EDGE)] + [w.data[np.maximum(last - k, w.starts)] for k in range(EDGE)],
                             axis=1) if len(w) else np.zeros((0, 2 * EDGE), np.uint8)
        n = np.maximum(1, -(-(w.counts - WINDOW) // STRIDE) + 1)
        self.row = np.repeat(np.arange(w.rows), n)
        self.first = np.cumsum(n) - n
        k = np.arange(len(self.row)) - self.first[self.row]
        self.start = w.first[:-1][self.row] + k * STRIDE
        self.size = np.clip(w.counts[self.row] - k * STRIDE, 0, WINDOW)
        self.word_row = w.row


def word_inputs(p: Parameters, text: Text, stats: Statistics, at: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    return np.concatenate([stats.columns(text.bucket[at], own), p.word[text.bucket[at, 0] % EMBEDDED],
                           p.char[text.edge[at]].reshape(len(at), -1)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _read(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
    """States (T, windows, H) of one direction from the input parts (T, windows, 3 H)."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
    for t in range(len(x)):
        g = h @ u
        ru = _sigmoid(x[t, :, :2 * HIDDEN] + g[:, :2 * HIDDEN])
        r, z = ru[:, :HIDDEN], ru[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
        m = mask[t][:, None]
        new = h + m * (1 - z) * (c - h)
        if keep is not None:
            keep.append((h, r, z, c, g[:, 2 * HIDDEN:]))
        out[t] = h = new
    return out


def forward(p: Parameters, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows; ``x`` (T, windows, 2, 3 H) holds the input parts of both directions, ``mask`` (T, windows)."""
    k0, k1 = ([], []) if keep is not None else (None, None)
    f = _read(x[:, :, 0], mask, p.u[0], k0)
    b = _read(x[::-1, :, 1], mask[::-1], p.u[1], k1)[::-1]
    h = np.concatenate([f, b], axis=2)
    e = np.tanh(h @ p.a)
    s = np.where(mask > 0, e @ p.v, np.float32(-1e9))
    alpha = np.exp(s - s.max(axis=0)) * mask
    alpha /= np.maximum(alpha.sum(axis=0), np.float32(1e-9))
    pooled = np.einsum("tn,tnh->nh", alpha, h)
    if keep is not None:
        keep.update(k0=k0, k1=k1, h=h, e=e, alpha=alpha, pooled=pooled)
    return pooled @ p.o + p.bias[0]


def _back(x: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list, dh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input parts and of ``u`` from those of the states."""
    dx, du, carry = np.zeros_like(x), np.zeros_like(u), np.zeros_like(dh[0])
    for t in range(len(x) - 1, -1, -1):
        h, r, z, c, gc = kept[t]
        m = mask[t][:, None]
        d = dh[t] + carry
        dc, dz, dprev = d * m * (1 - z), -d * m * (c - h), d * (1 - m * (1 - z))
        dc = dc * (1 - c * c)
        dr = dc * gc * r * (1 - r)
        dz = dz * z * (1 - z)
        dx[t] = np.concatenate([dr, dz, dc], axis=1)
        dg = np.concatenate([dr, dz, dc * r], axis=1)
        du += h.T @ dg
        carry = dprev + dg @ u.T
    return dx, du


def gradients(p: Parameters, text: Text, at: np.ndarray, mask: np.ndarray, features: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted log loss of windows and its gradients. ``at`` (T, windows) are word positions, ``features`` their inputs."""
    x = (features.reshape(-1, INPUTS) @ np.concatenate([p.w[0], p.w[1]], axis=1)).reshape(*at.shape, 2, 3 * HIDDEN) + p.b
    keep: dict = {}
    logit = forward(p, x, mask, keep)
    loss = float((weight * np.logaddexp(0, np.where(y > 0.5, -logit, logit))).sum())
    d = (weight * (_sigmoid(logit) - y)).astype(np.float32)
    h, e, alpha, pooled = keep["h"], keep["e"], keep["alpha"], keep["pooled"]
    g = {"o": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p.o
    dh = alpha[:, :, None] * dp
    da = np.einsum("tnh,nh->tn", h, dp)
    ds = alpha * (da - (alpha * da).sum(axis=0))
    g["v"] = np.einsum("tn,tna->a", ds, e)
    de = ds[:, :, None] * p.v * (1 - e * e)
    g["a"] = np.einsum("tnh,tna->ha", h, de)
    dh = dh + de @ p.a.T
    dx0, du0 = _back(x[:, :, 0], mask, p.u[0], keep["k0"], dh[:, :, :HIDDEN])
    dx1, du1 = _back(x[::-1, :, 1], mask[::-1], p.u[1], keep["k1"], dh[::-1, :, HIDDEN:])
    dx = np.stack([dx0, dx1[::-1]], axis=2).reshape(-1, 2, 3 * HIDDEN)
    flat = features.reshape(-1, INPUTS)
    g["u"], g["b"] = np.stack([du0, du1]), dx.sum(axis=0)
    g["w"] = np.stack([flat.T @ dx[:, 0], flat.T @ dx[:, 1]])
    df = dx[:, 0] @ p.w[0].T + dx[:, 1] @ p.w[1].T
    words, edges = at.reshape(-1), STATS + WORD
    g["word"], g["char"] = np.zeros_like(p.word), np.zeros_like(p.char)
    np.add.at(g["word"], text.bucket[words, 0] % EMBEDDED, df[:, STATS:edges])
    np.add.at(g["char"], text.edge[words].reshape(-1), df[:, edges:].reshape(-1, CHAR))
    return loss, g


def window_logits(p: Parameters, text: Text, stats: Statistics, own: np.ndarray | None = None) -> np.ndarray:
    """Logits of all windows of a slice; ``own``: label of the row of each word, while training."""
    out = np.empty(len(text.start), np.float32)
    steps, weights = np.arange(WINDOW)[:, None], np.concatenate([p.w[0], p.w[1]], axis=1)
    for a in range(0, len(out), 4096):
        start, size = text.start[a:a + 4096], text.size[a:a + 4096]
        lo, hi = int(start.min()), int((start + size).max())
        # the input parts of a word serve both windows it is in; the last row is for places past a window's end
        words = np.arange(lo, hi)
        x = word_inputs(p, text, stats, words, None if own is None else own[words]) @ weights
        x = np.concatenate([x.reshape(hi - lo, 2, 3 * HIDDEN) + p.b, np.zeros((1, 2, 3 * HIDDEN), np.float32)])
        mask = (steps < size).astype(np.float32)
        out[a:a + 4096] = forward(p, x[np.where(mask > 0, start + steps - lo, hi - lo)], mask)
    return out


def _best(logit: np.ndarray, text: Text) -> np.ndarray:
    """The highest window of each row, the first of equals."""
    top = np.maximum.reduceat(logit, text.first) if text.rows else np.zeros(0)
    hit = np.flatnonzero(logit == top[text.row])
    return hit[np.unique(text.row[hit], return_index=True)[1]]


@dataclass
class Model:
    p: Parameters
    stats: Statistics
    constant: float | None = None
    losses: list[float] = field(default_factory=list)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, index of the highest window) of each text."""
        text = Text(column)
        if self.constant is not None:
            return np.full(text.rows, self.constant), np.zeros(text.rows, np.int64)
        logit = window_logits(self.p, text, self.stats)
        at = _best(logit, text)
        return np.round(_sigmoid(logit[at].astype(np.float64)), 6), at - text.first


def train(column: pa.Array, y: np.ndarray, rounds: int = 4, seed: int = 11) -> Model:
    text, y = Text(column), y.astype(np.float32)
    pairs = [np.unique(text.word_row * BUCKETS + b) for b in text.bucket.T]
    held = lambda of: np.stack([np.bincount((p % BUCKETS)[of[p // BUCKETS] > 0.5], minlength=BUCKETS) for p in pairs])
    stats = Statistics(held(y), held(1 - y), int(y.sum()), int((1 - y).sum()))
    p = Parameters.new(seed)
    if len(np.unique(y)) < 2:
        return Model(p, stats, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    own = y[text.word_row]
    # to begin with, the window that holds the word of the highest odds
    odds = np.append(stats.columns(text.bucket, own)[:, :1 + len(BEGIN)].max(axis=1), np.float32(-99))
    steps = np.arange(WINDOW)[:, None]
    at = np.where(steps < text.size, np.minimum(text.start + steps, len(text.bucket)), len(text.bucket))
    best = _best(odds[at].max(axis=0), text)
    m = {k: np.zeros_like(a) for k, a in p.arrays().items()}
    v = {k: np.zeros_like(a) for k, a in p.arrays().items()}
    losses, step, least = [], 0, np.inf
    shuffled = rng.permutation(len(y))
    check, learn = shuffled[:len(y) * 15 // 100], shuffled[len(y) * 15 // 100:]
    weight = np.where(y > 0.5, min(4.0, stats.n_clean / max(1, stats.n_toxic)), 1.0).astype(np.float32)
    batches = max(1, len(learn) // 64)
    kept = p
    for _ in range(rounds):
        # few documents are gone through more often
        for _ in range(max(2, -(-100 // batches))):
            for rows in np.array_split(rng.permutation(learn), batches):
                pick = best[rows]
                mask = (steps < text.size[pick]).astype(np.float32)
                pos = np.minimum(text.start[pick] + steps, max(len(text.bucket) - 1, 0))
                inputs = word_inputs(p, text, stats, pos.reshape(-1), own[pos.reshape(-1)]) * mask.reshape(-1, 1)
                _, g = gradients(p, text, pos, mask, inputs.reshape(*pos.shape, INPUTS), y[rows], weight[rows] / weight[rows].sum())
                step += 1
                for k, a in p.arrays().items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    a -= (0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32)
                p.word *= 1 - DECAY
        logit = window_logits(p, text, stats, own)
        best = _best(logit, text)
        # the round that does best on documents that taught the weights nothing is kept
        loss = float(np.logaddexp(0, np.where(y > 0.5, -1, 1) * logit[best])[check].mean()) if len(check) else 0.0
        losses.append(loss)
        if loss < least:
            least, kept = loss, Parameters(**{k: a.copy() for k, a in p.arrays().items()})
    return Model(kept, stats, None, losses)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", text_col: str = "text", id_col: str = "doc_id",
        train_rows: int = TRAIN_ROWS) -> Model:
    """Train on about ``train_rows`` labelled documents at most for which ``usable``, a condition on the column ``id``, holds."""
    got = sample(docs, labels, label, usable, train_rows, id_col, text_col).select("id", "text", "y").toArrow().sort_by("id")
    return train(got.column("text").combine_chunks(), got.column("y").to_numpy())


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", window: str = "top_window") -> DataFrame:
    """The documents with their columns, ``out`` and the index of the highest window; these replace columns of that name."""
    bounded_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)
    frame = docs.drop(out, window).withColumns({out: F.lit(0.0), window: F.lit(0)})
    text_at = frame.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, text_at):
                s, top = shared().score(part.column(text_at))
                part = part.set_column(part.num_columns - 2, out, pa.array(s))
                yield part.set_column(part.num_columns - 1, window, pa.array(top, pa.int32()))

    return frame.mapInArrow(run, frame.schema)
