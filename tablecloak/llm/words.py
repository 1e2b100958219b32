"""Words, word hashes and windows of whole Arrow batches of text, as numpy arrays over the UTF-8 bytes.

A text column is one byte buffer with row offsets, so splitting and hashing cost a few array passes and no Python
object per word. All word classes used here are sets of ASCII bytes, so working on bytes equals working on characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are turned into arrays at once; a longer single row is one slice of its own.
SLICE_BYTES = 2 << 20
# Words longer than this are hashed one by one.
LONG_WORD = 64
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
ODD = 0x9E3779B97F4A7C15


def byte_class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


# [^\x20\x09-\x0D]+
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
# runs of letters and digits, and runs of other signs
TOKENS = np.where(NOT_SPACE, np.where(byte_class(lambda b: chr(b).isalnum() and b < 0x80 or b >= 0x80), 1, 2), 0).astype(np.uint8)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return data[base:int(offsets[-1]) if len(offsets) else 0], offsets - base


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text column of a cut holds about ``limit`` bytes, or one row."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """The words of the rows of one slice: ``starts``/``ends`` byte positions, ``row`` of each word, ``first`` word of each row.

    ``kind`` has a class for each byte: 0 parts words, and so does a change from one class to another."""

    def __init__(self, column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = False):
        data, offsets = text_bytes(column)
        self.data = LOWER[data] if lower else data
        self.rows = len(offsets) - 1
        inside = kind[self.data]
        n = len(inside)
        # where a row begins, or the class of the byte changes
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        edge[1:n] |= inside[1:] != inside[:-1]
        inside = inside != 0
        start, end = inside & edge[:n], inside & edge[1:]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)
        # words left in the row from this one on, itself included
        self.left = self.first[1:][self.row] - np.arange(len(self.starts)) if self.rows else np.zeros(0, np.int64)
        self.offsets = offsets

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64 bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64 bit hash, never zero, of each byte span; equal bytes have equal hashes in every task and run."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    h = mix(size.astype(np.uint64) * np.uint64(ODD))
    h = mix(h ^ (eight[starts] & keep[np.minimum(size, 8)]))
    todo = np.flatnonzero(size > 8)
    long = todo[size[todo] > LONG_WORD]
    for at in range(8, LONG_WORD, 8):
        todo = todo[size[todo] > at]
        if not len(todo):
            break
        h[todo] = mix(h[todo] * np.uint64(ODD) ^ (eight[starts[todo] + at] & keep[np.minimum(size[todo] - at, 8)]))
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h | np.uint64(1)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, one for each start; the last k - 1 starts are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(ODD) + h[j:n + j]
    return mix(out)
