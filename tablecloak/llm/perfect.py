"""Minimal perfect hashing of 64 bit keys, in numpy: each key of a set has its own index below the size of the set.

Keys are dealt over shards. In a shard every level has ``GAMMA`` bits for each key that is left; a key alone on its bit stays,
the others go on to the next level, and the index is the number of bits set before the key's. The keys themselves are kept in
index order, so a key outside the set is recognised instead of getting a foreign index.
"""

from __future__ import annotations

import numpy as np

from .words import ODD, mix

GAMMA = 2
LEVELS = 64  # a level takes about 60 % of the keys; a set that outlives them all is refused


def spread(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix((keys ^ np.uint64(salt * 0x2545F4914F6CDD1D & (1 << 64) - 1)) * np.uint64(ODD))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (spread(keys, 0) % np.uint64(shards)).astype(np.int64)


class Shard:
    """The hash of one shard's distinct keys."""

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []    # a flag for each place of a level
        self.ranks: list[np.ndarray] = []   # flags set before the place, those of earlier levels included
        left, before = np.unique(keys.astype(np.uint64)), 0
        total = len(left)
        while len(left):
            if len(self.bits) == LEVELS:
                raise ValueError("no perfect hash found")
            place = self._places(left, len(self.bits), GAMMA * len(left))
            alone = np.bincount(place, minlength=GAMMA * len(left)) == 1
            self.bits.append(alone)
            self.ranks.append((before + np.cumsum(alone) - alone).astype(np.int32))
            before += int(alone.sum())
            left = left[~alone[place]]
        self.keys = np.zeros(total, np.uint64)
        own = np.unique(keys.astype(np.uint64))
        self.keys[self._raw(own)] = own

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (spread(keys, level + 1) % np.uint64(size)).astype(np.int64)

    def _raw(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            place = self._places(keys[todo], level, len(bits))
            here = bits[place]
            out[todo[here]] = ranks[place[here]]
            todo = todo[~here]
            if not len(todo):
                break
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for one outside the set."""
        out = self._raw(keys)
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1
        return out


class PerfectHash:
    """Shards side by side; the index of a key is its shard's first index and its own in the shard."""

    def __init__(self, shards: dict[int, Shard], count: int):
        self.shards, self.count = shards, count
        sizes = np.array([len(shards[s].keys) if s in shards else 0 for s in range(count)], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])

    def __len__(self) -> int:
        return int(self.first[-1])

    @property
    def keys(self) -> np.ndarray:
        """Every key, in index order."""
        return np.concatenate([np.zeros(0, np.uint64), *(self.shards[s].keys for s in range(self.count) if s in self.shards)])

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out, at = np.full(len(keys), -1, np.int64), shard_of(keys, self.count)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(self.count + 1))
        for s, shard in self.shards.items():
            rows = order[bounds[s]:bounds[s + 1]]
            if len(rows):
                found = shard.index(keys[rows])
                out[rows] = np.where(found < 0, -1, found + self.first[s])
        return out
