"""Byte-level BPE: texts to token ids by the ranks of a vocabulary file, and ids back to bytes.

A text is cut by the vocabulary's pattern into pre-tokens. A pre-token that is an entry itself is that id. The others, each
distinct one of a chunk once, lie one after the other as single bytes in a linked list without links between pre-tokens; every pair of
neighbours whose joined bytes are an entry waits in the bucket of that entry's rank. A bitmap of levels, 64 flags a word, says
which buckets hold something: find-first-set from the top gives the lowest rank in as many steps as there are levels, whatever
the length. The positions of a bucket are merged at once, the leftmost of overlapping ones first; an entry whose pair has changed
since is stale and skipped. A merge makes two new pairs at most, so n bytes take n merges and 3 n bucket entries, also in a
pre-token of megabytes. Where a merge can bring up a pair of lower rank, only the leftmost position of each pre-token is merged and
the rest go back to their bucket.

Everything is one pass over the documents without a shuffle. The vocabulary is broadcast: its size is that of its file. A task
works on ``CHUNK_BYTES`` of text at once, or on one longer text, and remembers pre-tokens until it has ``REMEMBERED`` of them; this
bounds memory and changes no id.

Defined cases: a null text is an empty one and has no ids; repeated rows are encoded each by itself; an empty table gives an empty
one; ids of rows, null or repeated, are carried along; a text of any length is encoded whole, its pre-tokens taken one by one from
``LONG`` characters on. Null ids, and ids that no entry has, decode to null. A column called ``ids`` or ``decoded`` stays: the new
one gets underscores before its name. Ties cannot occur: every entry has a rank of its own, and equal ranks merge leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import bounded_batches, free_name, share
from .words import slices, text_bytes

CHUNK_BYTES = 32 << 20  # text whose pre-tokens are merged together
REMEMBERED = 1 << 18    # pre-tokens a task keeps from one chunk to the next
LONG = 1 << 20          # characters of a text whose pre-tokens are not listed at once
FLAGS = 6               # a bitmap word has 2 ** FLAGS flags
EVERY = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def read_ranks(path: str) -> dict[bytes, int]:
    """Entries and ranks of a rank file: a base64 text and a number on each line."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in file if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks lack single bytes")
    return ranks


class RankQueue:
    """Positions in buckets by rank, under a bitmap of levels: a flag of one level stands for a word of the level below."""

    def __init__(self, ranks: int):
        self.levels, size = [], ranks
        while not self.levels or size > 1:
            size = (size + (1 << FLAGS) - 1) >> FLAGS
            self.levels.append([0] * size)
        self.buckets: dict[int, list[int]] = {}

    def add(self, rank: int, *positions: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.extend(positions)
            return
        self.buckets[rank] = [*positions]
        for level in self.levels:
            word = rank >> FLAGS
            had, level[word] = level[word], level[word] | 1 << (rank & ((1 << FLAGS) - 1))
            if had:
                return
            rank = word

    def lowest(self) -> int:
        """The lowest rank with positions, or -1."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = (at << FLAGS) | ((word & -word).bit_length() - 1)
        return at

    def take(self, rank: int) -> list[int]:
        """The positions of a rank from left to right; its bucket is empty afterwards."""
        bucket = self.buckets.pop(rank)
        bucket.sort()
        for level in self.levels:
            word = rank >> FLAGS
            level[word] &= ~(1 << (rank & ((1 << FLAGS) - 1)))
            if level[word]:
                break
            rank = word
        return bucket


class Merges:
    """What the ranks allow: the entry of each pair of entries, and the ranks whose merge can bring up a lower one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.entries: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for entry, rank in ranks.items():
            self.entries[rank] = entry
        self.none = len(self.entries)   # the symbol after the last
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[e[:k]], ranks[e[k:]], rank) for e, rank in ranks.items() for k in range(1, len(e)) if e[:k] in ranks and e[k:] in ranks]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = left * (self.none + 1) + right
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], -1), np.append(made[order], -1)
        self.lower = np.zeros(self.none, bool)
        for part in (left, right):
            self.lower[part[made < part]] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it is no entry."""
        keys = left * (self.none + 1) + right
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[at] == keys, self.made[at], -1)


class Merger:
    """Ids of pre-tokens that are no entries."""

    def __init__(self, merges: Merges):
        self.merges, self.queue = merges, RankQueue(merges.none)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, four little-endian bytes an id."""
        if not pieces:
            return []
        m, queue = self.merges, self.queue
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, sizes = len(data), np.array([len(p) for p in pieces])
        first = np.cumsum(sizes) - sizes
        # a symbol is known by its first byte; place n is that after the last of every piece
        symbol = np.append(m.bytes[data], m.none)
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
        after[first[1:] - 1], after[n - 1], before[first] = n, n, -1
        pair = np.append(m.rank(symbol[:n], symbol[after[:n]]), -1)
        waiting = np.flatnonzero(pair >= 0)
        waiting = waiting[np.argsort(pair[waiting], kind="stable")]
        bounds = np.flatnonzero(np.diff(pair[waiting], prepend=-1, append=-1)).tolist()
        for x, y in zip(bounds[:-1], bounds[1:]):
            queue.add(int(pair[waiting[x]]), *waiting[x:y].tolist())
        while (rank := queue.lowest()) >= 0:
            at = np.array(queue.take(rank))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if m.lower[rank] and len(at) > 1:
                piece = np.searchsorted(first, at, "right")
                leftmost = np.append(True, piece[1:] != piece[:-1])
                if not leftmost.all():
                    queue.add(rank, *at[~leftmost].tolist())
                    at = at[leftmost]
            second = after[at]
            if len(at) > 1 and (touching := second[:-1] == at[1:]).any():
                # of positions that overlap one another in a row, every other one
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(np.append(False, touching), 0, place))
                at = at[(place - start) % 2 == 0]
                second = after[at]
            end = after[second]
            after[at], before[end], symbol[at], pair[second], alive[second] = end, at, rank, -1, False
            left = before[at]
            changed = np.concatenate([at, left[left >= 0]])
            if len(at) > 1:
                changed = np.unique(changed)
            new = m.rank(symbol[changed], symbol[after[changed]])
            pair[changed] = new
            for r, i in zip(new.tolist(), changed.tolist()):
                if r >= 0:
                    queue.add(r, i)
        ids = symbol[:n][alive].astype("<u4").tobytes()
        ends = np.cumsum(np.add.reduceat(alive, first, dtype=np.int64)) * 4
        return [ids[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _ranges(chars: set[str]) -> str:
    """The inside of a character class."""
    points, parts = sorted(map(ord, chars)), []
    for p in points:
        if parts and parts[-1][1] == p - 1:
            parts[-1][1] = p
        else:
            parts.append([p, p])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in parts)


def library_class(name: str) -> set[str]:
    """The characters that the reference library takes for the class ``name``."""
    single = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(single.decode(single.encode_ordinary(EVERY)))


def split_rules(pattern: str, theirs: Callable[[str], set[str]] = library_class) -> tuple[str, str, str]:
    """(pattern, strange, exact): texts with a character of the class ``strange`` are split by ``exact``, others by ``pattern``.

    The regular expressions here and those of the reference library know different Unicode versions. Characters that only one
    of them takes for a letter, a number or a space are strange; ``exact`` moves them to where the library has them.
    """
    strange, exact = set(), pattern
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        if name not in pattern:
            continue
        want, have = theirs(name), set(regex.findall(name, EVERY))
        if want != have:
            strange |= want ^ have
            moved = f"[{name}--[{_ranges(have - want)}]]" if have - want else name
            exact = exact.replace(name, f"[{moved}{_ranges(want - have)}]")
    return pattern, f"[{_ranges(strange)}]" if strange else "", exact


def beginnings(strange: str) -> bytes:
    """A pattern for the first two bytes of the characters of a class, all of them outside ASCII: looking for those is cheap."""
    seconds: dict[int, set[int]] = {}
    for c in regex.findall(strange, EVERY):
        seconds.setdefault(c.encode()[0], set()).add(c.encode()[1])
    one = lambda b: b"\\x%02x" % b
    return b"|".join(one(a) + b"[" + b"".join(map(one, sorted(s))) + b"]" for a, s in sorted(seconds.items()))


class Coder(dict):
    """Encodes inside a task. As a dict it numbers the pre-tokens it has seen; ``coded`` has the ids of each."""

    def __init__(self, rules: tuple[str, str, str], ids_of: Callable[[list[str]], list[bytes]]):
        super().__init__()
        plain, strange, exact = rules
        self.plain = regex.compile(plain)
        self.strange = (re.compile(beginnings(strange)), regex.compile(strange)) if strange else None
        self.exact = regex.compile(exact, regex.V1)
        self.ids_of = ids_of
        self.fresh: list[str] = []
        self.coded: list[bytes] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number

    def _numbers(self, text: str) -> array:
        odd = self.strange and not text.isascii() and self.strange[0].search(text.encode()) and self.strange[1].search(text)
        pattern = self.exact if odd else self.plain
        pieces = pattern.findall(text) if len(text) <= LONG else (match.group() for match in pattern.finditer(text))
        return array("I", map(self.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, four little-endian bytes an id."""
        if len(self) > REMEMBERED:
            self.clear()
            self.coded = []
        numbers = [self._numbers(t) for t in texts]
        fresh, self.fresh = self.fresh, []
        self.coded += self.ids_of(fresh)
        return [b"".join(map(self.coded.__getitem__, row)) for row in numbers]


class Vocabulary:
    """The ids of pre-tokens, and the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], merges: Merges):
        self.ranks, self.entries, self.merger = ranks, merges.entries, Merger(merges)

    def ids(self, pieces: list[str]) -> list[bytes]:
        wanted = [p.encode() for p in pieces]
        merged = iter(self.merger.ids([p for p in wanted if p not in self.ranks]))
        return [self.ranks[p].to_bytes(4, "little") if p in self.ranks else next(merged) for p in wanted]

    def decode(self, ids: list[int | None]) -> bytes | None:
        try:
            return b"".join(map(self.entries.__getitem__, ids)) if not ids or min(ids) >= 0 else None
        except (IndexError, TypeError):
            return None


def _tools(docs: DataFrame, ranks: dict[bytes, int], pattern: str):
    """Gives (coder, vocabulary) inside a task."""
    bounded_batches(docs.sparkSession)
    held = share(docs.sparkSession, (ranks, Merges(ranks), split_rules(pattern)))
    made: list = []

    def get() -> tuple[Coder, Vocabulary]:
        if not made:
            own, merges, rules = held()
            vocabulary = Vocabulary(own, merges)
            made.extend([Coder(rules, vocabulary.ids), vocabulary])
        return made[0], made[1]

    return get


def chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in chunks of ``limit`` bytes of text, or of one longer text."""
    waiting, size = [], 0
    for batch in batches:
        for part in slices(batch, column):
            bytes_ = int(text_bytes(part.column(column))[1][-1])
            if waiting and size + bytes_ > limit:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, size = [], 0
            waiting, size = [*waiting, part], size + bytes_
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """The documents with ``ids`` array<int>."""
    tools, at = _tools(docs, ranks, pattern), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for part in chunks(batches, at, CHUNK_BYTES):
            coded = tools()[0].encode([t or "" for t in part.column(at).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=out.names)

    out = T.StructType([*docs.schema.fields, T.StructField(free_name(docs.columns, "ids"), T.ArrayType(T.IntegerType(), True))])
    return docs.mapInArrow(run, out)


def decode(coded: DataFrame, ranks: dict[bytes, int], pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded`` binary, the bytes of their ids."""
    tools, at = _tools(coded, ranks, pattern), coded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [tools()[1].decode(ids or []) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=out.names)

    out = T.StructType([*coded.schema.fields, T.StructField(free_name(coded.columns, "decoded"), T.BinaryType(), True)])
    return coded.mapInArrow(run, out)


def report(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids as little-endian 32 bit numbers, and of what they decode to."""
    tools = _tools(docs, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]):
        for part in chunks(batches, 1, CHUNK_BYTES):
            coded = tools()[0].encode([t or "" for t in part.column(1).to_pylist()])
            n, of_ids = [len(c) // 4 for c in coded], [hashlib.sha256(c).hexdigest() for c in coded]
            of_bytes = [hashlib.sha256(tools()[1].decode(np.frombuffer(c, "<u4").tolist())).hexdigest() for c in coded]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)
