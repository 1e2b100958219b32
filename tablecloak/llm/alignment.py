"""How the tokens of two tokenizers line up: documents are encoded by both, and tokens that end at the same byte are linked.

One pass encodes every document and keeps the ids. A link is a pair of occurrences, of an A token and a B token, whose byte
ranges end together. Tasks count the pairs of ids of their own links; the distinct pairs of all tasks get a minimal perfect hash,
built shard by shard (``perfect``); each task's counts become a dense vector indexed by that hash, and the vectors are summed by a
tree of small groups (``vectors``). A second pass aligns the kept ids again and looks every link up, with the key verified.

What is collected and broadcast is bounded by the two vocabularies and not by the corpus. Texts before a common end are the same,
so of the two tokens of a link one's bytes are a suffix of the other's. ``most_pairs`` counts such pairs; the number of links found is
checked against it. The vocabularies themselves have the size of their files.

Defined cases: texts that are null or empty, and texts of which either tokenizer does not give back every byte, have no tokens and
count for nothing; repeated rows count each for itself; a null id is carried along like any other; an empty table gives an empty one. A
text of any length is encoded whole; Arrow batches are cut by bytes, so a long text is a batch of its own. Ties for the highest count of
a B id all count as best. Only the named columns of the documents are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import EVERY, Coder, chunks, split_rules
from .frames import bounded_batches, cut, share
from .perfect import PerfectHash, Shard, shard_of
from .vectors import SCHEMA as VECTOR, block_batch, block_rows, tree_sum
from .words import slices, text_bytes

SPACE = "\u2581"         # how pieces write a space
SAMPLE = "\ufb01 \uff21  x\u00a0e\u0301\tE"  # what a normaliser would change
SHARD_KEYS = 1 << 15   # keys of one shard of the hash, about
BUFFERED = 1 << 20     # links a task counts before it adds them to its table of distinct pairs
PIECES = 4096          # texts or pre-tokens given to the library at once
CHUNK_BYTES = 2 << 20  # text whose distinct pre-tokens are encoded together
SHIFT = np.uint64(32)  # a pair of ids as one key: the A id above, the B id below


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin signs for themselves, the other bytes in
    order for the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """The contents of the two vocabulary files, and the pattern by which byte-level vocabularies cut texts into pre-tokens."""

    byte_level: str
    pieces: bytes
    pattern: str

    @classmethod
    def read(cls, byte_level_path: str, pieces_path: str, pattern: str) -> Tokenizers:
        with open(byte_level_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
            return cls(a.read(), b.read(), pattern)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tools"}

    def entries(self) -> tuple[list[bytes], list[bytes]]:
        """The bytes of every id of A and of B."""
        from sentencepiece import SentencePieceProcessor

        described = json.loads(self.byte_level)
        signs, vocabulary = byte_of_sign(), described["model"]["vocab"]
        a = [b""] * (max([*vocabulary.values(), *(t["id"] for t in described["added_tokens"])]) + 1)
        for entry, i in vocabulary.items():
            a[i] = bytes(signs[c] for c in entry)
        for token in described["added_tokens"]:
            a[token["id"]] = token["content"].encode()
        model = SentencePieceProcessor(model_proto=self.pieces)
        b = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            b.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        return a, b

    def libraries(self):
        """(encode A, encode B): from texts to lists of ids, without special tokens."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        first, second = Tokenizer.from_str(self.byte_level), SentencePieceProcessor(model_proto=self.pieces)
        first.encode_special_tokens = True
        return (lambda texts: [e.ids for e in first.encode_batch_fast(texts, add_special_tokens=False)],
                lambda texts: second.encode(texts, num_threads=1))

    def rules(self) -> tuple[str, str, str] | None:
        """How texts are split for A; None where A splits in another way than by the pattern alone."""
        described = json.loads(self.byte_level)
        own = described["pre_tokenizer"] or {}
        if described["normalizer"] or own.get("type") != "ByteLevel" or own["add_prefix_space"] or not own["use_regex"]:
            return None

        def library(name: str) -> set[str]:
            from tokenizers import Regex, pre_tokenizers

            cut_out = pre_tokenizers.Split(Regex(name), "isolated")
            return {c for piece, _ in cut_out.pre_tokenize_str(" ".join(EVERY) if name != r"\s" else "a".join(EVERY)) for c in piece
                    if len(piece) == 1 and c not in (" " if name != r"\s" else "a")}

        return split_rules(self.pattern, library)

    def by_word(self) -> bool:
        """Does B encode a text word by word? No piece goes on after a space inside it, and texts are taken as they are."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=self.pieces)
        apart = not any(SPACE in model.id_to_piece(i).lstrip(SPACE) for i in range(model.get_piece_size()))
        return apart and model.normalize(SAMPLE) == SPACE + SAMPLE.replace(" ", SPACE)

    def make(self, rules: tuple[str, str, str] | None = None):
        """(encode A, encode B) for a task: texts to the ids of each as little-endian 32 bit numbers. With ``rules`` A encodes each
        distinct pre-token of some texts once, and so does B with words where that is the same."""
        first, second = self.libraries()
        packed = lambda library: lambda texts: [_packed(ids) for a in range(0, len(texts), PIECES) for ids in library(texts[a:a + PIECES])]
        rules = rules or self.rules()
        return (Coder(rules, packed(first)).encode if rules else packed(first)), WordCoder(packed(second)).encode if self.by_word() else packed(second)

    def in_worker(self, rules: tuple[str, str, str] | None) -> tuple:
        """(entries of A, entries of B, encode A, encode B), made once in a worker process: the coder only remembers."""
        if "tools" not in self.__dict__:
            self.__dict__["tools"] = (*self.entries(), *self.make(rules))
        return self.__dict__["tools"]


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordCoder(Coder):
    """Encodes texts by their words, each distinct one once. Texts that begin or end with a space, hold two in a row, or the
    sign that pieces have for one, are encoded as a whole."""

    def __init__(self, whole: Callable[[list[str]], list[bytes]]):
        dict.__init__(self)
        self.ids_of, self.fresh, self.coded = whole, [], []

    def encode(self, texts: list[str]) -> list[bytes]:
        even = [bool(t) and "  " not in t and SPACE not in t and t[0] != " " and t[-1] != " " for t in texts]
        by_word = iter(super().encode([t for t, e in zip(texts, even) if e]))
        whole = iter(self.ids_of([t for t, e in zip(texts, even) if not e]))
        return [next(by_word) if e else next(whole) for e in even]

    def _numbers(self, text: str) -> array:
        return array("I", map(self.__getitem__, text.split(" ")))


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """Pairs of ids of which one's bytes are a suffix of the other's: no corpus has links of more pairs."""
    def counted(entries: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for e in entries:
            out[e] = out.get(e, 0) + 1
        return out

    of_a, of_b = counted(a), counted(b)
    total = sum(n * of_b.get(e[k:], 0) for e, n in of_a.items() for k in range(len(e)))
    return total + sum(n * of_a.get(e[k:], 0) for e, n in of_b.items() for k in range(1, len(e)))


def tokens(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b): the ids of every document as little-endian numbers of 16 bits, or of 32 where a vocabulary has more ids; both
    null where it has no tokens."""
    bounded_batches(docs.sparkSession)
    held = share(docs.sparkSession, (tokenizers, tokenizers.rules()))
    kinds = [_kind(len(entries)) for entries in tokenizers.entries()]

    def run(batches: Iterator[pa.RecordBatch]):
        both, rules = held()
        of_a, of_b, encode_a, encode_b = both.in_worker(rules)
        for part in chunks(batches, 1, CHUNK_BYTES):
            texts = part.column(1).to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            a, b = [None] * len(texts), [None] * len(texts)
            for i, x, y in zip(some, encode_a([" " + texts[i] for i in some]), encode_b([texts[i] for i in some])):
                whole, x, y = b" " + texts[i].encode(), np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                if b"".join(map(of_b.__getitem__, y.tolist())) == whole and b"".join(map(of_a.__getitem__, x.tolist())) == whole:
                    a[i], b[i] = x.astype(kinds[0]).tobytes(), y.astype(kinds[1]).tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["id", "a", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, a binary, b binary")


class Links:
    """The links of the rows of one batch. Rows follow each other without a gap: both sides of a row have the same bytes, so the
    end of a row is a common end as well."""

    def __init__(self, a: pa.Array, b: pa.Array, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.rows_a = _ids(a, _kind(len(size_a)))
        self.b, self.rows_b = _ids(b, _kind(len(size_b)))
        ends_a, ends_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        _, self.at_a, self.at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        self.keys = self.a[self.at_a].astype(np.uint64) << SHIFT | self.b[self.at_b].astype(np.uint64)
        # links of each row: those that end in its A tokens
        self.first = np.searchsorted(self.at_a, self.rows_a)

    def texts(self, table_a: list[bytes], table_b: list[bytes]) -> list[bytes]:
        """The groups of each row as text. The tables hold two forms of each id: followed by a comma, and at the end of its side."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.at_a], last_b[self.at_b] = 1, 1
        # a group's A tokens come before its B tokens, so a token moves by the tokens of the other side before it
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        through_b = np.concatenate([[0], self.at_b + 1])
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + through_b[group_a]] = 2 * self.a.astype(np.int64) + last_a
        code[np.arange(len(self.b)) + (self.at_a + 1)[group_b]] = len(table_a) + 2 * self.b.astype(np.int64) + last_b
        both = table_a + table_b
        bounds, code = (self.rows_a + self.rows_b).tolist(), code.tolist()
        return [b"".join(map(both.__getitem__, code[x:y]))[:-1] for x, y in zip(bounds[:-1], bounds[1:])]


def _kind(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows and the first of each; null rows have none."""
    data, offsets = text_bytes(column)
    return np.frombuffer(data.tobytes(), kind), offsets // np.dtype(kind).itemsize


def _sizes(tokenizers: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    a, b = tokenizers.entries()
    return np.array([len(e) for e in a], np.int64), np.array([len(e) for e in b], np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate([np.zeros(0, np.int64), *counts]), len(distinct)).astype(np.int64)


def pair_counts(coded: DataFrame, sizes) -> DataFrame:
    """(keys, counts): one row of each task, its distinct pairs and how many of its links hold them."""
    def run(batches: Iterator[pa.RecordBatch]):
        size_a, size_b = sizes()
        keys, counts, waiting = [], [], 0
        for batch in batches:
            found, n = np.unique(Links(batch.column(0), batch.column(1), size_a, size_b).keys, return_counts=True)
            keys, counts, waiting = [*keys, found], [*counts, n], waiting + len(found)
            if waiting > BUFFERED:
                found, n = _merged(keys, counts)
                keys, counts, waiting = [found], [n], 0
        found, n = _merged(keys, counts)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["keys", "counts"])

    return coded.select("a", "b").mapInArrow(run, "keys binary, counts binary")


def perfect_hash(counted: DataFrame, most: int) -> PerfectHash:
    """The minimal perfect hash of the distinct pairs, built one shard a group; ``most`` bounds their number."""
    shards = max(1, most // SHARD_KEYS)

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for held in batch.column(0):
                keys = np.frombuffer(held.as_buffer(), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, shards).astype(np.int32)), pa.array(keys.view(np.int64))], names=["shard", "key"])

    def build(table: pa.Table) -> pa.Table:
        from pyspark import cloudpickle
        made = Shard(table.column("key").to_numpy().view(np.uint64))
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "made": pa.array([cloudpickle.dumps(made)], pa.binary())})

    from pyspark import cloudpickle
    distinct = counted.select("keys").mapInArrow(deal, "shard int, key bigint").distinct()
    made = distinct.groupBy("shard").applyInArrow(build, "shard int, made binary")
    out = PerfectHash({row["shard"]: cloudpickle.loads(row["made"]) for row in made.toLocalIterator()}, shards)
    if len(out) > most:
        raise RuntimeError("links of more pairs than the vocabularies allow")
    return out


def total_counts(counted: DataFrame, hashed: PerfectHash) -> np.ndarray:
    """How many links of the corpus hold each pair, in index order: dense vectors of the tasks, summed by a tree."""
    held, size = share(counted.sparkSession, hashed), len(hashed)

    def run(batches: Iterator[pa.RecordBatch]):
        vector = np.zeros(size, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                np.add.at(vector, held().index(np.frombuffer(keys.as_buffer(), np.uint64)), np.frombuffer(counts.as_buffer(), "<i8"))
        yield block_batch(list(block_rows(TaskContext.get().partitionId(), vector)))

    return tree_sum(cut(counted.mapInArrow(run, VECTOR), "pair_vectors"), size)


def align(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, PerfectHash, np.ndarray]:
    """(tokens of every document, hash of the pairs, count of each pair in index order)."""
    coded = cut(tokens(docs, tokenizers, id_col, text_col), "tokens")
    sizes = share(docs.sparkSession, _sizes(tokenizers))
    counted = cut(pair_counts(coded, sizes), "pairs")
    hashed = perfect_hash(counted, most_pairs(*tokenizers.entries()))
    return coded, hashed, total_counts(counted, hashed)


def best_of(hashed: PerfectHash, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their B id."""
    b = (hashed.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    return counts == highest[b]


def pair_table(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n, best): every pair of ids that some link holds, how many do, and whether none of its B id's pairs has more."""
    _, hashed, counts = align(docs, tokenizers, id_col, text_col)
    keys = hashed.keys
    table = pa.table({"a": pa.array((keys >> SHIFT).astype(np.int32)), "b": pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int32)),
                      "n": pa.array(counts), "best": pa.array(best_of(hashed, counts))})
    return docs.sparkSession.createDataFrame(table)


def report(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    coded, hashed, counts = align(docs, tokenizers, id_col, text_col)
    held = share(docs.sparkSession, (*_sizes(tokenizers), hashed, counts, best_of(hashed, counts)))
    tables: list[list[bytes]] = []

    def run(batches: Iterator[pa.RecordBatch]):
        size_a, size_b, index, n, best = held()
        if not tables:
            tables.extend([b"%d%c" % (i, sign) for i in range(len(size)) for sign in signs] for size, signs in ((size_a, b",|"), (size_b, b",;")))
        for batch in batches:
            for part in slices(batch, 1):
                links = Links(part.column(1), part.column(2), size_a, size_b)
                at = index.index(links.keys)
                if (at < 0).any():
                    raise RuntimeError("a link of no known pair")
                upto = lambda x: np.concatenate([[0], np.cumsum(x)])[links.first]
                groups = np.diff(links.first)
                digests = [hashlib.sha256(t).hexdigest() if t else "" for t in links.texts(*tables)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(links.rows_a)), pa.array(np.diff(links.rows_b)), pa.array(groups), pa.array(groups),
                    pa.array(np.diff(upto(best[at].astype(np.int64)))), pa.array(np.diff(upto(n[at]))), pa.array(digests, pa.string())], names=names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = coded.schema["id"].dataType.simpleString()
    found = coded.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", groups_sha256 string")
    return found.withColumnRenamed("id", id_col)
