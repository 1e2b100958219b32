"""Byte-level BPE and the alignment of two tokenizers: against the tokenizer libraries and plain restatements."""

import hashlib
import os
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import AWKWARD, EXTRA, SCHEMA, documents, random_texts, rows  # noqa: E402

from tablecloak.llm import alignment, bpe, perfect, vectors  # noqa: E402

SF = "/root/testdata/sf0.001"
STRANGE = "՘a 1₏2 \U00010940x \U00011de03 �\x1c\x1d  　 \U0001f600‍ 'll'LL  \x85"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    odd = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0xD7FF), r.randrange(0xE000, 0x110000)])) for _ in range(300)) for _ in range(20)]
    runs = ["a" * 3001, "ab" * 2000, "中文" * 1500, " " * 500 + "x", "\n" * 77, "aaaabaaab" * 200, "=" * 1000, "é" * 999, "<|endoftext|> tail"]
    return random_texts(40) + AWKWARD + [(1000 + i, t) for i, t in enumerate([*odd, *runs, STRANGE])]


def numbers(ids):
    return [int.from_bytes(ids[k:k + 4], "little") for k in range(0, len(ids), 4)]


def coder(ranks):
    return bpe.Coder(bpe.split_rules(public_tokenizers.PATTERN), bpe.Vocabulary(ranks, bpe.Merges(ranks)).ids)


def test_queue_gives_the_lowest_rank():
    r, q = random.Random(1), bpe.RankQueue(50_000)
    held = {}
    for _ in range(5000):
        if held and r.random() < 0.4:
            low = q.lowest()
            assert low == min(held) and q.take(low) == sorted(held.pop(low))
        else:
            rank, at = r.choice([r.randrange(50_000), r.randrange(64)]), r.randrange(1000)
            held.setdefault(rank, []).append(at)
            q.add(rank, at)
    while held:
        low = q.lowest()
        assert q.take(low) == sorted(held.pop(low))
    assert q.lowest() == -1 and not any(any(level) for level in q.levels)


def test_merges_of_any_vocabulary():
    """Vocabularies whose entries do not come from merges in order, so that a merge can bring up a lower rank."""
    r = random.Random(2)
    for _ in range(60):
        entries = list({bytes(r.choice(b"ab") for _ in range(r.randint(2, 6))) for _ in range(14)} | {b"ab"})
        r.shuffle(entries)
        own = {bytes([b]): len(entries) + b for b in range(256)} | {e: i for i, e in enumerate(entries)}
        there = tiktoken.Encoding("t", pat_str=r"(?s).+", mergeable_ranks=own, special_tokens={})
        pieces = [p for p in (bytes(r.choice(b"aab") for _ in range(r.randint(1, 300))) for _ in range(20)) if p not in own]
        assert [numbers(c) for c in bpe.Merger(bpe.Merges(own)).ids(pieces)] == [there.encode_ordinary(p.decode()) for p in pieces]


def test_ids_are_those_of_the_library(spark, ranks, library, texts):
    docs = documents(spark, texts)
    got = rows(bpe.report(docs, ranks, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_ids_of_the_documents(spark, ranks, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for row in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect():
        assert row["ids"] == library.encode_ordinary(row["text"])


def test_encode_then_decode_keeps_other_columns(spark, ranks, texts):
    docs = documents(spark, texts).withColumnRenamed("h", "ids").withColumnRenamed("node", "decoded")
    back = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN, "_ids")
    assert back.columns == [*docs.columns, "_ids", "_decoded"]
    for row in back.collect():
        assert bytes(row["_decoded"]).decode() == (row["text"] or "") and row["ids"] == EXTRA["h"]


def test_long_texts_and_short_memory(spark, ranks, library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 100)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own, some = coder(ranks), random_texts(30, 3)
    for k in range(0, 30, 3):
        assert [numbers(c) for c in own.encode([t for _, t in some[k:k + 3]])] == [library.encode_ordinary(t) for _, t in some[k:k + 3]]
        assert len(own) == len(own.coded) < 300
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 500)
    got = rows(bpe.encode(documents(spark, texts), ranks, public_tokenizers.PATTERN), "doc_id", "ids")
    assert got == sorted(((i, library.encode_ordinary(t or "")) for i, t in texts), key=repr)


def test_a_pre_token_of_a_megabyte(ranks, library):
    """Merges grow with the length, not with its square."""
    r = random.Random(3)
    text = "".join(r.choice("abcdeilnorst") for _ in range(1 << 20))
    assert numbers(coder(ranks).encode([text])[0]) == library.encode_ordinary(text)


def test_unknown_ids_and_empty_tables(spark, ranks):
    rows_ = spark.createDataFrame([(1, [64, None]), (2, [10 ** 8]), (3, [-1]), (4, None), (5, [])], "k int, ids array<int>")
    got = {row["k"]: row["decoded"] for row in bpe.decode(rows_, ranks, public_tokenizers.PATTERN).collect()}
    assert got[1] is None and got[2] is None and got[3] is None and bytes(got[4]) == b"" and bytes(got[5]) == b""
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.report(none, ranks, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def plain_alignment(texts, both):
    """Every document's links and groups by the ends of its tokens, one by one."""
    of_a, of_b = both.entries()
    encode_a, encode_b = both.libraries()
    found, counts = [], {}
    for i, t in texts:
        a, b = (encode_a([" " + t])[0], encode_b([t])[0]) if t else ([], [])
        whole = b" " + (t or "").encode()
        if not t or b"".join(of_a[x] for x in a) != whole or b"".join(of_b[x] for x in b) != whole:
            a, b = [], []
        ends_b, at = {}, 0
        for k, x in enumerate(b):
            at += len(of_b[x])
            ends_b[at] = k
        groups, links, at, from_a, from_b = [], [], 0, 0, 0
        for k, x in enumerate(a):
            at += len(of_a[x])
            if at in ends_b:
                links.append((x, b[ends_b[at]]))
                groups.append(",".join(map(str, a[from_a:k + 1])) + "|" + ",".join(map(str, b[from_b:ends_b[at] + 1])))
                from_a, from_b = k + 1, ends_b[at] + 1
        for pair in links:
            counts[pair] = counts.get(pair, 0) + 1
        found.append((i, len(a), len(b), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(i, na, nb, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "") for i, na, nb, groups, links in found], counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_is_that_of_every_end(spark, both, texts, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD_KEYS", 1 << 10)
    monkeypatch.setattr(alignment, "BUFFERED", 100)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "FAN", 2)
    odd = [(2000, "  leading"), (2001, "tab\tand　wide ▁ sign"), (2002, "﻿bom"), (2003, "<0x41> </s> <unk>"), (2004, "é é ﬁ"), (2005, "\x00nul")]
    docs = documents(spark, texts + odd)
    want, _ = plain_alignment(texts + odd, both)
    assert any(w[1] == 0 for w in want) and sum(w[1] > 0 for w in want) > 40
    assert rows(alignment.report(docs, both), *COLUMNS) == sorted(want, key=repr)


def test_a_ids_are_those_of_the_library(spark, both, texts):
    """Pre-tokens encoded one by one give the ids of the whole text, also with letters that only one Unicode version has."""
    whole, _ = both.libraries()
    by_piece, _ = both.make()
    some = [" " + t for _, t in texts if t]
    assert [numbers(c) for c in by_piece(some)] == whole(some)
    assert both.rules()[1]
    _, by_word = both.make()
    more = [t for _, t in texts if t] + ["a  b", " a", "a ", "  ", "x y z", "a\t b\n c", "\u2581 \u2581a"]
    assert both.by_word() and [numbers(c) for c in by_word(more)] == both.libraries()[1](more)
    other = alignment.Tokenizers(both.byte_level.replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false'), both.pieces, both.pattern)
    assert other.rules() is None
    assert [numbers(c) for c in other.make()[0](some)] == other.libraries()[0](some)


def test_pairs_of_the_documents(spark, both):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, counts = plain_alignment(texts, both)
    assert rows(alignment.report(docs, both), *COLUMNS) == sorted(want, key=repr)
    got = {(r["a"], r["b"]): (r["n"], r["best"]) for r in alignment.pair_table(docs, both).collect()}
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    assert got == {p: (n, n == highest[p[1]]) for p, n in counts.items()}
    assert len(got) <= alignment.most_pairs(*both.entries())


def test_most_pairs_counts_suffixes():
    a, b = [b"a", b"ba", b"x", b"a"], [b"a", b"cba", b"y", b"a"]
    by_hand = sum(x.endswith(y) or y.endswith(x) for x in a for y in b)
    assert alignment.most_pairs(a, b) == by_hand


def test_perfect_hash_is_minimal_and_knows_its_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000).astype(np.uint64))
    at = perfect.shard_of(keys, 5)
    hashed = perfect.PerfectHash({s: perfect.Shard(np.repeat(keys[at == s], 2)) for s in range(5)}, 5)
    index = hashed.index(keys)
    assert sorted(index.tolist()) == list(range(len(keys))) and np.array_equal(hashed.keys[index], keys)
    assert (hashed.index(keys + np.uint64(1 << 62)) == -1).all()
    none = perfect.PerfectHash({}, 3)
    assert len(none) == 0 and (none.index(keys[:10]) == -1).all() and len(none.keys) == 0


def test_alignment_of_empty_tables(spark, both):
    none = spark.createDataFrame([], SCHEMA)
    assert alignment.report(none, both).count() == 0 and alignment.pair_table(none, both).count() == 0
