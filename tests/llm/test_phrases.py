"""Phrase mining against a plain restatement, with hot prefixes, long texts and awkward rows."""

import os
import random
import re
import sys
from collections import Counter

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import AWKWARD, SCHEMA, UPPER, documents, random_texts, rows  # noqa: E402

from tablecloak.llm import collocations  # noqa: E402

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(texts, least, top):
    """``texts``: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, t in texts:
        lang = lang or "und"
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, x), a in candidates.items():
        for size in range(2, len(x)):
            for s in range(len(x) - size + 1):
                if 100 * a >= 80 * f[lang, x[s:s + size]]:
                    gone.add((lang, x[s:s + size]))
    out = {}
    for (lang, x), a in candidates.items():
        if (lang, x) not in gone:
            score, _, l, r = min((2_000_000 * a // (f[lang, x[:k]] + f[lang, x[k:]]), k, f[lang, x[:k]], f[lang, x[k:]]) for k in range(1, len(x)))
            out.setdefault(lang, []).append((score, a, " ".join(x), l, r))
    return sorted([(lang, i, p, a, l, r, n[lang], score) for lang, found in out.items()
                   for i, (score, a, p, l, r) in enumerate(sorted(found, key=lambda q: (-q[0], -q[1], q[2].encode()))[:top], 1)], key=repr)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    base = random_texts(150, 9, 60, 18) + AWKWARD
    return [(r.choice(["en", "en", "en", "fr", "und", None]), None if t is None else re.sub(" ", lambda _: r.choice([" ", " ", " ", ", ", ".", "\r\n", "\t"]), t)) for _, t in base]


def frame(spark, texts):
    docs = documents(spark, [(i, t) for i, (_, t) in enumerate(texts)]).drop("lang")
    langs = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(texts)], "doc_id bigint, lang string")
    return docs.join(langs, "doc_id").repartition(5)


@pytest.mark.parametrize("budget", [1 << 20, 300, 10])
def test_phrases(spark, texts, budget):
    """Small budgets extend the prefixes of most words, by one word and then by more."""
    want = plain(texts, 5, 40)
    assert len(want) > 60 and {w[0] for w in want} >= {"en", "und"}
    assert rows(collocations.collocations(frame(spark, texts), 40, 5, budget=budget), *COLUMNS) == want


def test_full_tables_change_nothing(spark, texts, monkeypatch):
    """Tables with a few slots only: no suffix is cut short, groups are coarse."""
    monkeypatch.setattr(collocations, "PAIR_SLOTS", 4)
    monkeypatch.setattr(collocations, "WORD_SLOTS", 3)
    assert rows(collocations.collocations(frame(spark, texts), 40, 5, budget=500), *COLUMNS) == plain(texts, 5, 40)


def test_texts_longer_than_a_batch(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "KNOWN_WORDS", 5)
    monkeypatch.setattr(collocations, "PART_BYTES", 64)
    long = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["ab cd, " * 100 + "x" * 200 + " y. z"])], names=["lang", "text"])
    parts = list(collocations._parts(long))
    assert len(parts) > 10 and b"".join(p.column(1)[0].as_py() for p in parts).decode() == long.column(1)[0].as_py()
    assert rows(collocations.collocations(frame(spark, texts), 40, 5), *COLUMNS) == plain(texts, 5, 40)


def test_words_of_one_hash_are_counted_anew(spark, texts, monkeypatch):
    """With the first seed all words of one length, or of the next, have one hash."""
    real = collocations.span_hashes

    def weak(data, starts, ends):
        # spaces are spaces with the first seed only
        return (ends - starts).astype("uint64") | 1 if (data == 0x20).any() else real(data, starts, ends)

    seeds = []
    monkeypatch.setattr(collocations, "_sketch", lambda seed, least, real=collocations._sketch: seeds.append(seed) or real(seed, least))
    monkeypatch.setattr(collocations, "span_hashes", weak)
    assert rows(collocations.collocations(frame(spark, texts), 40, 5), *COLUMNS) == plain(texts, 5, 40)
    assert seeds == [0, 1]


def test_phrases_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(none).count() == 0
    blank = spark.createDataFrame([(None, None), ("en", ""), ("en", " .,")], "lang string, text string")
    assert collocations.collocations(blank).count() == 0
