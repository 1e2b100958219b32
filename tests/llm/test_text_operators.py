"""Decontamination, line dedup, substring dedup, near dedup, personal data: against plain restatements, with awkward rows."""

import os
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import ALNUM, AWKWARD, SCHEMA, UPPER, documents, near_classes, random_texts, rows, sha, substring_digest  # noqa: E402

from tablecloak.llm import decontaminate, graph, lines, minhash, pii, substrings  # noqa: E402
from tablecloak.llm.words import NOT_SPACE, ODD, Words, mix, slices  # noqa: E402


@pytest.fixture(scope="module")
def texts():
    return random_texts() + AWKWARD


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_hashes():
    texts = ["a bb\tccc", None, "", " x ", "é" * 40 + " " + "q" * 200, "a bb"]
    w = Words(pa.array(texts))
    assert w.counts.tolist() == [3, 0, 0, 1, 2, 2]
    h = w.hashes()
    assert h[0] == h[6] and h[1] == h[7] and len(set(h.tolist())) == 6
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    assert sum(s.num_rows for s in slices(batch.slice(2), 0, 3)) == 4
    assert np.array_equal(Words(batch.slice(4).column(0), NOT_SPACE).hashes(), h[4:])


def items(spark, rows_):
    return spark.createDataFrame(rows_, "item_id string, text string")


def contamination(texts, bench, window=10):
    out = []
    for i, t in texts:
        w = re.findall(ALNUM, (t or "").translate(UPPER))
        hit, found = set(), set()
        for item, x in bench:
            v = re.findall(ALNUM, (x or "").translate(UPPER))
            k = min(window, len(v))
            for s in range(len(v) - k + 1) if v and item is not None else ():
                for a in range(len(w) - k + 1):
                    if w[a:a + k] == v[s:s + k]:
                        hit |= set(range(a, a + k))
                        found.add(item)
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_contamination(spark, docs, texts, block):
    whole = next(t for _, t in texts if len(t.split()) > 30)
    bench = [("10", whole), ("9", " ".join(whole.split()[3:17])), ("short", "Two WORDS"), ("nothing", "nowhere to be found at all"), ("null", None), (None, "one"), ("empty", " ")]
    got = decontaminate.contamination(docs, items(spark, bench), block_words=block)
    assert rows(got, *got.columns) == contamination(texts, bench)
    kept = decontaminate.decontaminate(docs, items(spark, bench), block_words=block)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted(((r[0],) for r in contamination(texts, bench) if not r[5]), key=repr)


def test_longest_match(spark):
    docs = documents(spark, [(1, "z a b c d e f g h i j k l m y"), (2, "a b c d e f g h i j q")])
    got = decontaminate.matches(docs, items(spark, [("t", "a b c d e f g h i j k l m n")]))
    assert {(r.doc_id, h.start, h.length) for r in got.collect() for h in r.hits} == {(1, 1, 13), (2, 0, 10)}


def test_substrings(docs, texts):
    got = substrings.dedup_substrings(docs, report=True)
    assert rows(got, *got.columns) == substring_digest(texts)
    clean = substrings.dedup_substrings(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    untouched = {i for i, _, gone, _ in substring_digest(texts) if not gone}
    assert {(i, t) for i, t in texts if i in untouched} <= {(r.doc_id, r.text) for r in clean.collect()}


def test_substrings_with_very_frequent_anchors(docs, texts, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_PASSAGES", 1)
    monkeypatch.setattr(substrings, "FILTER_BITS", 64)
    got = substrings.dedup_substrings(docs, report=True)
    assert rows(got, *got.columns) == substring_digest(texts)


def _words_of_equal_hash() -> tuple[str, str]:
    """Two words of 16 signs that ``span_hashes`` cannot tell apart: the second half of each undoes the difference of the first."""
    heads = np.frombuffer("".join(f"{i:08d}" for i in range(4000)).encode(), "<u8")
    keys = (mix(mix(np.uint64(16) * np.array([ODD], np.uint64)) ^ heads) * np.uint64(ODD)).tolist()
    for i, a in enumerate(keys):
        for b, other in zip(keys[i + 1:], heads[i + 1:].tolist()):
            if not (gap := a ^ b) & 0x8080808080808080:
                tail = bytes(next((x for x in range(0x21, 0x7F) if 0x21 <= x ^ g < 0x7F), 0) for g in gap.to_bytes(8, "little"))
                if 0 not in tail:
                    twin = bytes(x ^ g for x, g in zip(tail, gap.to_bytes(8, "little")))
                    return (int(heads[i]).to_bytes(8, "little") + tail).decode(), (other.to_bytes(8, "little") + twin).decode()
    raise AssertionError("no pair")


def test_substrings_of_words_whose_hashes_are_equal(spark):
    one, two = _words_of_equal_hash()
    w = Words(pa.array([f"{one} {two}"]), NOT_SPACE)
    assert one != two and len(set(w.hashes().tolist())) == 1
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join([*words[:15], x, *words[15:]])) for i, x in enumerate((one, two, one))]
    got = substrings.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string"), report=True)
    assert rows(got, *got.columns) == substring_digest(texts)
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == [0, 30, 31]


def test_automaton_statistics():
    a = substrings.Automaton()
    a.add(list("abcde"), 1)
    a.add(list("bcdx"), 2)
    assert a.statistics(list("zbcdxabc"), 3, 9) == [9, 1, 2, 9, 9, 1]
    assert a.statistics(list("ab"), 3, 9) == []


def test_near_classes(docs, texts):
    got = minhash.classes(docs, words=4)
    assert rows(got, *got.columns) == near_classes(texts)
    kept = minhash.dedup(docs, words=4)
    assert kept.columns == docs.columns
    # of rows equal in id and text one stays
    assert rows(kept, "doc_id") == sorted({(i, t): (i,) for (i, t), (_, _, _, k) in zip(texts, near_classes_of_rows(texts)) if k}.values(), key=repr)


def near_classes_of_rows(texts):
    found = {(i, n): (i, n, c, k) for i, n, c, k in near_classes(texts)}
    return [found[i, len(shingle_set(t))] for i, t in texts]


def shingle_set(t, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
    return {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


A = " ".join(f"a{i}" for i in range(30))


@pytest.mark.parametrize("given, want", [
    ([(1, A), (2, A), (2, "b c d e f g")], [(1, A), (2, "b c d e f g")]),
    ([(1, A), (1, A), (1, A + " x")], [(1, None)]),
    ([(None, A), (None, A), (5, A)], [(5, A)]),
    ([(None, A), (None, A), (None, "other words here now")], [(None, A), (None, "other words here now")]),
    ([(1, ""), (2, ""), (2, ""), (None, None), (None, None), (3, "  ")], [(1, ""), (2, ""), (3, "  "), (None, None)]),
    ([(2, "x y"), (1, "X Y"), (3, "x  y")], [(1, "X Y")])])
def test_dedup_keeps_one_of_each_class_and_no_text_less(spark, given, want):
    """Repeated ids with other texts, equal rows, null ids, rows without words."""
    got = rows(minhash.dedup(documents(spark, given), words=4), "doc_id", "text")
    if want == [(1, None)]:
        assert len(got) == 1 and got[0][0] == 1
    else:
        assert got == sorted(want, key=repr)


def test_near_classes_of_one_large_group(spark, monkeypatch):
    """A family of near copies, most of them not linked with its leader, in blocks of very few shingles."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    texts = random_texts(n=1, seed=3, words=40)
    import random
    r = random.Random(5)
    base = [f"w{r.randrange(50)}" for _ in range(60)]
    texts = [(i, " ".join(x if r.random() > 0.035 else f"v{r.randrange(9)}" for x in base)) for i in range(150)]
    got = minhash.classes(documents(spark, texts), words=4)
    assert rows(got, *got.columns) == near_classes(texts)


def test_pairs_of_blocks_are_dealt_out(spark, monkeypatch):
    """A bucket of many blocks: the pairs of blocks are keyed by both numbers, and none is lost."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 120)
    import random
    r = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    # texts that share a beginning, so bands collide, in several families of near copies
    texts = []
    for i in range(120):
        tail = [f"t{i % 6}x{k}" for k in range(14)]
        texts.append((i, " ".join([*base, *(x if r.random() > 0.02 else "y" for x in tail)])))
    got = minhash.classes(documents(spark, texts), words=4)
    assert rows(got, *got.columns) == near_classes(texts)


def test_blocks_of_a_benchmark_are_written_one_by_one(spark, docs, texts, monkeypatch):
    """Forty items in blocks of few words: the plan holds one Python operator, and the result is that of one block."""
    bench = items(spark, [(f"i{k}", " ".join((t or "").split()[:15])) for k, (_, t) in enumerate(texts[:40])])
    one = decontaminate.matches(docs, bench)
    many = decontaminate.matches(docs, bench, block_words=100)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    flat = lambda f: rows(f.withColumn("hits", F.array_sort("hits")), "doc_id", "n_words", "n_hit", "hits")
    assert flat(one) == flat(many)
    left = decontaminate.decontaminate(docs, bench, block_words=100)
    assert left._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert rows(left, "doc_id") == rows(decontaminate.decontaminate(docs, bench), "doc_id")


def test_bayesian_bounds():
    """At the threshold a pair outlives every batch with probability 1 - 1e-4 at least; at 0.3 hardly any does."""
    rng, fewest = np.random.default_rng(0), minhash.fewest_matches(0.8)
    for s, low, high in ((0.8, 0.9999, 1), (0.3, 0, 1e-3)):
        same = rng.random((20_000, minhash.SIGNATURE)) < s
        b = np.where(same, 0, 1)
        share = len(minhash._survivors(np.zeros_like(b), b, fewest)) / len(b)
        assert low <= share <= high


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (200, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def line_digest(texts, m):
    """Rows that repeat id and text are one document; null ids come last."""
    parts = {}
    for i, t in texts:
        if t is not None:
            parts[(i is None, i, t)] = t.split("\n")
    order = sorted(parts, key=lambda k: (k[0], k[1] or 0))
    first = {}
    for k in order:
        for a in range(len(parts[k]) - m + 1):
            first.setdefault(tuple(parts[k][a:a + m]), (k, a))
    out = []
    for i, t in texts:
        ls = [] if t is None else t.split("\n")
        k, gone = (i is None, i, t), set()
        for a in range(len(ls) - m + 1):
            if first[tuple(ls[a:a + m])] != (k, a):
                gone |= set(range(a, a + m))
        runs = sum(x in gone and x - 1 not in gone for x in range(len(ls)))
        out.append((i, len(ls), len(gone), runs, sha("\n".join(x for n, x in enumerate(ls) if n not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("m", [2, 3])
def test_lines(spark, m):
    import random
    r = random.Random(2)
    run = [f"shared {k}" for k in range(12)]
    texts = []
    for i in range(30):
        ls = [f"l{r.randrange(6)}" for _ in range(r.randint(1, 8))]
        if i % 3 == 0:
            a = r.randrange(6)
            ls[1:1] = run[a:a + 6]
        texts.append((i, "\n".join(ls)))
    texts += [(40, texts[3][1]), (41, None), (42, ""), (43, "\n\n"), (44, "\n\n\n"), (3, texts[3][1]), (None, texts[5][1])]
    docs = documents(spark, texts)
    got = lines.dedup_lines(docs, min_lines=m, report=True)
    assert rows(got, "doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256") == line_digest(texts, m)
    kept = lines.dedup_lines(docs, min_lines=m)
    assert kept.columns == docs.columns
    lost = {i for i, n, gone, _, _ in line_digest(texts, m) if n and n == gone}
    assert {x.doc_id for x in kept.select("doc_id").collect()} == {i for i, _ in texts} - lost


def lone_digest(texts, words):
    """What is left when later copies of pairs of lines and of long lines go."""
    parts = [(i, t.split("\n")) for i, t in texts]
    first, out = {}, {}
    for i, ls in parts:
        gone = set()
        for a, x in enumerate(ls):
            w = x.split()
            if a + 1 < len(ls) and first.setdefault((x, ls[a + 1]), (i, a)) != (i, a):
                gone |= {a, a + 1}
            if (len(w) >= words or len("".join(w)) >= lines.LONE_CHARS * words) and first.setdefault(x, (i, a)) != (i, a):
                gone.add(a)
        if len(gone) < len(ls):
            out[i] = "\n".join(x for a, x in enumerate(ls) if a not in gone)
    return out


@pytest.mark.parametrize("words", [None, 1, 3, lines.LONE_WORDS])
def test_single_long_lines(spark, words):
    """One planted line among lines that differ: its first copy stays, later ones go; short and blank lines stay."""
    import random
    r = random.Random(4)
    passage, unspaced, short = " ".join(f"word{k}" for k in range(60)), "漢字" * 40, "two words"
    texts = []
    for i in range(40):
        ls = [r.choice([f"own {i} {k}", f"l{r.randrange(5)} a b", passage, unspaced, short, "", " " * 80, "l1"]) for k in range(r.randint(1, 9))]
        texts.append((i, "\n".join(ls)))
    texts += [(50, f"x\n{passage}\ny"), (51, passage), (52, f"{passage}\n{unspaced}\n{passage}")]
    got = {x.doc_id: x.text for x in lines.dedup_lines(documents(spark, texts), lone_words=words).collect()}
    assert got == lone_digest(texts, 10_000 if words is None else words)
    if words is not None:
        assert sum(t.count(passage) for t in got.values()) == 1 and got[50] == "x\ny" and 51 not in got


def test_line_rounds_double(spark):
    run = "\n".join(f"x{k}" for k in range(20))
    docs = documents(spark, [(1, "a\n" + run), (2, "b\n" + run + "\nc")])
    depths = [d for d, f in lines.suffix_rounds(docs)]
    assert depths == [2, 4, 8, 16]


def luhn(digits):
    t = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def base_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for n, (k, p) in enumerate(kinds.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), n, f"{k}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


PII = [
    (1, "écrire à a.b@c.de, a@b.c_d@e.f.g x@y a@@b.c q@r..s.t @x.y"), (2, "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.255 1.2.3"),
    (3, "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 12 1" + "0" * 30), (4, "call +1 (743) 555-3824. +12 3 or +1234567890123456 +49.30.1234567-"),
    (5, "card 4111111111111111 ip 10.0.0.1 mail x@y.org phone +33 1 23 45 67 89"), (6, None), (7, ""), (8, "nothing here"), (8, "nothing here"),
    (9, "mail x@y.org"), (9, "mail x@y.org"), (None, "ip 10.0.0.1"), (10, "9" * 40_000), (11, "a." * 30_000 + "@" + "b." * 30_000 + "c"), (12, "1 " * 30_000), (13, "+1" + "-" * 40_000 + "2"),
    (14, "write to jane at mail dot com or phone 743 555-3824 please, license 4.0.1.2"),
]


def test_personal_data(spark):
    got = {}
    for r in pii.report(documents(spark, PII)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i in {i for i, _ in PII}:
        want = [base_spans(t) for j, t in PII if j == i]
        assert len(got[i]) == len(want)
        for r, w in zip(sorted(got[i], key=lambda r: r.base_sha256), sorted(want, key=lambda w: sha(",".join(w)))):
            assert r.base_sha256 == sha(",".join(w))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in w) for k in pii.KINDS]
            assert set(w) <= set(r.spans.split(",") if r.spans else [])


def personal_corpus(n, seed):
    """Base spans of each kind with and without words around them, numbers that look like cards and fail the check digit, written-out
    addresses and national numbers where they are personal, and digits of the same shape where they are not."""
    import random
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(good):
        while True:
            c = r.choice("45") + digits(15)
            total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(x) for x in c))
            if (total % 10 == 0) == good:
                return c
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    made, texts = [], []
    for i in range(n):
        kind = i % 8
        written = f"{name()} at {name()} dot com"
        national = f"{r.randint(200, 999)} {r.randint(200, 999)}-{digits(4)}"
        texts.append((i, [f"please mail {name()}@{name()}.com soon", f"pay by card {card(True)} today", f"order {card(False)} was sent", f"the host address {r.randint(1, 220)}.{r.randint(0, 255)}.0.{r.randint(1, 255)} is up",
                          f"call +1 {r.randint(200, 999)} {r.randint(200, 999)} {digits(4)} now", f"write to {written} please", f"phone {national} please", f"section {name()} 12-34 and 999.{r.randint(256, 900)}.1.1"][kind]))
        made.append((kind, texts[-1][1], card, written, national))
    return texts, made


@pytest.fixture(scope="module")
def two_sizes(spark):
    texts, _ = personal_corpus(240, 11)
    more, _ = personal_corpus(6000, 12)
    small = {r.doc_id: r.spans for r in pii.report(documents(spark, texts)).collect()}
    # the same documents within a corpus of another size and mix
    large = {r.doc_id: r.spans for r in pii.report(documents(spark, texts + [(1000 + i, t) for i, t in more if i % 8 in (0, 2, 3, 6)])).collect()}
    return texts, small, large


def test_numbers_that_fail_the_check_digit_are_no_cards(two_sizes):
    texts, small, large = two_sizes
    for i, t in texts:
        for found in (small[i], large[i]):
            if i % 8 == 2:
                assert found == ""
            if i % 8 == 1:
                assert found.startswith("card:") and found.count(":") == 2


def test_added_spans_are_found_at_both_sizes(two_sizes):
    texts, small, large = two_sizes
    for found in (small, large):
        for i, t in texts:
            if i % 8 == 5:
                start, end = t.index("to ") + 3, t.index(" please")
                assert found[i] == f"email:{start}:{end}", t
            if i % 8 == 6:
                assert found[i] == f"phone:6:{t.index(' please')}", t


def test_verdicts_do_not_depend_on_the_rest_of_the_corpus(two_sizes):
    _, small, large = two_sizes
    assert small == {i: large[i] for i in small}


def test_gazetteers_are_counted(spark):
    texts, _ = personal_corpus(240, 11)
    lists = pii.gazetteers(pii.candidates(documents(spark, texts), "doc_id", "text"))
    assert lists["email"] == ["com"] and set(x[0] for x in lists["card"]) <= {"4", "5"} and lists["phone"] == [] and len(lists["ip"]) > 10


def test_labelers_that_vote_alike_count_once():
    rows_ = [{f"v_{x}": 1 for x in pii.LABELERS} | {"n": 50}, {f"v_{x}": 0 for x in pii.LABELERS} | {"n": 40, "v_context": 1}]
    assert pii.independent(rows_) == ["pattern", "valid", "context"]


def test_labelers_learn_reliabilities():
    """Votes that agree with the truth get reliable, one that is drawn at random does not."""
    rng, patterns = np.random.default_rng(1), {}
    for _ in range(4000):
        y = rng.random() < 0.5
        v = {f"v_{x}": int(y if rng.random() < 0.9 else not y) for x in pii.LABELERS}
        v["v_borders"] = int(rng.random() < 0.5)
        key = tuple(v.items())
        patterns[key] = patterns.get(key, 0) + 1
    table = pii.reliabilities([dict(k) | {"kind": "email", "n": n} for k, n in patterns.items()])["email"]["table"]
    assert 0.85 < table["valid", 1, 1] < 0.95 and abs(table["borders", 1, 1] - table["borders", 1, 0]) < 0.1


def test_empty_tables(spark, none):
    bench = items(spark, [("a", "some words of a test item")])
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.contamination(documents(spark, [(1, "a b")]), items(spark, [])).collect()[0].n_words == 2
    assert substrings.dedup_substrings(none, report=True).count() == 0
    assert minhash.classes(none).count() == 0 and minhash.dedup(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert pii.report(none).count() == 0
