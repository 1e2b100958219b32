"""Classifiers, mixing, search and the secret scan: gradients, held-out accuracy, brute force, awkward rows."""

import os
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import ALNUM, AWKWARD, NOT_SPACE, SCHEMA, UPPER, documents, random_texts, rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from tablecloak.llm import mixing, quality, secrets, topk, toxicity  # noqa: E402
from tablecloak.llm.labelled import fold, sample  # noqa: E402
from tablecloak.llm.q_quality import op10  # noqa: E402
from tablecloak.llm.q_toxicity import op9  # noqa: E402
from tablecloak.llm.words import Words  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labelled(spark, pairs, name):
    return spark.createDataFrame(pairs, f"doc_id bigint, {name} int")


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("run,label,least", [(op9, "toxic", 0.85), (op10, "quality", 0.97)])
def test_held_out_accuracy(spark, run, label, least):
    got = run(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and auc(got.score.to_numpy(), got[label].to_numpy()) > least
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_folds(spark):
    import zlib
    got = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_sample_is_bounded_and_settles_contradictions(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(400)] + [(None, "x")])
    labels = labelled(spark, [(i, i % 2) for i in range(400)] + [(0, 1), (0, 1), (1, 0), (2, None), (None, 1)], "toxic")
    got = sample(docs, labels, "toxic", F.lit(True), 100).collect()
    assert 60 < len(got) < 140
    everything = {r.id: r.y for r in sample(docs, labels, "toxic", F.col("id") < 5, 1000).collect()}
    assert everything == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0}


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_awkward_rows(spark, none, module, label):
    texts = [(i, ("good calm words here " if i % 2 else "BAD!! $$$ idiot ") * (1 + i % 5)) for i in range(60)] + AWKWARD
    docs = documents(spark, texts)
    model = module.fit(docs, labelled(spark, [(i, i % 2) for i in range(60)], label), F.lit(True))
    got = module.score(docs, model).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    scores = {r.doc_id: r.score for r in got}
    assert min(scores[i] for i in range(1, 60, 2)) > max(scores[i] for i in range(0, 60, 2))
    assert module.score(none, model).count() == 0
    for pairs, want in (([], 0.5), ([(1, 1), (3, 1)], None)):
        flat = module.score(docs, module.fit(docs, labelled(spark, pairs, label), F.lit(True))).select("score").distinct().collect()
        assert len(flat) == 1 and (want is None or abs(flat[0].score - want) < 1e-6)
    empty = module.fit(none, labelled(spark, [], label), F.lit(True))
    assert module.score(documents(spark, [(1, "a")]), empty).count() == 1


def test_keep_good_keeps_columns(spark):
    docs = documents(spark, [(i, "fine words" if i % 2 else "### $$$") for i in range(40)])
    model = quality.fit(docs, labelled(spark, [(i, i % 2) for i in range(40)], "quality"), F.lit(True))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {1}


def test_random_indexing_by_hand(spark):
    """The vector of a word is the damped, normalised sum of its neighbours' index vectors."""
    table = quality.word_vectors(documents(spark, [(1, "a b"), (2, None), (3, "a c")]))
    place, sign = quality._index_vectors()
    at = {w: quality._buckets(quality.Words(pa.array([w]), quality.TOKENS))[0] for w in "abc"}
    want = np.zeros(quality.DIMS)
    for w in "bc":
        np.add.at(want, place[at[w]], sign[at[w]])
    want = np.sign(want) * np.log1p(np.abs(want))
    assert np.allclose(table[at["a"]], want / np.linalg.norm(want), atol=1e-6)


def test_gradients_of_the_recurrent_network():
    text = toxicity.Text(pa.array(["idiot of a word", "fine calm words and some more of them", ""]))
    y, weight = np.array([1, 0, 1], np.float32), np.array([0.5, 0.3, 0.2], np.float32)
    stats = toxicity.Statistics(np.ones((3, toxicity.BUCKETS)), np.ones((3, toxicity.BUCKETS)), 3, 4)
    p = toxicity.Parameters.new(1)
    p = toxicity.Parameters(**{k: v.astype(np.float64) for k, v in p.arrays().items()})
    steps = np.arange(toxicity.WINDOW)[:, None]
    mask = (steps < text.size).astype(np.float64)
    at = np.minimum(text.start + steps, len(text.bucket) - 1)

    def loss():
        inputs = toxicity.word_inputs(p, text, stats, at.reshape(-1)) * mask.reshape(-1, 1)
        return toxicity.gradients(p, text, at, mask, inputs.reshape(*at.shape, -1), y, weight)

    _, g = loss()
    rng = np.random.default_rng(0)
    for name, a in p.arrays().items():
        if name in ("word", "char"):  # these are only masked in the inputs of places past the end
            continue
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in a.shape)
            old, h = a[i], 1e-3
            a[i] = old + h
            up = loss()[0]
            a[i] = old - h
            down = loss()[0]
            a[i] = old
            assert abs((up - down) / (2 * h) - g[name][i]) < 2e-4 + 2e-2 * abs(g[name][i]), name


def test_windows_overlap_and_cover():
    text = toxicity.Text(pa.array(["w " * n for n in (0, 1, 31, 32, 33, 48, 49, 500)]))
    for r, n in enumerate((0, 1, 31, 32, 33, 48, 49, 500)):
        mine = text.row == r
        start, size = text.start[mine] - text.start[mine][0], text.size[mine]
        assert (np.diff(start) == toxicity.STRIDE).all() and start[-1] + size[-1] == n and (size[:-1] == toxicity.WINDOW).all()


def brute_mix(texts, sources, block=mixing.BLOCK_WORDS):
    import hashlib
    import re
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in texts]
    names = sorted({sources.get(i, "s") for i, _ in texts}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, (i, _) in zip(size, texts) if sources.get(i, "s") == s) for s in names}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    capped, all_ = set(), 1.5 * sum(total.values())
    while True:
        level = (all_ - sum(2 * total[s] for s in capped)) / (sum(weight[s] for s in names if s not in capped) or 1)
        new = {s for s in names if weight[s] * level > 2 * total[s]}
        if new == capped:
            break
        capped = new
    target = {s: min(2.0 * total[s], weight[s] * level) for s in names}
    points = {s: round(target[s] / (all_ or 1) * mixing.F45) for s in names}
    slots, k = dict.fromkeys(names, 0), -(-round(sum(target.values())) // block)
    for i in range(k):
        x, upto = i % mixing.F45 * mixing.F44 % mixing.F45, 0
        for s in names:
            upto += points[s]
            if x < upto or s == names[-1]:
                slots[s] += 1
                break
    taken = {}
    for s in names:
        mine = sorted((n for n in range(len(texts)) if sources.get(texts[n][0], "s") == s and size[n]),
                      key=lambda n: (hashlib.md5(f"{'' if texts[n][0] is None else texts[n][0]}|0".encode()).hexdigest(), texts[n][0] or 0, size[n]))
        at, end = 0, slots[s] * block
        for n in mine:
            taken[n] = sum(max(0, min(a + size[n], end) - a) for a in (at, at + total[s]))
            at += size[n]
    return sorted(((i, size[n], total[sources.get(i, "s")], round(target[sources.get(i, "s")], 6), taken.get(n, 0)) for n, (i, _) in enumerate(texts)), key=repr), slots


@pytest.mark.parametrize("block", [1, 64])
def test_mix(spark, block):
    texts = random_texts(50) + AWKWARD[:7]
    sources = {i: [None, "a", "b", "é", "Z"][i % 5] for i in range(50)} | {903: "tiny", 902: "no words"}
    want, _ = brute_mix(texts, sources, block)
    got = mixing.mix(documents(spark, texts, sources), block_words=block)
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got.collect()), key=repr) == want
    assert all(r[4] <= 2 * r[1] for r in want)


def test_mix_follows_targets_in_every_stretch(spark):
    sources = spark.createDataFrame([("a", 0, 10_000, 6000.0), ("b", 1, 10_000, 1000.0), ("c", 2, 10_000, 3000.0)], "source string, rank bigint, source_size bigint, target double")
    order = [r.rank for r in mixing.schedule(sources, 10).orderBy("slot").collect()]
    for n in (50, 100, 500, 1000):
        assert all(abs(order[:n].count(k) - n * share) <= 3 for k, share in enumerate((0.6, 0.1, 0.3)))


def test_mix_of_nothing(none):
    assert mixing.mix(none).count() == 0


def brute_top(vectors, k, asks):
    import math
    fine = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in fine:
        first[i] = min(first.get(i, v), v)
    out = []
    for q, v in first.items():
        if asks(q):
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block,shard,few,once", [(2048, 2048, 1 / 32, 2048), (3, 16, 0.0, 2), (3, 7, 1.0, 1)])
def test_top_k(spark, monkeypatch, block, shard, few, once):
    import random
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", once)
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "FEW", few)
    r = random.Random(4)
    vectors = [(i, [r.choice([-0.5, 0.1, 0.25, 0.3, 0.9]) for _ in range(5)]) for i in range(120)]
    vectors += [(20, [0.1] * 5), (200, None), (201, []), (202, [0.1, None, 0.2, 0.3, 0.4]), (203, [float("nan")] * 5), (204, [float("inf")] * 5),
                (220, [0.5, 0.5]), (221, [0.25, 0.75]), (None, [0.1] * 5), (300, [1e6] * 5), (301, [-1e6] * 5)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors], "vec_id bigint, embedding array<float>, id string, score string").repartition(4)
    vectors = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = topk.top_k(frame, F.col("id") % 20 == 0, k=4, query_block=block)
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(brute_top(vectors, 4, lambda i: i % 20 == 0), key=repr)


def cells_read(values, asked, k, shard_rows=256):
    """(cells read, cells there are, results equal to those of all products)."""
    ids, read, whole = np.arange(len(values)), 0, 0
    queries, best = values[asked], [(np.zeros(0, np.int64),) * 3]
    for a in range(0, len(values), shard_rows):
        shard = topk.Lists(ids[a:a + shard_rows], values[a:a + shard_rows])
        i, x, s = best[0]
        floor = np.full(len(asked), -np.inf)
        for q in range(len(asked)):
            if (i == q).sum() >= k:
                floor[q] = s[i == q].min()
        i2, j2, s2, cells = topk.search(ids[asked], queries, shard, k, floor)
        best[0] = topk._best(np.concatenate([i, i2]), np.concatenate([x, shard.ids[j2]]), np.concatenate([s, s2]), k)
        read, whole = read + cells, whole + len(shard.ids) * int(np.count_nonzero(queries))
    i, x, s = best[0]
    for q, own in enumerate(asked):
        all_ = values @ queries[q]
        want = sorted(((-int(v), c) for c, v in enumerate(all_) if c != own))[:k]
        assert [(-int(v), int(c)) for v, c in zip(s[i == q], x[i == q])] == want
    return read, whole


def test_lists_of_skewed_vectors_are_not_read_to_their_ends():
    """Few large components: the threshold falls under the floor early. The first shard, without a floor, stops early as well."""
    rng = np.random.default_rng(2)
    skewed = np.floor(64 * rng.standard_normal((4000, 24)) * (rng.random((4000, 24)) < 0.08)).astype(np.float64)
    read, whole = cells_read(skewed, np.arange(0, 4000, 97), 10)
    assert read < 0.5 * whole
    heavy = np.floor(rng.pareto(1.1, (3000, 8)) * 20).astype(np.float64)
    read, whole = cells_read(heavy, np.arange(0, 3000, 61), 5)
    assert read < 0.25 * whole
    first, n = cells_read(heavy[:256], np.arange(0, 256, 17), 5)
    assert first < n


def test_lists_of_even_vectors_give_the_same():
    rng = np.random.default_rng(3)
    for values in (rng.integers(-3, 4, (500, 6)), rng.integers(0, 2, (300, 3)), np.zeros((100, 4)), np.floor(64 * rng.standard_normal((600, 32)))):
        cells_read(values.astype(np.float64), np.arange(0, len(values), 23), 7, 64)


def test_top_k_refuses_ids_that_are_no_numbers(spark):
    with pytest.raises(TypeError):
        topk.top_k(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"), F.lit(True))


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.lit(True)).count() == 0


def test_secrets(spark, none):
    import random
    r = random.Random(0)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    words = ["internationalisation", "straightforwardness", "thequickbrownfoxjumps"]
    texts = [(i, f"é text of a page with {r.choice(words)} in it\n" + (f'api token = "{hexa(40)}" and more' if i % 2 else "see " + r.choice(words))) for i in range(120)]
    texts += [(500, f"commit {hexa(40)} fixed"), (501, 'token = "aaaaexampleaaaaaaaaa"')] + AWKWARD
    docs = documents(spark, texts)
    got = secrets.scan(docs, path_col="source").collect()
    by_id = dict(texts)
    for row in got:
        body = (by_id[row.doc_id] or "")[row.start:row.end]
        assert len(body) >= secrets.SHORTEST and all(c in "_+/=-" or (c.isascii() and c.isalnum()) for c in body)
    found = {(r.doc_id, by_id[r.doc_id][r.start - 1]) for r in got if r.secret and r.doc_id < 120}
    assert found == {(i, '"') for i in range(1, 120, 2)}
    marked = spark.createDataFrame([(r.doc_id, r.start, float(r.doc_id == 500)) for r in got], "id bigint, start int, label double")
    taught = secrets.scan(docs, marked).where("doc_id = 500").collect()
    assert taught[0].score > max(r.score for r in secrets.scan(docs, marked).where("doc_id < 50").collect())
    assert secrets.scan(none).count() == 0


def test_secret_dictionary_does_not_grow_with_the_corpus(spark, monkeypatch):
    """Forty copies of every document have the same dictionary; pieces of tokens are no words of it."""
    import random
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(300)]
    texts = [(i, " ".join(r.choice(vocabulary[:k]) for k in (5, 30, 300) for _ in range(20)) + f" rare{'x' * i} 12abc34") for i in range(80)]
    docs = documents(spark, texts)
    monkeypatch.setattr(secrets, "COMMON", 1e-3)
    once = secrets.corpus_tables(docs)[1]
    more = secrets.corpus_tables(docs.crossJoin(spark.range(40).select()))[1]
    assert 0 < len(once) < 300 and np.array_equal(once, more)
    hashes = secrets.span_hashes(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3]))
    assert "abc" in vocabulary or not secrets._among(hashes, once)[0]


def test_secrets_in_other_places_than_quotes(spark):
    """KEY=value, unquoted and short secrets are found and kept; assigned and quoted words are not; no context feature tells the label."""
    import random
    r = random.Random(1)
    token = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = []
    for i in range(60):
        texts += [(10 * i, f"export DB_PASSWORD={token(24)}"), (10 * i + 1, f"api key: {token(32)} is live"), (10 * i + 2, f'password = "{token(10)}"'),
                  (10 * i + 3, 'title = "internationalisation"'), (10 * i + 4, "the internationalisation of it"), (10 * i + 5, f"commit {token(40)} fixed")]
    texts += [(9001, "here AKIA" + "Q7Z2" * 4 + " alone")]
    docs, by_id = documents(spark, texts), dict(texts)
    got = secrets.scan(docs).collect()
    left = {(x.doc_id, by_id[x.doc_id][x.start:x.end]) for x in got if x.secret}
    for i in range(60):
        assert (10 * i, by_id[10 * i].split("=")[1]) in left and (10 * i + 1, by_id[10 * i + 1].split()[2]) in left
        assert (10 * i + 2, by_id[10 * i + 2].split('"')[1]) in left
        assert not any(d in (10 * i + 3, 10 * i + 4, 10 * i + 5) for d, _ in left)
    found = secrets.findings(docs).cache()
    known = found.join(secrets.structural_labels(found), ["id", "start"])
    for name in ("assigned", "quoted", "keyword_before"):
        assert known.groupBy(name).agg(F.countDistinct("label").alias("n")).where("n > 1").count() > 0


def test_secrets_without_labels_of_both_classes_are_all_reported(spark):
    got = secrets.scan(documents(spark, [(1, "some internationalisation here"), (2, "and straightforwardness there")])).collect()
    assert len(got) == 2 and all(x.secret for x in got)


def test_one_task_sorts_only_the_sample(spark, monkeypatch):
    """A shuffle lies between the join of the labels and the one task."""
    plans, cut = [], secrets.cut
    monkeypatch.setattr(secrets, "cut", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if label == "labelled_findings" else None, cut(df, label))[1])
    secrets.scan(documents(spark, [(1, "some internationalisation here")]))
    assert len(plans) == 1 and "Coalesce 1" not in plans[0] and "REPARTITION_BY_NUM" in plans[0]


def test_name_and_value_are_parted():
    cut_at = lambda t: [t.encode()[a:b].decode() for a, b in zip(*secrets._candidates(Words(pa.array([t]), secrets.CANDIDATE))[:2])]
    assert cut_at("export DB_PASSWORD=abc123456 x") == ["DB_PASSWORD", "abc123456"]
    assert cut_at("QUJDREVGR0hJSktM== =abc12345") == ["QUJDREVGR0hJSktM==", "abc12345"]
    assert cut_at("sentence Sentence SENTENCE: hunterhunter 'hunters2'") == ["hunterhunter", "hunters2"]
    assert cut_at("a==b1234567=c12345678") == ["b1234567=c12345678"] and cut_at("====") == [] and cut_at("") == []


def test_pipeline(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = base
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF).cache()
        assert kept.columns == base.columns, name
        assert kept.select("doc_id").distinct().count() <= docs.count()
        docs = kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert rows(out, *out.columns) == rows(corpus_pipeline.run(spark, SF), *out.columns)
    # documents with a good label that share nothing with others come through
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").count()
    assert docs.count() > good


def plain_lines(given):
    """(id, text) of rows after later copies of pairs of lines and of long lines went; rows that lost all lines are gone."""
    from tablecloak.llm import lines
    parts = sorted({(i is None, i or 0, t) for i, t in given if t is not None})
    first, gone = {}, {}
    for k in parts:
        ls, lost = k[2].split("\n"), set()
        for a, x in enumerate(ls):
            if a + 1 < len(ls) and first.setdefault((x, ls[a + 1]), (k, a)) != (k, a):
                lost |= {a, a + 1}
            long = len(re.findall(NOT_SPACE, x)) >= lines.LONE_WORDS or len("".join(re.findall(NOT_SPACE, x))) >= lines.LONE_CHARS * lines.LONE_WORDS
            if long and first.setdefault(x, (k, a)) != (k, a):
                lost.add(a)
        gone[k] = (ls, lost)
    out = []
    for i, t in given:
        if t is None:
            out.append((i, None))
            continue
        ls, lost = gone[(i is None, i or 0, t)]
        if len(lost) < len(ls):
            out.append((i, "\n".join(x for a, x in enumerate(ls) if a not in lost)))
    return out


def plain_near(given, words=5):
    """One row of each class of linked sets, that with the smallest id, a null id last; rows without words stay, equal rows once."""
    rows_ = list(dict.fromkeys(given))
    sets = []
    for _, t in rows_:
        w = re.findall(NOT_SPACE, (t or "").translate(UPPER))
        sets.append({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    group = list(range(len(rows_)))
    for a in range(len(rows_)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for n, (i, t) in enumerate(rows_):
        key = ("alone", n) if not sets[n] else group[n]
        best[key] = min(best.get(key, (True, float("inf"), n)), (i is None, i or 0, n))
    return [rows_[n] for _, _, n in best.values()]


def plain_clean(given, bench, window=10):
    hits = set()
    for t in bench:
        w = re.findall(ALNUM, (t or "").translate(UPPER))
        k = min(window, len(w))
        hits |= {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if w else set()
    out = []
    for i, t in given:
        w = re.findall(ALNUM, (t or "").translate(UPPER))
        if not any(tuple(w[a:a + k]) in hits for k in {len(h) for h in hits} for a in range(len(w) - k + 1)):
            out.append((i, t))
    return out


def test_pipeline_against_plain_rules(spark):
    """Real and awkward rows: nulls, empty and long texts, repeated rows and ids, clashing columns. Each stage on what the one before it kept."""
    sf = "/root/testdata/sf0.001"
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    given = real + AWKWARD + [(950, real[0][1]), (951, real[0][1] + " and more"), (real[1][0], real[2][1] + " of another kind"), (952, "so " + (bench[0] or "") + " it was"),
                              (953, real[3][1] + "\n" + real[4][1]), (None, real[5][1]), (None, None)]
    docs = documents(spark, given, {i: ("a", "b", None)[n % 3] for n, (i, _) in enumerate(given)})
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf).cache()
    assert kept.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), fold(F.col("id"), 5) != 0)
    scored = quality.score(docs, model, out="own score").where("`own score` >= 0.3")
    assert rows(kept, "doc_id", "text") == rows(scored, "doc_id", "text")
    docs = docs.where("doc_id IS NULL OR doc_id IS NOT NULL")  # later stages see all rows, also those the first would reject
    now = given
    for k, plain in ((1, plain_lines), (2, plain_near), (3, lambda x: plain_clean(x, bench))):
        docs, now = corpus_pipeline.STAGES[k][1](spark, docs, sf).cache(), plain(now)
        assert docs.schema.names == kept.columns
        if k == 2:
            # of equal ids in one class the text is chosen by hash
            assert sorted((i is None, i or 0) for i, _ in rows(docs, "doc_id", "text")) == sorted((i is None, i or 0) for i, _ in now)
            now = rows(docs, "doc_id", "text")
        else:
            assert rows(docs, "doc_id", "text") == sorted(now, key=repr), corpus_pipeline.STAGES[k][0]
    out = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    size = lambda t: len(re.findall(NOT_SPACE, t or ""))
    assert sorted((r.size for r in out)) == sorted(size(t) for _, t in now) and all(0 <= r.taken <= 2 * r.size for r in out)
    assert sum(r.taken for r in out) == pytest.approx(1.5 * sum(size(t) for _, t in now), rel=0.05)


def test_pipeline_of_nothing(spark, none):
    sf = "/root/testdata/sf0.001"
    docs = none
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == none.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0
