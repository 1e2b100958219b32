"""Small tables with every awkward row, and plain restatements of the rules."""

import hashlib
import random
import re

NOT_SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = {i: i + 32 for i in range(65, 91)}
EXTRA = {"id": "x", "h": "y", "score": "z", "n_words": "w", "starts": "s", "_i": "i", "_lost": "l", "node": "n", "runs": "r", "size": "t"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA)


def documents(spark, texts, sources=None):
    """``texts``: (id, text) pairs; further columns have names that operators might use themselves."""
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or ""), *EXTRA.values()) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def random_texts(n=60, seed=1, words=40, vocabulary=30):
    """Texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    passage = [[r.choice(vocab) for _ in range(25)] for _ in range(4)]
    out, made = [], []
    for i in range(n):
        if made and r.random() < 0.3:
            w = list(r.choice(made))
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.randint(1, words))]
        if r.random() < 0.4:
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passage)
        made.append(w)
        out.append((i, "".join(x + r.choice([" ", "  ", "\n", "\t"]) for x in w)))
    return out


AWKWARD = [(900, None), (901, ""), (902, "   \n\t"), (903, "one"), (903, "one"), (904, "Two Words"), (None, "a row without an id"), (905, "x" * 50_000), (906, "long " * 20_000)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_digest(texts, window=13):
    first, words = {}, {}
    for n, (i, t) in enumerate(texts):
        words[n] = w = re.findall(NOT_SPACE, t or "")
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k:k + window])
                first[x] = min(first.get(x, i), i)
    out = []
    for n, (i, t) in enumerate(texts):
        w, gone = words[n], set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def near_classes(texts, words=4, percent=80):
    sets = []
    for i, t in texts:
        w = re.findall(NOT_SPACE, (t or "").translate(UPPER))
        sets.append({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if texts[a][0] is not None and texts[b][0] is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(texts):
        if i is not None:
            least[root(n)] = min(least.get(root(n), i), i)
    return sorted(((i, len(sets[n]), None if i is None else least[root(n)], i is None or least[root(n)] == i) for n, (i, _) in enumerate(texts)), key=repr)


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
