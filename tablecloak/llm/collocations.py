"""Phrases of words that belong together, mined from depth-truncated suffix trees over the words of all documents.

A suffix starts at a word and is cut after ``DEPTH`` words, or at the end of its piece of text. Suffixes are parted vertically, by the
words they begin with: prefixes that occur seldom are put together until a group's suffixes fill the memory budget, prefixes
that occur more often than that are extended by their next word, up to whole truncated suffixes. Each group is one task's work
and builds its trees alone: sorted distinct suffixes with their counts are the leaves, and a node's count is the total of its leaves. Only
nodes of extended prefixes lie in several groups, and their totals are added up afterwards.

A first scan fills two tables of fixed size: occurrences by slot of a hash of the word, which decide the groups, and by slot of
two neighbouring words, up to ``min_count``. A slot's total is no less than that of any word or pair in it, so a
suffix is cut before the first pair whose slot stays below ``min_count``: no phrase across it can be frequent. That only saves
shuffling; where the tables are too small for a corpus, more is shuffled and the result is the same.

A phrase's association is the lowest over its cuts into a first and a last part: 2,000,000 * a / (l + r), a, l and r the
occurrences of the phrase and of the parts, rounded down. Phrases contained in a longer frequent one that occurs at least 80 % as often go.

Bounds: the tables are ``PAIR_SLOTS`` bytes and ``WORD_SLOTS`` numbers, groups at most ``MOST_GROUPS``; nothing else is broadcast or
collected. A group has at most ``budget`` occurrences unless a slot or a whole suffix has more by itself; of a whole suffix it holds one
row for each batch. Words are 64 bit hashes on the way; the words themselves come with the counts, and where two share a hash the work is
done again with other hashes.

Defined cases: a null text is empty, a null language is ``und`` and the same as that word; repeated rows and null ids count like any other;
empty tables give no rows. A text longer than a batch is worked off in parts that end at ends of pieces. Ties are
ranked by count and then by the phrase's bytes, so ranks are unique. Only the named columns are read, others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .frames import bounded_batches, cut, share
from .vectors import block_rows, tree_sum
from .words import ODD, Words, byte_class, mix, slices, span_hashes, text_bytes

DEPTH = 4
MIN_COUNT = 30
SHARE = 80             # a phrase goes if a longer one around it has this percentage of its occurrences
SCALE = 2_000_000
TOP = 2000
WORD_SLOTS = 1 << 18
PAIR_SLOTS = 1 << 24
PART_BYTES = 4 << 20   # text whose suffixes are counted together
KNOWN_WORDS = 1 << 20  # words of which a task remembers that it has sent them
BUDGET = 1 << 20       # occurrences of suffixes in a group, 48 bytes each while its trees are built
MOST_GROUPS = 1 << 20  # beyond it the budget is doubled
SALTS = 64             # parts in which the first phrases of a language are found before they meet
SEEDS = 8
UNKNOWN = "und"
SEPARATOR = byte_class(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
WORD = byte_class(lambda b: b not in b" \t" and not SEPARATOR[b])
W = [f"w{i + 1}" for i in range(DEPTH)]
KEY = ["lang", *W]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(lang, text) in parts of about ``PART_BYTES``; a longer text is cut after a separator where it has one."""
    for part in slices(batch, 1, PART_BYTES):
        data, offsets = text_bytes(part.column(1))
        if part.num_rows > 1 or len(data) <= PART_BYTES:
            yield part
            continue
        ends, start = np.flatnonzero(SEPARATOR[data]) + 1, 0
        while start < len(data):
            k = np.searchsorted(ends, start + PART_BYTES, "right") - 1
            end = int(ends[k]) if k >= 0 and ends[k] > start else int(ends[k + 1]) if k + 1 < len(ends) else len(data)
            end = len(data) if len(data) - start <= PART_BYTES else end
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([data[start:end].tobytes()], pa.large_binary())], names=["lang", "text"])
            start = end


class Sequence:
    """The words of one part: hashes, the language of each, and whether the next word is in the same piece."""

    def __init__(self, part: pa.RecordBatch, seed: int):
        self.words = w = Words(part.column(1), WORD, lower=True)
        coded = part.column(0).fill_null(UNKNOWN).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w.row]
        self.hashes = span_hashes(w.data ^ np.uint8(seed), w.starts, w.ends)
        self.distinct, self.ids = np.unique(self.hashes, return_inverse=True)
        piece = np.cumsum(SEPARATOR[w.data], dtype=np.int32)[w.starts] if len(w) else np.zeros(0, np.int64)
        self.joined = np.zeros(len(w), bool)
        self.joined[:-1] = (w.row[1:] == w.row[:-1]) & (piece[1:] == piece[:-1])
        names = [t.encode() for t in self.langs]
        ends = np.cumsum([len(t) for t in names], dtype=np.int64)
        salts = span_hashes(np.frombuffer(b"".join(names), np.uint8), ends - [len(t) for t in names], ends) if names else np.zeros(0, np.uint64)
        # the word together with its language, for slots only
        self.own = mix(self.hashes ^ salts[self.lang] * np.uint64(ODD)) if len(w) else self.hashes
        self.word_slot = (self.own % np.uint64(WORD_SLOTS)).astype(np.int64)
        self.pair_slot = (mix(self.own * np.uint64(ODD) + np.append(self.hashes[1:], np.uint64(0))) % np.uint64(PAIR_SLOTS)).astype(np.int64) if len(w) else self.word_slot

    def text(self, i: int) -> bytes:
        return self.words.data[self.words.starts[i]:self.words.ends[i]].tobytes()


def _sketch(seed: int, least: int):
    """The tables of one task, and its number of words of each language."""
    kind = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]):
        pairs, words, total = np.zeros(PAIR_SLOTS, kind), np.zeros(WORD_SLOTS, np.int64), {}
        for batch in batches:
            for part in _parts(batch):
                s = Sequence(part, seed)
                slot, n = np.unique(s.pair_slot[s.joined], return_counts=True)
                pairs[slot] = np.minimum(pairs[slot] + n, least)
                words += np.bincount(s.word_slot, minlength=WORD_SLOTS)
                for lang, n in zip(s.langs, np.bincount(s.lang, minlength=len(s.langs)).tolist()):
                    total[lang] = total.get(lang, 0) + n
        here = TaskContext.get().partitionId()
        for table, vector in (("pairs", pairs), ("words", words)):
            for part, block, data in block_rows(here, vector):
                yield pa.RecordBatch.from_arrays([pa.array([table]), pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary()),
                                                  pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], names=names)
        m = len(total)
        yield pa.RecordBatch.from_arrays([pa.array(["langs"] * m, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
                                          pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=names)

    names = ["table", "part", "block", "vector", "lang", "n"]
    return run


class Partition:
    """Which group the suffixes of a prefix belong to."""

    def __init__(self, words: np.ndarray, budget: int):
        while words.sum() > budget * MOST_GROUPS:
            budget *= 2
        self.hot = words > budget
        light = np.where(self.hot, 0, words)
        # slots in order, as many to a group as the budget holds
        self.group = np.zeros(len(words), np.int64)
        filled, group = 0, 0
        for slot, n in enumerate(light.tolist()):
            if filled + n > budget:
                filled, group = 0, group + 1
            filled += n
            self.group[slot] = group
        self.light = group + 1
        self.extended = max(1, -(-int(words[self.hot].sum()) // budget))

    def groups(self, s: Sequence, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The group of the suffixes that start at ``at`` and have ``depth`` words."""
        out = self.group[s.word_slot[at]]
        prefix, going = s.own[at].copy(), self.hot[s.word_slot[at]]
        extended = going.copy()
        for k in range(1, DEPTH):
            going = going & (depth > k)
            more = np.flatnonzero(going)
            prefix[more] = mix(prefix[more] * np.uint64(ODD) + s.hashes[at[more] + k])
            going[more] = self.hot[s.word_slot[at[more] + k]]
        out[extended] = self.light + (mix(prefix[extended]) % np.uint64(self.extended)).astype(np.int64)
        return out


COLUMNS = ["group", "lang", "words", "hot", "windows", "counts", "named", "texts"]
ROWS = "group int, lang string, " + ", ".join(f"{c} binary" for c in COLUMNS[2:])


def _suffixes(seed: int, least: int, tables):
    """Rows of ``ROWS``: for each group and language of a part its distinct suffixes in order, with their counts. ``windows`` has ``DEPTH``
    numbers for each, 0 for none, else the place from 1 on in ``words``, hashes of the words that occur here; ``hot`` says which of
    them are extended as prefixes. ``texts`` has the words at the places ``named``: those that suffixes start with, where the task
    has not sent them before."""
    def run(batches: Iterator[pa.RecordBatch]):
        pairs, words, partition = tables()
        sent: set[int] = set()
        for batch in batches:
            for part in _parts(batch):
                if len(sent) > KNOWN_WORDS:
                    sent.clear()
                yield _suffix_rows(Sequence(part, seed), pairs, words, partition, least, sent)
    return run


def _suffix_rows(s: Sequence, pairs: np.ndarray, words: np.ndarray, partition: Partition, least: int, sent: set[int]) -> pa.RecordBatch:
    may = words[s.word_slot] >= least
    step = s.joined & may & (pairs[s.pair_slot] >= least)
    at, depth = np.flatnonzero(may), np.ones(int(may.sum()), np.int64)
    table, going = np.zeros((len(at), DEPTH), np.int64), np.ones(len(at), bool)
    table[:, 0] = s.ids[at] + 1
    for k in range(1, DEPTH):
        going &= step[np.minimum(at + k - 1, len(step) - 1)]
        depth += going
        table[going, k] = s.ids[at[going] + k] + 1
    place = partition.groups(s, at, depth) * max(1, len(s.langs)) + s.lang[at]
    first, second = table[:, 0] << 32 | table[:, 1], table[:, 2] << 32 | table[:, 3]
    order = np.lexsort((second, first, place))
    place, first, second = place[order], first[order], second[order]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1]))) if len(order) else order
    counts = np.diff(np.append(new, len(order))).astype("<u4")
    table, at, place = table[order[new]], at[order[new]], place[new]
    bounds = np.flatnonzero(np.append(True, place[1:] != place[:-1])).tolist() if len(place) else []
    rows = []
    for x, y in zip(bounds, [*bounds[1:], len(place)]):
        block = table[x:y]
        used, where, local = np.unique(block, return_index=True, return_inverse=True)
        if used[0]:
            local = local + 1
        else:
            used, where = used[1:], where[1:]
        hot = partition.hot[s.word_slot[at[x + where // DEPTH] + where % DEPTH]]
        kind = "<u2" if len(used) < 1 << 16 else "<u4"
        starts, by = np.unique(local.reshape(-1, DEPTH)[:, 0], return_index=True)
        new = [j for j, own in enumerate(s.own[at[x + by]].tolist()) if own not in sent]
        sent.update(s.own[at[x + by[new]]].tolist())
        rows.append((int(place[x]) // len(s.langs), s.langs[int(place[x]) % len(s.langs)], s.distinct[used - 1].astype("<u8").tobytes(), np.packbits(hot).tobytes(),
                     local.astype(kind).tobytes(), counts[x:y].tobytes(), starts[new].astype(kind).tobytes(), b" ".join(s.text(at[x + by[j]]) for j in new)))
    columns = zip(*rows) if rows else [()] * len(COLUMNS)
    kinds = [pa.int32(), pa.string(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=COLUMNS)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[bytes]]:
    """(hashes, counts, hot) of the suffixes of one row, and the words it names: hashes and texts."""
    counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
    kind = "<u2" if len(row["windows"]) == 2 * DEPTH * len(counts) else "<u4"
    places = np.frombuffer(row["windows"], kind).reshape(-1, DEPTH)
    words = np.concatenate([np.zeros(1, np.uint64), np.frombuffer(row["words"], "<u8")])
    hot = np.concatenate([np.zeros(1, bool), np.unpackbits(np.frombuffer(row["hot"], np.uint8))[:len(words) - 1].astype(bool)])
    named = np.frombuffer(row["named"], kind)
    return words[places], counts, hot[places], words[named].tolist(), row["texts"].split(b" ") if len(named) else []


def _trees(least: int):
    """The nodes of one group: (lang, w1.., a, low, high). The text of a word stands at its node of one word, as the least and
    the greatest text with that hash. Nodes whose words are all extended are kept whatever their count: other groups have the rest."""
    def build(table: pa.Table) -> pa.Table:
        out = []
        rows = table.select(COLUMNS).to_pylist()
        for name in sorted({r["lang"] for r in rows}):
            windows, counts, hot, starts, named = zip(*(_unpacked(r) for r in rows if r["lang"] == name))
            windows, counts, hot = np.concatenate(windows), np.concatenate(counts), np.concatenate(hot)
            order = np.lexsort(tuple(windows[:, k] for k in reversed(range(DEPTH))))
            windows, counts, hot = windows[order], counts[order], hot[order]
            texts: dict[int, tuple[bytes, bytes]] = {}
            for h, t in ((h, t) for hs, ts in zip(starts, named) for h, t in zip(hs, ts)):
                low, high = texts.get(h, (t, t))
                texts[h] = (min(low, t), max(high, t))
            for d in range(1, DEPTH + 1):
                deep = np.flatnonzero(windows[:, d - 1] > 0)
                if not len(deep):
                    break
                w = windows[deep, :d]
                start = np.flatnonzero(np.append(True, (w[1:] != w[:-1]).any(axis=1)))
                a = np.add.reduceat(counts[deep], start)
                spread = hot[deep[start], :d].all(axis=1) & (d < DEPTH)
                keep = np.flatnonzero((a >= least) | spread)
                nodes = np.zeros((len(keep), DEPTH), "<u8")
                nodes[:, :d] = w[start[keep]]
                # a word that is extended has its text in one of its groups
                named = [texts.get(h, (None, None)) for h in nodes[:, 0].tolist()] if d == 1 else [(None, None)] * len(keep)
                out.append(pa.table({"lang": pa.array([name] * len(keep), pa.string()), **{c: pa.array(nodes[:, k].copy().view("<i8")) for k, c in enumerate(W)}, "a": pa.array(a[keep]),
                                     **{c: pa.array([None if t[j] is None else t[j].decode() for t in named], pa.string()) for j, c in enumerate(("low", "high"))}}))
        return pa.concat_tables(out)
    return build


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals): (lang, w1..w4, a, word) of every phrase of one to four words that occurs ``min_count`` times or more, as
    hashes with 0 after the last; the word itself where it is one. (lang, n): occurrences of words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    for seed in range(SEEDS):
        first = cut(source.mapInArrow(_sketch(seed, min_count), "table string, part int, block int, vector binary, lang string, n bigint"), "phrase_tables")
        kind = np.min_scalar_type(min_count).str
        pairs = tree_sum(first.where("table = 'pairs'").select("part", "block", "vector"), PAIR_SLOTS, kind, min_count)
        words = tree_sum(first.where("table = 'words'").select("part", "block", "vector"), WORD_SLOTS)
        tables = share(spark, (pairs, words, Partition(words, budget)))
        rows = source.mapInArrow(_suffixes(seed, min_count, tables), ROWS)
        nodes = rows.groupBy("group").applyInArrow(_trees(min_count), "lang string, " + ", ".join(f"{w} bigint" for w in W) + ", a bigint, low string, high string")
        nodes = cut(nodes.groupBy(*KEY).agg(F.sum("a").alias("a"), F.min("low").alias("word"), F.max("high").alias("high")).where(F.col("a") >= min_count), "phrases")
        if nodes.where("word <> high").isEmpty():
            return nodes.drop("high"), first.where("table = 'langs'").groupBy("lang").agg(F.sum("n").alias("n"))
    raise RuntimeError("words with equal hashes")


def _sub(start: int, size: int) -> list:
    """The key columns of ``size`` words from word ``start`` on."""
    return [F.col(W[start + k]) if k < size else F.lit(0).cast("bigint") for k in range(DEPTH)]


def _depth() -> F.Column:
    return reduce(lambda x, y: x + y, [(F.col(w) != 0).cast("int") for w in W])


def scored(nodes: DataFrame) -> DataFrame:
    """(lang, w1..w4, a, best): phrases of two words and more; best is (score, k, l, r) of the lowest cut."""
    phrases = nodes.where("w2 <> 0").select(*KEY, "a", _depth().alias("d"))
    sides = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *[c.alias(f"p{i}") for i, c in enumerate(key)])
             for k in range(1, DEPTH) for side, key in (("l", _sub(0, k)), ("r", _sub(k, DEPTH - k)))]
    cuts = phrases.select(*KEY, "a", F.inline(F.filter(F.array(*sides), lambda x: x["k"] < F.col("d"))))
    keys = ["lang", *[f"p{i}" for i in range(DEPTH)]]
    known = nodes.select("lang", *[F.col(w).alias(f"p{i}") for i, w in enumerate(W)], F.col("a").alias("f"))
    part = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    wide = lookup_join(cuts, known, keys, "inner").groupBy(*KEY, "a").agg(*[part(k, side) for k in range(1, DEPTH) for side in "lr"])
    score = lambda k: F.expr(f"cast(a as decimal(19, 0)) * {SCALE} div cast(l{k} + r{k} as decimal(20, 0))")
    made = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, DEPTH)]
    return wide.select(*KEY, "a", F.array_min(F.array(*made)).alias("best"))


def not_contained(phrases: DataFrame, share_percent: int = SHARE) -> DataFrame:
    """The phrases that no longer one around them has ``share_percent`` of the occurrences of."""
    inner = [F.struct(F.lit(start + size).alias("needs"), F.lit(size).alias("size"), *[c.alias(f"p{i}") for i, c in enumerate(_sub(start, size))])
             for size in range(2, DEPTH) for start in range(DEPTH - size + 1)]
    spans = phrases.select("lang", "a", _depth().alias("d"), F.explode(F.array(*inner)).alias("x")).where((F.col("x.needs") <= F.col("d")) & (F.col("x.size") < F.col("d")))
    over = spans.groupBy("lang", *[F.col(f"x.p{i}").alias(w) for i, w in enumerate(W)]).agg(F.max("a").alias("over"))
    exact = lambda c, by: F.col(c).cast("decimal(19, 0)") * by
    return phrases.join(over, KEY, "left").where(F.col("over").isNull() | (exact("over", 100) < exact("a", share_percent))).drop("over")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    nodes, totals = frequent(docs, min_count, lang_col, text_col, budget)
    left = cut(not_contained(scored(nodes)), "collocations")
    places = F.filter(F.array(*[F.struct(F.lit(k).alias("at"), F.col(w).alias("w")) for k, w in enumerate(W)]), lambda x: x["w"] != 0)
    words = nodes.where("w2 = 0").select("lang", F.col("w1").alias("w"), "word")
    spelled = lookup_join(left.select(*KEY, F.inline(places)), words, ["lang", "w"], "inner").groupBy(*KEY).agg(
        F.concat_ws(" ", *[F.max(F.when(F.col("at") == k, F.col("word"))) for k in range(DEPTH)]).alias("phrase"))
    named = left.join(spelled, KEY).select("lang", "phrase", "a", "best.*", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
