"""MinHash near-dedup with sequential Bayesian verification.

A document is the set of its distinct word shingles. Documents with equal sets are one node (a 128 bit digest of the set), so
copies never meet each other. Nodes get ``BANDS * ROWS`` minhashes; nodes that agree on a band share a bucket. At the
similarity threshold a pair misses every band with probability (1 - t**ROWS)**BANDS, about 3e-6 for 0.8.

Candidates are verified in sequence: batches of signature values are compared, and a pair is pruned as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold falls below ``MISS``. Survivors are confirmed on the
full sets.

Pairs of a bucket are not listed. First every member is verified against the bucket's leader only. Buckets whose members
are then one component are done; in the others the members outside the leader's component meet all members, in blocks of
a bounded number of shingles, and a pair is looked at only in the first band it shares. So a tight group of any size costs
one comparison per member, and no link between different components is lost.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text with fewer words than a shingle is
one shingle; rows that repeat an id with other texts are documents of their own. In ``classes`` a row with a null id is in no
class and kept, with a null component, and repeated rows are kept or not by their id; in ``dedup`` a null id is an id like any
other, the last in order, and of equal rows one stays. Ties, that is equal ids in a class, go by a hash of the text. Long texts are
taken whole, in slices of a few megabytes or one row; a text's own set is held by one task. An empty table gives an empty one. Only
the named columns are read, others keep their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, cut, free_name
from .graph import components
from .words import NOT_SPACE, ODD, Words, mix, slices, window_hashes

BANDS, ROWS = 24, 4
SIGNATURE = BANDS * ROWS
BATCH = 16          # signature values compared at a time
MISS = 1e-6         # posterior probability below which a pair is pruned
PERCENT = 80        # 100 * |intersection| >= PERCENT * |union|
BLOCK_SHINGLES = 1 << 16


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each) of the word shingles of each text, repeats included."""
    h = w.hashes()
    full = window_hashes(h, k)
    at = np.flatnonzero(w.left[:len(full)] >= k)
    out, row = full[at], w.row[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = np.array([window_hashes(h[w.first[r]:w.first[r + 1]], int(w.counts[r]))[0] for r in short], np.uint64)
        # of another length, so never equal to a full shingle
        whole = mix(whole ^ (w.counts[short].astype(np.uint64) * np.uint64(ODD)))
        out, row = np.concatenate([out, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return mix(out), row


def _multipliers() -> np.ndarray:
    return mix((np.arange(SIGNATURE, dtype=np.uint64) + np.uint64(1)) * np.uint64(ODD)) | np.uint64(1)


def _sets(part: pa.RecordBatch, column: int, k: int) -> list[np.ndarray]:
    w = Words(part.column(column), NOT_SPACE, lower=True)
    h, row = shingles(w, k)
    bounds = np.searchsorted(row, np.arange(w.rows + 1))
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _digest(s: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    a, b = mix(s * np.uint64(ODD)).sum(dtype=np.uint64), mix(s ^ np.uint64(ODD)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(mix(np.array([b + np.uint64(len(s))], np.uint64))[0]).to_bytes(8, "big")


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        factors = _multipliers()
        for batch in batches:
            for part in slices(batch, 1):
                sets = _sets(part, 1, k)
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                starts = (np.cumsum(n) - n)[some]
                signature = np.empty((len(some), SIGNATURE), "<u4")
                for j, f in enumerate(factors):
                    if len(some):
                        signature[:, j] = np.minimum.reduceat(flat * f, starts) >> np.uint64(32)
                node, sig = [None] * len(sets), [None] * len(sets)
                for i, r in enumerate(some.tolist()):
                    node[r], sig[r] = _digest(sets[r]), signature[i].tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())],
                                                 names=["id", "h", "n", "node", "sig"])
    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 0):
                sets = [s for s in _sets(part, 0, k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["node", "full"])
    return run


def fewest_matches(t: float, miss: float = MISS) -> list[int]:
    """For n = BATCH, 2 * BATCH, ... compared values: the fewest matches at which the similarity still reaches ``t`` with a
    posterior probability of ``miss`` or more. The posterior is Beta(m + 1, n - m + 1); its tail is a binomial sum."""
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail, m = (1 - t) ** (n + 1), 0
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _survivors(a: np.ndarray, b: np.ndarray, fewest: list[int]) -> np.ndarray:
    """Which pairs of signatures outlive every batch."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(fewest):
        at = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (a[alive, at] == b[alive, at]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SIGNATURE)


def _prune(fewest: list[int]):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            alive = _survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), fewest)
            yield batch.select([0, 1]).take(pa.array(alive))
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3))
            ok = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in pairs]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
    return run


def _blocks(fewest: list[int], percent: int):
    """Links between the members outside the leader's component (left) and all members (right) of one bucket."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for band, left, right in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out += _block_links(band, left, right, fewest, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])
    return run


def _block_links(band: int, left: list[dict], right: list[dict], fewest: list[int], percent: int) -> list[tuple[bytes, bytes]]:
    ls = np.frombuffer(b"".join(x["sig"] for x in left), "<u4").reshape(-1, SIGNATURE)
    rs = np.frombuffer(b"".join(x["sig"] for x in right), "<u4").reshape(-1, SIGNATURE)
    ln, rn = np.array([x["n"] for x in left]), np.array([x["n"] for x in right])
    names = {c: i for i, c in enumerate({x["c"] for x in left} | {x["c"] for x in right})}
    lc, rc = np.array([names[x["c"]] for x in left]), np.array([names[x["c"]] for x in right])
    # other component, sizes that allow the similarity, each pair once
    ok = (lc[:, None] != rc[None, :]) & (100 * np.minimum(ln[:, None], rn[None, :]) >= percent * np.maximum(ln[:, None], rn[None, :]))
    outside = np.array([x["u"] for x in right])
    order = np.array([x["node"] for x in left], dtype="S16")[:, None] < np.array([x["node"] for x in right], dtype="S16")[None, :]
    i, j = np.nonzero(ok & (~outside[None, :] | order))
    if band and len(i):
        earlier = np.zeros(len(i), bool)
        for k in range(band):
            at = slice(k * ROWS, (k + 1) * ROWS)
            todo = np.flatnonzero(~earlier)
            earlier[todo] = (ls[i[todo], at] == rs[j[todo], at]).all(axis=1)
        i, j = i[~earlier], j[~earlier]
    alive = _survivors(ls[i], rs[j], fewest) if len(i) else np.zeros(0, int)
    i, j = i[alive], j[alive]
    best = np.argsort(-(ls[i] == rs[j]).sum(axis=1), kind="stable") if len(i) else alive
    parent = list(range(len(names)))

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    full: dict[tuple[int, int], np.ndarray] = {}

    def whole(side: int, at: int) -> np.ndarray:
        if (side, at) not in full:
            full[side, at] = np.frombuffer((left, right)[side][at]["full"], np.uint64)
        return full[side, at]

    out = []
    for p in best.tolist():
        a, b = int(i[p]), int(j[p])
        if root(lc[a]) != root(rc[b]) and _linked(whole(0, a), whole(1, b), percent):
            parent[root(lc[a])] = root(rc[b])
            out.append((left[a]["node"], right[b]["node"]))
    return out


def rooted(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, null_ids: bool) -> DataFrame:
    """(id, h, n, node, root) for each row: a hash of its text, the size and digest of its set, and the class of that set; null
    digest and class without words. With ``null_ids`` rows without an id link sets like any other."""
    bounded_batches(docs.sparkSession)
    fewest = fewest_matches(percent / 100)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = texts.select("id", "text", F.xxhash64("text").alias("h"))
    base = cut(hashed.mapInArrow(_sketch(words), f"id {kind}, h bigint, n bigint, node binary, sig binary"), "sketches")
    rows_ = base.where("node IS NOT NULL") if null_ids else base.where("node IS NOT NULL AND id IS NOT NULL")
    nodes = cut(rows_.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("first"), F.first("n").alias("n"),
                                             F.first("sig").alias("sig")), "nodes")

    # buckets with two nodes or more; of those with the same members, the one of the first band
    spots = nodes.select("node", F.col("sig").substr(1, 4 * SIGNATURE).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    spots = spots.select("band", "node", F.xxhash64("band", F.expr(f"substring(s, band * {4 * ROWS} + 1, {4 * ROWS})")).alias("key"))
    mark = F.xxhash64("node").cast("decimal(20,0)")
    buckets = spots.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("node").alias("leader"), F.sum(mark).alias("mark")).where("size > 1")
    buckets = buckets.groupBy("size", "mark", "leader").agg(F.min(F.struct("band", "key")).alias("k")).select("k.band", "k.key", "size", "leader")
    members = cut(spots.join(buckets, ["band", "key"]), "members")

    # full sets of the nodes that share a bucket
    shared = members.select("node").distinct()
    one = nodes.join(shared, "node", "left_semi").select(F.col("first.id").alias("_i"), F.col("first.h").alias("_h"))
    full = hashed.join(one, F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")), "left_semi").select("text").mapInArrow(_full_sets(words), "node binary, full binary")
    sets = cut(full.join(shared, "node", "left_semi").groupBy("node").agg(F.first("full").alias("full")), "sets")

    # every member against its leader
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab"]
    sized = pairs.join(sides[0], "a").join(sides[1], "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    alive = sized.select("a", "b", "sa", "sb").mapInArrow(_prune(fewest), "a binary, b binary")
    sides = [sets.select(F.col("node").alias(x), F.col("full").alias(f"f{x}")) for x in "ab"]
    links = cut(alive.join(sides[0], "a").join(sides[1], "b").select("a", "b", "fa", "fb").mapInArrow(_confirm(percent), "a binary, b binary"), "links")

    # the rest of the buckets that are not one component yet
    found = cut(components(links), "components")
    named = cut(members.join(found, "node", "left").select("band", "key", "size", "leader", "node", F.coalesce("component", "node").alias("c")), "named")
    # a leader is a member, so its component is that of the row where both are the same
    state = named.groupBy("band", "key").agg(F.max(F.when(F.col("node") == F.col("leader"), F.col("c"))).alias("lc"),
                                             F.min("c").alias("low"), F.max("c").alias("high"), F.first("size").alias("size"))
    todo = state.where("size > 2 AND low <> high").select("band", "key", "lc")
    rest = named.join(todo, ["band", "key"]).join(nodes.select("node", "n", "sig"), "node")
    rest = cut(rest.withColumn("u", F.col("c") != F.col("lc")).select("band", "key", "node", "c", "u", "n", "sig"), "rest")
    totals = rest.groupBy("band", "key").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("u"), F.col("n"))).alias("out"))
    rest = rest.join(totals, ["band", "key"]).join(sets, "node")

    def blocks(frame: DataFrame, total: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.ceil(F.col(total) / BLOCK_SHINGLES))
        return frame.groupBy("band", "key", block.alias(f"{name}at")).agg(
            F.collect_list(F.struct("node", "c", "u", "n", "sig", "full")).alias(name), F.first(F.ceil(F.col("all") / BLOCK_SHINGLES)).alias("rights"))

    # a left block is there once for each right block of its bucket, and the two numbers deal the pairs of blocks over tasks
    left = blocks(rest.where("u"), "out", "left_").withColumn("right_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rights") - 1))).drop("rights")
    met = left.join(blocks(rest, "all", "right_").drop("rights"), ["band", "key", "right_at"])
    more = cut(met.select("band", "left_", "right_").mapInArrow(_blocks(fewest, percent), "a binary, b binary"), "more_links")

    # the links between components join those, few as they are, and not all their nodes again
    name = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = cut(components(between), "merged").withColumnRenamed("node", "was").withColumnRenamed("component", "now")
    alone = more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    final = found.union(alone).join(merged, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("root"))
    known = base.select("id", "h", "n", "node").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return cut(known, "known")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``."""
    known = rooted(docs, id_col, text_col, words, percent, False)
    least = known.where("id IS NOT NULL AND root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"))
    out = known.join(least, "root", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each class, with its own columns: that with the smallest id, of those with the smallest text hash. A null
    id comes after all others. Rows without words are in no class. Of rows equal in id and text one stays, whichever it
    is; rows that share an id alone are documents of their own."""
    known = rooted(docs, id_col, text_col, words, percent, True)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "h")
    first = known.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("x")).select("x.id", "x.h")
    stay = first.unionByName(known.where("root IS NULL").select("id", "h").distinct())
    stay = stay.select(F.col("id").alias("_i"), F.col("h").alias("_h"))
    name = free_name(docs.columns, "text_hash")
    one = docs.withColumn(name, F.xxhash64(text_col)).dropDuplicates([id_col, name])
    return one.join(stay, one[id_col].eqNullSafe(stay["_i"]) & (one[name] == stay["_h"]), "left_semi").select(*docs.columns)
