"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least ``SHORTEST`` characters of [A-Za-z0-9_+/=-]; one with '=' inside is parted at the first into
name and value. Below ``PLAIN`` characters it needs more than plain letters of one case (a capital first aside), or stands right
after '=', ':' or a quote: other short words are prose. Its features are its length and character shares,
how its characters follow one another (changes of class, and the mean log probability of its character pairs in this
corpus), how much of it dictionary words cover (words that are a share of ``COMMON`` or more of all words of the corpus, and
stand there twice at least), its path, and the words around it. A forest trained from labelled findings scores every candidate.

The table of character pairs has a fixed size (256 x 256); words are counted one by one, by a 64 bit hash, and at most 1 / COMMON
of them can have that share, so the dictionary is bounded at any size. Only words that stand free count, so that pieces of
tokens do not make themselves a dictionary. Both cover all documents. Labelled findings are a parameter: (id, start, label). Where there are none, ``structural_labels`` labels those
whose syntax leaves little doubt and leaves the others to the forest. No label follows from the context alone, and known formats,
quotes and assignments, which labels are made of, are not shown to the forest: it has to tell findings apart by the rest.

Defined cases: a null or empty text has no candidates; a null path has no path features; repeated rows give repeated findings;
without labels of both classes every finding scores the share of label 1, or 0.5, and none is removed; a null id is an id like any other; an
empty table gives no findings; very long texts are searched whole, in slices of a few megabytes or one row. Ties cannot occur: a
finding is known by its place. Only the named columns are read. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, cut, share
from .words import NOT_SPACE, Words, byte_class, slices, span_hashes

SHORTEST = 8
PLAIN = 16
CANDIDATE = byte_class(lambda b: chr(b) in "_+/=-" or (b < 0x80 and chr(b).isalnum()))
LETTERS = byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
COMMON = 2e-6           # share of all words; at most 500,000 words have it
TRAIN_ROWS = 20_000     # bound of the labelled findings that the forest is grown from
TREES, DEPTH = 30, 6
AROUND = 64             # bytes of text looked at on either side
# Words that speak for and against a secret.
KEYWORDS = re.compile(rb"token|secret|passw|pwd|api|key|auth|bearer|credential|private", re.I)
EXAMPLES = re.compile(rb"example|sample|dummy|test|changeme|placeholder|your", re.I)
REFERENCES = re.compile(rb"commit|revision|checksum|digest|hash|sha-?[0-9]|md5|uuid|blob", re.I)
FORMATS = re.compile(rb"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}"
                     rb"|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}")
PATHS = re.compile(r"test|example|sample|doc|spec|fixture", re.I)
FEATURES = ("length", "digits", "upper", "lower", "signs", "hexadecimal", "distinct", "changes", "pairs", "dictionary", "path_depth", "path_example",
            "keyword_before", "example_near", "assigned", "quoted", "words_before", "words_after", "sign_after", "reference_before", "known_format")

# what labels are made of and the forest does not see: it has to tell findings apart by the others
CUES = ("known_format", "assigned", "quoted")
LEARNT = tuple(f for f in FEATURES if f not in CUES)


def _class_of(data: np.ndarray) -> np.ndarray:
    table = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        table[b] = 1 if b < 128 and c.isdigit() else 2 if b < 128 and c.isupper() else 3 if b < 128 and c.islower() else 4
    return table[data]


def _tables(text_at: int):
    """Counts of byte pairs (kind 0), summed over the task, and of lower-cased free-standing words by hash (kind 1), over a slice."""
    high = byte_class(lambda b: b >= 0x80)

    def out(kind, at, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["kind", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]):
        pairs = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in slices(batch, text_at):
                w = Words(part.column(text_at), CANDIDATE | high, lower=True)
                pairs += np.bincount(w.data[:-1].astype(np.int64) * 256 + w.data[1:], minlength=1 << 16)
                other = np.append(0, np.cumsum(~(LETTERS | high)[w.data]))
                word = other[w.ends] == other[w.starts]
                yield out(1, *np.unique(span_hashes(w.data, w.starts[word], w.ends[word]).view(np.int64), return_counts=True))
        some = np.flatnonzero(pairs)
        yield out(0, some, pairs[some])
    return run


def corpus_tables(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each byte given the one before it, the sorted hashes of the dictionary words)."""
    bounded_batches(docs.sparkSession)
    counts = docs.select(text_col).mapInArrow(_tables(0), "kind int, at bigint, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n"))
    counts = cut(counts, "word_counts")
    total = counts.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    got = counts.where((F.col("kind") == 0) | (F.col("n") >= max(2.0, COMMON * total))).toArrow()
    kind, at, n = (got.column(i).to_numpy() for i in range(3))
    pairs = np.zeros(1 << 16)
    pairs[at[kind == 0]] = n[kind == 0]
    pairs = pairs.reshape(256, 256) + 0.1
    return np.log(pairs / pairs.sum(axis=1, keepdims=True)).astype(np.float32), np.sort(at[kind == 1])


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the hashes are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    h = hashes.view(np.int64)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _candidates(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the candidates among the runs ``w``, in order."""
    raw, starts, ends, rows = w.data, w.starts, w.ends, w.row
    signs = np.flatnonzero(raw == 0x3D)
    if len(signs):
        run, first = np.unique(np.searchsorted(starts, signs, "right") - 1, return_index=True)
        at = signs[first]
        # the value begins after the signs that follow one another; signs at the end are padding
        value = np.flatnonzero(raw != 0x3D)
        value = np.append(value, len(raw))[np.searchsorted(value, at)]
        inside = value < ends[run]
        run, at, value = run[inside], at[inside], value[inside]
        cut_ends = ends.copy()
        cut_ends[run] = at
        starts, ends, rows = np.append(starts, value), np.append(cut_ends, ends[run]), np.append(rows, rows[run])
        order = np.argsort(starts, kind="stable")
        starts, ends, rows = starts[order], ends[order], rows[order]
    size = ends - starts
    total = lambda x: np.append(0, np.cumsum(x))
    upper = (raw >= 0x41) & (raw <= 0x5A)
    n_other, n_upper = (c[ends] - c[starts] for c in (total(~LETTERS[raw]), total(upper)))
    plain = (n_other == 0) & ((n_upper == 0) | (n_upper == size) | ((n_upper == 1) & upper[np.minimum(starts, max(len(raw) - 1, 0))]))
    named = np.zeros(256, bool)
    named[list(b"=:\"'`")] = True
    low = w.offsets[rows]
    back = lambda k: np.where(starts - k >= low, raw[np.maximum(starts - k, 0)], 0) if len(raw) else np.zeros(0, np.uint8)
    after = named[back(1)] | ((back(1) == 0x20) & named[back(2)])
    keep = (size >= PLAIN) | ((size >= SHORTEST) & (~plain | after))
    return starts[keep], ends[keep], rows[keep]


def _findings(tables, id_at: int, text_at: int, path_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]):
        log_pair, common = tables()
        for batch in batches:
            for part in slices(batch, text_at):
                w = Words(part.column(text_at), CANDIDATE)
                starts, ends, rows = _candidates(w)
                raw = w.data
                point = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                lower = Words(part.column(text_at), LETTERS, lower=True)
                covered = _among(span_hashes(lower.data, lower.starts, lower.ends), common) & (lower.ends - lower.starts > 2)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, lower.starts[covered], 1)
                np.add.at(edge, lower.ends[covered], -1)
                in_word = np.append(0, np.cumsum(np.cumsum(edge[:-1])))
                spans, features = [], []
                for s, e, r in zip(starts.tolist(), ends.tolist(), rows.tolist()):
                    body, size = raw[s:e], e - s
                    kind = _class_of(body)
                    low, high = int(w.offsets[r]), int(w.offsets[r + 1])
                    before, after = raw[max(low, s - AROUND):s].tobytes(), raw[e:min(high, e + AROUND)].tobytes()
                    path = part.column(path_at)[r].as_py() if path_at is not None else None
                    text = body.tobytes()
                    share_of = [float((kind == k).mean()) for k in (1, 2, 3, 4)]
                    features.append([
                        size, *share_of, float(re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", text) is not None), len(set(text)) / size, float((kind[1:] != kind[:-1]).mean()),
                        float(log_pair[body[:-1], body[1:]].mean()), (in_word[e] - in_word[s]) / size, float((path or "").count("/")), float(bool(PATHS.search(path or ""))),
                        float(bool(KEYWORDS.search(b" ".join(before.split()[-4:])))), float(bool(EXAMPLES.search(before + b" " + text + b" " + after))),
                        float(bool(re.search(rb"[=:]\s*[\"'`]?$", before))), float(before[-1:] in (b'"', b"'", b"`") and after[:1] == before[-1:]),
                        float(len(before.split())), float(len(after.split())), float(after[:1] not in (b"", b" ", b"\n")),
                        float(bool(REFERENCES.search(b" ".join(before.split()[-2:])))), float(FORMATS.fullmatch(text) is not None)])
                    spans.append((int(point[s] - point[low]), int(point[e] - point[low]), hashlib.sha256(text).hexdigest()))
                table = np.array(features, np.float64).reshape(len(spans), len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_at).take(pa.array(rows)), pa.array([x[0] for x in spans], pa.int32()), pa.array([x[1] for x in spans], pa.int32()),
                     pa.array([x[2] for x in spans], pa.string())] + [pa.array(c) for c in table.T], names=["id", "start", "end", "fingerprint", *FEATURES])
    return run


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, start, end, fingerprint, features): every candidate of every whole text; the fingerprint is its SHA-256."""
    tables = share(docs.sparkSession, corpus_tables(docs, text_col))
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text")] + ([F.col(path_col).cast("string").alias("path")] if path_col else [])
    kind = dict(docs.dtypes)[id_col]
    return docs.select(*columns).mapInArrow(_findings(tables, 0, 1, 2 if path_col else None),
                                            f"id {kind}, start int, end int, fingerprint string, " + ", ".join(f"{f} double" for f in FEATURES))


def structural_labels(found: DataFrame) -> DataFrame:
    """(id, start, label) of findings whose syntax leaves little doubt. A secret has a known format, or looks drawn at random and
    has two of three: a keyword before it, an assignment, quotes. None is what words cover or plain letters make up, whatever is
    around it but a keyword, and what looks drawn at random after a word like commit or checksum. So quoted and assigned values
    have both labels, and so have findings without any context."""
    context = F.col("assigned") + F.col("quoted") + F.col("keyword_before")
    mixed = (F.col("upper") > 0.1) & (F.col("lower") > 0.1) & (F.col("changes") > 0.25)
    drawn = ((F.col("digits") > 0.1) | mixed) & (F.col("dictionary") <= 0.5)
    plain = (F.col("dictionary") > 0.5) | ((F.col("digits") == 0) & ~mixed)
    known = (F.col("known_format") == 1) & (F.col("example_near") == 0)
    yes = known | (drawn & (context >= 2) & (F.col("example_near") == 0) & (F.col("reference_before") == 0))
    no = ~known & (F.col("keyword_before") == 0) & (plain | (drawn & (F.col("reference_before") == 1)))
    return found.where(yes | no).select("id", "start", yes.cast("double").alias("label")).distinct()


def score(found: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 5) -> DataFrame:
    """``found`` with ``score``: the forest's probability, and ``judged``: whether there was a forest, that is labels of both classes. Grown from about ``train_rows`` labelled findings at most, drawn by hash."""
    known = found.join(labels.where("label IS NOT NULL").dropDuplicates(["id", "start"]), ["id", "start"])
    total = known.count()
    space = 1 << 40
    few = known.where(F.pmod(F.xxhash64("id", "start", F.lit(seed)), F.lit(space)) < int(space * min(1.0, train_rows / max(total, 1))))
    # of a size that the parameter fixes, in one order, so that every run grows the same trees
    # a shuffle parts the join and its filter, which run in parallel, from the one task that sorts what is left
    few = cut(few.select("label", "id", "start", *LEARNT).repartition(1).sortWithinPartitions("id", "start", "label"), "labelled_findings")
    mean, low, high = few.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if low is None or low == high:
        return found.withColumn("score", F.lit(0.5 if mean is None else float(mean))).withColumn("judged", F.lit(False))
    pack = VectorAssembler(inputCols=list(LEARNT), outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, probabilityCol="_p",
                                    rawPredictionCol="_raw", predictionCol="_class").fit(pack.transform(few))
    out = forest.transform(pack.transform(found))
    return out.withColumn("score", F.round(vector_to_array("_p")[1], 9)).withColumn("judged", F.lit(True)).drop("_features", "_raw", "_p", "_class")


def scan(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None,
         threshold: float = 0.5) -> DataFrame:
    """(id, start, end, fingerprint, score, secret): all findings; ``secret`` says which are left when false positives go."""
    found = cut(findings(docs, id_col, text_col, path_col), "findings")
    out = score(found, structural_labels(found) if labels is None else labels)
    return out.select(F.col("id").alias(id_col), "start", "end", "fingerprint", "score", (~F.col("judged") | (F.col("score") >= threshold)).alias("secret"))
