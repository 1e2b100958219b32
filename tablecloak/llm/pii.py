"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans. Labelers vote on each (personal, not personal, or nothing): the pattern itself, check
digits and ranges, gazetteers, words around it, its borders and its shape. The gazetteers are counted from the corpus: endings of
addresses, first digits of card numbers and first parts of host numbers that ``LISTED`` or more of the spans have that satisfy the
base rules. Expectation maximisation estimates, per kind, how reliable each vote is, without any labelled span. What a check digit is
worth is known beforehand and not estimated (``ANCHORS``), and gives the first beliefs; a labeler that nearly always votes like
an earlier one does not count again. The posteriors then train a logistic span classifier for each kind on votes, lengths and digit
shares, both sides with equal weight, so a verdict does not depend on how many spans of a kind the corpus has. Both work on the counts of
vote and feature patterns, whose number is fixed by the labelers and not by the data, so the driver only sees a small table.

Spans that satisfy the base rules are always reported; the classifier adds others (written-out addresses, national phone
numbers) that it holds for personal with probability ``ACCEPT`` or more and that overlap no base span. Positions are code
points, end exclusive.

Defined cases: a null or empty text has no spans; rows that repeat id and text get the same result each; a null id is a row
like any other; an empty table gives an empty one, and with no candidate of a kind nothing is fitted for it; very long texts are
searched whole. Ties cannot occur: spans are ordered by start, kind and end. Only the two named columns are read.

The patterns use possessive groups and start only where a run of characters starts or the last match ended, which
matches the same spans as the plain form, in linear time and constant stack on texts of any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checksums import luhn_valid
from .frames import cut

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
# type: (kind, whether the base rule is meant, what a text must contain, pattern)
TYPES = {
    "email": ("email", True, "@", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", True, "[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("card", True, "[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("phone", True, r"\+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "email_words": ("email", False, "(?i)dot", rf"(?i)(?<!{LOCAL})[a-z0-9._%+-]{{1,64}}+ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{{1,63}}+ ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{{2,10}}+(?![A-Za-z0-9])"),
    "phone_national": ("phone", False, "[0-9]", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
}
# Word lists of the gazetteer and context labelers.
CONTEXT = {"email": "mail email contact write courriel correo", "ip": "ip host server address addr from client adresse",
           "card": "card visa credit mastercard payment pay karte carte tarjeta", "phone": "phone tel call fax mobile cell telefon"}
NOT_CONTEXT = "version license licence isbn release section chapter build no number cc by under"
AROUND = 40     # characters of context
LABELERS = ("pattern", "valid", "gazetteer", "context", "other_context", "borders", "shape")
ACCEPT = 0.5
ROUNDS = 30
LISTED = 0.005  # share of a kind's base spans from which a beginning or ending is in the gazetteer, so it has 200 entries at most
ALIKE = 0.95    # share of spans on which two labelers agree from which the later one is left out
EVEN = 0.5
TRUST = (8, 2)  # votes that a labeler counts as right and wrong with before any is looked at
# Chance that the rule of the kind is met by a personal span, and by another that looks like one. One in ten
# numbers passes a check digit; an address has no rule beyond its pattern.
ANCHORS = {"card": (0.999, 0.1), "ip": (0.9999, 0.5), "phone": (0.99, 0.5)}


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, type, kind, start, end, m, left, right): every match of every pattern, once per (id, text)."""
    text = F.col(text_col)
    found = []
    for name, (_, _, needs, pattern) in TYPES.items():
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(AROUND)).alias("left"), F.left(g, F.lit(AROUND)).alias("right")))
        got = F.struct(F.lit(name).alias("type"), gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"))
        found.append(F.when(text.rlike(needs) & text.rlike(pattern), got))
    some = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())).alias("s"))
    some = some.select("id", "h", "s.*").dropDuplicates(["id", "h", "type"])
    size = F.size("ms")
    each = some.select("id", "h", "type", F.posexplode(F.arrays_zip("ms", F.slice("gaps", F.lit(1), size).alias("before"), F.slice("gaps", F.lit(2), size).alias("after"))).alias("at", "z"))
    until = Window.partitionBy("id", "h", "type").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("z.ms")
    out = each.withColumn("end", F.sum(F.col("z.before.n") + length).over(until))
    kind = F.create_map(*[F.lit(x) for t, v in TYPES.items() for x in (t, v[0])])[F.col("type")]
    return out.select("id", "h", "type", kind.alias("kind"), (F.col("end") - length).cast("int").alias("start"), F.col("end").cast("int"), F.col("z.ms").alias("m"),
                      F.col("z.before.left").alias("left"), F.col("z.after.right").alias("right"))


def _digits() -> Column:
    return F.regexp_replace("m", "[^0-9]", "")


def _valid() -> Column:
    """The rule of the kind on the matched text: octets at most 255, 12 to 19 digits passing Luhn, 9 to 15 digits."""
    n = F.length(_digits())
    octets = F.forall(F.split("m", r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    return F.when(F.col("kind") == "ip", octets).when(F.col("kind") == "card", n.between(12, 19) & F.coalesce(luhn_valid(_digits()), F.lit(False))).when(
        F.col("kind") == "phone", n.between(9, 15)).otherwise(F.lit(True))


def _word_in(words: str, where: Column) -> Column:
    return where.rlike(rf"(?i)(?<![a-z])(?:{'|'.join(words.split())})(?![a-z])")


def _entry() -> Column:
    """What of a span the gazetteer of its kind has: the ending of an address, two digits of a card, the first part of a host number."""
    kind = F.col("kind")
    return F.when(kind == "email", F.lower(F.regexp_extract("m", r"([A-Za-z]+)$", 1))).when(kind == "card", F.left(_digits(), F.lit(2))).when(
        kind == "ip", F.regexp_extract("m", "^([0-9]+)", 1))


def _is_base() -> Column:
    return F.col("type").isin([t for t, v in TYPES.items() if v[1]]) & _valid()


def gazetteers(spans: DataFrame) -> dict[str, list[str]]:
    """kind -> entries that ``LISTED`` or more of its base spans have, at most 1 / LISTED of them."""
    counts = spans.where(_is_base()).groupBy("kind", _entry().alias("entry")).agg(F.count("*").alias("n")).where("entry <> ''")
    totals = counts.groupBy("kind").agg(F.sum("n").alias("all"))
    found = counts.join(totals, "kind").where(F.col("n") >= F.col("all") * LISTED).select("kind", "entry").collect()
    return {k: sorted(r["entry"] for r in found if r["kind"] == k) for k in KINDS}


def labelled(spans: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """With ``base`` and a vote (1, 0, or -1 for none) of each labeler, and the features ``len`` and ``share``."""
    kind, none = F.col("kind"), F.lit(-1)
    is_base = F.col("type").isin([t for t, v in TYPES.items() if v[1]])
    context = F.lit(False)
    for k, words in CONTEXT.items():
        context = context | ((kind == k) & _word_in(words, F.col("left")))
    listed = F.lit(False)
    for k, entries in lists.items():
        if entries:
            listed = listed | ((kind == k) & _entry().isin(entries))
    known = kind.isin([k for k, entries in lists.items() if entries] or [None])
    n, digits = F.length("m"), F.length(_digits())
    shape = F.when(kind == "email", n.between(6, 60)).when(kind == "card", digits.between(15, 16)).when(kind == "ip", n.between(7, 15)).otherwise(digits.between(10, 12))
    borders = F.col("left").rlike(r"[A-Za-z0-9]$") | F.col("right").rlike(r"^[A-Za-z0-9]")
    votes = {
        "pattern": F.when(is_base, 1).otherwise(none),
        "valid": F.when(~kind.isin(list(ANCHORS)), none).when(_valid(), 1).otherwise(0),
        "gazetteer": F.when(F.coalesce(listed, F.lit(False)), 1).when(known & kind.isin("card", "ip"), 0).otherwise(none),
        "context": F.when(context, 1).otherwise(none),
        "other_context": F.when(_word_in(NOT_CONTEXT, F.right(F.col("left"), F.lit(12))), 0).otherwise(none),
        "borders": F.when(borders, 0).otherwise(1),
        "shape": F.when(shape, 1).otherwise(0),
    }
    return spans.withColumn("base", _is_base()).withColumns({f"v_{k}": v.cast("int") for k, v in votes.items()}).withColumns(
        {"len": F.least(F.expr("length(m) div 8"), F.lit(7)).cast("int"), "share": F.expr("cast(4 * length(regexp_replace(m, '[^0-9]', '')) div length(m) as int)")})


PATTERN = ["kind", *[f"v_{x}" for x in LABELERS], "len", "share"]


def independent(rows: list[dict]) -> list[str]:
    """The labelers of one kind, without those that agree with an earlier one nearly whenever both vote."""
    kept: list[str] = []
    for x in LABELERS:
        def agrees(y: str) -> bool:
            both = [p for p in rows if p[f"v_{x}"] >= 0 and p[f"v_{y}"] >= 0]  # noqa: B023
            n = sum(p["n"] for p in both)
            return n > 0 and sum(p["n"] for p in both if p[f"v_{x}"] == p[f"v_{y}"]) >= ALIKE * n  # noqa: B023
        if x == "valid" or not any(agrees(y) for y in kept):
            kept.append(x)
    return kept


def reliabilities(patterns: list[dict], rounds: int = ROUNDS) -> dict[str, dict]:
    """Per kind: the labelers that count and P(vote | truth) of each, by expectation maximisation.

    A labeler is right with one probability whenever it votes, and says nothing where it does not: its accuracy is estimated, with
    ``TRUST`` beforehand, but for the check that is known. The first beliefs are those of that check and the share of votes. How many
    spans of a kind are personal is no evidence about one of them: a span is judged by its votes alone.
    """
    out = {}
    for kind in sorted({p["kind"] for p in patterns}):
        rows = [p for p in patterns if p["kind"] == kind]
        used, anchor = independent(rows), ANCHORS.get(kind)
        silent = {(x, -1, y): 1.0 for x in LABELERS for y in (0, 1)}
        fixed = silent | ({("valid", v, y): chance if v else 1 - chance for y, chance in ((1, anchor[0]), (0, anchor[1])) for v in (0, 1)} if anchor else {})
        learned = [x for x in used if not (anchor and x == "valid")]
        belief = []
        for p in rows:
            cast = [p[f"v_{x}"] for x in learned if p[f"v_{x}"] >= 0]
            belief.append(_posterior(p, (sum(cast) + 0.5) / (len(cast) + 1), fixed, ["valid"] if anchor else []))
        for _ in range(rounds):
            table = dict(fixed)
            for x in learned:
                right = sum(p["n"] * (b if p[f"v_{x}"] else 1 - b) for p, b in zip(rows, belief) if p[f"v_{x}"] >= 0)
                accuracy = (right + TRUST[0]) / (sum(p["n"] for p in rows if p[f"v_{x}"] >= 0) + sum(TRUST))
                table |= {(x, v, y): accuracy if v == y else 1 - accuracy for v in (0, 1) for y in (0, 1)}
            belief = [_posterior(p, EVEN, table, used) for p in rows]
        out[kind] = {"table": table, "used": used}
    return out


def _posterior(p: dict, prior: float, table: dict, used: list[str]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(table[x, p[f"v_{x}"], 1] / table[x, p[f"v_{x}"], 0]) for x in used)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _features(p: dict) -> list[tuple]:
    """Each kind has weights of its own."""
    kind = p["kind"]
    return [("one", kind)] + [(x, kind, p[f"v_{x}"]) for x in LABELERS] + [("len", kind, p["len"]), ("share", kind, p["share"])]


def span_classifier(patterns: list[dict], steps: int = 400) -> dict[tuple, float]:
    """Weights of logistic regressions, one a kind, on the posteriors of the labelers' votes, by gradient descent over patterns. The
    spans held for personal and the others weigh as much as each other in each kind, where both are there."""
    found, rows = reliabilities(patterns), []
    for p in patterns:
        f = found[p["kind"]]
        rows.append((_features(p), _posterior(p, EVEN, f["table"], f["used"]), p["n"], p["kind"]))
    mass = {(k, y): sum(n for _, q, n, kind in rows if kind == k and (q >= 0.5) == y) for k in {r[3] for r in rows} for y in (False, True)}
    pulls = [(fs, q * n / mass[k, q >= 0.5], (1 - q) * n / mass[k, q >= 0.5]) for fs, q, n, k in rows]  # (features, pull to 1, pull to 0)
    weights = {f: 0.0 for fs, _, _ in pulls for f in fs}
    for _ in range(steps):
        slope = {f: 1e-3 * w for f, w in weights.items()}
        for fs, up, down in pulls:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in fs)))))
            d = down * p - up * (1 - p)
            for f in fs:
                slope[f] += d
        for f in weights:
            weights[f] -= 0.5 * slope[f]
    return weights


def _probability(weights: dict[tuple, float]) -> Column:
    total = F.lit(0.0)
    for f, w in sorted(weights.items(), key=str):
        hit = F.col("kind") == f[1]
        if f[0] != "one":
            hit = hit & (F.col(f[0] if f[0] in ("len", "share") else f"v_{f[0]}") == f[2])
        total = total + F.when(hit, F.lit(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, kind, start, end, base, p): base spans, and others that the classifier accepts."""
    spans = cut(candidates(docs, id_col, text_col), "candidates")
    votes = cut(labelled(spans, gazetteers(spans)), "votes")
    # at most 4 kinds, 3 votes a labeler, 8 lengths and 5 shares; in practice some hundred rows
    patterns = [r.asDict() for r in votes.groupBy(*PATTERN).agg(F.count("*").alias("n")).orderBy(*PATTERN).collect()]
    scored = votes.withColumn("p", _probability(span_classifier(patterns)))
    # a span that only the classifier finds overlaps no base span
    order = Window.partitionBy("id", "h").orderBy("start", "end", "type")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end"))
    out = scored.withColumn("free", free).where(F.col("base") | (F.col("free") & (F.col("p") >= ACCEPT)))
    return out.select("id", "h", "kind", "start", "end", "base", "p")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and all spans as text, for every row."""
    spans = find_spans(docs, id_col, text_col)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = spans.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind", "base"))).alias("spans"))
    spans = spans.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "spans")
    keys = docs.select(F.col(id_col), F.xxhash64(text_col).alias("h"))
    both = keys.join(spans, keys[id_col].eqNullSafe(spans["_i"]) & (keys["h"] == spans["_h"]), "left")
    none = F.array().cast(both.schema["spans"].dataType)
    both = both.withColumn("spans", F.coalesce("spans", none)).withColumn("sure", F.filter("spans", lambda s: s["base"]))
    sure = F.transform("sure", lambda s: s["kind"])
    counts = [(F.size(sure) - F.size(F.array_remove(sure, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return both.select(id_col, *counts, F.sha2(_written(F.col("sure")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
