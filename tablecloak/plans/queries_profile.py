"""Scans, fits and fidelity."""

from __future__ import annotations

from dataclasses import replace

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.detectors import DETECTORS, SPANS
from ..keys import seed_key, sql_hmac, sql_row_message, subkey
from ..operators import fidelity as FID
from ..operators import fit as FIT
from ..operators import scan as SCAN
from . import oracle_text as O
from .queries_mask import _CARD_OK, SECRET, patients, PRESET_DF_SQL
from .registry import SEED, Tables, query

# people: columns that hold personal data of known kinds, made of the customer table
PEOPLE = f"""(SELECT c_custkey, zip, dob, substr(ssn, 1, 3) || '-' || substr(ssn, 4, 2) || '-' || substr(ssn, 6, 4) AS ssn,
 CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE 'user' || c_custkey::VARCHAR || '@example.com' END AS contact,
 CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'NA' ELSE (c_custkey % 4)::VARCHAR END AS grp FROM ({PRESET_DF_SQL}))"""


def people(t: Tables):
    k = F.col("c_custkey")
    s = lambda a, n: F.substring("ssn", a, n)
    return patients(t).select(
        "c_custkey", "zip", "dob", F.concat(s(1, 3), F.lit("-"), s(4, 2), F.lit("-"), s(6, 4)).alias("ssn"),
        F.when(k % 3 == 0, "n/a").otherwise(F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com"))).alias("contact"),
        F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, "NA").otherwise((k % 4).cast("string")).alias("grp"))


PCOLS = ["c_custkey", "zip", "dob", "ssn", "contact", "grp"]


def _each(template: str, cols, frm: str) -> str:
    """UNION ALL of a template over columns; {c} is the column, {s} its text."""
    return " UNION ALL ".join(template.format(c=c, s=f"{c}::VARCHAR", frm=frm) for c in cols)


@query("scan_column_stats", _each("""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct",
 (count(*) - count({c}))::DOUBLE / count(*) AS null_rate, count(DISTINCT {c})::DOUBLE / count({c}) AS unique_rate, min(length({s})) AS min_length, max(length({s})) AS max_length,
 round(avg(length({s})), 6) AS mean_length FROM {frm}""", PCOLS, PEOPLE))
def _(t):
    return SCAN.column_stats(people(t), exact=True).drop("min", "max", "mean").withColumn("mean_length", F.round("mean_length", 6))


@query("scan_number_stats", _each("""SELECT '{c}' AS "column", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, count(DISTINCT {c}) AS "distinct" FROM {frm}""",
                                  ["l_partkey", "l_suppkey", "l_quantity", "l_discount"], "lineitem"))
def _(t):
    return SCAN.column_stats(t.lineitem, ["l_partkey", "l_suppkey", "l_quantity", "l_discount"], exact=True).select(
        "column", "min", "max", F.round("mean", 4).alias("mean"), "distinct")


@query("scan_top_values", "WITH " + ", ".join(f"""{c}_t AS (SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS rank
 FROM events WHERE {c} IS NOT NULL GROUP BY {c})""" for c in ("user_id", "event_type")) + " SELECT * FROM user_id_t WHERE rank <= 5 UNION ALL SELECT * FROM event_type_t WHERE rank <= 5")
def _(t):
    return SCAN.top_values(t.events, ["user_id", "event_type"], 5)


def _type_case(s: str, pre: str = "") -> str:
    filled = f"count(*) FILTER ({s} <> '')"
    whens = " ".join(f"WHEN count(*) FILTER (regexp_full_match({s}, {O.q(p[1:-1])})) = {filled} THEN '{n}'" for n, p in SCAN.TYPE_SHAPES)
    return f"CASE WHEN {filled} = 0 THEN 'empty' {whens} ELSE 'string' END"


@query("scan_type_inference", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {_type_case(f"{c}::VARCHAR")} AS inferred_type FROM {frm}""" for c, frm in
       [*((c, PEOPLE) for c in PCOLS)]))
def _(t):
    return SCAN.infer_types(people(t))


def _hit(d, s: str) -> str:
    base = f"regexp_full_match({s}, {O.q(d.cell[1:-1])})"
    if d.check == "luhn":
        digits = f"regexp_replace({s}, '[^0-9]', '', 'g')"
        body = f"substr({digits}, 1, length({digits}) - 1)"
        return f"({base} AND length({digits}) BETWEEN 12 AND 19 AND {O.luhn_digit(body)} = right({digits}, 1))"
    if d.check == "npi":
        pre = f"('80840' || substr({s}, 1, 9))"
        return f"({base} AND {O.luhn_digit(pre)} = right({s}, 1))"
    if d.check == "iban":
        return f"({base} AND {O.mod97(f'(substr({s}, 5) || substr({s}, 1, 4))')} = 1)"
    return base


def _detect_sql(cols, frm: str) -> str:
    parts = []
    for c in cols:
        for d in DETECTORS:
            parts.append(f"""SELECT '{c}' AS "column", '{d.id}' AS detector, count(*) FILTER (CASE WHEN {_plain_match(d, f'{c}::VARCHAR')} THEN {_hit(d, f'{c}::VARCHAR')} ELSE false END) AS hits, count({c}) AS filled FROM {frm}""")
    return f"""SELECT "column", detector, hits, filled, hits::DOUBLE / filled AS match_rate, CASE WHEN hits::DOUBLE / filled >= 0.8 THEN 'high' WHEN hits::DOUBLE / filled >= 0.5 THEN 'medium' ELSE 'low' END AS confidence
 FROM ({' UNION ALL '.join(parts)}) WHERE hits > 0"""


def _plain_match(d, s: str) -> str:
    return f"regexp_full_match({s}, {O.q(d.cell[1:-1])})"


DETECTED = _detect_sql(PCOLS, "people")
WITH_PEOPLE = f"WITH people AS MATERIALIZED {PEOPLE}"


@query("scan_detect_pii", f"{WITH_PEOPLE} {DETECTED}")
def _(t):
    return SCAN.detect(people(t))


_WEIGHT = "CASE detector " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SCAN.WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
_SCORES = f"""scores AS (SELECT n."column", b.detector, coalesce(b.score, 0.0::DOUBLE) AS pii_score FROM (SELECT unnest({O.words(PCOLS)}) AS "column") n LEFT JOIN
 (SELECT "column", detector, match_rate * {_WEIGHT} AS score, row_number() OVER (PARTITION BY "column" ORDER BY match_rate * {_WEIGHT} DESC, detector DESC) AS r FROM ({DETECTED})) b ON b."column" = n."column" AND b.r = 1)"""
_BUCKET = "CASE WHEN pii_score >= 0.6 THEN 'high' WHEN pii_score >= 0.3 THEN 'med' WHEN pii_score > 0 THEN 'low' ELSE 'none' END"


@query("scan_pii_score", f"""{WITH_PEOPLE}, {_SCORES} SELECT "column", detector, pii_score, {_BUCKET} AS pii_bucket FROM scores""")
def _(t):
    return SCAN.pii_scores(SCAN.detect(people(t)), PCOLS)


@query("scan_sentinels", f"SELECT * FROM ({_each(chr(39).join(['SELECT ', '{c}', ' AS \"column\", {s} AS sentinel, count(*) AS n FROM {frm} WHERE {s} IN (' ]) + ', '.join(O.q(x) for x in SCAN.SENTINELS) + ') GROUP BY {s}', PCOLS, PEOPLE)})")
def _(t):
    return SCAN.sentinels(people(t))


@query("scan_key_candidates", f"""SELECT * FROM ({_each('SELECT CASE WHEN count(*) = count(DISTINCT {c}) THEN ' + "'{c}'" + ' END AS "column" FROM {frm}', PCOLS, PEOPLE)}) WHERE "column" IS NOT NULL""")
def _(t):
    return SCAN.key_candidates(people(t))


def _class_sql(cols) -> str:
    return f"SELECT count(*) AS size FROM orders GROUP BY {', '.join(cols)}"


QI = ["o_orderpriority", "o_orderstatus", "yr"]


def orders_qi(t: Tables):
    return t.orders.select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("yr"))


_QI_SQL = " UNION ALL ".join(f"""SELECT '{','.join(s)}' AS "columns", min(size) AS k, count(*) AS classes, sum(size)::BIGINT AS rows, (sum(CASE WHEN size = 1 THEN 1 ELSE 0 END))::DOUBLE / sum(size) AS singleton_share
 FROM (SELECT count(*) AS size FROM (SELECT *, year(o_orderdate) AS yr FROM orders) GROUP BY {', '.join(s)})""" for s in (
    ("o_orderpriority", "o_orderstatus"), ("o_orderpriority", "yr"), ("o_orderstatus", "yr"), ("o_orderpriority", "o_orderstatus", "yr")))


_MIN_COLUMNS = ["l_discount", "l_linenumber", "l_quantity", "l_shipdate", "l_suppkey", "l_tax"]
_MIN_SHARE = 0.6


def _minimal_sql() -> str:
    """Every set of the columns, and those that no smaller one with the share is inside of."""
    sets = [s for size in range(1, len(_MIN_COLUMNS) + 1) for s in combinations(_MIN_COLUMNS, size)]
    each = " UNION ALL ".join(f"""SELECT {sum(1 << _MIN_COLUMNS.index(c) for c in s)} AS m, '{'|'.join(s)}' AS "columns", sum(CASE WHEN size = 1 THEN 1 ELSE 0 END)::DOUBLE / sum(size) AS share
 FROM (SELECT count(*) AS size FROM lineitem GROUP BY {', '.join(s)})""" for s in sets)
    return f"""WITH a AS ({each}), b AS (SELECT * FROM a WHERE share >= {_MIN_SHARE})
 SELECT "columns", len(string_split("columns", '|')) AS size FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.m <> b.m AND o.m & b.m = o.m)"""


@query("scan_minimal_sets", _minimal_sql())
def _(t):
    found = SCAN.minimal_identifying_sets(t.lineitem, _MIN_COLUMNS, _MIN_SHARE)
    return t.spark.createDataFrame([("|".join(s), len(s)) for s in found], "columns string, size long")


@query("scan_quasi_identifiers", _QI_SQL)
def _(t):
    return SCAN.quasi_identifiers(orders_qi(t), QI)


_CLS = "(SELECT count(*) AS size FROM part GROUP BY p_brand, p_type, p_size)"


@query("scan_k_anonymity", f"SELECT min(size) AS k, count(*) AS classes, sum(size)::BIGINT AS rows, count(*) FILTER (size = 1) AS singletons FROM {_CLS}")
def _(t):
    return SCAN.k_anonymity(t.part, ["p_brand", "p_type", "p_size"])


@query("scan_reid_risk", f"SELECT 100.0::DOUBLE * count(*) / sum(size) AS reid_risk, min(size) AS k FROM {_CLS}")
def _(t):
    return SCAN.reid_risk(t.part, ["p_brand", "p_type", "p_size"])


@query("scan_sample_head", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10000")
def _(t):
    return SCAN.sample_head(t.orders, ["o_orderkey"]).select("o_orderkey", "o_custkey")


_SH = sql_hmac(subkey(seed_key(SEED), "scan-sample"), sql_row_message("o_orderkey"))


@query("scan_sample_random", f"SELECT o_orderkey, o_custkey FROM (SELECT *, {_SH} AS h FROM orders) ORDER BY h, o_orderkey LIMIT 10000")
def _(t):
    return SCAN.sample_random(t.orders, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("scan_full", f"""{WITH_PEOPLE}, {_SCORES} SELECT 'people' AS "table", "column", detector, {_BUCKET} AS pii_bucket, (SELECT count(*) FROM people) AS rows FROM scores""")
def _(t):
    return SCAN.scan(people(t), "people", exact=True).select("table", "column", "detector", "pii_bucket", "rows")


_PLAIN = [d for d in SPANS if not d.check]


@query("scan_freetext_detect", " UNION ALL ".join(f"SELECT '{d.id}' AS detector, count(*) FILTER (n > 0) AS rows, sum(n)::BIGINT AS hits FROM (SELECT len(regexp_extract_all(text, {O.q(d.span)})) AS n FROM documents) HAVING sum(n) > 0" for d in _PLAIN)
       + f" UNION ALL SELECT 'pan', count(*) FILTER (n > 0), sum(n)::BIGINT FROM (SELECT len(list_filter(regexp_extract_all(text, {O.q(next(d for d in SPANS if d.id == 'pan').span)}), lambda s: {_CARD_OK})) AS n FROM documents) HAVING sum(n) > 0"
       + f" UNION ALL SELECT 'iban', count(*) FILTER (n > 0), sum(n)::BIGINT FROM (SELECT len(list_filter(regexp_extract_all(text, {O.q(next(d for d in SPANS if d.id == 'iban').span)}), lambda s: {O.mod97('(substr(s, 5) || substr(s, 1, 4))')} = 1)) AS n FROM documents) HAVING sum(n) > 0")
def _(t):
    return SCAN.freetext_entities(t.documents, "text")


@query("scan_freetext_spans", " UNION ALL ".join(f"SELECT doc_id, '{d.id}' AS detector, unnest(regexp_extract_all(text, {O.q(d.span)})) AS span FROM documents" for d in _PLAIN)
       + f" UNION ALL SELECT doc_id, 'pan', unnest(list_filter(regexp_extract_all(text, {O.q(next(d for d in SPANS if d.id == 'pan').span)}), lambda s: {_CARD_OK})) FROM documents"
       + f" UNION ALL SELECT doc_id, 'iban', unnest(list_filter(regexp_extract_all(text, {O.q(next(d for d in SPANS if d.id == 'iban').span)}), lambda s: {O.mod97('(substr(s, 5) || substr(s, 1, 4))')} = 1)) FROM documents")
def _(t):
    return SCAN.entity_spans(t.documents, "doc_id", "text")


@query("scan_fields", f"""{WITH_PEOPLE}, {_SCORES} SELECT "column", pii_score FROM scores WHERE {_BUCKET} = 'high' AND "column" NOT IN ('zip', 'dob')""")
def _(t):
    return SCAN.scan_fields(SCAN.scan(people(t), "people"), "high", [["zip", "dob"]], in_group=False).select("column", "pii_score")


# the new table lost a column, gained one, and a contact column became clean
_NEWCOLS = ["c_custkey", "zip", "dob", "ssn", "contact", "mail"]


def people2(t: Tables):
    p = people(t)
    return p.select("c_custkey", "zip", "dob", F.lit("x").alias("ssn"), "contact", F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("mail"))


@query("scan_diff", f"""{WITH_PEOPLE}, {_SCORES} SELECT 'ssn' AS "column", 'pii_decreased' AS change, {_BUCKET} AS old_bucket, 'none' AS new_bucket FROM scores WHERE "column" = 'ssn'
 UNION ALL SELECT 'grp', 'removed', {_BUCKET}, NULL FROM scores WHERE "column" = 'grp' UNION ALL SELECT 'mail', 'added', NULL, 'high'""")
def _(t):
    return SCAN.scan_diff(SCAN.scan(people(t), "people"), SCAN.scan(people2(t), "people"))


_WRITTEN = {"c_custkey": ("NULL", "'digits'", "NULL"), "c_name": ("'title'", "'mixed'", "NULL"), "c_mktsegment": ("'upper'", "'letters'", "NULL"),
            "day": ("'lower'", "'mixed'", "'%Y-%m-%d'")}


# every tenth day is no date, and every seventh is blank
_DAYED = """(SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 10 = 0 THEN 'soon'
 ELSE (DATE '2020-01-01' + (c_custkey % 900)::INT)::VARCHAR END AS day FROM customer)"""


@query("scan_profile_fields", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {casing} AS casing_pattern, {alphabet} AS alphabet, {fmt} AS date_format,
 {"min(try_cast(v AS DATE))" if c == "day" else "min(NULL::DATE)"} AS date_min, {"max(try_cast(v AS DATE))" if c == "day" else "min(NULL::DATE)"} AS date_max,
 {"(count(*) FILTER (v = 'soon'))" if c == "day" else "NULL"} AS invalid_count, (SELECT max(n)::DOUBLE / sum(n) FROM (SELECT count(*) AS n FROM {_DAYED} WHERE {c}::VARCHAR <> '' GROUP BY {c})) AS mode_freq
 FROM (SELECT {c}::VARCHAR AS v FROM {_DAYED} WHERE {c}::VARCHAR <> '')""" for c, (casing, alphabet, fmt) in _WRITTEN.items()))
def _(t):
    k = F.col("c_custkey")
    day = F.when(k % 7 == 0, "").when(k % 10 == 0, "soon").otherwise(F.date_add(F.to_date(F.lit("2020-01-01")), (k % 900).cast("int")).cast("string"))
    return SCAN.profile_fields(t.customer.select("c_custkey", "c_name", "c_mktsegment", day.alias("day")))


# two tables with an identifying pair and triple; the second is coarser
_QA = "(SELECT c_custkey, c_nationkey % 5 AS a, c_mktsegment AS b, floor(c_acctbal / 500)::BIGINT AS d FROM customer)"
_QB = "(SELECT c_custkey, c_nationkey % 5 AS a, c_mktsegment AS b, floor(c_acctbal / 5000)::BIGINT AS d FROM customer)"


def _singled(frm: str, *sets: str) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS columns, sum(n) FILTER (n = 1)::DOUBLE / sum(n) AS share FROM (SELECT count(*) AS n FROM {frm} GROUP BY {s})" for s in sets)


_SETS = ("a", "b", "d", "a,b", "a,d", "b,d", "a,b,d")


@query("scan_identifying_sets", f"""WITH s AS ({_singled(_QA, *_SETS)}), h AS (SELECT columns, string_split(columns, ',') AS c FROM s WHERE share >= 0.05)
 SELECT columns FROM h WHERE NOT EXISTS (SELECT 1 FROM h x WHERE len(x.c) < len(h.c) AND list_has_all(h.c, x.c))""")
def _(t):
    df = t.customer.select("c_custkey", (F.col("c_nationkey") % 5).alias("a"), F.col("c_mktsegment").alias("b"), F.floor(F.col("c_acctbal") / 500).alias("d"))
    found = SCAN.identifying_sets(df, ["a", "b", "d"])
    return t.spark.createDataFrame([(",".join(s),) for s in found], "columns string")


@query("scan_set_risk", f"""SELECT 'c_custkey' AS keys, min(n) AS k, 100.0 * count(*) / sum(n) AS reid_risk FROM (SELECT count(*) AS n FROM {_QB} GROUP BY a, b, d)""")
def _(t):
    df = t.customer.select("c_custkey", (F.col("c_nationkey") % 5).alias("a"), F.col("c_mktsegment").alias("b"), F.floor(F.col("c_acctbal") / 5000).alias("d"))
    s = SCAN.scan_set(df, "customer", candidates=["a", "b", "d"], min_singletons=0.0)
    everything = SCAN.reid_risk(df, sorted({c for g in s.groups for c in g})).first()
    assert everything["reid_risk"] == s.reid_risk
    return t.spark.createDataFrame([(",".join(s.keys), s.k_anonymity, s.reid_risk)], "keys string, k bigint, reid_risk double")


@query("scan_set_diff", f"""{WITH_PEOPLE}, {_SCORES} SELECT 'pii_decreased' AS change, 'ssn' AS name, {_BUCKET} AS old, 'none' AS new FROM scores WHERE "column" = 'ssn'
 UNION ALL SELECT 'removed', 'grp', {_BUCKET}, NULL FROM scores WHERE "column" = 'grp' UNION ALL SELECT 'added', 'mail', NULL, 'high' UNION ALL SELECT 'new_high_pii', 'mail', NULL, 'high'
 UNION ALL SELECT 'key_added', 'mail', NULL, NULL UNION ALL SELECT 'qi_group_removed', 'grp', NULL, NULL UNION ALL SELECT 'qi_group_added', 'contact', NULL, NULL
 UNION ALL SELECT 'key_removed', 'ssn', NULL, NULL FROM (SELECT 1) WHERE (SELECT count(*) = count(DISTINCT ssn) AND count(*) = count(ssn) FROM people)""")
def _(t):
    # which sets count as groups is given, so that the rows say what a diff of two whole scans lists
    old, new = (SCAN.scan_set(p, candidates=["zip"], min_singletons=2.0) for p in (people(t), people2(t)))
    return SCAN.scan_set_diff(replace(old, groups=(("grp",),)), replace(new, groups=(("contact",),)))


@query("drift_gate", "SELECT count(*) AS n, true AS drifted, false AS same FROM customer")
def _(t):
    from ..errors import DriftRefused
    old, new = SCAN.scan(people(t)), SCAN.scan(people2(t))
    try:
        SCAN.drift_gate(old, new)
        drifted = False
    except DriftRefused:
        drifted = True
    same = bool(SCAN.drift_gate(old, old, on_drift="warn"))
    return t.customer.agg(F.count("*").alias("n")).withColumns({"drifted": F.lit(drifted), "same": F.lit(same)})


_RULES = " UNION ALL ".join(f"SELECT '{d.id}' AS detector, '{d.strategy}' AS strategy, {O.q(d.provider) if d.provider else 'NULL'} AS provider" for d in DETECTORS)


@query("suggest_strategies", f"""{WITH_PEOPLE}, rules AS ({_RULES}), f AS (SELECT * FROM ({DETECTED}) WHERE match_rate >= 0.5),
 r AS (SELECT *, row_number() OVER w AS r, lead(match_rate) OVER w AS nxt FROM f WINDOW w AS (PARTITION BY "column" ORDER BY match_rate DESC, detector))
 SELECT n."column", r.detector, CASE WHEN rules.strategy IS NOT NULL THEN rules.strategy WHEN n."column" = 'c_custkey' THEN 'hash' ELSE 'redact' END AS strategy, rules.provider,
 coalesce(match_rate - nxt < 0.1, false) AS ambiguous FROM (SELECT unnest({O.words(PCOLS)}) AS "column") n LEFT JOIN r ON r."column" = n."column" AND r.r = 1 LEFT JOIN rules USING (detector)""")
def _(t):
    return SCAN.suggest(people(t), exact=True)


# ---- fit

NUMS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("fit_numeric", _each("""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 round(quantile_cont({c}, 0.05), 6) AS p5, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(quantile_cont({c}, 0.95), 6) AS p95 FROM {frm}""", NUMS, "lineitem"))
def _(t):
    s = FIT.numeric_stats(t.lineitem, NUMS)
    return s.select("column", "rows", "nulls", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                    *[F.round(p, 6).alias(p) for p in ("p5", "p25", "p50", "p75", "p95")])


@query("fit_histogram", _each("""SELECT '{c}' AS "column", b AS bucket, round(lo0 + b * ((hi0 - lo0) / 10.0), 6) AS lo, round(lo0 + (b + 1) * ((hi0 - lo0) / 10.0), 6) AS hi, count(*) AS n FROM
 (SELECT lo0, hi0, least(floor(({c} - lo0) / ((hi0 - lo0) / 10.0)), 9)::INT AS b FROM {frm}, (SELECT min({c})::DOUBLE AS lo0, max({c})::DOUBLE AS hi0 FROM {frm})) GROUP BY lo0, hi0, b""", NUMS, "lineitem"))
def _(t):
    h = FIT.numeric_histogram(t.lineitem, NUMS)
    return h.select("column", "bucket", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("fit_categorical", """WITH a AS (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY p_brand)
 SELECT "column", value, n, false AS is_other FROM a WHERE r <= 20 UNION ALL SELECT "column", NULL, coalesce(sum(n) FILTER (r > 20), 0)::BIGINT, true FROM a GROUP BY 1""")
def _(t):
    return FIT.top_values(t.part, ["p_brand"], 20)


@query("fit_datetime", """SELECT 'l_shipdate' AS "column", year(l_shipdate) AS year, count(*) AS n, (SELECT min(l_shipdate) FROM lineitem) AS earliest, (SELECT max(l_shipdate) FROM lineitem) AS latest FROM lineitem GROUP BY 2""")
def _(t):
    return FIT.datetime_stats(t.lineitem, ["l_shipdate"]).withColumns({"earliest": F.col("earliest").cast("timestamp_ntz"), "latest": F.col("latest").cast("timestamp_ntz")})


@query("fit_freetext", """SELECT 'text' AS "column", b AS bucket, round(lo0 + b * ((hi0 - lo0) / 10.0), 6) AS lo, round(lo0 + (b + 1) * ((hi0 - lo0) / 10.0), 6) AS hi, count(*) AS n FROM
 (SELECT lo0, hi0, least(floor((length(text) - lo0) / ((hi0 - lo0) / 10.0)), 9)::INT AS b FROM documents, (SELECT min(length(text))::DOUBLE AS lo0, max(length(text))::DOUBLE AS hi0 FROM documents)) GROUP BY lo0, hi0, b""")
def _(t):
    h = FIT.freetext_stats(t.documents, ["text"])
    return h.select("column", "bucket", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("fit_joint", "SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 25")
def _(t):
    return FIT.joint_counts(t.part, "p_brand", "p_type")


@query("fit_joint_all", "SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2")
def _(t):
    return FIT.fit(t.part.select("p_brand", "p_type"), joints=[("p_brand", "p_type")], joint_cells=None, include_values=True).joint_frames[("p_brand", "p_type")]


@query("fit_fanout", """SELECT children, count(*) AS parents FROM (SELECT c_custkey, count(o_orderkey) AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1""")
def _(t):
    return FIT.fanout(t.orders, ["o_custkey"], t.customer, ["c_custkey"])


@query("fit_cell_format", """SELECT 'o_totalprice' AS "column", max(length(rtrim(split_part(printf('%.9f', o_totalprice), '.', 2), '0'))) AS decimals, NULL AS resolution, 0 AS blanks FROM orders
 UNION ALL SELECT 'o_orderdate', NULL, 'date', 0 UNION ALL SELECT 'o_custkey', 0, NULL, 0 UNION ALL SELECT 'o_orderstatus', NULL, NULL, count(*) FILTER (o_orderstatus = '') FROM orders""")
def _(t):
    return FIT.cell_formats(t.orders, ["o_totalprice", "o_orderdate", "o_custkey", "o_orderstatus"])


@query("fit_redaction", """SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY 2 HAVING count(*) >= 10 QUALIFY row_number() OVER (ORDER BY count(*) DESC, p_brand) <= 20
 UNION ALL SELECT 'p_type', NULL, count(*) FROM part""")
def _(t):
    snap = FIT.fit(t.part.select("p_brand", "p_type", "p_retailprice"), flagged=["p_type"], top=20)
    rows = [("p_brand", v, n) for v, n in snap.columns["p_brand"]["stats"]["top_values"]]
    rows.append(("p_type", None, snap.columns["p_type"]["stats"]["other_count"]))
    return t.spark.createDataFrame(rows, "column string, value string, n long")


_FH = sql_hmac(subkey(seed_key(SEED), "fit-sample"), sql_row_message("o_orderkey"))


@query("fit_sample", f"SELECT o_orderkey, o_totalprice FROM (SELECT *, {_FH} AS h FROM orders) ORDER BY h, o_orderkey LIMIT 2000")
def _(t):
    return FIT.sample_for_fit(t.orders, ["o_orderkey"], 2000, SEED).select("o_orderkey", "o_totalprice")


@query("fit_dp_marginals")
def _(t):
    snap = FIT.fit_dp(t.orders.select("o_totalprice", "o_orderstatus"), [FIT.DPColumn("o_totalprice", "number", 0, 600_000), FIT.DPColumn("o_orderstatus", "text")], 1.0, 1e-6)
    rows = [("o_totalprice", f"{lo:.0f}-{hi:.0f}", n) for lo, hi, n in snap.columns["o_totalprice"]["stats"]["histogram"]]
    rows += [("o_orderstatus", v, n) for v, n in snap.columns["o_orderstatus"]["stats"]["top_values"]]
    return t.spark.createDataFrame(rows, "column string, value string, n long")


@query("fit_dp_budget", "SELECT 3.0::DOUBLE AS epsilon, true AS refused, (SELECT count(*) FROM orders) > 0 AS fitted")
def _(t):
    from ..errors import PrivacyBudget
    a = FIT.fit_dp(t.orders.select("o_orderstatus"), [FIT.DPColumn("o_orderstatus", "text")], 1.0, 1e-6)
    b = FIT.fit_dp(t.customer.select("c_mktsegment"), [FIT.DPColumn("c_mktsegment", "text")], 2.0, 1e-6)
    epsilon, _ = FIT.check_dp_budget([a, b, a], 3.0, 1e-5)
    try:
        FIT.check_dp_budget([a, b], 2.5, 1e-5)
        refused = False
    except PrivacyBudget:
        refused = True
    return t.orders.agg((F.count("*") > 0).alias("fitted")).withColumns({"epsilon": F.lit(epsilon), "refused": F.lit(refused)})


# ---- fidelity: odd order keys against even ones, with nulls and a moved price

SRC = "(SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 2 = 0)"
OUT = """(SELECT o_orderkey, o_custkey, o_totalprice * 1.1 AS o_totalprice, CASE WHEN o_orderkey % 5 <> 1 THEN o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 7 = 1 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 2 = 1)"""
FCOLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate"]


def halves(t: Tables):
    k = F.col("o_orderkey")
    src = t.orders.select(*FCOLS).where(k % 2 == 0)
    out = t.orders.select(*FCOLS).where(k % 2 == 1).withColumns({
        "o_totalprice": F.col("o_totalprice") * 1.1, "o_orderstatus": F.when(k % 5 != 1, F.col("o_orderstatus")),
        "o_orderpriority": F.when(k % 7 == 1, "1-URGENT").otherwise(F.col("o_orderpriority"))})
    return src, out


def _num_sql(c: str) -> str:
    qs = "[0.05, 0.25, 0.5, 0.75, 0.95]"
    return (f"""SELECT '{c}' AS "column", sqrt(list_sum(list_transform(list_zip(s, o), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 5) AS rmse, s[4] - s[2] AS iqr FROM
 (SELECT quantile_cont({c}, {qs}) AS s FROM {SRC}), (SELECT quantile_cont({c}, {qs}) AS o FROM {OUT})""")


_FNUM = " UNION ALL ".join(_num_sql(c) for c in ("o_custkey", "o_totalprice"))


@query("fid_numeric", f"""SELECT "column", round(rmse, 6) AS quantile_rmse, round(greatest(0, 1 - rmse / iqr), 6) AS similarity FROM ({_FNUM})""")
def _(t):
    r = FID.numeric(*halves(t), ["o_custkey", "o_totalprice"])
    return r.select("column", F.round("quantile_rmse", 6).alias("quantile_rmse"), F.round("similarity", 6).alias("similarity"))


def _tvd_sql(name: str, x: str, a: str = SRC, b: str = OUT) -> str:
    sh = lambda f, n: f"(SELECT ({x})::VARCHAR AS v, count(*)::DOUBLE / sum(count(*)) OVER () AS {n} FROM {f} WHERE ({x}) IS NOT NULL GROUP BY 1)"
    return f"""SELECT '{name}' AS "column", 0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))) AS tvd FROM {sh(a, 'p')} FULL JOIN {sh(b, 'q')} USING (v)"""


@query("fid_categorical", f"""SELECT "column", round(tvd, 6) AS tvd, round(1 - tvd, 6) AS similarity FROM ({_tvd_sql('o_orderstatus', 'o_orderstatus')} UNION ALL {_tvd_sql('o_orderpriority', 'o_orderpriority')}
 UNION ALL {_tvd_sql('o_orderdate', 'year(o_orderdate)')})""")
def _(t):
    s, o = halves(t)
    r = FID.categorical(s, o, ["o_orderstatus", "o_orderpriority"]).unionByName(FID.datetimes(s, o, ["o_orderdate"]))
    return r.select("column", F.round("tvd", 6).alias("tvd"), F.round("similarity", 6).alias("similarity"))


@query("fid_freetext", """SELECT 'text' AS "column", round(abs(a - b), 6) AS length_mean_diff, round(greatest(0, 1 - abs(a - b) / a), 6) AS similarity FROM (SELECT avg(length(text)) AS a FROM documents WHERE doc_id % 2 = 0),
 (SELECT avg(length(text)) AS b FROM documents WHERE doc_id % 2 = 1)""")
def _(t):
    d = t.documents
    r = FID.freetext(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["text"])
    return r.select("column", F.round("length_mean_diff", 6).alias("length_mean_diff"), F.round("similarity", 6).alias("similarity"))


_NULLS = f"(SELECT (count(*) - count(o_orderstatus))::DOUBLE / count(*) FROM {OUT})"


@query("fid_null_factor", f"""SELECT 'o_orderstatus' AS "column", 0.0::DOUBLE AS source_nulls, {_NULLS} AS output_nulls, 1 - {_NULLS} AS factor""")
def _(t):
    return FID.null_factor(*halves(t), ["o_orderstatus"])


_PAIR = "CASE WHEN o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL THEN o_orderstatus || '/' || o_orderpriority END"


@query("fid_pairwise", f"""SELECT 'o_orderstatusxo_orderpriority' AS joint, round(1 - tvd, 6) AS similarity FROM ({_tvd_sql('x', _PAIR)})""")
def _(t):
    return FID.pairwise(*halves(t), [("o_orderstatus", "o_orderpriority")]).select("joint", F.round("similarity", 6).alias("similarity"))


_MARG = f"""SELECT "column", 'numeric' AS kind, greatest(0, 1 - rmse / iqr) AS v, 0.0::DOUBLE AS nl FROM ({_FNUM}) UNION ALL SELECT 'o_orderstatus', 'categorical', 1 - tvd, {_NULLS} FROM ({_tvd_sql('x', 'o_orderstatus')})
 UNION ALL SELECT 'o_orderpriority', 'categorical', 1 - tvd, 0.0 FROM ({_tvd_sql('x', 'o_orderpriority')}) UNION ALL SELECT 'o_orderdate', 'datetime', 1 - tvd, 0.0 FROM ({_tvd_sql('x', 'year(o_orderdate)')})"""
SCORED = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate"]


def _marginal(t: Tables):
    s, o = halves(t)
    return FID.marginal(s.select(*SCORED), o.select(*SCORED))


@query("fid_marginal", f"""SELECT "column", kind, true AS comparable, round(v, 6) AS value_similarity, round(1 - nl, 6) AS missing_similarity, round(v * (1 - nl), 6) AS similarity FROM ({_MARG})""")
def _(t):
    r = lambda c: F.round(c, 6).alias(c)
    return _marginal(t).select("column", "kind", "comparable", r("value_similarity"), r("missing_similarity"), r("similarity"))


@query("fid_overall", f"""SELECT round(m, 6) AS marginal_score, round(p, 6) AS pairwise_score, round((m + p) / 2, 6) AS overall_score, CASE WHEN (m + p) / 2 >= 0.95 THEN 'A' WHEN (m + p) / 2 >= 0.85 THEN 'B'
 WHEN (m + p) / 2 >= 0.7 THEN 'C' WHEN (m + p) / 2 >= 0.5 THEN 'D' ELSE 'F' END AS grade FROM (SELECT avg(v * (1 - nl)) AS m FROM ({_MARG})), (SELECT 1 - tvd AS p FROM ({_tvd_sql('x', _PAIR)}))""")
def _(t):
    s, o = halves(t)
    r = lambda c: F.round(c, 6).alias(c)
    return FID.overall(_marginal(t), FID.pairwise(s, o, [("o_orderstatus", "o_orderpriority")])).select(r("marginal_score"), r("pairwise_score"), r("overall_score"), "grade")


def _ks_sql(c: str) -> str:
    return (f"""SELECT '{c}' AS "column", max(abs(f - g)) AS ks FROM (SELECT sum(s) OVER (ORDER BY v) / (SELECT count({c}) FROM {SRC})::DOUBLE AS f, sum(o) OVER (ORDER BY v) / (SELECT count({c}) FROM {OUT})::DOUBLE AS g
 FROM (SELECT v, sum(s) AS s, sum(o) AS o FROM (SELECT {c}::DOUBLE AS v, 1 AS s, 0 AS o FROM {SRC} UNION ALL SELECT {c}::DOUBLE, 0, 1 FROM {OUT}) GROUP BY v))""")


@query("fid_ks", f"""SELECT "column", round(ks, 6) AS ks, round(1 - ks, 6) AS similarity FROM ({_ks_sql('o_custkey')} UNION ALL {_ks_sql('o_totalprice')})""")
def _(t):
    return FID.ks(*halves(t), ["o_custkey", "o_totalprice"]).select("column", F.round("ks", 6).alias("ks"), F.round("similarity", 6).alias("similarity"))


def _v_sql(c: str) -> str:
    cells = f"(SELECT {c} AS v, side, count(*) AS o FROM (SELECT {c}, 's' AS side FROM {SRC} UNION ALL SELECT {c}, 'o' FROM {OUT}) WHERE {c} IS NOT NULL GROUP BY 1, 2)"
    return (f"""SELECT '{c}' AS "column", sqrt(sum((o - e) * (o - e) / e) / any_value(n)) AS v FROM (SELECT coalesce(x.o, 0) AS o, r.t * k.t / n.t::DOUBLE AS e, n.t AS n FROM
 (SELECT v, sum(o) AS t FROM {cells} GROUP BY v) r CROSS JOIN (SELECT side, sum(o) AS t FROM {cells} GROUP BY side) k CROSS JOIN (SELECT sum(o) AS t FROM {cells}) n LEFT JOIN {cells} x ON x.v = r.v AND x.side = k.side)""")


@query("fid_cramers_v", f"""SELECT "column", round(v, 6) AS cramers_v, round(1 - v, 6) AS similarity FROM ({_v_sql('o_orderstatus')} UNION ALL {_v_sql('o_orderpriority')})""")
def _(t):
    return FID.cramers_v(*halves(t), ["o_orderstatus", "o_orderpriority"]).select("column", F.round("cramers_v", 6).alias("cramers_v"), F.round("similarity", 6).alias("similarity"))


_RANKS = lambda f: f"(SELECT row_number() OVER (ORDER BY count(*) DESC) AS r, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM {f} GROUP BY o_custkey)"


@query("fid_shape", f"""SELECT 'o_custkey' AS "column", round(1 - 0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 6) AS similarity FROM {_RANKS(SRC)} a FULL JOIN {_RANKS(OUT)} b USING (r)""")
def _(t):
    from ..operators.masks import keep, mask_table, rule
    s, o = halves(t)
    hashed = mask_table(o.select("o_orderkey", "o_custkey"), [rule("o_custkey", "hash", "customer_identity"), *keep("o_orderkey")], SECRET, "orders")
    return FID.shape(s, hashed, "o_custkey").withColumn("similarity", F.round("similarity", 6))


@query("fid_policy", f"""SELECT 'column' AS rule, "column" AS subject, 0.99::DOUBLE AS minimum, round(v * (1 - nl), 6) AS actual FROM ({_MARG}) WHERE v * (1 - nl) < 0.99 AND "column" IN ('o_totalprice', 'o_orderstatus')
 UNION ALL SELECT 'strategy', "column", 0.85, round(v * (1 - nl), 6) FROM ({_MARG}) WHERE "column" = 'o_orderstatus' AND v * (1 - nl) < 0.85""")
def _(t):
    m = _marginal(t)
    v = FID.policy_violations(m, FID.overall(m), {"overall": 0.1, "columns": {"o_totalprice": 0.99, "o_orderstatus": 0.99}},
                              {"o_orderstatus": "shuffle", "o_custkey": "faker"})
    return v.withColumn("actual", F.round("actual", 6))


@query("fid_diagnostic", f"""SELECT 'row_count' AS "check", NULL AS "column", (SELECT count(*) FROM {SRC}) = (SELECT count(*) FROM {OUT}) AS ok UNION ALL SELECT 'column_present', 'o_custkey', true
 UNION ALL SELECT 'type_kept', 'o_custkey', false UNION ALL SELECT 'column_present', 'o_totalprice', false""")
def _(t):
    s, o = halves(t)
    return FID.diagnostic(s.select("o_custkey", "o_totalprice"), o.select(F.col("o_custkey").cast("string").alias("o_custkey")))


@query("post_scan_distribution", f"""SELECT "column", round(v * (1 - nl), 6) AS similarity, 1 - v * (1 - nl) > 0.1 AS warn FROM ({_MARG}) WHERE "column" IN ('o_totalprice', 'o_orderstatus')""")
def _(t):
    from ..operators.evidence import distribution_warnings
    return distribution_warnings(*halves(t), ["o_totalprice", "o_orderstatus"], 0.1).withColumn("similarity", F.round("similarity", 6))


@query("gen_low_fidelity_warning", """SELECT 'column o_orderstatus scores ' || printf('%.3f', count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*)) || ', under 0.8' AS warning FROM orders""")
def _(t):
    from ..operators.generate import Generator, GenTable, check_fidelity, gen
    src = t.orders.select("o_totalprice", "o_orderstatus")
    snap = FIT.fit(src, include_values=True)
    table = GenTable("g", t.orders.count(), (gen("o_totalprice", "statistical", snapshot=snap), gen("o_orderstatus", "categorical", categories=["F"])))
    out = Generator(t.spark, [table], seed=SEED).run()["g"]
    scores = {r["column"]: r["similarity"] for r in FID.marginal(src, out).where("comparable").collect()}
    return t.spark.createDataFrame([(w,) for w in check_fidelity(scores)], "warning string")
