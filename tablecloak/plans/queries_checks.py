"""Validators, quarantine, evidence, privacy measures, streams and the Python calls."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import evidence as EV
from ..operators import privacy as PR
from ..operators.masks import keep, mask_table, rule
from ..operators.relations import Link
from ..keys import sql_row_message
from ..session import scratch_dir
from . import oracle_text as O
from .oracle_text import mask_hmac
from .queries_mask import _shift_sql, DAY, _numbers_sql, orders_text, with_numbers
from .queries_relations import H_CUST, ORDER_LINK, PARENT, _propagated, thin
from .registry import SECRET, Tables, query


def _bent(column: str) -> str:
    """Every third number has its last character replaced by 0."""
    return f"CASE WHEN c_custkey % 3 = 0 THEN left({column}, length({column}) - 1) || '0' ELSE {column} END AS {column}"


def bent(t: Tables):
    df = with_numbers(t)
    return df.select("c_custkey", *[F.when(F.col("c_custkey") % 3 == 0, F.concat(F.expr(f"left({c}, length({c}) - 1)"), F.lit("0"))).otherwise(F.col(c)).alias(c)
                                    for c in df.columns[1:]])


def _validator(name: str, column: str, kind: str, ok: str):
    @query(name, f"SELECT '{kind}:{column}' AS \"check\", count({column}) AS checked, count(*) FILTER (NOT ({ok})) AS failed FROM (SELECT c_custkey, {_bent(column)} FROM ({_numbers_sql()}))")
    def _(t):
        return C.failures(bent(t), [C.check(kind, column)])


_body = lambda c: f"substr({c}, 1, length({c}) - 1)"
_npi_pre = "('80840' || substr(npi, 1, 9))"
_vin_zero = "(substr(vin, 1, 8) || '0' || substr(vin, 10, 8))"
_iban_turned = "(substr(iban, 5) || substr(iban, 1, 4))"
_validator("val_luhn", "luhn", "luhn", f"{O.luhn_digit(_body('luhn'))} = right(luhn, 1)")
_validator("val_npi", "npi", "npi", f"{O.luhn_digit(_npi_pre)} = right(npi, 1)")
_validator("val_iban", "iban", "iban", f"{O.mod97(_iban_turned)} = 1")
_validator("val_vin", "vin", "vin", f"{O.vin_digit(_vin_zero)} = substr(vin, 9, 1)")


@query("val_isbn13_ean13_gtin", " UNION ALL ".join(f"SELECT '{c}:{c}' AS \"check\", count({c}) AS checked, count(*) FILTER (NOT ({O.gtin_digit(_body(c))} = right({c}, 1))) AS failed FROM (SELECT c_custkey, {_bent(c)} FROM ({_numbers_sql()}))"
                                                  for c in ("isbn13", "ean13", "gtin")))
def _(t):
    return C.failures(bent(t), [C.check(c, c) for c in ("isbn13", "ean13", "gtin")])


@query("val_regex_match", "SELECT 'regex_match:c_name' AS \"check\", count(c_name) AS checked, count(*) FILTER (NOT regexp_full_match(c_name, 'Customer#0000000[0-9]{2}')) AS failed FROM customer")
def _(t):
    return C.failures(t.customer, [C.check("regex_match", "c_name", pattern="^Customer#0000000[0-9]{2}$")])


@query("val_column_in_set", "SELECT 'column_in_set:o_orderstatus' AS \"check\", count(*) AS checked, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS failed FROM orders")
def _(t):
    return C.failures(t.orders, [C.check("column_in_set", "o_orderstatus", values=["O", "F"])])


@query("val_leak_check", """SELECT 'c_name' AS "column", count(*) AS rows, count(*) FILTER (c_mktsegment <> 'BUILDING') AS identical, 0 AS lost, (count(*) FILTER (c_mktsegment <> 'BUILDING'))::DOUBLE / count(*) AS ratio,
 false AS ok FROM customer UNION ALL SELECT 'c_mktsegment', count(*), 0, 0, 0.0, true FROM customer""")
def _(t):
    src = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    out = mask_table(src, [rule("c_name", "redact", when=F.col("c_mktsegment") == "BUILDING"), rule("c_mktsegment", "hash", "seg"), *keep("c_custkey")], SECRET, "customer")
    return C.leak_check(src, out, ["c_custkey"], ["c_name", "c_mktsegment"], 0.02, 50)


@query("val_fk_intact", "SELECT 'orders->lineitem' AS edge, count(*) AS orphans, count(*) = 0 AS ok FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(t):
    return C.fk_intact(t.orders, t.lineitem, Link("orders", ("o_orderkey",), "lineitem", ("l_orderkey",), "fail"))


@query("val_no_orphan_children", f"SELECT 'customer->orders' AS edge, count(*) AS orphans, false AS ok FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {PARENT})")
def _(t):
    return C.fk_intact(thin(t), t.orders, ORDER_LINK)


@query("check_fk_preservation", "SELECT 'customer->orders' AS edge, 0 AS lost, 0 AS gained, 0 AS missing, true AS ok, (SELECT count(*) FROM orders) AS n")
def _(t):
    parent = mask_table(thin(t).select("c_custkey"), [rule("c_custkey", "hash", "customer_identity")], SECRET, "customer")
    r = C.fk_preserved(ORDER_LINK, thin(t), t.orders, parent, _propagated(t, "preserve"), ["o_orderkey"])
    return r.withColumn("n", t.orders.agg(F.count("*")).scalar())


@query("check_policy", """SELECT * FROM (VALUES ('*', 'rows', 0), ('o_custkey', 'hash', 0), ('o_orderdate', 'date_shift', 0), ('o_orderstatus', 'redact', 0), ('o_orderpriority', 'truncate', 0)) v("column", strategy, broken)
 UNION ALL SELECT 'o_comment', 'redact', count(*) FROM orders WHERE o_orderkey % 100 = 0""")
def _(t):
    src = orders_text(t).join(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderpriority").alias("o_comment")), "o_orderkey")
    rules = [rule("o_custkey", "hash", "c"), rule("o_orderdate", "date_shift", "d", min_days=-30, max_days=30, date_format="%Y-%m-%d"),
             rule("o_orderstatus", "redact"), rule("o_orderpriority", "truncate", length=1), rule("o_comment", "redact"), *keep("o_orderkey")]
    out = mask_table(src, rules, SECRET, "orders")
    # one row in a hundred lost its comment on the way: the check must see it
    out = out.withColumn("o_comment", F.when(F.col("o_orderkey") % 100 != 0, F.col("o_comment")))
    return C.check_policy(src, out, rules, ["o_orderkey"])


@query("check_policy_faults", """WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0)
 SELECT '*' AS "column", 'rows' AS strategy, count(*) AS broken FROM orders WHERE o_orderkey % 11 = 0
 UNION ALL SELECT 'moved', 'date_shift', count(*) FROM o WHERE k % 7 = 0 UNION ALL SELECT 'banded', 'bucketize', count(*) FROM o WHERE k % 5 = 0
 UNION ALL SELECT 'pan', 'fpe', count(*) FROM o WHERE k % 2 = 0 UNION ALL SELECT 'cut', 'truncate', count(*) FROM o WHERE k % 3 = 0
 UNION ALL SELECT 'kind', 'categorical', count(*) FROM o WHERE k % 9 = 0 UNION ALL SELECT 'same', 'passthrough', count(*) FROM o WHERE k % 13 = 0
 UNION ALL SELECT 'name', 'faker', count(*) FROM o WHERE k % 4 = 0""")
def _(t):
    """One planted fault per strategy, and rows that vanish."""
    k = F.col("o_orderkey")
    src = t.orders.select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("moved"), F.col("o_totalprice").alias("banded"),
                          F.lpad((k + 4_000_000_000).cast("string"), 16, "4").alias("pan"), F.concat(F.lit("p"), k.cast("string")).alias("cut"),
                          F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("same"), F.concat(F.lit("n-"), k.cast("string")).alias("name"))
    rules = [rule("moved", "date_shift", "d", min_days=-30, max_days=30, date_format="%m/%d/%Y"), rule("banded", "bucketize", width=1000), rule("pan", "fpe", "pan"),
             rule("cut", "truncate", length=2), rule("kind", "categorical", categories=["a", "b"]), rule("name", "faker", "people", deterministic=True, provider="person_email"),
             *keep("same", "o_orderkey")]
    out = mask_table(src, rules, SECRET, "orders", ["o_orderkey"]).where("o_orderkey % 11 <> 0")
    real = src.select("o_orderkey", *[F.col(c).alias(f"was_{c}") for c in ("moved", "pan", "cut", "name")])
    fault = lambda c, every, bad: F.when(k % every == 0, bad).otherwise(F.col(c)).alias(c)
    far = F.date_format(F.date_add(F.to_date("was_moved", "MM/dd/yyyy"), 900), "MM/dd/yyyy")
    out = out.join(real, "o_orderkey").select(
        "o_orderkey", fault("moved", 7, far), fault("banded", 5, F.lit("nonsense")), fault("pan", 2, F.col("was_pan")), fault("cut", 3, F.lit("zz")), fault("kind", 9, F.lit("c")),
        fault("same", 13, F.lit("?")), fault("name", 4, F.col("was_name")))
    return C.check_policy(src, out, rules, ["o_orderkey"])


# every cell of one column moved down by one row and one cell changed; another column rightly shuffled, a third with one stranger
@query("check_policy_swap", """SELECT '*' AS "column", 'rows' AS strategy, 0 AS broken UNION ALL SELECT 'pan', 'fpe', count(*) - 1 FROM orders
 UNION ALL SELECT 'price', 'shuffle', 0 UNION ALL SELECT 'clerk', 'shuffle', 1""")
def _(t):
    from ..operators.ordering import with_row_index
    src = with_row_index(t.orders.select("o_orderkey", F.lpad((F.col("o_orderkey") + 4_000_000_000).cast("string"), 16, "4").alias("pan"), F.col("o_totalprice").alias("price"),
                                         F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("clerk")), ["o_orderkey"], "i")
    n = src.count()
    moved = src.select(((F.col("i") + 1) % n).alias("i"), F.when(F.col("i") == 0, "4" + "0" * 15).otherwise(F.col("pan")).alias("pan"), "price",
                       F.when(F.col("i") == 0, "nobody").otherwise(F.col("clerk")).alias("clerk"))
    out = src.select("i", "o_orderkey").join(moved, "i").drop("i")
    rules = [rule("pan", "fpe", "pan"), rule("price", "shuffle"), rule("clerk", "shuffle"), *keep("o_orderkey")]
    return C.check_policy(src.drop("i"), out, rules, ["o_orderkey"])


@query("check_residual_pii", """SELECT 'contact' AS "column", 'email' AS detector, 1.0::DOUBLE AS source_rate, (SELECT count(*) FILTER (c_custkey % 2 = 0)::DOUBLE / count(*) FROM customer) AS output_rate,
 CASE WHEN (SELECT count(*) FILTER (c_custkey % 2 = 0)::DOUBLE / count(*) FROM customer) >= 0.5 THEN 'high' ELSE 'medium' END AS severity""")
def _(t):
    mail = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    src = t.customer.select(mail.alias("contact"), mail.alias("fake"))
    out = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, mail).otherwise("gone").alias("contact"), mail.alias("fake"))
    return C.residual_pii(src, out, {"fake": "email"})


_QBAD = "(o_orderkey % 7 = 0 OR o_orderstatus NOT IN ('O', 'F'))"


def _quarantined(t: Tables):
    df = orders_text(t).join(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    masked = mask_table(df, [rule("o_orderdate", "date_shift", "dates", min_days=-30, max_days=30, date_format="%Y-%m-%d"),
                             *keep("o_orderkey", "o_custkey", "o_orderstatus")], SECRET, "orders", with_errors=True)
    return C.quarantine(masked, [C.check("column_in_set", "o_orderstatus", values=["O", "F"])])


@query("quarantine_rows", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'format_error:o_orderdate' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus NOT IN ('O', 'F') THEN ',' ELSE '' END ||
 CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'validation_fail:column_in_set:o_orderstatus' ELSE '' END AS reasons FROM orders WHERE {_QBAD}""")
def _(t):
    _, bad = _quarantined(t)
    p = f"{scratch_dir(t.spark)}/tablecloak/quarantine-{uuid.uuid4().hex}"
    C.write_quarantine(bad, p)
    back = t.spark.read.schema("row string, reasons array<string>").json(p)
    return back.select(F.get_json_object("row", "$.o_orderkey").cast("bigint").alias("o_orderkey"), F.array_join("reasons", ",").alias("reasons"))


@query("quarantine_clean_rows", f"SELECT o_orderkey, strftime(o_orderdate::DATE + {_shift_sql(mask_hmac(DAY, 'date_shift', 'dates'), -30, 30)}, '%Y-%m-%d') AS o_orderdate FROM orders WHERE NOT {_QBAD}")
def _(t):
    return _quarantined(t)[0].select("o_orderkey", "o_orderdate")


@query("data_diff", """SELECT 'o_orderkey' AS "column", 'common' AS change, b.n - a.n AS row_delta, 0 AS null_delta, b.n - a.n AS unique_delta, false AS type_changed FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0) b
 UNION ALL SELECT 'o_orderstatus', 'common', b.n - a.n, b.z, b.d - a.d, false FROM (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS d FROM orders) a, (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS z, count(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'P') AS d FROM orders WHERE o_orderkey % 3 <> 0) b
 UNION ALL SELECT 'o_custkey', 'common', b.n - a.n, 0, b.d - a.d, true FROM (SELECT count(*) AS n, count(DISTINCT o_custkey) AS d FROM orders) a, (SELECT count(*) AS n, count(DISTINCT o_custkey) AS d FROM orders WHERE o_orderkey % 3 <> 0) b
 UNION ALL SELECT 'o_orderpriority', 'removed', NULL, NULL, NULL, NULL UNION ALL SELECT 'extra', 'added', NULL, NULL, NULL, NULL""")
def _(t):
    a = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")
    b = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
                                                     F.col("o_custkey").cast("string").alias("o_custkey"), F.lit(1).alias("extra"))
    return EV.data_diff(a, b, exact=True)


def _content(cols: list[str], frm: str) -> str:
    return f"SELECT count(*) AS rows, sum(('0x' || substr(sha256({sql_row_message(*cols)}), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS content_hash FROM {frm}"


@query("run_evidence", f"""SELECT 'input' AS side, 'customer' AS "table", rows, content_hash, 'hash=1,passthrough=1,redact=1' AS strategies FROM ({_content(['c_custkey', 'c_name', 'c_mktsegment'], 'customer')})
 UNION ALL SELECT 'output', 'customer', rows, content_hash, 'hash=1,passthrough=1,redact=1' FROM ({_content([H_CUST, "'REDACTED'", 'c_mktsegment'], 'customer')})""")
def _(t):
    src = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    rules = [rule("c_custkey", "hash", "customer_identity"), rule("c_name", "redact"), *keep("c_mktsegment")]
    return EV.manifest({"customer": src}, {"customer": mask_table(src, rules, SECRET, "customer")}, {"customer": rules})


@query("run_compare", "SELECT 'output' AS side, 'customer' AS \"table\", -(SELECT count(*) FROM customer WHERE c_custkey % 4 = 0) AS row_delta, true AS changed UNION ALL SELECT 'input', 'customer', 0, false")
def _(t):
    src = t.customer.select("c_custkey", "c_name")
    a = EV.manifest({"customer": src}, {"customer": src})
    b = EV.manifest({"customer": src.repartition(5)}, {"customer": src.where("c_custkey % 4 <> 0")})
    return EV.compare_runs(a, b)


# source: even customers; output: every customer with a slightly moved balance, every tenth left as it was
def _priv(t: Tables):
    src = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_nationkey", "c_acctbal")
    out = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal")).otherwise(F.col("c_acctbal") + 37.5).alias("c_acctbal"))
    return src, out


_SCALE = "(c_nationkey - nl) / (nh - nl)::DOUBLE AS x, (c_acctbal - bl) / (bh - bl)::DOUBLE AS y"
_ENDS = "(SELECT min(c_nationkey)::DOUBLE AS nl, max(c_nationkey)::DOUBLE AS nh, min(c_acctbal) AS bl, max(c_acctbal) AS bh FROM customer WHERE c_custkey % 2 = 0)"
_GRID = "CASE WHEN l > 10 THEN {x} ELSE floor({x} * pow(2.0, l)) END"


@query("privacy_dcr", f"""WITH s AS (SELECT {_SCALE} FROM customer, {_ENDS} WHERE c_custkey % 2 = 0),
 o AS (SELECT c_custkey, {_SCALE} FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal ELSE c_acctbal + 37.5 END AS c_acctbal FROM customer), {_ENDS}),
 lv AS (SELECT unnest(range(1, 12)) AS l), sc AS (SELECT DISTINCT l, {_GRID.format(x='x')} AS a, {_GRID.format(x='y')} AS b FROM s, lv),
 oc AS (SELECT c_custkey, l, {_GRID.format(x='x')} AS a, {_GRID.format(x='y')} AS b FROM o, lv)
 SELECT c_custkey, CASE WHEN max(CASE WHEN sc.l IS NOT NULL THEN oc.l END) IS NULL THEN 1.0 WHEN max(CASE WHEN sc.l IS NOT NULL THEN oc.l END) > 10 THEN 0.0
 ELSE pow(2.0, -max(CASE WHEN sc.l IS NOT NULL THEN oc.l END)) END::DOUBLE AS dcr FROM oc LEFT JOIN sc USING (l, a, b) GROUP BY 1""")
def _(t):
    return PR.distance_to_closest(*_priv(t), ["c_custkey"], ["c_nationkey", "c_acctbal"])


_NEAR = "greatest(abs((o.nation - nl) / (nh - nl) - (s.c_nationkey - nl) / (nh - nl)), abs((o.balance - bl) / (bh - bl) - (s.c_acctbal - bl) / (bh - bl)))"


# every supplier against every customer, to the last digit
@query("privacy_closest_record", f"""WITH e AS (SELECT min(c_nationkey)::DOUBLE AS nl, max(c_nationkey)::DOUBLE AS nh, min(c_acctbal)::DOUBLE AS bl, max(c_acctbal)::DOUBLE AS bh FROM customer),
 s AS (SELECT DISTINCT c_nationkey::DOUBLE AS c_nationkey, c_acctbal::DOUBLE AS c_acctbal FROM customer),
 o AS (SELECT s_suppkey, s_nationkey::DOUBLE AS nation, s_acctbal::DOUBLE AS balance FROM supplier)
 SELECT s_suppkey, min({_NEAR}) AS distance FROM o, s, e GROUP BY 1""")
def _(t):
    out = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    return PR.closest_record(t.customer, out, ["s_suppkey"], ["c_nationkey", "c_acctbal"])


@query("privacy_linkage", """WITH one AS (SELECT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL HAVING count(*) = 1)
 SELECT count(*) AS rows, count(one.p_brand) AS linked, count(one.p_brand)::DOUBLE / count(*) AS share FROM part LEFT JOIN one USING (p_brand, p_type, p_size)""")
def _(t):
    return PR.linkage(t.part.where("p_partkey % 2 = 0"), t.part, ["p_brand", "p_type", "p_size"])


# ---- streams


def _event_rules():
    return [rule("user_id", "hash", "user_identity"), rule("ts", "date_shift", "event_days", min_days=-5, max_days=5), rule("value", "bucketize", width=10),
            rule("event_type", "categorical", categories=["A", "B"]), rule("props", "redact"), *keep("event_id")]


_EDAY = mask_hmac("strftime(ts, '%Y-%m-%d')", "date_shift", "event_days")
_EVENTS_SQL = f"""SELECT event_id, ts + to_days({_shift_sql(_EDAY, -5, 5)}) AS ts, substr({mask_hmac('user_id::VARCHAR', 'hash', 'user_identity')}, 1, 32) AS user_id,
 {O.weighted(O.unit(mask_hmac('event_type', 'categorical', 'events.event_type')), ['A', 'B'], None)} AS event_type,
 (floor(value / 10) * 10)::BIGINT::VARCHAR || '-' || (floor(value / 10) * 10 + 10)::BIGINT::VARCHAR AS value, 'REDACTED' AS props FROM events"""


def _event_stream(t: Tables):
    # the folder holds other tables too; the glob picks the events
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


@query("stream_mask", _EVENTS_SQL)
def _(t):
    from ..streaming.masking import mask_stream, run_available
    base = f"{scratch_dir(t.spark)}/tablecloak/stream-{uuid.uuid4().hex}"
    run_available(mask_stream(_event_stream(t), _event_rules(), SECRET, "events"), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out")


@query("stream_refuse_whole_column", "SELECT count(*) AS n, true AS refused FROM events")
def _(t):
    from ..errors import NotStreamable
    from ..streaming.masking import mask_stream
    try:
        mask_stream(_event_stream(t), [rule("user_id", "shuffle"), *keep("event_id", "ts", "event_type", "value", "props")], SECRET, "events", ["event_id"])
        refused = False
    except NotStreamable:
        refused = True
    return t.events.agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("stream_tokenize", f"SELECT event_id, 'tok_' || substr({mask_hmac('user_id::VARCHAR', 'tokenize', 'user')}, 1, 32) AS user_id FROM events")
def _(t):
    from ..streaming.masking import VaultTable, tokenize_stream
    base = f"{scratch_dir(t.spark)}/tablecloak/stream-{uuid.uuid4().hex}"
    stream = _event_stream(t).select("event_id", F.col("user_id").cast("string").alias("user_id"))
    tokenize_stream(stream, "user_id", VaultTable(t.spark, f"{base}/vault", "user", SECRET), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out").select("event_id", "user_id")


# ---- the Python calls


@query("api_mask", f"SELECT {H_CUST} AS c_custkey, 'REDACTED' AS c_name FROM customer")
def _(t):
    import tablecloak
    return tablecloak.mask(t.customer.select("c_custkey", "c_name"), [rule("c_custkey", "hash", "customer_identity"), rule("c_name", "redact")], SECRET, table="customer")


@query("api_scan", "SELECT 'c_custkey' AS \"column\", 'integer' AS inferred_type, 0 AS nulls, (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'c_mktsegment', 'string', 0, (SELECT count(*) FROM customer)")
def _(t):
    import tablecloak
    return tablecloak.scan(t.customer.select("c_custkey", "c_mktsegment"), "customer").select("column", "inferred_type", "nulls", "rows")
