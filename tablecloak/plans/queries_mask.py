"""Masking strategies over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.detectors import BY_ID, SPANS
from ..functions.providers import COMPOSITES, PROVIDERS
from ..keys import sql_feistel, sql_permute, sql_row_message, subkey
from ..operators import masks as M
from ..operators.masks import keep, mask_table, rule
from ..operators.text import find_entities, redact_text
from ..session import spread
from . import oracle_text as O
from .oracle_text import mask_hmac, pick, row_hmac, unit, weighted
from .registry import SECRET, Tables, query

CUST = "c_custkey::VARCHAR"


def customers(t: Tables, *rules, key=("c_custkey",), columns=("c_custkey",), **kw):
    df = kw.pop("df", None)
    df = t.customer if df is None else df
    ruled = {c for r in rules for c in r.columns}
    have = [c for c in (*columns, *ruled) if c in df.columns]
    df = df.select(*dict.fromkeys(have), *[c for c in kw.pop("also", ()) if c not in have])
    rest = [c for c in df.columns if c not in ruled]
    return mask_table(df, [*rules, *keep(*rest)], SECRET, "customer", key, **kw)


@query("mask_passthrough", "SELECT c_custkey, c_name FROM customer")
def _(t):
    return customers(t, rule("c_name", "passthrough"))


@query("mask_redact", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 'REDACTED' END AS c_name FROM customer")
def _(t):
    df = t.customer.withColumn("c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")))
    return customers(t, rule("c_name", "redact"), df=df)


@query("mask_hash", f"""SELECT l_linenumber, l_quantity, substr({mask_hmac('l_orderkey::VARCHAR', 'hash', 'order_identity')}, 1, 32) AS l_orderkey,
 substr({mask_hmac('l_partkey::VARCHAR', 'hash', 'part_identity')}, 1, 32) AS l_partkey FROM lineitem""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return mask_table(df, [rule("l_orderkey", "hash", "order_identity"), rule("l_partkey", "hash", "part_identity"),
                           *keep("l_linenumber", "l_quantity")], SECRET, "lineitem")


def fpe_digits_sql(body: str, space: str, n: int) -> str:
    """Digits body of fixed length n up to 34: one block, tweak n|0."""
    u, v = n // 2, n - n // 2
    s = sql_feistel(subkey(SECRET, "fpe", space), f"'{n}|0'", f"substr({body}, 1, {u})", f"substr({body}, {u + 1}, {v})",
                    str(10**u), str(10**v))
    return f"list_transform([{s}], lambda s: lpad(s.l::VARCHAR, {u}, '0') || lpad(s.r::VARCHAR, {v}, '0'))[1]"


# c_name is Customer#000000001: the nine digits move, the rest stays
@query("mask_fpe", f"""SELECT c_custkey, 'Customer#' || {fpe_digits_sql("substr(c_name, 10, 9)", 'cust', 9)} AS c_name FROM customer""")
def _(t):
    return customers(t, rule("c_name", "fpe", "cust", charset="digits"), df=spread(t.customer.select("c_custkey", "c_name")))


def with_numbers(t: Tables):
    """Card, NPI, IBAN, VIN, EAN-13, ISBN-13 and GTIN-14 of each customer, from provider formulas and keys."""
    from ..functions import checksums as C
    k = F.col("c_custkey")
    pad = lambda w: F.lpad((k * 7919 + 13).cast("string"), w, "0")
    vin = F.concat(F.lit("1HGCM826"), F.lit("0"), F.lpad(k.cast("string"), 8, "0"))
    return spread(t.customer.select("c_custkey")).select(
        "c_custkey", PROVIDERS["synthetic_pan"].at(k * 7919).alias("luhn"), PROVIDERS["synthetic_npi"].at(k * 7919).alias("npi"),
        PROVIDERS["synthetic_iban"].at(k * 7919).alias("iban"),
        F.concat(F.substring(vin, 1, 8), C.vin_digit(vin), F.substring(vin, 10, 8)).alias("vin"),
        F.concat(pad(12), C.gtin_digit(pad(12))).alias("ean13"),
        F.concat(F.lit("978"), pad(9), C.gtin_digit(F.concat(F.lit("978"), pad(9)))).alias("isbn13"),
        F.concat(pad(13), C.gtin_digit(pad(13))).alias("gtin"),
    )


CHECKS = ("luhn", "npi", "iban", "vin", "ean13", "isbn13", "gtin")


def _numbers_sql() -> str:
    k = "c_custkey"
    pad = lambda w: O.pad(f"{k} * 7919 + 13", w)
    vin = f"('1HGCM8260' || {O.pad(k, 8)})"
    isbn = f"('978' || {pad(9)})"
    return (f"SELECT c_custkey, {O.PROVIDER_SQL['synthetic_pan'](f'({k} * 7919)')} AS luhn, "
            f"{O.PROVIDER_SQL['synthetic_npi'](f'({k} * 7919)')} AS npi, {O.PROVIDER_SQL['synthetic_iban'](f'({k} * 7919)')} AS iban, "
            f"substr({vin}, 1, 8) || {O.vin_digit(vin)} || substr({vin}, 10, 8) AS vin, "
            f"{pad(12)} || {O.gtin_digit(pad(12))} AS ean13, {isbn} || {O.gtin_digit(isbn)} AS isbn13, "
            f"{pad(13)} || {O.gtin_digit(pad(13))} AS gtin FROM customer")


_PAN_BODY = fpe_digits_sql("substr(luhn, 1, 15)", "pan", 15)
_EAN_BODY = fpe_digits_sql("substr(ean13, 1, 12)", "ean", 12)
_NPI_BODY = fpe_digits_sql("substr(npi, 2, 8)", "npi", 8)


@query("mask_fpe_checksum", f"""WITH n AS ({_numbers_sql()}), b AS (SELECT c_custkey, {_PAN_BODY} AS p, {_EAN_BODY} AS e,
 substr(npi, 1, 1) || {_NPI_BODY} AS i FROM n)
 SELECT c_custkey, p || {O.luhn_digit('p')} AS luhn, e || {O.gtin_digit('e')} AS ean13, i || {O.luhn_digit("('80840' || i)")} AS npi FROM b""")
def _(t):
    return customers(t, rule("luhn", "fpe", "pan", validate_luhn=True), rule("ean13", "fpe", "ean", checksum="ean13"),
                     rule("npi", "fpe", "npi", checksum="npi"), df=with_numbers(t))


@query("unmask_fpe", f"SELECT n.*, c_name, c.c_custkey AS id FROM ({_numbers_sql()}) n JOIN customer c USING (c_custkey)")
def _(t):
    rules = [rule(c, "fpe", c, checksum=c) for c in CHECKS] + [
        rule("c_name", "fpe", "nm", charset="ALPHANUM"), rule("id", "fpe", "id", width=12), *keep("c_custkey")]
    df = with_numbers(t).join(t.customer.select("c_custkey", "c_name"), "c_custkey").withColumn("id", F.col("c_custkey"))
    masked = mask_table(spread(df), rules, SECRET, "customer")
    return M.unmask_fpe(masked, rules, SECRET, "customer")


@query("mask_faker", f"""SELECT c_custkey, {O.provider('person_full_name', mask_hmac('c_name', 'faker', 'people'))} AS c_name,
 {O.provider('address_state', row_hmac(CUST, 'faker', 'customer', 'c_mktsegment'))} AS c_mktsegment FROM customer""")
def _(t):
    return customers(t, rule("c_name", "faker", "people", deterministic=True, provider="person_full_name"),
                     rule("c_mktsegment", "faker", provider="address_state"))


def _shift_sql(h: str, lo: int, hi: int) -> str:
    k = f"({pick(h, hi - lo)} + ({lo}))"
    return f"(CASE WHEN {k} >= 0 THEN {k} + 1 ELSE {k} END)::INT"


DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def orders_text(t: Tables):
    """Order dates as text; every seventh one is not a date."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 == 0, F.concat(day, F.lit("x")))
                           .otherwise(day).alias("o_orderdate"))


@query("mask_date_shift", f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate::DATE +
 {_shift_sql(mask_hmac(DAY, 'date_shift', 'dates'), -30, 30)}, '%Y-%m-%d') END AS o_orderdate,
 o_orderdate + to_days({_shift_sql(mask_hmac('o_custkey::VARCHAR', 'date_shift', 'ent'), -10, 10)}) AS entity_date FROM orders""")
def _(t):
    df = orders_text(t).join(t.orders.select("o_orderkey", F.col("o_orderdate").alias("entity_date")), "o_orderkey")
    return mask_table(df, [rule("o_orderdate", "date_shift", "dates", min_days=-30, max_days=30, date_format="%Y-%m-%d"),
                           rule("entity_date", "date_shift", "ent", jitter_days=10, group_by="o_custkey"),
                           *keep("o_orderkey", "o_custkey")], SECRET, "orders")


@query("mask_preserve_values", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '9999-12-31' ELSE
 strftime(o_orderdate::DATE + {_shift_sql(mask_hmac(DAY, 'date_shift', 'dates'), -30, 30)}, '%Y-%m-%d') END AS d,
 o_orderkey % 11 = 0 AS preserved FROM orders""")
def _(t):
    d = F.when(F.col("o_orderkey") % 11 == 0, F.lit("9999-12-31")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = t.orders.select("o_orderkey", d.alias("d"), (F.lit("9999-12-31") == d).alias("preserved"))
    return mask_table(df, [rule("d", "date_shift", "dates", min_days=-30, max_days=30, date_format="%Y-%m-%d",
                                preserve_values=["9999-12-31"]), *keep("o_orderkey", "preserved")], SECRET, "orders")


@query("mask_truncate", "SELECT doc_id, substr(text, 1, 3) AS text FROM documents")
def _(t):
    return mask_table(t.documents.select("doc_id", "text"), [rule("text", "truncate", length=3), *keep("doc_id")], SECRET, "documents")


@query("mask_bucketize", """SELECT p_partkey, (floor(p_retailprice / 50) * 50)::BIGINT::VARCHAR || '-' ||
 (floor(p_retailprice / 50) * 50 + 50)::BIGINT::VARCHAR AS p_retailprice FROM part""")
def _(t):
    return mask_table(t.part.select("p_partkey", "p_retailprice"), [rule("p_retailprice", "bucketize", width=50), *keep("p_partkey")],
                      SECRET, "part")


_EPOCH_DAY = "date_diff('day', DATE '1970-01-01', o_orderdate::DATE)"


@query("mask_bucket_perturb", f"""SELECT o_orderkey, round(floor(o_custkey / 100.0) * 100 + {unit(mask_hmac('o_custkey::VARCHAR',
 'bucket_perturb', 'cust'))} * 100, 6) AS o_custkey, strftime(DATE '1970-01-01' + (floor({_EPOCH_DAY} / 30.0) * 30 +
 floor({unit(mask_hmac(DAY, 'bucket_perturb', 'dates'))} * 30))::INT, '%Y-%m-%d') AS o_orderdate FROM orders""")
def _(t):
    df = t.orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    return mask_table(df, [rule("o_custkey", "bucket_perturb", "cust", width=100),
                           rule("o_orderdate", "bucket_perturb", "dates", bucket_days=30, date_format="%Y-%m-%d"),
                           *keep("o_orderkey")], SECRET, "orders").withColumn("o_custkey", F.round("o_custkey", 6))


@query("mask_top_code", """SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0)::DOUBLE AS c_acctbal, round(least(bal, (SELECT quantile_cont(c_acctbal, 0.95)
 FROM customer)), 6) AS bal FROM (SELECT *, c_acctbal AS bal FROM customer)""")
def _(t):
    df = t.customer.select("c_custkey", "c_acctbal", F.col("c_acctbal").alias("bal"))
    out = customers(t, rule("c_acctbal", "top_code", threshold=5000.0, floor=0.0), rule("bal", "top_code", quantile=0.95), df=df)
    return out.withColumn("bal", F.round("bal", 6))


@query("mask_shuffle", f"""WITH i AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer WHERE c_custkey % 9 <> 0),
 p AS (SELECT c_custkey, {sql_permute(subkey(SECRET, 'shuffle', 'bal'), 'i', 'n')} AS i FROM (SELECT *, count(*) OVER () AS n FROM i))
 SELECT c.c_custkey, i.c_acctbal FROM customer c LEFT JOIN p USING (c_custkey) LEFT JOIN i ON p.i = i.i""")
def _(t):
    df = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")))
    return customers(t, rule("c_acctbal", "shuffle", "bal", deterministic=True), df=df)


@query("mask_shuffle_null_key", f"""WITH s AS (SELECT CASE WHEN c_custkey <> 5 THEN c_custkey END AS c_custkey, c_acctbal FROM customer),
 i AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey NULLS FIRST) - 1 AS i FROM s),
 p AS (SELECT c_custkey, {sql_permute(subkey(SECRET, 'shuffle', 'bal'), 'i', 'n')} AS i FROM (SELECT *, count(*) OVER () AS n FROM i))
 SELECT s.c_custkey, i.c_acctbal FROM s LEFT JOIN p ON p.c_custkey IS NOT DISTINCT FROM s.c_custkey LEFT JOIN i ON p.i = i.i""")
def _(t):
    """The row without a key takes part like any other: no cell is lost."""
    df = t.customer.select(F.when(F.col("c_custkey") != 5, F.col("c_custkey")).alias("c_custkey"), "c_acctbal")
    return mask_table(df, [rule("c_acctbal", "shuffle", "bal", deterministic=True), *keep("c_custkey")], SECRET, "customer", ["c_custkey"])


TIERS, TIER_W = ["None", "Silver", "Gold"], [0.6, 0.3, 0.1]


@query("mask_categorical", f"""SELECT c_custkey, {weighted(unit(mask_hmac('c_name', 'categorical', 'customer.c_name')), TIERS, TIER_W)} AS c_name FROM customer""")
def _(t):
    return customers(t, rule("c_name", "categorical", categories=TIERS, weights=TIER_W))


# zips are made of the nation and the account balance, so groups differ in size
_ZIP = "lpad((c_nationkey * 1000 + (floor(abs(c_acctbal) / 1500))::INT * 7)::VARCHAR, 5, '0')"


def with_zip(t: Tables):
    z = F.lpad((F.col("c_nationkey") * 1000 + F.floor(F.abs(F.col("c_acctbal")) / 1500).cast("int") * 7).cast("string"), 5, "0")
    return t.customer.select("c_custkey", z.alias("zip"))


@query("mask_geo_generalize", f"""WITH z AS (SELECT c_custkey, {_ZIP} AS zip FROM customer),
 n5 AS (SELECT zip, count(*) AS n FROM z GROUP BY 1), n3 AS (SELECT substr(zip, 1, 3) AS zip3, count(*) AS n FROM z GROUP BY 1),
 ns AS (SELECT substr(zip, 1, 2) AS st, count(*) AS n FROM z GROUP BY 1)
 SELECT c_custkey, CASE WHEN n5.n >= 12 THEN zip WHEN n3.n >= 60 AND n3.n >= 12 THEN zip3 WHEN n3.n >= 12 THEN zip3
 WHEN ns.n >= 12 THEN 'S' || st END AS zip FROM z JOIN n5 USING (zip) JOIN n3 ON n3.zip3 = substr(zip, 1, 3) JOIN ns ON ns.st = substr(zip, 1, 2)""")
def _(t):
    df = with_zip(t)
    states = df.select(F.substring("zip", 1, 3).alias("zip3")).distinct().withColumn(
        "state", F.concat(F.lit("S"), F.substring("zip3", 1, 2)))
    return customers(t, rule("zip", "geo_generalize", type="zip", cascade=["zip5", "zip3", "state", "suppress"],
                             k_threshold=12, states=states), df=df)


# codes are type-size pairs of the part table, the type is the chapter; every fifth row holds a code of no set
_CODE = "p_type || '-' || p_size::VARCHAR"


@query("mask_code_set", f"""WITH s AS (SELECT DISTINCT {_CODE} AS code, p_type AS chapter FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY code) - 1 AS r, count(*) OVER (PARTITION BY chapter) AS n FROM s),
 w AS (SELECT code AS old, chapter, CASE WHEN n > 1 THEN (r + 1 + {pick(mask_hmac('code', 'code_set', 'part.code'), '(n - 1)')}) % n ELSE r END AS r FROM r)
 SELECT p_partkey, r.code FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE {_CODE} END AS code FROM part) p
 LEFT JOIN w ON w.old = p.code LEFT JOIN r ON r.chapter = w.chapter AND r.r = w.r""")
def _(t):
    code = F.concat("p_type", F.lit("-"), F.col("p_size").cast("string"))
    codes = t.part.select(code.alias("code"), F.col("p_type").alias("chapter"))
    df = t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.lit("none")).otherwise(code).alias("code"))
    return mask_table(df, [rule("code", "code_set", codes=codes, chapter_preserve=True), *keep("p_partkey")], SECRET, "part")


def _redact_sql(text: str, ids=("url", "email", "uuid", "ssn", "us_phone", "mrn", "ipv4", "icd10")) -> str:
    for d in SPANS:
        if d.id in ids:
            text = f"regexp_replace({text}, {O.q(d.span)}, {O.q(d.token)}, 'g')"
    return text


PLAIN_SPANS = ("url", "email", "uuid", "ssn", "us_phone", "mrn", "ipv4", "icd10")


@query("mask_text_redact", f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")
def _(t):
    return mask_table(t.documents.select("doc_id", "text"), [rule("text", "text_redact", detectors=list(PLAIN_SPANS)), *keep("doc_id")],
                      SECRET, "documents")


_CARD = O.q(BY_ID["pan"].span)
_CARD_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
_CARD_OK = (f"length({_CARD_DIGITS}) BETWEEN 12 AND 19 AND {O.luhn_digit(f'substr({_CARD_DIGITS}, 1, length({_CARD_DIGITS}) - 1)')}"
            f" = right({_CARD_DIGITS}, 1)")


@query("mask_text_redact_checksum", f"""SELECT doc_id, array_to_string(flatten(list_transform(list_zip(regexp_split_to_array(text, {_CARD}),
 list_transform(regexp_extract_all(text, {_CARD}), lambda s: CASE WHEN {_CARD_OK} THEN '[CARD]' ELSE s END)),
 lambda z: [z[1], coalesce(z[2], '')])), '') AS text FROM documents""")
def _(t):
    return mask_table(t.documents.select("doc_id", "text"), [rule("text", "text_redact", detectors=["pan"]), *keep("doc_id")], SECRET, "documents")


_MIX = "|".join(f"(?:{d.span})" for d in SPANS if d.id in ("email", "us_phone", "ipv4"))
_TKEY = subkey(SECRET, "text_mask", "documents.text")
_FAKE_EMAIL = O.PROVIDER_SQL["person_email"](pick(O.sql_hmac(_TKEY, "s"), PROVIDERS["person_email"].size))
_FAKE_PHONE = O.PROVIDER_SQL["person_phone"](pick(O.sql_hmac(_TKEY, "s"), PROVIDERS["person_phone"].size))


@query("mask_text_mask", f"""SELECT doc_id, array_to_string(flatten(list_transform(list_zip(regexp_split_to_array(text, {O.q(_MIX)}),
 list_transform(regexp_extract_all(text, {O.q(_MIX)}), lambda s: CASE WHEN regexp_full_match(s, {O.q(BY_ID['email'].span)}) THEN {_FAKE_EMAIL}
 WHEN regexp_full_match(s, {O.q(BY_ID['us_phone'].span)}) THEN {_FAKE_PHONE} ELSE '[IP]' END)),
 lambda z: [z[1], coalesce(z[2], '')])), '') AS text FROM documents""")
def _(t):
    return mask_table(t.documents.select("doc_id", "text"), [
        rule("text", "text_mask", detectors={"email": "fake", "us_phone": "fake", "ipv4": "redact"}), *keep("doc_id")], SECRET, "documents")


# a note with a span of every kind for each customer; every third account number fails its check digits
_IBANS = ("GB82WEST12345698765432", "DE89370400440532013000", "GB83WEST12345698765432")


def _notes(t: Tables):
    k = F.col("c_custkey").cast("string")
    pad = lambda n: F.lpad(k, n, "0")
    iban = F.element_at(F.array(*[F.lit(x) for x in _IBANS]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return spread(t.customer.select("c_custkey")).select("c_custkey", F.concat(
        F.lit("c"), k, F.lit(" wrote to https://shop.example.com/a?id="), k, F.lit(" and mail u"), k, F.lit("@example.com id 123e4567-e89b-12d3-a456-"), pad(12), F.lit(" iban "), iban,
        F.lit(" card 4111 1111 1111 1111 ssn 123-45-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit(" call (555) 123-"),
        F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit(" MRN-"), pad(8), F.lit(" host 10."), (F.col("c_custkey") % 256).cast("string"),
        F.lit(".0.7 code J45."), (F.col("c_custkey") % 10).cast("string"), F.lit(" end")).alias("note"))


@query("mask_text_redact_kinds", f"""SELECT c_custkey, 'c' || c_custkey || ' wrote to [URL] and mail [EMAIL] id [UUID] iban ' || CASE WHEN c_custkey % 3 = 2 THEN '{_IBANS[2]}' ELSE '[IBAN]' END
 || ' card [CARD] ssn [SSN] call [PHONE] [MRN] host [IP] code [ICD10] end' AS note FROM customer""")
def _(t):
    return mask_table(_notes(t), [rule("note", "text_redact"), *keep("c_custkey")], SECRET, "customer")


# all four strategies and the unmatched policy; what was faked or encrypted is still of its kind, and not what it was
@query("mask_text_mask_kinds", """SELECT c_custkey, '[TEXT] [TEXT] [TEXT] [URL] [TEXT] [TEXT] [EMAIL] [TEXT] 123e4567-e89b-12d3-a456-' || lpad(c_custkey::VARCHAR, 12, '0') || ' [TEXT] '
 || CASE WHEN c_custkey % 3 = 2 THEN '[TEXT]' ELSE '[IBAN]' END || ' [TEXT] [CARD] [TEXT] [SSN] [TEXT] (555) 123-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' [MRN] [TEXT] [IP] [TEXT] J45.'
 || (c_custkey % 10) || ' [TEXT]' AS note, false AS survived FROM customer""")
def _(t):
    src = _notes(t)
    how = {"url": "redact", "email": "fake", "uuid": "passthrough", "iban": "redact", "pan": "fpe", "ssn": "fpe", "us_phone": "passthrough", "mrn": "fake", "ipv4": "redact", "icd10": "passthrough"}
    out = mask_table(src, [rule("note", "text_mask", detectors=how, unmatched="redact"), *keep("c_custkey")], SECRET, "customer")
    kinds = ["email", "pan", "ssn", "mrn"]
    both = out.join(src.withColumnRenamed("note", "was"), "c_custkey")
    old = F.transform(find_entities(F.col("was"), kinds), lambda e: e["span"])
    return both.select("c_custkey", redact_text(F.col("note"), kinds).alias("note"), F.exists(old, lambda x: F.contains(F.col("note"), x)).alias("survived"))


# FF1 and back: no SQL here has its cipher, so the query says what came back and whether the mask kept the form
@query("mask_fpe_ff1", """SELECT c_custkey, '+' || substr(p, 1, 2) || ' ' || substr(p, 3) AS back, true AS same_form, false AS same_text
 FROM (SELECT c_custkey, lpad((c_custkey * 7 + 1000000000)::VARCHAR, 12, '0') AS p FROM customer)""")
def _(t):
    rules = [rule("c_phone", "fpe", "phones", method="ff1", tweak="customer"), *keep("c_custkey")]
    p = F.lpad((F.col("c_custkey") * 7 + 10**9).cast("string"), 12, "0")
    src = spread(t.customer.select("c_custkey")).select("c_custkey", F.concat(F.lit("+"), F.substring(p, 1, 2), F.lit(" "), F.substring(p, 3, 10)).alias("c_phone"))
    out = mask_table(src, rules, SECRET, "customer")
    form = lambda c: F.regexp_replace(c, "[0-9]", "9")
    back = M.unmask_fpe(out, rules, SECRET, "customer").select("c_custkey", F.col("c_phone").alias("back"))
    both = out.join(back, "c_custkey")
    return both.select("c_custkey", "back", (form("c_phone") == form("back")).alias("same_form"), (F.col("c_phone") == F.col("back")).alias("same_text"))


@query("mask_joint", f"""WITH d AS (SELECT DISTINCT p_brand, p_type FROM part), i AS (SELECT *, row_number() OVER (ORDER BY p_brand, p_type) - 1 AS i FROM d)
 SELECT p_partkey, i.p_brand, i.p_type FROM (SELECT p_partkey, {pick(row_hmac('p_partkey::VARCHAR', 'joint', 'part', 'p_brand+p_type'), '(SELECT count(*) FROM d)')} AS i
 FROM part) p JOIN i USING (i)""")
def _(t):
    return mask_table(t.part.select("p_partkey", "p_brand", "p_type"), [rule(("p_brand", "p_type"), "joint_mask"), *keep("p_partkey")],
                      SECRET, "part", ["p_partkey"])


@query("mask_joint_matched", f"""WITH d AS (SELECT DISTINCT p_type, p_brand, p_size FROM part),
 i AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_size) - 1 AS i, count(*) OVER (PARTITION BY p_type) AS n FROM d)
 SELECT p_partkey, p.p_type, i.p_brand, i.p_size FROM part p JOIN (SELECT DISTINCT p_type, n FROM i) s USING (p_type)
 JOIN i ON i.p_type = p.p_type AND i.i = {pick(row_hmac('p_partkey::VARCHAR', 'joint', 'part', 'p_brand+p_size'), 's.n')}""")
def _(t):
    return mask_table(t.part.select("p_partkey", "p_type", "p_brand", "p_size"), [
        rule(("p_brand", "p_size"), "joint_mask", match_on="p_type"), *keep("p_partkey", "p_type")], SECRET, "part", ["p_partkey"])


_CH = mask_hmac(sql_row_message("first_name", "last_name", "email"), "composite", "people")
_CI = pick(_CH, COMPOSITES["composite_name_email"][0])


@query("mask_composite", f"""WITH c AS (SELECT c_custkey, c_name AS first_name, c_mktsegment AS last_name, c_name || '@x' AS email FROM customer),
 i AS (SELECT c_custkey, {_CI} AS i FROM c)
 SELECT c_custkey, {O.PROVIDER_SQL['person_first_name']('i')} AS first_name, {O.item(O.P.LAST, f'(i // {len(O.P.FIRST)})')} AS last_name,
 {O.PROVIDER_SQL['person_email']('i')} AS email FROM i""")
def _(t):
    df = t.customer.select("c_custkey", F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"),
                           F.concat("c_name", F.lit("@x")).alias("email"))
    return customers(t, rule(("first_name", "last_name", "email"), "composite", "people", deterministic=True,
                             provider="composite_name_email"), df=df)


@query("mask_formula", "SELECT c_custkey, c_mktsegment || '-' || lpad(c_custkey::VARCHAR, 8, '0') AS c_name, c_mktsegment FROM customer")
def _(t):
    return customers(t, rule("c_name", "formula", expression=X.concat(X.col("c_mktsegment"), "-", X.zfill(X.text(X.col("c_custkey")), 8))),
                     also=("c_mktsegment",))


@query("mask_derived", """SELECT c_custkey, c_acctbal, CASE WHEN least(c_acctbal, 5000.0) * 2 BETWEEN 0 AND 9000 THEN
 round(least(c_acctbal, 5000.0) * 2, 6) ELSE -1 END AS twice FROM (SELECT c_custkey, least(c_acctbal, 5000.0)::DOUBLE AS c_acctbal FROM customer)""")
def _(t):
    return customers(t, rule("c_acctbal", "top_code", threshold=5000.0), rule(
        "twice", "derived", expression=F.round(X.mul(X.col("c_acctbal"), 2), 6), bounds=(0, 9000), null_propagation=False, default=-1))


@query("mask_derived_aggregate", """SELECT c_custkey, c_acctbal, (SELECT max(c_acctbal) FROM customer) AS top,
 (SELECT count(c_acctbal) FROM customer) AS n FROM customer""")
def _(t):
    return customers(t, rule("top", "derived_aggregate", op="max", of="c_acctbal"), rule("n", "derived_aggregate", op="count", of="c_acctbal"),
                     also=("c_acctbal",))


@query("mask_group_key", f"""SELECT l_orderkey, l_linenumber, 'K' || substr({mask_hmac(sql_row_message("l_orderkey", "l_returnflag"), 'group_key', 'lineitem.gk')}, 1, 12) AS gk
 FROM lineitem""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return mask_table(df, [rule("gk", "group_key", group_by=["l_orderkey", "l_returnflag"], length=12, prefix="K"), *keep("l_orderkey", "l_linenumber")],
                      SECRET, "lineitem", unconfigured="warn")


# cells that hold the signs a joined text would use: "a|b", "c" and "a", "b|c", and nulls beside their written form
_SEP_A = "CASE o_orderkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a' WHEN 2 THEN NULL ELSE '-' END"
_SEP_B = "CASE o_orderkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'b|c' WHEN 2 THEN '1:a' ELSE NULL END"


@query("mask_group_key_separators", f"""SELECT o_orderkey, substr({mask_hmac(sql_row_message(_SEP_A, _SEP_B), 'group_key', 'orders.gk')}, 1, 16) AS gk FROM orders""")
def _(t):
    df = t.orders.select("o_orderkey", F.expr(_SEP_A).alias("a"), F.expr(_SEP_B).alias("b"))
    return mask_table(df, [rule("gk", "group_key", group_by=["a", "b"]), *keep("o_orderkey")], SECRET, "orders", unconfigured="warn")


_WALK = O.sql_hmac(subkey(SECRET, "walk", "events", "walk"), sql_row_message("user_id", "event_id"))


@query("mask_grouped_series", f"""SELECT event_id, user_id, 100 + 5 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS n,
 (1000 + sum(floor({unit(_WALK)} * 11)) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS walk FROM events""")
def _(t):
    df = t.events.select("event_id", "user_id")
    return mask_table(df, [rule("n", "grouped_series", group_by="user_id", order_by="event_id", start=100, step=5),
                           rule("walk", "grouped_series", group_by="user_id", order_by="event_id", generator="monotone_walk", start=1000, max_step=10),
                           *keep("event_id", "user_id")], SECRET, "events", ["event_id"])


@query("mask_windowed_date", f"""SELECT l_orderkey, o_orderdate::DATE AS o_orderdate, o_orderdate::DATE + (5 + least(floor({unit(row_hmac('l_orderkey::VARCHAR',
 'windowed_date', 'orders', 'due'))} * 26), 25))::INT AS due, o_orderdate::DATE + least(floor((1.0 - sqrt(1.0 - {unit(row_hmac('l_orderkey::VARCHAR',
 'windowed_date', 'orders', 'soon'))})) * 31), 30)::INT AS soon FROM (SELECT o_orderkey AS l_orderkey, o_orderdate FROM orders)""")
def _(t):
    df = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("o_orderdate"),
                         F.col("o_orderdate").alias("due"), F.col("o_orderdate").alias("soon"))
    return mask_table(df, [rule("due", "windowed_date", anchor="o_orderdate", min_days=5, max_days=30),
                           rule("soon", "windowed_date", anchor="o_orderdate", max_days=30, distribution="linear_decay"),
                           *keep("l_orderkey", "o_orderdate")], SECRET, "orders", ["l_orderkey"])


@query("mask_nested", f"""SELECT event_id, '{{"k":"' || substr({mask_hmac("json_extract_string(props, '$.k')", 'hash', 'k')}, 1, 32) || '"}}' AS props FROM events""")
def _(t):
    df = t.events.select("event_id", "props")
    return mask_table(df, [rule("props", "nested", schema="k STRING", fields={"k": rule("k", "hash", "k")}), *keep("event_id")], SECRET, "events")


@query("mask_from_parent", f"""SELECT o_orderkey, substr({mask_hmac('o_custkey::VARCHAR', 'hash', 'customer_identity')}, 1, 32) AS o_custkey FROM orders""")
def _(t):
    from ..operators.relations import Link, child_rules
    parent = [rule("c_custkey", "hash", "customer_identity"), *keep("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]
    df = t.orders.select("o_orderkey", "o_custkey")
    rules = child_rules(Link("customer", ("c_custkey",), "orders", ("o_custkey",), "preserve"), parent)
    return mask_table(df, [*rules, *keep("o_orderkey")], SECRET, "orders")


PRESET_DF_SQL = f"""SELECT c_custkey, {_ZIP} AS zip, c_name AS first_name, strftime(DATE '1960-01-01' + (c_custkey % 9000)::INT, '%Y-%m-%d') AS dob,
 lpad((c_custkey + 100000000)::VARCHAR, 9, '0') AS ssn, 'u' || c_custkey::VARCHAR AS url FROM customer"""


def patients(t: Tables):
    k = F.col("c_custkey")
    return with_zip(t).join(t.customer.select(
        "c_custkey", F.col("c_name").alias("first_name"),
        F.date_format(F.date_add(F.lit("1960-01-01").cast("date"), (k % 9000).cast("int")), "yyyy-MM-dd").alias("dob"),
        F.lpad((k + 100000000).cast("string"), 9, "0").alias("ssn"), F.concat(F.lit("u"), k.cast("string")).alias("url")), "c_custkey")


@query("mask_preset", f"""WITH p AS ({PRESET_DF_SQL}) SELECT c_custkey, {O.provider('person_first_name', row_hmac(CUST, 'faker', 'patients', 'first_name'))} AS first_name,
 strftime(dob::DATE + {_shift_sql(mask_hmac('dob', 'date_shift', 'patient_dates'), -30, 30)}, '%Y-%m-%d') AS dob,
 {fpe_digits_sql('ssn', 'ssn_identity', 9)} AS ssn, 'REDACTED' AS url, NULL::VARCHAR AS zip FROM p""")
def _(t):
    from ..operators.presets import preset_rules
    df = patients(t)
    return mask_table(df, preset_rules("hipaa", df.columns, keep=("c_custkey",)), SECRET, "patients", ["c_custkey"])


@query("policy_rules", f"""WITH p AS ({PRESET_DF_SQL}) SELECT c_custkey, substr(zip, 1, 3) AS zip, {O.provider('person_first_name', row_hmac(CUST, 'faker', 'patients', 'first_name'))} AS first_name,
 'REDACTED' AS dob, 'REDACTED' AS ssn, 'REDACTED' AS url FROM p""")
def _(t):
    from ..operators.presets import Policy, resolve_policy
    df = patients(t)
    classes = {"first_name": "person_name", "dob": "iso_date", "ssn": "ssn", "url": "url", "zip": "us_zip"}
    policy = (Policy(default="redact").match("classification", "person_name", rule("*", "faker", provider="person_first_name"))
              .match("column", "c_custkey", rule("*", "passthrough")).match("classification", "us_zip", rule("*", "truncate", length=3))
              .forbid("passthrough", "classification", "ssn"))
    return mask_table(df, resolve_policy(policy, "patients", df.schema, classes), SECRET, "patients", ["c_custkey"])


@query("mask_casting", "SELECT o_orderkey, substr(o_orderkey::VARCHAR, 1, 2)::BIGINT AS cut, floor(o_totalprice / 1000)::BIGINT AS o_totalprice FROM (SELECT *, o_orderkey AS cut FROM orders)")
def _(t):
    df = t.orders.select("o_orderkey", F.col("o_orderkey").alias("cut"), "o_totalprice")
    return mask_table(df, [rule("cut", "truncate", length=2, cast="bigint"), rule(
        "o_totalprice", "formula", expression=F.floor(F.col("o_totalprice") / 1000), cast="bigint"), *keep("o_orderkey")], SECRET, "orders")


@query("mask_unique_faker", f"""SELECT c_custkey, {O.PROVIDER_SQL['person_email']('p')} AS c_name FROM (SELECT c_custkey, {sql_permute(subkey(SECRET, 'unique', 'customer.c_name'), 'i',
 str(PROVIDERS['person_email'].size))} AS p FROM (SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS i FROM customer))""")
def _(t):
    return customers(t, rule("c_name", "unique_faker", provider="person_email"))


_NAMES = PROVIDERS["person_email"].size
_PIDX = sorted(O.PROVIDER_SQL)


@query("provider_values", "SELECT c_custkey, " + ", ".join(f"{O.PROVIDER_SQL[p](f'((c_custkey * 7919) % {PROVIDERS[p].size})')} AS {p}" for p in _PIDX) + " FROM customer")
def _(t):
    i = F.col("c_custkey") * 7919
    return t.customer.select("c_custkey", *[PROVIDERS[p].at(i % F.lit(PROVIDERS[p].size).cast("bigint")).alias(p) for p in _PIDX])


@query("conditional_mask", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal >= 100 THEN 'REDACTED' ELSE c_name END AS c_name, c_mktsegment, c_acctbal FROM customer""")
def _(t):
    return customers(t, rule("c_name", "redact", when=X.and_(X.eq(X.col("c_mktsegment"), "BUILDING"), X.ge(X.col("c_acctbal"), 100))),
                     also=("c_mktsegment", "c_acctbal"))


@query("masked_projection", f"""SELECT substr({mask_hmac(CUST, 'hash', 'customer_identity')}, 1, 32) AS c_custkey, 'REDACTED' AS c_name, c_nationkey,
 (floor(c_acctbal / 1000) * 1000)::BIGINT::VARCHAR || '-' || (floor(c_acctbal / 1000) * 1000 + 1000)::BIGINT::VARCHAR AS c_acctbal,
 {weighted(unit(mask_hmac('c_mktsegment', 'categorical', 'customer.c_mktsegment')), TIERS, TIER_W)} AS c_mktsegment FROM customer""")
def _(t):
    return mask_table(t.customer, [
        rule("c_custkey", "hash", "customer_identity"), rule("c_name", "redact"), rule("c_acctbal", "bucketize", width=1000),
        rule("c_mktsegment", "categorical", categories=TIERS, weights=TIER_W), *keep("c_nationkey")], SECRET, "customer")
