"""Sources, sinks, shaping and expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import shape as S
from ..operators.masks import keep, mask_table, rule
from ..session import scratch_dir
from ..sources import readers as R
from ..sources import writers as W
from .oracle_text import mask_hmac
from .registry import SECRET, Tables, query


def _scratch(t: Tables, label: str) -> str:
    return f"{scratch_dir(t.spark)}/tablecloak/{label}-{uuid.uuid4().hex}"


@query("read_csv", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part")
def _(t):
    p = _scratch(t, "csv")
    t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size").write.option("sep", "|").csv(p)
    return R.read_csv(t.spark, p, has_header=False, column_names=["p_partkey", "p_name", "p_brand", "p_type", "p_size"], delimiter="|")


@query("read_parquet", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    n = R.read_parquet(t.spark, f"{t.sf_dir}/nation.parquet", ["n_nationkey", "n_name", "n_regionkey"])
    r = R.read_parquet(t.spark, f"{t.sf_dir}/region.parquet", ["r_regionkey", "r_name"])
    return n.join(r, n.n_regionkey == r.r_regionkey)


LAYOUT = [R.Field("c_custkey", 0, 12, "int"), R.Field("c_name", 14, 30), R.Field("c_mktsegment", 44, 12)]


@query("read_fixed_width", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    p = _scratch(t, "fixed")
    t.customer.select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, " "), F.lit("  "), F.rpad("c_name", 30, " "),
                               F.when(F.col("c_custkey") % 5 != 0, F.rpad("c_mktsegment", 12, " ")).otherwise(F.lit(" ")))).write.text(p)
    return R.read_fixed_width(t.spark, p, LAYOUT)


@query("read_object_store", "SELECT * FROM supplier")
def _(t):
    return R.read_object_store(t.spark, "file", "", f"{t.sf_dir}/supplier.parquet")


@query("check_declared_schema", "SELECT r_regionkey, r_name FROM region")
def _(t):
    R.check_declared_schema(t.region, ["r_name", "r_regionkey"])
    return t.region


@query("write_csv", """SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey::VARCHAR END AS o_custkey, o_orderstatus FROM orders""")
def _(t):
    p = _scratch(t, "csv")
    W.write_csv(t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
                                "o_orderstatus"), p, compression="gz")
    return R.read_csv(t.spark, p, has_header=True)


@query("write_parquet", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def _(t):
    p = _scratch(t, "parquet")
    W.write_parquet(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), p, rows_per_file=100_000)
    return R.read_parquet(t.spark, p, ["o_orderkey", "o_custkey", "o_orderdate"])


@query("write_fixed_width", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(t):
    p = _scratch(t, "fixed")
    W.write_fixed_width(t.customer.select(F.col("c_custkey").cast("double").alias("c_custkey"), "c_name", "c_mktsegment"), p, LAYOUT)
    return R.read_fixed_width(t.spark, p, LAYOUT)


@query("publish_outputs", "SELECT c_custkey, c_name FROM customer")
def _(t):
    p = _scratch(t, "publish")
    frames = {"a": t.customer.select("c_custkey", "c_name")}
    W.publish_outputs(t.spark, frames, {"a": p})
    W.publish_outputs(t.spark, frames, {"a": p})  # replaces the first
    return t.spark.read.parquet(p)


@query("read_chunked", f"""SELECT l_linenumber, l_quantity, substr({mask_hmac('l_orderkey::VARCHAR', 'hash', 'order_identity')}, 1, 32) AS l_orderkey FROM lineitem""")
def _(t):
    # chunks are partitions: the masked bytes do not depend on how the rows are cut
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").repartition(13)
    return mask_table(df, [rule("l_orderkey", "hash", "order_identity"), *keep("l_linenumber", "l_quantity")], SECRET, "lineitem")


# blanks: every fourth segment is null
_SEG = "CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END"


def gappy(t: Tables):
    return t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))


@query("filter_rows", f"SELECT * FROM (SELECT c_custkey, c_name, c_acctbal, {_SEG} AS c_mktsegment FROM customer) WHERE c_mktsegment IS DISTINCT FROM 'BUILDING' AND c_acctbal >= 18")
def _(t):
    return S.shape(gappy(t).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), [
        S.filter_rows(X.and_(X.ne(X.col("c_mktsegment"), "BUILDING"), X.ge(X.col("c_acctbal"), 18)))])


@query("derive_column", "SELECT n_nationkey, n_name, n_name || ' ' || n_regionkey::VARCHAR AS full_name FROM nation")
def _(t):
    return S.shape(t.nation, [S.derive_column("full_name", X.concat(X.col("n_name"), " ", X.text(X.col("n_regionkey")))), S.drop_columns("n_regionkey")])


@query("sort_rows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def _(t):
    return S.shape(t.customer.select("c_custkey", "c_acctbal"), [S.sort_rows("c_acctbal", "c_custkey", ascending=[False, True])])


@query("limit_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t):
    return S.shape(t.orders.select("o_orderkey", "o_totalprice"), [S.sort_rows("o_totalprice", "o_orderkey", ascending=[False, True]), S.limit_rows(100)])


@query("dedupe_rows", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def _(t):
    return S.shape(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), [
        S.dedupe_rows("l_orderkey", "l_linenumber", order_by=["l_partkey", "l_suppkey"])])


@query("dedupe_whole_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return S.shape(t.lineitem.select("l_orderkey", "l_linenumber"), [S.dedupe_rows()])


@query("drop_columns", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(t):
    return S.shape(t.supplier, [S.drop_columns("s_name", "s_acctbal")])


@query("expr_arith", """SELECT l_orderkey, l_linenumber, l_quantity, l_quantity + 1 - l_tax * 2 AS a, l_extendedprice / l_quantity AS b,
 floor(l_quantity / 7)::BIGINT AS c FROM lineitem""")
def _(t):
    q = X.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", X.sub(X.add(q, 1), X.mul(X.col("l_tax"), 2)).alias("a"),
                             X.div(X.col("l_extendedprice"), q).alias("b"), X.floor_div(q, 7).alias("c"))


@query("expr_compare", f"""SELECT c_custkey, c_mktsegment IS NULL AS blank, c_acctbal < 0 AS neg, c_acctbal <= 1000 AS le, c_acctbal > 5000 AS gt, c_nationkey >= 20 AS ge,
 coalesce(c_mktsegment = 'BUILDING', false) AS eq, coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) AS isin
 FROM (SELECT * REPLACE ({_SEG} AS c_mktsegment) FROM customer)""")
def _(t):
    s, b = X.col("c_mktsegment"), X.col("c_acctbal")
    return gappy(t).select("c_custkey", X.is_null(s).alias("blank"), X.lt(b, 0).alias("neg"), X.le(b, 1000).alias("le"), X.gt(b, 5000).alias("gt"),
                           X.ge(X.col("c_nationkey"), 20).alias("ge"), X.eq(s, "BUILDING").alias("eq"), X.is_in(s, ["BUILDING", "MACHINERY"]).alias("isin"))


@query("expr_logic", """SELECT c_custkey, (c_acctbal > 0 AND c_nationkey < 10) OR NOT c_mktsegment = 'BUILDING' AS a, NOT (c_nationkey IN (1, 2, 3)) AS b FROM customer""")
def _(t):
    return t.customer.select("c_custkey", X.or_(X.and_(X.gt(X.col("c_acctbal"), 0), X.lt(X.col("c_nationkey"), 10)),
                                                X.not_(X.eq(X.col("c_mktsegment"), "BUILDING"))).alias("a"),
                             X.not_(X.is_in(X.col("c_nationkey"), [1, 2, 3])).alias("b"))


@query("expr_concat", f"SELECT c_custkey, {_SEG} || '-' || c_custkey::VARCHAR AS label FROM customer")
def _(t):
    return gappy(t).select("c_custkey", X.concat(X.col("c_mktsegment"), "-", X.col("c_custkey")).alias("label"))


@query("expr_slice", "SELECT doc_id, substr(text, 1, 3) AS a, substr(text, 11, 20) AS b, length(text) AS n FROM documents")
def _(t):
    s = X.col("text")
    return t.documents.select("doc_id", X.slice_(s, 0, 3).alias("a"), X.slice_(s, 10, 30).alias("b"), X.length(s).alias("n"))


@query("expr_days_between", "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", X.days_between(X.col("o_orderdate"), X.col("l_shipdate")).alias("days"))


@query("expr_if", f"SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' ELSE 'other' END AS x FROM (SELECT * REPLACE ({_SEG} AS c_mktsegment) FROM customer)")
def _(t):
    return gappy(t).select("c_custkey", X.if_(X.eq(X.col("c_mktsegment"), "BUILDING"), "b", "other").alias("x"))


@query("expr_case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS x FROM part")
def _(t):
    z = X.col("p_size")
    return t.part.select("p_partkey", X.case_when((X.lt(z, 10), "S"), (X.lt(z, 30), "M"), default="L").alias("x"))


@query("expr_formula_text", """SELECT o_orderkey, 'ORD-' || o_orderkey::VARCHAR AS a, lpad(o_orderkey::VARCHAR, greatest(5, length(o_orderkey::VARCHAR))::INT, '0') AS b,
 right(o_orderkey::VARCHAR, 4) AS c, length(o_orderkey::VARCHAR) AS d, round_even(o_orderkey / 3.0, 0)::BIGINT AS e FROM orders""")
def _(t):
    k = X.text(X.col("o_orderkey"))
    return t.orders.select("o_orderkey", X.concat("ORD-", k).alias("a"), X.zfill(k, 5).alias("b"), X.last(k, 4).alias("c"), X.length(k).alias("d"),
                           X.round_(X.col("o_orderkey") / 3).cast("bigint").alias("e"))


@query("expr_number_as_text_refused", "SELECT count(*) AS n, true AS refused FROM orders")
def _(t):
    from ..errors import NumberUsedAsText
    try:
        X.check_text_operands(t.orders, "o_orderstatus", "o_orderkey")
        refused = False
    except NumberUsedAsText:
        refused = True
    return t.orders.agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("expr_blank_logic", f"""SELECT c_custkey, c_mktsegment IS DISTINCT FROM 'BUILDING' AS ne, NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) AS not_in,
 NOT coalesce(c_mktsegment = 'BUILDING', false) AS not_eq FROM (SELECT * REPLACE ({_SEG} AS c_mktsegment) FROM customer)""")
def _(t):
    s = X.col("c_mktsegment")
    return gappy(t).select("c_custkey", X.ne(s, "BUILDING").alias("ne"), X.not_in(s, ["BUILDING", "MACHINERY"]).alias("not_in"),
                           X.not_(X.eq(s, "BUILDING")).alias("not_eq"))
