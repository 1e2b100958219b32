"""Foreign keys, vaults and subsets over region .. lineitem."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..keys import seed_key, sql_hmac, sql_row_message, subkey
from ..operators import relations as REL
from ..operators import subset as SUB
from ..operators import vault as V
from ..operators.masks import keep, mask_table, rule
from ..operators.relations import Link
from ..session import scratch_dir
from .oracle_text import mask_hmac, pick, unit
from .queries_mask import fpe_digits_sql
from .registry import SECRET, SEED, Tables, query

H_CUST = f"substr({mask_hmac('c_custkey::VARCHAR', 'hash', 'customer_identity')}, 1, 32)"
H_OCUST = f"substr({mask_hmac('o_custkey::VARCHAR', 'hash', 'customer_identity')}, 1, 32)"
# parents: two of every ten customers are gone, so their orders are orphans
PARENT = "(SELECT * FROM customer WHERE c_custkey % 10 > 1)"
ORDER_LINK = Link("customer", ("c_custkey",), "orders", ("o_custkey",), "preserve", "customer_identity")


def thin(t: Tables):
    return t.customer.where(F.col("c_custkey") % 10 > 1)


def keymap(t: Tables):
    p = thin(t).select("c_custkey", "c_name")
    masked = mask_table(p.withColumn("k", F.col("c_custkey")), [rule("c_custkey", "hash", "customer_identity"), *keep("k", "c_name")], SECRET, "customer")
    return REL.key_map(p.withColumn("k", F.col("c_custkey")), masked, ["k"], ["c_custkey"])


def _propagated(t: Tables, policy: str, warnings=None):
    link = Link("customer", ("c_custkey",), "orders", ("o_custkey",), policy, "customer_identity")
    return REL.propagate(t.orders.select("o_orderkey", "o_custkey"), keymap(t), link, SECRET, warnings)


@query("fk_mask_propagate", f"""SELECT c.c_name, h AS o_custkey, count(*) AS n FROM (SELECT c_name, {H_CUST} AS h FROM customer) c JOIN
 (SELECT {H_OCUST} AS o FROM orders) o ON c.h = o.o GROUP BY 1, 2""")
def _(t):
    masked = REL.mask_linked(
        {"customer": t.customer, "orders": t.orders}, {"customer": [rule("c_custkey", "hash", "customer_identity"), *keep(
            "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")], "orders": keep(
            "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey")},
        [Link("customer", ("c_custkey",), "orders", ("o_custkey",), "fail", "customer_identity")], SECRET)
    c, o = masked["customer"], masked["orders"]
    return c.join(o, c.c_custkey == o.o_custkey).groupBy("c_name", "o_custkey").agg(F.count("*").alias("n"))


@query("fk_composite", """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
 m AS (SELECT l_orderkey, l_linenumber, 'R' || (l_orderkey * 10 + l_linenumber)::VARCHAR AS new_o, 'L' || l_linenumber::VARCHAR AS new_l FROM d)
 SELECT l.l_partkey, l.l_suppkey, l.l_quantity, new_o AS l_orderkey, new_l AS l_linenumber FROM lineitem l JOIN m USING (l_orderkey, l_linenumber)""")
def _(t):
    k = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    km = k.withColumn("__new_l_orderkey", F.concat(F.lit("R"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"))).withColumn(
        "__new_l_linenumber", F.concat(F.lit("L"), F.col("l_linenumber").cast("string")))
    link = Link("lines", ("l_orderkey", "l_linenumber"), "lineitem", ("l_orderkey", "l_linenumber"), "preserve", "lines")
    return REL.propagate(t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber"), km, link, SECRET)


@query("fk_orphans_preserve", f"SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL THEN o_custkey::VARCHAR ELSE {H_OCUST} END AS o_custkey FROM orders LEFT JOIN {PARENT} c ON o_custkey = c_custkey")
def _(t):
    return _propagated(t, "preserve")


@query("fk_orphans_remap", f"SELECT o_orderkey, {H_OCUST} AS o_custkey FROM orders")
def _(t):
    return _propagated(t, "remap")


@query("fk_orphans_remap_fpe", f"""SELECT o_orderkey, {fpe_digits_sql("lpad(o_custkey::VARCHAR, 9, '0')", 'cust', 9)} AS o_custkey FROM orders""")
def _(t):
    """An orphan is masked the way its parent's key would be, here format preserving."""
    nine = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    key = rule("c_custkey", "fpe", "cust", charset="digits")
    parent = thin(t).select(nine("c_custkey").alias("c_custkey"), nine("c_custkey").alias("k"))
    known = REL.key_map(parent, mask_table(parent, [key, *keep("k")], SECRET, "customer"), ["k"], ["c_custkey"])
    link = Link("customer", ("c_custkey",), "orders", ("o_custkey",), "remap", "cust")
    return REL.propagate(t.orders.select("o_orderkey", nine("o_custkey").alias("o_custkey")), known, link, SECRET, parent_rules={"c_custkey": key})


_REMAP = sql_hmac(subkey(SECRET, "remap", "customer_identity"), sql_row_message("o_custkey"))


@query("fk_orphans_remap_to_existing", f"""WITH p AS (SELECT c_custkey, {H_CUST} AS h FROM {PARENT}), i AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS i FROM p)
 SELECT o_orderkey, coalesce(p.h, i.h) AS o_custkey FROM orders LEFT JOIN p ON o_custkey = p.c_custkey
 LEFT JOIN i ON p.h IS NULL AND i.i = {pick(_REMAP, '(SELECT count(*) FROM i)')}""")
def _(t):
    return _propagated(t, "remap_to_existing")


@query("fk_orphans_warn", f"SELECT 'orders -> customer: ' || count(*)::VARCHAR || ' orphan keys kept' AS warning FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {PARENT})")
def _(t):
    notes: list[str] = []
    _propagated(t, "warn", notes)
    return t.spark.createDataFrame([(n,) for n in notes], "warning string")


@query("fk_orphans_fail", f"""SELECT o_custkey AS o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {PARENT}) GROUP BY 1""")
def _(t):
    from ..errors import OrphansFound
    link = Link("customer", ("c_custkey",), "orders", ("o_custkey",), "fail", "customer_identity")
    try:
        REL.propagate(t.orders.select("o_orderkey", "o_custkey"), keymap(t), link, SECRET)
    except OrphansFound:
        # the run stopped before any write; this is what it stopped for
        return REL.orphan_rows(thin(t), t.orders, link).groupBy("o_custkey").agg(F.count("*").alias("n"))
    raise AssertionError("orphans were not refused")


@query("fk_integrity_check", f"""SELECT 'customer->orders' AS edge, (SELECT count(*) FROM orders) AS source_checked,
 (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {PARENT})) AS source_orphans, (SELECT count(*) FROM orders) AS output_checked,
 (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {PARENT})) AS output_orphans""")
def _(t):
    parent = mask_table(thin(t).select("c_custkey"), [rule("c_custkey", "hash", "customer_identity")], SECRET, "customer")
    return REL.integrity_report([(ORDER_LINK, thin(t), t.orders, parent, _propagated(t, "preserve"))])


# ---- vault

_TOK = "'tok_' || substr({h}, 1, 32)"
_T_SEG = _TOK.format(h=mask_hmac("nfc_normalize(c_mktsegment)", "tokenize", "segment"))


def stored(t: Tables):
    """A vault that already knows one value under an older token."""
    return t.customer.where("c_mktsegment = 'BUILDING'").select(F.lit("segment").alias("ns"), F.col("c_mktsegment").alias("value"),
                                                               F.lit("tok_old").alias("token")).distinct()


@query("mask_tokenize", f"SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'tok_old' ELSE {_T_SEG} END AS c_mktsegment FROM customer")
def _(t):
    return V.tokenize(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "segment", SECRET, stored(t))[0]


@query("tokenize_text", f"SELECT doc_id, {_TOK.format(h=mask_hmac('nfc_normalize(text)', 'tokenize', 'text'))} AS text FROM documents")
def _(t):
    return V.tokenize(t.documents.select("doc_id", "text"), ["text"], "text", SECRET, V.empty_vault(t.spark))[0]


_TOK_KEY = lambda c: _TOK.format(h=mask_hmac(f"{c}::VARCHAR", 'tokenize', 'orders'))


@query("tokenize_keys", f"SELECT {_TOK_KEY('o_orderkey')} AS o_orderkey, o_custkey FROM orders")
def _(t):
    """As many values as rows."""
    return V.tokenize(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], "orders", SECRET, V.empty_vault(t.spark))[0]


@query("tokenize_two_columns", f"SELECT o_orderkey, {_TOK_KEY('o_orderstatus')} AS o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN {_TOK_KEY('o_orderpriority')} END AS o_orderpriority FROM orders")
def _(t):
    df = t.orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return V.tokenize(df, ["o_orderstatus", "o_orderpriority"], "orders", SECRET, V.empty_vault(t.spark))[0]


@query("detokenize", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t):
    out, vault = V.tokenize(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "segment", SECRET, stored(t))
    return V.detokenize(out, ["c_mktsegment"], "segment", vault)


@query("vault_join", f"SELECT value, token, count(*) AS n FROM (SELECT c_mktsegment AS value, CASE WHEN c_mktsegment = 'BUILDING' THEN 'tok_old' ELSE {_T_SEG} END AS token FROM customer) GROUP BY 1, 2")
def _(t):
    _, vault = V.tokenize(t.customer.select("c_mktsegment"), ["c_mktsegment"], "segment", SECRET, stored(t))
    from ..operators.joins import lookup_join
    rows = t.customer.select(F.lit("segment").alias("ns"), F.col("c_mktsegment").alias("value"))
    return lookup_join(rows, vault, ["ns", "value"], "inner").groupBy("value", "token").agg(F.count("*").alias("n"))


@query("vault_report", """WITH p AS (SELECT DISTINCT 'nation' AS ns, n_name AS value, (n_nationkey % 20)::VARCHAR AS token FROM nation UNION ALL
 SELECT DISTINCT 'cust', c_name, substr(c_name, 10) FROM customer), g AS (SELECT ns, token, count(DISTINCT value) AS n FROM p GROUP BY 1, 2)
 SELECT ns, count(*) FILTER (n = 1) AS entries, count(*) FILTER (n > 1) AS ambiguous FROM g GROUP BY 1""")
def _(t):
    a = t.nation.select(F.lit("nation").alias("ns"), F.col("n_name").alias("value"), (F.col("n_nationkey") % 20).cast("string").alias("token"))
    b = t.customer.select(F.lit("cust").alias("ns"), F.col("c_name").alias("value"), F.expr("substring(c_name, 10)").alias("token"))
    return V.vault_report(a.unionByName(b))


def _sealed(t: Tables):
    src = t.customer.select("c_custkey", "c_name")
    masked = mask_table(src, [rule("c_name", "hash", "cust_name", vault=True), *keep("c_custkey")], SECRET, "customer")
    return src, masked


@query("vault_write", "SELECT 'cust_name' AS ns, count(*) AS entries, 0 AS in_clear FROM customer")
def _(t):
    src, masked = _sealed(t)
    path = f"{scratch_dir(t.spark)}/tablecloak/vault-{uuid.uuid4().hex}"
    V.vault_write(src, masked, ["c_custkey"], ["c_name"], "cust_name", SECRET, path)
    back = t.spark.read.parquet(path)
    return back.groupBy("ns").agg(F.count("*").alias("entries"), F.count_if(F.col("sealed").contains("Customer")).alias("in_clear"))


@query("vault_read", "SELECT c_custkey, c_name, 'vault_reversed' AS c_name_status FROM customer")
def _(t):
    src, masked = _sealed(t)
    sealed = V.vault_write(src, masked, ["c_custkey"], ["c_name"], "cust_name", SECRET)
    return V.vault_read(masked, ["c_name"], "cust_name", SECRET, sealed)


# ---- subset

LINKS = (Link("region", ("r_regionkey",), "nation", ("n_regionkey",), "preserve"),
         Link("nation", ("n_nationkey",), "customer", ("c_nationkey",), "preserve"),
         Link("customer", ("c_custkey",), "orders", ("o_custkey",), "preserve"),
         Link("orders", ("o_orderkey",), "lineitem", ("l_orderkey",), "preserve"),
         Link("part", ("p_partkey",), "lineitem", ("l_partkey",), "preserve"),
         Link("supplier", ("s_suppkey",), "lineitem", ("l_suppkey",), "preserve"))
# dimension tables are only ever reached as parents
WAYS = {("region", "nation"): "upward", ("nation", "customer"): "upward", ("part", "lineitem"): "upward", ("supplier", "lineitem"): "upward"}
U_CUST = unit(sql_hmac(subkey(seed_key(SEED), "subset", "customer"), sql_row_message("c_custkey")))


def world(t: Tables, *names):
    return {n: getattr(t, n) for n in (names or ("region", "nation", "customer", "orders", "lineitem", "part", "supplier"))}


def sampled(fraction="0.05", **kw):
    return SUB.SubsetPlan((SUB.Seed("customer", "sample", ("c_custkey",), fraction=fraction),), LINKS, WAYS, seed=SEED, **kw)


@query("subset_seed_sample", f"SELECT c_custkey, c_name FROM customer WHERE {U_CUST} < 0.333::DOUBLE")
def _(t):
    return SUB.seed_rows(t.customer.select("c_custkey", "c_name"), SUB.Seed("customer", "sample", ("c_custkey",), fraction="0.333"), SEED)


@query("subset_seed_sample_count", f"SELECT c_custkey, c_name FROM customer ORDER BY {U_CUST}, c_custkey LIMIT 50")
def _(t):
    return SUB.seed_rows(t.customer.select("c_custkey", "c_name"), SUB.Seed("customer", "sample", ("c_custkey",), count=50), SEED)


@query("subset_seed_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('O', 'F') AND o_custkey IS NOT NULL AND o_orderpriority <> '5-LOW'")
def _(t):
    s = SUB.Seed("orders", "filter", where=(("o_totalprice", "gt", 100000), ("o_orderstatus", "in", ["O", "F"]), ("o_custkey", "is_not_null", None),
                                            ("o_orderpriority", "ne", "5-LOW")))
    return SUB.seed_rows(t.orders, s, SEED).select("o_orderkey", "o_totalprice")


@query("subset_seed_keys", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_orderkey = 3 AND l_linenumber = 2) OR (l_orderkey = 10 AND l_linenumber = 1) OR (l_orderkey = 7 AND l_linenumber = 4)")
def _(t):
    s = SUB.Seed("lineitem", "keys", ("l_orderkey", "l_linenumber"), keys=((3, 2), (10, 1), (7, 4)))
    return SUB.seed_rows(t.lineitem, s, SEED).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_S = f"(SELECT c_custkey FROM customer WHERE {U_CUST} < 0.05::DOUBLE)"


@query("subset_closure_down", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN {_S})")
def _(t):
    plan = SUB.SubsetPlan(sampled().seeds, LINKS[2:4], {("customer", "orders"): "downward", ("orders", "lineitem"): "downward"}, seed=SEED)
    return SUB.subset(world(t, "customer", "orders", "lineitem"), plan)["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("subset_closure_up", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    plan = SUB.SubsetPlan((SUB.Seed("orders", "filter", where=(("o_totalprice", "gt", 400000),)),), LINKS[2:3], {("customer", "orders"): "upward"}, seed=SEED)
    return SUB.subset(world(t, "customer", "orders"), plan)["customer"].select("c_custkey", "c_name")


@query("subset_edge_direction", f"""SELECT 'customer' AS tbl, count(*) AS n FROM {_S} UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN {_S}
 UNION ALL SELECT 'lineitem', 0 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN {_S})""")
def _(t):
    ways = {("customer", "orders"): "downward", ("orders", "lineitem"): "none", ("nation", "customer"): "upward"}
    out = SUB.subset(world(t, "nation", "customer", "orders", "lineitem"), SUB.SubsetPlan(sampled().seeds, LINKS[1:4], ways, seed=SEED))
    return _counts(out)


def _counts(out):
    df = None
    for name, f in out.items():
        row = f.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        df = row if df is None else df.unionByName(row)
    return df


_ORD = f"(SELECT o_orderkey FROM orders WHERE o_custkey IN {_S})"
_LINE = f"(SELECT * FROM lineitem WHERE l_orderkey IN {_ORD})"


@query("subset_closure_fixpoint", f"""SELECT 'customer' AS tbl, count(*) AS n FROM {_S} UNION ALL SELECT 'orders', count(*) FROM {_ORD} UNION ALL SELECT 'lineitem', count(*) FROM {_LINE}
 UNION ALL SELECT 'part', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM {_LINE}) UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM {_LINE})
 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN {_S})
 UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN {_S}))""")
def _(t):
    return _counts(SUB.subset(world(t), sampled()))


# a self reference: customer k reports to customer k // 3
_BOSS = "(SELECT c_custkey AS id, CASE WHEN c_custkey >= 3 THEN c_custkey // 3 END AS boss FROM customer)"


@query("subset_self_reference", f"""WITH RECURSIVE s AS {_BOSS}, up(id) AS (SELECT id FROM s WHERE id IN (1200, 77) UNION SELECT s.boss FROM up JOIN s USING (id) WHERE s.boss IS NOT NULL)
 SELECT id FROM up""")
def _(t):
    staff = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") >= 3, F.floor(F.col("c_custkey") / 3)).alias("boss"))
    plan = SUB.SubsetPlan((SUB.Seed("staff", "keys", ("id",), keys=(1200, 77)),), (Link("staff", ("id",), "staff", ("boss",), "preserve"),),
                          {("staff", "staff"): "upward"}, seed=SEED)
    return SUB.subset({"staff": staff}, plan)["staff"].select("id")


@query("subset_budget", f"SELECT 'customer' AS tbl, count(*) AS n, true AS refused FROM {_S} UNION ALL SELECT 'orders', count(*), true FROM {_ORD}")
def _(t):
    from ..errors import BudgetExceeded
    tabs = world(t, "customer", "orders")
    base = SUB.SubsetPlan(sampled().seeds, LINKS[2:3], {}, seed=SEED)
    closure = SUB.close(tabs, base)
    est = SUB.estimates(tabs, base, closure)
    refused = False
    try:
        SUB.check_budget(SUB.SubsetPlan(base.seeds, base.links, seed=SEED, max_total_rows=10), est)
    except BudgetExceeded:
        refused = True
    return est.select(F.col("table").alias("tbl"), F.col("surviving_rows").alias("n")).withColumn("refused", F.lit(refused))


@query("subset_dry_run", f"""SELECT 'customer' AS "table", (SELECT count(*) FROM customer) AS input_rows, (SELECT count(*) FROM {_S}) AS seed_rows, (SELECT count(*) FROM {_S}) AS surviving_rows, 0 AS seed_null_excluded
 UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 0, (SELECT count(*) FROM {_ORD}), 0 UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 0, (SELECT count(*) FROM {_LINE}), 0""")
def _(t):
    tabs = world(t, "customer", "orders", "lineitem")
    plan = SUB.SubsetPlan(sampled().seeds, LINKS[2:4], {}, seed=SEED)
    return SUB.estimates(tabs, plan, SUB.close(tabs, plan))


@query("subset_edge_stats", f"""SELECT 'customer->orders' AS edge, 'both' AS direction, (SELECT count(*) FROM orders WHERE o_custkey IN {_S}) AS rows_added_downward, 0 AS rows_added_upward
 UNION ALL SELECT 'orders->lineitem', 'both', (SELECT count(*) FROM {_LINE}), 0""")
def _(t):
    tabs = world(t, "customer", "orders", "lineitem")
    plan = SUB.SubsetPlan(sampled().seeds, LINKS[2:4], {}, seed=SEED)
    return t.spark.createDataFrame(SUB.close(tabs, plan).edges, "edge string, direction string, rows_added_downward long, rows_added_upward long")


@query("subset_allow_dangling", "SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'customer', 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    plan = SUB.SubsetPlan((SUB.Seed("orders", "filter", where=(("o_totalprice", "gt", 400000),)),), LINKS[2:4], {}, seed=SEED, allow_dangling=True)
    return _counts(SUB.subset(world(t, "orders", "customer", "lineitem"), plan))


@query("subset_preflight", f"SELECT 'orders->customer: ' || count(*)::VARCHAR || ' orphan keys' AS warning FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {PARENT})")
def _(t):
    notes = SUB.preflight({"customer": thin(t), "orders": t.orders}, SUB.SubsetPlan((), LINKS[2:3]))
    return t.spark.createDataFrame([(n,) for n in notes], "warning string")


_FIRST = f"(SELECT c_custkey FROM customer ORDER BY {U_CUST}, c_custkey LIMIT 20)"


@query("sample_run", f"SELECT o_orderkey, {H_OCUST} AS o_custkey, o_totalprice FROM orders WHERE o_custkey IN {_FIRST}")
def _(t):
    plan = SUB.SubsetPlan((SUB.Seed("customer", "sample", ("c_custkey",), count=20),), LINKS[2:3], {}, seed=SEED)
    cutout = SUB.subset(world(t, "customer", "orders"), plan)
    return mask_table(cutout["orders"].select("o_orderkey", "o_custkey", "o_totalprice"), [
        rule("o_custkey", "hash", "customer_identity"), *keep("o_orderkey", "o_totalprice")], SECRET, "orders")


@query("subset_then_mask", f"SELECT {H_CUST} AS c_custkey, 'REDACTED' AS c_name, c_nationkey FROM customer WHERE c_custkey IN {_S}")
def _(t):
    cutout = SUB.subset(world(t, "nation", "customer", "orders"), SUB.SubsetPlan(sampled().seeds, LINKS[1:3], WAYS, seed=SEED))
    return mask_table(cutout["customer"].select("c_custkey", "c_name", "c_nationkey"), [
        rule("c_custkey", "hash", "customer_identity"), rule("c_name", "redact"), *keep("c_nationkey")], SECRET, "customer")
