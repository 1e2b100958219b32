"""All registered queries, and the flagship."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import subset as SUB
from ..operators.masks import keep, mask_table, rule
from . import (  # noqa: F401
    queries_checks, queries_generate, queries_mask, queries_profile, queries_relations, queries_shape,
)
from .registry import ORACLES, QUERIES, SECRET, SEED, Tables, query


@query("flagship", f"""SELECT (floor(o_totalprice / 50000) * 50000)::BIGINT::VARCHAR || '-' || (floor(o_totalprice / 50000) * 50000 + 50000)::BIGINT::VARCHAR AS price_band,
 count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_totalprice > 250000 GROUP BY 1""")
def _flagship(t: Tables) -> DataFrame:
    """Orders above a price with their customers, masked together: keys hashed in one namespace, names replaced,
    dates shifted, prices banded; then the masked tables are joined and counted."""
    plan = SUB.SubsetPlan((SUB.Seed("orders", "filter", where=(("o_totalprice", "gt", 250000),)),), queries_relations.LINKS[2:3],
                          {("customer", "orders"): "upward"}, seed=SEED)
    out = SUB.subset({"customer": t.customer, "orders": t.orders}, plan)
    customers = mask_table(out["customer"], [
        rule("c_custkey", "hash", "customer_identity"), rule("c_name", "faker", "people", deterministic=True, provider="person_full_name"),
        *keep("c_nationkey", "c_acctbal", "c_mktsegment")], SECRET, "customer")
    orders = mask_table(out["orders"], [
        rule("o_custkey", "hash", "customer_identity"), rule("o_orderdate", "date_shift", "order_dates", min_days=-30, max_days=30),
        rule("o_totalprice", "bucketize", width=50000), *keep("o_orderkey", "o_orderstatus", "o_orderpriority")], SECRET, "orders")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(F.col("o_totalprice").alias("price_band")).agg(
        F.count("*").alias("orders"), F.count_distinct("c_custkey").alias("customers"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
