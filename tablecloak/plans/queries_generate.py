"""Synthetic tables. Row counts come from the given tables, so the work grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.locales import LOCALES
from ..functions.providers import ALIASES, PROVIDERS, get_provider
from ..keys import seed_key, sql_hmac, sql_permute, sql_row_message, subkey
from ..operators import fit as FIT
from ..operators.alias import sql_alias
from ..operators.generate import Generator, GenTable, Source, gen, generation_order, preview
from ..operators.statistical import FILLER
from . import oracle_text as O
from .industries import INDUSTRIES, industry
from .oracle_text import cell_hmac, pick, unit, weighted
from .registry import SEED, Tables, query

ROWS = "(SELECT row_number() OVER () - 1 AS i FROM orders)"


def build(t: Tables, *cols, rows=None, name="g", sources=None, unique_together=()):
    n = t.orders.count() if rows is None else rows
    table = GenTable(name, n, (gen("id", "sequence", start=0), *cols), tuple(unique_together))
    return Generator(t.spark, [table], sources, SEED).run()[name]


def cell(column: str, i: str = "i", table: str = "g") -> str:
    return cell_hmac(table, column, i)


def pkey(column: str, table: str = "g") -> bytes:
    return subkey(seed_key(SEED), table, column)


@query("gen_rows", f"SELECT i AS id FROM {ROWS}")
def _(t):
    return build(t)


@query("gen_sequence", f"SELECT i AS id, 10000 + 5 * i AS a, 'ORD-' || lpad((1 + i)::VARCHAR, 8, '0') || '-X' AS b FROM {ROWS}")
def _(t):
    return build(t, gen("a", "sequence", start=10000, step=5), gen("b", "sequence", start=1, prefix="ORD-", suffix="-X", pad_length=8))


@query("gen_faker", f"""SELECT i AS id, {O.provider('first_name', cell('name'))} AS name, {O.provider('email', cell('mail'))} AS mail, {O.provider('uuid', cell('uid'))} AS uid,
 1 + {pick(cell('spend'), 500)} AS spend, CASE WHEN {unit(cell('city'), 3)} >= 0.25::DOUBLE THEN {O.provider('city', cell('city'))} END AS city,
 {O.provider('date_this_year', cell('day'))} AS day FROM {ROWS}""")
def _(t):
    return build(t, gen("name", "faker", faker_type="first_name"), gen("mail", "faker", faker_type="email"), gen("uid", "faker", faker_type="uuid4"),
                 gen("spend", "faker", faker_type="random_int", faker_kwargs={"min": 1, "max": 500}),
                 gen("city", "faker", faker_type="city", null_probability=0.25), gen("day", "faker", faker_type="date_this_year"))


_DE = LOCALES["de_DE"]


def _words_sql(words, i: str) -> str:
    return f"([{', '.join(O.q(w) for w in words)}])[({i}) % {len(words)} + 1]"


@query("gen_faker_locale", f"""SELECT i AS id, {_words_sql(_DE.first, 'n')} || ' ' || {_words_sql(_DE.last, f'n // {len(_DE.first)}')} AS name, split_part({_words_sql(_DE.cities, 'c')}, ',', 1) AS city,
 {_words_sql(_DE.streets, 's')} || ' ' || (s // {len(_DE.streets)} % 199 + 1) AS street, '+49 30 ' || lpad((p // 10000)::VARCHAR, 3, '0') || ' ' || lpad((p % 10000)::VARCHAR, 4, '0') AS phone,
 {O.provider('email', cell('mail'))} AS mail
 FROM (SELECT i, {pick(cell('name'), len(_DE.first) * len(_DE.last))} AS n, {pick(cell('city'), len(_DE.cities))} AS c, {pick(cell('street'), len(_DE.streets) * 199)} AS s,
 {pick(cell('phone'), 10 ** 7)} AS p FROM {ROWS})""")
def _(t):
    return build(t, *[gen(n, "faker", faker_type=f, locale="de_DE") for n, f in (("name", "name"), ("city", "city"), ("street", "street_address"), ("phone", "phone_number"), ("mail", "email"))])


TIER = {"None": 0.6, "Silver": 0.3, "Gold": 0.1}


@query("gen_categorical", f"SELECT i AS id, {weighted(unit(cell('tier')), list(TIER), list(TIER.values()))} AS tier, {weighted(unit(cell('even')), ['a', 'b', 'c'], None)} AS even FROM {ROWS}")
def _(t):
    return build(t, gen("tier", "categorical", categories=TIER), gen("even", "categorical", categories=["a", "b", "c"]))


@query("gen_constant", f"SELECT i AS id, 'EU' AS area FROM {ROWS}")
def _(t):
    return build(t, gen("area", "constant", value="EU"))


@query("gen_distribution", f"""SELECT i AS id, 10 + {unit(cell('u'))} * 90 AS u, -ln(1.0 - {unit(cell('e'))}) * 4.0 AS e,
 50 + sqrt(-2.0 * ln(1.0 - {unit(cell('n'))})) * cos(6.283185307179586 * {unit(cell('n'), 1)}) * 10 AS n FROM {ROWS}""")
def _(t):
    df = build(t, gen("u", "distribution", family="uniform", min=10, max=100), gen("e", "distribution", family="exponential", mean=4.0),
               gen("n", "distribution", family="normal", mean=50, std=10))
    return df


def cust_source(t: Tables) -> Source:
    return Source(t.customer.select("c_custkey", "c_name"), ["c_custkey"])


_CS = "(SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer)"
_NC = "(SELECT count(*) FROM customer)"


@query("gen_reference", f"""WITH c AS {_CS}, g AS (SELECT i, {pick(cell('random_id'), 'n')} AS x, i % n AS y FROM (SELECT i, {_NC} AS n FROM {ROWS}))
 SELECT g.i AS id, a.c_custkey AS random_id, b.c_name AS seq_name FROM g JOIN c a ON a.p = g.x JOIN c b ON b.p = g.y""")
def _(t):
    ref = dict(reference_table="customer")
    return build(t, gen("random_id", "reference", reference_column="c_custkey", **ref),
                 gen("seq_name", "reference", reference_column="c_name", distribution="sequential", **ref), sources={"customer": cust_source(t)})


@query("gen_reference_weighted", f"""SELECT g.i AS id, CASE WHEN {unit(cell('region', 'g.i'))} < 0.5::DOUBLE THEN 'AFRICA' WHEN {unit(cell('region', 'g.i'))} < 0.8::DOUBLE THEN 'AMERICA'
 WHEN {unit(cell('region', 'g.i'))} < 0.9::DOUBLE THEN 'ASIA' WHEN {unit(cell('region', 'g.i'))} < 0.95::DOUBLE THEN 'EUROPE' ELSE 'MIDDLE EAST' END AS region FROM {ROWS} g""")
def _(t):
    src = {"region": Source(t.region, ["r_regionkey"])}
    return build(t, gen("region", "reference", reference_table="region", reference_column="r_name", distribution="weighted",
                        weights=[0.5, 0.3, 0.1, 0.05, 0.05]), sources=src)


# every customer is a parent, weighted by a column: the draws meet an alias table
@query("gen_reference_weighted_column", f"""WITH items AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS item, c_nationkey AS w FROM customer), {sql_alias('items')},
 g AS (SELECT i, {pick(cell('c'), 'slots')} AS slot, {pick(cell('c'), 'total', 1)} AS v FROM {ROWS}, (SELECT any_value(slots) AS slots, any_value(total) AS total FROM alias_))
 SELECT i AS id, c.c_custkey AS c FROM g JOIN alias_ a ON a.slot = g.slot JOIN {_CS} c ON c.p = CASE WHEN v < cut THEN item ELSE other END""")
def _(t):
    src = {"customer": Source(t.customer.select("c_custkey", "c_nationkey"), ["c_custkey"])}
    return build(t, gen("c", "reference", reference_table="customer", reference_column="c_custkey", distribution="weighted", weight_column="c_nationkey"), sources=src)


@query("gen_reference_bounded", f"""WITH c AS {_CS}, g AS (SELECT CASE WHEN i < n THEN i % n ELSE {sql_permute(pkey('c'), 'greatest(i - n, 0)', '(n * 19)')} % n END AS p
 FROM (SELECT i, {_NC} AS n FROM {ROWS})) SELECT c.c_custkey AS c, count(*) AS children FROM g JOIN c USING (p) GROUP BY 1""")
def _(t):
    # one to twenty orders for every customer
    df = build(t, gen("c", "reference", reference_table="customer", reference_column="c_custkey", min_per_parent=1, max_per_parent=20),
               sources={"customer": cust_source(t)})
    return df.groupBy("c").agg(F.count("*").alias("children"))


_FAN = f"""hist AS (SELECT k, count(*) AS n FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey) GROUP BY 1),
 cum AS (SELECT k, sum(n) OVER (ORDER BY k)::DOUBLE / (SELECT sum(n) FROM hist)::DOUBLE AS hi, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE
 / (SELECT sum(n) FROM hist)::DOUBLE AS lo FROM hist), per AS (SELECT p, c_custkey, k FROM (SELECT p, c_custkey, {unit(cell('c', 'p'))} AS u FROM {_CS}) s JOIN cum ON u >= lo AND u < hi),
 off AS (SELECT p, c_custkey, k, sum(k) OVER (ORDER BY p) - k AS off FROM per), slots AS (SELECT c_custkey, off + j AS s FROM off, unnest(range(k)) AS u(j)),
 tot AS (SELECT count(*) AS n FROM slots)"""
_CUT = sql_permute(subkey(pkey("c"), "cut"), "s", "n")


# the row count is a fifth of the orders, so the drawn children are cut
@query("gen_reference_fitted", f"""WITH {_FAN} SELECT r AS id, c_custkey AS c FROM (SELECT c_custkey, {_CUT} AS r FROM slots, tot) WHERE r < (SELECT count(*) // 5 FROM orders)""")
def _(t):
    hist = {r["children"]: r["parents"] for r in FIT.fanout(t.orders, ["o_custkey"]).collect()}
    return build(t, gen("c", "reference", reference_table="customer", reference_column="c_custkey", distribution="fitted", fanout=hist),
                 rows=t.orders.count() // 5, sources={"customer": cust_source(t)})


_PARTS = "(SELECT p_name, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS p FROM part)"


def _drawn(column: str) -> str:
    return f"(SELECT i, {pick(cell(column), 'n')} AS x FROM (SELECT i, (SELECT count(*) FROM part) AS n FROM {ROWS}))"


@query("gen_lookup", f"SELECT g.i AS id, p.p_name AS product FROM {_drawn('product')} g JOIN {_PARTS} p ON p.p = g.x")
def _(t):
    src = {"part": Source(t.part.select("p_partkey", "p_name"), ["p_partkey"])}
    return build(t, gen("product", "lookup", reference_table="part", reference_column="p_name"), sources=src)


@query("lookup_join", f"SELECT g.i AS id, p.p_name AS product, p.p_brand AS brand FROM {_drawn('p')} g JOIN {_PARTS} p ON p.p = g.x")
def _(t):
    from ..keys import hmac_hex, pick as pick_
    from ..operators.joins import lookup_join
    src = Source(t.part.select("p_partkey", "p_name", "p_brand"), ["p_partkey"])
    drawn = build(t).withColumn("__p", pick_(hmac_hex(pkey("p"), F.col("id").cast("string")), src.rows))
    return lookup_join(drawn, src.df, ["__p"]).select("id", F.col("p_name").alias("product"), F.col("p_brand").alias("brand"))


_AMT = f"(1 + {pick(cell('amount'), 1000)})"


@query("gen_formula", f"SELECT i AS id, {_AMT} AS amount, 'ORD-' || lpad(i::VARCHAR, 9, '0') AS label, CASE WHEN {_AMT} > 500 THEN 'big' ELSE 'small' END AS size FROM {ROWS}")
def _(t):
    return build(t, gen("amount", "faker", faker_type="random_int", faker_kwargs={"min": 1, "max": 1000}),
                 gen("label", "formula", expression=X.concat("ORD-", X.zfill(X.text(F.col("id")), 9))),
                 gen("size", "formula", expression=X.if_(X.gt(F.col("amount"), 500), "big", "small")))


@query("gen_derived", f"SELECT i AS id, {_AMT} AS amount, CASE WHEN {_AMT} * 2 + i % 7 <= 1500 THEN {_AMT} * 2 + i % 7 END AS total FROM {ROWS}")
def _(t):
    return build(t, gen("amount", "faker", faker_type="random_int", faker_kwargs={"min": 1, "max": 1000}),
                 gen("total", "derived", expression=X.add(X.mul(F.col("amount"), 2), F.col("id") % 7), bounds=(0, 1500)))


@query("gen_derived_aggregate", f"WITH g AS (SELECT i AS id, {_AMT} AS amount FROM {ROWS}) SELECT id, amount, (SELECT sum(amount) FROM g)::BIGINT AS total, (SELECT max(amount) FROM g) AS top FROM g")
def _(t):
    return build(t, gen("amount", "faker", faker_type="random_int", faker_kwargs={"min": 1, "max": 1000}),
                 gen("total", "derived_aggregate", op="sum", column="amount"), gen("top", "derived_aggregate", op="max", column="amount"))


_GRP = pick(cell("grp"), 50)


@query("gen_grouped_series", f"""WITH g AS (SELECT i, 1 + {_GRP} AS grp, floor({unit(cell('walk'))} * 6)::BIGINT AS s FROM {ROWS})
 SELECT i AS id, grp, row_number() OVER (PARTITION BY grp ORDER BY i) AS n, (100 + sum(s) OVER (PARTITION BY grp ORDER BY i))::BIGINT AS walk FROM g""")
def _(t):
    return build(t, gen("grp", "faker", faker_type="random_int", faker_kwargs={"min": 1, "max": 50}),
                 gen("n", "grouped_series", group_by="grp", order_by="id", start=1),
                 gen("walk", "grouped_series", group_by="grp", order_by="id", generator="monotone_walk", start=100, max_step=5))


_DAY = O.provider("date_this_year", cell("day"))


@query("gen_windowed_date", f"SELECT i AS id, {_DAY} AS day, {_DAY} + (1 + least(floor({unit(cell('due'))} * 30), 29))::INT AS due FROM {ROWS}")
def _(t):
    return build(t, gen("day", "faker", faker_type="date_this_year"), gen("due", "windowed_date", anchor="day", min_days=1, max_days=30))


@query("gen_group_key", f"SELECT i AS id, 1 + {_GRP} AS grp, 'G' || substr({sql_hmac(pkey('key'), sql_row_message(f'1 + {_GRP}'))}, 1, 16) AS key FROM {ROWS}")
def _(t):
    return build(t, gen("grp", "faker", faker_type="random_int", faker_kwargs={"min": 1, "max": 50}), gen("key", "group_key", group_by="grp", prefix="G"))


@query("gen_null_injection", f"SELECT i AS id, CASE WHEN {unit(cell('seg'), 3)} >= 0.4::DOUBLE THEN {weighted(unit(cell('seg')), ['x', 'y'], None)} END AS seg FROM {ROWS}")
def _(t):
    return build(t, gen("seg", "categorical", categories=["x", "y"], null_probability=0.4))


@query("gen_unique_column", f"""SELECT g.i AS id, c.c_custkey AS cust, {O.PROVIDER_SQL['person_email'](sql_permute(pkey('mail'), 'g.i', str(PROVIDERS['person_email'].size)))} AS mail
 FROM (SELECT row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM customer) g JOIN {_CS} c ON c.p = {sql_permute(pkey('cust'), 'g.i', 'g.n')}""")
def _(t):
    return build(t, gen("cust", "reference", reference_table="customer", reference_column="c_custkey", unique=True),
                 gen("mail", "faker", faker_type="email", unique=True), rows=t.customer.count(), sources={"customer": cust_source(t)})


@query("gen_unique_together", f"""SELECT g.i AS id, c.c_custkey AS cust, p.p_partkey AS part FROM (SELECT i, q // n AS a, q % n AS b FROM (SELECT i, n, {sql_permute(pkey('cust+part'), 'i', 'm')} AS q
 FROM (SELECT i, (SELECT count(*) FROM part) AS n, (SELECT count(*) FROM customer) * (SELECT count(*) FROM part) AS m FROM {ROWS}))) g
 JOIN {_CS} c ON c.p = g.a JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS p FROM part) p ON p.p = g.b""")
def _(t):
    src = {"customer": cust_source(t), "part": Source(t.part.select("p_partkey"), ["p_partkey"])}
    return build(t, gen("cust", "reference", reference_table="customer", reference_column="c_custkey"),
                 gen("part", "reference", reference_table="part", reference_column="p_partkey"), sources=src, unique_together=[("cust", "part")])


# ---- from a snapshot

def _steps(counts: str, order: str) -> str:
    """counts: a CTE with n; adds lo_u and hi_u, the share of rows before and up to each."""
    return (f"SELECT *, coalesce(sum(n) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(n) OVER ())::DOUBLE AS lo_u, "
            f"CASE WHEN row_number() OVER (ORDER BY {order}) = count(*) OVER () THEN 1.0 ELSE (sum(n) OVER (ORDER BY {order}))::DOUBLE / (sum(n) OVER ())::DOUBLE END AS hi_u FROM {counts}")


def _hist_sql(x: str, frm: str) -> str:
    return (f"SELECT lo0 + b * ((hi0 - lo0) / 10.0) AS lo, lo0 + (b + 1) * ((hi0 - lo0) / 10.0) AS hi, b, count(*) AS n FROM (SELECT lo0, hi0, "
            f"least(floor((x - lo0) / ((hi0 - lo0) / 10.0)), 9)::INT AS b FROM (SELECT ({x})::DOUBLE AS x, min(({x})::DOUBLE) OVER () AS lo0, max(({x})::DOUBLE) OVER () AS hi0 FROM {frm} WHERE ({x}) IS NOT NULL)) GROUP BY ALL")


_STAT = f"""WITH nh AS ({_hist_sql('o_totalprice', 'orders')}), nc AS ({_steps('nh', 'b')}),
 ch AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1), cc AS ({_steps('ch', 'n DESC, v')}),
 yh AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), yc AS ({_steps('yh', 'y')}),
 g AS (SELECT i, {unit(cell('o_totalprice'))} AS nu, {unit(cell('o_totalprice'), 1)} AS nv, {unit(cell('o_orderstatus'))} AS cu, {unit(cell('o_orderdate'))} AS yu,
 {unit(cell('o_orderdate'), 1)} AS yv FROM {ROWS})"""


@query("gen_statistical", f"""{_STAT} SELECT i AS id, round(nc.lo + nv * (nc.hi - nc.lo), 2) AS o_totalprice, cc.v AS o_orderstatus,
 (to_timestamp(greatest(least(floor(epoch(make_date(yc.y, 1, 1)) + yv * (epoch(make_date(yc.y + 1, 1, 1)) - epoch(make_date(yc.y, 1, 1)))), (SELECT epoch(max(o_orderdate)) FROM orders)),
 (SELECT epoch(min(o_orderdate)) FROM orders))) AT TIME ZONE 'UTC')::DATE AS o_orderdate
 FROM g JOIN nc ON nu >= nc.lo_u AND nu < nc.hi_u JOIN cc ON cu >= cc.lo_u AND cu < cc.hi_u JOIN yc ON yu >= yc.lo_u AND yu < yc.hi_u""")
def _(t):
    snap = FIT.fit(t.orders.select("o_totalprice", "o_orderstatus", "o_orderdate"), include_values=True)
    st = lambda c: gen(c, "statistical", snapshot=snap, allow_real_categories=True)
    return build(t, st("o_totalprice"), st("o_orderstatus"), st("o_orderdate"))


_LH = f"""WITH lh AS ({_hist_sql('length(text)', 'documents')}), lc AS ({_steps('lh', 'b')}),
 g AS (SELECT i, {unit(cell('text'))} AS u, {unit(cell('text'), 1)} AS v, {pick(cell('text'), len(FILLER), 2)} AS skip FROM (SELECT row_number() OVER () - 1 AS i FROM documents))"""


@query("gen_statistical_freetext", f"""{_LH} SELECT i AS id, substr(repeat({O.q(FILLER)}, ceil((n + skip) / {float(len(FILLER))})::INT), skip + 1, n) AS text
 FROM (SELECT i, skip, greatest(round(lo + v * (hi - lo))::INT, 0) AS n FROM g JOIN lc ON u >= lo_u AND u < hi_u)""")
def _(t):
    snap = FIT.fit(t.documents.select("text"), include_values=True)
    return build(t, gen("text", "statistical", snapshot=snap), rows=t.documents.count())


@query("gen_statistical_conditional", f"""WITH ph AS (SELECT o_orderstatus AS a, count(*) AS n FROM orders GROUP BY 1), pc AS ({_steps('ph', 'n DESC, a')}),
 j AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 25),
 jc AS (SELECT a, b, coalesce(sum(n) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(n) OVER (PARTITION BY a))::DOUBLE AS lo,
 CASE WHEN row_number() OVER (PARTITION BY a ORDER BY b) = count(*) OVER (PARTITION BY a) THEN 1.0 ELSE (sum(n) OVER (PARTITION BY a ORDER BY b))::DOUBLE / (sum(n) OVER (PARTITION BY a))::DOUBLE END AS hi FROM j),
 g AS (SELECT i, {unit(cell('o_orderstatus'))} AS u, {unit(cell('o_orderpriority'))} AS w FROM {ROWS})
 SELECT i AS id, pc.a AS o_orderstatus, jc.b AS o_orderpriority FROM g JOIN pc ON u >= pc.lo_u AND u < pc.hi_u JOIN jc ON jc.a = pc.a AND w >= jc.lo AND w < jc.hi""")
def _(t):
    snap = FIT.fit(t.orders.select("o_orderstatus", "o_orderpriority"), joints=[("o_orderstatus", "o_orderpriority")], include_values=True)
    return build(t, gen("o_orderstatus", "statistical", snapshot=snap, allow_real_categories=True),
                 gen("o_orderpriority", "statistical_conditional", snapshot=snap, condition_on="o_orderstatus"))


# every pair of brand and type, over a thousand cells
@query("gen_statistical_conditional_all", f"""WITH ph AS (SELECT p_brand AS a, count(*) AS n FROM part GROUP BY 1), pc AS ({_steps('ph', 'n DESC, a')}),
 items AS (SELECT p_brand AS grp, p_type AS item, count(*) AS w FROM part GROUP BY 1, 2), {sql_alias('items', 'grp')},
 k AS (SELECT DISTINCT grp, slots, total FROM alias_),
 g AS (SELECT i, {unit(cell('p_brand'))} AS u, {cell('p_type')} AS h FROM {ROWS}),
 d AS (SELECT i, pc.a, {pick('h', 'slots')} AS slot, {pick('h', 'total', 1)} AS v FROM g JOIN pc ON u >= pc.lo_u AND u < pc.hi_u JOIN k ON k.grp = pc.a)
 SELECT i AS id, d.a AS p_brand, CASE WHEN v < cut THEN item ELSE other END AS p_type FROM d JOIN alias_ ON alias_.grp = d.a AND alias_.slot = d.slot""")
def _(t):
    snap = FIT.fit(t.part.select("p_brand", "p_type"), joints=[("p_brand", "p_type")], joint_cells=None, include_values=True)
    return build(t, gen("p_brand", "statistical", snapshot=snap, allow_real_categories=True),
                 gen("p_type", "statistical_conditional", snapshot=snap, condition_on="p_brand"))


# ---- whole sets

def _column_sql(table: str, g, i: str) -> str:
    """SQL of a self-contained column of a starter set at row i."""
    o, h = g.options, cell_hmac(table, g.name, i)
    if g.type == "sequence":
        return f"({o['start']} + {i})"
    if g.type == "constant":
        return O.q(o["value"])
    if g.type == "categorical":
        return weighted(unit(h), o["categories"], o["weights"])
    kind, kw = o["faker_type"], o["faker_kwargs"]
    if kind == "random_int":
        return f"({kw['min']} + {pick(h, kw['max'] - kw['min'] + 1)})"
    if kind == "bothify":
        w = pick(h, get_provider(kind, **kw).size)
        return "'CC-' || " + " || ".join(f"(({w} // {10 ** k}) % 10)::VARCHAR" for k in range(4))
    return O.provider(ALIASES.get(kind, kind), h)


def industry_sql(name: str) -> str:
    """The third table joined to its parents, row by row."""
    (a, na, ca), (b, nb, cb), (c, nc, cc) = INDUSTRIES[name]
    count = lambda n: f"greatest(1, round_even((SELECT count(*) FROM customer) * {n} / 1500.0, 0))::BIGINT"
    rows = f"(SELECT unnest(range({count(nc)})) AS i)"
    ref_c = next(g for g in cc if g.type == "reference")
    ref_b = next(g for g in cb if g.type == "reference")
    cols = [f"{_column_sql(c, g, 'i')} AS {c}_{g.name}" for g in cc if g.type != "reference"]
    cols += [f"{_column_sql(b, g, 'j')} AS {b}_{g.name}" for g in cb if g.type != "reference"]
    cols += [f"{_column_sql(a, g, 'k')} AS {a}_{g.name}" for g in ca]
    return (f"SELECT {', '.join(cols)} FROM (SELECT i, j, {pick(cell_hmac(b, ref_b.name, 'j'), 'na')} AS k FROM (SELECT i, "
            f"{pick(cell_hmac(c, ref_c.name, 'i'), 'nb')} AS j, na FROM (SELECT i, {count(na)} AS na, {count(nb)} AS nb FROM {rows})))")


def _industry(name: str):
    def run(t: Tables):
        tables = industry(name, t.customer.count() / 1500.0)
        out = Generator(t.spark, tables, seed=SEED).run()
        a, b, c = (tb.name for tb in tables)
        ref_c = next(g for g in tables[2].columns if g.type == "reference").name
        ref_b = next(g for g in tables[1].columns if g.type == "reference").name
        f = {n: out[n].select(*[F.col(x).alias(f"{n}_{x}") for x in out[n].columns]) for n in (a, b, c)}
        joined = f[c].join(f[b], F.col(f"{c}_{ref_c}") == F.col(f"{b}_{ref_c}")).join(f[a], F.col(f"{b}_{ref_b}") == F.col(f"{a}_{ref_b}"))
        return joined.drop(f"{c}_{ref_c}", f"{b}_{ref_b}")
    return run


for _name in INDUSTRIES:
    query(f"gen_industry_{_name}", industry_sql(_name))(_industry(_name))


@query("gen_industry", " UNION ALL ".join(f"SELECT '{n}' AS industry, {tb[0][1]} AS first_rows, {tb[1][1]} AS second_rows, {tb[2][1]} AS third_rows, 0 AS orphans, (SELECT count(*) FROM customer) AS scale"
                                         for n, tb in INDUSTRIES.items()).replace("AS first_rows", "* {k} AS first_rows").replace("AS second_rows", "* {k} AS second_rows")
       .replace("AS third_rows", "* {k} AS third_rows").replace("{k}", "(SELECT greatest(1, count(*) // 1000) FROM customer)"))
def _(t):
    """Row counts of all sets at a whole multiple of their size, and children without a parent (none)."""
    n = t.customer.count()
    out = None
    for name in INDUSTRIES:
        tables = industry(name, max(1, n // 1000))
        built = Generator(t.spark, tables, seed=SEED).run()
        a, b, c = (tb.name for tb in tables)
        kb = next(g for g in tables[1].columns if g.type == "reference").name
        kc = next(g for g in tables[2].columns if g.type == "reference").name
        lost = built[b].join(built[a], kb, "left_anti").agg(F.count("*")).scalar() + built[c].join(built[b], kc, "left_anti").agg(F.count("*")).scalar()
        row = built[c].agg(F.count("*").alias("third_rows")).select(
            F.lit(name).alias("industry"), built[a].agg(F.count("*")).scalar().alias("first_rows"), built[b].agg(F.count("*")).scalar().alias("second_rows"),
            "third_rows", lost.alias("orphans"), F.lit(n).alias("scale"))
        out = row if out is None else out.unionByName(row)
    return out


@query("gen_table_order", """SELECT 0 AS pos, 'customers' AS tbl, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 1, 'orders', (SELECT count(*) FROM orders)
 UNION ALL SELECT 2, 'lines', (SELECT count(*) FROM lineitem)""")
def _(t):
    ref = lambda n, tb: gen(n, "reference", reference_table=tb, reference_column="id")
    key = gen("id", "sequence", start=1)
    tables = [GenTable("lines", t.lineitem.count(), (key, ref("o", "orders"))), GenTable("orders", t.orders.count(), (key, ref("c", "customers"))),
              GenTable("customers", t.customer.count(), (key,))]
    built = Generator(t.spark, tables, seed=SEED).run()
    out = None
    for pos, n in enumerate(generation_order(tables)):
        row = built[n].agg(F.count("*").alias("n")).select(F.lit(pos).alias("pos"), F.lit(n).alias("tbl"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("gen_preview", """SELECT 'lines' AS tbl, 100 AS n UNION ALL SELECT 'orders', greatest(1, round_even((SELECT count(*) FROM orders) * 100.0 / (SELECT count(*) FROM lineitem), 0))::BIGINT
 UNION ALL SELECT 'customers', greatest(1, round_even((SELECT count(*) FROM customer) * 100.0 / (SELECT count(*) FROM lineitem), 0))::BIGINT""")
def _(t):
    key = gen("id", "sequence", start=1)
    tables = [GenTable("lines", t.lineitem.count(), (key,)), GenTable("orders", t.orders.count(), (key,)), GenTable("customers", t.customer.count(), (key,))]
    out = None
    for n, f in Generator(t.spark, preview(tables, 100), seed=SEED).run().items():
        row = f.agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n")
        out = row if out is None else out.unionByName(row)
    return out
