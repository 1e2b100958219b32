from . import decontaminate as D
from .registry import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql_words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ITEMS = f"""items AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {sql_words('text')} AS ws
  FROM benchmark WHERE item_id IS NOT NULL) WHERE len(ws) > 0),
 wins AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM items))"""

SQL = f"""WITH {ITEMS},
 d AS (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS ws FROM documents),
 dw AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT r, ws, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT k FROM items))),
 hit AS (SELECT r, i, dw.k AS k, item_id FROM dw JOIN wins ON dw.w = wins.w AND dw.k = wins.k),
 pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
 it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)"""


@query("op2_suffix_array_decontamination", SQL)
def op2(spark, sf_dir):
    return D.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
