from . import minhash as H
from .registry import query, table

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

# Pairs share one of the rarest shingles of both: if fewer than a fifth of the smaller set is missing from the other, the
# first ceil(n / 5) + 1 shingles of each, rarest first, overlap.
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 f AS (SELECT g, count(*) AS f FROM s GROUP BY 1),
 p AS (SELECT doc_id, g FROM (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k FROM s JOIN f USING (g) JOIN n USING (doc_id)) WHERE k <= ceil(n / 5.0) + 1),
 c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id),
 j AS (SELECT a, b, count(*) AS both_ FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY 1, 2),
 l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
 m AS (SELECT x, min(y) AS c FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id"""


@query("op5_bayesian_minhash", SQL)
def op5(spark, sf_dir):
    return H.classes(table(spark, sf_dir, "documents"), words=4)
