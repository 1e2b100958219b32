from . import collocations as C
from .registry import query, table

SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 p AS (SELECT lang, regexp_extract_all(unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS ws FROM d),
 w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
 n AS (SELECT lang, count(*) AS n FROM w GROUP BY 1),
 f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM w, range(1, 5) s(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 30),
 c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE m > 1),
 k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
 s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, u.f AS l, v.f AS r, CAST(CAST(2000000 AS HUGEINT) * k.a // (u.f + v.f) AS BIGINT) AS score FROM k
  JOIN f u ON u.lang = k.lang AND u.phrase = array_to_string(k.x[1:k.k], ' ') JOIN f v ON v.lang = k.lang AND v.phrase = array_to_string(k.x[k.k + 1:k.m], ' ')),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 i AS (SELECT lang, a, m, x, unnest(range(1, m)) AS j FROM c WHERE m > 2),
 o AS (SELECT lang, array_to_string(x[j:j + z - 1], ' ') AS phrase, max(a) AS over FROM i, range(2, 4) t(z) WHERE z < m AND j + z - 1 <= m GROUP BY 1, 2),
 g AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE over IS NULL OR 100 * over < 80 * a),
 q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM g)
 SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000"""


@query("op11_era_collocations", SQL)
def op11(spark, sf_dir):
    return C.collocations(table(spark, sf_dir, "documents"))
