from . import lines as L
from .registry import query, table

SQL = """WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
 p AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b FROM (SELECT *, unnest(range(1, len(ls))) AS i FROM d)),
 f AS (SELECT a, b, min({'d': doc_id, 'i': i}) AS first FROM p GROUP BY a, b HAVING count(*) > 1),
 later AS (SELECT doc_id, i FROM p JOIN f USING (a, b) WHERE {'d': doc_id, 'i': i} > first),
 gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM later),
 runs AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest, sum(n) AS n_removed, flatten(list(places)) AS places
  FROM (SELECT doc_id, i - k AS run, count(*) AS n, list(i) AS places FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gone) GROUP BY 1, 2) GROUP BY 1)
 SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(longest, 0) AS longest_run,
  sha256(coalesce(array_to_string([ls[j] FOR j IN range(1, len(ls) + 1) IF places IS NULL OR NOT list_contains(places, j)], chr(10)), '')) AS kept_sha256
 FROM d LEFT JOIN runs USING (doc_id)"""


@query("op7_line_suffix_array", SQL)
def op7(spark, sf_dir):
    # the SQL knows runs of two lines only
    return L.dedup_lines(table(spark, sf_dir, "documents"), report=True, lone_words=None)
