from . import mixing as M
from .registry import query, table

SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
 s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
 s1 AS (SELECT *, CAST([3, 1, 2][(rank % 3) + 1] AS DOUBLE) AS weight, 2 * source_size AS most FROM s0),
 s2 AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w, row_number() OVER (ORDER BY most / weight, rank) AS k FROM s1),
 tot AS (SELECT 1.5 * CAST(sum(source_size) AS DOUBLE) AS total, max(rank) AS last FROM s1),
 lv AS (SELECT arg_min((total - held) / w, k) AS level FROM s2, tot WHERE weight * ((total - held) / w) <= most),
 t AS (SELECT source, rank, source_size, least(weight * level, CAST(most AS DOUBLE)) AS target FROM s2, lv),
 sp AS (SELECT rank, p, sum(p) OVER (ORDER BY rank) AS upto FROM (SELECT rank, CAST(round(target / total * {M.F45}) AS BIGINT) AS p FROM t, tot)),
 iv AS (SELECT rank, upto - p AS lo, CASE WHEN rank = last THEN greatest(upto, {M.F45}) ELSE upto END AS hi FROM sp, tot),
 slots AS (SELECT slot, ((slot % {M.F45}) * {M.F44}) % {M.F45} AS x FROM (SELECT unnest(range(0, CAST(ceil(round(sum(target)) / {M.BLOCK_WORDS}) AS BIGINT))) AS slot FROM t)),
 sl AS (SELECT rank, count(*) AS n FROM slots JOIN iv ON x >= lo AND x < hi GROUP BY rank),
 st AS (SELECT d.*, rank, source_size, target, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|0'), doc_id, size
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
 SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(start + size, coalesce(n, 0) * {M.BLOCK_WORDS}) - start) + greatest(0, least(start + size + source_size, coalesce(n, 0) * {M.BLOCK_WORDS}) - start - source_size) AS BIGINT) AS taken
 FROM st LEFT JOIN sl USING (rank)"""


@query("op6_golden_ratio_mix", SQL)
def op6(spark, sf_dir):
    return M.mix(table(spark, sf_dir, "documents"))
