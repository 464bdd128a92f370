"""Query op12: five filters over all documents, in all orders."""

from tallygrid.llm.filter_audit import filter_audit
from tallygrid.llm.registry import SQL_WORDS, query
from tallygrid.llm.shared import table

FILTER_SQL = f"""
WITH l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS s, {SQL_WORDS.format('text')} AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {{
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
    'C': 100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 10 * length(s), 'D': regexp_matches(s, '[#$%&*|]'),
    'E': coalesce(doc_id > first, false)}} AS f
  FROM t LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, (CASE WHEN f['A'] THEN 'A' ELSE '' END) || (CASE WHEN f['B'] THEN 'B' ELSE '' END) || (CASE WHEN f['C'] THEN 'C' ELSE '' END)
    || (CASE WHEN f['D'] THEN 'D' ELSE '' END) || (CASE WHEN f['E'] THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || g.c || h.c || i.c AS filter_order FROM x a, x b, x g, x h, x i
  WHERE len(list_distinct([a.c, b.c, g.c, h.c, i.c])) = 5
), r AS (
  SELECT part, filter_order, step, filter_order[step] AS c, fails, n, good, toxic,
    contains(fails, filter_order[step]) AS failing, regexp_matches(filter_order[1:step - 1], '[' || fails || '_]') AS gone
  FROM m, o, (SELECT unnest(range(1, 6)) AS step)
), s AS (
  SELECT part, filter_order, step, c,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = c THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM s
"""


@query("op12_filter_interactions", FILTER_SQL)
def op12(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
