"""Query op5: licence notices in all documents."""

from tallygrid.llm.license_scan import APART, PERCENT, TEMPLATES, license_scan, templates
from tallygrid.llm.registry import SQL_LOWER, query
from tallygrid.llm.shared import table

_ROWS = ", ".join(f"""('{k}', '{t.replace("'", "''")}')""" for k, v in TEMPLATES.items() for t in v)
_WORDS = f"trim(regexp_replace({SQL_LOWER}, '{APART}', ' ', 'g'))"

LICENSE_SQL = f"""
WITH t AS (SELECT license_id, string_split({_WORDS.format('text')}, ' ') AS w FROM (VALUES {_ROWS}) AS v(license_id, text)
), tg AS (
  SELECT license_id, w AS template, len(w) - 1 AS m, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM t
), tb AS (SELECT license_id, template, m, g, count(*) AS k FROM tg GROUP BY ALL
), u AS (
  SELECT doc_id, unnest(list_distinct(list_concat(string_split(coalesce(text, ''), chr(10)),
    regexp_split_to_array(coalesce(text, ''), '\\n\\n+'), [coalesce(text, '')]))) AS part FROM documents
), p AS (SELECT DISTINCT doc_id, string_split({_WORDS.format('part')}, ' ') AS w FROM u
), pg AS (
  SELECT doc_id, w, len(w) - 1 AS n, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM p WHERE len(w) >= 2
), pb AS (SELECT doc_id, w, n, g, count(*) AS k FROM pg GROUP BY ALL
), s AS (
  SELECT doc_id, w, n, license_id, template, m, sum(least(pb.k, tb.k)) AS o FROM pb JOIN tb USING (g) GROUP BY ALL
)
SELECT doc_id, license_id, max(2.0::DOUBLE * o / (n + m)) AS dice, count(DISTINCT w) AS n_parts
FROM s WHERE 200 * o >= {PERCENT} * (n + m) GROUP BY ALL
"""


@query("op5_license_dice", LICENSE_SQL)
def op5(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"), templates(spark))
