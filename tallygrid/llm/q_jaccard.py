"""Query op3: the n-gram Jaccard join over all documents."""

from tallygrid.llm.jaccard_join import jaccard_join
from tallygrid.llm.registry import SQL_LOWER, SQL_WORDS, query
from tallygrid.llm.shared import table

JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {SQL_WORDS.format(SQL_LOWER.format('text'))} AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""


@query("op3_ngram_jaccard_join", JACCARD_SQL)
def op3(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"), size=4, percent=85)
