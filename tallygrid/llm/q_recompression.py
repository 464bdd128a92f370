"""Query op10: long repeats removed from all documents."""

from pyspark.sql import functions as F

from tallygrid.llm.recompression import remove_repeats
from tallygrid.llm.registry import SQL_WORDS, query
from tallygrid.llm.shared import table

REPEATS_SQL = f"""
WITH w AS (SELECT doc_id, {SQL_WORDS.format('text')} AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest([md5(array_to_string(w[i:i + 49], ' ')) for i in range(1, len(w) - 48)]) AS g
  FROM w WHERE len(w) >= 50
), f AS (SELECT g, min(doc_id) AS d FROM p GROUP BY g
), h AS (SELECT doc_id, list(p ORDER BY p) AS hits FROM p JOIN f USING (g) WHERE p.doc_id > f.d GROUP BY doc_id
), x AS (
  SELECT DISTINCT h.doc_id, unnest(flatten([range(i, i + 50) for i in hits])) AS k FROM h
), o AS (
  SELECT w.doc_id, k.k AS k, w.w[k.k] AS word FROM w, unnest(range(1, len(w.w) + 1)) AS k(k)
), r AS (
  SELECT o.doc_id, string_agg(o.word, ' ' ORDER BY o.k) AS kept, count(*) AS n
  FROM o LEFT JOIN x ON x.doc_id = o.doc_id AND x.k = o.k WHERE x.k IS NULL GROUP BY o.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(w.w) - coalesce(r.n, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


@query("op10_recompression_substring_dedup", REPEATS_SQL)
def op10(spark, sf_dir):
    kept = remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
