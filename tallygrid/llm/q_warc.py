"""Query op8: all pages written to WARC bundles and read back."""

from tallygrid.llm.registry import query
from tallygrid.llm.shared import table, temporary_folder
from tallygrid.llm.warc_bundles import read_bundles, write_bundles

WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, html, h, min(page_id) OVER (PARTITION BY h) AS f,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (('0x' || substr(h, 5 * (k // 4) + 1, 5))::INT >> (15 - 5 * (k % 4))) % 32 + 1, 1) FOR k IN range(0, 32)], '') AS b
  FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, b AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM d
"""


@query("op8_seekable_warc", WARC_SQL)
def op8(spark, sf_dir):
    folder = temporary_folder(spark, "warc")
    write_bundles(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    return read_bundles(spark, folder, payload=False).drop("url")
