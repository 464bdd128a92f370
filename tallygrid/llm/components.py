"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.shared import written


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Tie each vertex's larger (`both`) or smaller neighbours to its smallest one."""
    if both:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # the least is taken per task before the shuffle, so a vertex with many links stays small
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    met = around.join(least, "a")
    if both:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(
            least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`(id, component)` of every vertex of `links (a, b)`; the component is its smallest id.

    Each round is written to the shared folder, so the plan does not grow. It ends
    when a round changes nothing: about the logarithm of the longest chain.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        edges = written(_star(_star(edges, True), False), "stars")
    tied = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return tied.unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
