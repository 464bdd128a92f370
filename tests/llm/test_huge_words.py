"""Texts of very few, very long words."""

from pyspark.sql import functions as F

from tallygrid.llm import robust_outliers as R
from tallygrid.llm.text_stats import COUNTS


def test_counts_of_huge_words_do_not_overflow(spark):
    huge = {"n_words": 20, "word_chars": 150_000_000, "n_lower": 150_000_000, "n_distinct_words": 20, "n_long_words": 20}
    plain = {"n_words": 200, "word_chars": 1000, "n_lower": 1000, "n_lines": 10, "n_distinct_words": 150, "n_short_words": 60}
    rows = [(k, "en", "a", *(float(huge.get(c, 0)) for c in COUNTS)) for k in range(14)] + [
        (100 + k, "en", "a", *(float(plain.get(c, 0) + (k % 5 if plain.get(c) else 0)) for c in COUNTS)) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} double" for c in COUNTS))
    counted = frame.select("doc_id", "lang", "source", *(F.col(c).cast("bigint").alias(c) for c in COUNTS))
    found = R.estimates(counted).collect()
    assert found and all(abs(v) < 1e12 for r in found for v in r["mean"])


def test_usual_word_lengths_are_taken_as_they_are(spark):
    found = spark.range(1).select(R._bent(F.lit(3.0)).alias("a"), R._bent(F.lit(25.0)).alias("b"), R._bent(F.lit(25.0001)).alias("c"), R._bent(F.lit(1e9)).alias("d")).first()
    assert (found.a, found.b) == (3.0, 25.0) and abs(found.c - 25.0001) < 1e-4 and 25 < found.d < 500
