import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text):
    return (text or "").encode().split()


@pytest.fixture(scope="session")
def texts():
    """Rows with nulls in every column, empty and long texts, ties, repeated rows and copies."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(70)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), "en", "b", None), (4, None, "en", "a", 0), (5, "", None, None, 0),
        (6, " \t\n ", "en", "a", 3), (7, "one two", None, "b", 7), (7, "one two", None, "b", 7), (None, prose(90), "en", None, 1),
        (None, base, "fr", "b", 1), (8, prose(40) + " " + passage + " " + prose(40), "fr", "a", 1),
        (9, prose(30) + " " + passage.replace(" ", "\n") + " " + prose(20), "fr", "b", 1), (10, "a " * 6000, "en", "c", 1),
        (11, prose(30000), "en", "c", 1), (12, "x" * 200_000, "en", "c", 1), (13, "Ünïcode ñandú ß " * 30, "es", "c", 1),
        (14, "\n".join([prose(8)] * 5), "es", "a", 1), (15, "THIS IS LOUD!! " + "AND LOUDER!!! " * 60, "en", "a", 1),
        (16, " ".join("%%%" + w + "###" for w in prose(150).split()), "en", "a", 1),
    ]
    rows += [(100 + k, prose(60 + 5 * k), "en" if k % 3 else "fr", "abc"[k % 3], 1) for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows, with more columns whose names the operators use themselves."""
    frame = spark.createDataFrame(texts, SCHEMA)
    return frame.select("*", *(F.lit(1).alias(c) for c in (
        "kept", "size", "rank", "key", "words", "n_words", "held_out", "score", "place", "gram", "n", "id", "source_size", "distance")))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
