"""Benchmark items whose last sentence is short and edited or left off."""

import random

from pyspark.sql import functions as F

from tallygrid.llm.decontamination import contaminated, split_item


def test_edited_and_missing_short_last_sentences(spark):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    short, missing, four = (prose(30) for _ in range(3))
    half = prose(6)
    items = spark.createDataFrame([
        (1, f"{short}. Yes it is."), (2, f"{missing}. Always."), (3, f"{four}. One two three four."), (4, f"{half}. One two three four."),
        (5, f"{prose(30)}. Not in any text."), (6, f"{half} {prose(10)}. Rather never.")], "item_id bigint, text string")
    question, answer = split_item(F.col("text"))
    items = items.select("item_id", question.alias("question"), answer.alias("answer"))
    docs = spark.createDataFrame([
        (1, f"{prose(80)} {short}. Yes it was. {prose(80)}"), (2, f"{prose(80)} {missing} {prose(80)}"),
        (3, f"{prose(80)} {four}. One two other four. {prose(80)}"), (4, f"{prose(80)} {half}. One two other four. {prose(80)}"),
        (5, prose(200))], "doc_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in contaminated(docs, items).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}
