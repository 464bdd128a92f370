"""Licence scan: parts of texts against licence templates by the Dice coefficient of word bigrams.

Built-in functions only. Texts are compared by line, by paragraph, as a whole, and by every stretch
that is as long as a template. A part and a template are bags of bigrams of normalised words; where
one is so much longer than the other that even full agreement stays below the threshold, the pair is
not formed. Texts that lack words without which no template is reached are passed over first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.shared import written

#: Dice coefficient in percent from which a part counts as the licence.
PERCENT = 70
#: Up to so many templates, texts are first looked through for their telling words.
TELLING_TEMPLATES = 100
BLANK_LINES = r"\r?\n(?:[ \t]*\r?\n)+"

# Common notices of public licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "all-rights-reserved": ["Copyright. All rights reserved."],
}

#: All of ASCII but digits and small letters parts words.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WITHIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """`(license_id, text)` of the built-in notices, or of others."""
    rows = [F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, v in (texts or TEMPLATES).items() for t in v]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), APART, " "))
    return F.array_remove(F.split(plain, " "), "")  # an empty text splits into one empty word


def _bigrams(frame: DataFrame, *keys: str) -> DataFrame:
    """`(keys, size, gram, times)` of the column `words`."""
    grams = F.transform(
        F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
    return frame.where("size(words) >= 2").select(*keys, (F.size("words") - 1).alias("size"), F.explode(grams).alias("gram"))


def _telling_words(notices: list[list[str]], percent: int) -> list[str]:
    """Words of which a text holds one if a stretch of it can reach the threshold; none where only some would tell."""
    chosen: list[str] = []
    for words in notices:
        pairs = list(zip(words, words[1:]))
        least = -(-percent * len(pairs) // (200 - percent))  # a stretch of only shared bigrams
        left = [p for p in pairs if not any(w in chosen for w in p)]
        for word in sorted({w for w in words if w.isascii()}, key=lambda w: (-len(w), w)):
            if len(left) < least:
                break
            if any(word in p for p in left):
                chosen.append(word)
                left = [p for p in left if word not in p]
        if len(left) >= least:
            return []
    return chosen


def _stretches(rows: DataFrame, notices: DataFrame, percent: int) -> DataFrame:
    """`(doc_id, row, license_id, template, notice_size, place, dice)` of stretches as long as a template anywhere in
    `rows (doc_id, words)`.

    A stretch that begins without a shared bigram shares no more than the one that begins at its
    first shared bigram, so only those are counted. A shared bigram counts where the one that stands
    `in_notice` places of its kind earlier is before the stretch.
    """
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
    text_keys = ["doc_id", "row", "license_id", "template", "notice_size"]
    # equal rows of a document have equal places
    places = (
        rows.where("size(words) >= 2").select("doc_id", F.xxhash64("words").alias("row"), F.posexplode(grams).alias("place", "gram"))
        .join(notices, "gram").groupBy(*text_keys, "gram", "in_notice").agg(F.sort_array(F.collect_set("place")).alias("places"))
    )
    hits = F.transform("places", lambda at, i: F.struct(
        at.alias("place"), F.when(i >= F.col("in_notice"), F.get("places", (i - F.col("in_notice")).cast("int"))).otherwise(-1).alias("back")))
    able = places.groupBy(*text_keys).agg(
        F.sort_array(F.flatten(F.collect_list(hits))).alias("hits"),
        F.sum(F.least(F.size("places").cast("bigint"), "in_notice")).alias("most"),
    ).where(100 * F.col("most") >= percent * F.col("notice_size"))

    def stretch(first: Column, i: Column) -> Column:
        shared = F.aggregate(F.slice("hits", i + 1, F.col("notice_size")), F.lit(0), lambda n, x: n + (
            (x["place"] < first["place"] + F.col("notice_size")) & (x["back"] < first["place"])).cast("int"))
        return F.struct(first["place"].alias("place"), shared.alias("shared"))

    found = able.select(*text_keys, F.explode(F.filter(
        F.transform("hits", stretch), lambda s: 100 * s["shared"] >= percent * F.col("notice_size"))).alias("s"))
    return found.select(*text_keys, "s.place", (2.0 * F.col("s.shared") / (2 * F.col("notice_size"))).alias("dice"))


def license_scan(docs: DataFrame, licenses: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`(doc_id, license_id, dice, n_parts)`: the licences that the texts of `docs (doc_id, text)` name.

    A part is a line, a paragraph (ended by a blank line) or a whole text; a pair of part
    and template of `licenses (license_id, text)` counts where 200 * shared bigrams >= `percent` *
    (bigrams of the part + bigrams of the template). So does every stretch of a text that has as many
    words as the template, wherever it begins. `dice` is the best of a document, `n_parts` how many of
    its parts reach the threshold, equal ones once; 1 where only stretches within longer parts do.

    Null and empty texts and parts of one word name nothing; templates of less than two words
    are never found. A null doc_id is a document of its own, null license_ids likewise; rows
    that repeat a doc_id are parts of one document. Without templates or documents the result is
    empty. Other columns are ignored.
    """
    notices = licenses.select("license_id", _words(F.col("text")).alias("words")).distinct()
    # a part outside these sizes cannot reach the threshold with any template
    least, most = notices.where("size(words) >= 2").agg(F.min(F.size("words") - 1), F.max(F.size("words") - 1)).first()
    fits = F.size("words").between((percent * (least or 0)) // (200 - percent) + 1, (200 - percent) * (most or 0) // percent + 2)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    few = notices.where("size(words) >= 2").select("words").limit(TELLING_TEMPLATES + 1).collect()
    telling = _telling_words([r.words for r in few], percent) if len(few) <= TELLING_TEMPLATES else []
    if telling:
        # one expression, so that the text is folded once; other letters than A-Z are parts of words in either case
        docs = written(docs.where(F.lower(text).rlike(rf"(?<!{_WITHIN})(?:{'|'.join(telling)})(?!{_WITHIN})")), "licence_texts")
    notices = _bigrams(notices.withColumn("template", F.xxhash64("license_id", "words")), "license_id", "template").groupBy(
        "license_id", "template", "size", "gram").agg(F.count("gram").alias("in_notice")).withColumnRenamed("size", "notice_size")

    parts = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, BLANK_LINES), F.array(text)))
    # words come out of the explode, so that the filter behind it does not work them out again
    rows = docs.select("doc_id", F.explode(F.transform(parts, _words)).alias("words"))
    # equal word sequences of a document are one part, wherever they stand
    rows = rows.where(fits & (F.size("words") >= 2)).withColumn("part", F.xxhash64("words"))
    shared = (
        _bigrams(rows, "doc_id", "part")
        .join(notices, "gram")
        .where(200 * F.least("size", "notice_size") >= percent * (F.col("size") + F.col("notice_size")))
        .groupBy("doc_id", "part", "size", "license_id", "template", "notice_size", "gram")
        .agg(F.least(F.count("gram"), F.first("in_notice")).alias("shared"))
    )
    found = shared.groupBy("doc_id", "part", "size", "license_id", "template", "notice_size").agg(F.sum("shared").alias("shared")).where(
        200 * F.col("shared") >= percent * (F.col("size") + F.col("notice_size")))
    dice = 2.0 * F.col("shared") / (F.col("size") + F.col("notice_size"))
    whole = docs.select("doc_id", F.explode(F.array(_words(text))).alias("words"))
    either = found.select("doc_id", "license_id", dice.alias("dice"), "part").unionAll(
        _stretches(whole, notices, percent).select("doc_id", "license_id", "dice", F.lit(None).cast("bigint").alias("part")))
    return either.groupBy("doc_id", "license_id").agg(
        F.max("dice").alias("dice"), F.greatest(F.count_distinct("part"), F.lit(1)).alias("n_parts"))
