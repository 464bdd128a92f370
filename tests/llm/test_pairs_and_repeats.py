"""Operators on pairs, repeats, benchmark items and licences."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import words as W
from tallygrid.llm.components import components
from tallygrid.llm.decontamination import contaminated, retrieve, split_item
from tallygrid.llm.jaccard_join import jaccard_join
from tallygrid.llm.license_scan import TEMPLATES, license_scan, templates
from tallygrid.llm.recompression import remove_repeats
from tests.llm.conftest import words_of


def folded(text):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words_of(text)]


def shingle_set(text, size):
    w = folded(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def roots(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def expected_components(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    ids = {i for i, _ in sets if i is not None}
    links = [(a, b) for a, x in sets for b, y in sets
             if None not in (a, b) and a != b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    found = roots(ids, links)
    return sorted(((i, len(s), found.get(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, texts, size, percent):
    got = sorted(map(tuple, jaccard_join(docs, size, percent).collect()), key=str)
    assert got == expected_components([(r[0], r[1]) for r in texts], size, percent)


def test_jaccard_join_of_nothing(no_docs):
    assert jaccard_join(no_docs).collect() == []


def test_jaccard_join_of_a_family(spark):
    """Near copies of one text that mostly do not link with each other directly, in blocks of few rows."""
    import random

    from tallygrid.llm import jaccard_join as J
    r = random.Random(2)
    base = [f"w{k}" for k in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        own = list(base)
        for k in r.sample(range(140), r.choice([1, 2, 4, 6, 9])):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    before, J.BLOCK_ROWS = J.BLOCK_ROWS, 20
    try:
        got = sorted(map(tuple, jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()), key=str)
    finally:
        J.BLOCK_ROWS = before
    assert got == expected_components(rows, 4, 85)


def test_components(spark):
    links = [(5, 6), (6, 7), (7, 8), (8, 9), (9, 2), (20, 21), (21, 22), (22, 20), (3, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {5: 2, 6: 2, 7: 2, 8: 2, 9: 2, 2: 2, 20: 20, 21: 20, 22: 20}


def expected_kept(rows, window):
    first = {}
    for i, t in rows:
        w = words_of(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def test_remove_repeats(docs, texts):
    got = sorted(map(tuple, remove_repeats(docs, 50).collect()), key=str)
    assert got == expected_kept([(r[0], r[1]) for r in texts], 50)


def test_remove_repeats_of_periodic_texts(spark):
    rows = [(1, "a " * 300), (2, "a " * 55 + "b"), (3, "a b " * 40), (4, "c " + "a b " * 30 + "d"), (5, "a a b " * 40), (6, "x " + "a a b " * 21)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, remove_repeats(frame, 50).collect()), key=str) == expected_kept(rows, 50)


def test_remove_repeats_of_nothing(no_docs):
    assert remove_repeats(no_docs).collect() == []


def items(spark, rows):
    question, answer = split_item(F.col("text"))
    return spark.createDataFrame(rows, "item_id bigint, text string").select("item_id", question.alias("question"), answer.alias("answer"))


def test_contaminated(spark, docs, texts):
    held = " ".join(texts[10][1].split()[5:35])
    edited = held.split()
    edited[3] = "other"
    other = "entirely different words that no text of this collection has anywhere. Not even here."
    # longer than a passage
    long_item = " ".join(texts[13][1].split()[100:500])
    found = contaminated(docs, items(spark, [
        (1, held), (2, " ".join(edited).upper()), (3, other), (4, None), (5, ""), (6, "?!"), (None, held), (1, held), (7, long_item)])).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got == {(8, 1), (8, 2), (8, None), (11, 7)} and len(found) == 4


def test_contaminated_without_items_or_documents(spark, docs, no_docs):
    assert contaminated(docs, items(spark, []).limit(0)).collect() == []
    assert contaminated(no_docs, items(spark, [(1, "some words in here")])).collect() == []


def test_retrieval_agrees_with_scoring_all_pairs():
    """Pruning by blocks drops no pair of passage and item above the threshold."""
    import numpy as np

    from tallygrid.llm import decontamination as D
    from collections import namedtuple
    Row = namedtuple("Row", "item_id question answer")
    random = np.random.RandomState(1)
    names = W.mix(np.arange(300, dtype=np.uint64), 5)
    pick = lambda n: names[np.minimum(random.zipf(1.3, n), 300) - 1]
    sequences = [pick(random.randint(6, 150)) for _ in range(60)]
    rows = [Row(k, s[: len(s) // 2].view(np.int64).tolist(), s[len(s) // 2 :].view(np.int64).tolist()) for k, s in enumerate(sequences)]
    held = defaultdict(int)
    for s in sequences:
        for x in np.unique(s).view(np.int64).tolist():
            held[x] += 1
    index = D._built(rows, held, len(rows), np.mean([len(s) for s in sequences]))
    words = np.concatenate([pick(500), sequences[3], pick(200), sequences[40][:70], pick(300)])
    chunks = np.arange(len(words)) // D.STRIDE
    ends = np.zeros(chunks[-1] + 1, bool)
    ends[-1] = True
    score = dict(zip(index.item_keys.tolist(), index.impacts.tolist()))
    by_name = dict(zip(index.names.tolist(), index.terms.tolist()))
    for threshold in (0.2, 0.5):
        wanted = set()
        for c in range(len(ends)):
            terms = {by_name[x] for x in words[(chunks == c) | (chunks == c + 1)].tolist() if x in by_name}
            for item in range(len(rows)):
                if sum(score.get(t * len(rows) + item, 0.0) for t in terms) >= threshold:
                    wanted.add((c, item))
        owner, item, _ = retrieve(index, words, chunks, ends, threshold)
        assert set(zip(owner.tolist(), item.tolist())) == wanted


def test_license_scan(spark):
    line = "Released under the MIT License."
    rows = [(1, f"some text\n{line}\nmore"), (2, line.upper()), (3, "released under  the (mit) license"), (4, None), (5, ""), (6, "License"),
            (None, line), (7, "released under the other agreement of nobody"), (8, "Permission\nis"), (8, line), (9, "word " * 5000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("size", F.lit(1)).withColumn("license_id", F.lit("x"))
    got = {(r.doc_id, r.license_id, r.dice) for r in license_scan(frame, templates(spark)).collect()}
    assert got == {(i, "MIT", 1.0) for i in (1, 2, 3, None, 8)}
    assert license_scan(frame.limit(0), templates(spark)).collect() == []
    assert license_scan(frame, templates(spark).limit(0)).collect() == []
    plan = license_scan(frame, templates(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_license_scan_within_longer_parts(spark):
    """Notices whose line or paragraph goes on, against all stretches as long as a template."""
    mit, wrapped = "Released under the MIT License.", TEMPLATES["BSD-3-Clause"][0].replace(" ", "\r\n", 4)
    rows = [(1, f"{mit} See the file COPYING for details."), (2, "prose " * 300 + mit + " prose" * 300),
            (3, "Copyright (c) 2020 Example Inc. All rights reserved."), (4, f"a b c\r\n\r\n{wrapped}\r\n \r\nd e f"),
            (5, "released under under under under the other words here"), (5, "the the the license mit the released " * 20),
            (6, f"x {mit} y {mit} z"), (6, f"x {mit} y {mit} z"), (7, f"{mit}\nand then {mit} again and again")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.license_id): (r.dice, r.n_parts) for r in license_scan(frame, templates(spark)).collect()}

    def bag(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return [tuple(w[k : k + 2]) for k in range(len(w) - 1)]

    wanted = defaultdict(float)
    for i, text in rows:
        own = bag(text)
        for key, notices in TEMPLATES.items():
            for notice in map(bag, notices):
                parts = [bag(x) for x in (*text.split("\n"), *re.split(r"\r?\n[ \t]*\r?\n", text), text)]
                for part in parts + [own[k : k + len(notice)] for k in range(len(own) - len(notice) + 1)]:
                    dice = 2 * (Counter(part) & Counter(notice)).total() / (len(part) + len(notice))
                    if dice >= 0.7:
                        wanted[i, key] = max(wanted[i, key], dice)
    assert {k: v[0] for k, v in got.items()} == wanted
    assert {(i, "MIT") for i in (1, 2, 6, 7)} | {(4, "BSD-3-Clause")} <= got.keys()
    assert got[7, "MIT"] == (1.0, 1) and got[1, "MIT"] == (1.0, 1)


def test_words_agree_with_split(texts):
    import pyarrow as pa
    column = pa.array([r[1] for r in texts])
    for limit in (64, 1 << 20):
        seen = {}
        for part in W.words(column, limit=limit):
            for r in range(part.last - part.first):
                own = words_of(texts[part.first + r][1])
                numbers = part.hashes[part.at[r] : part.at[r + 1]].tolist()
                assert len(own) == len(numbers)
                for w, n in zip(own, numbers):
                    assert seen.setdefault(w, n) == n
        assert len(set(seen.values())) == len(seen)


def test_digest_of_kept_text(docs):
    row = remove_repeats(docs.where("doc_id = 7"), 50).withColumn("sha", F.sha2("kept_text", 256)).first()
    assert row.sha == hashlib.sha256(b"one two").hexdigest()
