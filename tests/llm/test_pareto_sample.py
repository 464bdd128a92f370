"""Which documents the mix takes, against one document after the other."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from tallygrid.llm.shared import written
from tallygrid.llm.source_mixing import LENGTH_POWER, LIMIT, NEAR, _targets, mixed
from tests.llm.conftest import words_of


def _sample(rows, target):
    """`rows (drawn, size)` of a source: certain copies, then down the Pareto ranks whatever fits."""
    classes = defaultdict(int)
    for _, size in rows:
        if size:
            classes[int(math.log2(size))] += size
    full = set()
    while True:
        rest = sum(w * 2 ** (LENGTH_POWER * c) for c, w in classes.items() if c not in full)
        level = (target - LIMIT * sum(classes[c] for c in full)) / rest if rest else 0.0
        over = {c for c in classes if c not in full and level * 2 ** (LENGTH_POWER * c) >= LIMIT}
        if not over:
            break
        full |= over
    copies = {c: float(LIMIT) if c in full else max(level * 2 ** (LENGTH_POWER * c), 0.0) for c in classes}
    whole = {c: math.floor(x + 1e-12) for c, x in copies.items()}
    chance = {c: max(copies[c] - whole[c], 0.0) for c in classes}
    rest = target - sum(whole[c] * w for c, w in classes.items())
    left, ranked = math.floor(rest), []
    for drawn, size in rows:
        c = int(math.log2(size)) if size else None
        if size and chance[c] > 0:
            u = (((drawn % 2**64) >> 12) + 0.5) / 2.0**52
            p = max(chance[c], 1e-15)
            ranked.append((math.log2(u / (1 - u)) - math.log2(p / (1 - p)), drawn, size))
    taken = set()
    for _, drawn, size in sorted(ranked):
        if taken and left <= NEAR * rest:
            break
        if size <= left:
            taken.add(drawn)
            left -= size
    nearer = [(rank, drawn) for rank, drawn, size in sorted(ranked) if drawn not in taken and size < 2 * left]
    taken |= {nearer[0][1]} if nearer else set()
    return {drawn: (whole[int(math.log2(size))] if size else 0) + (drawn in taken) for drawn, size in rows}


def _check(docs):
    got = mixed(docs).join(docs.select(F.col("doc_id").alias("i"), "source"), F.col("doc_id") == F.col("i")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rows in by.values():
        want = _sample([(r.drawn, r["size"]) for r in rows], rows[0].target)
        assert {r.drawn: r.copies for r in rows} == want


def test_the_sample_is_the_pareto_one(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _check(docs)
    few = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "most").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 40)))
    _check(few)


def test_levels_of_many_sources(spark):
    """Targets against sharing round by round."""
    sizes = [int(1.4**k) % 5000 + k for k in range(200)] + [0, 0, 10**7]
    found = _targets(spark.createDataFrame([(f"s{k:03}", s) for k, s in enumerate(sizes)], "source string, source_size bigint"), (1, 2, 3), 3)
    weights = [k % 3 + 1 for k in range(len(sizes))]
    stopped, total = set(), sum(sizes)
    while True:
        rest = total - sum(3 * sizes[k] for k in stopped)
        level = rest / sum(w for k, w in enumerate(weights) if k not in stopped)
        over = {k for k, w in enumerate(weights) if k not in stopped and level * w > 3 * sizes[k]}
        if not over:
            break
        stopped |= over
    want = [3 * s if k in stopped else level * weights[k] for k, s in enumerate(sizes)]
    got = [r.target for r in found.orderBy("source").collect()]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want))


def test_plan_stays_small(spark, docs):
    plan = mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 20


def test_turns_do_not_add_passes(spark, monkeypatch):
    """Sources that need many turns cost as many written tables as those that need two."""
    from tallygrid.llm import source_mixing

    labels = []
    monkeypatch.setattr(source_mixing, "written", lambda frame, label: labels.append(label) or written(frame, label))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _check(docs.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 30)))
    assert len(labels) == len(set(labels)) <= 9


def test_repeated_rows_that_do_not_fit_together(spark):
    """Two rows alike, one of which would fit: both are passed over, and the sample goes on."""
    texts = [(k, "word " * (20 + k % 40), "ab"[k % 2]) for k in range(120)]
    rows = mixed(spark.createDataFrame(texts + texts, "doc_id bigint, text string, source string")).collect()
    assert len(rows) == 240
    for size in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == size]
        assert len({(r.doc_id, r.copies) for r in own}) == len({r.doc_id for r in own})
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= 40
