"""Quality rules, classifier and language model against plain reckoning."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallygrid.llm import hidden_markov as H
from tallygrid.llm import robust_outliers as R
from tallygrid.llm.kernel_classifier import RIDGES, isotonic, quality_scores, ridge
from tallygrid.llm.registry import QUERIES
from tests.llm.conftest import words_of


def base_facts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for k in range(len(w) - 4):
        places.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {k + d for v in places.values() if len(v) > 1 for k in v for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_of_odd_rows(docs, texts):
    got = sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in R.robust_quality(docs).collect()), key=str)
    assert got == sorted(((r[0], *base_facts(r[1])) for r in texts), key=str)


def test_quality_query_and_its_estimates(spark, small):
    """Every count, and every verdict from a concentration written out in plain numpy."""
    found = QUERIES["op1_robust_outliers"](spark, small).toPandas().set_index("doc_id")
    rows = spark.read.parquet(f"{small}/documents.parquet").toPandas().set_index("doc_id")
    for i, row in rows.iterrows():
        assert tuple(found.loc[i, list(COLUMNS)]) == base_facts(row.text)
    marks = R.robust_quality(spark.read.parquet(f"{small}/documents.parquet"))
    vectors = marks.select("doc_id", "lang", "source", "base_failed", "distance", "kept", *R._vector()).toPandas()
    x = vectors[[f"x{k}" for k in range(R.P)]].to_numpy(float)
    core = ~vectors.base_failed.to_numpy()
    low, high = 0.0, 1000.0
    for _ in range(100):
        m = (low + high) / 2
        low, high = (m, high) if R.chi_square_cdf(m, R.P) < R.CORE else (low, m)
    factor = R.CORE / R.chi_square_cdf(high, R.P + 2)
    floor = np.eye(R.P) * (R.LEAST_SPREAD * R.SCALE) ** 2

    def concentrated(member):
        own = x[member]
        ordered = np.sort(own, axis=0)
        at = lambda q: ordered[-(-q * len(own) // 4) - 1]
        mean, cov = at(2), np.diag(((at(3) - at(1)) / 1.349) ** 2) + floor
        for _ in range(R.STEPS):
            d = np.einsum("ij,jk,ik->i", own - mean, np.linalg.inv(cov), own - mean)
            bins = np.floor(np.log2(np.maximum(d, 1e-6)) * R.BINS)
            kinds, counts = np.unique(bins, return_counts=True)
            before = np.cumsum(counts) - counts
            near = own[bins <= kinds[before < R.CORE * len(own)].max()]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True).reshape(R.P, R.P) * factor + floor
        return len(near), mean, cov

    def lean(own, mean, cov):
        beyond = max(0, own[0] - R.LEAST_ROWS)
        w = beyond / (beyond + R.PRIOR_ROWS)
        apart = own[1] - mean
        return w * own[1] + (1 - w) * mean, w * own[2] + (1 - w) * cov + w * (1 - w) * np.outer(apart, apart)

    _, mean_all, cov_all = concentrated(core)
    limit = R.chi_square_quantile(R.P, R.TAIL)
    for (lang, source), rows in vectors.groupby(["lang", "source"]):
        of_lang = core & (vectors.lang == lang).to_numpy()
        own = of_lang & (vectors.source == source).to_numpy()
        if not own.any():
            continue
        mean, cov = lean(concentrated(own), *lean(concentrated(of_lang), mean_all, cov_all))
        d = np.einsum("ij,jk,ik->i", x[rows.index] - mean, np.linalg.inv(cov), x[rows.index] - mean)
        assert np.allclose(d, rows.distance, rtol=1e-6)
        assert ((d <= limit) & ~rows.base_failed == rows.kept).all()


def test_quality_keeps_clean_and_rejects_junk(docs):
    kept = {r.doc_id: r.kept for r in R.robust_quality(docs).collect() if r.doc_id}
    assert not any(kept[i] for i in (4, 5, 6, 7, 10, 12, 15, 16)) and all(kept[100 + k] for k in range(40))
    rows = R.kept_by_quality(docs)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect() if r.doc_id} == {i for i, k in kept.items() if k}


def test_quality_of_nothing(no_docs):
    assert R.robust_quality(no_docs).collect() == [] and R.kept_by_quality(no_docs).collect() == []


def test_chi_square():
    assert R.chi_square_cdf(R.chi_square_quantile(8, 0.05), 8) == pytest.approx(0.95)
    assert R.chi_square_quantile(8, 0.05) == pytest.approx(15.507, abs=1e-3)
    assert R.chi_square_quantile(3, 0.05) == pytest.approx(7.815, abs=1e-3)


def test_isotonic():
    x, y = isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 0, 1.0]), np.ones(6))
    assert np.allclose(x, [0, 2.5, 5]) and np.allclose(y, [0, 0.5, 1])


def test_classifier_on_held_out_rows(spark, small):
    found = QUERIES["op9_fourier_quality_classifier"](spark, small).toPandas()
    assert len(found) == 200 and found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    held = found.merge(spark.read.parquet(f"{small}/labels.parquet").toPandas(), on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() > 0.85


def test_classifier_where_labels_are_enough(spark):
    """Accuracy and ranking of rows that were not learnt from."""
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op9_fourier_quality_classifier"](spark, folder).toPandas()
    held = found.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id").query("held_out")
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    above = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert (held.predicted == held.quality).mean() > 0.95 and above > 0.97


def test_penalty_against_leaving_one_out():
    """The chosen penalty predicts left-out rows about as well as the best one."""
    random = np.random.default_rng(1)
    x = np.column_stack((np.ones(80), random.standard_normal((80, 40))))
    y = (x[:, 1] + random.standard_normal(80) > 0).astype(float)

    def left_out(share):
        penalty = np.diag([1e-9] + [share * 80 + 1e-9] * 40)
        hat = x @ np.linalg.inv(x.T @ x + penalty) @ x.T
        return np.mean(((y - hat @ y) / (1 - np.diag(hat))) ** 2)

    weights = ridge(x.T @ x, x.T @ y, 80, y @ y)
    errors = {share: left_out(share) for share in RIDGES}
    chosen = min(RIDGES, key=lambda s: np.abs(np.linalg.solve(x.T @ x + np.diag([1e-9] + [s * 80 + 1e-9] * 40), x.T @ y) - weights).max())
    assert errors[chosen] < 1.1 * min(errors.values())


def test_classifier_of_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (16, 0), (15, 0)] + [(100 + k, 1) for k in range(40)], "doc_id bigint, quality int")
    found = quality_scores(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert quality_scores(no_docs, labels).collect() == []
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def tokens(text):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words_of(text)] + [None]


def expected_base(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(x for (i, t), h in zip(rows, held) if not h for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(k), sum(c[x] > 0 for x in k), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in k), 5))
                   for (i, t), h in zip(rows, held) for k in [tokens(t)]), key=str)


def test_base_scores_of_odd_rows(docs, texts, no_docs):
    found = H.hidden_markov_scores(docs, rounds=1).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found), key=str)
    assert got == expected_base([(r[0], r[1]) for r in texts]) and all(math.isfinite(r.score) for r in found)
    assert H.hidden_markov_scores(no_docs, rounds=1).collect() == []
    alone = H.hidden_markov_scores(docs.where("doc_id IS NULL"), rounds=1).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in alone)


def test_language_model_query(spark, small):
    found = QUERIES["op6_hidden_markov_scores"](spark, small).toPandas()
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found.itertuples()), key=str)
    for a, b in zip(got, expected_base(rows)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=2e-5)
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_forward_and_expected_counts_against_all_paths():
    import itertools
    random = np.random.RandomState(3)
    draw = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(random.rand(*shape))
    model = H.Model(draw(2), draw(2, 2), draw(2, 5))
    sequences = [random.randint(0, 5, n).astype(np.uint16) for n in (1, 4, 6, 6, 3)]
    counts = np.zeros((2, 1 + 2 + 5))
    for s, found in zip(sequences, H.forward(model, sequences)):
        total, own = 0.0, np.zeros_like(counts)
        for path in itertools.product(range(2), repeat=len(s)):
            p = model.start[path[0]] * np.prod([model.emits[z, o] for z, o in zip(path, s)])
            p *= np.prod([model.moves[a, b] for a, b in zip(path, path[1:])])
            total += p
            own[path[0], 0] += p
            for a, b in zip(path, path[1:]):
                own[a, 1 + b] += p
            for z, o in zip(path, s):
                own[z, 3 + o] += p
        assert found == pytest.approx(math.log10(total))
        counts += own / total
    assert np.allclose(H.expected(model, sequences, 5), counts, atol=1e-5)


def test_rounds_raise_the_likelihood():
    random = np.random.RandomState(4)
    sequences = [np.concatenate([random.randint(4 * (k % 2), 4 * (k % 2) + 4, 60)]).astype(np.uint16) for k in range(30)]
    model, before = H.first_model(np.full(8, 1 / 8), 2), -1e9
    for _ in range(5):
        now = H.forward(model, sequences).sum()
        assert now >= before - 1e-6
        before, total = now, H.expected(model, sequences, 8)
        start, moves, emits = total[:, 0], total[:, 1:3], total[:, 3:] + 1e-9
        model = H.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))
