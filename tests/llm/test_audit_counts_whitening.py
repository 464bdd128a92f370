"""Filter interactions, token counts and whitening against brute force."""

from decimal import Decimal
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import chebyshev_whitening, token_counts as counting
from tallygrid.llm.chebyshev_whitening import spectrum, usable, whitening
from tallygrid.llm.filter_audit import FILTERS, filter_audit
from tallygrid.llm.q_tokens import vocabulary
from tallygrid.llm.registry import QUERIES
from tests.llm.conftest import SCHEMA, words_of


# -- filters -----------------------------------------------------------------------------------

def _audit(texts, labels):
    """One document after the other, in each of the 120 orders."""
    smallest = {}
    for i, text, *_ in texts:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    marks = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or quality == 1, bad or toxic == 1)
    rows = []
    for i, text, lang, *_ in texts:
        text = text or ""
        words = words_of(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in text for c in "#$%&*|"), "E": i is not None and i > smallest[text]}
        rows.append((lang or "", {f for f in fails if fails[f]}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_at = {}
        for order in permutations(FILTERS):
            left = own
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_at[order, f] = len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in permutations(FILTERS):
            for step, f in enumerate(order):
                out[part, "".join(order), step + 1].append(sum(n for (_, g), n in removed_at.items() if g == f))
    return out


LABELS = [(1, 1, 0), (2, 1, 1), (2, None, 0), (3, 0, 1), (5, 1, 0), (15, 1, 1), (100, 1, None), (100, 1, 1), (None, 1, 1), (999, 1, 1)]


def test_filters_in_every_order(spark, docs, texts):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("x"))
    found = filter_audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in found} == _audit(texts, LABELS)
    assert len(found) == 600 * 4


def test_no_documents_have_no_parts(spark, no_docs):
    assert filter_audit(no_docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_filters_need_no_product_of_rows(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    plan = filter_audit(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# -- token counts ------------------------------------------------------------------------------

ODD = [
    "a  b", "a\n\nb", "a \n b", "a\n  b\t\tc", " \n", "\n", " a", "a ", "a  ", "\r\n\r\nx", "don't we'll  I'M 'tis", "x  y", "　a   b", "a\x1cb \x1f c",
    "\x85 a", "q <|endoftext|> r", "q  <|endoftext|>\n\ns<|endoftext|>", "<|endoftext|>", "<|endoftext |>", "1234 567,89", "日本語 テスト 。", "😀 😀😀  👩‍👩‍👧", "a\x00b \x0b\x0c c",
    "﻿bom", "a​b  c", "́x", "  ́ é", "  ᠎ x", "tab\tword", "  ,  ,,", "_ __ ___  _",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def _counted(tokenizer, rows):
    return sorted(((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows), key=repr)


def test_token_counts(docs, texts, tokenizer):
    found = counting.token_counts(docs, vocabulary("byte_bpe_50k.json"))
    assert sorted(map(tuple, found.collect()), key=repr) == _counted(tokenizer, [r[:2] for r in texts])


def test_token_counts_of_odd_texts(spark, tokenizer):
    rows = list(enumerate(ODD + [a + b for a in ODD for b in ODD]))
    found = counting.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), vocabulary("byte_bpe_50k.json"))
    assert sorted(map(tuple, found.collect()), key=repr) == _counted(tokenizer, rows)


def test_token_counts_of_nothing(no_docs):
    assert counting.token_counts(no_docs, vocabulary("byte_bpe_50k.json")).collect() == []


def test_token_query_counts_all_documents(spark, small, tokenizer):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op13_token_counts"](spark, small).collect()), key=repr) == _counted(tokenizer, rows)


def test_table_finds_what_it_holds_and_no_more():
    random = np.random.default_rng(3)
    keys = np.unique(random.integers(0, 2**63, counting.HELD).astype(np.uint64))
    keys[:3000] = (keys[:3000] & np.uint64(2**40 - 1)) | np.uint64(5 << 40)  # one slot for all
    keys = np.unique(keys)
    table = counting.PieceTable(keys, np.arange(len(keys), dtype=np.int32))
    assert (table.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(random.integers(0, 2**63, 10000).astype(np.uint64), keys)
    assert (table.find(others) == -1).all()


def test_rare_pieces_are_counted_too(docs, texts, tokenizer, monkeypatch):
    """With a table of three pieces and tiny caches the counts are the same."""
    for name, value in (("NAMED", 3), ("HELD", 3), ("COUNTED", 8)):
        monkeypatch.setattr(counting, name, value)
    found = counting.token_counts(docs, vocabulary("byte_bpe_50k.json"))
    assert sorted(map(tuple, found.collect()), key=repr) == _counted(tokenizer, [r[:2] for r in texts])


# -- whitening ---------------------------------------------------------------------------------

def _eigen(rows, components=8):
    x = np.floor(1024 * np.array(rows, float)) + 100000
    c = x - x.mean(0)
    v = c.T @ c / len(x)
    e, u = np.linalg.eigh(v)
    return c @ u[:, ::-1][:, :components] / np.sqrt(e[::-1][:components]), e[::-1][:components] / np.trace(v)


def _exact(rows):
    x = np.array(np.floor(1024 * np.array(rows, float)) + 100000).astype(np.int64).astype(object)
    y = len(x) * x - x.sum(0)
    return [int(s) for s in (y * y).sum(1)]


def _check(found, ids, rows, components=8):
    whitened, explained = _eigen(rows, components)
    by = {i: sorted((r for r in found if r.vec_id == i), key=lambda r: r.component) for i in ids}
    got = np.array([[r.whitened for r in by[i]] for i in ids])
    assert got.shape == whitened.shape
    signs = np.sign((got * whitened).sum(0))
    assert np.abs(got - whitened * signs).max() < 1e-9
    assert [int(by[i][0].deviation) for i in ids] == _exact(rows)
    assert np.allclose([r.explained for r in by[ids[0]]], explained, rtol=1e-9)
    assert max(r.identity_error for r in found) < 1e-9 and {r.n for r in found} == {len(rows)}


def test_whitening_of_all_embeddings(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    _check(QUERIES["op11_chebyshev_whitening"](spark, small).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_leaves_unusable_vectors_out(spark):
    random = np.random.default_rng(1)
    rows = (random.standard_normal((300, 40)) * np.linspace(1, 4, 40)).astype(np.float32).astype(float).tolist()
    bad = [None, [], [None] * 40, [1.0] * 39 + [None], [1.0] * 39 + [float("nan")], [float("inf")] * 40, [-float("inf")] + [0.0] * 39, [1e300] * 40, [1.0] * 41]
    table = spark.createDataFrame([*enumerate(rows), *((1000 + k, v) for k, v in enumerate(bad))], "vec_id bigint, embedding array<float>")
    table = table.select("*", F.lit(1).alias("n"), F.lit(2).alias("vector"), F.lit(3).alias("whitened")).repartition(5)
    _check(whitening(table).collect(), list(range(300)), rows)


def test_whitening_with_repeats_nulls_and_few_dimensions(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, 1.0, 3.0]), (2, [4.0, -1.0, 2.0]), (3, [0.3, 0.2, 9.0])]
    found = whitening(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert len(found) == 15 and {r.component for r in found} == {1, 2, 3} and max(r.identity_error for r in found) < 1e-9
    assert sum(r.vec_id is None for r in found) == 3


def test_components_without_variance_are_null(spark):
    alike = spark.createDataFrame([(k, [1, 2]) for k in range(4)], "vec_id bigint, embedding array<int>")
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in whitening(alike).collect()} == {(None, 0.0, 0.0, Decimal(0))}
    line = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(4)], "vec_id bigint, embedding array<double>")
    found = whitening(line).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in found] == [False, True] * 4 and np.allclose([r.explained for r in found[:2]], [1.0, 0.0])


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None)]):
        assert whitening(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect() == []


def test_deviation_beyond_64_bits_is_exact(spark, monkeypatch):
    rows = [[1e12, 3.0], [-1e12, 5.0], [7.0, 1e9], [0.25, -1.0]]
    found = whitening(spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")).collect()
    x = [[int(np.floor(1024 * v)) + 100000 for v in r] for r in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((4 * v - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert {r.vec_id: int(r.deviation) for r in found} == dict(enumerate(want)) and max(want) > 2**64


def test_filter_finds_a_direction_that_the_start_misses(spark, monkeypatch):
    """The first block is orthogonal to the leading eigenvector; the new columns of each turn find it."""
    random = np.random.default_rng(2)
    rows = random.standard_normal((400, 60))
    rows[:, 0] *= 5
    real, calls = np.random.default_rng, []

    class Blind:
        def __init__(self, seed):
            self.inner = real(seed)

        def standard_normal(self, shape):
            out = self.inner.standard_normal(shape)
            if not calls:
                out[0] = 0
            calls.append(shape)
            return out

    monkeypatch.setattr(chebyshev_whitening.np.random, "default_rng", Blind)
    table = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id bigint, embedding array<double>")
    found = spectrum(usable(table))
    assert len(calls) > 1 and abs(found.vectors[0, 0]) > 0.9 and found.residual <= chebyshev_whitening.RESIDUAL


def test_flat_spectrum_doubles_the_block(spark):
    """Eigenvalues that differ by a millionth leave the filter nothing to work on; all dimensions at once are exact."""
    d = 80
    rows = np.vstack([np.eye(d) * (100 + np.arange(d)[:, None] * 1e-2), -np.eye(d) * (100 + np.arange(d)[:, None] * 1e-2)])
    table = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id bigint, embedding array<double>")
    found = spectrum(usable(table))
    x = np.floor(1024 * rows)
    assert np.allclose(found.values, np.linalg.eigvalsh((x - x.mean(0)).T @ (x - x.mean(0)) / len(x))[::-1][:8], rtol=1e-12)
