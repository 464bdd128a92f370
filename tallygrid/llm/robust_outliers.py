"""Quality rules by robust distance: minimum covariance determinant per language and source.

Every text becomes a vector of transformed statistics. For each group (all rows, a
language, a language and source) concentration steps look for the part of its rows, a
share `core`, whose covariance has the least determinant: distances by the present
estimate, the nearest share of the rows, their mean and covariance as the next estimate.
One pass does this for all groups: counts and integer moments per group and distance
bin, combined per task before the shuffle. The nearest bins that hold the share are the
next core. The start is the median and quartile range of each statistic.

A group's estimate leans on that of the level above by `PRIOR_ROWS` rows, and rests on it
wholly up to `LEAST_ROWS`, so a small source is judged by its language. Rows beyond the chi-square quantile are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.shared import map_arrow, written
from tallygrid.llm.text_stats import COUNTS, text_counts

#: Share of a group's rows that its estimate rests on.
CORE = 0.75
STEPS = 4
#: Rows by which the level above weighs in.
PRIOR_ROWS = 60
#: A group whose core has no more rows is judged by the level above alone: five to a statistic.
LEAST_ROWS = 40
#: Chance for a clean, normally spread row to be rejected.
TAIL = 1e-12
#: Statistics are whole multiples of 1 / SCALE, so that their sums do not depend on the order of rows.
SCALE = 1024
#: Least spread of each statistic: one that hardly varies must not reject by a trifle.
LEAST_SPREAD = 0.12
#: Distance bins to a factor of two.
BINS = 32


def _share(part: str, of: Column, weight: float = 10.0) -> Column:
    """A count against another, damped for short texts, on a logarithmic scale."""
    return F.log1p(weight * F.col(part) / (of + 10))


def _bent(value: Column, linear: float = 25.0) -> Column:
    """The value up to `linear` (words of a hundred characters on average), logarithmic beyond, so that squares can be summed."""
    return F.when(value <= linear, value).otherwise(linear * (1 + F.log(value / linear)))


def statistics() -> dict[str, Column]:
    """The statistics of a text out of its counts."""
    words, letters = F.col("n_words"), F.col("n_upper") + F.col("n_lower") + F.col("n_wide")
    return {
        "symbols": _share("n_symbols", words),
        "capitals": _share("n_upper", letters + 20),
        "marks": _share("n_marks", words, 2.0),
        "digits": _share("n_digits", words, 1.0),
        "repeats": _share("n_repeat_words", words),
        "dup_lines": _share("n_dup_lines", F.col("n_lines")),
        # distinct words against what a text of that length usually has, and the length of words
        "variety": 4 * F.log((F.col("n_distinct_words") + 20) / (words + 20)) / F.log(words + 20),
        "word_length": _bent((F.col("word_chars") + 100) / (words + 20) / 4),
    }


P = 8
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi_square_cdf(x: float, k: int) -> float:
    """The chi-square distribution of `k` degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= half / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi_square_quantile(k: int, tail: float) -> float:
    """The value that is exceeded with the chance `tail`."""
    low, high = 0.0, 10.0 * k + 400
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square_tail(middle, k) > tail else (low, middle)
    return high


def _chi_square_tail(x: float, k: int) -> float:
    """The upper tail; for an even number of degrees of freedom a finite sum, exact far out."""
    if k % 2:
        return 1 - chi_square_cdf(x, k)
    half = x / 2
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(k // 2))


def _keys() -> list[Column]:
    """A row's groups; null is a value of its own."""
    return [F.lit("all"), F.concat(F.lit("lang "), F.to_json(F.struct("lang"))),
            F.concat(F.lit("source "), F.to_json(F.struct("lang", "source")))]


_MODEL = "key string, lang_key string, n double, mean array<double>, cov array<double>, inverse array<double>"


def _solved(n: float, mean: np.ndarray, cov: np.ndarray) -> tuple[float, list, list, list]:
    cov = cov + np.diag(np.full(P, (LEAST_SPREAD * SCALE) ** 2))
    return n, mean.tolist(), cov.ravel().tolist(), np.linalg.inv(cov).ravel().tolist()


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    """One estimate per row of `(key, lang_key, n, s0.., q0..)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                n = float(r["n"])
                mean = np.array([float(r[f"s{i}"]) for i in range(P)]) / n
                cov = np.zeros((P, P))
                for k, (i, j) in enumerate(_PAIRS):
                    cov[i, j] = cov[j, i] = float(r[f"q{k}"]) / n - mean[i] * mean[j]
                out.append((r["key"], r["lang_key"], *_solved(n, mean, cov * factor)))
            yield _model_batch(out)

    return map_arrow(moments, run, _MODEL)


def _model_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.float64(), *[pa.list_(pa.float64())] * 3]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["key", "lang_key", "n", "mean", "cov", "inverse"])


def _start(grouped: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each statistic, exact on the whole multiples."""
    values = grouped.select("key", "lang_key", F.posexplode(F.array(*(f"x{i}" for i in range(P)))).alias("at", "x"))
    counted = values.groupBy("key", "lang_key", "at", "x").agg(F.count("x").alias("n"))
    by = Window.partitionBy("key", "at")
    ranked = counted.withColumns({
        "upto": F.sum("n").over(by.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(by)})
    quartiles = ranked.groupBy("key", "lang_key", "at").agg(
        *(F.min(F.when(F.col("upto") * 4 >= k * F.col("all"), F.col("x"))).alias(f"v{k}") for k in (1, 2, 3)))
    rows = quartiles.groupBy("key", "lang_key").agg(F.sort_array(F.collect_list(F.struct("at", "v1", "v2", "v3"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mean = np.array([float(v["v2"]) for v in r["v"]])
                spread = np.array([(v["v3"] - v["v1"]) / 1.349 for v in r["v"]])
                out.append((r["key"], r["lang_key"], *_solved(1.0, mean, np.diag(spread**2))))
            yield _model_batch(out)

    return map_arrow(rows, run, _MODEL)


def _distance() -> Column:
    """Squared Mahalanobis distance of `x0..` by `mean` and `inverse`."""
    d = [F.col(f"x{i}") - F.col("mean")[i] for i in range(P)]
    terms = [(1 if i == j else 2) * F.col("inverse")[i * P + j] * d[i] * d[j] for i, j in _PAIRS]
    return reduce(lambda a, b: a + b, terms)


def _next(grouped: DataFrame, model: DataFrame, core: float, factor: float) -> DataFrame:
    """A concentration step of all groups."""
    bin_ = F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * BINS)
    binned = grouped.join(model.select("key", "mean", "inverse"), "key").withColumn("bin", bin_)
    sums = binned.groupBy("key", "lang_key", "bin").agg(
        F.count("bin").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{k}") for k, (i, j) in enumerate(_PAIRS)))
    by = Window.partitionBy("key")
    nearest = sums.withColumns({
        "before": F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "all": F.sum("n").over(by)}).where(F.col("before") < core * F.col("all"))
    names = ["n", *(f"s{i}" for i in range(P)), *(f"q{k}" for k in range(len(_PAIRS)))]
    moments = nearest.groupBy("key", "lang_key").agg(*(F.sum(c).alias(c) for c in names))
    return written(_estimates(moments, factor), "estimates")


def _leaned(model: DataFrame) -> DataFrame:
    """`(key, mean, inverse)` per language and source, each estimate leaning on the level above."""
    top = model.where("key = 'all'").select(F.col("key").alias("top"), F.col("mean").alias("mean_a"), F.col("cov").alias("cov_a"))
    lang = model.where("key LIKE 'lang %'").select(
        F.col("key").alias("lang_key"), F.col("n").alias("n_l"), F.col("mean").alias("mean_l"), F.col("cov").alias("cov_l"))
    own = model.where("key LIKE 'source %'").join(lang, "lang_key").withColumn("top", F.lit("all")).join(top, "top").drop("top")

    def lean(n, mean, cov, to_mean, to_cov):
        beyond = max(0.0, n - LEAST_ROWS)
        w = beyond / (beyond + PRIOR_ROWS)
        apart = mean - to_mean
        return w * mean + (1 - w) * to_mean, w * cov + (1 - w) * to_cov + w * (1 - w) * np.outer(apart, apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                v = {k: np.array(r[k]) for k in ("mean", "cov", "mean_l", "cov_l", "mean_a", "cov_a")}
                square = {k: v[k].reshape(P, P) for k in ("cov", "cov_l", "cov_a")}
                mean, cov = lean(r["n_l"], v["mean_l"], square["cov_l"], v["mean_a"], square["cov_a"])
                mean, cov = lean(r["n"], v["mean"], square["cov"], mean, cov)
                out.append((r["key"], r["lang_key"], r["n"], mean.tolist(), cov.ravel().tolist(), np.linalg.inv(cov).ravel().tolist()))
            yield _model_batch(out)

    return map_arrow(own, run, _MODEL).select("key", "mean", "inverse")


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    return [F.round(c * SCALE).cast("long").alias(f"x{i}") for i, c in enumerate(statistics().values())]


def _groups_of(docs: DataFrame) -> list[Column]:
    return [docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source")]


def estimates(counted: DataFrame, core: float = CORE) -> DataFrame:
    """`(key, mean, inverse)` per language and source, from `(lang, source, <counts>)` of all rows the base rule leaves."""
    keys = _keys()
    grouped = counted.where(~_failed()).select(
        F.explode(F.array(*keys)).alias("key"), keys[1].alias("lang_key"), *_vector())
    grouped = grouped.withColumn("lang_key", F.when(F.col("key") == "all", F.lit("")).otherwise(F.col("lang_key")))
    # makes the core's covariance that of all rows where these are spread normally
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, P) < core else (low, middle)
    factor = core / chi_square_cdf(high, P + 2)
    model = written(_start(grouped), "estimates")
    for _ in range(STEPS):
        model = _next(grouped, model, core, factor)
    return written(_leaned(model), "estimates")


def judged(counted: DataFrame, model: DataFrame, tail: float = TAIL) -> DataFrame:
    """Counted rows with `base_failed`, `distance` and `kept`."""
    rows = counted.select("*", _failed().alias("base_failed"), *_vector()).withColumn("key", _keys()[2])
    limit = chi_square_quantile(P, tail)
    far = rows.join(model, "key", "left").withColumn("distance", _distance())
    return far.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).select(
        *counted.columns, "base_failed", "distance", "kept")


def robust_quality(docs: DataFrame, core: float = CORE, tail: float = TAIL) -> DataFrame:
    """`(doc_id, lang, source, <counts>, base_failed, distance, kept)` of every row of `docs (doc_id, text, lang, source)`.

    `base_failed`: fewer than 10 words, or more than a fifth of the words in five-word
    windows that the text holds twice or more. `distance` is the squared Mahalanobis
    distance from the estimate of the row's language and source; `kept` is false where
    base_failed, or where the distance exceeds the chi-square quantile of `tail`.

    A null text counts as empty and fails the base rule. Null languages and sources are
    groups of their own. Every row is judged for itself, so repeated rows and doc_ids, null
    ones too, get one result each; a row adds to its group's estimate as often as it comes.
    An empty table gives an empty result. Other columns are ignored.
    """
    counted = written(text_counts(docs, docs["doc_id"], *_groups_of(docs)), "counts")
    return judged(counted, estimates(counted, core), tail)


def kept_by_quality(docs: DataFrame, core: float = CORE, tail: float = TAIL) -> DataFrame:
    """The rows of `docs`, with all their columns, that `robust_quality` keeps.

    Rows are judged where they lie, by a second count that carries them along: texts are not shuffled.
    """
    counted = written(text_counts(docs, *_groups_of(docs)), "counts")
    model = estimates(counted, core)
    rows = text_counts(docs, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *_groups_of(docs))
    return judged(rows, model, tail).where("kept").select("row.*")
