"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

The statistics of a text are standardised and mapped to cosines of random projections,
whose products approximate a Gaussian kernel. Tasks sum the products of their training
rows to normal equations; the sums of all tasks meet per row of the matrix, and the
driver solves systems of fixed size, one for each penalty tried. The raw scores of the training rows, counted in
bins of fixed number, give a monotone calibration by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.robust_outliers import statistics
from tallygrid.llm.shared import map_arrow, written
from tallygrid.llm.text_stats import text_counts

FEATURES = 256
#: Width of the kernel in standard deviations of the statistics.
WIDTH = 3.0
#: Penalties tried, as shares of the number of training rows; generalised cross-validation picks one.
RIDGES = tuple(10.0 ** (k / 2) for k in range(-14, 3))
#: Task sums are added up in two steps, this many groups to a row of the matrix at first.
SALTS = 512
SEED = 20
#: Bins to a unit of raw score; raw scores are held within -1 and 2.
BINS = 1024


def _inputs() -> list[Column]:
    words = F.col("n_words")
    shape = [F.log1p(words) / 4, F.col("n_short_words") / (words + 5), F.col("n_long_words") / (words + 5),
             F.log1p(10 * F.col("n_lines") / (words + 10))]
    return [*statistics().values(), *shape]


def _projection(mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.RandomState(SEED)  # a fixed sequence
    weights = random.standard_normal((len(mean), FEATURES)) / (WIDTH * spread)[:, None]
    return weights, random.uniform(0, 2 * np.pi, FEATURES) - mean @ weights


def _mapped(batch: pa.RecordBatch, n: int, projection: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    x = np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(n)], 1)
    cosines = np.cos(x @ projection[0] + projection[1]) * np.sqrt(2 / FEATURES)
    return np.concatenate((np.ones((len(x), 1)), cosines), 1)


def _normal_equations(train: DataFrame, n: int, projection: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of z z' and z y, with z the mapped statistics after a leading 1."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = _mapped(batch, n, projection)
                y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
                total += z.T @ np.column_stack((z, y))
        at = np.arange(0, total.size + 1, FEATURES + 2, dtype=np.int32)
        salt = np.full(FEATURES + 1, TaskContext.get().partitionId() % SALTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(FEATURES + 1)), pa.array(salt), pa.ListArray.from_arrays(pa.array(at), pa.array(total.ravel()))], ["at", "salt", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        sums = np.sum(rows.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES + 2), axis=0)
        return pa.table({**{c: rows.column(c).slice(0, 1) for c in ("at", "salt")}, "sums": pa.array([sums], pa.list_(pa.float64()))})

    schema = "at bigint, salt bigint, sums array<double>"
    some = map_arrow(train, part, schema).groupBy("at", "salt").applyInArrow(add, schema)
    rows = some.groupBy("at").applyInArrow(add, schema).collect()  # FEATURES + 1 rows
    total = np.array([r.sums for r in sorted(rows, key=lambda r: r.at)]).reshape(-1, FEATURES + 2)
    return total[:, :-1], total[:, -1]


def ridge(squares: np.ndarray, products: np.ndarray, n: int, total: float) -> np.ndarray:
    """Weights under the penalty with the least generalised cross-validation error; the constant has none.

    All that the error needs is in the normal equations and `total`, the sum of squared labels.
    """
    # without the constant: sums about the means, in the axes in which all penalties are diagonal
    means, level = squares[0, 1:] / n, products[0] / n
    values, axes = np.linalg.eigh(squares[1:, 1:] - n * np.outer(means, means))
    values, along = np.maximum(values, 0.0), axes.T @ (products[1:] - n * level * means)
    spread = total - n * level**2
    best, least = None, np.inf
    for share in RIDGES:
        found = along / (values + share * n)
        rest = spread - 2 * found @ along + found @ (values * found)
        free = n - 1 - (values / (values + share * n)).sum()
        error = max(rest, 0.0) / free**2 if free > 1e-6 * n else np.inf
        if best is None or error < least:
            best, least = found, error
    weights = axes @ best
    return np.concatenate(([level - weights @ means], weights))


def isotonic(places: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the blocks of the monotone fit, in ascending order."""
    blocks: list[list[float]] = []
    for x, s, n in zip(places, sums, counts):
        blocks.append([x * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x_n, s_n, n_n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x_n, blocks[-1][1] + s_n, blocks[-1][2] + n_n]
    table = np.array(blocks).reshape(-1, 3)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every row of `docs (doc_id, text)`.

    Learns `labels (doc_id, quality)` of the rows with crc32(doc_id as text) mod `folds` other
    than 0. Only statistics of the whole text go into a score. `predicted` is 1 from
    `threshold` on.

    A null text counts as empty and is scored like one. A null doc_id has no label and is
    held out. Where a doc_id has several labels the least counts; null labels are left out.
    Repeated rows are scored each, and learnt from as often as they come. Without any label
    to learn from all scores are 0.5. An empty table gives an empty result. Other columns are ignored.
    """
    inputs = _inputs()
    n = len(inputs)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = written(text_counts(docs, F.col("doc_id")).select(
        "doc_id", (fold == 0).alias("held_out"), *(c.cast("double").alias(f"x{i}") for i, c in enumerate(inputs))), "statistics")
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    train = written(rows.where("NOT held_out").join(known, "doc_id"), "training")

    names = [f"x{i}" for i in range(n)]
    facts = train.agg(F.count("label"), F.sum(F.col("label") * F.col("label")), *(F.avg(c) for c in names), *(F.stddev_pop(c) for c in names)).first()
    if not facts[0]:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    mean, spread = np.array(facts[2 : n + 2]), np.maximum(np.array(facts[n + 2 :]), 0.05)
    projection = _projection(mean, spread)
    squares, products = _normal_equations(train, n, projection)
    weights = ridge(squares, products, facts[0], float(facts[1]))

    def raw(batch: pa.RecordBatch) -> np.ndarray:
        return np.clip(_mapped(batch, n, projection) @ weights, -1, 2)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.round(raw(batch) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("label")], ["bin", "label"])

    counted = (
        map_arrow(train, scored, "bin bigint, label int").groupBy("bin")
        .agg(F.sum("label").alias("ones"), F.count("bin").alias("n")).orderBy("bin").toPandas()  # at most 3 * BINS + 1 rows
    )
    centres, means = isotonic(*(counted[c].to_numpy(float) for c in ("bin", "ones", "n")))

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(np.interp(raw(batch) * BINS, centres, means), 0, 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(rows, calibrated, "doc_id bigint, held_out boolean, score double, predicted int")
