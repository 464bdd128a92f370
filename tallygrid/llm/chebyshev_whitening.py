"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V are found without forming V. A pass over the
data multiplies a block Q of a few vectors: tasks sum C'(CQ) over their centred rows C, Spark
adds the sums up per dimension. A turn puts the block through a polynomial in V, by the
three-term recurrence of the Chebyshev polynomials, one pass a degree. On the interval of
unwanted eigenvalues the polynomial stays below one, beyond it grows fast. QR and
Rayleigh-Ritz follow. The interval ends at the block's own smallest Ritz value.

The result is certified, not assumed. All wanted vectors have to leave a residual near the
rounding of doubles, and the last columns of every block are new random ones, so that a direction the
block has missed would show up above the wanted eigenvalues in the turn that follows. Where the
spectrum is so flat that a turn gains little the block doubles, up to all dimensions,
where Rayleigh-Ritz is exact.

Rows are kept between passes as packed whole numbers, some thousands to a Parquet row, so a pass
is one read of contiguous memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructField, StructType

from tallygrid.llm.shared import map_arrow, written

COMPONENTS = 8
#: x = floor(SCALE * entry) + SHIFT
SCALE, SHIFT = 1024.0, 100_000
#: Passes in a turn of the filter.
DEGREE = 12
#: Block columns to a wanted component, and how many columns are new in every turn.
WIDTH, NEW = 4, 4
#: A turn that gains less than this doubles the block.
LEAST_GAIN = 10.0
#: Residuals of wanted vectors, over the largest eigenvalue.
RESIDUAL = 1e-13
_BLOCK_BYTES = 4 << 20
#: Entries whose x is no 64-bit number are not finite for this purpose.
_LARGEST = float(1 << 52)
_SEED = 11


@dataclass(frozen=True)
class Spectrum:
    """What is known of the fit list: its size, dimension sums, and leading components."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray      # a column per component
    values: np.ndarray       # their eigenvalues, falling
    trace: float
    residual: float          # the largest of the wanted vectors', over the largest eigenvalue
    passes: int


def usable(embeddings: DataFrame) -> DataFrame:
    """The rows whose vector has finite entries only, as `vector array<double>`; of those the commonest length."""
    entry = "transform(embedding, e -> cast(e as double))"
    rows = embeddings.select("vec_id", F.expr(entry).alias("vector")).where(
        # NaN is above every number
        f"size(vector) > 0 and not exists(vector, e -> e is null or abs(e) > {_LARGEST}D)")
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0].d if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """x of a column of vectors of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(SCALE * values).astype(np.int64)


def _packed(rows: DataFrame) -> DataFrame:
    """x - SHIFT of many vectors as one binary value, in 4 bytes an entry where they fit."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            step = max(1, _BLOCK_BYTES // (8 * x.shape[1]))
            for k in range(0, len(x), step):
                part = x[k : k + step]
                wide = bool(np.abs(part).max() >= 1 << 31)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int64()), pa.array([wide]), pa.array([part.astype("<i8" if wide else "<i4").tobytes()], pa.binary())],
                    ["n", "wide", "x"])

    return map_arrow(rows.select("vector"), pack, "n bigint, wide boolean, x binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, wide, x in zip(*(batch.column(k) for k in range(3))):
            yield np.frombuffer(x.as_buffer(), "<i8" if wide.as_py() else "<i4").reshape(n.as_py(), -1).astype(np.int64)


def _sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors, and exact sums of x - SHIFT per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = high = low = 0
        for x in _blocks(batches):
            # two halves, so no task's sums can exceed 64 bits
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    parts = map_arrow(blocks, add, "dim bigint, n bigint, high bigint, low bigint")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    rows = sorted(parts.groupBy("dim").agg(*exact).collect())  # one row per dimension
    return int(rows[0].n) if rows else 0, [(int(r.high) << 32) + int(r.low) for r in rows]


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and what they leave, so that centring rounds once."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole)])


def _products(blocks: DataFrame, n: int, centre: tuple[np.ndarray, np.ndarray], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """V q, and the diagonal of V, by one pass."""
    whole, rest = centre
    names = [f"y{j}" for j in range(q.shape[1])]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(whole), q.shape[1] + 1))
        for x in _blocks(batches):
            c = (x - whole) - rest
            total[:, :-1] += c.T @ (c @ q)
            total[:, -1] += np.einsum("ij,ij->j", c, c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *(pa.array(y) for y in total.T.copy())], ["dim", *names, "squares"])

    schema = StructType([StructField("dim", LongType()), *(StructField(c, DoubleType()) for c in (*names, "squares"))])
    parts = map_arrow(blocks, multiply, schema)
    # a row per dimension
    rows = sorted(parts.groupBy("dim").agg(*(F.sum(c).alias(c) for c in (*names, "squares"))).collect())
    total = np.array([r[1:] for r in rows]) / n
    return total[:, :-1], total[:, -1]


def _filtered(multiply, block: np.ndarray, bound: float, top: float, degree: int) -> np.ndarray:
    """The block times the Chebyshev polynomial of V that stays small on [0, bound], scaled to one at `top`."""
    half = bound / 2
    first = scale = half / (top - half)
    before, now = block, (multiply(block) - half * block) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (multiply(now) - half * now) * (2 * after / half) - scale * after * before
        scale = after
    return now


def spectrum(rows: DataFrame, components: int = COMPONENTS, degree: int = DEGREE) -> Spectrum:
    """The leading `components` of the covariance of `usable` rows, certified to double precision."""
    blocks = written(_packed(rows), "vectors")
    n, sums = _sums(blocks)
    if not n:
        return Spectrum(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    d, centre, passes = len(sums), _centre(n, sums), 0
    diagonal = np.zeros(d)

    def multiply(q: np.ndarray) -> np.ndarray:
        nonlocal passes, diagonal
        passes += 1
        product, diagonal = _products(blocks, n, centre, q)
        return product

    random = np.random.default_rng(_SEED)
    wanted = min(components, d)
    block = np.linalg.qr(random.standard_normal((d, min(d, WIDTH * wanted + NEW))))[0]
    before, seen = np.inf, None
    while True:
        product = multiply(block)
        values, turn = np.linalg.eigh((block.T @ product + product.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = block @ turn
        top = max(float(values[0]), 0.0)
        left = np.linalg.norm(product @ turn[:, :wanted] - vectors[:, :wanted] * values[:wanted], axis=0).max()
        residual = float(left / top) if top else 0.0
        # new columns took part in this turn, and what is wanted has not moved
        same = seen is not None and np.allclose(values[:wanted], seen, rtol=1e-10, atol=1e-10 * top)
        if len(block.T) == d or not top or (residual <= RESIDUAL and same):
            break
        width = len(block.T)
        if residual > RESIDUAL and before / max(residual, 1e-300) < LEAST_GAIN and before < np.inf:
            width = min(d, 2 * width)
        before, seen = residual, values[:wanted]
        kept = min(len(block.T) - NEW, width)
        start = np.linalg.qr(np.hstack([vectors[:, :kept], random.standard_normal((d, width - kept))]))[0]
        if width == d:
            block = start
            continue
        bound = max(float(values[kept - 1]), 1e-12 * top)
        block = np.linalg.qr(_filtered(multiply, start, bound, top, degree))[0]
    vectors, values = vectors[:, :wanted], np.maximum(values[:wanted], 0.0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(wanted)] < 0, -1.0, 1.0)
    return Spectrum(n, tuple(s + n * SHIFT for s in sums), vectors, values, float(diagonal.sum()), residual, passes)


def _projector(found: Spectrum) -> np.ndarray:
    """Columns that whiten; a component without variance has none (NaN)."""
    flat = found.values <= len(found.sums) * np.finfo(float).eps * found.trace
    return found.vectors / np.where(flat, np.nan, np.sqrt(np.where(flat, 1.0, found.values)))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over dimensions of (n * x - S)^2."""
    y = n * x.astype(float) - np.array(sums, float)
    if np.einsum("ij,ij->i", y, y).max(initial=0) < 2.0**62 and n * float(np.abs(x).max(initial=0)) < 2.0**62:
        y = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    y = n * x.astype(object) - np.array(sums, object)
    return (y * y).sum(1).tolist()


def whitened(rows: DataFrame, found: Spectrum) -> DataFrame:
    """`(vec_id, deviation decimal(38,0), whitened array<double>)` of `usable` rows; `deviation` is exact, null beyond 38 digits."""
    n, sums, project = found.n, [s - found.n * SHIFT for s in found.sums], _projector(found)
    whole, rest = _centre(n, sums) if n else (np.zeros(0, np.int64), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            y = ((x - whole) - rest) @ project
            far = [Decimal(v) if v < 10**38 else None for v in _deviation(x, n, sums)]
            offsets = np.arange(len(x) + 1, dtype=np.int32) * y.shape[1]
            values = pa.array(y.ravel(), from_pandas=True)  # NaN is null
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(far, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(offsets), values)],
                ["vec_id", "deviation", "whitened"])

    schema = StructType([
        rows.schema["vec_id"], StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])
    return map_arrow(rows.select("vec_id", "vector"), run, schema)


def identity_error(rows: DataFrame, found: Spectrum) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    n, project = found.n, _projector(found)
    project = project[:, ~np.isnan(project).any(0)] if n else project
    if not project.size:
        return 0.0
    whole, rest = _centre(n, [s - n * SHIFT for s in found.sums])
    k = project.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                y = ((_matrix(batch.column(0)) - whole) - rest) @ project
                total[:k] += y.T @ y
                total[k] += y.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    parts = map_arrow(rows.select("vector"), add, "at bigint, v double")
    total = np.array([r.v for r in sorted(parts.groupBy("at").agg(F.sum("v").alias("v")).collect())]).reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitening(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """`(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error)` per usable row and component.

    Reads `vec_id` and `embedding` (an array of any number type) only. Vectors that are null or empty, or
    hold null, NaN, infinite or absurd (above 2**52) entries, are dropped, and so are those
    of another length than the commonest (the shorter one of ties). Repeated rows, and null vec_ids, are
    rows like others. A component without variance (all vectors alike, or fewer of them than
    components) has whitened null and is left out of `identity_error`. With fewer
    dimensions than `components` there are as many components. No usable row: no rows.
    """
    rows = usable(embeddings)
    found = spectrum(rows, components)
    error = identity_error(rows, found)
    share = [float(e / found.trace) if found.trace > 0 else 0.0 for e in found.values]
    out = whitened(rows, found).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, share or [0.0])), F.col("at") + 1)
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation",
        "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
