"""Sources mixed to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected number of copies grows slowly
with its length, within the limit; a source's documents together are expected to give its
target. The whole part of the expected number is taken for certain. The rest, p, is an
inclusion chance: documents are ranked by the odds of a fixed random number over the odds
of p, and the first ones are taken until the source's sample has its size, measured in
words. Where the next document is too long for what is left, the sample goes on, in the same order, with
those that are not, turn by turn until the size is met or nothing fits; so the last document's
worth of words, and no more, prefers short texts.

The cut is found without sorting: ranks are whole numbers of 48 bits, and three levels of a plan narrow it by 16 bits
each, with sums per source and bin combined per task before the shuffle. No task holds more
than 65,536 bins of a source.

Of the rows behind the cut, those of one length are taken in the order of their ranks until one does not fit, and none
after it; the same plan, by source and length, finds how many that can be at most. Less is left than the row at the cut
has words, so these are few, however many rows the source has: they are sorted and walked through, and all further turns
together cost one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm import words as W
from tallygrid.llm.shared import map_arrow, written

#: Copies of a document, and words of a source against its own, at most.
LIMIT = 3
WEIGHTS = (1, 2, 3)
#: Expected copies grow with this power of the length.
LENGTH_POWER = 0.25
SEED = 4
#: A sample is met when less than this share of its source's target is left.
NEAR = 1e-4
_BITS, _LEVELS = 16, 3
_PARTS = 64


def _sized(docs: DataFrame) -> DataFrame:
    """`(doc_id, source, drawn, size)`: words of each whole text, and the row's random number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = W.buffers(batch.column("text"))
            sizes = [len(data[offsets[r] : offsets[r + 1]].tobytes().split()) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "source", "drawn")), pa.array(sizes, pa.int64())],
                ["doc_id", "source", "drawn", "size"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), row_number_of(docs).alias("drawn"), "text")
    return map_arrow(rows, count, "doc_id bigint, source string, drawn bigint, size bigint")


def row_number_of(docs: DataFrame):
    """A number that depends on a row's doc_id and text only."""
    return F.xxhash64(F.lit(SEED), docs["doc_id"], docs["text"])


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in code point order, null last; no task holds them all."""
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    rows = written(ordered.withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for r in rows.groupBy(part.alias("part")).agg(F.count("at").alias("n")).orderBy("part").collect():  # a row per task
        offsets.append((r.part, before))
        before += r.n
    offsets = rows.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    return rows.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn(
        "sid", F.col("before") + F.col("at") - F.shiftleft("part", 33)).drop("part", "before", "at")


def _targets(sources: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """Targets by weight that stop at `limit` times a source's size, the excess reshared by weight."""
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = written(_ranked(sources).withColumn("weight", weight), "weights")
    most = limit * F.col("source_size")
    # the level at which targets stop, from below: first by bins of sources that stop at about the same one
    ratio = F.floor(F.log2(most / F.col("weight")) * _PARTS)
    bins = rows.groupBy(F.when(most > 0, ratio).alias("bin")).agg(F.sum(most).alias("most"), F.sum("weight").alias("weight")).collect()
    total = float(sum(r.most or 0 for r in bins)) / limit
    level = _level(total, [(2.0 ** ((r.bin + 1) / _PARTS) if r.bin is not None else 0.0, float(r.most), r.weight) for r in bins])
    while True:  # then exactly, among the sources of one bin
        stopped = F.lit(level) * F.col("weight") > most
        fixed, open_ = rows.agg(
            F.sum(F.when(stopped, most).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        now = (total - fixed) / open_ if open_ else level
        if now <= level:
            break
        level = now
    return rows.withColumn("target", F.least(F.lit(level) * F.col("weight"), most.cast("double")))


def _level(total: float, bins: list[tuple[float, float, float]]) -> float:
    """A level that the true one is not below, from `(level at which all of it has stopped, words at most, weight)` of bins."""
    level = 0.0
    while True:
        fixed = sum(most for edge, most, _ in bins if edge < level)
        open_ = sum(weight for edge, _, weight in bins if edge >= level)
        now = (total - fixed) / open_ if open_ else level
        if now <= level:
            return level * (1 - 1e-12)
        level = now


def _copies(classes: DataFrame, limit: float) -> DataFrame:
    """For each source and length class, the copies taken for certain and the chance of one more."""

    def solve(rows: pa.Table) -> pa.Table:
        length = rows.column("length").to_numpy()
        words = rows.column("words").to_numpy().astype(float)
        target = rows.column("target")[0].as_py()
        wish = 2.0 ** (LENGTH_POWER * length)
        copies = np.zeros(len(words))
        full = np.zeros(len(words), bool)
        while True:  # at most one round per class
            rest = words[~full] @ wish[~full]
            level = (target - limit * words[full].sum()) / rest if rest > 0 else 0.0
            over = ~full & (level * wish >= limit)
            if not over.any():
                break
            full |= over
        copies = np.where(full, limit, np.maximum(level * wish, 0.0))
        whole = np.floor(copies + 1e-12)
        chance = np.maximum(copies - whole, 0.0)
        rest = target - whole @ words
        return rows.append_column("whole", pa.array(whole.astype(np.int64))).append_column(
            "chance", pa.array(chance)).append_column("rest", pa.array(np.full(len(words), rest)))

    schema = f"{classes._jdf.schema().toDDL()}, whole bigint, chance double, rest double"
    return classes.groupBy("sid").applyInArrow(solve, schema)  # some 40 classes to a source


def _cuts(rows: DataFrame, state: DataFrame, *by: str) -> DataFrame:
    """`(*by, cut, before)`: the rank at which the words of a group's `rows (*by, rank, size)` would exceed its `left`,
    and their words before it. A group whose rows all fit has no row."""
    found = state.select(*by, F.lit(0).cast("bigint").alias("cut"), F.lit(0).cast("bigint").alias("before"), "left")
    bins_of = Window.partitionBy(*by).orderBy("bin")
    for level in range(1, _LEVELS + 1):
        shift = _BITS * (_LEVELS - level)
        inside = rows.join(found, [*by]).where(F.shiftright("rank", shift + _BITS) == F.col("cut"))
        bins = inside.groupBy(*by, F.shiftright("rank", shift).alias("bin")).agg(
            F.sum("size").alias("words"), F.first("before").alias("before"), F.first("left").alias("left"))
        upto = bins.withColumn("upto", F.col("before") + F.sum("words").over(bins_of)).where("upto > left")
        found = upto.groupBy(*by).agg(
            F.min("bin").alias("cut"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before"), F.first("left").alias("left"))
    return found.select(*by, "cut", "before")


_PICKS = "sid bigint, rank bigint, longest bigint, words bigint, turn bigint"


def _fitting(units: DataFrame) -> DataFrame:
    """`_PICKS`: the units that fit in turn what is left of their source, and the turn each is taken in.

    A turn begins with what is left, passes over what is longer, and ends at the first unit that does
    not fit any more. A row without rank tells that its source needs that turn.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, left, fits, turn = None, 0, 0, 0
        for batch in batches:
            out = []
            for sid, rank, words, longest, most, enough in zip(*(c.to_pylist() for c in batch.columns)):
                if sid != source:
                    source, left, fits, turn = sid, most, most, 2  # the first turn was up to the cut
                if words <= left:
                    left -= words
                    out.append((sid, rank, longest, words, turn))
                elif words <= fits:
                    fits, turn = left, turn + 1
                    if left > enough:
                        out.append((sid, None, None, None, turn))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 5)], ["sid", "rank", "longest", "words", "turn"])

    ordered = units.select("sid", "rank", "words", "longest", "left", "enough").repartition("sid").sortWithinPartitions("sid", "rank")
    return map_arrow(ordered, walk, _PICKS)


def _turns(rows: DataFrame, rests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(sid, cut)` and `(sid, rank, longest)`: a ranked row is taken before its source's cut, or with a rank of the second
    table if it is not above `longest`.

    The first turn takes rows of any size up to the cut; each further one those that fit what is left, until every
    source's sample is met or nothing fits. At the end one more row is taken if the sample comes nearer to its size by it.
    """
    ends = F.lit(1 << (_BITS * _LEVELS))
    state = rests.select("sid", "rest", F.floor("rest").alias("left"))
    after = state.join(_cuts(rows, state, "sid"), "sid", "left")
    state = written(after.select(
        "sid", F.coalesce("cut", ends).alias("cut"), F.when(F.col("cut").isNotNull(), F.col("left") - F.col("before")).otherwise(0).alias("left"),
        F.greatest(F.lit(0.0), NEAR * F.col("rest")).alias("enough")), "cuts")
    # rows of one rank are repeats and stand together; longer ones would not bring the sample nearer to its size
    behind = rows.join(state.where("left > 0"), "sid").where("rank >= cut and size < 2 * left").groupBy("sid", "rank").agg(
        F.sum("size").alias("words"), F.max("size").alias("longest"), F.first("left").alias("left"), F.first("enough").alias("enough"))
    behind = written(behind.where("words < 2 * left"), "behind")
    picks = state.sparkSession.createDataFrame([], _PICKS)
    if state.where("left > enough").limit(1).collect():
        fit = behind.where("words <= left")
        by_length = fit.select("sid", F.col("words").alias("length"), "rank", F.col("words").alias("size"), "left")
        cuts = _cuts(by_length.drop("left"), by_length.select("sid", "length", "left").distinct(), "sid", "length")
        few = fit.join(cuts.withColumnRenamed("length", "words"), ["sid", "words"], "left").where("cut is null or rank <= cut")
        picks = written(_fitting(few), "picks")
        turns = max(2, picks.where("rank is null").agg(F.max("turn")).first()[0] or 0)  # as many as the source that needs most
        picks = picks.where((F.col("turn") <= turns) & F.col("rank").isNotNull())
    took = picks.groupBy("sid").agg(F.sum("words").alias("took"))
    now = F.col("left") - F.coalesce("took", F.lit(0))
    last = behind.join(picks.select("sid", "rank"), ["sid", "rank"], "left_anti").join(took, "sid", "left").where(
        F.col("words") < 2 * now).groupBy("sid").agg(F.min_by(F.struct("rank", "longest"), "rank").alias("last"))
    kept = picks.select("sid", "rank", "longest").unionAll(last.select("sid", "last.rank", "last.longest"))
    return state.select("sid", "cut"), written(kept, "taken")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """`(doc_id, drawn, size, source_size, target, copies)` of every row of `docs (doc_id, text, source)`.

    `size` is the row's number of words and `source_size` its source's; sources in code point
    order, null last, have the `weights` in turn and share all words, none above `limit`
    times its own. `copies`, 0 to `limit`, is how often the mix takes the row; a source's
    words come near its target (see `_turns`). Reruns agree.

    Null and empty texts have size 0 and are never taken. Null sources are one source, null
    doc_ids are rows like others. Rows that repeat doc_id and text are taken alike, all or none at
    the cut. An empty table gives an empty result. Other columns are ignored. `drawn` is
    `row_number_of` the row, by which a caller finds it.
    """
    sized = written(_sized(docs), "sizes")
    length = F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    classes = sized.groupBy("source", length.alias("length")).agg(F.sum("size").alias("words"))
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = _targets(sources, weights, limit)
    facts = ["sid", "source_size", "target"]
    joined = classes.join(
        targets.select(F.col("source").alias("of_source"), *facts), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    plan = written(_copies(joined, float(limit)), "copies").withColumnsRenamed({"source": "of_source", "length": "of_length"})
    chance = F.greatest("chance", F.lit(1e-15))
    u = (F.shiftrightunsigned("drawn", 12) + 0.5) / float(1 << 52)
    odds = F.log2(u / (1 - u)) - F.log2(chance / (1 - chance))  # between -110 and 110
    rank = F.floor((odds + 128) * float(1 << (_BITS * _LEVELS - 8))).cast("bigint")
    rows = written(
        sized.join(plan, F.col("source").eqNullSafe(F.col("of_source")) & (length == F.col("of_length"))).select(
            "doc_id", "drawn", "size", *facts, "whole", F.when((F.col("size") > 0) & (F.col("chance") > 0), rank).alias("rank")),
        "rows")
    cuts, picks = _turns(rows.where("rank is not null").select("sid", "rank", "size"), plan.groupBy("sid").agg(F.max("rest").alias("rest")))
    more = F.coalesce((F.col("rank") < F.col("cut")) | (F.col("size") <= F.col("longest")), F.lit(False)).cast("bigint")
    copies = F.when(F.col("size") > 0, F.col("whole") + more).otherwise(0).cast("bigint")
    return rows.join(cuts, "sid").join(picks, ["sid", "rank"], "left").select(
        "doc_id", "drawn", "size", "source_size", "target", copies.alias("copies"))


def repeated_by_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    taken = mix.where("copies > 0").select(F.col("drawn").alias("__drawn"), F.col("copies").alias("__copies")).dropDuplicates(["__drawn"])
    return docs.join(taken, row_number_of(docs) == F.col("__drawn")).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).drop("__drawn", "__copies", "__copy")
