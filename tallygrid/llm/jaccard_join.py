"""Set similarity join on word n-grams, with the n-gram order cut into fragments.

All n-grams stand in one global order: first those seen in few documents, then, by
the power of two of their count, the common ones, and within a class by number. A
document's n-grams in that order begin with its *prefix*: two documents that link
must share an n-gram of both prefixes.

1. Documents with equal sets are one class; only its representative goes on.
2. Prefixes meet per n-gram. Where an n-gram is held by many, they are first paired
   with one of them only (the one with the fewest rare n-grams), which ties groups
   of near copies together without pairing all with all.
3. Then the pairs whose two sides are still in different components are formed, within
   the bounds that sizes and places in the order set.
4. Bit maps of the sets (each n-gram turns one bit over) show how many n-grams a pair
   differs in at least, and leave few pairs but the linked ones.
5. For these, the shared n-grams are counted separately in each fragment of the order
   (`array_intersect` of two pieces) and the counts summed per pair.
6. Linked pairs give connected components.

No link that joins two components is missed, at any size: the order comes from a fixed-size
table of counts, and any order gives the same links. Counts only decide how much is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import words as W
from tallygrid.llm.components import components
from tallygrid.llm.shared import id_filter, map_arrow, slot, written

#: Entries of the table that holds the class of common n-grams (one byte each).
CLASS_SLOTS = 1 << 18
#: An n-gram of fewer documents is rare.
COMMON_FROM = 32
#: Pieces of the global order.
FRAGMENTS = 8
#: Entries after which a task hands on its counts.
COUNTS_HELD = 1 << 21
#: Holders of an n-gram compared in one place; more are dealt into blocks, and the blocks paired.
BLOCK_ROWS = 4096

_PREFIX_SCHEMA = "doc_id bigint, n_shingles bigint, sig1 bigint, sig2 bigint, n_rare bigint, parity binary, prefix array<bigint>"


def _class_slot(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint64(40)) & np.uint64(CLASS_SLOTS - 1)


def _common_classes(docs: DataFrame, size: int) -> bytes:
    """For each slot the class of the commonest n-gram in it; 0 stands for rare."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            numbers, times = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            many = times > 1  # what a task sees once cannot be common unless all tasks do
            return pa.RecordBatch.from_arrays([W.longs(numbers[many]), pa.array(times[many])], ["gram", "n"])

        for batch in batches:
            for part in W.words(batch.column(0), lower=True):
                for r in range(part.last - part.first):
                    held.append(W.shingles(part.hashes[part.at[r] : part.at[r + 1]], size))
                if sum(map(len, held)) > COUNTS_HELD:
                    yield flush()
        yield flush()

    slots = (
        map_arrow(docs.select("text"), counts, "gram bigint, n bigint")
        .groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM)
        .groupBy(F.shiftrightunsigned("gram", 40).bitwiseAND(F.lit(CLASS_SLOTS - 1)).alias("at"))
        .agg(F.max(F.floor(F.log2("n"))).cast("int").alias("class"))
        .toPandas()  # at most CLASS_SLOTS rows
    )
    table = np.zeros(CLASS_SLOTS, np.uint8)
    table[slots["at"].to_numpy(np.int64)] = slots["class"].to_numpy(np.uint8)
    return table.tobytes()


def _ordered(numbers: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the global order, and how many of it are rare."""
    classes = table[_class_slot(numbers)]
    rare = len(classes) - int(np.count_nonzero(classes))
    return (numbers if rare == len(classes) else numbers[np.argsort(classes, kind="stable")]), rare


def _prefixes(docs: DataFrame, size: int, percent: int, table: bytes) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(table, np.uint8)
        for batch in batches:
            for part in W.words(batch.column(1), lower=True):
                facts, parities, prefixes = [], [], []
                for r in range(part.last - part.first):
                    own = W.shingles(part.hashes[part.at[r] : part.at[r + 1]], size)
                    n = len(own)
                    ranked, rare = _ordered(own, order)
                    prefixes.append(ranked[: n - -(-percent * n // 100) + 1] if n else own)
                    parities.append(_parity(own))
                    facts.append((n, int(W.mix(own, 1).sum()), int(W.mix(own, 2).sum()), rare))
                n, one, two, rare = (np.array(x) for x in zip(*facts))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, part.last - part.first), pa.array(n),
                    W.longs(one.astype(np.uint64)), W.longs(two.astype(np.uint64)), pa.array(rare),
                    pa.array(parities, pa.binary()), W.lists(prefixes, pa.int64()),
                ], ["doc_id", "n_shingles", "sig1", "sig2", "n_rare", "parity", "prefix"])

    return map_arrow(docs.select("doc_id", "text"), parse, _PREFIX_SCHEMA)


def _fragments(docs: DataFrame, size: int, table: bytes, wanted: bytes) -> DataFrame:
    """`(id, n, fragment, grams)` of the documents whose slot is set: one piece per part of the order."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bits = np.frombuffer(table, np.uint8), np.frombuffer(wanted, np.uint8)
        shift = np.uint64(64 - (FRAGMENTS - 1).bit_length())
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
            for part in W.words(batch.column(1), lower=True):
                ids, sizes, kinds, pieces = [], [], [], []
                for r in range(part.last - part.first):
                    own = W.shingles(part.hashes[part.at[r] : part.at[r + 1]], size)
                    common = order[_class_slot(own)] > 0
                    # rare ones by number, the common ones are the last piece of the order
                    piece = np.where(common, FRAGMENTS, own >> shift)
                    for k in np.unique(piece):
                        ids.append(part.first + r)
                        sizes.append(len(own))
                        kinds.append(int(k))
                        pieces.append(own[piece == k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), pa.array(kinds, pa.int32()),
                     W.lists(pieces, pa.int64())], ["id", "n", "fragment", "grams"])

    rows = docs.select("doc_id", "text", slot(F.col("doc_id")).alias("at")).where("doc_id IS NOT NULL")
    return map_arrow(rows, parse, "id bigint, n bigint, fragment int, grams array<bigint>")


def _verified(pairs: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    """The pairs `(a, b, na, nb)` whose counts, summed over all fragments, reach the threshold."""
    left = pieces.select(F.col("id").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("grams_a"))
    right = pieces.select(F.col("id").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("grams_b"))
    partial = (
        pairs.join(left, ["a", "na"]).join(right, ["b", "nb", "fragment"])
        .select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("shared"))
        .groupBy("a", "b", "na", "nb", "fragment").agg(F.max("shared").alias("shared"))  # rows may repeat
    )
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    return summed.where(F.col("shared") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("shared")))


def _parity(numbers: np.ndarray) -> bytes:
    """A bit map in which each number turns over one bit; at least twice as many bits as numbers."""
    bits = max(64, 1 << (2 * len(numbers) - 1).bit_length())
    at = (W.mix(numbers, 3) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


def _can_link(percent: int):
    """Pairs whose bit maps do not differ in more places than linked sets may differ in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = na + nb - 2 * -(-percent * (na + nb) // (100 + percent))
            keep = np.zeros(batch.num_rows, bool)
            for r, (x, y) in enumerate(zip(batch.column("parity_a"), batch.column("parity_b"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                small = min(len(x), len(y))  # both are powers of two: the larger one folds onto the smaller
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, small), axis=0) for v in (x, y))
                keep[r] = int(np.bitwise_count(x ^ y).sum()) <= most[r]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    return run


def _pairs_across(percent: int):
    """Pairs of different components out of rows sorted by n-gram, within the bounds of their sizes and places."""
    names = ["a", "b", "na", "nb"]

    def pairs_of(ids, sizes, places, comps, blocks) -> list[np.ndarray]:
        alone = blocks.min() == blocks.max()
        kinds, at, times = np.unique(comps, return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            return []
        # members outside the largest component against all; among themselves once
        order = np.argsort(at == np.argmax(times), kind="stable")
        found = []
        for x, i in enumerate(order[: len(ids) - int(times.max())]):
            js = order[x + 1 :]
            js = js[(at[js] != at[i]) & ((blocks[js] != blocks[i]) | alone)]
            n, m = sizes[i], sizes[js]
            need = -(-percent * (n + m) // (100 + percent))
            # holds at the first n-gram that the two share in the order
            most = 1 + np.minimum(n - places[i] - 1, m - places[js] - 1)
            js = js[(np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & (most >= need)]
            if len(js):
                swap = ids[js] < ids[i]
                pair = np.empty((len(js), 4), np.int64)
                pair[:, 0], pair[:, 1] = np.minimum(ids[js], ids[i]), np.maximum(ids[js], ids[i])
                pair[:, 2], pair[:, 3] = np.where(swap, sizes[js], n), np.where(swap, n, sizes[js])
                found.append(pair)
        return found

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        table = np.unique(np.concatenate([*found, np.zeros((0, 4), np.int64)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(4)], names)

    def joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, cell, *columns = (rows.column(c).to_numpy() for c in ("gram", "cell", "id", "n", "place", "comp", "block"))
        edges = np.flatnonzero((np.diff(gram) != 0) | (np.diff(cell) != 0)) + 1
        found, held = [], 0
        for s, e in zip(np.concatenate(([0], edges)), np.append(edges, len(gram))):
            new = pairs_of(*(c[s:e] for c in columns))
            found, held = found + new, held + sum(map(len, new))
            if held > 200_000:
                yield batch_of(found)
                found, held = [], 0
        yield batch_of(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, cell = batch.column("gram").to_numpy(), batch.column("cell").to_numpy()
            # the last n-gram's rows may go on in the next batch
            last = int(np.count_nonzero((gram != gram[-1]) | (cell != cell[-1])))
            before = held[0].select(["gram", "cell"]).slice(0, 1).to_pylist()[0] if held else None
            if last or before and (before["gram"], before["cell"]) != (gram[-1], cell[-1]):
                yield from joined(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held:
            yield from joined(pa.Table.from_batches(held))

    return run


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` of every row of `docs (doc_id, text)`.

    Texts are lower-cased (A-Z only); words are separated by ASCII white space. A document's
    set holds its distinct shingles of `size` words, or the whole sequence where it has
    fewer words. Two documents link when 100 * intersection >= `percent` * union, and
    `component_id` is the smallest doc_id that links reach.

    Null and empty texts have an empty set and link with nothing. A row without doc_id links
    with nothing and has no component. Rows that repeat a doc_id are rows of that document:
    they share its component, and their texts may both link. Other columns are ignored.
    """
    table = _common_classes(docs, size)
    parsed = written(_prefixes(docs, size, percent, table), "prefixes")
    sets = parsed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("sig1", "sig2", "n_shingles").agg(F.min("doc_id").alias("id"))
    own = written(sets.join(classes, ["sig1", "sig2", "n_shingles"]).where("doc_id = id").select(
        "id", F.col("n_shingles").alias("n"), "n_rare", "parity", "prefix"), "classes").dropDuplicates(["id", "n"])

    held = own.select("id", "n", F.posexplode("prefix").alias("place", "gram"))
    shared = held.groupBy("gram").agg(F.count("gram").alias("times")).where("times > 1").select("gram")
    met = written(held.join(shared, "gram"), "met")
    fits = F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    hubs = met.join(own.select("id", "n", "n_rare"), ["id", "n"]).groupBy("gram").agg(
        F.min(F.struct("n_rare", "id", "n", "place")).alias("hub"))
    near = met.join(hubs, "gram").where("id <> hub.id").select(
        *_ordered_pair("id", "n", "hub.id", "hub.n"),
        (F.least(F.col("n") - F.col("place"), F.col("hub.n") - F.col("hub.place"))).alias("most"),
    ).where(fits & (F.col("most") >= need)).select("a", "b", "na", "nb").distinct()
    first = written(_linked(docs, near, own, size, percent, table), "linked")
    tied = components(first)

    open_ = met.join(tied, "id", "left").select("gram", "id", "n", "place", F.coalesce("component", "id").alias("comp"))
    crossed = open_.groupBy("gram").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("id") / BLOCK_ROWS).alias("blocks"),
    ).where("low <> high")
    dealt = open_.join(crossed.select("gram", "blocks"), "gram").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks"))
    ).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # blocks i and j meet in cell (i, j); a block meets itself in (i, i)
    cell = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    rows = dealt.select("gram", cell.alias("cell"), "id", "n", "place", "comp", "block")
    across = map_arrow(
        rows.repartition("gram", "cell").sortWithinPartitions("gram", "cell", "id"),
        _pairs_across(percent), "a bigint, b bigint, na bigint, nb bigint",
    ).distinct()
    second = _linked(docs, across, own, size, percent, table)
    same = sets.join(classes, ["sig1", "sig2", "n_shingles"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    joined = components(first.unionAll(second).unionAll(same))
    return parsed.select("doc_id", "n_shingles").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _ordered_pair(x: str, nx: str, y: str, ny: str) -> list[Column]:
    """A pair with the smaller id first, and each one's size."""
    first = F.col(x) < F.col(y)
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"),
            F.when(first, F.col(nx)).otherwise(F.col(ny)).alias("na"), F.when(first, F.col(ny)).otherwise(F.col(nx)).alias("nb")]


def _linked(docs: DataFrame, pairs: DataFrame, own: DataFrame, size: int, percent: int, table: bytes) -> DataFrame:
    """The pairs `(a, b)` that link: bit maps first, then counts per fragment for what they leave."""
    maps = own.select("id", "n", "parity")
    left = maps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("parity").alias("parity_a"))
    right = maps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("parity_b"))
    able = written(map_arrow(
        pairs.join(left, ["a", "na"]).join(right, ["b", "nb"]), _can_link(percent), "a bigint, b bigint, na bigint, nb bigint"),
        "pairs")
    ends = able.select(F.col("a").alias("id")).unionAll(able.select(F.col("b").alias("id")))
    pieces = written(_fragments(docs, size, table, id_filter(ends, "id")), "pieces")
    return _verified(able, pieces, percent).select("a", "b")
