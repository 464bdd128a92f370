"""Removal of long repeated word sequences, found by recompression.

A document's words are rewritten in rounds. Each round first names every maximal run
of one symbol (symbol and length), then every pair of a left and a right symbol, where
one bit of a symbol's number tells its side. Names are numbers worked out from what
they stand for, so all tasks give equal things equal names without asking each other.
Whether symbols join depends on their near neighbours only: every symbol knows the
*context*, the words that its making depended on, and wherever this context occurs
again the same symbol stands in it.

So a window that two texts share has, for each symbol with its context inside the
window, that symbol in both. A symbol held by one text only rules out every window
around its context; what is left is verified window by window. Hence nothing is missed,
whatever the texts; rounds and thinning only decide how much is left to verify.

1. Parse all texts; count for each symbol whether different texts hold it (the least and
   the largest text number, both combined per task before the shuffle).
2. Give each document the list of its symbols that others hold.
3. Parse those documents again, name their open windows, and find for each window the
   smallest doc_id that holds it.
4. A document loses the words under its windows that a smaller doc_id holds too. A text
   that equals an earlier one as a whole loses all words if it has a window at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import words as W
from tallygrid.llm.shared import id_filter, map_arrow, slot, written

#: Rounds of naming. Symbols stand for about three words then, their contexts for some twenty.
ROUNDS = 4
#: Longest symbol in words; longer neighbours stay apart.
LONGEST = 16
#: One symbol in so many is counted, chosen by its number.
THINNED = 2


def recompress(symbols: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS):
    """`(symbol, row, context start, context end)` after so many rounds; places count all words from 0.

    `rows` tells which text a word belongs to. A context that takes in an end of its text
    reaches over it, since another text may go on at that place.
    """
    symbols, place = symbols.copy(), np.arange(len(symbols))
    start, end, low, high = place, place + 1, place, place + 1
    for r in range(rounds):
        if not len(symbols):
            break
        # runs
        same = rows[1:] == rows[:-1]
        at = np.flatnonzero(np.concatenate(([True], ~(same & (symbols[1:] == symbols[:-1])))))
        until = np.append(at[1:], len(symbols))
        times, symbols_ = until - at, symbols[at]
        if len(at) < len(symbols):
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        start, end, rows = start[at], end[until - 1], rows[at]
        symbols = np.where(times > 1, W.mix(symbols_ + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 31), symbols_)
        low, high = _reach(rows, low, high, np.ones(len(rows), bool), np.ones(len(rows), bool))
        # pairs
        left = (W.mix(symbols, 40 + r) >> np.uint64(63)).astype(bool)
        joins = left[:-1] & ~left[1:] & (rows[1:] == rows[:-1]) & (end[1:] - start[:-1] <= LONGEST)
        first, second = np.append(joins, False), np.concatenate(([False], joins))
        single = ~first & ~second
        low, high = _reach(rows, low, high, single & ~left, single & left)
        i = np.flatnonzero(first)
        symbols[i] = W.mix(symbols[i] * np.uint64(3) + W.mix(symbols[i + 1], 21), 22)
        end, high = end.copy(), high.copy()
        end[i], high[i], low[i] = end[i + 1], np.maximum(high[i], high[i + 1]), np.minimum(low[i], low[i + 1])
        keep = ~second
        symbols, rows, start, end, low, high = (x[keep] for x in (symbols, rows, start, end, low, high))
    return symbols, rows, low, high


def _reach(rows, low, high, back, ahead):
    """Contexts that also take in that of the neighbour before (`back`) or after (`ahead`), or an end of the text."""
    apart = rows[1:] != rows[:-1]
    before_low = np.concatenate((low[:1] - 1, np.where(apart, low[1:] - 1, low[:-1])))
    before_high = np.concatenate((high[:1], np.where(apart, high[1:], high[:-1])))
    after_low = np.append(np.where(apart, low[:-1], low[1:]), low[-1:])
    after_high = np.append(np.where(apart, high[:-1] + 1, high[1:]), high[-1:] + 1)
    new_low = np.minimum(np.where(back, np.minimum(low, before_low), low), np.where(ahead, after_low, low))
    new_high = np.maximum(np.where(ahead, np.maximum(high, after_high), high), np.where(back, before_high, high))
    return new_low, new_high


def _text_keys(part: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each text's word sequence."""
    place = (np.arange(len(part.hashes)) - part.at[part.rows]).astype(np.uint64)
    out = []
    for seed in (51, 52):
        total = np.zeros(len(part.hashes) + 1, np.uint64)
        np.cumsum(W.mix(part.hashes + W.mix(place, seed), seed), out=total[1:])
        out.append(total[part.at[1:]] - total[part.at[:-1]])
    return out[0], out[1]


def _parsed(docs: DataFrame) -> DataFrame:
    """`(doc_id, key1, key2, n_words, symbols, lows, highs)` of every row: the thinned symbols and their contexts."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.words(batch.column(1)):
                key1, key2 = _text_keys(part)
                symbols, rows, low, high = recompress(part.hashes, part.rows)
                own = (symbols >> np.uint64(20)) % np.uint64(THINNED) == 0
                symbols, rows, low, high = symbols[own], rows[own], low[own], high[own]
                at = np.searchsorted(rows, np.arange(part.last - part.first + 1)).astype(np.int32)
                base = part.at[rows]
                offsets = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, part.last - part.first), W.longs(key1), W.longs(key2),
                    pa.array(np.diff(part.at).astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, W.longs(symbols)),
                    pa.ListArray.from_arrays(offsets, pa.array((low - base).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array((high - base).astype(np.int32))),
                ], ["doc_id", "key1", "key2", "n_words", "symbols", "lows", "highs"])

    return map_arrow(docs.select("doc_id", "text"), parse, (
        "doc_id bigint, key1 bigint, key2 bigint, n_words bigint, symbols array<bigint>, lows array<int>, highs array<int>"))


def _open_ranges(texts: DataFrame, window: int) -> DataFrame:
    """`(doc_id, key1, ranges)`: first and last place of each run of windows that no lone symbol rules out."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            n_words, symbols, lows, highs, shared = (batch.column(c) for c in ("n_words", "symbols", "lows", "highs", "shared"))
            for r in range(batch.num_rows):
                places = n_words[r].as_py() - window + 1
                low, high = lows[r].values.to_numpy(), highs[r].values.to_numpy()
                lone = ~np.isin(symbols[r].values.to_numpy(), shared[r].values.to_numpy())
                low, high = low[lone], high[lone]
                first, last = np.maximum(high - window, 0), np.minimum(low, places - 1)
                real = first <= last
                shut = np.bincount(first[real], minlength=places + 1) - np.bincount(last[real] + 1, minlength=places + 1)
                is_open = np.concatenate(([0], (np.cumsum(shut)[:places] == 0).view(np.int8), [0]))
                turn = np.diff(is_open)
                if turn.any():
                    keep.append(r)
                    found.append(np.stack((np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1), 1).ravel())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(keep, pa.int64())), batch.column("key1").take(pa.array(keep, pa.int64())),
                W.lists(found, pa.int32())], ["doc_id", "key1", "ranges"])

    return map_arrow(texts, ranges, "doc_id bigint, key1 bigint, ranges array<int>")


def _chosen(docs: DataFrame, wanted: bytes) -> DataFrame:
    """`(doc_id, key1, text)` of the rows whose slot is set."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
            for part in W.words(batch.column(1)):
                n = part.last - part.first
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, n), W.longs(_text_keys(part)[0]), batch.column(1).slice(part.first, n)],
                    ["doc_id", "key1", "text"])

    rows = docs.select("doc_id", "text", slot(F.col("doc_id")).alias("at"))
    return map_arrow(rows, choose, "doc_id bigint, key1 bigint, text string")


def _windows(suspects: DataFrame, window: int) -> DataFrame:
    """`(name, doc_id, key1, place)` of the open windows."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column("ranges")
            for part in W.words(batch.column("text")):
                names, places, rows = [], [], []
                for r in range(part.last - part.first):
                    own = W.long_grams(part.hashes[part.at[r] : part.at[r + 1]], window)
                    for first, last in ranges[part.first + r].values.to_numpy().reshape(-1, 2):
                        names.append(own[first : last + 1])
                        places.append(np.arange(first, last + 1, dtype=np.int32))
                        rows.append(np.full(last + 1 - first, part.first + r))
                if names:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([
                        W.longs(np.concatenate(names)), batch.column("doc_id").take(at), batch.column("key1").take(at),
                        pa.array(np.concatenate(places))], ["name", "doc_id", "key1", "place"])

    return map_arrow(suspects, name, "name bigint, doc_id bigint, key1 bigint, place int")


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """`(doc_id, key1, n_words, spans)`: the words of each row of `docs (doc_id, text)` that repeat earlier ones.

    A window is `window` consecutive words (runs of bytes other than ASCII white space) of
    one document. `spans` holds the first and last word, in turn, of each maximal run of
    words under windows that a document with a smaller doc_id holds too; rows without any
    are left out. `key1` is a number of the row's word sequence.

    Null and empty texts, and texts shorter than a window, have no spans. A row without doc_id
    has none and is no one's earlier text. Rows that repeat a doc_id are parts of one document
    and do not count as earlier for each other. Other columns are ignored.
    """
    parsed = written(_parsed(docs.where("doc_id IS NOT NULL")), "parsed").where(F.col("n_words") >= window)
    key = ["key1", "key2", "n_words"]
    first = parsed.groupBy(*key).agg(F.min("doc_id").alias("first_id"))
    copies = parsed.select("doc_id", *key).join(first, key).where("doc_id > first_id").select(
        "doc_id", "key1", F.array(F.lit(0), F.col("n_words").cast("int") - 1).alias("spans")).distinct()
    texts = written(
        parsed.join(first, key).where("doc_id = first_id").drop("first_id", "key2").dropDuplicates(["doc_id", "key1"]), "texts")

    held = texts.select("doc_id", "key1", F.explode("symbols").alias("symbol"))
    several = held.groupBy("symbol").agg(F.min("key1").alias("low"), F.max("key1").alias("high")).where("low <> high")
    shared = held.join(several.select("symbol"), "symbol").groupBy("doc_id", "key1").agg(F.collect_set("symbol").alias("shared"))
    # a text without shared symbols may still have windows that no symbol rules out
    listed = texts.join(shared, ["doc_id", "key1"], "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<bigint>")))
    ranges = written(_open_ranges(listed, window), "ranges")
    suspects = written(_chosen(docs, id_filter(ranges, "doc_id")).join(ranges, ["doc_id", "key1"]), "suspects")

    windows = _windows(suspects, window)
    known = windows.groupBy("name").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where(
        "first_id <> last_id").select("name", "first_id")
    hits = windows.join(known, "name").where("doc_id > first_id").groupBy("doc_id", "key1").agg(
        F.sort_array(F.collect_set("place")).alias("places"))
    found = map_arrow(hits, _merged(window), "doc_id bigint, key1 bigint, spans array<int>")
    return found.unionAll(copies)


def _merged(window: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for places in batch.column("places"):
                at = places.values.to_numpy()
                cut = np.flatnonzero(np.diff(at) > window)
                spans.append(np.stack((at[np.concatenate(([0], cut + 1))], at[np.append(cut, len(at) - 1)] + window - 1), 1).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key1"), W.lists(spans, pa.int32())], ["doc_id", "key1", "spans"])

    return merge


_KEPT_SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def _cut(with_spans: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = W.buffers(batch.column("text"))
            total, lost, kept, held = [], [], [], 0
            for r in range(batch.num_rows):
                own = data[offsets[r] : offsets[r + 1]].tobytes().split()
                spans = batch.column("spans")[r].values if with_spans else None
                left = own
                if spans is not None:
                    left, at = [], 0
                    for first, last in spans.to_numpy().reshape(-1, 2):
                        left += own[at:first]
                        at = last + 1
                    left += own[at:]
                total.append(len(own))
                lost.append(len(own) - len(left))
                kept.append(b" ".join(left).decode())
                held += len(kept[-1])
                if r + 1 == batch.num_rows or held > W.SLICE_BYTES:
                    n = len(kept)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").slice(r + 1 - n, n), pa.array(total, pa.int64()), pa.array(lost, pa.int64()),
                        pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])
                    total, lost, kept, held = [], [], [], 0

    return cut


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`(doc_id, n_words, n_removed, kept_text)` of every row: its words outside its spans, joined by one space."""
    spans = written(spans, "spans")
    wanted = id_filter(spans, "doc_id")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            at = batch.column("at").to_numpy()
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 0))

    rows = docs.select("doc_id", "text", slot(F.col("doc_id")).alias("at"))
    whole = map_arrow(rows, lambda batches: _cut(False)(others(batches)), _KEPT_SCHEMA)
    some = _chosen(docs, wanted).join(spans, ["doc_id", "key1"], "left")
    return whole.unionAll(map_arrow(some, _cut(True), _KEPT_SCHEMA))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """`(doc_id, n_words, n_removed, kept_text)` of every row of `docs`, without the words of `repeated_spans`."""
    return without_spans(docs, repeated_spans(docs, window))
