"""Token counts of byte-level BPE from a table of frequent pieces and worker caches.

A piece is what the tokenizer's own pattern can never join with its neighbours: a run of
characters other than ASCII white space, with the blank before it; or the rest of a run of
white space. So a text's tokens are the sum over its pieces, and a piece's number of tokens need
only be known once. Two tiers know it:

1. A first pass finds the pieces that are frequent in any task, with their numbers of tokens. The
   commonest go to all tasks as a hash table of fixed size, looked up for a whole slice at a time.
2. Each Python worker keeps what it has encoded itself, from task to task, and the tokenizer
   sees what neither knows.

No piece is shuffled: tasks send a bounded list of frequent ones. Pieces are 64-bit numbers
(see `words.py`). Texts with a special token's string or with white space beyond ASCII, where
pieces do join, are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tallygrid.llm import words as W
from tallygrid.llm.shared import map_arrow

#: Pieces a task names as frequent at most, and pieces in the table.
NAMED, HELD = 1 << 12, 1 << 16
#: Slots of the table: at most a quarter are taken.
_SLOTS = 1 << 18
#: Pieces a worker keeps, and pieces a task counts before the rare ones go.
CACHED, COUNTED = 1 << 20, 1 << 17
LIMIT = 512

_UNKNOWN = -1
#: Separators and white space beyond blank, tab and line ends, as UTF-8 (U+001C-1F, 85, A0, 1680, 180E, 2000-200F, 2028-202F, 205F, 2060, 3000, FEFF)
_OTHER_SPACE = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf"


class PieceTable:
    """A fixed set of 64-bit numbers, each with a small one: open addressing in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, _UNKNOWN, np.int32)
        left = np.arange(len(keys))
        at = (keys >> np.uint64(40)).astype(np.int64) % _SLOTS
        while len(left):
            free = self.values[at[left]] == _UNKNOWN
            slots, which = np.unique(at[left][free], return_index=True)  # one key to a slot
            put = left[free][which]
            self.keys[slots], self.values[slots] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) % _SLOTS

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, `_UNKNOWN` where there is none."""
        at = (keys >> np.uint64(40)).astype(np.int64) % _SLOTS
        out = np.where(self.keys[at] == keys, self.values[at], _UNKNOWN)
        # a key may stand further on, up to the next free slot
        left = np.flatnonzero((out == _UNKNOWN) & (self.values[at] != _UNKNOWN))
        while len(left):
            at[left] = (at[left] + 1) % _SLOTS
            here = at[left]
            hit = self.keys[here] == keys[left]
            out[left[hit]] = self.values[here[hit]]
            left = left[~hit & (self.values[here] != _UNKNOWN)]
        return out


class _Worker:
    """A tokenizer and the numbers of tokens it has found, kept for the life of a Python worker."""

    _all: dict[str, "_Worker"] = {}

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.joins = re.compile(b"|".join([*special, _OTHER_SPACE]))
        self.known: dict[int, int] = {}

    @classmethod
    def of(cls, vocabulary: str) -> "_Worker":
        if vocabulary not in cls._all:
            cls._all[vocabulary] = cls(vocabulary)
        return cls._all[vocabulary]

    def sizes(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lookup(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Tokens of the pieces `data[starts:ends]` whose numbers are `keys`."""
        names, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > CACHED:
            self.known.clear()
        numbers, known = names.tolist(), self.known
        new = [k for k, x in enumerate(numbers) if x not in known]
        if new:
            texts = [data[starts[k] : ends[k]].tobytes().decode() for k in first[new].tolist()]
            known.update(zip([numbers[k] for k in new], self.sizes(texts)))
        return np.fromiter(map(known.__getitem__, numbers), np.int64, len(numbers))[inverse]


class _Pieces:
    """The pieces of a slice of texts: numbers, rows, and places in `data`."""

    def __init__(self, part: W.Words, offsets: np.ndarray):
        n, data = part.last - part.first, part.data
        bounds = offsets[part.first : part.last + 1]
        # the gaps before each word, and after each text's last
        first = part.at[:-1][part.at[:-1] < part.at[1:]]
        gap_starts = np.concatenate((part.starts[:1], part.ends[:-1])) if len(part.starts) else part.starts.copy()
        gap_starts[first] = bounds[part.rows[first]]
        blank = (part.starts > gap_starts) & (data[np.maximum(part.starts - 1, 0)] == 0x20)
        tail_starts = bounds[:-1].copy()
        tail_starts[part.rows[first]] = part.ends[part.at[1:][part.at[:-1] < part.at[1:]] - 1]
        last = (part.starts > gap_starts) & ~blank      # one character of a gap that is no blank stands alone
        lead = part.starts - gap_starts > 1
        tail = bounds[1:] > tail_starts
        space_starts = np.concatenate((gap_starts[lead], part.starts[last] - 1, tail_starts[tail]))
        space_ends = np.concatenate((part.starts[lead] - 1, part.starts[last], bounds[1:][tail]))
        order = np.argsort(space_starts, kind="stable")
        space_starts, space_ends = space_starts[order], space_ends[order]
        space_rows = np.concatenate((part.rows[lead], part.rows[last], np.arange(n)[tail]))[order]
        spaces = W._hashes(data, space_starts, space_ends, W._BYTE, False)
        self.keys = np.concatenate((W.mix(part.hashes, 1) * np.uint64(2) + blank.astype(np.uint64), W.mix(spaces, 2)))
        self.rows = np.concatenate((part.rows, space_rows))
        self.starts = np.concatenate((part.starts - blank, space_starts))
        self.ends = np.concatenate((part.ends, space_ends))
        self.data, self.n = data, n


def _slices(batches: Iterator[pa.RecordBatch], worker: _Worker) -> Iterator[tuple[pa.RecordBatch, W.Words, np.ndarray, _Pieces, list[int]]]:
    """Batch, words, offsets and pieces of each slice, and the rows to be encoded whole, whose pieces are left out."""
    for batch in batches:
        text = batch.column(0).fill_null("")
        offsets, data = W.buffers(text)
        for part in W.words(text):
            pieces = _Pieces(part, offsets)
            begin, end = int(offsets[part.first]), int(offsets[part.last])
            whole = sorted({
                int(np.searchsorted(offsets, begin + m.start(), "right")) - 1 - part.first for m in worker.joins.finditer(data[begin:end].data)
            }) if end > begin else []
            if whole:
                keep = ~np.isin(pieces.rows, whole)
                for name in ("keys", "rows", "starts", "ends"):
                    setattr(pieces, name, getattr(pieces, name)[keep])
            yield batch, part, offsets, pieces, whole


def frequent_pieces(docs: DataFrame, vocabulary: str) -> PieceTable:
    """The commonest pieces of all whole texts, as a table of at most `HELD`.

    A task counts its pieces, forgetting those met once when they are too many, and names its
    commonest. What is missing from the table costs time, never a token.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker.of(vocabulary)
        keys, counts, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, _, _, pieces, _ in _slices(batches, worker):
            own, first, n = np.unique(pieces.keys, return_index=True, return_counts=True)
            often = n > 1
            own, first, n = own[often], first[often], n[often]
            tokens = worker.lookup(own, pieces.starts[first], pieces.ends[first], pieces.data) if len(own) else n
            keys, inverse = np.unique(np.concatenate((keys, own)), return_inverse=True)
            total, of = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            np.add.at(total, inverse, np.concatenate((counts, n)))
            of[inverse] = np.concatenate((sizes, tokens))
            if len(keys) > COUNTED:
                best = np.sort(np.argpartition(total, -COUNTED // 2)[-COUNTED // 2 :])
                keys, total, of = keys[best], total[best], of[best]
            counts, sizes = total, of
        best = np.argsort(-counts, kind="stable")[:NAMED]
        yield pa.RecordBatch.from_arrays([W.longs(keys[best]), pa.array(counts[best]), pa.array(sizes[best])], ["piece", "n", "n_tokens"])

    named = map_arrow(docs.select("text"), name, "piece bigint, n bigint, n_tokens bigint")
    top = named.groupBy("piece", "n_tokens").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(HELD).collect()
    return PieceTable(np.array([r.piece for r in top], np.int64).view(np.uint64), np.array([r.n_tokens for r in top], np.int32))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """`(doc_id, n_bytes, n_tokens, over_limit)` of every row of `docs (doc_id, text)`.

    `n_tokens` is what the tokenizers library gives for the whole text by `vocabulary`, a byte-level
    BPE file that the executors can read, without tokens added at its ends; the strings of special
    tokens are such tokens, as by the library's default. `over_limit` tells that there are more than `limit`. Null
    and empty texts have 0 bytes and tokens. Rows that repeat a doc_id, and null doc_ids, are rows like
    others; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), "doc_id")
    context = docs.sparkSession.sparkContext
    table = context.broadcast(frequent_pieces(rows, vocabulary))  # 3 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, frequent = _Worker.of(vocabulary), table.value
        for batch, part, offsets, pieces, whole in _slices(batches, worker):
            tokens = frequent.find(pieces.keys).astype(np.int64)
            rare = np.flatnonzero(tokens == _UNKNOWN)
            if len(rare):
                tokens[rare] = worker.lookup(pieces.keys[rare], pieces.starts[rare], pieces.ends[rare], pieces.data)
            n = np.zeros(pieces.n, np.int64)
            np.add.at(n, pieces.rows, tokens)
            for r in whole:
                text = part.data[offsets[part.first + r] : offsets[part.first + r + 1]].tobytes().decode()
                n[r] = worker.sizes([text])[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(part.first, pieces.n), pa.array(np.diff(offsets[part.first : part.last + 1])), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = StructType([
        rows.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])
    return map_arrow(rows, count, schema)
