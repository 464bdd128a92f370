"""Token ids as Parquet list columns with chosen encodings, row groups and page indexes.

A token table is a folder with `tokens` (one row per document in ascending doc_id order:
doc_id, part, local_start, n_tokens, ids) and `parts` (part, base: the ids before the
part). Parts are ranges of doc_id, so a part is written without knowing the ones before
it, and a document's global start is its part's base plus its local start.

Encodings are set per column: ids are dictionary coded (their values repeat, and an index
takes two bytes), the ascending columns are delta coded. Row groups and pages are small,
and files carry column and offset indexes, so a range of documents, or the counts alone,
are read without the other ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import words as W
from tallygrid.llm.hash_table import HashTable
from tallygrid.llm.shared import give_back_memory, map_arrow

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
#: Distinct words whose ids a worker keeps at hand.
HELD_WORDS = 1 << 19
#: A slice of texts may add as many words again before rare ones go.
_SLOTS = 1 << 21
#: New words encoded in one text.
TOGETHER = 256

#: Marks at the end of a word that are looked back over; a word with more stays whole.
MARKS_BACK = 8
#: A splitter that parts marks from a letter or digit before them; letters count after an apostrophe only.
_MARKS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_UPPER, _ALNUM = (np.array([k < 128 and test(chr(k)) for k in range(256)]) for test in (str.isupper, str.isalnum))
_MARK = np.array([0x20 < k < 0x7F and not chr(k).isalnum() for k in range(256)])

_ROWS = "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"


def _rules(tokenizer) -> tuple[bool, bool]:
    """Whether a tokenizer takes A-Z as a-z everywhere, and marks at a word's end apart from a letter or digit before them.

    Only steps known to leave either alone are allowed before.
    """
    made = json.loads(tokenizer.to_str())
    steps, splits = ((x or {}).get(many, [x] if x else []) for x, many in (
        (made["normalizer"], "normalizers"), (made["pre_tokenizer"], "pretokenizers")))
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    known = all(x["type"] in ("NFC", "Lowercase") or x == blanks for x in steps)
    known &= not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values())
    first = {"type": "Split", "pattern": {"Regex": _MARKS_APART}, "behavior": "Removed", "invert": True}
    rest = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in splits[1:])
    return known and any(x["type"] == "Lowercase" for x in steps), known and splits[:1] == [first] and rest


class _HeldWords:
    """The ids of words met so far, one after the other, and each word's place in them.

    A Python worker keeps them from task to task. Beyond `HELD_WORDS` those met in one call only go.
    """

    _all: dict[str, "_HeldWords"] = {}

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # a special token parts words that are encoded in one text
        parting = [(k, t.content) for k, t in sorted(self.tokenizer.get_added_tokens_decoder().items())
                   if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.part_id, self.parting = parting[0] if parting else (None, None)
        self.folds, self.parts = _rules(self.tokenizer)
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = HashTable(_SLOTS)
        self.names = np.zeros(0, np.uint64)
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.calls = np.zeros(0, np.int32)

    @classmethod
    def of(cls, vocabulary: str) -> "_HeldWords":
        if vocabulary not in cls._all:
            cls._all[vocabulary] = cls(vocabulary)
        return cls._all[vocabulary]

    def cut(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words without what makes no difference to their ids: capitals as small letters, marks at the end as words.

        A slice with an added token, in whatever case, stays as it is.
        """
        if not (self.folds or self.parts) or not len(starts):
            return data, starts, ends
        lower = data.tobytes().lower()
        if any(x in lower for x in self.added):
            return data, starts, ends
        if self.folds:
            # a letter before a byte beyond ASCII may be composed with it, and not alike in either case
            upper = _UPPER[data]
            upper[:-1] &= data[1:] < 128
            data = np.where(upper, np.frombuffer(lower, np.uint8), data)
        if self.parts:
            ending = np.flatnonzero(_MARK[data[ends - 1]])
            marks = ends[ending] - 1
            for _ in range(MARKS_BACK):
                marks -= _MARK[data[marks - 1]] & (marks > starts[ending])
            parted = (marks > starts[ending]) & _ALNUM[data[marks - 1]]
            ending, marks = ending[parted], marks[parted]
            starts, ends = np.insert(starts, ending + 1, marks), np.insert(ends, ending, marks)
        return data, starts, ends

    def _drop_rare(self) -> None:
        """At most half of the words stay, the ones met most often."""
        often = np.flatnonzero(self.calls > 1)
        often = often[np.argsort(-self.calls[often], kind="stable")[: HELD_WORDS // 2]]
        often.sort()
        sizes = np.diff(self.at)
        self.ids = self.ids[np.repeat(np.isin(np.arange(len(sizes)), often), sizes)]
        self.at = np.concatenate(([0], np.cumsum(sizes[often])))
        self.names = self.names[often]
        self.known.clear()
        self.known.add(self.names, np.arange(len(often), dtype=np.int32))
        self.calls = np.ones(len(often), np.int32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that the tokenizer has not seen, and how many each has."""
        if self.parting is None or any(self.parting in t for t in texts):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.int32), np.array([len(x) for x in found], np.int64)
        joined = [self.parting.join(texts[k : k + TOGETHER]) for k in range(0, len(texts), TOGETHER)]
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.append(np.array(x.ids, np.int32), np.int32(self.part_id)) for x in found])
        sizes = np.diff(np.flatnonzero(ids == self.part_id), prepend=-1) - 1
        return ids[ids != self.part_id], sizes

    def encode(self, part: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the part's words, and how many each word has."""
        if len(self.names) > HELD_WORDS:
            self._drop_rare()
        place = self.known.find(part.hashes).astype(np.int64)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            names, first, inverse = np.unique(part.hashes[unknown], return_index=True, return_inverse=True)
            first = unknown[first]
            data, starts, ends = part.data, part.starts[first].tolist(), part.ends[first].tolist()
            ids, sizes = self._encoded([data[s:e].tobytes().decode() for s, e in zip(starts, ends)])
            numbers = np.arange(len(self.names), len(self.names) + len(names))
            place[unknown] = numbers[inverse]
            self.known.add(names, numbers)
            self.names = np.concatenate((self.names, names))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, ids))
            self.calls = np.concatenate((self.calls, np.zeros(len(names), np.int32)))
        self.calls += np.bincount(place, minlength=len(self.calls)) > 0
        begins, sizes = self.at[place], self.at[place + 1] - self.at[place]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        return self.ids[np.arange(total) + np.repeat(begins - upto + sizes, sizes)], sizes


def _tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Token rows of sorted partitions. The tokenizer never joins what ASCII white space parts, so
    each distinct word is encoded once and its ids are used again."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _HeldWords.of(vocabulary)
        part_number, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in W.words(batch.column(1), cut=held.cut):
                n = part.last - part.first
                ids, word_sizes = held.encode(part)
                upto = np.concatenate(([0], np.cumsum(word_sizes)))
                # where each document's own ids end, and its end id goes
                ends = upto[part.at[1:]]
                ids = np.insert(ids, ends, end_id)
                sizes = np.diff(upto[part.at]) + 1
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, n), pa.array(np.full(n, part_number, np.int32)),
                    pa.array(start + offsets[:-1].astype(np.int64)), pa.array(sizes.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"])
                start += int(offsets[-1])
        give_back_memory()

    return map_arrow(docs.select("doc_id", "text"), encode, _ROWS)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1) -> None:
    """Encode every whole text of `docs (doc_id, text)` and write a token table to a new folder.

    `vocabulary` is a tokenizers file that the executors can read; `end_id` ends each document.
    Documents stand in ascending doc_id order, null first; rows that repeat a doc_id are
    written each, in the order of their texts. Null and empty texts are the end alone. An
    empty table gives an empty token table. Other columns are left out.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        _tokenized(ordered, vocabulary, end_id).write
        .option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")                       # delta for what ascends
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.enable.dictionary#part", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.column.index.truncate.length", 64)
        .parquet(f"{folder}/tokens")
    )
    spark = docs.sparkSession
    sizes = spark.read.schema(_ROWS).parquet(f"{folder}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per part: as many as there are tasks
    base, rows = 0, []
    for r in sizes.orderBy("part").collect():
        rows.append((r.part, base))
        base += r.n
    spark.createDataFrame(rows, "part int, base bigint").coalesce(1).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None,
                ids: bool = True) -> DataFrame:
    """`(doc_id, start, n_tokens[, ids])` of a token table, of doc_ids from `first` to `last` only.

    Bounds reach the row groups' statistics and the page indexes; without `ids` their column is not read.
    """
    rows = spark.read.schema(_ROWS).parquet(f"{folder}/tokens")
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    parts = spark.read.schema("part int, base bigint").parquet(f"{folder}/parts")
    start = (F.col("base") + F.col("local_start")).alias("start")
    return rows.join(parts, "part").select("doc_id", start, "n_tokens", *(["ids"] if ids else []))


def with_checksum(tokens: DataFrame) -> DataFrame:
    """`ids_crc32` of each row's ids as little-endian unsigned 32-bit numbers, in the place of `ids`."""
    kept = [c for c in tokens.columns if c != "ids"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            sums = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sums, pa.int64())], [*kept, "ids_crc32"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name != "ids")
    return map_arrow(tokens, check, f"{fields}, ids_crc32 bigint")
