"""Counts of whole texts, worked out for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallygrid.llm import words as W
from tallygrid.llm.shared import map_arrow

_SYMBOLS = b"#*$%&|<>"
_KINDS = ("n_symbols", "n_upper", "n_lower", "n_digits", "n_marks", "n_lines", "n_wide")
COUNTS = ("n_words", "word_chars", *_KINDS, "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_short_words", "n_long_words")
#: Words in a window whose repetition counts.
REPEATED = 5


def _kinds() -> np.ndarray:
    """For each byte value a row of flags, one per name in `_KINDS`."""
    flags = np.zeros((256, len(_KINDS)), np.int32)
    for b in range(256):
        c = chr(b) if b < 128 else ""
        flags[b] = (b in _SYMBOLS, "A" <= c <= "Z", "a" <= c <= "z", c.isdigit(), c.isprintable() and not c.isalnum() and c not in ("", " "),
                    c == "\n", b >= 0xC0)
    return flags


_FLAGS = _kinds()


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _repeat_words(hashes: np.ndarray) -> int:
    """Words in windows that the text holds twice or more."""
    own = W.grams(hashes, REPEATED)
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    covered = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(np.isin(own, twice))
    covered += np.bincount(at, minlength=len(covered)) - np.bincount(at + REPEATED, minlength=len(covered))[: len(covered)]
    return int(np.count_nonzero(np.cumsum(covered)))


def counts(part: W.Words, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of `COUNTS` for each text of the part."""
    bounds = offsets[part.first : part.last + 1]
    out = {k: np.zeros(part.last - part.first, np.int64) for k in COUNTS}
    chars = np.zeros(len(part.starts), np.int64)
    for r in range(part.last - part.first):
        begin, end = int(bounds[r]), int(bounds[r + 1])
        own = part.data[begin:end]
        per_byte = np.bincount(own, minlength=256)
        for k, name in enumerate(_KINDS):
            out[name][r] = per_byte @ _FLAGS[:, k]
        # white space is one byte a character, all other bytes belong to words
        out["word_chars"][r] = len(own) - per_byte[0x80:0xC0].sum() - per_byte[W.SPACES].sum()
        s, e = part.at[r], part.at[r + 1]
        hashes = part.hashes[s:e]
        length = part.ends[s:e] - part.starts[s:e]
        out["n_words"][r] = e - s
        out["n_short_words"][r] = np.count_nonzero(length <= 3)
        out["n_long_words"][r] = np.count_nonzero(length > 12)
        out["n_distinct_words"][r] = len(np.unique(hashes))
        out["n_dup_lines"][r] = _dup_lines(own.tobytes())
        out["n_repeat_words"][r] = _repeat_words(hashes)
    return out


def text_counts(docs: DataFrame, *carried: Column) -> DataFrame:
    """`carried` columns and the counts of every row's whole text; a null text counts as empty."""
    rows = docs.select(F.col("text").cast("string").alias("text"), *carried)
    names = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).fill_null("")
            offsets, _ = W.buffers(text)
            for part in W.words(text):
                found = counts(part, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(1 + k).slice(part.first, part.last - part.first) for k in range(len(names))),
                     *(pa.array(found[c]) for c in COUNTS)], [*names, *COUNTS])

    schema = StructType([*rows.schema.fields[1:], *(StructField(c, LongType()) for c in COUNTS)])
    return map_arrow(rows, run, schema)
