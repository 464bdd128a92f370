"""Words of Arrow text columns as 64-bit numbers, without a Python string per word.

A word is a maximal run of bytes other than space and `\\t \\n \\v \\f \\r`; these bytes
never occur inside a UTF-8 character. Equal words get equal numbers; two different
words share one with a chance of about 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken together up to this many bytes, so memory does not follow the batch size.
SLICE_BYTES = 1 << 20
#: Bytes hashed at once.
BLOCK = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 1 << 16

SPACES = [0x20, *range(0x09, 0x0E)]
_SPACE = np.zeros(256, bool)
_SPACE[SPACES] = True
#: All of ASCII but letters and digits, for words without punctuation.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_LOWER = _BYTE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_STEP = int(mix(np.array([11], np.uint64))[0]) | 1
_ODD = mix(np.arange(64, dtype=np.uint64), 13) | np.uint64(1)
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        for base in (_STEP, pow(_STEP, -1, 2**64)):
            steps = np.full(BLOCK + LONG_WORD + 1, base, np.uint64)
            steps[0] = 1
            _tables.append(np.multiply.accumulate(steps))
    return _tables


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


@dataclass
class Words:
    """The words of rows `first` to `last` (not included) of a column."""
    first: int
    last: int
    rows: np.ndarray      # for each word its row, counted from `first`
    hashes: np.ndarray    # uint64
    starts: np.ndarray    # byte places in `data`
    ends: np.ndarray
    at: np.ndarray        # words of row r: at[r] to at[r + 1]
    data: np.ndarray


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, lower: bool) -> np.ndarray:
    up, down = _powers()
    out = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        if e[-1] <= len(up) - 1:
            total = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(table[data[starts[i] : ends[j - 1]]] * up[: e[-1]], out=total[1:])
            out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    for k in long:
        word = data[starts[k] : ends[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
    return mix(out + (ends - starts).astype(np.uint64))


#: Bytes, starts and ends of words to those that are to be hashed.
Cut = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def words(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES, plain: bool = False, cut: Cut | None = None) -> Iterator[Words]:
    """The words of every whole text, some rows at a time; `lower` folds A-Z only, `plain` words end at punctuation too.

    `cut` may part words and put other bytes in the places of theirs.
    """
    offsets, data = buffers(column)
    apart = _MARKS if plain else _SPACE
    table, n, first = _LOWER if lower else _BYTE, len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        begin, bounds = int(offsets[first]), offsets[first : last + 1]
        here = data[begin : int(bounds[-1])]
        if len(here):
            space = apart[here]
            edge = np.zeros(len(here) + 1, bool)
            edge[bounds - begin] = True          # a text begins or ends here
            starts = np.flatnonzero(~space & (edge[:-1] | np.concatenate(([True], space[:-1])))) + begin
            ends = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True])))) + 1 + begin
        else:
            starts = ends = np.zeros(0, np.int64)
        text = data
        if cut is not None:
            bounds = bounds - begin
            text, starts, ends = cut(here, starts - begin, ends - begin)
        at = np.searchsorted(starts, bounds)
        rows = np.repeat(np.arange(last - first), np.diff(at))
        yield Words(first, last, rows, _hashes(text, starts, ends, table, lower), starts, ends, at, text)
        first = last


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of `size` numbers; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _ODD[k]
    return mix(out, size)


def long_grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """As `grams`, at a cost that does not grow with `size`."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers()
    out = np.empty(n, np.uint64)
    step = BLOCK // 2
    for i in range(0, n, step):
        part = hashes[i : min(n, i + step) + size - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - size + 1
        out[i : i + m] = (total[size:] - total[:m]) * down[:m]
    return mix(out, size)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles in ascending order; fewer words than `size` are one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(grams(hashes, min(size, len(hashes))))


def longs(numbers: np.ndarray) -> pa.Array:
    """Unsigned numbers as Spark's signed ones."""
    return pa.array(numbers.view(np.int64))


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))
