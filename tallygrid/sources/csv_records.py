"""Records of CSV files whose fields may hold line breaks, found in parallel.

Whether a line begins inside a quoted field depends on all lines before it. So each split is
summed up as a function of what it may begin with, the driver puts the functions of a
file together in order (one small row a split), and a second pass knows where it stands.

A quote opens only where a field begins and closes only where one ends. A line that leaves a field
open makes a record with the lines after it if the first line that can close the field does, and
the fields then are as many as the header's. Otherwise the quote was left open by
mistake: that line alone is at fault, and the next one begins a record of its own. If a later
line opens a field while an earlier one is still open, the earliest that comes out right wins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.session import map_arrow, new_folder
from tallygrid.sources.csv_lines import read_lines, runs

#: What a line is to a field that is open when it begins: it goes on, ends well, or cannot be inside.
_PASSES, _ENDS, _BREAKS = 0, 1, 2
WHOLE, OPEN, PIECE = "whole", "open", "piece"


class LineRule:
    """How lines of one dialect open and close quoted fields."""

    def __init__(self, sep: str, quote: str):
        s, q = re.escape(sep), re.escape(quote)
        inner = f"[^{q}]*(?:{q}{q}[^{q}]*)*"
        self.sep, self.quote = sep, quote
        self._closed = re.compile(f"(^|{s}){q}{inner}{q}(?={s}|\\Z)")
        self._opened = re.compile(f"(?:^|{s}){q}{inner}\\Z")
        self._inside = re.compile(inner)

    def from_outside(self, line: str) -> tuple[int, int]:
        """Fields up to the one left open (0 if none is), and all fields of a line that leaves none open."""
        if self.quote not in line:
            return 0, line.count(self.sep) + 1
        bare = self._closed.sub(r"\1", line)
        opened = self._opened.search(bare)
        if not opened:
            return 0, bare.count(self.sep) + 1
        before = bare[: opened.start()].count(self.sep)
        return before + (2 if opened.group().startswith(self.sep) else 1), 0

    def from_inside(self, line: str) -> tuple[int, int]:
        """What the line is to an open field, and how many fields it adds."""
        if self.quote not in line:
            return _PASSES, 0
        end = self._inside.match(line).end()
        if end == len(line):
            return _PASSES, 0
        rest = line[end + 1 :]
        if not rest:
            return _ENDS, 0
        if not rest.startswith(self.sep):
            return _BREAKS, 0
        opened, fields = self.from_outside(rest[len(self.sep) :])
        return (_PASSES, opened) if opened else (_ENDS, fields)


class _Walk:
    """Lines that left a field open and may yet turn out right: the earliest per number of fields so far."""

    def __init__(self, width: int):
        self.width, self.passed, self.first = width, 0, {}

    def opened(self, fields: int, at: int) -> None:
        self.first.setdefault(fields - self.passed, at)

    def winner(self, kind: int, fields: int) -> int | None:
        return self.first.get(self.width - self.passed - fields) if kind == _ENDS else None

    def gathered(self) -> list[tuple[int, int]]:
        return [(k + self.passed, at) for k, at in self.first.items() if k + self.passed <= self.width]

    def step(self, kind: int, fields: int, opened: int, at: int) -> int | None:
        """Go over a line; the winner if it ends a record."""
        won = None
        if kind == _PASSES:
            self.passed += fields
        else:
            won = self.winner(kind, fields)
            self.passed, self.first = 0, {}
            if won is not None:
                return won
        if opened:
            self.opened(opened, at)
        return won


def _line(value: bytes, codec: str, first: bool) -> str:
    text = value.decode(codec, errors="replace")
    return text.lstrip("\ufeff") if first else text


class _Split:
    """A split as a function of what it begins with."""

    def __init__(self, file: str, block: int, rule: LineRule, width: int):
        self.file, self.block, self.rule, self.width = file, block, rule, width
        self.n, self.header, self.event = 0, None, None
        self.begin = _Walk(width)
        self.after: list[_Walk] = []     # what follows the first event if it is not, and if it is, taken by a record

    def add(self, line: str) -> None:
        at = 2 * self.block + self.n
        self.n += 1
        if self.block == 0 and self.header is None and line.strip():
            self.header = at
        line = line.removesuffix("\r")
        opened, _ = self.rule.from_outside(line)
        kind, fields = self.rule.from_inside(line)
        if self.event is None:
            if kind == _PASSES:
                self.begin.step(kind, fields, opened, at)
            else:
                self.event = (kind, fields)
                self.after = [_Walk(self.width), _Walk(self.width)]
                if opened:
                    self.after[0].opened(opened, at)
            return
        for walk in self.after:
            walk.step(kind, fields, opened, at)
        if len(self.after) == 2 and (self.after[0].passed, self.after[0].first) == (self.after[1].passed, self.after[1].first):
            del self.after[1]

    def summary(self) -> str:
        return json.dumps({
            "header": self.header, "event": self.event, "passed": self.begin.passed, "begin": self.begin.gathered(),
            "after": [w.gathered() for w in self.after]})


def _put_together(splits: list[tuple[int, dict]], width: int) -> dict[int, tuple[int | None, int | None]]:
    """For each split of a file: the record that its lines up to the first event, and after the last, belong to."""
    found = {block: [None, None] for block, _ in splits}
    pending: dict[int, int] = {}
    waiting: list[tuple[int, int]] = []
    for block, s in splits:
        pending = {fields + s["passed"]: at for fields, at in pending.items() if fields + s["passed"] <= width}
        for fields, at in s["begin"]:
            pending.setdefault(fields, at)
        waiting.append((block, 0))
        if s["event"]:
            kind, fields = s["event"]
            won = pending.get(width - fields) if kind == _ENDS else None
            for b, side in waiting:
                found[b][side] = won
            pending = dict(map(tuple, s["after"][-1 if won is not None else 0]))
            waiting = [(block, 1)]
    return {b: tuple(w) for b, w in found.items()}


class _Framer:
    """Cuts the lines of a split into records, knowing how it begins and ends."""

    def __init__(self, file: str, block: int, rule: LineRule, width: int, known: tuple[int | None, int | None], header: int | None, out: list):
        self.file, self.block, self.rule, self.width, self.header, self.out = file, block, rule, width, header, out
        self.started, self.ended = known
        self.n, self.seen = 0, False
        self.walk = _Walk(width)
        self.held: list[tuple[int, str, int]] = []   # lines since a field was left open

    def add(self, text: str) -> None:
        at = 2 * self.block + self.n
        self.n += 1
        line = text.removesuffix("\r")
        opened, _ = self.rule.from_outside(line)
        kind, fields = self.rule.from_inside(line)
        if self.seen:
            won = self.walk.step(kind, fields, opened, at)
            if won is not None:
                self.held.append((at, text, opened))
                self._settle(won)
                return
            if kind != _PASSES:
                self._settle(None)
            self._hold(at, text, opened)
            return
        # up to the first event it is known which record the lines belong to
        mine = self.started is not None and at >= self.started
        if kind == _PASSES:
            if mine:
                self.held.append((at, text, opened))
            else:
                self._emit(at, text, opened)
            return
        self.seen = True
        if self.started is not None:
            self.held.append((at, text, opened))
            self._settle(self.started)
        else:
            self.walk.step(_BREAKS, 0, opened, at)
            self._hold(at, text, opened)

    def _hold(self, at: int, text: str, opened: int) -> None:
        if self.held or self.walk.first:
            self.held.append((at, text, opened))
        else:
            self._emit(at, text, opened)

    def finish(self) -> None:
        self._settle(self.ended if self.seen else self.started, over=True)

    def _settle(self, record: int | None, over: bool = False) -> None:
        """Held lines before `record` stand alone, those from it on are its; `over` tells that it goes on in the next split."""
        own = [line for line in self.held if record is not None and line[0] >= record]
        for at, text, opened in self.held[: len(self.held) - len(own)]:
            self._emit(at, text, opened)
        self.held = []
        if own and record != self.header:
            text = "\n".join(t for _, t, _ in own)
            whole = record >= 2 * self.block and not over
            self.out.append((self.file, own[0][0], record, text.removesuffix("\r") if whole else text, WHOLE if whole else PIECE))

    def _emit(self, at: int, text: str, opened: int) -> None:
        line = text.removesuffix("\r")
        if at != self.header and line.strip():
            self.out.append((self.file, at, at, line, OPEN if opened else WHOLE))


_NAMES = ["file", "at", "record", "text", "kind"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_ROWS = "file string, at bigint, record bigint, text string, kind string"


def _lines(batches: Iterator[pa.RecordBatch], codec: str) -> Iterator[tuple[str, int, str]]:
    before = None
    for batch in batches:
        for file, block, values in runs(batch):
            for value in values.to_pylist():
                yield file, block, _line(value, codec, (file, block) != before and block == 0)
                before = (file, block)


def records(
    spark: SparkSession, files: list[str], sep: str, quote: str, width: int, codec: str, returns: bool = False, made: list[str] | None = None
) -> DataFrame:
    """`(file, text, open)` of every record of files of one dialect and header, without the header, in file order.

    `open` marks a line whose quote was left open. Blank lines between records are none. The
    splits of the files must stay the same until the frame has been used, and so must the folders that
    are added to `made`.
    """
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, split, rows = LineRule(sep, quote), None, []
        for file, block, text in _lines(batches, codec):
            if split is None or (split.file, split.block) != (file, block):
                if split:
                    rows.append((split.file, split.block, split.summary()))
                split = _Split(file, block, rule, width)
            split.add(text)
        if split:
            rows.append((split.file, split.block, split.summary()))
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["file", "block", "summary"])

    lines = read_lines(spark, files, returns)
    splits: dict[str, list] = {}
    for r in map_arrow(lines, summed, "file string, block bigint, summary string").collect():  # one row per split
        splits.setdefault(r.file, []).append((r.block, json.loads(r.summary)))
    known, headers, crossing = {}, {}, False
    for file, own in splits.items():
        own.sort(key=lambda b: b[0])
        headers[file] = own[0][1]["header"]
        for block, winners in _put_together(own, width).items():
            if winners != (None, None):
                known[file, block] = winners
                crossing = True

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, framer, out = LineRule(sep, quote), None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(_KINDS)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], _NAMES)
            out.clear()
            return made

        size = 0
        for file, block, text in _lines(batches, codec):
            if framer is None or (framer.file, framer.block) != (file, block):
                if framer:
                    framer.finish()
                framer = _Framer(file, block, rule, width, known.get((file, block), (None, None)), headers.get(file), out)
            framer.add(text)
            size += len(text)
            if size > 1 << 20 and out:
                yield batch()
                size = 0
        if framer:
            framer.finish()
        yield batch()

    rows = map_arrow(lines, framed, _ROWS)
    opened = (F.col("kind") == OPEN).alias("open")
    if not crossing:
        return rows.select("file", "text", opened)
    # a record over the end of a split comes in pieces; the first stays in its place and gets the others' text
    pieces = rows.where(F.col("kind") == PIECE).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("at", "text"))).alias("pieces"))
    joined = pieces.select(
        F.col("file").alias("__file"), F.col("record").alias("__record"),
        F.regexp_replace(F.array_join("pieces.text", "\n"), "\r$", "").alias("__text"))
    # at most one record a split, written so that Spark knows their size and ships them only if they are small
    folder = new_folder(spark, "pieces")
    joined.write.parquet(folder)
    if made is not None:
        made.append(folder)
    joined = spark.read.schema(joined.schema).parquet(folder)
    kept = rows.where((F.col("kind") != PIECE) | (F.col("at") == F.col("record")))
    first = (F.col("kind") == PIECE) & (F.col("file") == F.col("__file")) & (F.col("record") == F.col("__record"))
    return kept.join(joined, first, "left").select("file", F.coalesce("__text", "text").alias("text"), opened)
