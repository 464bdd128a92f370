"""What the lines of text files tell before they are parsed, from one pass over all of them.

`line_facts` gives each file's encoding, first line, and for every separator and quote how many
lines hold how many fields. Lines are looked at in Arrow batches; a task boils its
lines down to a few rows per file, so a file of any size is spread over its splits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.session import map_arrow
from tallygrid.sources.csv_dialect import DELIMITERS, QUOTES
from tallygrid.sources.csv_encoding import bom_of, decide, gb_evidence

_SCHEMA = (
    "file string, pair int, width bigint, n bigint, size bigint, zeros bigint, utf8 boolean, gb boolean, paired bigint, "
    "unpaired bigint, bom string, header binary, inner_cr bigint, odd0 bigint, odd1 bigint"
)
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]
#: The row of a file's plain facts, among the rows of its field counts.
_PLAIN = -1


@dataclass
class LineFacts:
    """One file, by a path that readers take: its lines are `\\n` apart, or `\\r` where `returns` is set."""

    file: str
    encoding: str
    header: bytes | None
    returns: bool
    odd: tuple[int, int]          # lines with an odd number of each of QUOTES
    widths: dict[tuple[str, str], Counter] = field(default_factory=dict)   # (quote, separator): fields -> lines


def read_lines(spark: SparkSession, paths: str | list[str], returns: bool = False) -> DataFrame:
    """`(file, block, value)` of every line, in file order within a task. `\\r` at a line's end stays, unless it ends lines itself."""
    reader = spark.read if returns else spark.read.option("lineSep", "\n")
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """`(file, block, values)` of each stretch of a batch that comes from one split."""
    files, blocks, values = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
    if not len(values):
        return
    ends = np.union1d(pc.run_end_encode(files).run_ends.to_numpy(), np.append(np.flatnonzero(np.diff(blocks)) + 1, len(values)))
    start = 0
    for end in ends.tolist():
        yield files[start].as_py(), int(blocks[start]), values.slice(start, end - start)
        start = end


class _Tally:
    """The facts of one file's lines within a task."""

    def __init__(self):
        self.size = self.zeros = self.paired = self.unpaired = self.inner_cr = 0
        self.utf8 = self.gb = True
        self.bom = self.header = None
        self.odd = [0, 0]
        self.widths: dict[int, Counter] = defaultdict(Counter)

    def add(self, block: int, values: pa.Array) -> None:
        if block == 0 and self.header is None:
            first = next((v for v in values if v.as_py().strip()), None)
            if self.bom is None:
                self.bom = bom_of(values[0].as_py()[:3]) or ""
            self.header = first.as_py() if first is not None else None
        offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.size += len(data)
        self.zeros += int(np.count_nonzero(data == 0))
        try:
            values.cast(pa.string())
        except pa.ArrowInvalid:
            self._other_encoding(values)
        returns = np.flatnonzero(data == 13) + offsets[0]
        self.inner_cr += len(returns) - int(np.isin(returns, offsets[1:] - 1).sum())
        lines = values.filter(pc.greater(pc.binary_length(values), 1))  # not blank
        plain = [pc.count_substring(lines, s).to_numpy() for s in DELIMITERS]
        for q, quote in enumerate(QUOTES):
            quotes = pc.count_substring(lines, quote).to_numpy()
            self.odd[q] += int((quotes % 2).sum())
            at = np.flatnonzero(quotes)
            # a quote opens where a field begins; doubled, it is text
            quoted = f"(^|[{''.join(DELIMITERS)}]){quote}(?:[^{quote}]|{quote}{quote})*{quote}"
            bare = pc.replace_substring_regex(lines.take(pa.array(at)), quoted, "\\1") if len(at) else None
            for s, sep in enumerate(DELIMITERS):
                counts = plain[s]
                if bare is not None:
                    counts = counts.copy()
                    counts[at] = pc.count_substring(bare, sep).to_numpy()
                width, n = np.unique(counts, return_counts=True)
                for w, k in zip(width.tolist(), n.tolist()):
                    self.widths[q * len(DELIMITERS) + s][w + 1] += k

    def _other_encoding(self, values: pa.Array) -> None:
        self.utf8 = False
        for v in values.to_pylist():
            try:
                v.decode()
            except UnicodeDecodeError:
                gb, paired, unpaired = gb_evidence(v)
                self.gb &= gb
                self.paired += paired
                self.unpaired += unpaired

    def rows(self, file: str) -> Iterator[tuple]:
        rest = (None,) * (len(_NAMES) - 4)
        for pair, counts in self.widths.items():
            for width, n in counts.items():
                yield file, pair, width, n, *rest
        yield (file, _PLAIN, 0, 0, self.size, self.zeros, self.utf8, self.gb, self.paired, self.unpaired, self.bom, self.header,
               self.inner_cr, *self.odd)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: dict[str, _Tally] = {}
    for batch in batches:
        for file, block, values in runs(batch):
            if file not in tallies:
                tallies[file] = _Tally()
            tallies[file].add(block, values)
    rows = [row for file, tally in tallies.items() for row in tally.rows(file)]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in _SCHEMA.split(", ")]
    columns = list(zip(*rows)) or [()] * len(types)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _NAMES)


def line_facts(spark: SparkSession, paths: str | list[str], encoding: str | None = None, returns: bool = False) -> list[LineFacts]:
    """The facts of every file of `paths`, by path. What comes to the driver is a few rows per file."""
    found = map_arrow(read_lines(spark, paths, returns), _tally, _SCHEMA).groupBy("file", "pair", "width").agg(
        *(F.sum(c).alias(c) for c in ("n", "size", "zeros", "paired", "unpaired", "inner_cr", "odd0", "odd1")),
        *(F.bool_and(c).alias(c) for c in ("utf8", "gb")), *(F.max(c).alias(c) for c in ("bom", "header"))).collect()
    facts = {}
    for r in found:
        if r.pair == _PLAIN:
            own = encoding or decide(r.bom or None, r.utf8, r.zeros * 4 >= max(r.size, 1), r.gb and not r.utf8, r.paired, r.unpaired)
            header = bytes(r.header) if r.header is not None else None
            facts[r.file] = LineFacts(unquote(r.file), own, header, returns, (r.odd0, r.odd1)), r.inner_cr
    again = []
    for r in found:
        if r.pair != _PLAIN:
            quote, sep = divmod(r.pair, len(DELIMITERS))
            facts[r.file][0].widths.setdefault((QUOTES[quote], DELIMITERS[sep]), Counter())[r.width] += r.n
    for file, (own, inner) in list(facts.items()):
        # a file of one line that holds line ends of the old kind
        if inner and not returns and sum(next(iter(own.widths.values()), Counter()).values()) <= 1:
            again.append(own.file)
            del facts[file]
    out = [own for own, _ in facts.values()]
    if again:
        out += line_facts(spark, again, encoding, returns=True)
    return sorted(out, key=lambda f: f.file)
