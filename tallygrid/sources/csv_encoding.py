"""Character encoding of text files: UTF-8, UTF-16, GB18030 or Latin-1.

`decide` is the one rule, applied by `audit_encodings` to every line of any number of
files, where the UTF-8 test stays in the JVM and only lines that fail it are looked at in
Python. `encoding_of` applies it to bytes at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.session import map_pandas

# bytes and lines of a file's head, from which its delimiter and header are read
HEAD_BYTES = 100_000
HEAD_LINES = 1_000

UTF8, UTF16, GB18030, LATIN1 = "UTF-8", "UTF-16", "GB18030", "ISO-8859-1"
_BOMS = ((b"\xef\xbb\xbf", UTF8), (b"\xff\xfe", UTF16), (b"\xfe\xff", UTF16))


def decide(bom: str | None, utf8: bool, nul: bool, gb: bool, paired: int, unpaired: int) -> str:
    """The encoding the evidence speaks for.

    `gb` tells that the bytes are valid GB18030; `paired` counts its two-byte
    characters from the plain Chinese planes, `unpaired` the others, which is
    what accented Latin-1 letters look like. `nul` tells that at least a quarter of the
    bytes are zero, as in UTF-16 text without a mark; a stray zero byte says nothing.
    """
    if bom:
        return bom
    if nul:
        return UTF16
    if utf8:
        return UTF8
    return GB18030 if gb and paired > unpaired else LATIN1


def bom_of(head: bytes) -> str | None:
    return next((name for mark, name in _BOMS if head.startswith(mark)), None)


def gb_evidence(raw: bytes) -> tuple[bool, int, int]:
    try:
        text = raw.decode("gb18030")
    except UnicodeDecodeError:
        return False, 0, 0
    wide = [c.encode("gb18030") for c in text if ord(c) > 0x7F]
    paired = sum(1 for b in wide if len(b) == 2 and b[0] >= 0xA1 and b[1] >= 0xA1)
    return True, paired, len(wide) - paired


def head_bytes(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, cut at a line end."""
    start = F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES)
    out = bytearray()
    # a collected limit reads the first split only
    for (line,) in spark.read.text(path).select(start).limit(HEAD_LINES).collect():
        if len(out) >= HEAD_BYTES:
            break
        out += bytes(line) + b"\n"
    return bytes(out)


def encoding_of(raw: bytes) -> str:
    try:
        raw.decode("utf-8")
        utf8 = True
    except UnicodeDecodeError:
        utf8 = False
    return decide(bom_of(raw), utf8, bool(raw) and raw.count(0) * 4 >= len(raw), *gb_evidence(raw))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of one file, or of the first of a folder, judged by all its lines."""
    found = audit_encodings(spark, [path]).orderBy("file").first()
    return found.encoding if found else UTF8


def _look_at_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [gb_evidence(bytes(v)) for v in batch["value"]]
        evidence = pd.DataFrame(found, columns=["gb", "paired", "unpaired"])
        evidence.insert(0, "file", batch["file"].to_numpy())
        yield (
            evidence.groupby("file", as_index=False)
            .agg(gb=("gb", "all"), paired=("paired", "sum"), unpaired=("unpaired", "sum"))
        )


def audit_encodings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """`(file, lines, encoding)` for every file, judged by all its lines.

    Each task boils its lines down to one row per file, so a file that holds a
    third of all lines is spread over as many tasks as it has splits.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"),
        (F.col("_metadata.file_block_start") == 0).alias("first_split"),
    )
    odd = lines.where(~F.is_valid_utf8(F.col("value").cast("string"))).select("file", "value")
    evidence = (
        map_pandas(odd, _look_at_lines, "file string, gb boolean, paired bigint, unpaired bigint")
        .groupBy("file")
        .agg(F.bool_and("gb").alias("gb"), F.sum("paired").alias("paired"), F.sum("unpaired").alias("unpaired"))
    )
    start = F.hex(F.substring("value", 1, 3))
    bom8 = F.col("first_split") & (start == "EFBBBF")
    bom16 = F.col("first_split") & (start.startswith("FFFE") | start.startswith("FEFF"))
    size = F.octet_length("value")
    zeros = size - F.octet_length(F.replace(F.col("value").cast("string"), F.lit("\x00"), F.lit("")))
    whole = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.bool_or(bom8).alias("bom8"), F.bool_or(bom16).alias("bom16"),
        (F.sum(zeros) * 4 >= F.greatest(F.sum(size), F.lit(1))).alias("nul"), F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))).alias("utf8"),
    )
    chinese = F.coalesce(F.col("gb") & (F.col("paired") > F.col("unpaired")), F.lit(False))
    return whole.join(evidence, "file", "left").select(
        "file", "lines",
        F.when(F.col("bom16"), UTF16).when(F.col("bom8"), UTF8).when(F.col("nul"), UTF16)
        .when(F.col("utf8"), UTF8).when(chinese, GB18030).otherwise(LATIN1).alias("encoding"),
    )
