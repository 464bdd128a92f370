"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with some whole records, and at
its end a skippable frame with the sizes of all frames: the seek table. Reading one
record takes the table, one frame, and the record's place in it. The index, a Parquet
table (page_id, record_id, bundle, frame, place, length), maps records to these.

Bundles are written by tasks under names of their own attempt; the index, written
afterwards, names those that count. Folders are paths or addresses that both Spark and
`pyarrow.fs` understand.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.shared import map_arrow

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
#: Readers of a whole archive, at most.
READERS = 10_000
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable Zstandard format and of the WARC profile for revisits.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "page_id bigint, record_id string, bundle string, frame int, place bigint, length bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(record_id: str) -> int | None:
    page_id = record_id.split(":")[2]
    return int(page_id) if page_id else None


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """A response record, or a revisit of the page `refers_to`, whose block ends before the payload."""
    digest = base32_sha1(payload)
    name = _record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Bundle:
    """A bundle being written."""

    def __init__(self, folder: str, name: str):
        self.name, self.frames, self.held, self.size = name, [], bytearray(), 0
        system, path = fs.FileSystem.from_uri(folder)
        self.out = system.open_output_stream(f"{path}/{name}", compression=None)
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame and the place in it that the record gets."""
        if self.held and len(self.held) + len(record) > FRAME_BYTES:
            self.flush()
        place = len(self.held)
        self.held += record
        return len(self.frames), place

    def flush(self) -> None:
        if self.held:
            packed = self.compressor.compress(bytes(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.held)))
            self.size += len(packed)
            self.held = bytearray()

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        table = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Begin, packed and unpacked size of each frame of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * width)
    entries, begin, out = file.read(n * width), 0, []
    for k in range(n):
        packed, unpacked = struct.unpack_from("<II", entries, k * width)
        out.append((begin, packed, unpacked))
        begin += packed
    return out


def _frame(file: pa.NativeFile, table: list[tuple[int, int, int]], k: int) -> bytes:
    begin, packed, unpacked = table[k]
    file.seek(begin)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=max(1, unpacked))


def _parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and where it ends."""
    head = data.index(b"\r\n\r\n", at)
    lines = data[at:head].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    begin = head + 4
    end = begin + int(headers["Content-Length"])
    return headers, data[begin:end], end + 4


def _row(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))
    kind, refers_to = headers["WARC-Type"], headers.get("WARC-Refers-To")
    digest = base32_sha1(payload) if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha1:")
    return (_page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, kind,
            _page_of(refers_to) if refers_to else None, payload if kind == "response" else None)


_RECORDS = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
            "payload binary")


def _record_batch(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names = [f.split()[0] for f in _RECORDS.split(", ")]
    n = len(kinds) if payload else len(kinds) - 1
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns[:n], kinds)], names[:n])


def _schema(payload: bool) -> str:
    return _RECORDS if payload else _RECORDS.removesuffix(", payload binary")


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write a WARC record for every row of `pages (page_id, url, html)` to a new folder.

    Of records with equal payloads of at least `least_bytes` bytes, those with the smallest
    page_id are responses and the others revisit it; smaller payloads are all responses.

    A null html is an empty payload, a null url an empty address. A null page_id counts as
    larger than any other; its records carry an empty id, and are responses where no page
    with an id has their payload. Rows that repeat a page_id are records each. An empty table gives an
    archive without records. Other columns are left out.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"))
    facts = rows.select("page_id", "sha1", F.octet_length("html").alias("size")).where(F.col("size") >= least_bytes)
    first = facts.groupBy("sha1").agg(F.min("page_id").alias("refers_to")).where("refers_to IS NOT NULL")
    # only revisits have to find their way to the pages' rows
    again = facts.join(first, "sha1").where("page_id IS NULL OR page_id > refers_to").select(
        F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1"), "refers_to").distinct()
    told = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha1") == F.col("again_sha1")), "left")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{path}/bundles", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        label = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        bundle, number = None, 0
        for batch in batches:
            out = []
            for page_id, url, text, refers_to in zip(*(batch.column(c) for c in range(4))):
                name, record = _record(page_id.as_py(), url.as_py(), text.as_buffer().to_pybytes(), refers_to.as_py())
                if bundle and bundle.size > BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
                if bundle is None:
                    bundle, number = _Bundle(f"{folder}/bundles", f"bundle-{label}-{number}.warc.zst"), number + 1
                frame, place = bundle.add(record)
                out.append((page_id.as_py(), name, bundle.name, frame, place, len(record)))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _INDEX.split(", ")])
        if bundle:
            bundle.close()

    map_arrow(told.select("page_id", "url", "html", "refers_to"), write, _INDEX).write.parquet(f"{folder}/index")


def bundle_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def read_bundles(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records of an archive, frame after frame: `(page_id, url, payload_bytes, payload_digest, record_type,
    refers_to[, payload])`. The digest of a response is that of the payload read, a revisit has its header's."""
    bundles = bundle_index(spark, folder).select("bundle").distinct()
    n = max(1, min(READERS, bundles.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(f"{folder}/bundles")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{path}/{name}") as file:
                    table = seek_table(file)
                    for k in range(len(table)):
                        data, at, rows = _frame(file, table, k), 0, []
                        while at < len(data):
                            headers, block, at = _parse(data, at)
                            rows.append(_row(headers, block))
                        yield _record_batch(rows, payload)

    # dealt out evenly: by key they would stay in the partitions of `distinct`, which may be merged into one
    return map_arrow(bundles.coalesce(1).repartition(n), read, _schema(payload))


def read_records(spark: SparkSession, folder: str, wanted: DataFrame, payload: bool = True) -> DataFrame:
    """The records of some rows of the index: each takes its bundle's seek table and one frame."""
    places = wanted.select("bundle", "frame", "place").repartition("bundle").sortWithinPartitions("bundle", "frame")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(f"{folder}/bundles")
        opened: tuple = (None, None, None, None, None)
        for batch in batches:
            rows = []
            for name, frame, place in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if opened[0] != name:
                    file = system.open_input_file(f"{path}/{name}")
                    opened = (name, file, seek_table(file), None, None)
                if opened[3] != frame:
                    opened = (*opened[:3], frame, _frame(opened[1], opened[2], frame))
                headers, block, _ = _parse(opened[4], place)
                rows.append(_row(headers, block))
            yield _record_batch(rows, payload)

    return map_arrow(places, read, _schema(payload))
