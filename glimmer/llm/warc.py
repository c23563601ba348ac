"""WARC records in seekable Zstandard bundles.

Each task groups its records into independent zstandard frames of about FRAME bytes and writes one bundle:

    data frames | index frame (skippable 0x184D2A50: zstandard-compressed JSON lines
    [record id, frame, offset in the frame, length]) | seek table (skippable 0x184D2A5E: u32 compressed and u32
    decompressed size of every frame, then u32 number of frames, a descriptor byte 0 and 0x8F92EAB1)

The seek table is that of the public zstd seekable format, so a record is fetched by decompressing one frame. Equal
payloads are found beforehand on (SHA-1, length, page_id) rows only; pages move no payload unless the table of
repeated digests is too large to broadcast.

Cases: null html is the empty payload, null url an empty target; equal payloads of at least ``min_bytes`` bytes keep
the smallest page_id as response and the rest refer to it; rows that repeat that very page_id are responses too, for
a record can't revisit itself; a null page_id never is referred to, and a group of nulls alone is all responses; a
payload longer than a frame has a frame of its own; equal rows have record ids of their own; an empty table writes nothing and gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Reader, TaskFile
from .shared import folder, keep, small

FRAME = 1 << 20
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_SEEK, _INDEX, _MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str, sha: str, row: str = "") -> str:
    """The same for a page wherever it is written; ``row`` tells equal pages apart."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{url}|{sha}|{row}')}>"


def record(page_id: int | None, url: str, payload: bytes, first: int | None = None, first_url: str = "", row: str = "") -> tuple[str, bytes]:
    """(record id, bytes). A revisit has no payload of its own; its headers say what it had and where it is. Where pages
    of its payload are equal (``row`` is given), their ids hold their places, which a revisit elsewhere can't know."""
    sha, revisit = digest(payload), first is not None and first != page_id
    rid = record_id(page_id, url, sha, row)

    def plain(u: str) -> str:
        return u.replace("\r", "%0D").replace("\n", "%0A")

    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {plain(url)}", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {plain(first_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {first}"]
        if not row:
            head.append(f"WARC-Refers-To: {record_id(first, first_url, sha)}")
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, end) of the record at an offset."""
    cut = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[at:cut].decode().split("\r\n")[1:])
    n = int(head["Content-Length"])
    return head, data[cut + 4 : cut + 4 + n], cut + 4 + n + 4


class Bundle:
    """Writes one bundle; holds one frame."""

    def __init__(self, out, frame: int = FRAME):
        self.out, self.frame, self.table, self.index, self.held, self.n = out, frame, [], [], [], 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, rid: str, data: bytes) -> None:
        if self.n and self.n + len(data) > self.frame:
            self._flush()
        self.index.append(json.dumps([rid, len(self.table), self.n, len(data)]))
        self.held.append(data)
        self.n += len(data)

    def _flush(self) -> None:
        raw = b"".join(self.held)
        data = self.zstd.compress(raw)
        self.out.write(data)
        self.table.append((len(data), len(raw)))
        self.held, self.n = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = self.zstd.compress("\n".join(self.index).encode())
        self.out.write(struct.pack("<II", _INDEX, len(index)) + index)
        self.table.append((len(index) + 8, 0))
        seek = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, _MAGIC)
        self.out.write(struct.pack("<II", _SEEK, len(seek)) + seek)


class SeekableBundle:
    """Random access by record id."""

    def __init__(self, uri: str):
        self.file = Reader(uri)
        n, _, magic = struct.unpack("<IBI", self.file.read(self.file.size - 9, 9))
        if magic != _MAGIC:
            raise ValueError(f"{uri} has no seek table")
        at = self.file.size - 9 - 8 * n
        sizes = list(struct.iter_unpack("<II", self.file.read(at, 8 * n)))
        self.frames, start = [], 0
        for c, d in sizes:
            self.frames.append((start, c, d))
            start += c
        start, c, _ = self.frames.pop()
        lines = zstandard.ZstdDecompressor().decompress(self.file.read(start + 8, c - 8)).decode().split("\n")
        self.index = {x[0]: x[1:] for x in map(json.loads, filter(None, lines))}

    def data(self, k: int) -> bytes:
        start, c, d = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read(start, c), max_output_size=d)

    def record(self, rid: str) -> tuple[dict[str, str], bytes]:
        frame, at, _ = self.index[rid]
        return parse(self.data(frame), at)[:2]

    def each(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.frames)):
            data, at = self.data(k), 0
            while at < len(data):
                head, body, at = parse(data, at)
                yield head, body


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, frame: int = FRAME) -> DataFrame:
    """Write bundles; returns (kept) one row a bundle: uri, n_records."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).cast("long").alias("n"))
    pages_of = rows.groupBy("sha", "n", "page_id", "url").agg(F.count(F.lit(1)).alias("c"))
    repeats = pages_of.groupBy("sha", "n").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.sum("c").alias("k"), (F.max("c") > 1).alias("equal")).filter("k > 1")
    response = F.when(F.col("n") >= min_bytes, F.col("first"))
    repeats = small(keep(repeats.select("sha", "n", response["page_id"].alias("first"), response["url"].alias("first_url"), "equal"), "payloads"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                for page_id, url, text, first, first_url, equal in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "first_url", "equal"))):
                    if out is None:
                        out = TaskFile(path, ".warc.zst")
                        bundle = Bundle(out, frame)
                    bundle.add(*record(page_id, url, text.encode(), first, first_url or "", f"{out.name}-{n}" if equal else ""))
                    n += 1
        if out is not None:
            bundle.close()
            yield pa.record_batch([pa.array([out.close()]), pa.array([n], pa.int64())], names=["uri", "n_records"])

    joined = rows.join(repeats, ["sha", "n"], "left").select("page_id", "url", "html", "first", "first_url", "equal")
    return keep(joined.mapInArrow(task, "uri string, n_records long"), "bundles")


def read(bundles: DataFrame, n: int) -> DataFrame:
    """Every record of the bundles; a response's length and digest are taken from its body."""

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows = []
                for head, body in SeekableBundle(uri).each():
                    response = head["WARC-Type"] == "response"
                    rows.append((number(head.get("X-Page-ID")), len(body) if response else int(head["X-Payload-Length"]), digest(body) if response else head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], number(head.get("X-Refers-To-Page-ID"))))
                columns = list(zip(*rows)) or [()] * 5
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("uri").repartition(max(1, n)).mapInArrow(task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder(spark, "warc"))
    return read(bundles, bundles.count())


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first
  FROM p),
b AS (
  SELECT *, array_to_string(list_transform(string_split(sha, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (instr('0123456789abcdef', c) - 1), 4)), '') AS bits
  FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1
         + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT
         + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
