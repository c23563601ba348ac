"""Token-ID / binary output with fixed-width bit packing.

Every id takes the fewest bits that hold the vocabulary. Ids stand in blocks of equal length, each starting at a
byte, so block k is found by arithmetic or in the offset table and unpacked with numpy alone; a document's ids are
read at random from the blocks that hold them. A file:

    b"TIDBITS1" | blocks | block offsets u64 * (n_blocks + 1) | doc_id i64 * n_docs | doc start u64 * (n_docs + 1) |
    null doc_id flags u8 * n_docs | footer: bits u32, block ids u32, n_ids u64, n_docs u64, n_blocks u64, tables at u64, b"TIDBITS1"

all little-endian. Files are in ascending doc_id order, one per range partition; texts move once, in that range
sort. What precedes a file is a prefix sum over the files' footers, one small row a file.

Cases: null or empty texts give the end id alone; null doc_ids come first; rows that share a doc_id stand side by
side ordered by text, so repeated rows are interchangeable; a very long text is encoded whole and its ids are flushed
block by block; the string of a special token in a text is that token, as the library has it; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoding import default_path, encoder
from .files import Reader, TaskFile
from .shared import documents, folder, keep

MAGIC = b"TIDBITS1"
BLOCK = 1 << 16
END_ID = 2
_FOOT = struct.Struct("<IIQQQQ8s")


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    rows = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (rows.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.offsets, self.doc_ids, self.starts, self.n = [out.write(MAGIC) + len(MAGIC)], [], [0], 0
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n += len(ids)
        self.starts.append(self.n)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 16 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            data = pack(ids[a : min(a + self.block, whole)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        at = self.offsets[-1]
        for values, kind in ((self.offsets, "<u8"), ([0 if d is None else d for d in self.doc_ids], "<i8"), (self.starts, "<u8"), ([d is None for d in self.doc_ids], "u1")):
            self.out.write(np.array(values).astype(kind).tobytes())
        self.out.write(_FOOT.pack(self.bits, self.block, self.n, len(self.doc_ids), len(self.offsets) - 1, at, MAGIC))


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        self.file = Reader(uri)
        self.bits, self.block, self.n_ids, self.n_docs, n_blocks, at, magic = _FOOT.unpack(self.file.read(self.file.size - _FOOT.size, _FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        sizes = [8 * (n_blocks + 1), 8 * self.n_docs, 8 * (self.n_docs + 1), self.n_docs]
        data, cut = self.file.read(at, sum(sizes)), np.cumsum([0, *sizes])
        self.offsets, self.doc_ids, self.starts, self.null = (np.frombuffer(data[cut[i] : cut[i + 1]], k) for i, k in enumerate(("<u8", "<i8", "<u8", "u1")))

    def block_ids(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        return unpack(self.file.read(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])), n, self.bits)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first = start // self.block
        parts = [self.block_ids(k) for k in range(first, (end - 1) // self.block + 1)]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def each(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) in order, unpacking every block once."""
        k, held, at = -1, np.zeros(0, np.uint32), 0
        for i in range(self.n_docs):
            s, e = int(self.starts[i]), int(self.starts[i + 1])
            parts = [held[s - at :]]
            have = at + len(held)
            while have < e:
                k += 1
                parts.append(self.block_ids(k))
                have += len(parts[-1])
            held, at = np.concatenate(parts) if len(parts) > 1 else parts[0], s
            yield None if self.null[i] else int(self.doc_ids[i]), s, held[: e - s]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Encode and write; returns (kept) one row a file: uri, n_docs, n_ids and the ids of all files before it."""
    tokenizer = tokenizer or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, writer = encoder(tokenizer), None, None
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                texts = [(x or "").encode() for x in part.column("text").to_pylist()]
                if out is None:
                    out = TaskFile(path, ".tid")
                    writer = Writer(out, width(max(enc.vocabulary, end_id + 1)), block)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if out is not None:
            writer.close()
            yield pa.record_batch([pa.array([out.close()]), pa.array([len(writer.doc_ids)], pa.int64()), pa.array([writer.n], pa.int64())], names=["uri", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a doc_id of very many rows, the null one say, is cut at the beginnings of its texts
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = keep(ordered.mapInArrow(task, "uri string, n_docs long, n_ids long"), "token-files")
    before = F.sum("n_ids").over(W.orderBy("uri").rowsBetween(W.unboundedPreceding, -1))
    return written.withColumn("start", F.coalesce(before, F.lit(0)))


def read(files: DataFrame, n_files: int) -> DataFrame:
    """Every document of the files: doc_id, start over all files, n_tokens, crc32 of its ids as little-endian u32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                rows = [(d, start + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in TokenFile(uri).each()]
                yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("uri", "start").repartition(max(1, n_files)).mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    files = write(docs, folder(docs.sparkSession, "tokens"), tokenizer, end_id)
    return read(files, files.count())


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(documents(spark, sf_dir))
