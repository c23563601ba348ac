"""Quality rules: compression bands.

A text that says the same thing again and again compresses too well, and one that says nothing (keys, encodings,
noise) hardly at all. Every text is compressed whole and in fixed chunks with zstandard; a ratio (compressed bytes
over bytes) outside the band for its length rejects it, and so does too large a share of bytes in chunks outside the
band for theirs. The last chunk is as long as what is left; texts of up to one chunk have no chunks but the whole.
Short texts carry the frame's overhead and have no history to refer to, so the bands depend on length.
Beside the verdict stand the counts of a plain base rule.

Cases: null or empty text has no words, fails the base rule and is rejected; texts of any length are measured whole,
a slice of the column at a time; rows are judged one by one, so repeated rows and ids get equal verdicts; a null
doc_id is carried; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import bytescan as B
from .shared import documents, keyed

#: (bytes up to, lowest ratio, highest ratio). The highest were fitted on pieces of documents labelled good: above the
#: largest ratio seen at each length, below that of base64 noise, which up to 128 bytes no ratio tells from prose.
BANDS = (
    (64, 0.0, 1.80), (128, 0.30, 1.20), (160, 0.30, 0.98), (200, 0.30, 0.93), (256, 0.30, 0.88), (384, 0.30, 0.83), (512, 0.30, 0.79), (768, 0.30, 0.76), (1024, 0.30, 0.74),
    (4096, 0.28, 0.66), (16384, 0.24, 0.60), (1 << 62, 0.20, 0.56),
)
LEVEL = 3
CHUNK_BYTES = 512
#: A text is rejected if more than this share of its bytes lies in chunks outside the band for their length.
BAD_CHUNKS = 0.3
MIN_WORDS = 10
REPEAT_WIDTH = 5
MAX_REPEAT_PERCENT = 20

SCHEMA = "doc_id long, xh long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks double, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80  # every byte but UTF-8's continuations: one a code point


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if n_bytes <= most)


def compression(text: bytes, compressor, bands=BANDS, chunk: int = CHUNK_BYTES, bad: float = BAD_CHUNKS) -> tuple[float, float, bool]:
    """(ratio of the whole, share of bytes in bad chunks, inside the bands). The last chunk may be shorter; a text of one
    chunk is judged whole only; an empty text is outside."""
    if not text:
        return 0.0, 0.0, False
    ratio = len(compressor.compress(text)) / len(text)
    low, high = band(len(text), bands)
    out = 0
    if len(text) > chunk:
        for i in range(0, len(text), chunk):
            part = text[i : i + chunk]
            c_low, c_high = band(len(part), bands)
            if not c_low <= len(compressor.compress(part)) / len(part) <= c_high:
                out += len(part)
    share = out / len(text)
    return ratio, share, low <= ratio <= high and share <= bad


def repeated_words(h: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Per text, the words that some window of ``width`` words covers which the text holds twice or more."""
    g, inside = B.windows(h, first, width)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(inside)
    key = g[at] ^ B.mix(owner[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[first[1:]] - total[first[:-1]]


def duplicate_lines(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of the text."""
    s, e, first = B.lines(data, offs)
    ts, te = B.stripped(data, s, e)
    use = np.flatnonzero(te > ts)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))[use]
    key = B.hashes(data, s[use], e[use]) ^ B.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(use), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    return np.bincount(owner[again], minlength=len(offs) - 1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for a, b, data, offs in B.texts(batch, "text"):
            s, e, first = B.words(data, offs)
            n = np.diff(first)
            inside = ~B.SPACE[data]
            chars = np.concatenate([[0], np.cumsum(inside & _LEADS[data])])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
            repeats = repeated_words(B.hashes(data, s, e), first, REPEAT_WIDTH)
            raw = data.tobytes()
            found = [compression(raw[offs[i] : offs[i + 1]], compressor) for i in range(b - a)]
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            fine = np.array([x[2] for x in found], bool)
            yield pa.record_batch(
                [batch.column("doc_id")[a:b], batch.column("xh")[a:b], pa.array(n, pa.int64()), pa.array(chars[offs[1:]] - chars[offs[:-1]], pa.int64()), pa.array(symbols[offs[1:]] - symbols[offs[:-1]], pa.int64()), pa.array(duplicate_lines(data, offs), pa.int64()), pa.array(repeats, pa.int64()), pa.array(failed), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()), pa.array(fine & ~failed)],
                names=["doc_id", "xh", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "bad_chunks", "kept"],
            )


def quality(docs: DataFrame) -> DataFrame:
    """Counts, ratios and verdict of every document; no shuffle."""
    return keyed(docs).mapInArrow(_measure, SCHEMA)


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.record_batch([pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.int64()), batch.column("text")], names=["doc_id", "xh", "text"])
        kept = [x.column("kept") for x in _measure(iter([keys]))]
        yield batch.filter(pa.concat_arrays(kept)) if kept else batch


def passing(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; judged where they are read, so the texts are not shuffled."""
    return docs.mapInArrow(_passing, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).drop("xh")
