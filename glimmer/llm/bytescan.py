"""Vectorised scans over the UTF-8 bytes of an Arrow text column.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Words and lines are never turned into Python
objects here: they are byte spans of the column's own buffer, and their hashes come from one running sum over the
buffer, so a scan costs a few nanoseconds a byte whatever the number of words.

Hash of a span: sum(T[b_j] * R**j) mod 2**64 with random T and odd R, divided by R**start (odd, so invertible) and
then mixed. Two seeds give two independent hashes where 64 bits are not enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = bytes(LOWER)
BLANKS = b" \t\n\x0b\x0c\r"

#: Bytes of text that one vectorised step holds arrays for.
STEP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _trim() -> None:
    """Give freed memory back to the system: a worker's free lists otherwise stay as large as its largest batch."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    import ctypes

    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, kept up to STEP."""

    def __init__(self, seed: int):
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.root = (int(mix(np.array([seed + 77], U64))[0]) & ~7) | 3
        self.inverse = pow(self.root, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, STEP)
            with np.errstate(over="ignore"):
                up, down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, r, U64)]), dtype=U64) for r in (self.root, self.inverse))
            if n > STEP:
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_POWERS = {s: _Powers(s) for s in (1, 2)}


def texts(batch: pa.RecordBatch, column: str, limit: int = 4 * STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of at most ``limit`` bytes (a longer text stands alone); null is empty."""
    array = pc.fill_null(batch.column(column), "")
    wide = pa.types.is_large_string(array.type)
    bufs = array.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if bufs[1] is not None and len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if len(bufs) > 2 and bufs[2] is not None else np.zeros(0, np.uint8)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b
    if len(data) > limit:
        _trim()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and per text the index of its first word (one more at the end)."""
    inside = ~SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offs[:-1][offs[:-1] < len(data)]
    begin[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offs[1:][offs[1:] > 0] - 1
    last[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the \\n-split lines; every text has one line at least."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offs, breaks, "right") - 1
    counts = np.bincount(owner, minlength=len(offs) - 1) + 1 if len(offs) > 1 else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    starts, ends = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    starts[first[:-1]] = offs[:-1]
    ends[first[1:] - 1] = offs[1:]
    at = np.arange(len(breaks)) + owner
    ends[at] = breaks
    starts[at + 1] = breaks + 1
    return starts, ends, first


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the blanks at both ends; an all-blank span becomes empty at its start."""
    inside = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(inside, starts), np.searchsorted(inside, ends)
    some = b > a
    if not len(inside):
        return starts, starts
    return np.where(some, inside[np.minimum(a, len(inside) - 1)], starts), np.where(some, inside[np.maximum(b - 1, 0)] + 1, starts)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint spans; with ``lower``, of the span with A-Z lower-cased."""
    powers, out, n, a = _POWERS[seed], np.empty(len(starts), U64), len(starts), 0
    table = powers.table[LOWER] if lower else powers.table
    with np.errstate(over="ignore"):
        while a < n:
            at = starts[a]
            b = max(a + 1, int(np.searchsorted(ends, at + STEP - 1, "right")))
            piece = data[at : ends[b - 1]]
            up, down = powers.upto(len(piece) + 1)
            total = np.empty(len(piece) + 1, U64)
            total[0] = 0
            np.cumsum(table[piece] * up[: len(piece)], out=total[1:])
            s, e = starts[a:b] - at, ends[a:b] - at
            out[a:b] = (total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
            a = b
    return mix(out)


_ODD = mix(np.arange(1, 4097, dtype=U64)) | U64(1)


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, inside): of the ``width`` words from each position; inside tells which do not run over a text's end."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out += h[j : n + j] * _ODD[j]
    ends = np.repeat(first[1:], np.diff(first))[:n]
    return mix(out), np.arange(n) + width <= ends


def sequences(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole sequence of word hashes."""
    at = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    out = []
    with np.errstate(over="ignore"):
        for seed in (3, 4):
            place = mix(at.astype(U64) * U64(2) + U64(seed << 40))
            total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ place), dtype=U64)])
            out.append(mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(U64)))
    return out[0], out[1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
