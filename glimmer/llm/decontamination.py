"""Benchmark decontamination with spaced-seed hashing.

A seed is a fixed mask over consecutive words; its hash reads the words at the mask's ones and ignores the rest, so a
passage with some words replaced still meets several of its seeds. Hashes of all benchmark items at all positions are
joined with those of all documents; at every hit item and document are laid side by side on the hit's diagonal and
compared word by word, and the best stretch (a match counts 1, a substitution -2) is a leak if it is long enough and
similar enough, and so is the best of what it leaves of the diagonal on either side, again and again. The masks leave
no such stretch out. Of leaks of one item that overlap in the text the one with the most equal words stays, of equal
ones the first; others are all reported, so an item that leaks several times in a text has several rows.

Hits collapse to diagonals while they are read and diagonals are compared in arrays of at most CELLS words, so a text
that repeats itself costs its length times the item's and bounded memory.

The benchmark is the given query set: it is broadcast in blocks of at most BLOCK_WORDS words, one scan of the
documents a block, so memory is bounded whatever its size, and documents are neither shuffled nor paired with each
other.

Cases: null or empty texts and items have no words and no leaks; an item shorter than the longest mask is sought also
with masks of its own length; null ids are carried; equal rows and items are reported
each; very long texts are scanned whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .mixing import n_words
from .shared import documents, keep, keyed, keyed_join, tagged, untagged

#: Fixed masks of weight 6, chosen so that every stretch that is a leak meets one, wherever its replaced words are (the
#: tests try all patterns of up to 20 words; of longer ones, none that escapes has so many equal words).
MASKS = ("111111", "1110111", "11001111", "1010100111", "10100100111")
#: What they leave of items below MIN_WORDS, as masks of the whole item.
SHORT_MASKS = ("110111", "1101111", "110110111", "1101101111")
#: A leak is a stretch of at least so many words (the whole item if it is shorter), so many of them equal.
MIN_WORDS = 13
MIN_PERCENT = 75
BLOCK_WORDS = 500_000
#: Hits, and words of diagonals, that one vectorised step holds arrays for.
CELLS = 1 << 20
_FILTER = 1 << 22

U64 = np.uint64


def seeds(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a mask over every text."""
    span, n = len(mask), len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    out = np.full(n, int(mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64), U64)
    with np.errstate(over="ignore"):
        for j, bit in enumerate(mask):
            if bit == "1":
                out += h[j : n + j] * B._ODD[j]
    ends = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + span <= ends)
    return at, B.mix(out[at])


def best_stretches(equal: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece of ``equal`` (flat, of these sizes) the start and end of the stretch with the largest sum of +1 for
    equal and -2 for different words, the first of the longest such, and its equal words."""
    n = len(sizes)
    edge = np.concatenate([[0], np.cumsum(sizes + 1)])  # every piece begins with a sum of nothing
    first = edge[:-1]
    value = np.zeros(edge[-1], np.int64)
    body = np.ones(edge[-1], bool)
    body[first] = False
    value[body] = np.where(equal, 1, -2)
    owner = np.repeat(np.arange(n), sizes + 1)
    total = np.cumsum(value)
    total -= total[first][owner]
    # below all that came before, so that the running least begins anew with every piece
    drop = total - owner * (3 * int(sizes.max(initial=0)) + 1)
    low = np.minimum.accumulate(drop)
    fresh = np.concatenate([[True], low[1:] < low[:-1]])
    since = np.maximum.accumulate(np.where(fresh, np.arange(len(low)), 0))
    gain = drop - low
    best = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == best[owner])
    end = at[np.searchsorted(at, first)]
    start = since[end]
    ones = np.concatenate([[0], np.cumsum(value == 1)])
    return start - first, end - first, ones[end + 1] - ones[start + 1]


class Probe:
    """One block of items, with its seeds sorted by hash."""

    def __init__(self, ids: list, texts: list[str]):
        batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
        hs, counts = [np.zeros(0, U64)], []
        for _, _, data, offs in B.texts(batch, "text"):
            s, e, first = B.words(data, offs)
            hs.append(B.hashes(data, s, e, True))
            counts.append(np.diff(first))
        self.ids, self.h = ids, np.concatenate(hs)
        n = np.concatenate([*counts, np.zeros(0, np.int64)])
        self.first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        longest = max(map(len, MASKS))
        self.masks = [*MASKS, *("1" * k for k in sorted({int(k) for k in n if 0 < k < longest} - {len(MASKS[0])})), *(m for m in SHORT_MASKS if len(m) in set(n.tolist()))]
        parts = []
        for i, mask in enumerate(self.masks):
            at, g = seeds(self.h, self.first, mask)
            if i >= len(MASKS):  # only for items of just this length
                item = np.searchsorted(self.first, at, "right") - 1
                own = n[item] == len(mask)
                at, g = at[own], g[own]
            parts.append((g, at))
        g, at = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(g, kind="stable")
        self.seed, self.at = g[order], at[order]
        self.item = np.searchsorted(self.first, self.at, "right") - 1
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[(self.seed & U64(_FILTER - 1)).astype(np.int64)] = True

    def diagonals(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (text, item, shift) of all diagonals that a seed meets: word k of all items' words faces word k + shift."""
        n_items, below = len(self.ids), len(self.h)  # a place in the items is counted through all of them
        span = len(h) + below + 1
        keys = np.zeros(0, np.int64)
        for mask in self.masks:
            at, g = seeds(h, first, mask)
            hit = np.flatnonzero(self.maybe[(g & U64(_FILTER - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(self.seed, g[hit], "left"), np.searchsorted(self.seed, g[hit], "right")
            hit, lo, k = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            done = np.concatenate([[0], np.cumsum(k)])
            a = 0
            while a < len(hit):
                b = max(a + 1, int(np.searchsorted(done, done[a] + CELLS, "right")) - 1)
                which = np.repeat(lo[a:b] - (done[a:b] - done[a]), k[a:b]) + np.arange(done[b] - done[a])
                where = np.repeat(at[hit[a:b]], k[a:b])
                text = np.searchsorted(first, where, "right") - 1
                fresh = np.unique((text * n_items + self.item[which]) * span + (where - self.at[which] + below))
                keys = np.union1d(keys, fresh) if len(keys) else fresh
                a = b
        pair, shift = keys // span, keys % span - below
        return np.stack([pair // n_items, pair % n_items, shift], axis=1)

    def stretches(self, h: np.ndarray, first: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Rows (text, item, start and end in h, start in the item's words, equal words) of all leaks on diagonals."""
        text, item, shift = lines.T
        least = np.minimum(MIN_WORDS, np.diff(self.first)[item])
        lo, hi = np.maximum(self.first[item], first[text] - shift), np.minimum(self.first[item + 1], first[text + 1] - shift)
        todo = np.stack([text, item, shift, least, lo, hi], axis=1)
        out = [np.zeros((0, 6), np.int64)]
        while len(todo := todo[todo[:, 5] - todo[:, 4] >= todo[:, 3]]):
            done, a, left = np.concatenate([[0], np.cumsum(todo[:, 5] - todo[:, 4])]), 0, []
            while a < len(todo):
                b = max(a + 1, int(np.searchsorted(done, done[a] + CELLS, "right")) - 1)
                part, sizes = todo[a:b], todo[a:b, 5] - todo[a:b, 4]
                cell = np.arange(done[b] - done[a]) + np.repeat(part[:, 4] - (done[a:b] - done[a]), sizes)
                s, e, same = best_stretches(self.h[cell] == h[cell + np.repeat(part[:, 2], sizes)], sizes)
                some = e > s
                part, s, e, same = part[some], part[some, 4] + s[some], part[some, 4] + e[some], same[some]
                good = (e - s >= part[:, 3]) & (100 * same >= MIN_PERCENT * (e - s))
                out.append(np.stack([part[:, 0], part[:, 1], s + part[:, 2], e + part[:, 2], s - self.first[part[:, 1]], same], axis=1)[good])
                left += [np.column_stack([part[:, :5], s]), np.column_stack([part[:, :4], e, part[:, 5]])]
                a = b
            todo = np.concatenate(left)
        return np.concatenate(out)

    def leaks(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, start and end word in the text, start in the item, equal words); no two of one item overlap."""
        found = self.stretches(h, first, self.diagonals(h, first))
        out, taken = [], {}
        for text, item, s, e, own, same in found[np.lexsort((found[:, 4], found[:, 2], -found[:, 5]))].tolist():
            starts, ends = taken.setdefault((text, item), ([], []))
            k = bisect.bisect_left(ends, s + 1)  # the first taken stretch that ends after this one's start
            if k < len(starts) and starts[k] < e:
                continue
            starts.insert(k, s)
            ends.insert(k, e)
            begin = int(first[text])
            out.append((text, item, s - begin, e - begin, own, same))
        return sorted(out)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, xh, item_id, start_word, end_word, item_start, n_equal): one row a leaked passage."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(n_words())).head()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_WORDS))
    rows, out = keyed(docs), None
    for k in range(n_blocks):
        part = (items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items).collect()
        shared = spark.sparkContext.broadcast(([r.item_id for r in part], [r.text for r in part]))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            probe = Probe(*shared.value)
            for batch in batches:
                for a, _, data, offs in B.texts(batch, "text"):
                    s, e, first = B.words(data, offs)
                    got = probe.leaks(B.hashes(data, s, e, True), first)
                    if got:
                        at = pa.array([a + x[0] for x in got])
                        yield pa.record_batch([batch.column("doc_id").take(at), batch.column("xh").take(at), pa.array([probe.ids[x[1]] for x in got], pa.int64()), *(pa.array([x[i] for x in got], pa.int64()) for i in (2, 3, 4, 5))], names=["doc_id", "xh", "item_id", "start_word", "end_word", "item_start", "n_equal"])

        found = rows.mapInArrow(task, "doc_id long, xh long, item_id long, start_word long, end_word long, item_start long, n_equal long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns; decided where they are read."""
    bad = keep(leaks(docs, items).select("doc_id", "xh").distinct(), "leaks")
    return untagged(keyed_join(tagged(docs), bad, "left_anti"), docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("xh")
