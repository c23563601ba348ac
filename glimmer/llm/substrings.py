"""Substring dedup by level-wise doubling.

A window of W words can only be repeated if each shorter window inside it is. The levels are lengths, each half of the
next, up to W. At each level a W-window that is still a candidate is looked at through its anchor: the window of the
level's length inside it with the least hash (ties to the left), which equal W-windows agree on wherever they stand,
and which neighbouring windows mostly share. Anchors that occur once drop out with the windows that they stand for;
those repeated at one length alone are extended to the next, twice as long, and counted again; and so on until no
candidate survives or the length is W, where every window is its own anchor.

Texts with equal word sequences are one unit that counts as repeated, so a large group of copies costs one text.
Levels shuffle (hash, unit, first and last window) rows; counts are combined before the shuffle. Hashes that very many
rows hold are brought back to their rows by a broadcast behind a check of its size, so they do not meet in one task.
Texts are read again for the units that still have candidates, by one kind of join at every size: a broadcast table of
the wanted keys' classes, at most CLASSES longs, passes over most others before the rest is shuffled and joined. Where
there are more candidates than classes it passes over few, and each level may shuffle the texts once.

Windows of W words are compared by two independent 64-bit hashes; shorter ones by one, for there a chance agreement
costs a candidate and no more.

Cases: null or empty text has no words; texts shorter than a window lose nothing; windows may overlap and may repeat
within one text; rows that share a doc_id, or are equal, are separate documents; any length of text is processed
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .shared import documents, fits, keep, keyed, small

WIDTH = 35
#: No level is shorter than so many words.
SHORTEST = 8
#: A hash of more rows than this is hot.
HOT = 2_000
#: Texts are looked up by this many classes of their keys before they are shuffled to what is wanted of them.
CLASSES = 1 << 21
U64 = np.uint64


def levels(width: int, shortest: int = SHORTEST) -> list[int]:
    """``width`` and what halving it (rounded up) gives down to ``shortest`` words, ascending."""
    out = [width]
    while (out[-1] + 1) // 2 >= shortest and out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def sliding_least(g: np.ndarray, span: int) -> np.ndarray:
    """Where the least of g[i : i + span] stands, the first of equals, for every i; by spans of doubling length."""
    where, have = np.arange(len(g)), 1
    while have < span:
        step = min(have, span - have)
        left, right = where[: len(where) - step], where[step:]
        where = np.where(g[right] < g[left], right, left)
        have += step
    return where


def anchors(h: np.ndarray, first: np.ndarray, width: int, length: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first and last window) of the anchors of this length of the ``width``-word windows, of those
    only whose starts are ``alive``; positions ascend."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, _ = B.windows(h, first, length)
    ends = np.repeat(first[1:], np.diff(first))[:n]
    inside = np.arange(n) + width <= ends
    at = np.flatnonzero(inside if alive is None else inside & alive[:n])
    where = sliding_least(g, width - length + 1)[:n][at]
    # where never descends, so the windows of one anchor stand together (or with dropped ones between them)
    cut = np.flatnonzero(np.diff(where, prepend=-1))
    last = np.concatenate([cut[1:], [len(at)]]) - 1 if len(cut) else cut
    return where[cut], g[where[cut]], at[cut], at[last]


def joined(raw: bytes, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> bytes:
    return b" ".join([raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())])


def _first_level(width: int, length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in B.texts(batch, "text"):
                s, e, first = B.words(data, offs)
                h = B.hashes(data, s, e)
                one, two = B.sequences(h, first)
                where, g, lo, hi = anchors(h, first, width, length)
                bounds = np.searchsorted(lo, first)
                owner = np.repeat(np.arange(b - a), np.diff(bounds))
                raw = data.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[offs[i] : offs[i + 1]].split())).hexdigest() for i in range(b - a)]
                yield pa.record_batch(
                    [batch.column("doc_id")[a:b], batch.column("xh")[a:b], pa.array(np.diff(first), pa.int64()), pa.array(B.signed(one)), pa.array(B.signed(two)), pa.array(sha), B.lists(B.signed(g), bounds, pa.int64()), B.lists(lo - first[owner], bounds, pa.int32()), B.lists(hi - first[owner], bounds, pa.int32())],
                    names=["doc_id", "xh", "n_words", "f1", "f2", "sha", "h", "lo", "hi"],
                )

    return task


def _next_level(width: int, length: int):
    """Anchors of the windows that the level before left, given as ranges (column ``left``)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, left = batch.column("unit").to_numpy(zero_copy_only=False), batch.column("left")
            for a, b, data, offs in B.texts(batch, "text"):
                s, e, first = B.words(data, offs)
                h = B.hashes(data, s, e)
                edge = np.zeros(len(h) + 1, np.int64)
                for i in range(b - a):
                    ranges = left[a + i].values
                    np.add.at(edge, first[i] + ranges.field("lo").to_numpy(), 1)
                    np.add.at(edge, first[i] + ranges.field("hi").to_numpy() + 1, -1)
                where, g, lo, hi = anchors(h, first, width, length, np.cumsum(edge) > 0)
                second = B.windows(B.hashes(data, s, e, seed=2), first, length)[0][where] if length == width else np.zeros(len(where), U64)
                owner = np.searchsorted(first, where, "right") - 1
                yield pa.record_batch([pa.array(B.signed(g)), pa.array(B.signed(second)), pa.array(units[a + owner], pa.int64()), pa.array((lo - first[owner]).astype(np.int32)), pa.array((hi - first[owner]).astype(np.int32))], names=["h", "h2", "unit", "lo", "hi"])

    return task


def _cut(width: int):
    """Remove what the windows starting at ``starts`` cover."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("starts")
            for a, b, data, offs in B.texts(batch, "text"):
                s, e, first = B.words(data, offs)
                raw, gone, kept = data.tobytes(), [], []
                for i in range(b - a):
                    n = first[i + 1] - first[i]
                    edge = np.zeros(n + 1, np.int64)
                    at = starts[a + i].values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone.append(int(n - stay.sum()))
                    kept.append(joined(raw, s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], stay))
                yield pa.record_batch([batch.column("unit")[a:b], pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["unit", "n_removed", "kept"])

    return task


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a kept table whose keys occur in two rows or more. Hot keys, of which there are at most one for HOT
    rows, are looked up in a broadcast table if it fits; else Spark splits the join's partitions that they make large."""
    twice = keep(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    hot = keep(twice.filter(F.col("n") > HOT).select(*keys), "hot")
    if not fits(hot):
        return rows.join(twice.select(*keys), keys, "left_semi")
    often, cold = rows.join(F.broadcast(hot), keys, "left_semi"), rows.join(F.broadcast(hot), keys, "left_anti")
    return often.unionByName(cold.join(twice.filter(F.col("n") <= HOT).select(*keys), keys, "left_semi"))


def substrings(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(documents, texts): per document doc_id, n_words, n_removed, and the unit whose ``kept`` text (in texts, only
    where something was removed but not all) is its own; sha is the digest of all its words."""
    rows = keyed(docs)
    first, *longer = levels(width)
    level = rows.mapInArrow(_first_level(width, first), "doc_id long, xh long, n_words long, f1 long, f2 long, sha string, h array<long>, lo array<int>, hi array<int>")
    level = keep(level.withColumn("unit", F.monotonically_increasing_id()), "units")
    copies = level.groupBy("f1", "f2").agg(F.min("unit").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = keep(copies, "copies")
    marked = level.select("doc_id", "xh", "unit", "n_words", "sha", "f1", "f2").join(small(copies), ["f1", "f2"], "left")
    # one text of each unit is looked at; a unit of copies counts as repeated and loses all its windows anyway
    others = small(keep(marked.filter("rep is not null and unit <> rep").select("unit"), "others"))
    multiple = copies.select(F.col("rep").alias("unit"))
    units = level.join(others, "unit", "left_anti")
    flat = units.select("unit", F.explode(F.arrays_zip("h", "lo", "hi")).alias("a")).select(F.col("a.h").alias("h"), F.lit(0).cast("long").alias("h2"), "unit", F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi"))

    def of(some: DataFrame, column: str) -> DataFrame:
        """(unit, column, text) of the units of a table (unit, column)."""
        where = keep(some.join(level.select("unit", "doc_id", "xh"), "unit").select("unit", column, F.col("doc_id").alias("d"), F.col("xh").alias("x")), "candidates")
        wanted = F.broadcast(where.select(F.pmod("x", F.lit(CLASSES)).alias("k")).distinct())
        near = rows.join(wanted, F.pmod("xh", F.lit(CLASSES)) == F.col("k"), "left_semi")
        return near.join(where.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xh") == F.col("x"))).select("unit", column, "text")

    if not longer:  # windows this short are compared at once
        longer = [width]
    for length in longer:
        left = repeated(flat, ["h"]).groupBy("unit").agg(F.collect_list(F.struct("lo", "hi")).alias("left"))
        flat = keep(of(left, "left").mapInArrow(_next_level(width, length), "h long, h2 long, unit long, lo int, hi int"), f"level-{length}")
        if flat.isEmpty():
            break
    cover = repeated(flat, ["h", "h2"]).join(small(keep(multiple, "multiple")), "unit", "left_anti")
    texts = of(cover.groupBy("unit").agg(F.collect_set("lo").alias("starts")), "starts")
    return marked, texts.mapInArrow(_cut(width), "unit long, n_removed long, kept binary")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, texts = substrings(documents(spark, sf_dir))
    cut = texts.select("unit", "n_removed", F.sha2("kept", 256).alias("cut_sha"))
    all_gone = F.col("rep").isNotNull() & (F.col("n_words") >= WIDTH)
    return marked.join(cut, "unit", "left").select(
        "doc_id", "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(0, 35) t(j)),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
k AS (
  SELECT e.doc_id, count(c.i) AS n_removed, string_agg(x, ' ' ORDER BY e.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
