"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles. Equal sets are one unit. Index lists map a shingle to the units that
have it in their prefix (the first n - ceil(t * n) + 1 shingles in one order of all shingles), which linked units are
sure to share. What the lists hold is then skipped in three ways instead of being paired off:

* Order: shingles whose list is long (boilerplate, passages that many texts quote) are put last in the order and the
  prefixes concerned are drawn again, so lists stay short unless a text consists of such shingles.
* Answers: every entry is first compared with its list's leaders, exactly. Linked ones are answered by a leader: a
  list whose entries are all in one component is skipped whole. Of two others, the overlaps with any leader bound
  their own: |x & y| <= |x & l| + |y| - |y & l|, so a set's answers are derived from those of a similar set.
* Position: entries too far apart in length or in position (|x & y| <= min(i, j) + min(|x| - i, |y| - j) for a
  shingle at i in x and j in y) skip each other, and pairs that share too few prefix shingles are skipped: at most
  |x| - |prefix(x)| more can follow.

What is left is verified exactly from the texts. Links between different components are all found, links inside one
are not all listed: components are exact, and so is every overlap reported.

Cases: null or empty texts have an empty set, link with nothing and are their own component; with fewer than WORDS
words the whole sequence is the one shingle; rows that share a doc_id are separate nodes named by that id; equal rows
are linked; a null doc_id is larger than any other, and a component of nulls alone has a null id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytescan as B
from .components import components
from .shared import documents, keep, keyed, keyed_join, row_key, small, tagged, untagged

WORDS = 5
PERCENT = 75
#: Lists up to this length are left in the order as they are.
LONG = 64
#: At most so many shingles are put last (8 bytes each are broadcast); if more lists are long, the longest are.
MOST_LONG = 200_000
ROUNDS = 2
#: Leaders of a long list (of each block of lengths): its entries with the most shingles that are put last, which are
#: nearest to what a group of near copies has in common.
LEADERS = 8
#: Members of a block where what long lists leave open is compared block by block.
BLOCK = 128
BITS = 1 << 26

U64 = np.uint64


def sets(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct 63-bit shingle hashes of each text, and each text's word count."""
    s, e, first = B.words(data, offs)
    h = B.hashes(data, s, e, True)
    g, _ = B.windows(h, first, words)
    n = np.diff(first)
    g = g >> U64(1)
    short = B.sequences(h, first)[0] >> U64(1) if (n < words).any() else None
    out = []
    for i in range(len(n)):
        if n[i] >= words:
            x = np.sort(g[first[i] : first[i + 1] - words + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(short[i : i + 1] if n[i] else np.zeros(0, U64))
    return out, n


def need(a, b, percent: int = PERCENT):
    """The least overlap with which sets of these sizes link: 100 * o >= percent * (a + b - o)."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_size(n, percent: int = PERCENT):
    return n - (-((-percent * n) // 100)) + 1


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which members of x are in the sorted table."""
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), bool)


def _prefix(x: np.ndarray, late: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a sorted set when the shingles in ``late`` come last, by rank."""
    p = int(prefix_size(len(x), percent)) if len(x) else 0
    if not len(late):
        return x[:p]
    hit = _in(x, late)
    front = x[~hit][:p]
    if len(front) == p:
        return front
    back = x[hit]
    return np.concatenate([front, back[np.argsort(rank[np.searchsorted(late, back)], kind="stable")][: p - len(front)]])


_NONE = (np.zeros(0, U64), np.zeros(0, np.int64))


def _index(percent: int, words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in B.texts(batch, "text"):
                xs, _ = sets(data, offs, words)
                with np.errstate(over="ignore"):
                    f1 = np.array([B.mix(x).sum() if len(x) else 0 for x in xs], U64)
                    f2 = np.array([B.mix(x ^ U64(0x5851F42D4C957F2D)).sum() if len(x) else 0 for x in xs], U64)
                cut = [_prefix(x, *_NONE, percent) for x in xs]
                bounds = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
                yield pa.record_batch(
                    [batch.column("doc_id")[a:b], batch.column("xh")[a:b], pa.array([len(x) for x in xs], pa.int32()), pa.array(B.signed(f1)), pa.array(B.signed(f2)), B.lists(B.signed(np.concatenate([*cut, np.zeros(0, U64)])), bounds, pa.int64())],
                    names=["doc_id", "xh", "n", "f1", "f2", "prefix"],
                )

    return task


def _names(words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _index(PERCENT, words)(batches):
            yield batch.select(["doc_id", "xh", "n", "f1", "f2"])

    return task


def _redrawn(before, now, percent: int, words: int, late_only: bool):
    """New prefix entries of a unit when more shingles are put last; with ``late_only``, those put last that its final
    prefix reaches all the same."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = before.value, now.value
        for batch in batches:
            units = batch.column("u")
            for a, b, data, offs in B.texts(batch, "text"):
                us, hs, ns, ks = [], [], [], []
                for i, x in enumerate(sets(data, offs, words)[0]):
                    p = _prefix(x, *new, percent)
                    late = _in(p, new[0])
                    fresh = p[late] if late_only else p[~late & ~_in(p, np.sort(_prefix(x, *old, percent)))]
                    us.append(np.full(len(fresh), units[a + i].as_py()))
                    hs.append(fresh)
                    ns.append(np.full(len(fresh), len(x)))
                us, hs, ns = (np.concatenate(v) if v else np.zeros(0) for v in (us, hs, ns))
                yield pa.record_batch([pa.array(hs.astype(np.int64)), pa.array(us.astype(np.int64)), pa.array(ns.astype(np.int32)), pa.array(np.zeros(len(hs), np.int32)), pa.array(np.full(len(hs), 1 << 28, np.int32))], names=["h", "u", "n", "pos", "slack"])

    return task


def _entries_of(bits):
    """Index entries of the shingles that ``bits`` may hold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            col = batch.column("prefix")
            h, bounds = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            lo, hi = int(bounds[0]), int(bounds[-1])
            at = (h[lo:hi] & (BITS - 1)).astype(np.int64)
            hit = np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1) + lo
            row = np.searchsorted(bounds, hit, "right") - 1
            yield pa.record_batch([pa.array(h[hit]), batch.column("u").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array((hit - bounds[row]).astype(np.int32)), pa.array(np.zeros(len(hit), np.int32))], names=["h", "u", "n", "pos", "slack"])

    return task


def _bit_set(h: DataFrame) -> bytes:
    """A filter of BITS bits of the shingles in column h; gathered by segments of 2 ** 16."""
    at = F.col("h").bitwiseAND(F.lit(BITS - 1))
    parts = h.select(F.shiftright(at, 16).alias("s"), at.bitwiseAND(F.lit(65535)).cast("int").alias("b")).distinct().groupBy("s").agg(F.collect_list("b").alias("bs"))
    out = np.zeros(BITS, np.uint8)
    for r in parts.toLocalIterator():
        out[(r.s << 16) + np.array(r.bs)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _overlap(words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for s in range(0, len(batch), 128):
                part = batch.slice(s, 128)
                heads = part.column("a").to_pylist()
                got = [x for _, _, data, offs in B.texts(part, "text_b") for x in sets(data, offs, words)[0]]
                texts = part.column("text_a")
                out = []
                for i, x in enumerate(got):
                    if heads[i] != last:
                        one = pa.record_batch([texts.slice(i, 1)], names=["t"])
                        held = next(sets(d, o, words)[0][0] for _, _, d, o in B.texts(one, "t"))
                        last = heads[i]
                    small_, large = (x, held) if len(x) < len(held) else (held, x)
                    at = np.searchsorted(large, small_)
                    out.append(int((large[np.minimum(at, len(large) - 1)] == small_).sum()) if len(large) else 0)
                yield pa.record_batch([part.column("a"), part.column("b"), pa.array(out, pa.int32())], names=["a", "b", "o"])

    return task


def _sets(words: int):
    """(u, shingles): the sorted distinct shingles of each unit's text, computed once for all its comparisons."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in B.texts(batch, "text"):
                xs = sets(data, offs, words)[0]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
                yield pa.record_batch([batch.column("u")[a:b], B.lists(B.signed(np.concatenate([*xs, np.zeros(0, U64)])), bounds, pa.int64())], names=["u", "shingles"])

    return task


def _blocks(percent: int):
    """Rows (probe chunk, block): links between their members of different components, one for each member of the
    block and component of the chunk; overlaps come from one sorted index of the block, kept while its rows follow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, ()

        def members(row: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            v = row.values
            lists = v.field("shingles")
            return v.field("u").to_numpy(), v.field("comp").to_numpy(), [lists[i].values.to_numpy() for i in range(len(v))]

        for batch in batches:
            src, dst = [], []
            for g, size, b, probe, block in zip(*(batch.column(c) for c in ("g", "size", "b", "probe", "block"))):
                key = (g.as_py(), size.as_py(), b.as_py())
                if key != last:
                    us, comps, xs = members(block)
                    sizes = np.array([len(x) for x in xs])
                    flat = np.concatenate(xs)
                    order = np.argsort(flat, kind="stable")
                    last, index = key, (us, comps, sizes, flat[order], np.repeat(np.arange(len(xs)), sizes)[order])
                us, comps, sizes, flat, owner = index
                done: set[tuple[int, int]] = set()
                for v, comp, y in zip(*members(probe)):
                    if not (comps != comp).any():
                        continue
                    lo, hi = np.searchsorted(flat, y, "left"), np.searchsorted(flat, y, "right")
                    k = hi - lo
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
                    shared = np.bincount(owner[at], minlength=len(sizes))
                    for i in np.flatnonzero((shared >= need(sizes, len(y), percent)) & (comps != comp)).tolist():
                        if (i, comp) not in done:
                            done.add((i, comp))
                            src.append(int(us[i]))
                            dst.append(int(v))
            yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return task


class Join:
    """One self-join of a document table."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, words: int = WORDS, long: int = LONG):
        self.docs, self.percent, self.words, self.long = keyed(docs), percent, words, long
        self.spark = docs.sparkSession

    def _cast(self, value):
        return self.spark.sparkContext.broadcast(value)

    def texts_of(self, units: DataFrame) -> DataFrame:
        """(u, text) of a kept table (u, d, x)."""
        t = self.docs.join(small(units), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xh") == F.col("x")))
        return t.select("u", "text")

    def overlaps(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b) -> (a, b, o, na, nb): exact overlaps, from the texts; the texts of ``b`` move to their ``a``."""
        used = pairs.select(F.col("a").alias("u")).unionByName(pairs.select(F.col("b").alias("u"))).distinct()
        where = keep(self.units.select("u", "d", "x").join(used, "u"), "units")
        texts = keep(self.texts_of(where).dropDuplicates(["u"]), "texts")
        both = pairs.join(texts.select(F.col("u").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("u").alias("a"), F.col("text").alias("text_a")), "a")
        return keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_overlap(self.words), "a long, b long, o int"), name)

    def build(self) -> None:
        schema = "doc_id long, xh long, n int, f1 long, f2 long"
        raw = self.docs.mapInArrow(_index(self.percent, self.words), schema + ", prefix array<long>").filter("n > 0")
        units = raw.groupBy("f1", "f2").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "xh")).alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.max(F.col("doc_id").isNull()).alias("nulls"))
        units = units.select(F.monotonically_increasing_id().alias("u"), "f1", "f2", "n", "prefix", F.when((F.col("rep.doc_id") < (1 << 63) - 1) | ~F.col("nulls"), F.col("rep.doc_id")).alias("d"), F.col("rep.xh").alias("x"))
        self.units = keep(units, "units")
        entries = self.units.select("u", "n", F.posexplode("prefix").alias("pos", "h")).withColumn("slack", F.lit(0))
        counts = entries.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        lists = keep(entries.join(counts, "h").select("h", "u", "n", "pos", "slack", "c"), "lists")
        late, counts, self.fresh = _NONE, {}, []
        for _ in range(ROUNDS):
            bound = self.long
            while (hot := lists.filter(F.col("c") > bound).groupBy("h").agg(F.max("c").alias("c"))).count() + len(late[0]) > MOST_LONG:
                bound *= 4
            hot = {r.h: r.c for r in hot.toLocalIterator()}
            if not set(hot) - set(counts):
                break
            counts = hot | counts
            # the rarest of them first, so that a prefix that does reach them meets short lists
            h = np.array(sorted(counts), np.int64)
            c = np.array([counts[x] for x in h.tolist()])
            lists, late = self._put_last(lists, late, (h.view(U64), np.argsort(np.lexsort((h, c)))))
        self.central = None
        if len(late[0]):
            touched = self._touched(lists)
            self.central = keep(lists.filter("late").groupBy("u").agg(F.count(F.lit(1)).cast("int").alias("k")), "central")
            tail = self.texts_of(touched).mapInArrow(_redrawn(self._cast(late), self._cast(late), self.percent, self.words, True), "h long, u long, n int, pos int, slack int")
            tail = keep(tail, "tail")
            lists = lists.filter("not late").drop("late", "c").unionByName(tail)
            lists = keep(lists.join(lists.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "h"), "lists")
        else:
            lists = lists.drop("late")
        self.lists = lists.select("h", "u", "n", "pos", "slack", "c")

    def _touched(self, lists: DataFrame) -> DataFrame:
        return keep(lists.filter("late").select("u").distinct().join(self.units.select("u", "d", "x"), "u"), "touched")

    def _put_last(self, lists: DataFrame, old: tuple, new: tuple) -> tuple[DataFrame, tuple]:
        """Draw the prefixes that hold newly late shingles again; entries of late shingles stay, marked, until the end."""
        late = small(keep(self.spark.createDataFrame(pa.table({"h": new[0].astype(np.int64)})), "late"))
        marked = lists.drop("late").join(late.withColumn("late", F.lit(True)), "h", "left").withColumn("late", F.coalesce("late", F.lit(False)))
        marked = keep(marked, "marked")
        touched = self._touched(marked)
        fresh = keep(self.texts_of(touched).mapInArrow(_redrawn(self._cast(old), self._cast(new), self.percent, self.words, False), "h long, u long, n int, pos int, slack int"), "fresh")
        bits = self._cast(_bit_set(fresh.select("h")))
        met = self.units.select("u", "n", "prefix").mapInArrow(_entries_of(bits), "h long, u long, n int, pos int, slack int")
        # an entry may come from the lists, from the filter and from a draw: one of each stays
        rows = marked.filter("not late").select("h", "u", "n", "pos", "slack").unionByName(met.join(late, "h", "left_anti"))
        for drawn in (*self.fresh, fresh):
            rows = rows.unionByName(drawn.join(late, "h", "left_anti"))
        self.fresh.append(fresh)
        rows = rows.groupBy("h", "u").agg(F.first("n").alias("n"), F.min("pos").alias("pos"), F.max("slack").alias("slack"))
        # entries of a touched unit have moved forward by as many places as it has late shingles
        moved = marked.filter("late").groupBy("u").agg(F.count(F.lit(1)).cast("int").alias("k"))
        rows = rows.join(moved, "u", "left").withColumn("slack", F.least(F.lit(1 << 28), F.col("slack") + F.coalesce("k", F.lit(0)))).drop("k")
        rows = keep(rows, "rows")
        rows = rows.join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "h").withColumn("late", F.lit(False))
        both = rows.select("h", "u", "n", "pos", "slack", "c", "late").unionByName(marked.filter("late").select("h", "u", "n", "pos", "slack", "c", "late"))
        return keep(both, "lists"), new

    def _need(self, a: str, b: str):
        return F.expr(f"cast(ceil({self.percent} * cast({a} + {b} as double) / {100 + self.percent} - 1e-9) as int)")

    def _fits(self, a: str, b: str):
        return F.expr(f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})")

    def _dense(self, members: DataFrame) -> DataFrame | None:
        """Links inside the groups that long lists leave open: (g, u, comp) -> (src, dst), or None.

        Who is not in a group's largest component is compared with the members of like size, BLOCK by BLOCK: what is
        joined is blocks of shingle arrays, never pairs of their members."""
        members = keep(members, "members")
        if members.isEmpty():
            return None
        size = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / self.percent)).cast("int")
        units = keep(self.units.select("u", "d", "x", size.alias("size")).join(members.select("u").distinct(), "u"), "units")
        shingles = keep(self.texts_of(units.select("u", "d", "x")).dropDuplicates(["u"]).mapInArrow(_sets(self.words), "u long, shingles array<long>"), "shingles")
        main = members.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
        rows = members.join(units.select("u", "size"), "u").join(main, "g")
        per = rows.groupBy("g", "size").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("comp") != F.col("main")).alias("rest"))
        rows = rows.join(per, ["g", "size"]).join(shingles, "u").withColumn("r", F.xxhash64("u"))
        chunk = lambda n: F.pmod("r", F.ceil(n / F.lit(float(BLOCK))))
        both = lambda name: F.collect_list(F.struct("u", "comp", "shingles")).alias(name)
        probes = keep(rows.groupBy("g", "size", chunk(F.col("k")).alias("pb")).agg(both("probe")), "probes")
        blocks = keep(rows.filter(F.col("comp") != F.col("main")).groupBy("g", "size", chunk(F.col("rest")).alias("b")).agg(both("block")), "blocks")
        # sets that link are of one or of neighbouring sizes
        near = blocks.select("g", "b", "block", F.col("size").alias("own"), F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
        pairs = probes.join(near, ["g", "size"]).select("g", F.col("own").alias("size"), "b", "probe", "block")
        spread = pairs.repartition(self.spark.sparkContext.defaultParallelism * 4, "g", "size", "b", F.pmod(F.xxhash64("probe.u"), F.lit(8))).sortWithinPartitions("g", "size", "b")
        return keep(spread.mapInArrow(_blocks(self.percent), "src long, dst long").distinct(), "dense")

    def link(self) -> DataFrame:
        """(node, root) of the units that link."""
        lists = self.lists.withColumn("size_block", F.floor(F.log(F.col("n").cast("double")) / np.log(100 / self.percent)).cast("int"))
        # answers of the leaders of each block of lengths: of long lists several, of others the first unit
        ranked = lists.withColumn("k", F.lit(0)) if self.central is None else lists.join(small(self.central), "u", "left").withColumn("k", F.coalesce("k", F.lit(0)))
        place = F.row_number().over(W.partitionBy("h", "size_block").orderBy(F.desc("k"), "u"))
        lead = ranked.withColumn("place", place).filter(F.col("place") <= LEADERS).filter((F.col("place") == 1) | (F.col("c") > self.long))
        lead = lead.select("h", "size_block", F.col("u").alias("a"), F.col("n").alias("na"))
        asks = lists.join(lead, ["h", "size_block"])
        below = lists.join(lead.withColumn("size_block", F.col("size_block") + 1), ["h", "size_block"])
        asked = keep(asks.unionByName(below).filter(F.col("u") != F.col("a")).filter(self._fits("n", "na")).groupBy("a", F.col("u").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.max("c").alias("c"), F.first("n").alias("nb"), F.first("na").alias("na")), "asked")
        worth = keep(asked.filter((F.col("c") > self.long) | (F.col("k") >= F.greatest(F.lit(1), F.floor(F.least("na", "nb") * 0.1)))).select("a", "b", "na", "nb"), "worth")
        answers = keep(self.overlaps(worth.select("a", "b"), "overlaps").join(worth, ["a", "b"]), "answers")
        links = answers.filter(F.col("o") >= self._need("na", "nb")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        roots = components(links)
        # what the answers leave open
        named = lists.join(roots, lists["u"] == roots["node"], "left").withColumn("comp", F.coalesce("root", "u")).drop("node", "root")
        open_ = named.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h")
        told = answers.select(F.col("b").alias("u"), F.col("a").alias("l"), "o").unionByName(answers.select(F.col("a").alias("u"), F.col("a").alias("l"), F.col("na").alias("o")).distinct())
        told = told.groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct("l", "o"))).alias("told"))
        dense = self._dense(named.filter(F.col("c") > self.long).join(open_, "h").join(ranked.groupBy("h").agg(F.max_by("u", F.struct("k", -F.col("u"))).alias("g")), "h").select("g", "u", "comp").distinct())
        named = keep(named.filter(F.col("c") <= self.long).join(open_, "h").join(told, "u", "left").select("h", "u", "n", "pos", "slack", "comp", "told"), "open")
        x, y = named.alias("x"), named.alias("y")
        least = self._need("x.n", "y.n")
        bounds = F.map_values(F.map_zip_with("x.told", "y.told", lambda _, a, b: F.least(a + F.col("y.n") - b, b + F.col("x.n") - a)))
        by_leader = ~F.coalesce(F.exists(bounds, lambda v: v < least), F.lit(False))
        apart = F.least("x.pos", "y.pos") + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) + F.col("x.slack") + F.col("y.slack")
        pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.u") < F.col("y.u")) & (F.col("x.comp") != F.col("y.comp")) & self._fits("x.n", "y.n") & (apart >= least) & by_leader)
        pairs = pairs.groupBy(F.col("x.u").alias("a"), F.col("y.u").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"))
        rest = F.greatest(*(F.expr(f"{c} - ({c} - ceil({self.percent} * {c} / 100.0) + 1)") for c in ("na", "nb")))
        pairs = pairs.filter(F.col("k") + rest >= self._need("na", "nb"))
        pairs = keep(pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti").join(answers.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti").select("a", "b", "na", "nb"), "pairs")
        self.verified = pairs
        more = self.overlaps(pairs.select("a", "b"), "overlaps").join(pairs, ["a", "b"]).filter(F.col("o") >= self._need("na", "nb"))
        more = more.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        more = more if dense is None else more.unionByName(dense)
        if more.isEmpty():
            return roots
        return components(links.unionByName(more))

    def classes(self) -> DataFrame:
        """Per document: doc_id, xh, n_shingles, component_id (and the unit and its root, for callers that pick one)."""
        self.build()
        roots = self.link()
        named = self.units.select("u", "f1", "f2", "d").join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
        least = named.groupBy("root").agg(F.min("d").alias("component_id"))
        named = keep(named.join(least, "root").select("f1", "f2", "root", "component_id"), "classes")
        rows = self.docs.mapInArrow(_names(self.words), "doc_id long, xh long, n int, f1 long, f2 long")
        out = rows.join(named, ["f1", "f2"], "left")
        return out.select("doc_id", "xh", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest doc_id stays (of several rows
    with that id, the one with the least text key; of several with one text, the one with the least key of all columns). Documents without words all stay."""
    names = keep(Join(docs).classes(), "names")
    best = names.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "xh")).alias("b"))
    gone = names.join(best, "root").filter((F.coalesce("doc_id", F.lit((1 << 63) - 1)) != F.col("b.d")) | (F.col("xh") != F.col("b.xh"))).select("doc_id", "xh").distinct()
    left = keyed_join(tagged(docs), keep(gone, "gone"), "left_anti")
    equal = names.filter("root is not null").groupBy("doc_id", "xh").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id", "xh")
    equal = keep(equal, "equal")
    if not equal.isEmpty():
        one = keyed_join(left, equal, "left_semi").groupBy("k", "xh").agg(F.min_by("row", row_key(docs, F.col("row"))).alias("row"))
        left = keyed_join(left, equal, "left_anti").unionByName(one)
    return untagged(left, docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Join(documents(spark, sf_dir)).classes().select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""
