"""Segments, cross-modal moments, temporal pairs and tail merging: joins within a source, never across."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as T


def segment_id(duration: Column, seconds: float = terms.SEGMENT_SECONDS) -> Column:
    """A candidate's own segment unless it is an audio window's, else the fixed bucket of its time."""
    last = F.greatest(F.ceil(duration / seconds) - 1, F.lit(0))
    bucket = F.concat(F.lit("long-segment-"), F.lpad(F.least(F.floor(F.col("t") / seconds), last).cast("string"), 4, "0"))
    own = F.col("segment_id").isNotNull() & ~F.startswith("segment_id", F.lit("audio-window-"))
    return F.when(own, F.col("segment_id")).otherwise(bucket)


def segment_groups(df: DataFrame, group: list[str], seconds: float = terms.SEGMENT_SECONDS) -> DataFrame:
    """(group, seg, relevance, t, modality) -> seg, start, stop, score, audio count."""
    start = F.regexp_extract("seg", r"(\d+)$", 1).cast("double") * seconds
    g = df.groupBy(*group, "seg").agg(F.max("relevance").alias("score"), F.count_if(F.col("modality") == "audio").alias("n_audio"), F.max("duration").alias("duration"))
    return g.withColumn("start", start).withColumn("stop", F.greatest(F.least(start + seconds, F.col("duration")), start + 1.0))


def shortlist(groups: DataFrame, group: list[str], most: int = terms.MAX_SEGMENTS) -> DataFrame:
    """The best segments by (score, earlier start)."""
    w = W.partitionBy(*group).orderBy(F.desc("score"), "start", "seg")
    return groups.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def nearest_visual(df: DataFrame, group: list[str], radius: float) -> DataFrame:
    """Each audio row with the visual within ``radius`` that is nearest, then most salient (vid, vt; null if none)."""
    from .scoring import nearest

    visuals = df.filter("modality = 'visual'").select(*group, F.col("id").alias("rid"), F.col("t").alias("rt"), F.coalesce("saliency", F.lit(0.0)).alias("rs"))
    order = [F.abs(F.col("t") - F.col("rt")).asc_nulls_last(), F.desc("rs"), F.col("rt"), F.col("rid")]
    return nearest(df.filter("modality = 'audio'"), visuals, group, radius, order).withColumnRenamed("rid", "vid").withColumnRenamed("rt", "vt").drop("rs")


def fuse(df: DataFrame, group: list[str], radius: float = terms.VISUAL_RADIUS, least: float = terms.MIN_AUDIO_RELEVANCE, most: int = terms.MAX_AUDIO_MOMENTS) -> DataFrame:
    """Relevant audio with its nearest visual attached (at most ``most`` a group) and the relevant visuals left over."""
    audio = nearest_visual(df, group, radius).filter(F.col("relevance") >= least)
    if {"query", "text"} <= set(df.columns):  # a why question looks for reasons
        why = F.when(F.startswith(F.lower(F.btrim("query")), F.lit("why")), 0.2 * T.count_contained("text", terms.WHY_ANSWER_TERMS)).otherwise(0.0)
        audio = audio.withColumn("relevance", F.round(F.col("relevance") + why, 9))
    fused = audio.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("relevance"), "t", "id"))).filter(F.col("place") <= most)
    fused = fused.select(*group, F.when(F.col("vid").isNotNull(), F.concat_ws("+", "id", "vid")).otherwise(F.col("id")).alias("id"), "t", F.lit("audio").alias("modality"), "relevance")
    used = audio.filter("vid is not null").select(*group, F.col("vid").alias("id")).distinct()
    orphans = df.filter((F.col("modality") == "visual") & (F.col("relevance") >= least)).join(used, [*group, "id"], "left_anti").select(*group, "id", "t", "modality", "relevance")
    return fused.unionByName(orphans)


TARGET_WORDS = "name slide text title word words".split()
OPENING_WORDS = "beginning first initial opening start".split()


def target_text_bonus(target_query: Column, text: Column) -> Column:
    asked = F.arrays_overlap(T.ascii_words(target_query), T.words_in(TARGET_WORDS))
    tail = F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1)
    long_ = F.filter(F.regexp_extract_all(tail, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: F.length(w) >= 3)
    upper = F.exists(long_, lambda w: (F.length(w) >= 4) & w.rlike("[A-Z]") & ~w.rlike("[a-z]"))
    return F.when(asked & F.contains(text, F.lit(":")) & (F.size(long_) > 0), F.when(F.size(long_) <= 8, 0.2).otherwise(0.05) + F.when(upper, 0.15).otherwise(0.0)).otherwise(0.0)


def target_noise_penalty(target_query: Column, text: Column) -> Column:
    asked = F.arrays_overlap(T.ascii_words(target_query), T.words_in(TARGET_WORDS))
    tail = F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1)
    ws = F.regexp_extract_all(tail, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    informative = F.size(F.filter(ws, lambda w: F.length(w) >= 3))
    short = F.try_divide(F.size(F.filter(ws, lambda w: F.length(w) <= 2)), F.size(ws))
    marks = F.length(F.regexp_replace(tail, r"[A-Za-z0-9\s]", "")) / F.greatest(F.length(tail), F.lit(1))
    parts = F.when(short > 0.45, 0.4).otherwise(0.0) + F.when(marks > 0.2, 0.25).otherwise(0.0) + F.when(informative == 1, 0.2).otherwise(0.0)
    return F.when(~asked | ~F.contains(text, F.lit(":")), 0.0).when(F.size(ws) == 0, 0.5).when(informative == 0, 0.75).otherwise(parts)


def content_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(T.ascii_words(text), lambda w: (F.length(w) > 2) & ~w.isin("near", "screen", "seconds", "text")))


def repeated_anchor_penalty(a: Column, b: Column) -> Column:
    """Of two content-term arrays."""
    share = F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))
    return F.when((F.size(a) >= 3) & (F.size(b) >= 3) & (share >= 0.55), 0.85).otherwise(0.0)


def running_best(df: DataFrame, group: list[str], a: str, b: str, reach: float) -> DataFrame:
    """(group, id, t, a, b) -> each row as an anchor with (target, target_t, target_b, gap): of the rows after it within
    ``reach`` the one whose b, less what its distance costs (a quarter over the whole reach), is largest; none: no row.

    The cost of a distance is the difference of two times, so targets can be compared without their anchors: the best
    of a range of times is a running maximum. Times are cut into buckets of ``reach``; an anchor's range is the rest of
    its bucket and the beginning of the next one, a suffix and a prefix. So each row takes part in two sorted passes,
    and no pair is formed, however many rows lie within reach."""
    rows = df.select(*group, "id", "t", a, b, F.floor(F.col("t") / reach).alias("__b"))
    value = F.struct((-F.round(F.col(b) - 0.25 * F.col("t") / reach, 9)).alias("v"), F.col("t"), F.col("id"), F.col(b).alias("b"))
    w = W.partitionBy(*group, "__b")
    # later rows of the own bucket: ranks, since rows of one time are not after each other
    own = rows.withColumn("__v", value).withColumn("__k", F.dense_rank().over(w.orderBy(F.desc("t"))))
    own = own.withColumn("__rest", F.min("__v").over(w.orderBy("__k").rangeBetween(W.unboundedPreceding, -1)))
    # the next bucket's rows up to the end of reach: anchors stand among them at that end
    ends = own.select(*group, (F.col("__b") + 1).alias("__b"), (F.col("t") + reach).alias("__t"), F.lit(None).cast(own.schema["__v"].dataType).alias("__v"), F.struct("id", "t", a, "__rest").alias("__a"))
    both = own.select(*group, "__b", F.col("t").alias("__t"), "__v", F.lit(None).cast(ends.schema["__a"].dataType).alias("__a")).unionByName(ends)
    upto = w.orderBy("__t").rangeBetween(W.unboundedPreceding, W.currentRow)
    best = both.withColumn("__next", F.min("__v").over(upto)).filter(F.col("__a").isNotNull()).withColumn("__best", F.least("__next", "__a.__rest")).filter(F.col("__best").isNotNull())
    return best.select(*group, F.col("__a.id").alias("id"), F.col("__a.t").alias("t"), F.col(f"__a.{a}").alias(a), F.col("__best.id").alias("target"), F.col("__best.t").alias("target_t"), F.col("__best.b").alias("target_b"), (F.col("__best.t") - F.col("__a.t")).alias("gap"))


def best_directed_pair(df: DataFrame, group: list[str], a: str, b: str, reach: float) -> DataFrame:
    """(group, anchor, target): the pair, target after anchor within ``reach``, with the largest a + b + nearness; ties to
    the smaller gap, the earlier anchor, the smaller ids."""
    best = running_best(df, group, a, b, reach)
    score = F.round(F.col(a) + F.col("target_b") + 0.25 * (1 - F.col("gap") / reach), 9)
    picked = F.min(F.struct((-score).alias("s"), F.col("gap"), F.col("t"), F.col("id"), F.col("target")))
    return best.groupBy(*group).agg(picked.alias("p")).select(*group, F.col("p.id").alias("anchor"), F.col("p.target").alias("target"))


def temporal_pairs(df: DataFrame, group: list[str], direction: str, target_query: str, anchor_query: str = "", reach: float = 300.0) -> DataFrame:
    """(group, id, t, segment_id, anchor_score, target_score, text) -> anchor, target, score.

    For each anchor the targets on its side within ``reach``: if some lie in other segments, the best of each of the
    eight nearest such segments, else the single nearest (see ``targets_by_sweep``). ids are unique in a group."""
    rows = df.filter(F.col("anchor_score").isNotNull() & F.col("target_score").isNotNull()).withColumn("content", content_terms(F.col("text")))
    tq = F.lit(target_query)
    rows = rows.withColumn("bonus", target_text_bonus(tq, F.col("text"))).withColumn("noise", target_noise_penalty(tq, F.col("text")))
    whole = W.partitionBy(*group)
    lo, hi = F.min("t").over(whole), F.max("t").over(whole)
    opening = F.greatest(F.lit(60.0), F.least(F.lit(120.0), F.greatest(hi - lo, F.lit(1.0)) * 0.02))
    asked = F.arrays_overlap(T.ascii_words(F.lit(anchor_query)), T.words_in(OPENING_WORDS))
    rows = rows.withColumn("position", F.when(asked, 1.1 * F.greatest(1.0 - F.greatest(F.col("t") - lo, F.lit(0.0)) / opening, F.lit(0.0))).otherwise(0.0))
    found = targets_by_sweep(rows, group, direction, reach)
    a, b = rows.select(*group, F.col("id").alias("anchor"), F.col("t").alias("at"), F.col("anchor_score").alias("sa"), "position", F.col("content").alias("ca")), rows.select(*group, F.col("id").alias("target"), F.col("t").alias("bt"), F.col("target_score").alias("sb"), "bonus", "noise", F.col("content").alias("cb"))
    p = found.join(a, [*group, "anchor"]).join(b, [*group, "target"]).withColumn("gap", F.abs(F.col("at") - F.col("bt")))
    score = F.col("sa") + F.col("sb") + 0.25 * F.greatest(1.0 - F.col("gap") / reach, F.lit(0.0)) + F.when(F.col("moved"), 0.1).otherwise(0.0) + F.col("position") + F.col("bonus") - F.col("noise") - repeated_anchor_penalty(F.col("ca"), F.col("cb"))
    return p.select(*group, "anchor", "target", score.alias("score"), "gap", "at")


NEAREST_SEGMENTS = 8


class _Walk:
    """One stretch of time of one group, walked against the direction: what has been passed is what an anchor may reach."""

    def __init__(self, after: bool, reach: float):
        self.sign, self.reach = 1.0 if after else -1.0, reach
        self.segments: dict = {}  # a segment's last row passed, the latest at the end
        self.best: dict = defaultdict(deque)  # a segment's rows that may still be its best, the best first
        self.last = None

    def inside(self, t: float, passed: float) -> bool:
        return passed <= t + self.reach if self.sign > 0 else passed >= t - self.reach

    def targets(self, t: float, segment) -> list[tuple[str, bool]]:
        near = []
        for seg in reversed(self.segments):
            if len(near) == NEAREST_SEGMENTS or not self.inside(t, self.segments[seg]):
                break
            if segment is not None and seg is not None and seg != segment:
                near.append(seg)
        for seg in near:
            while not self.inside(t, self.best[seg][0][2]):
                self.best[seg].popleft()
        if near or self.last is None or not self.inside(t, self.last[0]):
            return [(self.best[seg][0][3], True) for seg in near]
        return [(self.last[1], False)]

    def passes(self, t: float, id, segment, bonus: float, score: float) -> None:
        # a larger bonus, then score, then the earlier time, then the smaller id
        row, mine = (-bonus, -score, t, id), self.best[segment]
        while mine and mine[-1] > row:
            mine.pop()
        mine.append(row)
        self.segments.pop(segment, None)
        self.segments[segment] = t
        self.last = t, id


def _sweep(group: list[str], after: bool, reach: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by stretch, then along the walk; those of one time are passed after all of them have asked."""
        stretch, walk, waiting = None, None, []
        for batch in batches:
            out: list[tuple] = []
            keys = list(zip(*(batch.column(g).to_pylist() for g in (*group, "b"))))
            for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in ("t", "id", "segment_id", "bonus", "target_score", "own")))):
                if key != stretch:
                    stretch, walk, waiting = key, _Walk(after, reach), []
                if waiting and waiting[0][0] != row[0]:
                    for w in waiting:
                        walk.passes(*w)
                    waiting = []
                if row[5]:
                    out += [(*key[:-1], row[1], *x) for x in walk.targets(row[0], row[2])]
                waiting.append(row[:5])
            columns = list(zip(*out)) or [()] * (len(group) + 3)
            types = [*(batch.schema.field(g).type for g in (*group, "id", "id")), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=[*group, "anchor", "target", "moved"])

    return task


def targets_by_sweep(rows: DataFrame, group: list[str], direction: str, reach: float) -> DataFrame:
    """(group, id, t, segment_id, bonus, target_score) -> anchor, target, moved.

    Times are cut into buckets of ``reach``; a bucket is walked with the one that its anchors look into, so a group of any
    length is many tasks. The walk keeps the segments by when they were last passed and, for each, a queue of the rows that
    can still be its best (a row that is worse than a nearer one never is), so its work is near linear in the rows, where
    pairing all rows within reach is not."""
    after = direction == "after"
    own = F.floor(F.col("t") / reach)
    cut = rows.select(*group, "id", "t", F.col("segment_id").cast("string").alias("segment_id"), F.col("bonus").cast("double").alias("bonus"), F.col("target_score").cast("double").alias("target_score"), F.explode(F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + (-1 if after else 1)).alias("b"), F.lit(False).alias("own")))).alias("x"))
    cut = cut.select("*", "x.b", "x.own").drop("x")
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{g}` {types[g]}" for g in group), f"anchor {types['id']}", f"target {types['id']}", "moved boolean"])
    along = F.desc("t") if after else F.col("t")
    return cut.repartition(*group, "b").sortWithinPartitions(*group, "b", along, F.desc("id")).mapInArrow(_sweep(group, after, reach), schema)


def merge_edges(df: DataFrame, group: list[str], sigma: float, ratio: float = terms.MERGE_RATIO) -> DataFrame:
    """(group, id, modality, t, toks) -> source, target, similarity: rows alternate in time between two sides, every
    row of the first takes its most similar one of the second, and the strongest edges stay."""
    w = W.partitionBy(*group, "modality")
    rows = df.withColumn("i", F.row_number().over(w.orderBy("t", "id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    a, b = rows.filter("i % 2 = 0").alias("a"), rows.filter("i % 2 = 1").alias("b")
    reach = sigma * (-__import__("math").log(terms.MERGE_MIN_TEMPORAL)) ** 0.5 * (1 + 1e-9)
    on = (F.col("a.modality") == F.col("b.modality")) & (F.abs(F.col("a.t") - F.col("b.t")) <= reach)
    for g in group:
        on = on & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    kernel = T.time_kernel(F.col("a.t"), F.col("b.t"), sigma)
    similarity = F.when(kernel >= terms.MERGE_MIN_TEMPORAL, (1 - terms.MERGE_TEXT_WEIGHT) * kernel + terms.MERGE_TEXT_WEIGHT * T.jaccard(F.col("a.toks"), F.col("b.toks"))).otherwise(0.0)
    e = a.join(b, on).select(*[F.col(f"a.{g}") for g in group], F.col("a.modality"), F.col("a.id").alias("source"), F.col("b.id").alias("target"), F.col("a.n").alias("n"), F.col("b.i").alias("bi"), F.round(similarity, 9).alias("similarity"))
    e = e.withColumn("r", F.row_number().over(W.partitionBy(*group, "modality", "source").orderBy(F.desc("similarity"), "bi"))).filter((F.col("r") == 1) & (F.col("similarity") >= terms.MERGE_MIN_SIMILARITY))
    e = e.withColumn("place", F.row_number().over(W.partitionBy(*group, "modality").orderBy(F.desc("similarity"), "source")))
    return e.filter(F.col("place") <= F.floor(ratio * F.col("n"))).select(*group, "modality", "source", "target", "similarity")


def merge_groups(df: DataFrame, edges: DataFrame, group: list[str], most: int = terms.MERGE_MAX_GROUPS) -> DataFrame:
    """Groups of a target with its sources: strongest member, weighted time, members; the best few of each group."""
    members = edges.select(*group, F.col("target").alias("g"), F.col("source").alias("id")).unionByName(edges.select(*group, F.col("target").alias("g"), F.col("target").alias("id")).distinct())
    rows = members.join(df.select(*group, "id", "t", "relevance", "z", "modality"), [*group, "id"])
    weight = F.greatest("relevance", F.lit(0.0))
    m = rows.groupBy(*group, "g").agg(
        F.max_by("id", F.struct("z", "relevance", -F.col("t"), F.col("id"))).alias("representative"), F.max("z").alias("z"), F.first("modality").alias("modality"), F.array_sort(F.collect_list("id")).alias("members"),
        F.coalesce(F.try_divide(F.sum(weight * F.col("t")), F.sum(weight)), F.avg("t")).alias("t"),
    )
    s = edges.groupBy(*group, F.col("target").alias("g")).agg(F.avg("similarity").alias("similarity"))
    m = m.join(s, [*group, "g"])
    return m.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("z"), "t", "representative"))).filter(F.col("place") <= most)
