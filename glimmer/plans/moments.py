"""Queries: segments, moments, temporal pairs, tail merging, clips."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import moments as M
from ..operators.scoring import standardize
from ..operators.similar import similar
from ..registry import query
from ..functions.terms import DUPLICATE_ITEM_SIMILARITY, WHY_ANSWER_TERMS
from ..sources.tables import EVENT_CANDIDATES_SQL, TURNS_SQL, event_candidates, sql_jaccard, sql_list, sql_tokens, table, turns
from .selecting import SCALE, Z_SQL, scored

#: Seconds of a segment on the events' scale.
SEG = 86400.0
REACH = 43200.0
REL = "CASE WHEN len(q) = 0 OR len(c) = 0 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE * len(list_intersect(q, c)) / len(q) + 0.25::DOUBLE * len(list_intersect(q, c)) / len(c) END"
LEX_SQL = f"{TURNS_SQL}, tk AS (SELECT *, {sql_tokens('query')} AS q, {sql_tokens('text')} AS c FROM turns), lex AS (SELECT *, round({REL}, 9) AS relevance FROM tk)"


def lexical(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("toks", T.tokens("text"))
    return t.withColumn("relevance", F.round(T.lexical_relevance(T.tokens("query"), F.col("toks")), 9)).withColumn("saliency", F.lit(None).cast("double"))


def segmented(spark, sf_dir):
    c = event_candidates(spark, sf_dir).withColumn("segment_id", F.lit(None).cast("string")).withColumn("relevance", F.col("saliency"))
    c = c.withColumn("duration", F.max("t").over(W.partitionBy("video_id")) + 1.0)
    return c.withColumn("seg", M.segment_id(F.col("duration"), SEG))


SEG_SQL = f"""{EVENT_CANDIDATES_SQL},
  du AS (SELECT *, max(t) OVER (PARTITION BY video_id) + 1.0::DOUBLE AS duration FROM cand),
  sg AS (SELECT *, least(floor(t / {SEG}::DOUBLE), greatest(ceil(duration / {SEG}::DOUBLE) - 1, 0)) AS b FROM du),
  gr AS (SELECT video_id, 'long-segment-' || lpad(b::BIGINT::VARCHAR, 4, '0') AS seg, max(saliency) AS score, count(*) FILTER (WHERE modality = 'audio') AS n_audio, b * {SEG}::DOUBLE AS start, greatest(least(b * {SEG}::DOUBLE + {SEG}::DOUBLE, max(duration)), b * {SEG}::DOUBLE + 1.0) AS stop FROM sg GROUP BY video_id, b)"""


@query("s14_even_timestamps", "SELECT o_orderkey, i::INT AS i, round(least(o_totalprice, o_totalprice / 8 * i), 6) AS t FROM orders, range(0, 8) r(i) WHERE o_totalprice > 0")
def s14(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 0")
    return o.select("o_orderkey", "o_totalprice", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("o_orderkey", "i", F.round(F.least("o_totalprice", F.col("o_totalprice") / 8 * F.col("i")), 6).alias("t"))


@query("s15_audio_windows", "SELECT o_orderkey, i::INT AS i, i * 30000.0::DOUBLE AS start, round(least(30000.0::DOUBLE, o_totalprice - i * 30000.0::DOUBLE), 6) AS duration FROM orders, range(0, 1000) r(i) WHERE o_totalprice > 0 AND i < ceil(o_totalprice / 30000.0::DOUBLE)")
def s15(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 0")
    o = o.select("o_orderkey", "o_totalprice", F.explode(F.sequence(F.lit(0), F.ceil(F.col("o_totalprice") / 30000.0).cast("int") - 1)).alias("i"))
    return o.select("o_orderkey", "i", (F.col("i") * 30000.0).alias("start"), F.round(F.least(F.lit(30000.0), F.col("o_totalprice") - F.col("i") * 30000.0), 6).alias("duration"))


@query("w1_transcript_context", f"""
WITH {TURNS_SQL} SELECT video_id, id, string_agg(nullif(trim(text), ''), ' ') OVER w AS context, first(start) OVER w AS start, last(start + 30.0::DOUBLE) OVER w AS stop FROM turns WINDOW w AS (PARTITION BY video_id ORDER BY turn, id, text ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def w1(spark, sf_dir):
    w = W.partitionBy("video_id").orderBy("turn", "id", "text").rowsBetween(-1, 1)
    t = turns(spark, sf_dir)
    text = F.array_join(F.collect_list(F.when(F.trim("text") != "", F.trim("text"))).over(w), " ")
    return t.select("video_id", "id", text.alias("context"), F.first("start").over(w).alias("start"), F.last(F.col("start") + 30.0).over(w).alias("stop"))


@query("a3_segment_groups", f"WITH {SEG_SQL} SELECT video_id, seg, round(score, 6) AS score, n_audio, start, round(stop, 6) AS stop FROM gr")
def a3(spark, sf_dir):
    return M.segment_groups(segmented(spark, sf_dir), ["video_id"], SEG).select("video_id", "seg", F.round("score", 6).alias("score"), "n_audio", "start", F.round("stop", 6).alias("stop"))


@query("k10_segment_shortlist", f"WITH {SEG_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start, seg) AS place FROM gr) SELECT sg.video_id, sg.id FROM sg JOIN p ON sg.video_id = p.video_id AND p.start = sg.b * {SEG}::DOUBLE WHERE place <= 12")
def k10(spark, sf_dir):
    s = segmented(spark, sf_dir)
    best = M.shortlist(M.segment_groups(s, ["video_id"], SEG), ["video_id"]).select("video_id", "seg")
    return s.join(best, ["video_id", "seg"], "left_semi").select("video_id", "id")


@query("j11_nearest_fraction", f"""
WITH {SEG_SQL}, a AS (SELECT * FROM gr WHERE n_audio > 0), b AS (SELECT *, min(start) OVER (PARTITION BY video_id) AS lo, max(stop) OVER (PARTITION BY video_id) AS hi FROM a),
c AS (SELECT video_id, f, arg_min(seg, (round(abs((start + stop) / 2 - (lo + (hi - lo) * f)), 6), start)) AS seg FROM b, (VALUES (1.0::DOUBLE / 6), (0.5::DOUBLE), (5.0::DOUBLE / 6)) v(f) GROUP BY video_id, f)
SELECT DISTINCT video_id, seg FROM c""")
def j11(spark, sf_dir):
    w = W.partitionBy("video_id")
    g = M.segment_groups(segmented(spark, sf_dir), ["video_id"], SEG).filter("n_audio > 0").withColumn("lo", F.min("start").over(w)).withColumn("hi", F.max("stop").over(w))
    g = g.withColumn("f", F.explode(F.array(F.lit(1.0 / 6), F.lit(0.5), F.lit(5.0 / 6))))
    gap = F.round(F.abs((F.col("start") + F.col("stop")) / 2 - (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f"))), 6)
    return g.groupBy("video_id", "f").agg(F.min_by("seg", F.struct(gap, F.col("start"))).alias("seg")).select("video_id", "seg").distinct()


NV_SQL = f"""
  nv AS (SELECT a.video_id, a.id, v.id AS vid, row_number() OVER (PARTITION BY a.video_id, a.id ORDER BY abs(a.t - v.t) NULLS LAST, coalesce(v.saliency, 0) DESC, v.t, v.id) AS rn
    FROM cand a LEFT JOIN cand v ON a.video_id = v.video_id AND v.modality = 'visual' AND abs(a.t - v.t) <= {12 * SCALE}::DOUBLE WHERE a.modality = 'audio')"""


@query("j1_nearest_visual", f"WITH {EVENT_CANDIDATES_SQL}, {NV_SQL} SELECT video_id, id, vid FROM nv WHERE rn = 1")
def j1(spark, sf_dir):
    return M.nearest_visual(event_candidates(spark, sf_dir), ["video_id"], 12 * SCALE).select("video_id", "id", "vid")


@query("k11_moment_fusion", f"""
WITH {LEX_SQL}, nv AS (SELECT a.video_id, a.id, a.t, round(a.relevance + CASE WHEN starts_with(lower(trim(a.query)), 'why') THEN 0.2::DOUBLE * len(list_filter({sql_list(WHY_ANSWER_TERMS)}, lambda k: contains(lower(a.text), k))) ELSE 0 END, 9) AS relevance, v.id AS vid, row_number() OVER (PARTITION BY a.video_id, a.id ORDER BY abs(a.t - v.t) NULLS LAST, v.t, v.id) AS rn
  FROM lex a LEFT JOIN lex v ON a.video_id = v.video_id AND v.modality = 'visual' AND abs(a.t - v.t) <= 31 WHERE a.modality = 'audio' AND a.relevance >= 0.12),
one AS (SELECT * FROM nv WHERE rn = 1), f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY relevance DESC, t, id) AS place FROM one)
SELECT video_id, CASE WHEN vid IS NULL THEN id ELSE id || '+' || vid END AS id, 'audio' AS modality, round(relevance, 6) AS relevance FROM f WHERE place <= 8
UNION ALL SELECT video_id, id, modality, round(relevance, 6) FROM lex WHERE modality = 'visual' AND relevance >= 0.12 AND (video_id, id) NOT IN (SELECT (video_id, vid) FROM one WHERE vid IS NOT NULL)""")
def k11(spark, sf_dir):
    return M.fuse(lexical(spark, sf_dir), ["video_id"], 31.0).select("video_id", "id", "modality", F.round("relevance", 6).alias("relevance"))


@query("k12_global_audio", f"WITH {EVENT_CANDIDATES_SQL}, a AS (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY t, id) AS i, count(*) OVER (PARTITION BY video_id) AS n FROM cand WHERE modality = 'audio') SELECT video_id, id, 1.0::DOUBLE AS relevance FROM a WHERE i IN (1, n // 2 + 1, n)")
def k12(spark, sf_dir):
    """First, middle and last audio count as fully relevant."""
    w = W.partitionBy("video_id")
    a = event_candidates(spark, sf_dir).filter("modality = 'audio'").withColumn("i", F.row_number().over(w.orderBy("t", "id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return a.filter(F.expr("i in (1, n div 2 + 1, n)")).select("video_id", "id", F.lit(1.0).alias("relevance"))


@query("k13_opening_visual", f"WITH {EVENT_CANDIDATES_SQL} SELECT video_id, arg_min(id, (t, id)) AS id FROM cand WHERE modality = 'visual' GROUP BY video_id")
def k13(spark, sf_dir):
    return event_candidates(spark, sf_dir).filter("modality = 'visual'").groupBy("video_id").agg(F.min_by("id", F.struct("t", "id")).alias("id"))


@query("k16_counting_neighbors", f"""
WITH {EVENT_CANDIDATES_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY saliency DESC, t, id) AS r FROM cand WHERE modality = 'visual'),
p AS (SELECT c.video_id, c.id, n.id AS neighbor, row_number() OVER (PARTITION BY c.video_id, c.id ORDER BY abs(c.t - n.t), n.t, n.id) AS rn FROM v c JOIN v n ON c.video_id = n.video_id AND c.r <= 3 AND n.r > 3 AND abs(c.t - n.t) <= {12 * SCALE}::DOUBLE)
SELECT video_id, id, neighbor FROM p WHERE rn = 1""")
def k16(spark, sf_dir):
    """For each of the three chosen visuals, the nearest unchosen one within the radius."""
    from ..operators.scoring import nearest

    v = event_candidates(spark, sf_dir).filter("modality = 'visual'").withColumn("r", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("saliency"), "t", "id")))
    rest = v.filter("r > 3").select("video_id", F.col("id").alias("rid"), F.col("t").alias("rt"))
    n = nearest(v.filter("r <= 3"), rest, ["video_id"], 12 * SCALE, [F.abs(F.col("t") - F.col("rt")).asc_nulls_last(), F.col("rt"), F.col("rid")])
    return n.filter("rid is not null").select("video_id", "id", F.col("rid").alias("neighbor"))


@query("j5_temporal_pairs", f"""
WITH {EVENT_CANDIDATES_SQL}, s AS (SELECT video_id, id, t, segment_id, saliency / 500 AS sa, 1 - saliency / 500 AS sb FROM cand),
p AS (SELECT a.video_id, a.id AS anchor, b.id AS target, a.t AS at, b.t AS bt, abs(a.t - b.t) AS gap, b.segment_id AS seg, a.segment_id <> b.segment_id AS moved, a.sa, b.sb FROM s a JOIN s b ON a.video_id = b.video_id AND b.t > a.t AND b.t <= a.t + {REACH}::DOUBLE),
q AS (SELECT *, bool_or(moved) OVER (PARTITION BY video_id, anchor) AS anym, row_number() OVER (PARTITION BY video_id, anchor ORDER BY gap, bt, target) AS near,
  min(CASE WHEN moved THEN gap END) OVER (PARTITION BY video_id, anchor, seg) AS sgap, row_number() OVER (PARTITION BY video_id, anchor, seg ORDER BY sb DESC, bt, target) AS best FROM p),
k AS (SELECT *, dense_rank() OVER (PARTITION BY video_id, anchor, moved ORDER BY sgap) AS place FROM q)
SELECT video_id, anchor, target, round(sa + sb + 0.25::DOUBLE * greatest(1 - gap / {REACH}::DOUBLE, 0) + CASE WHEN moved THEN 0.1::DOUBLE ELSE 0 END, 6) AS score FROM k
WHERE CASE WHEN anym THEN moved AND place <= 8 AND best = 1 ELSE near = 1 END""")
def j5(spark, sf_dir):
    c = event_candidates(spark, sf_dir).withColumn("anchor_score", F.col("saliency") / 500).withColumn("target_score", 1 - F.col("saliency") / 500).withColumn("text", F.lit(""))
    return M.temporal_pairs(c, ["video_id"], "after", "what happens", "the event", REACH).select("video_id", "anchor", "target", F.round("score", 6).alias("score"))


@query("j6_pair_terms", r"""
WITH d AS (SELECT doc_id, text, contains(text, ':') AS c, regexp_extract(text, '(?s)^[^:]*:(.*)$', 1) AS o FROM documents),
w AS (SELECT *, regexp_extract_all(o, '[A-Za-z0-9]+') AS ws FROM d), i AS (SELECT *, list_filter(ws, lambda x: length(x) >= 3) AS inf FROM w)
SELECT doc_id, CASE WHEN c AND len(inf) > 0 THEN CASE WHEN len(inf) <= 8 THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END + CASE WHEN len(list_filter(inf, lambda x: length(x) >= 4 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) > 0 THEN 0.15::DOUBLE ELSE 0 END ELSE 0.0::DOUBLE END AS bonus,
  CASE WHEN NOT c THEN 0.0::DOUBLE WHEN len(ws) = 0 THEN 0.5::DOUBLE WHEN len(inf) = 0 THEN 0.75::DOUBLE ELSE CASE WHEN len(list_filter(ws, lambda x: length(x) <= 2))::DOUBLE / len(ws) > 0.45 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN length(regexp_replace(o, '[A-Za-z0-9\s]', '', 'g'))::DOUBLE / greatest(length(o), 1) > 0.2 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN len(inf) = 1 THEN 0.2::DOUBLE ELSE 0 END END AS penalty FROM i""")
def j6(spark, sf_dir):
    q = F.lit("which title")
    return table(spark, sf_dir, "documents").select("doc_id", M.target_text_bonus(q, F.col("text")).alias("bonus"), M.target_noise_penalty(q, F.col("text")).alias("penalty"))


SIGMA = 120.0
MERGE_SQL = f"""{LEX_SQL},
  o AS (SELECT *, row_number() OVER (PARTITION BY video_id, modality ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY video_id, modality) AS n FROM lex),
  pr AS (SELECT a.video_id, a.modality, a.id AS source, b.id AS target, a.n, b.i AS bi, exp(-((a.t - b.t) * (a.t - b.t)) / ({SIGMA}::DOUBLE * {SIGMA}::DOUBLE)) AS k, a.c AS ac, b.c AS bc FROM o a JOIN o b ON a.video_id = b.video_id AND a.modality = b.modality AND a.i % 2 = 0 AND b.i % 2 = 1),
  sm AS (SELECT *, CASE WHEN k < 0.1 THEN 0.0 ELSE round(0.65::DOUBLE * k + 0.35::DOUBLE * {sql_jaccard('ac', 'bc')}, 9) END AS similarity FROM pr),
  be AS (SELECT *, row_number() OVER (PARTITION BY video_id, modality, source ORDER BY similarity DESC, bi) AS r FROM sm),
  ed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, modality ORDER BY similarity DESC, source) AS place FROM be WHERE r = 1 AND similarity >= 0.35) WHERE place <= floor(0.5 * n))"""


@query("j8_bipartite_match", f"WITH {MERGE_SQL} SELECT video_id, modality, source, target, round(similarity, 6) AS similarity FROM ed")
def j8(spark, sf_dir):
    return M.merge_edges(lexical(spark, sf_dir), ["video_id"], SIGMA).select("video_id", "modality", "source", "target", F.round("similarity", 6).alias("similarity"))


@query("k19_tail_merge", f"""
WITH {MERGE_SQL}, z AS (SELECT video_id, id, t, relevance, modality, CASE WHEN min(relevance) OVER w = max(relevance) OVER w THEN 0.0::DOUBLE ELSE round((relevance - avg(relevance) OVER w) / stddev_pop(relevance) OVER w, 9) END AS z FROM lex WINDOW w AS (PARTITION BY video_id, modality)),
m AS (SELECT video_id, target AS g, source AS id FROM ed UNION SELECT video_id, target, target FROM ed),
g AS (SELECT m.video_id, g, arg_max(m.id, (z, relevance, -t, m.id)) AS representative, max(z) AS z, list_sort(list(m.id)) AS members, CASE WHEN sum(greatest(relevance, 0)) > 0 THEN sum(greatest(relevance, 0) * t) / sum(greatest(relevance, 0)) ELSE avg(t) END AS t FROM m JOIN z ON m.video_id = z.video_id AND m.id = z.id GROUP BY m.video_id, g),
s AS (SELECT video_id, target AS g, avg(similarity) AS similarity FROM ed GROUP BY video_id, target),
p AS (SELECT g.*, s.similarity, row_number() OVER (PARTITION BY g.video_id ORDER BY z DESC, t, representative) AS place FROM g JOIN s ON g.video_id = s.video_id AND g.g = s.g)
SELECT video_id, representative, members, round(t, 6) AS t, round(similarity, 6) AS similarity, place::INT AS place FROM p WHERE place <= 2""")
def k19(spark, sf_dir):
    rows = standardize(lexical(spark, sf_dir), "relevance", ["video_id", "modality"])
    g = M.merge_groups(rows, M.merge_edges(rows, ["video_id"], SIGMA), ["video_id"])
    return g.select("video_id", "representative", "members", F.round("t", 6).alias("t"), F.round("similarity", 6).alias("similarity"), "place")


@query("a7_merge_group", f"""
WITH {MERGE_SQL}, m AS (SELECT video_id, target AS g, source AS id FROM ed UNION SELECT video_id, target, target FROM ed),
x AS (SELECT m.video_id, m.g, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s, t, l.id FROM m JOIN lex l ON m.video_id = l.video_id AND m.id = l.id),
d AS (SELECT video_id, g, k, arg_min(s, (t, id)) AS s, min((t, id)) AS o FROM x WHERE s <> '' GROUP BY video_id, g, k), j AS (SELECT video_id, g, string_agg(s, ' ' ORDER BY o) AS text FROM d GROUP BY video_id, g)
SELECT video_id, g, CASE WHEN length(text) <= 320 THEN text ELSE rtrim(substr(text, 1, 319)) || '…' END AS text FROM j""")
def a7(spark, sf_dir):
    """A group's text: members in time order, each once whatever its case, at most 320 characters."""
    rows = lexical(spark, sf_dir)
    e = M.merge_edges(rows, ["video_id"], SIGMA)
    m = e.select("video_id", F.col("target").alias("g"), F.col("source").alias("id")).unionByName(e.select("video_id", F.col("target").alias("g"), F.col("target").alias("id")).distinct())
    x = m.join(rows.select("video_id", "id", "t", T.normalize_query("text").alias("s")), ["video_id", "id"]).filter("s <> ''")
    d = x.groupBy("video_id", "g", F.lower("s").alias("k")).agg(F.min(F.struct("t", "id", "s")).alias("o"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["s"]), " ")
    return d.groupBy("video_id", "g").agg(text.alias("text")).select("video_id", "g", F.when(F.length("text") <= 320, F.col("text")).otherwise(F.concat(F.rtrim(F.substring("text", 1, 319)), F.lit("…"))).alias("text"))


@query("j7_interval_overlap", f"""
WITH {TURNS_SQL}, e AS (SELECT item_id, (item_id % 20) * 10.0::DOUBLE AS a, (item_id % 20) * 10.0::DOUBLE + 12 AS b FROM benchmark)
SELECT DISTINCT video_id, id FROM turns JOIN e ON video_id % 40 = item_id WHERE start <= b + 2 AND a <= start + 30 + 2""")
def j7(spark, sf_dir):
    e = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 20 * 10.0).alias("a")).withColumn("b", F.col("a") + 12)
    t = turns(spark, sf_dir)
    return t.join(e, (t["video_id"] % 40 == e["item_id"]) & (t["start"] <= e["b"] + 2) & (e["a"] <= t["start"] + 32), "left_semi").select("video_id", "id").distinct()


@query("j16_duplicates", f"""
WITH {TURNS_SQL}, k AS (SELECT *, {sql_tokens('text')} AS c, row_number() OVER (PARTITION BY video_id ORDER BY turn, id, text) AS i FROM turns)
SELECT x.video_id, x.id, bool_or(y.i IS NOT NULL AND {sql_jaccard('x.c', 'y.c')} >= 0.72) AS duplicate FROM k x LEFT JOIN k y ON x.video_id = y.video_id AND x.modality = y.modality AND y.i < x.i GROUP BY x.video_id, x.id, x.i""")
def j16(spark, sf_dir):
    k = turns(spark, sf_dir).withColumn("c", T.tokens("text")).withColumn("i", F.row_number().over(W.partitionBy("video_id").orderBy("turn", "id", "text")))
    hit = similar(k.select("video_id", "modality", "i", F.col("c").alias("toks")), ["video_id", "modality"], DUPLICATE_ITEM_SIMILARITY).select("video_id", "i").distinct()
    return k.join(hit.withColumn("hit", F.lit(True)), ["video_id", "i"], "left").select("video_id", "id", F.coalesce("hit", F.lit(False)).alias("duplicate"))


@query("k25_head_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) WHERE i <= 3")
def k25(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return d.withColumn("i", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).filter("i <= 3").drop("i")


@query("k24_top_up", f"""
WITH {Z_SQL}, c AS (SELECT video_id, id, saliency, t, row_number() OVER (PARTITION BY video_id ORDER BY t, id) <= 2 AS chosen FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY chosen DESC, CASE WHEN chosen THEN 0 ELSE saliency END DESC, t, id) AS i FROM c)
SELECT video_id, id FROM r WHERE i <= 8""")
def k24(spark, sf_dir):
    """What is chosen already stays; the rest of the budget goes to the most salient."""
    w = W.partitionBy("video_id")
    c = scored(spark, sf_dir).withColumn("chosen", F.row_number().over(w.orderBy("t", "id")) <= 2)
    r = F.row_number().over(w.orderBy(F.desc("chosen"), F.when(F.col("chosen"), 0.0).otherwise(F.col("saliency")).desc(), "t", "id"))
    return c.withColumn("i", r).filter("i <= 8").select("video_id", "id")


def clip_span(intent, modality, low_query, t, start, stop, duration, default: float = 8.0, most: float = 12.0, speech_most: float = 90.0):
    """struct(start, stop): nine rules by modality, scene bounds and intent, inside [0, duration]."""

    def centered(width):
        a, b = t - width / 2, t + width / 2
        b = F.when(a < 0, F.least(b - a, duration)).otherwise(b)
        a = F.greatest(a, F.lit(0.0))
        return F.struct(F.when(b > duration, F.greatest(duration - width, F.lit(0.0))).otherwise(a).alias("a"), F.least(b, duration).alias("b"))

    def bounded(a, b, cap):
        a = F.greatest(a, F.lit(0.0))
        b = F.least(F.greatest(b, a), duration)
        b = F.when(b - a > cap, F.least(a + cap, duration)).otherwise(b)
        b = F.when(b <= a, F.least(a + 1.0, duration)).otherwise(b)
        return F.struct(F.when((b - a < 1.0) & (a > 0), F.greatest(b - 1.0, F.lit(0.0))).otherwise(a).alias("a"), b.alias("b"))

    scene_a = F.greatest(start, F.lit(0.0))
    scene_b = F.least(F.greatest(stop, scene_a + 1.0), duration)
    inner_a = F.greatest(t - most / 2, scene_a)
    inner_b = F.least(inner_a + most, scene_b)
    words = T.ascii_words(low_query)
    temporal = intent == "temporal_before_after"
    return (
        F.when((modality == "visual") & start.isNotNull() & stop.isNotNull() & (scene_b - scene_a > most), F.struct(F.greatest(inner_b - most, scene_a).alias("a"), inner_b.alias("b")))
        .when((modality == "visual") & start.isNotNull() & stop.isNotNull(), bounded(scene_a, scene_b, most))
        .when(temporal & F.arrays_overlap(words, T.words_in(["before", "prior"])), bounded(t - most, t + default / 2, most))
        .when(temporal & F.arrays_overlap(words, T.words_in(["after", "then", "next", "following"])), bounded(t - default / 2, t + most, most))
        .when(temporal, centered(most))
        .when((modality == "audio") & start.isNotNull() & stop.isNotNull(), bounded(F.coalesce(F.nullif(start, F.lit(0.0)), t), F.coalesce(F.nullif(stop, F.lit(0.0)), t + default), max(most, speech_most)))
        .when((modality == "audio") | (intent == "speech_semantic"), centered(min(most, default + 2.0)))
        .otherwise(centered(default))
    )


@query("t28_clip_span", """
WITH i(intent, query) AS (VALUES ('temporal_before_after', 'before it'), ('temporal_before_after', 'after it'), ('temporal_before_after', 'while it'), ('speech_semantic', 'why'), ('visual_object_action', 'which')),
c AS (SELECT conv_id, turn, role, intent, query, CASE WHEN role = 'user' THEN 'audio' ELSE 'visual' END AS m, turn * 30.0::DOUBLE + 15 AS t, 250.0::DOUBLE AS d,
  CASE WHEN turn % 3 <> 0 THEN turn * 30.0::DOUBLE END AS s, CASE WHEN turn % 3 <> 0 THEN turn * 30.0::DOUBLE + CASE WHEN turn % 3 = 1 THEN 8 ELSE 40 END END AS e FROM conversations, i),
k AS (SELECT *, CASE WHEN m = 'visual' AND s IS NOT NULL THEN CASE WHEN least(greatest(e, greatest(s, 0) + 1), d) - greatest(s, 0) > 12 THEN 'inner' ELSE 'scene' END WHEN intent = 'temporal_before_after' AND query = 'before it' THEN 'pre' WHEN intent = 'temporal_before_after' AND query = 'after it' THEN 'post'
   WHEN intent = 'temporal_before_after' THEN 'c12' WHEN m = 'audio' AND s IS NOT NULL THEN 'speech' WHEN m = 'audio' OR intent = 'speech_semantic' THEN 'c10' ELSE 'c8' END AS rule FROM c),
r AS (SELECT *, CASE rule WHEN 'c12' THEN 12.0::DOUBLE WHEN 'c10' THEN 10.0 WHEN 'c8' THEN 8.0 END AS w,
  greatest(CASE rule WHEN 'scene' THEN s WHEN 'pre' THEN t - 12 WHEN 'post' THEN t - 4 WHEN 'speech' THEN coalesce(nullif(s, 0), t) END, 0) AS a0, CASE rule WHEN 'scene' THEN least(greatest(e, s + 1), d) WHEN 'pre' THEN t + 4 WHEN 'post' THEN t + 12 WHEN 'speech' THEN coalesce(nullif(e, 0), t + 8) END AS b0, CASE rule WHEN 'speech' THEN 90 ELSE 12 END AS cap FROM k),
b AS (SELECT *, least(greatest(b0, a0), d) AS b1 FROM r), b2 AS (SELECT *, CASE WHEN b1 - a0 > cap THEN least(a0 + cap, d) ELSE b1 END AS b2 FROM b), b3 AS (SELECT *, CASE WHEN b2 <= a0 THEN least(a0 + 1, d) ELSE b2 END AS b3 FROM b2),
n AS (SELECT *, least(greatest(t - 6, s) + 12, least(greatest(e, s + 1), d)) AS ib FROM b3)
SELECT conv_id, turn, role, intent, query, round(CASE WHEN rule = 'inner' THEN greatest(ib - 12, s) WHEN w IS NOT NULL THEN CASE WHEN (CASE WHEN t - w / 2 < 0 THEN least(w, d) ELSE t + w / 2 END) > d THEN greatest(d - w, 0) ELSE greatest(t - w / 2, 0) END ELSE CASE WHEN b3 - a0 < 1 AND a0 > 0 THEN greatest(b3 - 1, 0) ELSE a0 END END, 6) AS start,
  round(CASE WHEN rule = 'inner' THEN ib WHEN w IS NOT NULL THEN least(CASE WHEN t - w / 2 < 0 THEN least(w, d) ELSE t + w / 2 END, d) ELSE b3 END, 6) AS stop FROM n""")
def t28(spark, sf_dir):
    i = spark.createDataFrame([("temporal_before_after", "before it"), ("temporal_before_after", "after it"), ("temporal_before_after", "while it"), ("speech_semantic", "why"), ("visual_object_action", "which")], "intent string, query string")
    c = table(spark, sf_dir, "conversations").crossJoin(F.broadcast(i))
    t, bounded = F.col("turn") * 30.0 + 15.0, F.col("turn") % 3 != 0
    s = F.when(bounded, F.col("turn") * 30.0)
    e = F.when(bounded, F.col("turn") * 30.0 + F.when(F.col("turn") % 3 == 1, 8.0).otherwise(40.0))
    span = clip_span(F.col("intent"), F.when(F.col("role") == "user", "audio").otherwise("visual"), F.col("query"), t, s, e, F.lit(250.0))
    return c.select("conv_id", "turn", "role", "intent", "query", span.alias("k")).select("conv_id", "turn", "role", "intent", "query", F.round("k.a", 6).alias("start"), F.round("k.b", 6).alias("stop"))


@query("u11_candidate_construction", f"""
WITH {TURNS_SQL} SELECT video_id || ':' || modality || ':' || turn AS id, t, CASE WHEN modality = 'audio' THEN text ELSE 'on-screen text near ' || printf('%.2f', t) || ' seconds: ' || text END AS text, CASE WHEN modality = 'audio' THEN 'audio-window-' || turn END AS segment_id, start, start + 30.0::DOUBLE AS stop FROM turns""")
def u11(spark, sf_dir):
    audio = F.col("modality") == "audio"
    text = F.when(audio, F.col("text")).otherwise(F.concat(F.lit("on-screen text near "), F.format_string("%.2f", F.col("t")), F.lit(" seconds: "), F.col("text")))
    return turns(spark, sf_dir).select(F.concat_ws(":", F.col("video_id").cast("string"), "modality", F.col("turn").cast("string")).alias("id"), "t", text.alias("text"), F.when(audio, F.concat(F.lit("audio-window-"), F.col("turn").cast("string"))).alias("segment_id"), "start", (F.col("start") + 30.0).alias("stop"))
