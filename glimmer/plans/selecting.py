"""Queries: scoring and selection over ``events`` (a user's events are one video's candidates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.text import time_kernel
from ..operators import scoring, selection
from ..registry import query
from ..sources.tables import EVENT_CANDIDATES_SQL, event_candidates, sql_jaccard

#: Media kernels are in seconds; the events span a month, so they are widened to hours.
SCALE = 3600.0
GROUP = ["video_id"]

Z_SQL = EVENT_CANDIDATES_SQL + """,
  zs AS (
    SELECT *, CASE WHEN min(saliency) OVER w = max(saliency) OVER w THEN 0.0::DOUBLE
                   ELSE round((saliency - avg(saliency) OVER w) / stddev_pop(saliency) OVER w, 9) + 0.0 END AS z
    FROM cand WINDOW w AS (PARTITION BY video_id, modality)),
  ga AS (SELECT video_id, CASE WHEN max(saliency) >= 0.15 THEN greatest(0.15::DOUBLE, 0.6::DOUBLE * max(saliency)) END AS fl FROM cand WHERE modality = 'audio' GROUP BY video_id),
  an AS (SELECT c.video_id, c.id AS rid, c.t AS rt FROM cand c JOIN ga ON c.video_id = ga.video_id WHERE c.modality = 'audio' AND c.saliency >= ga.fl),
  ap AS (
    SELECT z.video_id, z.id, an.rt, exp(-((z.t - an.rt) * (z.t - an.rt)) / (28800.0::DOUBLE * 28800.0::DOUBLE)) AS s,
           row_number() OVER (PARTITION BY z.video_id, z.id ORDER BY abs(z.t - an.rt), an.rt, an.rid) AS rn
    FROM zs z JOIN an ON z.video_id = an.video_id WHERE z.modality = 'visual'),
  boosted AS (
    SELECT z.video_id, z.id, z.modality, z.t, z.segment_id, z.saliency, z.saliency + coalesce(0.1::DOUBLE * a.s, 0) AS relevance, z.z + coalesce(1.25::DOUBLE * a.s, 0) AS z,
           coalesce(a.s, 0.0::DOUBLE) AS anchor_score, a.rt AS anchor_t
    FROM zs z LEFT JOIN (SELECT * FROM ap WHERE rn = 1 AND s >= 0.25) a ON z.video_id = a.video_id AND z.id = a.id)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.standardize(event_candidates(spark, sf_dir), "saliency", ["video_id", "modality"])


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.audio_anchors(scored(spark, sf_dir).withColumn("relevance", F.col("saliency")), GROUP, SCALE)


@query("a1_standardize", f"WITH {Z_SQL} SELECT video_id, id, modality, z FROM zs")
def a1(spark, sf_dir):
    return scored(spark, sf_dir).select("video_id", "id", "modality", "z")


@query("j2_nearest_audio_anchor", f"WITH {Z_SQL} SELECT video_id, id, anchor_t, round(anchor_score, 6) AS anchor_score FROM boosted WHERE modality = 'visual'")
def j2(spark, sf_dir):
    return anchored(spark, sf_dir).filter("modality = 'visual'").select("video_id", "id", "anchor_t", F.round("anchor_score", 6).alias("anchor_score"))


@query("j3_anchor_boost", f"WITH {Z_SQL} SELECT video_id, id, round(relevance, 6) AS relevance, round(z, 6) AS z FROM boosted")
def j3(spark, sf_dir):
    return anchored(spark, sf_dir).select("video_id", "id", F.round("relevance", 6).alias("relevance"), F.round("z", 6).alias("z"))


@query("t5_time_kernel", f"WITH {EVENT_CANDIDATES_SQL} SELECT video_id, id, round(exp(-((t - p) * (t - p)) / (50400.0::DOUBLE * 50400.0::DOUBLE)), 6) AS s FROM (SELECT *, lag(t) OVER (PARTITION BY video_id ORDER BY t, id) AS p FROM cand)")
def t5(spark, sf_dir):
    c = event_candidates(spark, sf_dir).withColumn("p", F.lag("t").over(W.partitionBy("video_id").orderBy("t", "id")))
    return c.select("video_id", "id", F.round(time_kernel(F.col("t"), F.col("p"), 14 * SCALE), 6).alias("s"))


@query("a2_best_duplicate", """
SELECT user_id, event_type, max(value) AS value, arg_min(event_id, (-value, event_id)) AS event_id FROM events GROUP BY user_id, event_type""")
def a2(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return scoring.best_of_duplicates(e, ["user_id", "event_type"], "value", ["event_id"]).select("user_id", "event_type", "value", "event_id")


def mmr_sql(source: str, k: int, lam: float, sigma: float, prefix: str = "", drop: bool = False) -> str:
    """CTEs ``rec`` (rn = 1 rows are the picks) over ``source``(video_id, id, t, modality, z, anchor_t), with ``drop``
    also c, its tokens: redundant audio neighbours of a pick then leave the pool."""
    ker = f"exp(-((r.t - p.t) * (r.t - p.t)) / ({sigma}::DOUBLE * {sigma}::DOUBLE))"
    pair = "coalesce((r.modality = 'visual' AND r.anchor_t = p.t) OR (p.modality = 'visual' AND p.anchor_t = r.t), false)"
    sim = f"CASE WHEN r.modality = p.modality THEN {ker} WHEN {pair} THEN 0.0::DOUBLE ELSE 0.15::DOUBLE * {ker} END"
    own, theirs, near = "", "", ""
    if drop:
        own, theirs = ", c", ", r.c"
        near = f""" AND NOT (r.modality = 'audio' AND p.modality = 'audio' AND abs(r.t - p.t) <= {terms.NEIGHBOR_GAP_SIGMAS}::DOUBLE * {sigma}::DOUBLE
        AND least(len(r.c), len(p.c)) >= {terms.NEIGHBOR_MIN_TOKENS} AND {sql_jaccard('r.c', 'p.c')} >= {terms.NEIGHBOR_SIMILARITY}::DOUBLE)"""
    return f"""
  {prefix}rec AS (
    SELECT video_id, 1 AS rank, id, t, modality, z, anchor_t{own}, -1.0::DOUBLE AS sim, z AS mmr, row_number() OVER (PARTITION BY video_id ORDER BY z DESC, t, id) AS rn FROM {source}
    UNION ALL
    SELECT video_id, rank + 1, id, t, modality, z, anchor_t{own}, sim, {lam}::DOUBLE * z - (1.0::DOUBLE - {lam}::DOUBLE) * sim AS mmr,
           row_number() OVER (PARTITION BY video_id ORDER BY {lam}::DOUBLE * z - (1.0::DOUBLE - {lam}::DOUBLE) * sim DESC, t, id) AS rn
    FROM (
      SELECT r.video_id, r.rank, r.id, r.t, r.modality, r.z, r.anchor_t{theirs}, greatest(r.sim, {sim}) AS sim
      FROM {prefix}rec r JOIN {prefix}rec p ON r.video_id = p.video_id AND r.rank = p.rank
      WHERE p.rn = 1 AND r.rn > 1 AND r.rank < {k}{near}))"""


def _mmr(preset: str, source: str = "zs0") -> str:
    k, lam, sigma = terms.PRESETS[preset]
    return f"WITH RECURSIVE {Z_SQL}, zs0 AS (SELECT *, NULL::DOUBLE AS anchor_t FROM zs), {mmr_sql(source, k, lam, sigma * SCALE)}"


@query("k1_mmr_select", _mmr("balanced") + " SELECT video_id, id, rank, round(mmr, 6) AS mmr FROM rec WHERE rn = 1")
def k1(spark, sf_dir):
    return selection.mmr_select(scored(spark, sf_dir), GROUP, "balanced", SCALE, drop_neighbors=False).select("video_id", "id", "rank", F.round("mmr", 6).alias("mmr"))


@query("k1_mmr_anchored", _mmr("conservative", "boosted") + " SELECT video_id, id, rank, round(mmr, 6) AS mmr FROM rec WHERE rn = 1")
def k1_anchored(spark, sf_dir):
    return selection.mmr_select(anchored(spark, sf_dir), GROUP, "conservative", SCALE, drop_neighbors=False).select("video_id", "id", "rank", F.round("mmr", 6).alias("mmr"))


@query("a4_response_metrics", _mmr("balanced") + """,
  m AS (SELECT video_id, count(*) AS n_in, count(*) FILTER (WHERE modality = 'visual') AS v_in, count(*) FILTER (WHERE modality = 'audio') AS a_in FROM cand GROUP BY video_id),
  s AS (SELECT video_id, count(*) AS n_out, count(*) FILTER (WHERE modality = 'visual') AS v_out, count(*) FILTER (WHERE modality = 'audio') AS a_out FROM rec WHERE rn = 1 GROUP BY video_id)
SELECT m.video_id, n_in, n_out, v_out, a_out, round((1 - n_out::DOUBLE / n_in) * 100, 6) AS reduction_percent,
       258 * v_in + 32 * a_in AS baseline_tokens, 258 * v_out + 32 * a_out AS compressed_tokens,
       round(greatest(258 * v_in + 32 * a_in - 258 * v_out - 32 * a_out, 0)::DOUBLE / (258 * v_in + 32 * a_in), 6) AS token_reduction
FROM m JOIN s ON m.video_id = s.video_id""")
def a4(spark, sf_dir):
    z = scored(spark, sf_dir)
    count = lambda d, s: d.groupBy("video_id").agg(F.count(F.lit(1)).alias(f"n_{s}"), F.count_if(F.col("modality") == "visual").alias(f"v_{s}"), F.count_if(F.col("modality") == "audio").alias(f"a_{s}"))
    m = count(z, "in").join(count(selection.mmr_select(z, GROUP, "balanced", SCALE, drop_neighbors=False), "out"), "video_id")
    v, a = terms.TOKENS_PER_ITEM["generic"]
    base, out = v * F.col("v_in") + a * F.col("a_in"), v * F.col("v_out") + a * F.col("a_out")
    return m.select("video_id", "n_in", "n_out", "v_out", "a_out", F.round((1 - F.col("n_out") / F.col("n_in")) * 100, 6).alias("reduction_percent"), base.alias("baseline_tokens"), out.alias("compressed_tokens"), F.round(F.greatest(base - out, F.lit(0)) / base, 6).alias("token_reduction"))


_PRESETS_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', {k}, {w}::DOUBLE, {s}::DOUBLE)" for i, (n, (k, w, s)) in enumerate(terms.PRESETS.items())) + ") pr(m, preset, max_items, relevance_weight, sigma)"


@query("k3_presets", f"""
WITH {Z_SQL}, n AS (SELECT video_id, count(*) AS n, arg_min(t, (-z, t, id)) AS peak FROM zs GROUP BY video_id)
SELECT n.video_id, preset, max_items, relevance_weight, sigma, least(n, max_items)::BIGINT AS budget, (SELECT count(*) FROM zs WHERE zs.video_id = n.video_id AND abs(zs.t - peak) <= sigma * {SCALE}::DOUBLE) AS near_peak
FROM n JOIN {_PRESETS_SQL} ON n.video_id % 3 = m""")
def k3(spark, sf_dir):
    """Presets in turn by video: what each allows of its pool, and how much lies within its kernel of the strongest moment."""
    p = spark.createDataFrame([(i, n, *v) for i, (n, v) in enumerate(terms.PRESETS.items())], "m int, preset string, max_items int, relevance_weight double, sigma double")
    z = scored(spark, sf_dir)
    n = z.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("z")).alias("z"), "t", "id"))["t"].alias("peak"))
    n = n.join(F.broadcast(p), F.col("video_id") % 3 == F.col("m"))
    near = z.join(n, "video_id").groupBy("video_id").agg(F.count_if(F.abs(F.col("t") - F.col("peak")) <= F.col("sigma") * SCALE).alias("near_peak"))
    return n.join(near, "video_id").select("video_id", "preset", "max_items", "relevance_weight", "sigma", F.least("n", F.col("max_items").cast("long")).alias("budget"), "near_peak")


@query("k6_scene_budget", f"""
WITH {Z_SQL},
  v AS (SELECT *, modality = 'visual' AND segment_id IS NOT NULL AS scene FROM boosted),
  g AS (SELECT video_id, count(DISTINCT segment_id) FILTER (WHERE scene) AS scenes, least(count(*) FILTER (WHERE scene), greatest(1, 12 - least(2, count(*) FILTER (WHERE modality = 'audio')))) AS budget FROM v GROUP BY video_id),
  f AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment_id ORDER BY z DESC, relevance DESC, t, id) AS first, max(z) OVER (PARTITION BY video_id, segment_id) AS mz, max(relevance) OVER (PARTITION BY video_id, segment_id) AS mr FROM v WHERE scene),
  h AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY mz DESC, mr DESC, segment_id) AS place FROM f WHERE first = 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY z DESC, relevance DESC, t, id) AS place FROM f WHERE first > 1)
SELECT video_id, id FROM v WHERE NOT scene
UNION ALL SELECT v.video_id, id FROM v JOIN g ON v.video_id = g.video_id WHERE scene AND scenes < 2
UNION ALL SELECT h.video_id, id FROM h JOIN g ON h.video_id = g.video_id WHERE scenes >= 2 AND place <= budget
UNION ALL SELECT r.video_id, id FROM r JOIN g ON r.video_id = g.video_id WHERE scenes >= 2 AND place <= budget - least(scenes, budget)""")
def k6(spark, sf_dir):
    return selection.scene_budget(anchored(spark, sf_dir), GROUP, 12).select("video_id", "id")


@query("k5_escalation", _mmr("aggressive", "boosted") + """,
  s AS (SELECT r.video_id, r.modality, b.relevance, b.anchor_score FROM rec r JOIN boosted b ON r.video_id = b.video_id AND r.id = b.id WHERE rn = 1),
  a AS (SELECT video_id, count(*) AS n, max(relevance) AS best, count(*) FILTER (WHERE modality = 'audio') AS na, count(*) FILTER (WHERE modality = 'visual') AS nv, bool_or(modality = 'visual' AND anchor_score >= 0.25) AS anchored FROM s GROUP BY video_id),
  e AS (SELECT video_id, CASE WHEN best < 0.15 THEN 'low best relevance at aggressive budget' WHEN anchored AND na < 2 AND nv >= 2 THEN 'aggressive budget underrepresented source audio evidence' WHEN n > 1 AND (na = 0 OR nv = 0) THEN 'aggressive budget selected only one modality' END AS reason FROM a)
SELECT video_id, reason IS NOT NULL AS expand, reason FROM e""")
def k5(spark, sf_dir):
    b = anchored(spark, sf_dir)
    s = selection.mmr_select(b, GROUP, "aggressive", SCALE, drop_neighbors=False).select("video_id", "id")
    rows = s.join(b, ["video_id", "id"]).withColumn("text", F.lit("")).withColumn("asset", F.lit(None).cast("string"))
    return selection.escalation(rows, GROUP)


def _ladder_sql() -> str:
    stages = [f"""{mmr_sql("boosted", k, lam, sigma * SCALE, "l" + name[0])},
  l{name[0]}s AS (SELECT r.video_id, r.modality, b.relevance, b.anchor_score FROM l{name[0]}rec r JOIN boosted b ON r.video_id = b.video_id AND r.id = b.id WHERE rn = 1),
  l{name[0]}e AS (SELECT video_id, CASE WHEN max(relevance) < 0.15 THEN 'low best relevance at aggressive budget'
      WHEN bool_or(modality = 'visual' AND anchor_score >= 0.25) AND count(*) FILTER (WHERE modality = 'audio') < 2 AND count(*) FILTER (WHERE modality = 'visual') >= 2 THEN 'aggressive budget underrepresented source audio evidence'
      WHEN count(*) > 1 AND count(DISTINCT modality) = 1 THEN 'aggressive budget selected only one modality' END AS reason FROM l{name[0]}s GROUP BY video_id)""" for name, (k, lam, sigma) in terms.PRESETS.items()]
    return f"""WITH RECURSIVE {Z_SQL}, {", ".join(stages)},
  w AS (SELECT a.video_id, a.reason AS first, b.reason AS second FROM lae a JOIN lbe b ON a.video_id = b.video_id)
SELECT r.video_id, id, rank, 'aggressive' AS preset, []::VARCHAR[] AS reasons FROM larec r JOIN w ON r.video_id = w.video_id WHERE rn = 1 AND first IS NULL
UNION ALL SELECT r.video_id, id, rank, 'balanced', [first] FROM lbrec r JOIN w ON r.video_id = w.video_id WHERE rn = 1 AND first IS NOT NULL AND second IS NULL
UNION ALL SELECT r.video_id, id, rank, 'conservative', [first, second] FROM lcrec r JOIN w ON r.video_id = w.video_id WHERE rn = 1 AND first IS NOT NULL AND second IS NOT NULL"""


@query("k4_budget_ladder", _ladder_sql())
def k4(spark, sf_dir):
    """Each video at the first of the three budgets whose evidence does not look weak, else at the largest."""
    b = anchored(spark, sf_dir)
    out, weak = None, b.select("video_id").distinct().withColumn("reasons", F.array().cast("array<string>"))
    for i, preset in enumerate(terms.PRESETS):
        s = selection.mmr_select(b.join(weak.select("video_id"), "video_id"), GROUP, preset, SCALE, drop_neighbors=False)
        e = selection.escalation(s.select("video_id", "id").join(b, ["video_id", "id"]).withColumn("text", F.lit("")).withColumn("asset", F.lit(None).cast("string")), GROUP)
        judged = weak.join(e, "video_id")
        done = judged.filter(~F.col("expand")) if i < 2 else judged
        part = s.join(done.select("video_id", "reasons"), "video_id").select("video_id", "id", "rank", F.lit(preset).alias("preset"), "reasons")
        out = part if out is None else out.unionByName(part)
        weak = judged.filter("expand").select("video_id", F.array_append("reasons", F.col("reason")).alias("reasons"))
    return out


@query("k7_score_topk", f"WITH {EVENT_CANDIDATES_SQL} SELECT video_id, id, rank FROM (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY coalesce(saliency, -1) DESC, t, id DESC) AS rank FROM cand) WHERE rank <= 12")
def k7(spark, sf_dir):
    return selection.top_k(event_candidates(spark, sf_dir), GROUP, 12, [F.coalesce("saliency", F.lit(-1.0)).desc(), F.col("t"), F.col("id").desc()]).select("video_id", "id", "rank")


@query("k8_uniform", f"""
WITH {EVENT_CANDIDATES_SQL},
  o AS (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM cand)
SELECT video_id, id, (j + 1)::INT AS rank FROM o JOIN range(0, 12) r(j) ON o.i = CASE WHEN n <= 12 THEN j ELSE round_even(j * ((n - 1) / 11.0::DOUBLE), 0) END""")
def k8(spark, sf_dir):
    return selection.uniform(event_candidates(spark, sf_dir), GROUP, 12, ["t", "id"]).select("video_id", "id", "rank")


@query("k9_uniform_paths", """
WITH o AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT DISTINCT label, vec_id FROM o JOIN range(0, 8) r(j) ON o.i = CASE WHEN n <= 8 THEN j ELSE round_even(j * ((n - 1) / 7.0::DOUBLE), 0) END""")
def k9(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id")
    return selection.uniform(e, ["label"], 8, ["vec_id"]).select("label", "vec_id")


@query("k20_split_budget", f"""
WITH RECURSIVE {Z_SQL}, sp AS (SELECT video_id || '/' || modality AS video_id, id, t, modality, z, NULL::DOUBLE AS anchor_t FROM zs), {mmr_sql("sp", 6, 0.72, 14 * SCALE)}
SELECT split_part(video_id, '/', 1)::BIGINT AS video_id, modality, id, rank, round(mmr, 6) AS mmr FROM rec WHERE rn = 1""")
def k20(spark, sf_dir):
    """An even split: half the balanced budget within each modality."""
    k, lam, sigma = terms.PRESETS["balanced"]
    p = selection.pools(selection.reachable(scored(spark, sf_dir).withColumn("m", F.col("modality")), ["video_id", "m"], k // 2, lam), ["video_id", "m"])
    out = selection.unfolded(p, selection.mmr_expression(str(k // 2), f"{lam}D", f"{sigma * SCALE}D", False), "video_id")
    return out.select("video_id", "modality", "id", "rank", F.round("mmr", 6).alias("mmr"))


@query("k20_intent_split", f"""
WITH RECURSIVE {Z_SQL}, sp AS (SELECT video_id || '/' || modality AS video_id, id, t, modality, z, NULL::DOUBLE AS anchor_t FROM zs), {mmr_sql("sp", 8, 0.72, 14 * SCALE)},
r AS (SELECT split_part(video_id, '/', 1)::BIGINT AS v, modality, id, rank, mmr FROM rec WHERE rn = 1)
SELECT v AS video_id, modality, id, rank, round(mmr, 6) AS mmr FROM r WHERE rank <= CASE v % 3 WHEN 0 THEN CASE modality WHEN 'visual' THEN 4 ELSE 8 END WHEN 1 THEN CASE modality WHEN 'visual' THEN 8 ELSE 4 END ELSE 6 END""")
def k20_intent(spark, sf_dir):
    """The balanced budget leaning to what the question asks for (intents go round by video): a third, two thirds or
    half of it for visuals, the rest for audio, each chosen within its modality."""
    k, lam, sigma = terms.PRESETS["balanced"]
    intents = F.element_at(F.array(F.lit("speech_semantic"), F.lit("visual_object_action"), F.lit("mixed_av")), (F.col("video_id") % 3 + 1).cast("int"))
    p = selection.pools(selection.reachable(scored(spark, sf_dir).withColumn("m", F.col("modality")), ["video_id", "m"], k, lam), ["video_id", "m"])
    p = p.withColumn("k", selection.split_budget(k, intents, F.col("m")))
    out = selection.unfolded(p, selection.mmr_expression("k", f"{lam}D", f"{sigma * SCALE}D", False), "video_id")
    return out.select("video_id", "modality", "id", "rank", F.round("mmr", 6).alias("mmr"))


@query("k9_window_subset", f"""
WITH {EVENT_CANDIDATES_SQL}, o AS (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM cand WHERE modality = 'audio')
SELECT DISTINCT video_id, id FROM o JOIN range(0, 5) r(j) ON o.i = CASE WHEN n <= 5 THEN j ELSE round_even(j * ((n - 1) / 4.0::DOUBLE), 0) END""")
def k9_windows(spark, sf_dir):
    """Five audio windows of each video to transcribe, evenly spread."""
    a = event_candidates(spark, sf_dir).filter("modality = 'audio'")
    return selection.uniform(a, GROUP, 5, ["t", "id"]).select("video_id", "id").distinct()


@query("w3_rank_within_group", f"WITH {EVENT_CANDIDATES_SQL} SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY t, id)::INT AS evidence_rank FROM cand")
def w3(spark, sf_dir):
    return event_candidates(spark, sf_dir).select("video_id", "id", F.row_number().over(W.partitionBy("video_id").orderBy("t", "id")).alias("evidence_rank"))


@query("w4_percentile_rank", f"WITH {EVENT_CANDIDATES_SQL} SELECT video_id, id, round(cume_dist() OVER (PARTITION BY video_id, modality ORDER BY saliency), 6) AS pct FROM cand")
def w4(spark, sf_dir):
    return event_candidates(spark, sf_dir).select("video_id", "id", F.round(F.cume_dist().over(W.partitionBy("video_id", "modality").orderBy("saliency")), 6).alias("pct"))


@query("w5_modal_dominance", f"""
WITH {EVENT_CANDIDATES_SQL},
  p AS (SELECT video_id, modality, saliency, cume_dist() OVER (PARTITION BY modality ORDER BY saliency) AS pct FROM cand),
  g AS (SELECT video_id, max(pct) FILTER (WHERE modality = 'audio') AS a, max(pct) FILTER (WHERE modality = 'visual') AS v FROM p GROUP BY video_id)
SELECT video_id, CASE WHEN v >= 0.8 AND a <= 0.5 THEN 'vision-dominant' WHEN a >= 0.8 AND v <= 0.5 THEN 'audio-dominant' WHEN a >= 0.8 OR v >= 0.8 THEN 'consensus' ELSE 'weak' END AS dominance FROM g""")
def w5(spark, sf_dir):
    """One score high and the other low, one or both high, or neither."""
    p = scoring.spread_cume_dist(event_candidates(spark, sf_dir), "modality", "saliency", "pct")
    g = p.groupBy("video_id").agg(F.max(F.when(F.col("modality") == "audio", F.col("pct"))).alias("a"), F.max(F.when(F.col("modality") == "visual", F.col("pct"))).alias("v"))
    d = F.when((F.col("v") >= 0.8) & (F.col("a") <= 0.5), "vision-dominant").when((F.col("a") >= 0.8) & (F.col("v") <= 0.5), "audio-dominant").when((F.col("a") >= 0.8) | (F.col("v") >= 0.8), "consensus").otherwise("weak")
    return g.select("video_id", d.alias("dominance"))


@query("w7_thirds", f"""
WITH {EVENT_CANDIDATES_SQL}, b AS (SELECT *, min(t) OVER w AS lo, greatest(max(t) OVER w - min(t) OVER w, 1.0::DOUBLE) AS span FROM cand WHERE modality = 'audio' WINDOW w AS (PARTITION BY video_id)),
  c AS (SELECT *, least(floor((t - lo) / span * 3), 2)::INT AS third FROM b)
SELECT video_id, third, arg_min(id, (-saliency, t, id)) AS id FROM c GROUP BY video_id, third""")
def w7(spark, sf_dir):
    w = W.partitionBy("video_id")
    c = event_candidates(spark, sf_dir).filter("modality = 'audio'").withColumn("lo", F.min("t").over(w)).withColumn("span", F.greatest(F.max("t").over(w) - F.min("t").over(w), F.lit(1.0)))
    c = c.withColumn("third", F.least(F.floor((F.col("t") - F.col("lo")) / F.col("span") * 3), F.lit(2)).cast("int"))
    return c.groupBy("video_id", "third").agg(F.min_by("id", F.struct(-F.col("saliency"), "t", "id")).alias("id"))


@query("x1_union_last_wins", f"""
WITH {EVENT_CANDIDATES_SQL}, u AS (SELECT video_id, id, 'budget' AS origin, 0 AS p FROM cand WHERE saliency > 50 UNION ALL SELECT video_id, id, 'forced' AS origin, 1 AS p FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, id) AS rn FROM cand) WHERE rn = 1)
SELECT video_id, id, arg_max(origin, p) AS origin FROM u GROUP BY video_id, id""")
def x1(spark, sf_dir):
    c = event_candidates(spark, sf_dir)
    forced = selection.top_k(c, GROUP, 1, ["t", "id"]).select("video_id", "id", F.lit("forced").alias("origin"), F.lit(1).alias("p"))
    u = c.filter("saliency > 50").select("video_id", "id", F.lit("budget").alias("origin"), F.lit(0).alias("p")).unionByName(forced)
    return u.groupBy("video_id", "id").agg(F.max_by("origin", "p").alias("origin"))


@query("x2_modality_union", f"WITH {EVENT_CANDIDATES_SQL} SELECT video_id, count(*) AS n, count(DISTINCT modality) AS modalities FROM cand GROUP BY video_id")
def x2(spark, sf_dir):
    c = event_candidates(spark, sf_dir)
    u = c.filter("modality = 'visual'").unionByName(c.filter("modality = 'audio'"))
    return u.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("modality").alias("modalities"))
