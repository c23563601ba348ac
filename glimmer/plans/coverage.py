"""Queries: rules that keep some kind of evidence in a selection, and chains of operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import selection
from ..registry import query
from ..functions import terms
from ..functions.terms import MAX_DISPLAY_MOMENTS, NEAR_DUPLICATE_TRANSCRIPT, WHY_ANSWER_TERMS
from ..sources.tables import EVENT_CANDIDATES_SQL, event_candidates, sql_jaccard, sql_list, sql_tokens
from .evidence import SUPPORT_SQL, first_fit_sql, supported
from .moments import LEX_SQL, REACH, lexical
from .selecting import SCALE, Z_SQL, _mmr, mmr_sql, scored

G = ["video_id"]


def with_quota(chosen, pool, modality: str, least: int, budget: int):
    """Chosen rows (id, modality, z, mmr, t) with ``least`` of a modality: the best of the pool by z come in, the
    weakest others by mmr go out while the budget is exceeded.

    Closed form of the loop: how many are missing is known beforehand, so the first of what may come in and of what may
    go out suffice. A group's choice and its best rows, as many as could be needed, meet as two short arrays. Rows
    without a group leave by ``is not null``, which the join infers for the other side, so that both are dealt once."""
    best = F.row_number().over(W.partitionBy(*G).orderBy(F.desc("z"), "t", "id"))
    top = pool.filter(F.col("modality") == modality).withColumn("r", best).filter(F.col("r") <= least + budget)
    top = top.groupBy(*G).agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("top"))
    sel = chosen.filter("video_id is not null").groupBy(*G).agg(F.collect_list(F.struct("id", "modality", "mmr", "rank")).alias("sel"))
    rows = sel.join(top, G, "left").withColumn("top", F.expr("coalesce(filter(top, x -> not exists(sel, y -> y.id = x.id)), array())"))
    rows = rows.withColumn("came", F.expr(f"slice(top, 1, greatest({least} - size(filter(sel, y -> y.modality = '{modality}')), 0))"))
    weakest = f"array_sort(transform(filter(sel, y -> y.modality <> '{modality}'), y -> struct(y.mmr is null, y.mmr, -y.rank as back)))"
    rows = rows.withColumn("gone", F.expr(f"slice({weakest}, 1, greatest(size(sel) + size(came) - {budget}, 0)).back"))
    ids = F.expr("concat(transform(filter(sel, y -> not array_contains(gone, -y.rank)), y -> y.id), transform(came, x -> x.id))")
    return rows.select(*G, F.explode_outer(ids).alias("id")).filter("id is not null")


QUOTA_SQL = """
  ch AS (SELECT video_id, id, modality, mmr, rank FROM rec WHERE rn = 1), nn AS (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE modality = '{m}') AS m FROM ch GROUP BY video_id),
  cm AS (SELECT * FROM (SELECT z.video_id, z.id, nn.m, row_number() OVER (PARTITION BY z.video_id ORDER BY z.z DESC, z.t, z.id) AS r FROM zs z JOIN nn ON z.video_id = nn.video_id WHERE z.modality = '{m}' AND (z.video_id, z.id) NOT IN (SELECT (video_id, id) FROM ch)) WHERE r <= greatest({least} - m, 0)),
  kk AS (SELECT video_id, count(*) AS k FROM cm GROUP BY video_id),
  go AS (SELECT ch.*, row_number() OVER (PARTITION BY ch.video_id, modality = '{m}' ORDER BY mmr, rank DESC) AS r, n + coalesce(k, 0) - {budget} AS over FROM ch JOIN nn ON ch.video_id = nn.video_id LEFT JOIN kk ON ch.video_id = kk.video_id)
SELECT video_id, id FROM go WHERE modality = '{m}' OR r > greatest(over, 0) UNION ALL SELECT video_id, id FROM cm"""


@query("k17_visual_quota", _mmr("aggressive") + "," + QUOTA_SQL.format(m="visual", least=4, budget=6))
def k17(spark, sf_dir):
    """At least four visuals among six."""
    z = scored(spark, sf_dir)
    chosen = selection.mmr_select(z, G, "aggressive", SCALE, drop_neighbors=False)
    return with_quota(chosen, z, "visual", 4, 6)


@query("k15_audio_quota", _mmr("balanced") + "," + QUOTA_SQL.format(m="audio", least=4, budget=12))
def k15(spark, sf_dir):
    """At least min(4, max(2, k // 3)) audio rows for the balanced budget of k = 12."""
    z = scored(spark, sf_dir)
    return with_quota(selection.mmr_select(z, G, "balanced", SCALE, drop_neighbors=False), z, "audio", 4, 12)


@query("k18_evict_weakest", _mmr("aggressive") + """
SELECT video_id, id FROM (SELECT video_id, id, modality, count(*) OVER w AS n, row_number() OVER (PARTITION BY video_id, modality ORDER BY mmr, rank DESC) AS r FROM rec WHERE rn = 1 WINDOW w AS (PARTITION BY video_id, modality)) WHERE modality = 'audio' AND n > 1 AND r = 1""")
def k18(spark, sf_dir):
    """The weakest audio pick of each selection that may go while one stays."""
    s = selection.mmr_select(scored(spark, sf_dir), G, "aggressive", SCALE, drop_neighbors=False).filter("modality = 'audio'")
    w = W.partitionBy("video_id")
    return s.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("mmr", F.desc("rank")))).filter("n > 1 and r = 1").select("video_id", "id")


@query("k14_temporal_pair_kept", f"""
WITH {EVENT_CANDIDATES_SQL}, p AS (SELECT a.video_id, a.id AS anchor, b.id AS target, row_number() OVER (PARTITION BY a.video_id ORDER BY round(a.saliency / 500 + 1 - b.saliency / 500 + 0.25::DOUBLE * (1 - (b.t - a.t) / {REACH}::DOUBLE), 9) DESC, b.t - a.t, a.t, a.id, b.id) AS r
  FROM cand a JOIN cand b ON a.video_id = b.video_id AND b.t > a.t AND b.t <= a.t + {REACH}::DOUBLE)
SELECT video_id, unnest([anchor, target]) AS id FROM p WHERE r = 1""")
def k14(spark, sf_dir):
    """The best directed pair of each video is forced into its pool."""
    from ..operators.moments import best_directed_pair

    c = event_candidates(spark, sf_dir).select("video_id", "id", "t", (F.col("saliency") / 500).alias("a"), (1 - F.col("saliency") / 500).alias("b"))
    return best_directed_pair(c, G, "a", "b", REACH).select("video_id", F.explode(F.array("anchor", "target")).alias("id"))


@query("k22_ranked_cards", f"""
WITH {LEX_SQL}, s AS (SELECT video_id, id, t, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, c))::DOUBLE / len(q) END + greatest(relevance, 0) * 0.25 + CASE WHEN modality = 'audio' THEN 0.08 ELSE 0 END, 9)::DOUBLE AS likely FROM lex),
b AS (SELECT *, max(likely) OVER w AS best, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY video_id)), d AS (SELECT *, best > 0 AND likely >= best * 0.55 AS direct FROM b),
e AS (SELECT *, min(t) FILTER (WHERE direct) OVER (PARTITION BY video_id) AS earliest FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY video_id, t < earliest AND earliest - t <= 30 ORDER BY earliest - t, likely DESC, id) AS pr FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id, n <= 3 OR direct OR (t < earliest AND earliest - t <= 30 AND pr = 1) ORDER BY likely DESC, t, id) AS r FROM p)
SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY t, id)::INT AS place, round(likely, 6) AS likelihood FROM k WHERE n <= 3 OR (r <= 3 AND (direct OR (t < earliest AND earliest - t <= 30 AND pr = 1)))""")
def k22(spark, sf_dir):
    """Cards likely to hold the answer and the nearest one before them, three at most, in time order; of three cards or
    fewer all."""
    q = T.tokens("query")
    likely = F.coalesce(F.try_divide(F.size(F.array_intersect(q, "toks")), F.size(q)), F.lit(0.0)) + F.greatest("relevance", F.lit(0.0)) * 0.25 + F.when(F.col("modality") == "audio", 0.08).otherwise(0.0)
    return selection.rank_cards(lexical(spark, sf_dir).withColumn("likelihood", F.round(likely, 9)), G).select("video_id", "id", "place", F.round("likelihood", 6).alias("likelihood"))


WHY_SQL = "CASE WHEN starts_with(lower(trim(query)), 'why') THEN 0.25::DOUBLE * len(list_filter(" + sql_list(WHY_ANSWER_TERMS) + ", lambda k: contains(lower(text), k))) ELSE 0.0::DOUBLE END"


@query("k23_display_moments", f"""
WITH RECURSIVE {LEX_SQL}, an AS (SELECT conv_id AS video_id, arg_max(text, (turn, text)) AS answer FROM conversations GROUP BY conv_id),
m AS (SELECT lex.video_id, id, t, c, relevance, round(relevance + {WHY_SQL} + {sql_jaccard(sql_tokens('answer'), 'c')} + least(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) / 80.0::DOUBLE, 1.0) * 0.1::DOUBLE, 9) AS quality
  FROM lex JOIN an ON lex.video_id = an.video_id WHERE modality = 'audio' AND trim(text) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY quality DESC, relevance DESC, t, id) AS i FROM m),
r AS (SELECT DISTINCT video_id, 0::BIGINT AS i, []::STRUCT(t DOUBLE, id VARCHAR, c VARCHAR[])[] AS acc FROM o UNION ALL
  SELECT r.video_id, o.i, CASE WHEN len(acc) >= 6 OR len(list_filter(acc, lambda y: {sql_jaccard('o.c', 'y.c')} >= 0.35)) > 0 THEN acc ELSE list_append(acc, {{'t': o.t, 'id': o.id, 'c': o.c}}) END FROM r JOIN o ON r.video_id = o.video_id AND o.i = r.i + 1),
l AS (SELECT video_id, unnest(arg_max(acc, i)) AS m FROM r GROUP BY video_id)
SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY m.t, m.id) - 1)::INT AS place, m.id AS id FROM l""")
def k23(spark, sf_dir):
    """Spoken moments by relevance, answer overlap, why terms and length; near duplicates of a shown one dropped, six at
    most, shown in time order: an ordered fold."""
    answer = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy(F.col("conv_id").alias("video_id")).agg(F.max_by("text", F.struct("turn", "text")).alias("answer"))
    rows = lexical(spark, sf_dir).filter((F.col("modality") == "audio") & (F.btrim("text") != "")).join(answer, "video_id")
    why = F.when(F.startswith(F.lower(F.btrim("query")), F.lit("why")), 0.25 * T.count_contained("text", WHY_ANSWER_TERMS)).otherwise(0.0)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    quality = F.round(F.col("relevance") + why + T.jaccard(T.tokens("answer"), F.col("toks")) + F.least(words / F.lit(80.0), F.lit(1.0)) * 0.1, 9)
    rows = rows.select("video_id", (-quality).alias("q"), (-F.col("relevance")).alias("r"), "t", "id", "toks")
    pool = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("q", "r", "t", "id", "toks"))).alias("pool"))
    fold = f"""aggregate(pool, cast(array() as array<struct<t: double, id: string, toks: array<string>>>), (acc, x) ->
        if(size(acc) >= {MAX_DISPLAY_MOMENTS} or exists(acc, y -> size(array_intersect(x.toks, y.toks)) / greatest(1, size(array_union(x.toks, y.toks))) >= {NEAR_DUPLICATE_TRANSCRIPT}D), acc, array_append(acc, named_struct('t', x.t, 'id', x.id, 'toks', x.toks))))"""
    return pool.select("video_id", F.posexplode_outer(F.array_sort(F.expr(fold))).alias("place", "m")).filter("m is not null").select("video_id", "place", "m.id")


@query("j4_claimed_context_audio", f"""
WITH RECURSIVE {EVENT_CANDIDATES_SQL}, v AS (SELECT * FROM (SELECT video_id, id, t, row_number() OVER (PARTITION BY video_id ORDER BY saliency DESC, t, id) AS r FROM cand WHERE modality = 'visual') WHERE r <= 8),
a AS (SELECT video_id, list({{'t': t, 'id': id}}) AS audio FROM cand WHERE modality = 'audio' GROUP BY video_id),
c AS (SELECT DISTINCT v.video_id, 0::BIGINT AS r, []::VARCHAR[] AS claimed, NULL::VARCHAR AS visual, NULL::VARCHAR AS audio_id FROM v JOIN a ON v.video_id = a.video_id UNION ALL
  SELECT video_id, r, CASE WHEN best IS NULL THEN claimed ELSE list_append(claimed, best) END, id, best FROM (
    SELECT c.video_id, v.r, claimed, v.id, list_sort(list_transform(list_filter(a.audio, lambda x: abs(x.t - v.t) <= {30 * SCALE}::DOUBLE AND NOT list_contains(claimed, x.id)), lambda x: {{'gap': abs(x.t - v.t), 'id': x.id}}))[1].id AS best
    FROM c JOIN v ON c.video_id = v.video_id AND v.r = c.r + 1 JOIN a ON c.video_id = a.video_id))
SELECT video_id, visual, audio_id AS audio FROM c WHERE audio_id IS NOT NULL""")
def j4(spark, sf_dir):
    """The eight most salient visuals in turn claim their nearest unclaimed audio within the radius: an ordered fold."""
    c = event_candidates(spark, sf_dir)
    v = selection.top_k(c.filter("modality = 'visual'"), G, 8, [F.desc("saliency"), F.col("t"), F.col("id")], "r").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("r", "id", "t"))).alias("vs"))
    a = c.filter("modality = 'audio'").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("audio"))
    fold = f"""aggregate(vs, cast(array() as array<struct<visual: string, audio: string>>), (acc, v) -> transform(
        array(array_min(transform(filter(audio, a -> abs(a.t - v.t) <= {30 * SCALE}D and not exists(acc, c -> c.audio = a.id)), a -> named_struct('gap', abs(a.t - v.t), 'id', a.id)))),
        b -> if(b is null, acc, array_append(acc, named_struct('visual', v.id, 'audio', b.id))))[0])"""
    return v.join(a, "video_id").select("video_id", F.expr(f"inline_outer({fold})")).filter("visual is not null")


@query("j12_nearby_audio", f"""
WITH {Z_SQL}, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY z DESC, t, id) AS r FROM zs WHERE modality = 'visual') WHERE r <= 3),
g AS (SELECT a.video_id, a.id, a.z, a.t, min(abs(a.t - v.t)) AS gap FROM zs a JOIN v ON a.video_id = v.video_id WHERE a.modality = 'audio' GROUP BY a.video_id, a.id, a.z, a.t),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(gap, 6), z DESC, t, id) AS place FROM g)
SELECT video_id, id, place::INT AS place, round(gap, 6) AS gap FROM r WHERE place <= 2""")
def j12(spark, sf_dir):
    """Audio by its distance to the nearest of three chosen visuals."""
    z = scored(spark, sf_dir)
    v = selection.top_k(z.filter("modality = 'visual'"), G, 3, [F.desc("z"), F.col("t"), F.col("id")], "r").groupBy("video_id").agg(F.collect_list("t").alias("vt"))
    a = z.filter("modality = 'audio'").join(v, "video_id").withColumn("gap", F.array_min(F.transform("vt", lambda x: F.abs(F.col("t") - x))))
    a = a.withColumn("place", F.row_number().over(W.partitionBy("video_id").orderBy(F.round("gap", 6), F.desc("z"), "t", "id")))
    return a.filter("place <= 2").select("video_id", "id", "place", F.round("gap", 6).alias("gap"))


@query("a5_raw_reduction", _mmr("balanced") + ", n AS (SELECT user_id AS video_id, count(*) AS raw FROM events GROUP BY user_id), s AS (SELECT video_id, count(*) AS k FROM rec WHERE rn = 1 GROUP BY video_id) SELECT s.video_id, raw * 3 AS raw, round((1 - k::DOUBLE / (raw * 3)) * 100, 6) AS raw_reduction FROM s JOIN n ON s.video_id = n.video_id")
def a5(spark, sf_dir):
    """Reduction against a pool three times as large, before fusion."""
    raw = event_candidates(spark, sf_dir).groupBy("video_id").agg((F.count(F.lit(1)) * 3).alias("raw"))
    s = selection.mmr_select(scored(spark, sf_dir), G, "balanced", SCALE, drop_neighbors=False).groupBy("video_id").agg(F.count(F.lit(1)).alias("k"))
    return s.join(raw, "video_id").select("video_id", "raw", F.round((1 - F.col("k") / F.col("raw")) * 100, 6).alias("raw_reduction"))


@query("e8_audio_retained", f"""
WITH {SUPPORT_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, relevance DESC, t, id) AS r FROM e6), k AS (SELECT * FROM t WHERE r <= 2),
m AS (SELECT video_id FROM k GROUP BY video_id HAVING count(*) FILTER (WHERE modality = 'audio') = 0), b AS (SELECT video_id, arg_min(id, (-score, -relevance, -z, t, id)) AS id FROM e6 WHERE modality = 'audio' AND NOT ocr GROUP BY video_id)
SELECT k.video_id, k.id FROM k LEFT JOIN m ON k.video_id = m.video_id WHERE m.video_id IS NULL OR r < 2 OR k.video_id NOT IN (SELECT video_id FROM b) UNION ALL SELECT b.video_id, b.id FROM b JOIN m ON b.video_id = m.video_id""")
def e8(spark, sf_dir):
    """Two best rows a conversation; if neither is audio, the best audio takes the second's place."""
    s = supported(spark, sf_dir)
    k = selection.top_k(s, G, 2, [F.desc("score"), F.desc("relevance"), F.col("t"), F.col("id")], "r")
    missing = k.groupBy("video_id").agg(F.count_if(F.col("modality") == "audio").alias("m")).filter("m = 0").select("video_id")
    spoken = s.filter((F.col("modality") == "audio") & ~F.startswith(F.lower("text"), F.lit("on-screen text near")))
    best = spoken.join(missing, "video_id", "left_semi").groupBy("video_id").agg(F.min_by("id", F.struct(-F.col("score"), -F.col("relevance"), -F.col("z"), F.col("t"), F.col("id"))).alias("id"))
    gone = best.select("video_id", F.lit(2).alias("r"))
    return k.join(gone, ["video_id", "r"], "left_anti").select("video_id", "id").unionByName(best)


@query("e15_finalisation", f"""
WITH RECURSIVE {SUPPORT_SQL}, pb AS (SELECT *, least(4, CASE WHEN vt OR ms THEN 2 ELSE 4 END, CASE WHEN tq THEN 1 ELSE 4 END) AS hi, CASE WHEN vt OR ms OR tq THEN 1 ELSE 3 END AS lo, count(*) OVER (PARTITION BY video_id) AS n,
  row_number() OVER (PARTITION BY video_id ORDER BY score DESC, relevance DESC, t, id) AS pr, score >= greatest(0.05::DOUBLE, max(score) OVER (PARTITION BY video_id) * 0.55::DOUBLE) AS ok FROM e6),
pk AS (SELECT *, least(count(*) FILTER (WHERE ok) OVER (PARTITION BY video_id), hi) AS k FROM pb), kept AS (SELECT * FROM pk WHERE n <= hi OR CASE WHEN k < lo THEN pr <= lo ELSE pr <= k END),
{first_fit_sql('kept')}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, cluster ORDER BY score DESC, relevance DESC, t, id) AS br FROM fit) WHERE br = 1),
g AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS bn, count(*) FILTER (WHERE grounding_label <> 'weak') OVER (PARTITION BY video_id) AS bg FROM b)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, id) AS rank, id, grounding_label FROM g WHERE bn <= 1 OR bg < 1 OR bg = bn OR grounding_label <> 'weak'""")
def e15(spark, sf_dir):
    """Support, pruning to the answer, first-fit consolidation, grounding: one chain."""
    s = E.prune(supported(spark, sf_dir), G).withColumn("toks", T.tokens("text")).withColumn("stop", F.col("start") + 30.0)
    c = E.first_fit(s.select("video_id", "id", "t", "modality", "start", "stop", "toks", "score", "relevance", "grounding_label"), G, ["t", "id"], E.ALIKE)
    c = c.withColumn("r", F.row_number().over(W.partitionBy("video_id", "cluster").orderBy(F.desc("score"), F.desc("relevance"), "t", "id"))).filter("r = 1")
    return E.drop_weak(c, G).withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy("t", "id"))).select("video_id", "rank", "id", "grounding_label")


def _mode_sql(name: str, k: int) -> str:
    return f"SELECT '{name}' AS mode, video_id, id FROM (SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY saliency DESC, t, id DESC) AS r FROM cand{'' if name == 'score_topk' else f" WHERE modality = '{name}'"}) WHERE r <= {k}"


@query("v9_ablation_modes", f"WITH {EVENT_CANDIDATES_SQL}, a AS ({_mode_sql('score_topk', 12)} UNION ALL {_mode_sql('visual', 12)} UNION ALL {_mode_sql('audio', 12)}) SELECT mode, count(*) AS n, count(DISTINCT video_id) AS videos FROM a GROUP BY mode")
def v9(spark, sf_dir):
    """The same pool under several modes of selection and one budget."""
    c = event_candidates(spark, sf_dir)
    order = [F.desc("saliency"), F.col("t"), F.desc("id")]
    parts = [selection.top_k(p, G, 12, order, "r").select(F.lit(m).alias("mode"), "video_id", "id") for m, p in (("score_topk", c), ("visual", c.filter("modality = 'visual'")), ("audio", c.filter("modality = 'audio'")))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video_id").alias("videos"))


def _k2_sql() -> str:
    k, lam, sigma = terms.PRESETS["balanced"]
    return f"""WITH RECURSIVE {LEX_SQL}, kz AS (SELECT video_id, id, t, modality, c, NULL::DOUBLE AS anchor_t, CASE WHEN min(relevance) OVER w = max(relevance) OVER w THEN 0.0::DOUBLE ELSE round((relevance - avg(relevance) OVER w) / stddev_pop(relevance) OVER w, 9) + 0.0 END AS z FROM lex WINDOW w AS (PARTITION BY video_id, modality)),
{mmr_sql("kz", k, lam, sigma * 5.0, drop=True)} SELECT video_id, id, rank, round(mmr, 6) AS mmr FROM rec WHERE rn = 1"""


@query("k2_redundant_neighbors", _k2_sql())
def k2(spark, sf_dir):
    """Selection over turns, where audio neighbours with much the same words are dropped after each pick."""
    from ..operators.scoring import standardize

    z = standardize(lexical(spark, sf_dir), "relevance", ["video_id", "modality"])
    return selection.mmr_select(z, G, "balanced", 5.0).select("video_id", "id", "rank", F.round("mmr", 6).alias("mmr"))


@query("r5_daily_cap_refund", """
WITH RECURSIVE e AS (SELECT user_id, ts::DATE AS day, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, day, 0::BIGINT AS i, 0::BIGINT AS n FROM (SELECT DISTINCT user_id, day FROM e) UNION ALL SELECT r.user_id, r.day, e.i, CASE WHEN e.event_type = 'error' THEN greatest(r.n - 1, 0) WHEN r.n < 2 THEN r.n + 1 ELSE r.n END FROM r JOIN e ON r.user_id = e.user_id AND r.day = e.day AND e.i = r.i + 1)
SELECT user_id, day, arg_max(n, i)::INT AS count FROM r GROUP BY user_id, day""")
def r5(spark, sf_dir):
    """A keyed counter with a cap of two a day and refunds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("es"))
    step = lambda n, x: F.when(x["event_type"] == "error", F.greatest(n - 1, F.lit(0))).when(n < 2, n + 1).otherwise(n)
    return e.select("user_id", "day", F.aggregate("es", F.lit(0), step).alias("count"))
