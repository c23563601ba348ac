"""Queries: evaluation and statistics. Labels are cases, events measured stages, orders and line items reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.terms import ADVICE
from ..operators import statistics as S
from ..operators.rates import filled
from ..registry import query
from ..sources.tables import EVENT_CANDIDATES_SQL, event_candidates, table
from .selecting import SCALE

K7_SQL = f"{EVENT_CANDIDATES_SQL}, sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY saliency DESC, t, id DESC) AS r FROM cand) WHERE r <= 12)"


def _selected(spark, sf_dir):
    from ..operators.selection import top_k

    return top_k(event_candidates(spark, sf_dir), ["video_id"], 12, [F.desc("saliency"), F.col("t"), F.desc("id")], "r")


@query("v1_point_hit_rate", f"""
WITH {K7_SQL}, e AS (SELECT DISTINCT video_id, k * 500000.0::DOUBLE AS due FROM cand, range(0, 5) r(k)), h AS (SELECT e.video_id, due, coalesce(bool_or(abs(s.t - due) <= {20 * SCALE}::DOUBLE), false) AS hit FROM e LEFT JOIN sel s ON e.video_id = s.video_id GROUP BY e.video_id, due)
SELECT video_id, round(avg(hit::INT), 6) AS hit_rate FROM h GROUP BY video_id""")
def v1(spark, sf_dir):
    s = _selected(spark, sf_dir).select("video_id", "t")
    e = event_candidates(spark, sf_dir).select("video_id").distinct().withColumn("at", F.explode(F.array(*[F.lit(k * 500000.0) for k in range(5)])))
    h = e.join(s, "video_id", "left").groupBy("video_id", "at").agg(F.coalesce(F.bool_or(F.abs(F.col("t") - F.col("at")) <= 20 * SCALE), F.lit(False)).alias("hit"))
    return h.groupBy("video_id").agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


@query("v2_range_hit_rate", f"""
WITH {K7_SQL}, v AS (SELECT DISTINCT video_id FROM cand), e AS (SELECT video_id, k * 400000.0::DOUBLE AS a, k * 400000.0::DOUBLE + 90000 AS b FROM v, range(0, 4) r(k) WHERE video_id % 3 <> 0),
h AS (SELECT e.video_id, a, coalesce(bool_or(s.t <= b + 10 AND a <= s.t + 3600 + 10), false) AS hit FROM e LEFT JOIN sel s ON e.video_id = s.video_id GROUP BY e.video_id, a)
SELECT v.video_id, round(coalesce(avg(hit::INT), 1.0), 6) AS hit_rate FROM v LEFT JOIN h ON v.video_id = h.video_id GROUP BY v.video_id""")
def v2(spark, sf_dir):
    """1 where nothing is expected."""
    v = event_candidates(spark, sf_dir).select("video_id").distinct()
    e = v.filter("video_id % 3 <> 0").withColumn("a", F.explode(F.array(*[F.lit(k * 400000.0) for k in range(4)]))).withColumn("b", F.col("a") + 90000)
    h = e.join(_selected(spark, sf_dir).select("video_id", "t"), "video_id", "left").groupBy("video_id", "a").agg(F.coalesce(F.bool_or((F.col("t") <= F.col("b") + 10) & (F.col("a") <= F.col("t") + 3610)), F.lit(False)).alias("hit"))
    return v.join(h, "video_id", "left").groupBy("video_id").agg(F.round(F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(1.0)), 6).alias("hit_rate"))


@query("v3_reduction", f"WITH {K7_SQL}, a AS (SELECT video_id, count(*) AS n FROM cand GROUP BY video_id), b AS (SELECT video_id, count(*) AS k, count(*) FILTER (WHERE modality = 'visual') AS v FROM sel GROUP BY video_id) SELECT a.video_id, round((1 - k::DOUBLE / n) * 100, 6) AS reduction, v AS visual, k - v AS audio FROM a JOIN b ON a.video_id = b.video_id")
def v3(spark, sf_dir):
    a = event_candidates(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    b = _selected(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("modality") == "visual").alias("visual"))
    return a.join(b, "video_id").select("video_id", F.round((1 - F.col("k") / F.col("n")) * 100, 6).alias("reduction"), "visual", (F.col("k") - F.col("visual")).alias("audio"))


@query("v4_selected_ranges", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 100 END AS cs, CASE WHEN l_linenumber % 3 = 0 THEN l_tax * 100 END AS ce, CASE WHEN l_linenumber % 3 <> 2 THEN l_quantity END AS ss, CASE WHEN l_linenumber % 3 <> 2 THEN l_quantity + 5 END AS se, l_extendedprice AS t FROM lineitem),
a AS (SELECT *, coalesce(nullif(cs, 0), ss) AS qa, coalesce(nullif(ce, 0), se) AS qb, coalesce(cs, ss) AS ra, coalesce(ce, se) AS rb FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN qa IS NULL OR qb IS NULL THEN t ELSE least(qa, qb) END, 6) AS quality_start, round(CASE WHEN qa IS NULL OR qb IS NULL THEN t ELSE greatest(qa, qb) END, 6) AS quality_end, round(CASE WHEN ra IS NULL OR rb IS NULL THEN t ELSE least(ra, rb) END, 6) AS regression_start FROM a""")
def v4(spark, sf_dir):
    """Clip, else scene, else moment; one reading takes a bound of 0 for missing, the other does not."""
    line = F.col("l_linenumber") % 3
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(line == 0, F.col("l_discount") * 100).alias("cs"), F.when(line == 0, F.col("l_tax") * 100).alias("ce"), F.when(line != 2, F.col("l_quantity")).alias("ss"), F.when(line != 2, F.col("l_quantity") + 5).alias("se"), F.col("l_extendedprice").alias("t"))
    zero = F.lit(0.0)
    qa, qb, ra, rb = F.coalesce(F.nullif("cs", zero), "ss"), F.coalesce(F.nullif("ce", zero), "se"), F.coalesce("cs", "ss"), F.coalesce("ce", "se")
    pick = lambda a, b, f: F.round(F.when(a.isNull() | b.isNull(), F.col("t")).otherwise(f(a, b)), 6)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", pick(qa, qb, F.least).alias("quality_start"), pick(qa, qb, F.greatest).alias("quality_end"), pick(ra, rb, F.least).alias("regression_start"))


CASES_SQL = """
  cs AS (SELECT l.doc_id, quality, toxic, d.source, d.lang, length(d.text) AS n, quality * 0.6::DOUBLE + (l.doc_id % 5) / 10.0::DOUBLE AS recall, 1 - toxic * 0.7::DOUBLE AS relevance, (l.doc_id % 11) / 10.0::DOUBLE AS hits, 100 - least(length(d.text), 4000) / 80.0::DOUBLE AS reduction, (l.doc_id % 7)::INT AS n_selected FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
  fl AS (SELECT *, list_filter([CASE WHEN recall < 0.5 THEN 'answer_grounding' END, CASE WHEN relevance < 0.5 THEN 'evidence_retrieval' END, CASE WHEN hits < 0.3 THEN 'temporal_localization' END, CASE WHEN reduction < 60 THEN 'compression_budget' END, CASE WHEN n_selected > 5 THEN 'evidence_pruning' END], lambda x: x IS NOT NULL) AS failures FROM cs)"""


def cases(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    c = d.select("doc_id", "quality", "toxic", "source", "lang", F.length("text").alias("n"), (F.col("quality") * 0.6 + (F.col("doc_id") % 5) / 10.0).alias("recall"), (1 - F.col("toxic") * 0.7).alias("relevance"), ((F.col("doc_id") % 11) / 10.0).alias("hits"), (100 - F.least(F.length("text"), F.lit(4000)) / 80.0).alias("reduction"), (F.col("doc_id") % 7).cast("int").alias("n_selected"))
    rules = [("answer_grounding", F.col("recall") < 0.5), ("evidence_retrieval", F.col("relevance") < 0.5), ("temporal_localization", F.col("hits") < 0.3), ("compression_budget", F.col("reduction") < 60), ("evidence_pruning", F.col("n_selected") > 5)]
    return c.withColumn("failures", F.array_compact(F.array(*[F.when(k, F.lit(n)) for n, k in rules])))


@query("v6_case_failures", f"WITH {CASES_SQL} SELECT doc_id, list_sort(failures) AS failures, CASE " + " ".join("WHEN " + " AND ".join(f"list_contains(failures, '{n}')" for n in ns) + f" THEN '{a}'" for ns, a in ADVICE) + " END AS advice FROM fl")
def v6(spark, sf_dir):
    c = cases(spark, sf_dir)
    advice = None
    for names, text in ADVICE:
        cond = F.lit(True)
        for n in names:
            cond = cond & F.array_contains("failures", n)
        advice = F.when(cond, text) if advice is None else advice.when(cond, text)
    return c.select("doc_id", F.array_sort("failures").alias("failures"), advice.alias("advice"))


@query("v5_relevance_rates", f"WITH {CASES_SQL} SELECT source, round(avg((recall >= 0.5 OR hits >= 0.5)::INT), 6) AS relevance_rate, round(avg((relevance >= 0.5)::INT), 6) AS grounded_rate FROM cs GROUP BY source")
def v5(spark, sf_dir):
    c = cases(spark, sf_dir)
    return c.groupBy("source").agg(F.round(F.avg(((F.col("recall") >= 0.5) | (F.col("hits") >= 0.5)).cast("int")), 6).alias("relevance_rate"), F.round(F.avg((F.col("relevance") >= 0.5).cast("int")), 6).alias("grounded_rate"))


@query("v7_regression_gates", f"WITH {CASES_SQL} SELECT doc_id, recall >= 0.5 AND hits >= 0.3 AND n_selected <= 5 AND quality = 1 AS passed FROM cs")
def v7(spark, sf_dir):
    return cases(spark, sf_dir).select("doc_id", ((F.col("recall") >= 0.5) & (F.col("hits") >= 0.3) & (F.col("n_selected") <= 5) & (F.col("quality") == 1)).alias("passed"))


SUMMARY = "count(*) AS cases, count(*) FILTER (WHERE len(failures) = 0) AS passed, round(avg((len(failures) = 0)::INT), 6) AS pass_rate, round(avg(recall), 6) AS recall, round(avg(relevance), 6) AS relevance, round(avg(hits), 6) AS hits, round(avg(reduction), 6) AS reduction"


def summary():
    ok = F.size("failures") == 0
    return [F.count(F.lit(1)).alias("cases"), F.count_if(ok).alias("passed"), F.round(F.avg(ok.cast("int")), 6).alias("pass_rate"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "relevance", "hits", "reduction")]]


@query("a8_quality_summary", f"WITH {CASES_SQL} SELECT {SUMMARY} FROM fl")
def a8(spark, sf_dir):
    return cases(spark, sf_dir).agg(*summary())


@query("a8_failure_counts", f"WITH {CASES_SQL} SELECT f AS category, count(*) AS n FROM (SELECT unnest(failures) AS f FROM fl) GROUP BY f")
def a8_counts(spark, sf_dir):
    return cases(spark, sf_dir).select(F.explode("failures").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("a8_rollup", f"WITH {CASES_SQL} SELECT lang, source, {SUMMARY} FROM fl GROUP BY ROLLUP (lang, source)")
def a8_rollup(spark, sf_dir):
    """An extension: the summary rolled up over (language, source)."""
    return cases(spark, sf_dir).rollup("lang", "source").agg(*summary())


@query("a9_variant_summary", f"WITH {CASES_SQL} SELECT source, count(*) AS n, round(avg(CASE WHEN toxic = 0 THEN recall END), 6) AS judged_recall, round(avg(reduction), 6) AS reduction FROM cs GROUP BY source")
def a9(spark, sf_dir):
    """Null where no row of a variant was judged."""
    return cases(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("toxic") == 0, F.col("recall"))), 6).alias("judged_recall"), F.round(F.avg("reduction"), 6).alias("reduction"))


@query("a12_acceptance_gates", f"""
WITH {CASES_SQL}, s AS (SELECT {SUMMARY} FROM fl), g AS (SELECT 'cases' AS gate, cases::DOUBLE AS actual, 100.0::DOUBLE AS required, true AS at_least FROM s UNION ALL SELECT 'pass_rate', pass_rate, 0.5, true FROM s UNION ALL SELECT 'recall', recall, 0.4, true FROM s UNION ALL SELECT 'failures', (cases - passed)::DOUBLE, 100, false FROM s)
SELECT gate, actual, required, CASE WHEN at_least THEN actual >= required ELSE actual <= required END AS passed, bool_and(CASE WHEN at_least THEN actual >= required ELSE actual <= required END) OVER () AS all_passed FROM g""")
def a12(spark, sf_dir):
    s = cases(spark, sf_dir).agg(*summary())
    gates = F.array(*[F.struct(F.lit(n).alias("gate"), a.cast("double").alias("actual"), F.lit(r).alias("required"), F.lit(up).alias("up")) for n, a, r, up in (("cases", F.col("cases"), 100.0, True), ("pass_rate", F.col("pass_rate"), 0.5, True), ("recall", F.col("recall"), 0.4, True), ("failures", F.col("cases") - F.col("passed"), 100.0, False))])
    g = s.select(F.inline(gates)).withColumn("passed", F.when(F.col("up"), F.col("actual") >= F.col("required")).otherwise(F.col("actual") <= F.col("required")))
    return g.withColumn("all_passed", F.bool_and("passed").over(W.partitionBy())).drop("up")


@query("a13_suite_coverage", f"WITH {CASES_SQL} SELECT 'lang' AS kind, lang AS name, count(*) AS n, count(DISTINCT source) AS videos FROM cs GROUP BY lang UNION ALL SELECT 'source', source, count(*), count(DISTINCT lang) FROM cs GROUP BY source")
def a13(spark, sf_dir):
    c = cases(spark, sf_dir)
    part = lambda k, o: c.groupBy(F.col(k).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(o).alias("videos")).select(F.lit(k).alias("kind"), "name", "n", "videos")
    return part("lang", "source").unionByName(part("source", "lang"))


@query("a14_deficit_plan", f"WITH {CASES_SQL}, w(lang, required) AS (VALUES ('en', 300), ('fr', 50), ('de', 60), ('es', 70), ('xx', 5)), k AS (SELECT lang, count(*) AS n FROM cs GROUP BY lang) SELECT w.lang, coalesce(n, 0) AS n, greatest(0, required - coalesce(n, 0)) AS deficit FROM w LEFT JOIN k ON w.lang = k.lang")
def a14(spark, sf_dir):
    w = spark.createDataFrame([("en", 300), ("fr", 50), ("de", 60), ("es", 70), ("xx", 5)], "lang string, required int")
    k = cases(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return w.join(k, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(0), F.col("required") - F.coalesce("n", F.lit(0))).alias("deficit"))


@query("a15_measured_cost", """
WITH e AS (SELECT *, event_type || '-' || (user_id % 4) AS cond, value < 5 AS oom FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY cond, oom ORDER BY ts, event_id) AS r FROM e),
a AS (SELECT cond, count(*) AS n, count(*) FILTER (WHERE oom) AS n_oom, count(*) FILTER (WHERE NOT oom AND r > 1) AS n_used, median(value) FILTER (WHERE NOT oom AND r > 1) AS med, avg(value) FILTER (WHERE NOT oom AND r > 1) AS mean, max(value) AS reserved FROM o GROUP BY cond)
SELECT cond, n, n_oom, n_used, round(med, 6) AS med, round(mean, 4) AS mean, reserved, round((SELECT med FROM a WHERE cond = 'view-0') / med, 2) AS speedup FROM a""")
def a15(spark, sf_dir):
    """Per condition: the first success is a warm-up; medians against the baseline's. The first is a minimum and the medians
    are selected by rank, so no condition's rows are sorted in one task."""
    e = table(spark, sf_dir, "events").withColumn("cond", F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string"))).withColumn("oom", F.col("value") < 5)
    first = e.filter("not oom").groupBy("cond").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first"))
    e = e.join(first, "cond", "left").withColumn("used", F.when(~F.col("oom") & (F.col("event_id") != F.col("first")), F.col("value")))
    a = e.groupBy("cond").agg(F.count(F.lit(1)).alias("n"), F.count_if("oom").alias("n_oom"), F.count("used").alias("n_used"), F.round(F.avg("used"), 4).alias("mean"), F.max("value").alias("reserved"))
    a = a.join(S.percentiles(e, ["cond"], "used", {"med0": 0.5}, True), "cond", "left")
    base = a.filter("cond = 'view-0'").select(F.col("med0").alias("base"))
    return a.crossJoin(F.broadcast(base)).select("cond", "n", "n_oom", "n_used", F.round("med0", 6).alias("med"), "mean", "reserved", F.round(F.col("base") / F.col("med0"), 2).alias("speedup"))


@query("w8_warmup_drop", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events WHERE event_type <> 'error') WHERE r > 3")
def w8(spark, sf_dir):
    """The first three of each type are known from what is least in each task; the others are not sorted."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    first = e.select("event_type", "ts", "event_id").withColumn("r", F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id"))).filter("r <= 3")
    return e.join(first.select("event_type", "event_id"), ["event_type", "event_id"], "left_anti").select("event_id", "event_type")


@query("a16_nearest_rank", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY event_type")
def a16(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = S.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, False)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")).join(p, "event_type", "left").select("event_type", "n", "p50", "p95", "p99", "most")


@query("a18_percentile", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type")
def a18(spark, sf_dir):
    p = S.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"low": 0.025, "high": 0.975}, True)
    return p.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("a17_error_budget", "SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg((event_type = 'error')::INT), 6) AS rate, avg((event_type = 'error')::INT) <= 0.01 AS within_budget FROM events GROUP BY user_id")
def a17(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(bad).alias("failed"), F.round(F.avg(bad.cast("int")), 6).alias("rate"), (F.avg(bad.cast("int")) <= 0.01).alias("within_budget"))


@query("a19_load_summary", """
WITH l AS (SELECT event_type AS mode, ts::DATE AS day, count(*) AS n, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type, ts::DATE)
SELECT mode, count(*) AS levels, round(max(n) / 86400.0::DOUBLE, 9) AS peak_rate, min(day) FILTER (WHERE p95 > 100) AS breaking_point FROM l GROUP BY mode""")
def a19(spark, sf_dir):
    l = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))
    return l.groupBy("mode").agg(F.count(F.lit(1)).alias("levels"), F.round(F.max("n") / F.lit(86400.0), 9).alias("peak_rate"), F.min(F.when(F.col("p95") > 100, F.col("day"))).alias("breaking_point"))


def encoder_gflops(n, d: int, depth: int, ratio: float):
    """Forward pass of a transformer encoder on n tokens: 2 * multiply-accumulates."""
    return 2 * depth * (4 * n * d * d + 2 * n * n * d + 2 * ratio * n * d * d) / 1e9


@query("a20_encoder_cost", """
WITH c AS (SELECT o_custkey, count(*)::DOUBLE AS frames, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS wins FROM orders GROUP BY o_custkey),
k AS (SELECT *, round(frames * (2 * 27 * (4 * 729.0::DOUBLE * 1152 * 1152 + 2 * 729.0::DOUBLE * 729 * 1152 + 2 * 3.74::DOUBLE * 729 * 1152 * 1152) / 1e9::DOUBLE), 2) AS vision, round(wins * (2 * 32 * (4 * 1500.0::DOUBLE * 1280 * 1280 + 2 * 1500.0::DOUBLE * 1500 * 1280 + 2 * 4.0::DOUBLE * 1500 * 1280 * 1280) / 1e9::DOUBLE), 2) AS audio, round_even(frames * 196 + wins * 750, 0)::BIGINT AS tokens FROM c)
SELECT o_custkey, vision, audio, tokens, round((1 - tokens::DOUBLE / (SELECT max(tokens) FROM k)) * 100, 1) AS token_saving FROM k""")
def a20(spark, sf_dir):
    """Closed-form cost of 196-token frames and 750-token windows; savings against the dearest."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("frames"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("wins"))
    k = c.select("o_custkey", F.round(F.col("frames") * encoder_gflops(729.0, 1152, 27, 3.74), 2).alias("vision"), F.round(F.col("wins") * encoder_gflops(1500.0, 1280, 32, 4.0), 2).alias("audio"), F.rint(F.col("frames") * 196 + F.col("wins") * 750).cast("long").alias("tokens"))
    base = k.agg(F.max("tokens").alias("base"))
    return k.crossJoin(F.broadcast(base)).select("o_custkey", "vision", "audio", "tokens", F.round((1 - F.col("tokens") / F.col("base")) * 100, 1).alias("token_saving"))


@query("a27_speech_cost", """
WITH c AS (SELECT conv_id, count(*) AS w, sum(len(regexp_extract_all(text, '\\S+'))) AS words FROM conversations GROUP BY conv_id)
SELECT conv_id, w, words, round((w * (2 * 3000.0::DOUBLE * 80 * 384 * 3 + 2 * 1500.0::DOUBLE * 384 * 384 * 3 + 4 * (24 * 1500.0::DOUBLE * 384 * 384 + 4 * 1500.0::DOUBLE * 1500 * 384) + 4 * 4 * 1500.0::DOUBLE * 384 * 384)
  + (1.4::DOUBLE * words + 4 * w) * 5 * (4 * (8 * 384.0::DOUBLE * 384 + 4 * 384.0::DOUBLE * 384 + 16 * 384.0::DOUBLE * 384 + 4 * 1500.0::DOUBLE * 384 + 256 * 384.0::DOUBLE) + 2 * 384.0::DOUBLE * 51865)) / 1e9::DOUBLE, 3) AS gflops FROM c""")
def a27(spark, sf_dir):
    """Encoder and decoder cost of the smallest speech model (width 384, four layers each) with a beam of five."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("w"), F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("words"))
    d, layers, context, mels, vocabulary, beam = 384.0, 4, 1500.0, 80, 51865, 5
    window = 2 * 3000.0 * mels * d * 3 + 2 * context * d * d * 3 + layers * (24 * context * d * d + 4 * context * context * d) + layers * 4 * context * d * d
    token = layers * (28 * d * d + 4 * context * d + 256 * d) + 2 * d * vocabulary
    return c.withColumn("gflops", F.round((F.col("w") * window + (1.4 * F.col("words") + 4 * F.col("w")) * beam * token) / 1e9, 3))


@query("a26_rate_fit", """
WITH p AS (SELECT l_returnflag, l_quantity AS x, l_discount * 100 AS y, l_extendedprice AS c FROM lineitem),
s AS (SELECT l_returnflag, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * c) AS xc, sum(y * c) AS yc FROM p GROUP BY l_returnflag)
SELECT l_returnflag, round((xc * yy - yc * xy) / (xx * yy - xy * xy), 4) AS per_x, round((yc * xx - xc * xy) / (xx * yy - xy * xy), 4) AS per_y FROM s""")
def a26(spark, sf_dir):
    """Least squares without intercept on two predictors, by the normal equations."""
    p = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("c"))
    s = p.groupBy("l_returnflag").agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy", "xc", "yc")])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return s.select("l_returnflag", F.round((F.col("xc") * F.col("yy") - F.col("yc") * F.col("xy")) / det, 4).alias("per_x"), F.round((F.col("yc") * F.col("xx") - F.col("xc") * F.col("xy")) / det, 4).alias("per_y"))


_STAGES_SQL = "SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag || '-' || (l_suppkey % 3) AS stage, l_quantity AS x, CASE WHEN l_suppkey % 3 = 0 THEN 2 * l_quantity ELSE l_discount * 100 END AS y, CASE WHEN l_linenumber <> 2 AND NOT (l_returnflag = 'R' AND l_suppkey % 3 = 2) THEN l_extendedprice END AS cost FROM lineitem"


@query("a26_predicted_costs", f"""
WITH r AS ({_STAGES_SQL}), m AS (SELECT * FROM r WHERE cost IS NOT NULL),
s AS (SELECT stage, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * cost) AS xc, sum(y * cost) AS yc, avg(cost / nullif(x, 0)) AS rate, avg(cost) AS mean FROM m GROUP BY stage),
f AS (SELECT *, xx * yy - xy * xy AS det FROM s)
SELECT r.stage, count(*) AS n, count(cost) AS n_known, round(sum(coalesce(cost, CASE WHEN det > 1e-9 * xx * yy THEN (xc * yy - yc * xy) / det * x + (yc * xx - xc * xy) / det * y END, rate * x, mean)), 2) AS spent FROM r LEFT JOIN f ON r.stage = f.stage GROUP BY r.stage""")
def a26_predicted(spark, sf_dir):
    """Costs of the stages of lines: fitted on two predictors where they tell two rates, by a mean rate where one is twice the
    other, and unknown for a stage that was never measured."""
    third, flag = F.col("l_suppkey") % 3, F.col("l_returnflag")
    r = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", flag, third.cast("string")).alias("stage"), F.col("l_quantity").alias("x"), F.when(third == 0, 2 * F.col("l_quantity")).otherwise(F.col("l_discount") * 100).alias("y"),
        F.when((F.col("l_linenumber") != 2) & ~((flag == "R") & (third == 2)), F.col("l_extendedprice")).alias("cost"),
    )
    out = filled(r, ["stage"], "x", "y", "cost")
    return out.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count("cost").alias("n_known"), F.round(F.sum("spent"), 2).alias("spent"))


@query("a21_video_stats", "SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) > 2000) AS long_ones, arg_min(lang, doc_id) AS domain FROM documents GROUP BY source")
def a21(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 2000).alias("long_ones"), F.min_by("lang", "doc_id").alias("domain"))


@query("x4_constrained_growth", """
WITH RECURSIVE v AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang <> 'en') AS b FROM documents GROUP BY source), o AS (SELECT *, row_number() OVER (ORDER BY a DESC, n DESC, source) AS i FROM v), t AS (SELECT max(i) AS m FROM o),
r AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS chosen, 0::BIGINT AS total, 0::BIGINT AS d UNION ALL
  SELECT o.i, CASE WHEN r.total < 300 AND (r.total = 0 OR abs(r.d + o.a - o.b) <= 60) THEN CASE WHEN r.chosen = '' THEN o.source ELSE r.chosen || ',' || o.source END ELSE r.chosen END, CASE WHEN r.total < 300 AND (r.total = 0 OR abs(r.d + o.a - o.b) <= 60) THEN r.total + o.n ELSE r.total END, CASE WHEN r.total < 300 AND (r.total = 0 OR abs(r.d + o.a - o.b) <= 60) THEN r.d + o.a - o.b ELSE r.d END FROM r JOIN o ON o.i = r.i + 1)
SELECT chosen, total FROM r JOIN t ON r.i = t.m""")
def x4(spark, sf_dir):
    """Sources are accepted in order unless they would tip the balance too far, until the target is met: a fold over
    one row a source."""
    en = F.col("lang") == "en"
    v = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(en).alias("a"), F.count_if(~en).alias("b"))
    pool = v.agg(F.array_sort(F.collect_list(F.struct((-F.col("a")).alias("ka"), (-F.col("n")).alias("kn"), "source", "n", (F.col("a") - F.col("b")).alias("d")))).alias("pool"))
    fold = """aggregate(pool, named_struct('chosen', cast(array() as array<string>), 'total', 0L, 'd', 0L), (s, x) ->
        if(s.total < 300 and (s.total = 0 or abs(s.d + x.d) <= 60), named_struct('chosen', array_append(s.chosen, x.source), 'total', s.total + x.n, 'd', s.d + x.d), s))"""
    return pool.select(F.expr(fold).alias("s")).select(F.array_join("s.chosen", ",").alias("chosen"), F.col("s.total").alias("total"))


@query("a22_marker_rates", "SELECT lang, round(avg(regexp_matches(text, '(?i)licensed')::INT), 6) AS licensed, round(avg(contains(text, '|')::INT), 6) AS tabular, count(*) AS n FROM documents GROUP BY lang")
def a22(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(F.col("text").rlike("(?i)licensed").cast("int")), 6).alias("licensed"), F.round(F.avg(F.contains("text", F.lit("|")).cast("int")), 6).alias("tabular"), F.count(F.lit(1)).alias("n"))


@query("a22_population_and_sample", """
WITH p AS (SELECT d.lang, length(d.text) AS n, l.doc_id IS NOT NULL AS kept FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, count(*) AS available, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS cut, round(avg(n), 6) AS population_mean, round(avg(n) FILTER (WHERE kept), 6) AS sample_mean FROM p GROUP BY lang""")
def a22_sample(spark, sf_dir):
    """What a sample (the labelled documents) keeps of each language, and both mean lengths."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("kept"))
    p = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n")).join(labels, "doc_id", "left")
    kept = F.col("kept").isNotNull()
    return p.groupBy("lang").agg(F.count(F.lit(1)).alias("available"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("cut"), F.round(F.avg("n"), 6).alias("population_mean"), F.round(F.avg(F.when(kept, F.col("n"))), 6).alias("sample_mean"))


@query("a22_value_counts", "SELECT lang, source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source")
def a22_counts(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 6))


@query("a23_best_by_key", """
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 10) / 10.0::DOUBLE END AS score, (o_orderkey % 7)::BIGINT AS red, o_totalprice AS latency FROM orders)
SELECT o_custkey, arg_max(o_orderkey, (coalesce(score, -1), red, -latency, o_orderkey)) AS best FROM r GROUP BY ROLLUP (o_custkey)""")
def a23(spark, sf_dir):
    k = F.col("o_orderkey")
    key = F.struct(F.coalesce(F.when(k % 4 != 0, (k % 10) / 10.0), F.lit(-1.0)), k % 7, -F.col("o_totalprice"), k)
    return table(spark, sf_dir, "orders").rollup("o_custkey").agg(F.max_by("o_orderkey", key).alias("best"))


@query("a25_split_manifest", r"SELECT CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'held_out' ELSE 'dev' END AS split, count(*) AS cases, count(DISTINCT source) AS videos, count(DISTINCT lang) AS categories, substr(sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)), 1, 16) AS fingerprint FROM documents GROUP BY 1")
def a25(spark, sf_dir):
    split = F.when(F.col("source").isin("src1", "src2", "src3"), "held_out").otherwise("dev").alias("split")
    ids = F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), "\n")
    return table(spark, sf_dir, "documents").groupBy(split).agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("source").alias("videos"), F.count_distinct("lang").alias("categories"), F.substring(F.sha2(ids, 256), 1, 16).alias("fingerprint"))


OUTCOMES_SQL = "oc AS (SELECT doc_id, quality::DOUBLE AS a, (1 - toxic)::DOUBLE AS b, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels)"
RESAMPLES = 10_000


def outcomes(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.lit("quality-clean").alias("pair"), "doc_id", F.col("quality").cast("double").alias("a"), (1 - F.col("toxic")).cast("double").alias("b")).withColumn("d", F.col("a") - F.col("b"))


def _interval_sql(x: str) -> str:
    return f"round(avg({x}), 6) AS {x}_mean, round(quantile_cont({x}, 0.025), 6) AS {x}_low, round(quantile_cont({x}, 0.975), 6) AS {x}_high"


@query("v10_paired_bootstrap", f"""
WITH {OUTCOMES_SQL}, h0 AS (SELECT r, n, (r * 1000003 + i) % 2147483648 AS h FROM oc, range(0, {RESAMPLES}) g(r)), h1 AS (SELECT r, n, (xor(h, h >> 16) * 73244475) % 2147483648 AS h FROM h0), h2 AS (SELECT r, n, (xor(h, h >> 16) * 73244475) % 2147483648 AS h FROM h1),
m AS (SELECT r, sum(oc.a) / any_value(oc.n) AS a, sum(oc.b) / any_value(oc.n) AS b, sum(oc.a - oc.b) / any_value(oc.n) AS d FROM h2 JOIN oc ON xor(h, h >> 16) % h2.n = oc.i GROUP BY r)
SELECT 'quality-clean' AS pair, {", ".join(_interval_sql(x) for x in "abd")}, (SELECT round(avg(a - b), 6) FROM oc) AS point, round(quantile_cont(d, 0.025), 6) >= -(SELECT round(sqrt(avg(b) * (1 - avg(b)) / count(*)), 6) FROM oc) AS non_inferior FROM m""")
def v10(spark, sf_dir):
    """Both conditions' and their difference's mean and interval over the same draws; not inferior if the difference's
    interval begins no lower than minus the second's standard error."""
    o = outcomes(spark, sf_dir)
    m = S.bootstrap(o, ["pair"], ["a", "b", "d"], "doc_id", RESAMPLES)
    ends = {x: F.percentile(x, F.array(F.lit(0.025), F.lit(0.975))) for x in "abd"}
    out = m.groupBy("pair").agg(*[c for x in "abd" for c in (F.round(F.avg(x), 6).alias(f"{x}_mean"), F.round(ends[x][0], 6).alias(f"{x}_low"), F.round(ends[x][1], 6).alias(f"{x}_high"))])
    p = F.avg("b")
    whole = o.groupBy("pair").agg(F.round(F.avg("d"), 6).alias("point"), F.round(F.sqrt(p * (1 - p) / F.count(F.lit(1))), 6).alias("se"))
    return out.join(whole, "pair").withColumn("non_inferior", F.col("d_low") >= -F.col("se")).drop("se")


@query("v11_standard_error", f"WITH {OUTCOMES_SQL} SELECT round(sqrt(avg(b) * (1 - avg(b)) / count(*)), 6) AS standard_error, round(avg((a = b)::INT), 6) AS agreement, count(*) AS n FROM oc")
def v11(spark, sf_dir):
    p = F.avg("b")
    return outcomes(spark, sf_dir).agg(F.round(F.sqrt(p * (1 - p) / F.count(F.lit(1))), 6).alias("standard_error"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("agreement"), F.count(F.lit(1)).alias("n"))


@query("v8_variant_runner", f"""
WITH {EVENT_CANDIDATES_SQL}, v(variant, k) AS (VALUES ('small', 4), ('medium', 8), ('large', 16)), r AS (SELECT video_id, id, t, saliency, row_number() OVER (PARTITION BY video_id ORDER BY saliency DESC, t, id) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM cand)
SELECT variant, count(*) AS selected, round(avg(saliency), 6) AS mean_score FROM r, v WHERE r <= k GROUP BY variant""")
def v8(spark, sf_dir):
    """Every example under every variant, in one job."""
    v = F.broadcast(spark.createDataFrame([("small", 4), ("medium", 8), ("large", 16)], "variant string, k int"))
    r = event_candidates(spark, sf_dir).withColumn("r", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("saliency"), "t", "id")))
    return r.join(v, F.col("r") <= F.col("k")).groupBy("variant").agg(F.count(F.lit(1)).alias("selected"), F.round(F.avg("saliency"), 6).alias("mean_score"))


@query("v12_artifact_audit", f"WITH {CASES_SQL} SELECT doc_id, list_filter([CASE WHEN n < 200 THEN 'too_short' END, CASE WHEN n_selected = 0 THEN 'no_evidence' END, CASE WHEN toxic = 1 THEN 'unsafe' END], lambda x: x IS NOT NULL) AS reasons, n >= 200 AND n_selected > 0 AND toxic = 0 AND quality = 0 AS candidate FROM cs")
def v12(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("n") < 200, F.lit("too_short")), F.when(F.col("n_selected") == 0, F.lit("no_evidence")), F.when(F.col("toxic") == 1, F.lit("unsafe"))))
    return cases(spark, sf_dir).select("doc_id", reasons.alias("reasons"), ((F.size(reasons) == 0) & (F.col("quality") == 0)).alias("candidate"))


@query("v13_refresh_queue", f"WITH {CASES_SQL} SELECT doc_id, 'refresh --id ' || doc_id || ' --source ' || source AS command FROM cs WHERE n > 500 AND toxic = 0 AND n_selected > 2")
def v13(spark, sf_dir):
    return cases(spark, sf_dir).filter("n > 500 and toxic = 0 and n_selected > 2").select("doc_id", F.concat(F.lit("refresh --id "), F.col("doc_id").cast("string"), F.lit(" --source "), F.col("source")).alias("command"))


@query("v14_query_proposals", f"WITH {CASES_SQL} SELECT lang AS category, doc_id, 'What is said in ' || source || '?' AS query FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY recall DESC, source, doc_id) AS r FROM cs WHERE quality = 1) WHERE r = 1")
def v14(spark, sf_dir):
    c = cases(spark, sf_dir).filter("quality = 1").withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("recall"), "source", "doc_id"))).filter("r = 1")
    return c.select(F.col("lang").alias("category"), "doc_id", F.concat(F.lit("What is said in "), F.col("source"), F.lit("?")).alias("query"))


@query("v16_downstream_accuracy", f"WITH {CASES_SQL}, c AS (SELECT 'whole' AS condition, quality AS ok, n // 4 AS tokens FROM cs UNION ALL SELECT 'selected', CASE WHEN recall >= 0.5 THEN 1 ELSE 0 END, n // 40 FROM cs) SELECT condition, round(avg(ok), 6) AS accuracy, sum(greatest(1, tokens))::BIGINT AS tokens FROM c GROUP BY condition")
def v16(spark, sf_dir):
    c = cases(spark, sf_dir)
    whole = c.select(F.lit("whole").alias("condition"), F.col("quality").alias("ok"), F.expr("n div 4").alias("tokens"))
    picked = c.select(F.lit("selected").alias("condition"), (F.col("recall") >= 0.5).cast("int").alias("ok"), F.expr("n div 40").alias("tokens"))
    return whole.unionByName(picked).groupBy("condition").agg(F.round(F.avg("ok"), 6).alias("accuracy"), F.sum(F.greatest(F.lit(1), F.col("tokens"))).alias("tokens"))


_REPLY_SQL = """CASE turn % 4 WHEN 0 THEN regexp_replace(text, '[{}]', '', 'g') || ' {"score": ' || (turn / 4.0 - 0.5) || ', "reason": "turn ' || turn || '"} tail' WHEN 1 THEN '{"reason": "none"}' ELSE regexp_replace(text, '[{}]', '', 'g') END"""


@query("v17_judge_verdict", f"""
WITH r AS (SELECT conv_id, turn, role, nullif(regexp_extract({_REPLY_SQL}, '(?s)\\{{.*\\}}'), '') AS j FROM conversations)
SELECT conv_id, turn, role, CASE WHEN json_extract_string(j, '$.score') IS NOT NULL THEN least(greatest(json_extract_string(j, '$.score')::DOUBLE, 0), 1) END AS score, json_extract_string(j, '$.reason') AS reason FROM r""")
def v17(spark, sf_dir):
    """The first JSON object of a judge's reply (here a turn's text, some with a verdict), its score clamped to [0, 1]."""
    bare = F.regexp_replace("text", "[{}]", "")
    verdict = F.format_string(' {"score": %s, "reason": "turn %d"} tail', (F.col("turn") / 4.0 - 0.5).cast("string"), F.col("turn"))
    reply = F.when(F.col("turn") % 4 == 0, F.concat(bare, verdict)).when(F.col("turn") % 4 == 1, F.lit('{"reason": "none"}')).otherwise(bare)
    j = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")), "score double, reason string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", j.alias("j"))
    return rows.select("conv_id", "turn", "role", F.when(F.col("j.score").isNotNull(), F.least(F.greatest(F.col("j.score"), F.lit(0.0)), F.lit(1.0))).alias("score"), F.col("j.reason").alias("reason"))


@query("v18_failure_analysis", f"WITH {CASES_SQL}, f AS (SELECT source, doc_id, len(failures) AS k, row_number() OVER (PARTITION BY source ORDER BY len(failures) DESC, doc_id) AS r FROM fl WHERE len(failures) > 0) SELECT source, list(doc_id ORDER BY k DESC, doc_id) AS worst FROM f WHERE r <= 3 GROUP BY source")
def v18(spark, sf_dir):
    c = cases(spark, sf_dir).filter(F.size("failures") > 0)
    top = c.withColumn("k", -F.size("failures")).withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("k", "doc_id"))).filter("r <= 3")
    return top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("k", "doc_id"))).alias("w")).select("source", F.col("w.doc_id").alias("worst"))


@query("w9_change_detection", "SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER w AS pt, lag(value > 50) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type IS DISTINCT FROM pt OR (value > 50) IS DISTINCT FROM pv")
def w9(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("high", F.col("value") > 50)
    e = e.withColumn("pt", F.lag("event_type").over(w)).withColumn("pv", F.lag("high").over(w))
    return e.filter(~F.col("event_type").eqNullSafe(F.col("pt")) | ~F.col("high").eqNullSafe(F.col("pv"))).select("event_id", "user_id")


@query("r1_rate_limit_batch", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::DOUBLE[] AS seen, NULL::DOUBLE AS wait FROM e UNION ALL
  SELECT user_id, i, event_id, CASE WHEN wait > 0 THEN seen ELSE list_append(seen, s) END, wait FROM (
    SELECT r.user_id, e.i, e.event_id, e.s, seen, greatest(CASE WHEN len(seen) >= 3 AND seen[len(seen) - 2] > e.s - 3600 THEN seen[len(seen) - 2] + 3600 - e.s ELSE 0 END, CASE WHEN len(seen) >= 10 AND seen[len(seen) - 9] > e.s - 86400 THEN seen[len(seen) - 9] + 86400 - e.s ELSE 0 END) AS wait
    FROM r JOIN e ON r.user_id = e.user_id AND e.i = r.i + 1))
SELECT user_id, event_id, CASE WHEN wait > 0 THEN greatest(1.0::DOUBLE, ceil(wait)) END AS wait FROM r WHERE i > 0""")
def r1(spark, sf_dir):
    """At most 3 events an hour and 10 a day for each user; refused events are not recorded (an ordered fold)."""
    from ..streaming.limits import decide

    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    return decide(e, "user_id", "s", "event_id", [(3, 3600.0), (10, 86400.0)])


@query("r6_concurrency_cap", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS a, epoch_us(ts) / 1e6::DOUBLE + value * 3600 AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::DOUBLE[] AS active, NULL::BOOLEAN AS admitted FROM e UNION ALL
  SELECT user_id, i, event_id, CASE WHEN len(now) < 2 THEN list_append(now, z) ELSE now END, len(now) < 2 FROM (SELECT r.user_id, e.i, e.event_id, e.z, list_filter(active, lambda x: x > e.a) AS now FROM r JOIN e ON r.user_id = e.user_id AND e.i = r.i + 1))
SELECT user_id, event_id, admitted FROM r WHERE i > 0""")
def r6(spark, sf_dir):
    """Two active jobs a user (a job lasts as many hours as its value); more are refused."""
    from ..streaming.limits import active_cap

    e = table(spark, sf_dir, "events").withColumn("a", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    return active_cap(e.withColumn("z", F.col("a") + F.col("value") * 3600), "user_id", "a", "z", "event_id")


@query("r2_limit_table", """
WITH l(kind, n, seconds) AS (VALUES ('general', 600, 60), ('ingest', 3, 3600), ('login', 5, 60), ('login', 20, 3600), ('query', 10, 60)),
e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'general' WHEN 'purchase' THEN 'ingest' ELSE 'login' END AS kind, epoch_us(ts) // 1000000 AS s FROM events),
w AS (SELECT user_id, e.kind, l.n, l.seconds, s // l.seconds AS w, count(*) AS used FROM e JOIN l ON e.kind = l.kind GROUP BY ALL)
SELECT user_id, kind, n AS count, seconds::DOUBLE AS seconds, max(used) AS most, max(used) >= n AS reached FROM w GROUP BY user_id, kind, n, seconds""")
def r2(spark, sf_dir):
    """Each user's use of each kind of request in the windows of its limits: the most in one, and whether a limit is reached."""
    from ..streaming.limits import LIMITS

    limits = spark.createDataFrame([(k, c, s) for k, ls in LIMITS.items() for c, s in ls], "kind string, count int, seconds double")
    kind = F.when(F.col("event_type") == "view", "query").when(F.col("event_type") == "click", "general").when(F.col("event_type") == "purchase", "ingest").otherwise("login")
    e = table(spark, sf_dir, "events").select("user_id", kind.alias("kind"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).join(F.broadcast(limits), "kind")
    w = e.groupBy("user_id", "kind", "count", "seconds", F.floor(F.col("s") / F.col("seconds")).alias("w")).agg(F.count(F.lit(1)).alias("used"))
    return w.groupBy("user_id", "kind", "count", "seconds").agg(F.max("used").alias("most"), (F.max("used") >= F.first("count")).alias("reached"))


@query("s3_heterogeneous_benchmark", """
WITH r AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text END AS q1, CASE WHEN turn % 2 = 1 THEN text ELSE ' ' END AS q2, CASE WHEN turn % 3 = 0 THEN turn::VARCHAR || '.5' ELSE 'n/a' END AS d FROM conversations)
SELECT conv_id, turn, role, trim(coalesce(nullif(trim(q1), ''), nullif(trim(q2), ''))) AS query, try_cast(d AS DOUBLE) AS duration FROM r""")
def s3(spark, sf_dir):
    """The first non-blank of several names; numbers may be strings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("q1"), F.when(F.col("turn") % 2 == 1, F.col("text")).otherwise(" ").alias("q2"), F.when(F.col("turn") % 3 == 0, F.concat(F.col("turn").cast("string"), F.lit(".5"))).otherwise("n/a").alias("d"))
    first = F.coalesce(F.nullif(F.trim("q1"), F.lit("")), F.nullif(F.trim("q2"), F.lit("")))
    return c.select("conv_id", "turn", "role", first.alias("query"), F.col("d").try_cast("double").alias("duration"))


@query("s5_readiness_audit", "SELECT d.doc_id, unnest(list_filter([CASE WHEN quality IS NULL THEN 'missing answer' END, CASE WHEN length(text) < 100 THEN 'missing video' END], lambda x: x IS NOT NULL)) AS issue FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def s5(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    issues = F.array_compact(F.array(F.when(F.col("quality").isNull(), F.lit("missing answer")), F.when(F.length("text") < 100, F.lit("missing video"))))
    return d.select("doc_id", F.explode(issues).alias("issue"))


@query("s11_outcome_sources", """
WITH w AS (SELECT doc_id, quality, toxic FROM labels), l AS (SELECT doc_id, 'a' AS condition, quality = 1 AS ok FROM w UNION ALL SELECT doc_id, 'b', toxic = 0 FROM w WHERE doc_id % 9 <> 0), n AS (SELECT doc_id FROM l GROUP BY doc_id HAVING count(DISTINCT condition) = 2)
SELECT condition, count(*) AS n, count(*) FILTER (WHERE ok) AS passed FROM l WHERE doc_id IN (SELECT doc_id FROM n) GROUP BY condition""")
def s11(spark, sf_dir):
    """Long outcomes restricted to the ids that every condition has."""
    w = table(spark, sf_dir, "labels")
    long = w.select("doc_id", F.lit("a").alias("condition"), (F.col("quality") == 1).alias("ok")).unionByName(w.filter("doc_id % 9 <> 0").select("doc_id", F.lit("b").alias("condition"), (F.col("toxic") == 0).alias("ok")))
    both = long.groupBy("doc_id").agg(F.count_distinct("condition").alias("k")).filter("k = 2").select("doc_id")
    return long.join(both, "doc_id", "left_semi").groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"))


@query("s11_wide_predictions", """
WITH w AS (SELECT doc_id, ' ' || lower(CASE quality WHEN 1 THEN 'Yes' ELSE 'No' END) AS gold, upper(CASE WHEN toxic = 0 THEN 'yes' ELSE 'no' END) AS plain, CASE WHEN quality = 1 THEN 'YES ' ELSE ' no' END AS chosen FROM labels)
SELECT condition, count(*) AS n, count(*) FILTER (WHERE upper(trim(answer)) = upper(trim(gold))) AS passed FROM w UNPIVOT (answer FOR condition IN (plain, chosen)) GROUP BY condition""")
def s11_wide(spark, sf_dir):
    """One row a question with every condition's answer and the right one; letters' case and blanks do not count."""
    good = F.col("quality") == 1
    w = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit(" "), F.lower(F.when(good, "Yes").otherwise("No"))).alias("gold"), F.upper(F.when(F.col("toxic") == 0, "yes").otherwise("no")).alias("plain"), F.when(good, "YES ").otherwise(" no").alias("chosen"))
    ok = F.upper(F.btrim("answer")) == F.upper(F.btrim("gold"))
    return w.unpivot(["doc_id", "gold"], ["plain", "chosen"], "condition", "answer").groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"))


@query("s11_nested_report", """
SELECT o.condition AS condition, count(*) AS n, count(*) FILTER (WHERE o.passed) AS passed FROM (SELECT unnest([{'condition': 'a', 'passed': quality = 1}, {'condition': 'b', 'passed': toxic = 0}]) AS o FROM labels) GROUP BY o.condition""")
def s11_nested(spark, sf_dir):
    """A report's cases with a map of outcomes by condition."""
    r = table(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("a"), F.struct((F.col("quality") == 1).alias("passed")), F.lit("b"), F.struct((F.col("toxic") == 0).alias("passed"))).alias("outcomes"))
    return r.select(F.explode("outcomes").alias("condition", "o")).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_if("o.passed").alias("passed"))


@query("s12_marked_pool", "SELECT doc_id, regexp_replace(substr(text, 1, 1), '[^A-Z]', '') AS initial, CASE WHEN regexp_matches(text, '(?i)licensed') THEN 'audio' WHEN contains(text, '|') THEN 'visual' ELSE 'unmarked' END AS bucket FROM documents WHERE length(text) > 300 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s12(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 300)
    dead = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    bucket = F.when(F.col("text").rlike("(?i)licensed"), "audio").when(F.contains("text", F.lit("|")), "visual").otherwise("unmarked")
    return d.join(dead, "doc_id", "left_anti").select("doc_id", F.regexp_replace(F.substring("text", 1, 1), "[^A-Z]", "").alias("initial"), bucket.alias("bucket"))
