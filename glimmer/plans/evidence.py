"""Queries: support, pruning, warnings and labels over ``conversations`` (turns are evidence, the last turn the answer)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as T
from ..operators import evidence as E
from ..operators.scoring import standardize
from ..registry import query
from ..sources.tables import sql_jaccard, sql_list, sql_tokens, sql_words, table
from .moments import LEX_SQL, lexical
from .textual import NOISY_TRANSCRIPT_SQL, SENTIMENT_STOP, SEVERITY_SQL, SQL_SENTENCES, requester_sql, sentences, sql_sentence_with

G = ["video_id"]
INTENTS = ["speech_semantic", "mixed_av", "visual_object_action"]


def selected(spark, sf_dir):
    """Turns as selected evidence: intents go round by conversation, every third visual carries on-screen text."""
    t = standardize(lexical(spark, sf_dir), "relevance", ["video_id", "modality"])
    answer = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.max_by("text", F.struct("turn", "text")).alias("answer"))
    t = t.join(answer, "video_id")
    ocr = (F.col("modality") == "visual") & (F.col("turn") % 3 == 1)
    t = t.withColumn("text", F.when(ocr, F.concat(F.lit("On-screen text near 1 seconds: "), F.col("text"))).otherwise(F.col("text")))
    t = t.withColumn("intent", F.element_at(F.array(*map(F.lit, INTENTS)), (F.col("video_id") % 3 + 1).cast("int")))
    t = t.withColumn("anchor_t", F.when((F.col("modality") == "visual") & (F.col("turn") % 2 == 1), F.col("t") - 30.0))
    return t.withColumn("anchor_score", F.when(F.col("anchor_t").isNotNull(), 0.3).otherwise(0.0)).drop("toks", "saliency")


SPOKEN_SQL = "(" + " OR ".join(f"contains(lq, ' {w} ')" for w in E.SPOKEN) + ")"
WRITTEN_SQL = "(" + " OR ".join(f"contains(lq, ' {w} ')" for w in E.WRITTEN) + ")"
SUPPORT_SQL = f"""{LEX_SQL},
  an AS (SELECT conv_id AS video_id, arg_max(text, (turn, text)) AS answer FROM conversations GROUP BY conv_id),
  z AS (SELECT *, CASE WHEN min(relevance) OVER w = max(relevance) OVER w THEN 0.0::DOUBLE ELSE round((relevance - avg(relevance) OVER w) / stddev_pop(relevance) OVER w, 9) END AS z FROM lex WINDOW w AS (PARTITION BY video_id, modality)),
  e0 AS (SELECT z.video_id, id, turn, modality, t, relevance, z, query, answer, {sql_list(INTENTS)}[z.video_id % 3 + 1] AS intent, CASE WHEN modality = 'visual' AND turn % 3 = 1 THEN 'On-screen text near 1 seconds: ' || text ELSE text END AS text,
    CASE WHEN modality = 'visual' AND turn % 2 = 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS anchor_score FROM z JOIN an ON z.video_id = an.video_id),
  e1 AS (SELECT *, {sql_tokens('text')} AS c1, {sql_tokens('query')} AS q1, {sql_tokens('answer')} AS a1, ' ' || lower(query) || ' ' AS lq, starts_with(lower(text), 'on-screen text near') AS ocr FROM e0),
  e2 AS (SELECT *, {sql_jaccard('a1', 'c1')} AS a, {sql_jaccard('q1', 'c1')} AS qs, intent = 'speech_semantic' OR (intent = 'mixed_av' AND {SPOKEN_SQL}) AS demote, {WRITTEN_SQL} AS vt,
    intent = 'speech_semantic' AND regexp_matches(lower(query), '(?:^|[\\s,;:])(what|why|how|when|where|who|which)\\s+') AS tq, intent = 'mixed_av' AND {SPOKEN_SQL} AS ms FROM e1),
  e3 AS (SELECT *, CASE WHEN modality = 'audio' AND NOT ocr THEN 0.7 * a + 0.3 * qs ELSE 0.0::DOUBLE END AS s_audio, CASE WHEN ocr THEN 0.65 * a + 0.35 * qs ELSE 0.0::DOUBLE END AS s_ocr,
    CASE WHEN modality <> 'visual' THEN 0.0::DOUBLE WHEN demote THEN least(qs, 0.04) WHEN vt THEN CASE WHEN ocr THEN least(qs, 0.2) ELSE 0.0 END
      ELSE least(greatest(relevance, z, qs, CASE WHEN ocr THEN qs + 0.05 ELSE qs END, CASE WHEN anchor_score > 0 THEN anchor_score * 0.5 ELSE qs END), 1.0) END AS s_visual FROM e2),
  e4 AS (SELECT *, CASE WHEN anchor_score <= 0 THEN 0.0::DOUBLE WHEN modality = 'visual' THEN greatest(anchor_score, least(s_visual + 0.1, 1.0)) ELSE greatest(anchor_score * 0.5, s_audio * 0.25) END AS s_cross, greatest(s_audio, s_ocr, s_visual) AS direct FROM e3),
  e5 AS (SELECT *, CASE WHEN demote AND modality = 'visual' THEN greatest(0.7 * a + 0.3 * qs, least(s_cross, 0.04)) ELSE greatest(0.7 * a + 0.3 * qs, 0.75 * direct + 0.25 * s_cross) END::DOUBLE AS score FROM e4),
  e6 AS (SELECT *, CASE WHEN score >= 0.12 THEN 'strong' WHEN score >= 0.05 THEN 'medium' ELSE 'weak' END AS support_label, CASE WHEN direct >= 0.05 THEN 'direct' WHEN direct >= 0.03 OR s_cross >= 0.03 THEN 'contextual' ELSE 'weak' END AS grounding_label FROM e5)"""


def supported(spark, sf_dir):
    return E.support(selected(spark, sf_dir))


SCORES = ["s_answer", "s_query", "s_audio", "s_ocr", "s_visual", "s_cross", "score"]


@query("e1_support_scores", f"WITH {SUPPORT_SQL} SELECT video_id, id, round(a, 6) AS s_answer, round(qs, 6) AS s_query, round(s_audio::DOUBLE, 6) AS s_audio, round(s_ocr::DOUBLE, 6) AS s_ocr, round(s_visual::DOUBLE, 6) AS s_visual, round(s_cross::DOUBLE, 6) AS s_cross, round(score, 6) AS score FROM e6")
def e1(spark, sf_dir):
    return supported(spark, sf_dir).select("video_id", "id", *[F.round(c, 6).alias(c) for c in SCORES])


@query("e2_labels", f"WITH {SUPPORT_SQL} SELECT video_id, id, support_label, grounding_label FROM e6")
def e2(spark, sf_dir):
    return supported(spark, sf_dir).select("video_id", "id", "support_label", "grounding_label")


@query("e3_annotate", f"WITH {SUPPORT_SQL} SELECT video_id, count(*) AS n, count(*) FILTER (WHERE support_label = 'strong') AS strong, count(*) FILTER (WHERE grounding_label <> 'weak') AS grounded, round(max(score), 6) AS best FROM e6 GROUP BY video_id")
def e3(spark, sf_dir):
    return supported(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("support_label") == "strong").alias("strong"), F.count_if(F.col("grounding_label") != "weak").alias("grounded"), F.round(F.max("score"), 6).alias("best"))


@query("e4_prune_to_answer", f"""
WITH {SUPPORT_SQL}, b AS (SELECT *, least(4, CASE WHEN vt OR ms THEN 2 ELSE 4 END, CASE WHEN tq THEN 1 ELSE 4 END) AS hi, CASE WHEN vt OR ms OR tq THEN 1 ELSE 3 END AS lo, count(*) OVER (PARTITION BY video_id) AS n,
  row_number() OVER (PARTITION BY video_id ORDER BY score DESC, relevance DESC, t, id) AS r, score >= greatest(0.05::DOUBLE, max(score) OVER (PARTITION BY video_id) * 0.55::DOUBLE) AS ok FROM e6),
k AS (SELECT *, least(count(*) FILTER (WHERE ok) OVER (PARTITION BY video_id), hi) AS k FROM b)
SELECT video_id, id FROM k WHERE n <= hi OR CASE WHEN k < lo THEN r <= lo ELSE r <= k END""")
def e4(spark, sf_dir):
    return E.prune(supported(spark, sf_dir), G).select("video_id", "id")


@query("e5_prune_to_citations", f"""
WITH {SUPPORT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, id) AS rank, max(score) OVER (PARTITION BY video_id) AS best FROM e6),
c AS (SELECT *, rank % 3 <> 0 AS cited, score >= greatest(0.035::DOUBLE, 0.35::DOUBLE * best) AS fine FROM r),
n AS (SELECT *, count(*) FILTER (WHERE cited) OVER w AS n_cited, count(*) FILTER (WHERE cited AND fine) OVER w AS n_good, count(*) FILTER (WHERE fine AND NOT (cited AND fine)) OVER w AS n_other,
  row_number() OVER (PARTITION BY video_id, fine AND NOT (cited AND fine) ORDER BY score DESC, relevance DESC, t, id) AS place FROM c WINDOW w AS (PARTITION BY video_id))
SELECT video_id, id FROM n WHERE CASE WHEN n_good + n_other < n_cited THEN cited ELSE fine AND (cited OR place <= n_cited - n_good) END""")
def e5(spark, sf_dir):
    """Two of three ranks are cited. Cited rows stay that pass the citation threshold; the best others above it fill up
    to as many as were cited; if those do not suffice, all cited rows stay."""
    w = W.partitionBy("video_id")
    s = supported(spark, sf_dir).withColumn("rank", F.row_number().over(w.orderBy("t", "id"))).withColumn("cited", F.col("rank") % 3 != 0)
    return E.prune_to_citations(s, G).select("video_id", "id")


def first_fit_sql(source: str) -> str:
    """CTE ``fit``: the rows of ``source`` with ``cluster``, by a recursion over a group's rows in time order."""
    alike = f"({sql_jaccard('x.c1', 'y.c1')} >= 0.6 OR (x.modality = y.modality AND greatest(least(x.turn, y.turn) + 1 - greatest(x.turn, y.turn), 0) >= 0.5))"
    return f"""
  fo AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, id) AS fi FROM {source}),
  fr AS (SELECT DISTINCT video_id, 0::BIGINT AS fi, []::STRUCT(cluster INTEGER, c1 VARCHAR[], modality VARCHAR, turn BIGINT)[] AS acc, NULL::INTEGER AS cluster FROM fo UNION ALL
    SELECT video_id, fi, list_append(acc, {{'cluster': k, 'c1': c1, 'modality': modality, 'turn': turn}}), k FROM (
      SELECT fr.video_id, x.fi, acc, x.c1, x.modality, x.turn, coalesce(list_min(list_transform(list_filter(acc, lambda y: {alike}), lambda y: y.cluster)), list_max(list_transform(acc, lambda y: y.cluster)) + 1, 0)::INTEGER AS k
      FROM fr JOIN fo x ON fr.video_id = x.video_id AND x.fi = fr.fi + 1)),
  fit AS (SELECT fo.*, fr.cluster FROM fo JOIN fr ON fo.video_id = fr.video_id AND fo.fi = fr.fi)"""


@query("e6_consolidate", f"WITH RECURSIVE {SUPPORT_SQL}, {first_fit_sql('e6')}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id, cluster) AS n, row_number() OVER (PARTITION BY video_id, cluster ORDER BY score DESC, relevance DESC, t, id) AS r FROM fit) SELECT video_id, cluster, id, n FROM n WHERE r = 1")
def e6(spark, sf_dir):
    """First-fit clusters by wording or overlapping spans; the strongest of each stays."""
    s = supported(spark, sf_dir).withColumn("toks", T.tokens("text")).withColumn("stop", F.col("start") + 30.0).select("video_id", "id", "t", "modality", "start", "stop", "toks", "score", "relevance")
    c = E.first_fit(s, G, ["t", "id"], E.ALIKE)
    w = W.partitionBy("video_id", "cluster")
    return c.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), F.desc("relevance"), "t", "id"))).filter("r = 1").select("video_id", "cluster", "id", "n")


@query("a24_evidence_cards", """
WITH RECURSIVE o AS (SELECT user_id, event_id, (epoch_us(ts) / 3600000000.0::DOUBLE) AS h, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY user_id ORDER BY i) <= 4.5 THEN 0 ELSE 1 END AS cut FROM o), g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY i) AS card FROM s)
SELECT user_id, card::BIGINT AS card, count(*) AS n, max(value) AS best FROM g GROUP BY user_id, card""")
def a24(spark, sf_dir):
    """Items within 4.5 of any member of the card, in time order: a gap to the last member, since it is the nearest."""
    e = table(spark, sf_dir, "events").withColumn("h", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600000000.0))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("cut", F.when(F.col("h") - F.lag("h").over(w) <= 4.5, 0).otherwise(1)).withColumn("card", F.sum("cut").over(w))
    return e.groupBy("user_id", "card").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))


@query("e7_drop_weakly_grounded", f"""
WITH {SUPPORT_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, count(*) FILTER (WHERE grounding_label <> 'weak') OVER (PARTITION BY video_id) AS g FROM e6)
SELECT video_id, id FROM n WHERE n <= 1 OR g < 1 OR g = n OR grounding_label <> 'weak'""")
def e7(spark, sf_dir):
    return E.drop_weak(supported(spark, sf_dir), G).select("video_id", "id")


_EXACT_SQL = "(" + " OR ".join(f"contains(lq, ' {p} ')" for p in E.EXACT_TEXT) + ") AND NOT (" + " OR ".join(f"contains(lq, ' {w} ')" for w in ("after", "before", "then", "next")) + ")"


@query("e9_query_classes", f"WITH {SUPPORT_SQL}, x AS (SELECT *, modality = 'visual' AND ocr AND relevance >= 0.95 AS strong FROM e6) SELECT video_id, any_value(intent) = 'speech_semantic' AS transcript_first, any_value(tq) AS transcript_question, any_value(ms) AS mixed_speech, any_value(vt) AS visual_text, any_value({_EXACT_SQL}) AND starts_with(lower(any_value(answer)), 'on-screen text near') AND bool_or(strong) AS exact_text FROM x GROUP BY video_id")
def e9(spark, sf_dir):
    ocr = F.startswith(F.lower("text"), F.lit("on-screen text near"))
    s = selected(spark, sf_dir).groupBy("video_id", "query", "intent", "answer").agg(F.bool_or((F.col("modality") == "visual") & ocr & (F.col("relevance") >= 0.95)).alias("strong"))
    classes = E.query_classes(F.col("query"), F.col("intent"))
    return s.select("video_id", *[c.alias(n) for n, c in classes.items()], E.exact_text_answer(F.col("query"), F.col("answer"), F.col("strong")).alias("exact_text"))


@query("e10_extractive_answer", f"""
WITH {SUPPORT_SQL}, b AS (SELECT video_id, arg_max(text, (round(score, 9), relevance, -t, id)) AS text, any_value(query) AS query FROM e6 GROUP BY video_id),
s AS (SELECT video_id, query, {SQL_SENTENCES} AS ss FROM b), x AS (SELECT video_id, query, i, ss[i] AS s FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)), k AS (SELECT *, {sql_tokens('query')} AS q, {sql_tokens('s')} AS c FROM x)
SELECT video_id, arg_min(s, (-round({sql_jaccard('q', 'c')}, 9), i)) AS answer FROM k GROUP BY video_id""")
def e10(spark, sf_dir):
    """The best sentence of the best supported evidence."""
    b = supported(spark, sf_dir).groupBy("video_id").agg(F.max_by(F.struct("text", "query"), F.struct(F.round("score", 9), F.col("relevance"), -F.col("t"), F.col("id"))).alias("b")).select("video_id", "b.*")
    x = b.select("video_id", T.tokens("query").alias("q"), F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    return x.groupBy("video_id").agg(F.min_by("s", F.struct(-F.round(T.jaccard(F.col("q"), T.tokens("s")), 9), F.col("i"))).alias("answer"))


@query("e12_claim_verification", f"""
WITH {LEX_SQL}, an AS (SELECT conv_id AS video_id, arg_max(text, (turn, text)) AS answer FROM conversations GROUP BY conv_id), s AS (SELECT video_id, {SQL_SENTENCES.replace('text', 'answer')} AS ss FROM an),
c AS (SELECT video_id, len(ss) AS n, i, ss[i] AS claim FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)), k AS (SELECT *, {sql_tokens('claim')} AS ct FROM c),
m AS (SELECT k.video_id, k.n, k.i, k.claim, len(k.ct) AS nt, max({sql_jaccard('k.ct', 'lex.c')}) AS best FROM k LEFT JOIN lex ON k.video_id = lex.video_id AND lex.modality = 'audio' GROUP BY k.video_id, k.n, k.i, k.claim, nt)
SELECT video_id, string_agg(claim, ' ' ORDER BY i) FILTER (WHERE n <= 1 OR nt < 4 OR coalesce(best, 0) >= 0.12) AS answer FROM m GROUP BY video_id""")
def e12(spark, sf_dir):
    """Claims that some spoken evidence supports; short ones and lone ones pass."""
    rows = lexical(spark, sf_dir).filter("modality = 'audio'").select("video_id", "toks")
    a = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.max_by("text", F.struct("turn", "text")).alias("answer"))
    a = a.join(lexical(spark, sf_dir).select("video_id").distinct(), "video_id", "left").withColumn("ss", sentences(F.col("answer")))
    c = a.select("video_id", F.size("ss").alias("n"), F.posexplode("ss").alias("i", "claim")).withColumn("ct", T.tokens("claim"))
    m = c.join(rows, "video_id", "left").groupBy("video_id", "n", "i", "claim", F.size("ct").alias("nt")).agg(F.max(T.jaccard(F.col("ct"), F.col("toks"))).alias("best"))
    ok = (F.col("n") <= 1) | (F.col("nt") < 4) | (F.coalesce("best", F.lit(0.0)) >= 0.12)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("i", "claim")))), lambda x: x["claim"]), " ")
    return m.groupBy("video_id").agg(F.nullif(text, F.lit("")).alias("answer"))


@query("e13_local_text", f"""
WITH {LEX_SQL}, s AS (SELECT video_id, id, t, query, {SQL_SENTENCES} AS ss FROM lex WHERE modality = 'audio'), x AS (SELECT video_id, id, t, query, i, ss[i] AS s FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)),
k AS (SELECT *, {sql_tokens('query')} AS q, {sql_tokens('s')} AS c FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round({sql_jaccard('q', 'c')} + least(length(s), 200) / 2000.0::DOUBLE, 9) DESC, t, id, i) AS rank FROM k)
SELECT video_id, rank::INT AS rank, s AS sentence FROM r WHERE rank <= 3""")
def e13(spark, sf_dir):
    """Spoken sentences ranked by overlap and length, three a conversation."""
    x = lexical(spark, sf_dir).filter("modality = 'audio'").select("video_id", "id", "t", T.tokens("query").alias("q"), F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    x = x.withColumn("score", F.round(T.jaccard(F.col("q"), T.tokens("s")) + F.least(F.length("s"), F.lit(200)) / F.lit(2000.0), 9))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("score"), "t", "id", "i"))).filter("rank <= 3").select("video_id", "rank", F.col("s").alias("sentence"))


@query("e14_quality_gate", f"""
WITH {SUPPORT_SQL}, f AS (SELECT *, NOT ocr AND trim(text) <> '' AS backed, lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS tt FROM e6),
w AS (SELECT *, tt AS t0, list_filter(list_transform(string_split(tt, ' '), lambda x: trim(x, '.,!?;:()[]{{}}')), lambda x: length(x) > 3) AS cw FROM f),
n AS (SELECT *, {NOISY_TRANSCRIPT_SQL.replace('(t ', '(tt ').replace('contains(t,', 'contains(tt,').replace('suffix(t,', 'suffix(tt,').replace('(c)', '(cw)')} AS noisy FROM w),
g AS (SELECT video_id, any_value(intent) AS intent, any_value(answer) AS answer, count(*) AS n, count(*) FILTER (WHERE backed) AS b, count(*) FILTER (WHERE backed AND noisy) AS nb, count(*) FILTER (WHERE grounding_label <> 'weak') AS gr, count(*) FILTER (WHERE support_label = 'strong') AS st FROM n GROUP BY video_id),
h AS (SELECT *, intent IN ('speech_semantic', 'mixed_av', 'sound_event', 'global_summary') AS sp, len(list_filter(string_split_regex(answer, '\\s+'), lambda x: x <> '')) AS aw, n * 10.0::DOUBLE AS red FROM g)
SELECT video_id, list_filter([CASE WHEN n = 0 THEN 'no_evidence' END, CASE WHEN aw < 6 THEN 'weak_answer' END, CASE WHEN b = 0 AND sp THEN 'missing_transcript_evidence' END, CASE WHEN b > 0 AND sp AND nb::DOUBLE / b >= 0.5 THEN 'noisy_transcript_evidence' END,
  CASE WHEN n > 0 AND gr = 0 THEN 'ungrounded_evidence' END, CASE WHEN n > 0 AND st = 0 THEN 'weak_evidence_support' END, CASE WHEN red < 80 THEN 'low_token_reduction' END], lambda x: x IS NOT NULL) AS codes FROM h""")
def e14(spark, sf_dir):
    s = supported(spark, sf_dir)
    backed = T.has_transcript("text")
    g = s.groupBy("video_id").agg(
        F.first("intent").alias("intent"), F.first("answer").alias("answer"), F.count(F.lit(1)).alias("n"), F.count_if(backed).alias("b"), F.count_if(backed & T.noisy_transcript("text")).alias("nb"),
        F.count_if(F.col("grounding_label") != "weak").alias("gr"), F.count_if(F.col("support_label") == "strong").alias("st"),
    )
    words = F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != ""))
    return g.select("video_id", E.warnings(F.col("intent"), words, F.col("n"), F.col("b"), F.col("nb"), F.col("gr"), F.col("st"), F.col("n") * 10.0).alias("codes"))


LABELS = [("pricing concern", ["and", "the", "cost", "too much"]), ("new capability", ["add", "der", "in"]), ("timing", ["la", "de", "later"])]


def _label_sql(more=""):
    out = []
    for name, kw in LABELS:
        own = [w for w in name.split() if w not in SENTIMENT_STOP]
        keys = sorted({*kw, *own})
        out.append(f"{{'score': round(greatest(len(list_intersect({sql_list(own)}, w))::DOUBLE / {len(own)}, len(list_filter({sql_list(keys)}, lambda k: CASE WHEN contains(k, ' ') THEN contains(l, k) ELSE list_contains(w, k) END))::DOUBLE / {len(keys)}), 9), 'label': '{name}'}}")
    return f"lb AS (SELECT video_id, id, turn, modality, t, start, relevance, text{more}, greatest({', '.join(out)}) AS b FROM (SELECT *, lower(text) AS l, list_filter(list_distinct({sql_words('text')}), lambda x: NOT list_contains({sql_list(SENTIMENT_STOP)}, x)) AS w FROM lex))"


def labelled(spark, sf_dir):
    return E.label_scores(lexical(spark, sf_dir), LABELS).filter("label_score >= 0.2")


@query("l1_extract_items", f"WITH {LEX_SQL}, {_label_sql()} SELECT video_id, id, b.label AS label, round(least(greatest(relevance, b.score), 1.0::DOUBLE), 6) AS confidence, coalesce(nullif(start, 0), t) AS a, start + 30.0::DOUBLE AS z FROM lb WHERE b.score >= 0.2")
def l1(spark, sf_dir):
    """Evidence to at most one labelled item: label, confidence, time range (a start of 0 falls back to the moment)."""
    return labelled(spark, sf_dir).select("video_id", "id", "label", F.round(F.least(F.greatest("relevance", "label_score"), F.lit(1.0)), 6).alias("confidence"), F.coalesce(F.nullif("start", F.lit(0.0)), "t").alias("a"), (F.col("start") + 30.0).alias("z"))


_REPLY_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(label, '{n}')" for n in names) + f" THEN '{reply}'" for names, reply in terms.RESPONSES) + f" WHEN list_has_any(w, {sql_list(terms.REQUEST_WORDS)}) THEN '{terms.REQUEST_RESPONSE}' END"


@query("l2_field_values", f"""
WITH {LEX_SQL}, {_label_sql()}, v AS (SELECT video_id, id, b.label AS label, text, {sql_words('text')} AS w FROM lb WHERE b.score >= 0.2)
SELECT video_id, id, label, {requester_sql('text')} AS speaker, {_REPLY_SQL} AS response, {SEVERITY_SQL} AS severity, {sql_sentence_with(terms.PRIORITY_TERMS, 'text')} AS priority, {sql_sentence_with(terms.PAIN_TERMS, 'text')} AS pain_point FROM v""")
def l2(spark, sf_dir):
    return labelled(spark, sf_dir).select(
        "video_id", "id", "label", T.requester("text").alias("speaker"), T.suggested_response("text", F.col("label")).alias("response"), T.severity("text").alias("severity"),
        T.sentence_with("text", terms.PRIORITY_TERMS).alias("priority"), T.sentence_with("text", terms.PAIN_TERMS).alias("pain_point"),
    )


DUPLICATE = "x.label = y.label and (coalesce(try_divide(greatest(least(x.stop, y.stop) - greatest(x.start, y.start), 0D), least(x.stop - x.start, y.stop - y.start)), 0D) >= 0.5D or size(array_intersect(x.toks, y.toks)) / greatest(1, size(array_union(x.toks, y.toks))) >= 0.72D)"


def _l3_sql() -> str:
    same = f"acc[k].label = x.label AND (acc[k].turn = x.turn OR {sql_jaccard('acc[k].c', 'x.c')} >= 0.72)"
    return f"""WITH RECURSIVE {LEX_SQL}, {_label_sql(', c')}, x AS (SELECT video_id, id, b.label AS label, turn, c, least(greatest(relevance, b.score), 1.0::DOUBLE) AS confidence FROM lb WHERE b.score >= 0.2),
  o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY turn, confidence DESC, id) AS i FROM x),
  r AS (SELECT DISTINCT video_id, 0::BIGINT AS i, []::STRUCT(id VARCHAR, label VARCHAR, turn BIGINT, c VARCHAR[], confidence DOUBLE)[] AS acc FROM o UNION ALL
    SELECT video_id, i, CASE WHEN j IS NULL THEN list_append(acc, me) WHEN me.confidence > acc[j].confidence THEN list_concat(list_append(acc[:j - 1], me), acc[j + 1:]) ELSE acc END FROM (
      SELECT r.video_id, x.i, acc, {{'id': x.id, 'label': x.label, 'turn': x.turn, 'c': x.c, 'confidence': x.confidence}} AS me, list_filter(range(1, len(acc) + 1), lambda k: {same})[1] AS j FROM r JOIN o x ON r.video_id = x.video_id AND x.i = r.i + 1)),
  l AS (SELECT video_id, unnest(arg_max(acc, i)) AS m FROM r GROUP BY video_id)
SELECT video_id, m.id AS id, m.label AS label, round(m.confidence, 6) AS confidence FROM l"""


@query("l3_deduplicate_items", _l3_sql())
def l3(spark, sf_dir):
    """Items in (start, rank, confidence) order; a duplicate replaces the kept one if it is more confident, and later
    items are compared with what then stands."""
    s = labelled(spark, sf_dir).withColumn("stop", F.col("start") + 30.0).withColumn("confidence", F.least(F.greatest("relevance", "label_score"), F.lit(1.0)))
    p = s.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "turn", (-F.col("confidence")).alias("o"), "id", F.struct("id", "label", "start", "stop", "toks", "confidence", "turn").alias("row")))).alias("pool"))
    row = "struct<id: string, label: string, start: double, stop: double, toks: array<string>, confidence: double, turn: bigint>"
    fold = f"""aggregate(transform(pool, p -> p.row), cast(array() as array<{row}>), (acc, x) -> transform(
        array(array_min(filter(transform(acc, (y, i) -> if({DUPLICATE}, i, null)), i -> i is not null))),
        j -> case when j is null then array_append(acc, x) when x.confidence > acc[j].confidence then transform(acc, (y, i) -> if(i = j, x, y)) else acc end)[0])"""
    return p.select("video_id", F.explode_outer(F.expr(fold)).alias("m")).filter("m is not null").select("video_id", "m.id", "m.label", F.round("m.confidence", 6).alias("confidence"))


@query("l5_extraction_evaluation", f"""
WITH {LEX_SQL}, {_label_sql()}, i AS (SELECT video_id, b.label AS label, start AS a, start + 30.0::DOUBLE AS z FROM lb WHERE b.score >= 0.2),
x(label, a, z) AS (VALUES ('pricing concern', 0.0::DOUBLE, 20.0::DOUBLE), ('new capability', 60.0, 70.0), ('timing', 300.0, 310.0)), v AS (SELECT DISTINCT video_id FROM lex),
h AS (SELECT v.video_id, x.label, bool_or(i.label IS NOT NULL) AS found, coalesce(bool_or(i.a <= x.z + 2 AND x.a <= i.z + 2), false) AS hit FROM v CROSS JOIN x LEFT JOIN i ON v.video_id = i.video_id AND x.label = i.label GROUP BY v.video_id, x.label)
SELECT video_id, round(avg(found::INT), 6) AS label_recall, round(avg(hit::INT), 6) AS timestamp_hit_rate FROM h GROUP BY video_id""")
def l5(spark, sf_dir):
    x = spark.createDataFrame([("pricing concern", 0.0, 20.0), ("new capability", 60.0, 70.0), ("timing", 300.0, 310.0)], "label string, a double, z double")
    i = labelled(spark, sf_dir).select("video_id", "label", F.col("start").alias("ia"), (F.col("start") + 30.0).alias("iz"))
    v = lexical(spark, sf_dir).select("video_id").distinct().crossJoin(F.broadcast(x))
    h = v.join(i, ["video_id", "label"], "left").groupBy("video_id", "label").agg(F.bool_or(F.col("ia").isNotNull()).alias("found"), F.coalesce(F.bool_or((F.col("ia") <= F.col("z") + 2) & (F.col("a") <= F.col("iz") + 2)), F.lit(False)).alias("hit"))
    return h.groupBy("video_id").agg(F.round(F.avg(F.col("found").cast("int")), 6).alias("label_recall"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("timestamp_hit_rate"))


_QUALITY_SQL = f"""{LEX_SQL}, {_label_sql(', c')}, it AS (SELECT video_id, turn, id, b.label AS label, c, least(greatest(relevance, b.score), 1.0::DOUBLE) AS conf, lower(text) AS l FROM lb WHERE b.score >= 0.2),
  du AS (SELECT DISTINCT x.video_id, x.id FROM it x JOIN it y ON x.video_id = y.video_id AND x.label = y.label AND y.turn < x.turn WHERE {sql_jaccard('x.c', 'y.c')} >= 0.72),
  qn AS (SELECT lb.video_id, count(*) AS n, count(it.id) AS k, coalesce(avg(it.conf), 0) AS conf, count(du.id) AS dups,
    count(it.id) FILTER (WHERE NOT regexp_matches(it.l, '\\b(?:customer|buyer|prospect|user|founder|builder|team)\\b')) + count(it.id) FILTER (WHERE NOT contains(it.label, 'pricing') AND NOT contains(it.label, 'timing')) AS missing
    FROM lb LEFT JOIN it ON lb.video_id = it.video_id AND lb.id = it.id LEFT JOIN du ON lb.video_id = du.video_id AND lb.id = du.id GROUP BY lb.video_id),
  qr AS (SELECT *, k::DOUBLE / n AS rate, CASE WHEN k < 2 THEN 0.0::DOUBLE ELSE dups::DOUBLE / k END AS dup_rate, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE missing::DOUBLE / (2 * k) END AS weak_rate, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS covered FROM qn),
  lq AS (SELECT *, list_filter([CASE WHEN k = 0 THEN 'no_items' END, CASE WHEN rate > 0.9 AND n >= 3 THEN 'over_extraction' END, CASE WHEN dup_rate > 0.25 THEN 'high_duplicate_rate' END, CASE WHEN weak_rate > 0.35 THEN 'weak_fields' END,
    CASE WHEN k > 0 AND covered < 0.95 THEN 'weak_timestamps' END, CASE WHEN k > 0 AND conf < 0.45 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS codes FROM qr)"""


def label_quality(spark, sf_dir):
    """(video_id, n, k, rates, codes) of every conversation's extraction, also of those without an item."""
    s = E.label_scores(lexical(spark, sf_dir), LABELS).withColumn("item", F.col("label_score") >= 0.2)
    conf = F.least(F.greatest("relevance", "label_score"), F.lit(1.0))
    missing = (~F.lower("text").rlike(r"\b(?:customer|buyer|prospect|user|founder|builder|team)\b")).cast("int") + (~F.contains("label", F.lit("pricing")) & ~F.contains("label", F.lit("timing"))).cast("int")
    rows = s.withColumn("x", F.when(F.col("item"), F.struct("turn", "label", "toks", conf.alias("conf"), missing.alias("missing"), F.col("start").alias("a"), (F.col("start") + 30.0).alias("z"))))
    n = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("x")).alias("xs"))
    return E.label_quality(n)


@query("a10_label_quality", f"WITH {_QUALITY_SQL} SELECT video_id, n, k, round(rate, 6) AS extraction_rate, round(dup_rate, 6) AS duplicate_rate, round(weak_rate, 6) AS weak_field_rate, covered AS timestamp_coverage_rate, round(conf, 6) AS confidence, codes FROM lq")
def a10(spark, sf_dir):
    return label_quality(spark, sf_dir)


@query("l6_batch_label", f"WITH {_QUALITY_SQL} SELECT video_id, k AS item_count, n AS evidence_count, NOT list_contains(codes, 'no_items') AS quality_passed, codes AS warning_codes FROM lq")
def l6(spark, sf_dir):
    """Extraction and its quality over every artifact in one job; a case fails on an error, which only no_items is."""
    return E.batch_cases(label_quality(spark, sf_dir))


@query("a11_batch_report", f"WITH {_QUALITY_SQL} SELECT count(*) AS case_count, sum(k)::BIGINT AS total_items, sum(n)::BIGINT AS total_evidence, round(sum(k)::DOUBLE / count(*), 6) AS average_items_per_case, round(avg((NOT list_contains(codes, 'no_items'))::INT), 6) AS pass_rate, sum(len(codes))::BIGINT AS warning_count FROM lq")
def a11_report(spark, sf_dir):
    c = E.batch_cases(label_quality(spark, sf_dir))
    return c.agg(F.count(F.lit(1)).alias("case_count"), F.sum("item_count").alias("total_items"), F.sum("evidence_count").alias("total_evidence"), F.round(F.sum("item_count") / F.count(F.lit(1)), 6).alias("average_items_per_case"), F.round(F.avg(F.col("quality_passed").cast("int")), 6).alias("pass_rate"), F.sum(F.size("warning_codes")).cast("long").alias("warning_count"))


@query("a11_batch_labels", f"WITH {LEX_SQL}, {_label_sql()} SELECT b.label AS label, count(*) AS items, count(DISTINCT video_id) AS cases, round(avg(b.score), 6) AS mean_score FROM lb WHERE b.score >= 0.2 GROUP BY b.label")
def a11(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("video_id").alias("cases"), F.round(F.avg("label_score"), 6).alias("mean_score"))
