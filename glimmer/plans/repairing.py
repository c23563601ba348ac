"""Queries: coverage rules over selections of events, by the intent of a question asked of each video."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as T
from ..operators import repair as R
from ..operators import selection
from ..registry import query
from .selecting import SCALE, Z_SQL, anchored, mmr_sql

G = ["video_id"]
#: The question of a video, by its number: one for each rule, with the intent that it has.
ASKED = [
    ("Which logo is visible on the screen?", "visual_object_action"),
    ("What object appears in the opening frame?", "visual_object_action"),
    ("What happens after the alarm?", "temporal_before_after"),
    ("How many people are wearing a shirt?", "counting_comparison"),
    ("What does the speaker say about the object on the screen?", "mixed_av"),
    ("Give an overview of the main theme.", "global_summary"),
    ("Which topic is not discussed?", "negative_evidence"),
    ("Is there applause or music?", "sound_event"),
]
K, LAM, SIGMA = terms.PRESETS["aggressive"]
#: Seconds that a pair's two moments may lie apart, on the events' scale.
REACH = 43200.0
NEAR = 12.0 * SCALE


def asked(df):
    """Adds the video's question and its intent."""
    q = F.array(*[F.lit(x) for x, _ in ASKED])[F.pmod("video_id", F.lit(len(ASKED))).cast("int")]
    return df.withColumn("query", q).withColumn("intent", T.query_intent("query")["intent"])


def pool(spark, sf_dir):
    """Scored and anchored events; clicks stand for frames that bear text."""
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("on-screen text near "), F.col("id"))).otherwise("")
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("video_id"), F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("id"), "event_type")
    return anchored(spark, sf_dir).join(kinds, ["video_id", "id"]).withColumn("text", text).withColumn("relevance", F.round(F.col("relevance") / 500, 9)).withColumn("z", F.round("z", 9))


def best_pairs(spark, sf_dir):
    """(video_id, anchor, target) ids of the best directed pair of visuals."""
    from ..operators.moments import best_directed_pair

    rows = pool(spark, sf_dir).filter("modality = 'visual'").select("video_id", "id", "t", (F.col("relevance")).alias("a"), (1 - F.col("relevance")).alias("b"))
    return best_directed_pair(rows, G, "a", "b", REACH)


def repairable(spark, sf_dir):
    p = pool(spark, sf_dir)
    chosen = selection.mmr_select(p, G, "aggressive", SCALE, drop_neighbors=False)
    return asked(R.states(p, chosen, G))


PAIR_SQL = f"""best AS (SELECT video_id, anchor, target FROM (SELECT a.video_id, a.id AS anchor, b.id AS target, row_number() OVER (PARTITION BY a.video_id ORDER BY round(a.relevance + 1 - b.relevance + 0.25::DOUBLE * (1 - (b.t - a.t) / {REACH}::DOUBLE), 9) DESC, b.t - a.t, a.t, a.id, b.id) AS r
    FROM pl a JOIN pl b ON a.video_id = b.video_id AND a.modality = 'visual' AND b.modality = 'visual' AND b.t > a.t AND b.t <= a.t + {REACH}::DOUBLE) WHERE r = 1)"""
ROW_SQL = "{'id': id, 'modality': modality, 't': t, 'z': z, 'relevance': relevance, 'mmr': %s, 'anchor_t': anchor_t, 'anchor_score': anchor_score, 'text': text}"
STATE_SQL = f"""WITH RECURSIVE {Z_SQL},
  pl AS (SELECT b.video_id, b.id, b.modality, b.t, round(b.z, 9) AS z, round(b.relevance / 500, 9) AS relevance, b.anchor_t, b.anchor_score, CASE WHEN e.event_type = 'click' THEN 'on-screen text near ' || b.id ELSE '' END AS text
    FROM boosted b JOIN events e ON b.video_id = e.user_id AND b.id = 'e' || lpad(e.event_id::VARCHAR, 10, '0')),
  {mmr_sql('pl', K, LAM, SIGMA * SCALE)},
  qs AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{q}', '{x}')" for i, (q, x) in enumerate(ASKED))}) v(m, query, intent)),
  st AS (SELECT p.video_id, query, intent, pool, sel FROM (SELECT video_id, list({ROW_SQL % 'z'} ORDER BY t, id) AS pool FROM pl GROUP BY video_id) p
    JOIN (SELECT r.video_id, list({ROW_SQL % 'r.mmr'.replace('r.mmr', 'own')} ORDER BY rank) AS sel FROM (SELECT pl.*, rec.mmr AS own, rec.rank FROM rec JOIN pl ON rec.video_id = pl.video_id AND rec.id = pl.id WHERE rn = 1) r GROUP BY r.video_id) s ON p.video_id = s.video_id
    JOIN qs ON p.video_id % {len(ASKED)} = m)"""
AUDIO, VISUAL = "y.modality = 'audio'", "y.modality = 'visual'"
ANCHORED = f"y.modality = 'visual' AND coalesce(y.anchor_score, 0) >= {terms.ANCHOR_MIN_SCORE}"


def _evict(may: str, floor: int = 0):
    """As ``repair.evict``, in the other dialect: a selection without its weakest row that may go, or null."""

    def of(sel: str) -> str:
        victim = f"list_sort(list_filter(list_transform({sel}, lambda y, i: CASE WHEN {may} THEN {{'mmr': y.mmr, 'i': i, 'id': y.id}} END), lambda v: v IS NOT NULL))[1].id"
        return f"CASE WHEN len(list_filter({sel}, lambda y: {may})) <= {floor} THEN NULL ELSE list_filter({sel}, lambda x: x.id <> {victim}) END"

    return of


def _audio_first(sel: str) -> str:
    return f"coalesce({_evict(AUDIO)(sel)}, {_evict(VISUAL)(sel)})"


def _n(cond: str, of: str = "sel") -> str:
    return f"len(list_filter({of}, lambda y: {cond}))"


def _ordered(rows: str, keys: list[str]) -> str:
    fields = ", ".join(f"'k{i}': {k}" for i, k in enumerate([*keys, "x.t", "x.id"]))
    return f"list_transform(list_sort(list_transform({rows}, lambda x: {{{fields}, 'x': x}})), lambda o: o.x)"


def _unchosen(cond: str) -> str:
    return f"list_filter(pool, lambda x: {cond.replace('y.', 'x.')} AND NOT list_contains(list_transform(sel, lambda y: y.id), x.id))"


def fill_sql(name: str, source: str, when: str, incoming: str, have: str, target: str, evict) -> str:
    """CTE ``name``: ``source`` with its selections filled row by row where ``when`` holds."""
    return f"""
  {name}_i AS (SELECT *, CASE WHEN {when} THEN {incoming} ELSE list_slice(pool, 1, 0) END AS inc, ({have})::BIGINT AS have, ({target})::BIGINT AS target FROM {source}),
  {name}_r AS (SELECT video_id, 0::BIGINT AS i, sel, have AS n, false AS done FROM {name}_i UNION ALL
    SELECT video_id, i, CASE WHEN e IS NULL THEN sel ELSE list_append(e, x) END, CASE WHEN e IS NULL THEN n ELSE n + 1 END, e IS NULL FROM (
      SELECT r.video_id, r.i + 1 AS i, r.sel, r.n, s.inc[r.i + 1] AS x, CASE WHEN len(r.sel) >= {K} THEN {evict('r.sel')} ELSE r.sel END AS e
      FROM {name}_r r JOIN {name}_i s ON r.video_id = s.video_id WHERE r.i < len(s.inc) AND NOT r.done AND r.n < s.target)),
  {name} AS (SELECT s.video_id, s.query, s.intent, s.pool, r.sel FROM {name}_i s JOIN (SELECT video_id, arg_max(sel, i) AS sel FROM {name}_r GROUP BY video_id) r ON s.video_id = r.video_id)"""


ANCHOR_SQL = fill_sql(
    "s1", "st", "true",
    _ordered(f"list_filter({_unchosen(AUDIO)}, lambda x: len(list_filter(sel, lambda y: {ANCHORED} AND y.anchor_t IS NOT NULL AND abs(x.t - y.anchor_t) < 0.000001)) > 0)", ["-x.relevance", "-x.z"]),
    _n(AUDIO), str(min(4, max(2, K // 3))), _evict(ANCHORED),
)
FRAME_SQL = f"coalesce({', '.join(_ordered(f'list_filter(pool, lambda x: {c})', []) + '[1]' for c in ("x.modality = 'visual' AND starts_with(lower(x.text), 'on-screen text')", "x.modality = 'visual'"))})"
BEST_SQL = "list_transform(list_sort(list_transform({sel}, lambda y, i: {{'m': -y.mmr, 'i': i, 'y': y}})), lambda o: o.y)[1:{n}]"
OPENS_SQL = "(" + " OR ".join(f"contains(lower(query), '{m}')" for m in terms.OPENING_MARKERS) + ")"
OPENING_SQL = f"""
  s2 AS (SELECT video_id, query, intent, pool, CASE WHEN intent = 'visual_object_action' AND {OPENS_SQL} AND f IS NOT NULL AND NOT list_contains(list_transform(sel, lambda y: y.id), f.id) THEN list_append({BEST_SQL.format(sel='sel', n=K - 1)}, f) ELSE sel END AS sel FROM (SELECT *, {FRAME_SQL} AS f FROM s1))"""
PAIRED_SQL = f"""
  {PAIR_SQL}, s3 AS (SELECT s.video_id, query, intent, pool, CASE WHEN intent = 'temporal_before_after' AND anchor IS NOT NULL THEN
      list_concat({BEST_SQL.format(sel='list_filter(sel, lambda x: x.id <> anchor AND x.id <> target)', n=K - 2)}, list_transform(list_filter(pool, lambda x: x.id = anchor), lambda x: struct_update(x, mmr := x.relevance)), list_transform(list_filter(pool, lambda x: x.id = target), lambda x: struct_update(x, mmr := 1 - x.relevance))) ELSE sel END AS sel
    FROM s2 s LEFT JOIN best ON s.video_id = best.video_id)"""
# claims of the counting rule: chosen visuals in turn, each its nearest visual that is unchosen and unclaimed
CLAIM_SQL = f"""
  s4_v AS (SELECT video_id, pool, sel, {_ordered(f'list_filter(sel, lambda x: x.modality = {chr(39)}visual{chr(39)})', ['-x.z', '-x.relevance'])} AS vs FROM s3 WHERE intent = 'counting_comparison'),
  s4_c AS (SELECT video_id, 0::BIGINT AS i, list_slice(pool, 1, 0) AS acc FROM s4_v UNION ALL
    SELECT video_id, i, CASE WHEN x IS NULL THEN acc ELSE list_append(acc, x) END FROM (
      SELECT video_id, i, acc, list_transform(list_sort(list_transform(list_filter(pool, lambda x: x.modality = 'visual' AND abs(x.t - vt) <= {NEAR} AND NOT list_contains(list_transform(sel, lambda y: y.id), x.id) AND NOT list_contains(list_transform(acc, lambda y: y.id), x.id)), lambda x: {{'a': abs(x.t - vt), 'b': -x.z, 'c': x.t, 'd': x.id, 'x': x}})), lambda o: o.x)[1] AS x
      FROM (SELECT c.video_id, c.i + 1 AS i, c.acc, v.pool, v.sel, v.vs[c.i + 1].t AS vt FROM s4_c c JOIN s4_v v ON c.video_id = v.video_id WHERE c.i < len(v.vs)))),
  s4_s AS (SELECT s.*, coalesce(c.acc, list_slice(pool, 1, 0)) AS claims FROM s3 s LEFT JOIN (SELECT video_id, arg_max(acc, i) AS acc FROM s4_c GROUP BY video_id) c ON s.video_id = c.video_id)"""
COUNT_SQL = CLAIM_SQL + "," + fill_sql("s4", "s4_s", "intent = 'counting_comparison'", "claims", "0", "len(pool)", _audio_first)
SURE = "y.modality = 'visual' AND starts_with(lower(y.text), 'on-screen text near') AND y.relevance >= 0.95"
VISUAL_SQL = fill_sql("s5", "s4", f"intent = 'visual_object_action' AND {_n(SURE)} = 0", _ordered(_unchosen(VISUAL), ["-x.z", "-x.relevance"]), _n(VISUAL), f"least({_n(VISUAL, 'pool')}, {max(2, K // 2)})", _audio_first)
BOTH = f"intent = 'mixed_av' AND {_n(VISUAL, 'pool')} > 0 AND {_n(AUDIO, 'pool')} > 0"
MIXED_SQL = ",".join([
    fill_sql("s6", "s5", BOTH, _ordered(_unchosen(AUDIO), ["-x.relevance", "-x.z"]) + "[1:1]", _n(AUDIO), "1", _evict(VISUAL, 1)),
    fill_sql("s7", "s6", BOTH, _ordered(_unchosen(VISUAL), ["-x.relevance", "-x.z"]) + "[1:1]", _n(VISUAL), "1", _evict(AUDIO, 1)),
    fill_sql("s8", "s7", f"{BOTH} AND {_n(VISUAL)} > 0", _ordered(_unchosen(AUDIO), [f"list_min(list_transform(list_filter(sel, lambda y: {VISUAL}), lambda y: abs(x.t - y.t)))", "-x.z", "-x.relevance"]), _n(AUDIO), f"least({_n(AUDIO, 'pool')}, {max(2, K // 3)})", _evict(VISUAL, 2)),
])


def _third(row: str, lo: str = "lo", span: str = "span") -> str:
    return f"least(floor(({row}.t - {lo}) / {span} * 3)::INT, 2)"


_CROWDED = _evict(f"{AUDIO} AND len(list_filter(r.sel, lambda w: w.modality = 'audio' AND {_third('w', 's.lo', 's.span')} = {_third('y', 's.lo', 's.span')})) > 1")
GLOBAL_SQL = f"""
  s9_i AS (SELECT *, list_min(ts) AS lo, greatest(list_max(ts) - list_min(ts), 1.0) AS span FROM (SELECT *, list_transform(list_filter(pool, lambda y: {AUDIO}), lambda y: y.t) AS ts FROM s8 WHERE intent = 'global_summary') WHERE len(ts) > 0),
  s9_r AS (SELECT video_id, 0 AS third, sel, false AS done FROM s9_i UNION ALL
    SELECT video_id, third + 1, CASE WHEN settled OR e IS NULL THEN sel ELSE list_append(e, x) END, NOT settled AND e IS NULL FROM (
      SELECT video_id, third, sel, x, x IS NULL OR taken AS settled, e FROM (
        SELECT r.video_id, r.third, r.sel, {_ordered(f"list_filter(s.pool, lambda x: x.modality = 'audio' AND {_third('x', 's.lo', 's.span')} = r.third)", ['-x.z', '-x.relevance'])}[1] AS x,
          len(list_filter(r.sel, lambda y: {AUDIO} AND {_third('y', 's.lo', 's.span')} = r.third)) > 0 AS taken, CASE WHEN len(r.sel) >= {K} THEN coalesce({_CROWDED('r.sel')}, {_evict(VISUAL, 1)('r.sel')}) ELSE r.sel END AS e
        FROM s9_r r JOIN s9_i s ON r.video_id = s.video_id WHERE r.third < 3 AND NOT r.done))),
  s9 AS (SELECT s.video_id, query, intent, pool, coalesce(r.sel, s.sel) AS sel FROM s8 s LEFT JOIN (SELECT video_id, arg_max(sel, third) AS sel FROM s9_r GROUP BY video_id) r ON s.video_id = r.video_id)"""
NEGATIVE_SQL = fill_sql("s10", "s9", "intent = 'negative_evidence'", _ordered(_unchosen(AUDIO), ["-x.z", "-x.relevance"]), _n(AUDIO), str(min(K, max(3, K // 2))), _evict(VISUAL))
CHAIN_SQL = ",".join([STATE_SQL, ANCHOR_SQL, OPENING_SQL, PAIRED_SQL, COUNT_SQL, VISUAL_SQL, MIXED_SQL, GLOBAL_SQL, NEGATIVE_SQL])


def _shown(step: str) -> str:
    return f" SELECT video_id, intent, u.i AS rank, sel[u.i].id AS id, round(sel[u.i].mmr, 6) AS mmr FROM (SELECT *, unnest(range(1, len(sel) + 1))::INT AS i FROM {step}) u"


def shown(rows):
    return rows.select("video_id", "intent", F.posexplode_outer("sel").alias("i", "x")).filter("i is not null").select("video_id", "intent", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("id"), F.round("x.mmr", 6).alias("mmr"))


def opens():
    return "(" + " or ".join(f"contains(lower(query), '{m}')" for m in terms.OPENING_MARKERS) + ")"


def repaired(spark, sf_dir):
    rows = repairable(spark, sf_dir).join(best_pairs(spark, sf_dir), G, "left")
    row = "get(filter(pool, x -> x.id = {}), 0)"
    for name, strength in (("anchor", "x.relevance"), ("target", "1 - x.relevance")):
        fields = ", ".join(f"'{f}', {strength if f == 'mmr' else f'x.{f}'}" for f in R.FIELDS)
        rows = rows.withColumn(name, F.expr(f"transform(array({row.format(name)}), x -> if(x is null, null, named_struct({fields})))[0]"))
    return R.repair(rows, K, opens(), pair=True, near=NEAR)


@query("k15_anchor_sources", ",".join([STATE_SQL, ANCHOR_SQL]) + _shown("s1"))
def k15_sources(spark, sf_dir):
    """Selections with the audio that anchors their visuals."""
    return shown(repairable(spark, sf_dir).withColumn("sel", F.expr(R.anchor_sources(str(K)))))


@query("k17_coverage_chain", CHAIN_SQL + _shown("s10"))
def k17_chain(spark, sf_dir):
    """All rules in their order, each for the questions of its intent."""
    return shown(repaired(spark, sf_dir))
