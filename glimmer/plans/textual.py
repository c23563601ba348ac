"""Queries: text functions over ``documents``, ``conversations`` and the literal questions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as T
from ..functions.terms import KEYWORD_FORMS, KEYWORD_STOPWORDS
from ..registry import query
from ..sources.tables import QUESTIONS_SQL, TURNS_SQL, questions, sql_jaccard, sql_list, sql_tokens, sql_words, table, turns

RECALL_TERMS = [" The ", "and", "licensed", "", "zzz"]
BLANK = r"[ \t\n\x0B\f\r]+"
SQL_COLLAPSED = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query("t1_tokens", f"SELECT doc_id, list_sort({sql_tokens('text')}) AS tokens FROM documents")
def t1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(T.tokens("text")).alias("tokens"))


@query("t2_lexical_relevance", f"""
WITH {TURNS_SQL}, k AS (SELECT video_id, id, {sql_tokens('query')} AS q, {sql_tokens('text')} AS c FROM turns)
SELECT video_id, id, round(CASE WHEN len(q) = 0 OR len(c) = 0 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE * len(list_intersect(q, c)) / len(q) + 0.25::DOUBLE * len(list_intersect(q, c)) / len(c) END, 6) AS relevance FROM k""")
def t2(spark, sf_dir):
    return turns(spark, sf_dir).select("video_id", "id", F.round(T.lexical_relevance(T.tokens("query"), T.tokens("text")), 6).alias("relevance"))


@query("t3_jaccard", f"""
WITH {TURNS_SQL}, k AS (SELECT video_id, id, {sql_tokens('query')} AS q, {sql_tokens('text')} AS c FROM turns)
SELECT video_id, id, round({sql_jaccard('q', 'c')}, 6) AS similarity FROM k""")
def t3(spark, sf_dir):
    return turns(spark, sf_dir).select("video_id", "id", F.round(T.text_similarity("query", "text"), 6).alias("similarity"))


@query("t4_unique_tokens", f"SELECT doc_id, len({sql_tokens('text')})::INT AS n FROM documents")
def t4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens("text")).alias("n"))


@query("t6_normalize_query", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS query FROM conversations WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 0")
def t6(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_query("text").alias("query"))
    return q.filter("query <> ''")


def _asked(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("-"), F.col("role")).alias("query_id"), F.col("text").alias("query"))
    return questions(spark).unionByName(c)


_ASKED_SQL = f"asked AS (SELECT * FROM {QUESTIONS_SQL} UNION ALL SELECT 'c' || conv_id || '-' || turn || '-' || role, text FROM conversations)"


def _has(ts):
    return f"list_has_any(w, {sql_list(ts)})"


def _phrases(ps, x="l"):
    return "(" + " OR ".join("contains({}, '{}')".format(x, p.replace("'", "''")) for p in ps) + ")"


def _intent_sql() -> str:
    r = terms.INTENT_REASONS
    rules = [
        ("len(w) = 0", "mixed_av", "blank"), ("neg", "negative_evidence", "negative"), ("cnt AND NOT sp", "counting_comparison", "counting"),
        ("gl AND NOT (sp OR vi OR so)", "global_summary", "global_only"), (f"vi AND sp AND NOT te AND {_phrases(terms.SCREEN_TEXT_PHRASES)}", "visual_object_action", "screen_text"),
        ("sp AND vi", "mixed_av", "speech_visual"), ("te AND (sp OR vi OR so)", "temporal_before_after", "temporal"), ("con AND NOT (vi OR so)", "speech_semantic", "conceptual"),
        ("sp", "speech_semantic", "speech"), ("so", "sound_event", "sound"), ("vi", "visual_object_action", "visual"), ("te", "temporal_before_after", "temporal"), ("gl", "global_summary", "global"),
    ]
    case = lambda i, default: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[1] if i == 1 else r[x[2]]}'" for x in rules) + f" ELSE '{default}' END"
    return f"""
WITH {_ASKED_SQL}, t AS (SELECT query_id, lower(query) AS l, {sql_words('query')} AS w FROM asked),
f AS (SELECT *, {_has(terms.SPEECH_TERMS)} AS sp, {_has(terms.VISUAL_TERMS)} AS vi, {_has(terms.TEMPORAL_TERMS)} AS te, {_has(terms.SOUND_TERMS)} AS so, {_has(terms.GLOBAL_TERMS)} AS gl,
  {_has(terms.COUNTING_TERMS)} OR contains(l, 'how many') AS cnt, {_has(terms.NEGATIVE_TERMS)} OR {_phrases(terms.NEGATIVE_PHRASES)} AS neg,
  {_has(terms.CONCEPTUAL_TERMS)} OR ({_has(['what', 'how'])} AND NOT {_has(terms.VISUAL_TERMS)}) AS con FROM t)
SELECT query_id, {case(1, 'mixed_av')} AS intent, {case(2, r['none'])} AS reason FROM f"""


@query("t7_query_intent", _intent_sql())
def t7(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", F.inline_outer(F.array(T.query_intent("query"))))


@query("t8_decompose", f"""
WITH {_ASKED_SQL}, n AS (SELECT query_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS q FROM asked),
p AS (SELECT query_id, q, string_split_regex(q, '(?i)\\b(?:and|then|while|before|after|when)\\b|[,;]') AS ps FROM n WHERE q <> ''),
s AS (SELECT query_id, i, trim(ps[i], ' ?.') AS text FROM (SELECT query_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
a AS (SELECT query_id, i, text FROM s WHERE text <> '' UNION ALL SELECT query_id, 1, q FROM p WHERE query_id NOT IN (SELECT query_id FROM s WHERE text <> '')),
d AS (SELECT query_id, lower(text) AS k, min(i) AS i, arg_min(text, i) AS text FROM a GROUP BY query_id, lower(text)),
m AS (SELECT *, {sql_words('text')} AS w, lower(text) AS l FROM d)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY i))::INT AS pos, text,
  CASE WHEN {_phrases(terms.SCREEN_TEXT_PHRASES)} THEN 'visual' WHEN {_has(terms.ASPECT_VISUAL_TERMS)} AND NOT {_has(terms.ASPECT_AUDIO_TERMS)} THEN 'visual'
       WHEN {_has(terms.ASPECT_AUDIO_TERMS)} AND NOT {_has(terms.ASPECT_VISUAL_TERMS)} THEN 'audio' ELSE 'both' END AS modality FROM m""")
def t8(spark, sf_dir):
    n = _asked(spark, sf_dir).select("query_id", T.normalize_query("query").alias("q")).filter("q <> ''")
    parts = F.filter(F.transform(F.split("q", T.ASPECT_SPLIT), lambda p: F.btrim(p, F.lit(" ?."))), lambda p: p != "")
    n = n.withColumn("parts", F.when(F.size(parts) == 0, F.array("q")).otherwise(parts))
    a = n.select("query_id", F.posexplode("parts").alias("i", "text")).groupBy("query_id", F.lower("text").alias("k")).agg(F.min("i").alias("i"), F.min_by("text", "i").alias("text"))
    return a.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy("i")).alias("pos"), "text", T.aspect_modality("text").alias("modality"))


@query("t9_temporal_query", f"""
WITH {_ASKED_SQL}, m AS (SELECT query_id, regexp_extract(query, '(?is)^(.*?)\\b(after|before)\\b(.*)$', ['a', 'b', 'c']) AS m FROM asked)
SELECT query_id, lower(m.b) AS direction, trim(m.a, ' ,?.') AS target, trim(m.c, ' ,?.') AS anchor FROM m WHERE m.b <> '' AND trim(m.a, ' ,?.') <> '' AND trim(m.c, ' ,?.') <> ''""")
def t9(spark, sf_dir):
    t = _asked(spark, sf_dir).select("query_id", T.temporal_query("query").alias("t")).filter("t is not null")
    return t.select("query_id", "t.*")


@query("t10_noisy_candidate", f"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)
SELECT doc_id, len(w) >= 8 AND (length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / greatest(length(text), 1) < 0.92 OR len(list_filter(w, lambda x: list_contains({sql_list(terms.COMMON_TRANSCRIPT_WORDS)}, x)))::DOUBLE / nullif(len(w), 0) < 0.08) AS noisy FROM w""")
def t10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.noisy_candidate("text").alias("noisy"))


@query("t11_ocr_match", f"""
WITH {TURNS_SQL}, k AS (SELECT video_id, id, list_filter(list_distinct({sql_words('query')}), lambda w: NOT list_contains({sql_list(sorted({*terms.COMMON_TRANSCRIPT_WORDS, *terms.VISUAL_QUERY_WORDS}))}, w)) AS q, list_distinct({sql_words('text')}) AS o FROM turns)
SELECT video_id, id, round(CASE WHEN len(q) = 0 OR len(o) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(q, o))::DOUBLE / len(q) END, 6) AS score FROM k""")
def t11(spark, sf_dir):
    return turns(spark, sf_dir).select("video_id", "id", F.round(T.ocr_match("query", "text"), 6).alias("score"))


@query("t12_plausible_ocr", f"""
WITH c AS (SELECT doc_id, {SQL_COLLAPSED} AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z][A-Za-z''-]*') AS w FROM c)
SELECT doc_id, CASE WHEN length(t) >= 4 AND len(w) >= 2 AND length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\s.,:;''"\\-!?()&/%$#@]', '', 'g'))::DOUBLE / length(t) >= 0.8
  AND len(list_filter(w, lambda x: length(x) >= 3 OR list_contains({sql_list(terms.OCR_FUNCTION_WORDS)}, lower(x))))::DOUBLE / len(w) >= 0.7
  AND list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) >= 3.5 THEN t END AS text FROM w""")
def t12(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.plausible_ocr("text").alias("text"))


@query("t13_information_score", f"SELECT doc_id, {SQL_COLLAPSED} AS text, len(list_filter(string_split({SQL_COLLAPSED}, ' '), lambda w: length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 3))::INT AS score FROM documents")
def t13(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse("text").alias("text"), T.information_score("text").alias("score"))


NOISY_TRANSCRIPT_SQL = """(t = '' OR (contains(t, 'a lot of')::INT + contains(t, 'and then')::INT + contains(t, 'basically')::INT + contains(t, 'kind of')::INT + contains(t, 'so this is')::INT + contains(t, 'this role')::INT + contains(t, 'we have')::INT) >= 2
  OR len(list_distinct(c))::DOUBLE / greatest(len(c), 1) < 0.45 OR len(c) < 2 OR suffix(t, ' of') OR suffix(t, ' a') OR suffix(t, ' the'))"""


@query("t14_noisy_transcript", f"""
WITH c AS (SELECT doc_id, lower({SQL_COLLAPSED}) AS t FROM documents), w AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, ' '), lambda x: trim(x, '.,!?;:()[]{{}}')), lambda x: length(x) > 3) AS c FROM c)
SELECT doc_id, {NOISY_TRANSCRIPT_SQL} AS noisy FROM w""")
def t14(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.noisy_transcript("text").alias("noisy"))


@query("t15_has_transcript", f"WITH c AS (SELECT doc_id, lower({SQL_COLLAPSED}) AS t FROM documents) SELECT doc_id, t <> '' AND NOT starts_with(t, 'visual frame sampled at') AND NOT starts_with(t, 'on-screen text near') AS backed FROM c")
def t15(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_transcript("text").alias("backed"))


sentences = T.sentences
SQL_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query("t16_best_sentence", f"""
WITH {TURNS_SQL}, s AS (SELECT video_id, id, query, {SQL_SENTENCES} AS ss FROM turns),
e AS (SELECT video_id, id, query, i, ss[i] AS s FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)),
k AS (SELECT video_id, id, query, i, trim(s, ' ,') AS s, {sql_tokens('query')} AS q, {sql_tokens('s')} AS c FROM e WHERE trim(s, ' ,') <> '')
SELECT video_id, id, arg_min(s, (-round({sql_jaccard('q', 'c')} + CASE WHEN starts_with(lower(trim(query)), 'why') THEN 0.35::DOUBLE * len(list_filter({sql_list(terms.WHY_ANSWER_TERMS)}, lambda x: contains(lower(s), x))) ELSE 0 END, 9), i)) AS sentence FROM k GROUP BY video_id, id""")
def t16(spark, sf_dir):
    """The sentence most like the question; a why question looks for reasons too."""
    e = turns(spark, sf_dir).select("video_id", "id", "query", T.tokens("query").alias("q"), F.posexplode(sentences(F.col("text"))).alias("i", "s")).withColumn("s", F.btrim("s", F.lit(" ,"))).filter("s <> ''")
    why = F.when(F.startswith(F.lower(F.btrim("query")), F.lit("why")), 0.35 * T.count_contained("s", terms.WHY_ANSWER_TERMS)).otherwise(0.0)
    e = e.withColumn("score", F.round(T.jaccard(F.col("q"), T.tokens("s")) + why, 9))
    return e.groupBy("video_id", "id").agg(F.min_by("s", F.struct(-F.col("score"), "i")).alias("sentence"))


def claims(text) -> F:
    """Claims of an answer: a numbered line is one, other lines are cut into sentences."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), F.trim), lambda x: x != "")
    return F.flatten(F.transform(lines, lambda x: F.when(x.rlike(r"^\d+[.)]\s+"), F.array(x)).otherwise(sentences(x))))


def _claims_sql(text: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex({text}, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '')"
    return f"flatten(list_transform({lines}, lambda x: CASE WHEN regexp_matches(x, '^\\d+[.)]\\s+') THEN [x] ELSE {SQL_SENTENCES.replace('(text,', '(x,')} END))"


_ANSWER = "CASE WHEN turn % 2 = 1 THEN '1. ' || text || chr(10) || text ELSE text END"


@query("t17_claims", f"SELECT conv_id, turn, role, len(s)::INT AS n_claims, s AS claims FROM (SELECT conv_id, turn, role, {_claims_sql('answer')} AS s FROM (SELECT *, {_ANSWER} AS answer FROM conversations))")
def t17(spark, sf_dir):
    """Every other turn is an answer whose first line is numbered."""
    answer = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("1. "), F.col("text"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", claims(answer).alias("claims"))
    return s.select("conv_id", "turn", "role", F.size("claims").alias("n_claims"), "claims")


_CITING = "text || CASE turn % 3 WHEN 0 THEN ' See evidence ' || (turn + 1) || ' and Evidence 9.' WHEN 1 THEN ' Evidence: ' || turn || ', ' || (turn + 2) || ', 77' ELSE '' END"


@query("t18_citations", rf"""
WITH a AS (SELECT conv_id, turn, role, {_CITING} AS answer, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
x AS (SELECT conv_id, turn, role, n, list_concat(regexp_extract_all(lower(answer), 'evidence\s+(\d+)', 1), regexp_extract_all(regexp_extract(lower(answer), 'evidence:\s*([\d,\s]+)', 1), '\d+')) AS r FROM a)
SELECT conv_id, turn, role, list_sort(list_distinct(list_filter(list_transform(r, lambda v: v::INT), lambda v: v BETWEEN 1 AND n))) AS ranks FROM x""")
def t18(spark, sf_dir):
    """Turns as answers that cite in prose, in a list or not at all; ranks count up to the conversation's turns."""
    a = table(spark, sf_dir, "conversations").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("conv_id"))).withColumn("answer", F.expr(_CITING))
    return a.select("conv_id", "turn", "role", T.cited_ranks("answer", F.col("n")).alias("ranks"))


def _form_sql(x):
    return f"CASE {x} " + " ".join("WHEN '{}' THEN '{}'".format(a.replace("'", "''"), b) for a, b in KEYWORD_FORMS.items()) + f" ELSE {x} END"


@query("t19_keyword_terms", f"""
WITH w AS (SELECT doc_id, trim(unnest(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9''-]{{2,}}')), '''') AS raw FROM documents), f AS (SELECT doc_id, {_form_sql('raw')} AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS n FROM f WHERE NOT list_contains({sql_list(KEYWORD_STOPWORDS)}, term) AND NOT regexp_matches(term, '[0-9''-]') AND length(term) <= 24 GROUP BY doc_id, term),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term))::INT AS rank FROM c)
SELECT doc_id, term, n, rank FROM r WHERE rank <= 16""")
def t19(spark, sf_dir):
    """The 16 most frequent terms of each document, counted inside its row: sorted terms, the lengths of their runs."""
    raw = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-zA-Z][a-zA-Z0-9'-]{2,})"), F.lit(1)), lambda x: F.btrim(x, F.lit("'")))
    forms = F.create_map(*[F.lit(x) for pair in KEYWORD_FORMS.items() for x in pair])
    one = F.transform(raw, lambda x: F.coalesce(F.try_element_at(forms, x), x))
    ok = F.filter(one, lambda x: ~x.isin(KEYWORD_STOPWORDS) & ~x.rlike(r"[0-9'\-]") & (F.length(x) <= 24))
    s = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(ok).alias("s"))
    s = s.withColumn("at", F.expr("filter(sequence(0, size(s)), i -> i < size(s) and (i = 0 or s[i] <> s[i - 1]))"))
    best = F.expr("slice(array_sort(zip_with(at, slice(concat(at, array(size(s))), 2, size(at)), (a, b) -> named_struct('o', a - b, 'term', s[a]))), 1, 16)")
    # an outer generator: a filter on its array would be pushed down as further copies of the whole chain
    rows = s.select("doc_id", F.posexplode_outer(best).alias("i", "b")).filter("b is not null")
    return rows.select("doc_id", "b.term", (-F.col("b.o")).cast("long").alias("n"), (F.col("i") + 1).alias("rank"))


@query("t20_term_recall", f"""
SELECT doc_id, round(len(list_filter(['the', 'and', 'licensed', 'zzz'], lambda x: contains(lower(text), x)))::DOUBLE / 4, 6) AS recall, contains(lower(text), 'licensed') OR contains(lower(text), 'zzz') AS any_rare FROM documents""")
def t20(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.term_recall(T.words_in(RECALL_TERMS), "text"), 6).alias("recall"), T.contains_any(F.lower("text"), ["licensed", "zzz"]).alias("any_rare"))


MC = [
    ("m1", "b", "B", ["red", "green"]), ("m2", "The answer is a", "red", ["red", "green"]), ("m3", "it was bright green paint", "green", ["red", "green"]),
    ("m4", "", "red", []), ("m5", "a red door", "red", []), ("m6", "blue", "red", []), ("m7", "large wooden ship", "a large ship made of wood", ["a large ship made of wood", "small boat"]),
]


@query("t21_answer_exact", r"""
WITH n AS (SELECT conv_id, turn, role, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS p, array_to_string(regexp_extract_all(lower(CASE turn % 3 WHEN 0 THEN '(' || text || '!' WHEN 1 THEN split_part(text, ' ', 2) ELSE 'unsaid ' || turn END), '[a-z0-9]+'), ' ') AS e FROM conversations)
SELECT conv_id, turn, role, p, e, CASE WHEN p = '' THEN 0.0::DOUBLE WHEN p = e OR contains(p, e) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM n""")
def t21(spark, sf_dir):
    """Turns as answers, against themselves in other spelling, a word of theirs, or what was not said."""
    e = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("("), "text", F.lit("!"))).when(F.col("turn") % 3 == 1, F.split_part("text", F.lit(" "), F.lit(2))).otherwise(F.concat(F.lit("unsaid "), F.col("turn").cast("string")))
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.answer_form("text").alias("p"), T.answer_form(e).alias("e"))
    return m.withColumn("score", F.when(F.col("p") == "", 0.0).when((F.col("p") == F.col("e")) | F.contains("p", F.col("e")), 1.0).otherwise(0.0))


@query("t21_multiple_choice", """SELECT * FROM (VALUES ('m1', 1.0::DOUBLE), ('m2', 1.0), ('m3', 1.0), ('m4', 0.0), ('m5', 1.0), ('m6', 0.0), ('m7', 0.0)) t(id, score)""")
def t21_choice(spark, sf_dir):
    """Letters, "the answer is a", contained choices, shared words."""
    m = spark.createDataFrame(MC, "id string, p string, e string, choices array<string>")
    return m.select("id", T.answer_score(F.col("p"), F.col("e"), F.col("choices")).alias("score"))


@query("t22_letter", r"SELECT conv_id, turn, role, regexp_extract(upper(text), '\b([ABCD])\b', 1) AS letter FROM conversations")
def t22(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.letter("text").alias("letter"))


@query("t23_token_proxy", "SELECT doc_id, greatest(1, length(text) // 4)::INT AS n FROM documents")
def t23(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_proxy("text").alias("n"))


SENTIMENT_STOP, POSITIVE, NEGATIVE = terms.KEYWORD_STOP, terms.POSITIVE, terms.NEGATIVE


def sql_overlap(keywords, text: str) -> str:
    words = f"list_filter({sql_words(text)}, lambda w: NOT list_contains({sql_list(SENTIMENT_STOP)}, w))"
    return "((" + " + ".join(("contains(lower({}), '{}')::INT".format(text, k.replace("'", "''")) if " " in k or "'" in k else f"list_contains({words}, '{k}')::INT") for k in keywords) + f")::DOUBLE / {len(keywords)})"


def sql_sentence_with(keywords, text: str) -> str:
    parts = f"list_filter(list_transform(string_split_regex({text}, '[.!?]+'), lambda p: trim(p)), lambda p: p <> '')"
    best = f"list_sort(list_transform({parts}, lambda p, i: {{'n': -({sql_overlap(keywords, 'p')}), 'i': i, 's': p}}))[1]"
    return f"(SELECT CASE WHEN b.n < 0 THEN CASE WHEN length(b.s) <= 180 THEN b.s ELSE rtrim(substr(b.s, 1, 177)) || '...' END END FROM (SELECT {best} AS b))"


def requester_sql(text: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(lower({text}), '{p}'), '')" for p in terms.REQUESTER_PATTERNS) + ")"


SEVERITY_SQL = "CASE " + " ".join(f"WHEN list_has_any(w, {sql_list(ws)}) THEN '{level}'" for level, ws in terms.SEVERITY.items()) + " END"


@query("t24_field_texts", f"""
WITH t AS (SELECT conv_id, turn, role, text, {sql_words('text')} AS w, {SQL_SENTENCES} AS s FROM conversations)
SELECT conv_id, turn, role, CASE WHEN list_has_any(w, {sql_list(NEGATIVE)}) THEN 'negative' WHEN list_has_any(w, {sql_list(POSITIVE)}) THEN 'positive' ELSE 'neutral' END AS sentiment,
  CASE WHEN length(coalesce(s[1], text)) <= 260 THEN coalesce(s[1], text) ELSE rtrim(substr(coalesce(s[1], text), 1, 257)) || '...' END AS summary,
  {SEVERITY_SQL} AS severity, {requester_sql('text')} AS speaker, {sql_sentence_with(terms.PRIORITY_TERMS, 'text')} AS priority, {sql_sentence_with(terms.PAIN_TERMS, 'text')} AS pain_point FROM t""")
def t24(spark, sf_dir):
    w = T.ascii_words("text")
    first = F.coalesce(F.try_element_at(sentences(F.col("text")), F.lit(1)), F.col("text"))
    sentiment = F.when(F.arrays_overlap(w, T.words_in(NEGATIVE)), "negative").when(F.arrays_overlap(w, T.words_in(POSITIVE)), "positive").otherwise("neutral")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", sentiment.alias("sentiment"), T.shortened(first, 260).alias("summary"), T.severity("text").alias("severity"), T.requester("text").alias("speaker"),
        T.sentence_with("text", terms.PRIORITY_TERMS).alias("priority"), T.sentence_with("text", terms.PAIN_TERMS).alias("pain_point"),
    )


KEYWORDS = ["too much", "price", "the", "not now", "and"]


@query("t25_keyword_overlap", f"""
WITH t AS (SELECT doc_id, lower(text) AS l, list_filter({sql_words('text')}, lambda w: NOT list_contains({sql_list(SENTIMENT_STOP)}, w)) AS w FROM documents)
SELECT doc_id, round(len(list_filter({sql_list(KEYWORDS)}, lambda k: CASE WHEN contains(k, ' ') THEN contains(l, k) ELSE list_contains(w, k) END))::DOUBLE / 5, 6) AS overlap FROM t""")
def t25(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.keyword_overlap(KEYWORDS, "text"), 6).alias("overlap"))


def _preset_sql() -> str:
    rows = ", ".join(f"('{preset}', '{schema}', {prio}, '{word}')" for preset, (schema, prio, ws) in terms.EXTRACTION_PRESETS.items() for word in ws)
    return f"""{_ASKED_SQL}, pr(preset, schema_name, prio, word) AS (VALUES {rows}), pt AS (SELECT query_id, trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS task FROM asked),
pm AS (SELECT query_id, preset, schema_name, prio, list_sort(list(DISTINCT word) FILTER (WHERE regexp_matches(task, '(^|[^a-z0-9])' || word || '([^a-z0-9]|$)'))) AS matched FROM pt, pr GROUP BY query_id, preset, schema_name, prio),
ps AS (SELECT query_id, coalesce(arg_max({{'preset': preset, 'schema_name': schema_name, 'matched': matched}}, (len(matched), prio)) FILTER (WHERE len(matched) > 0), {{'preset': '{terms.DEFAULT_PRESET}', 'schema_name': '{terms.EXTRACTION_PRESETS[terms.DEFAULT_PRESET][0]}', 'matched': []::VARCHAR[]}}) AS b FROM pm GROUP BY query_id)"""


def preset_suggestion(task) -> F:
    """struct(score, priority, preset, schema_name, matched): the extraction preset with most of its words in a task, by
    priority; the default if none has any."""
    low = F.btrim(F.regexp_replace(F.lower(task), r"\s+", " "))
    options = []
    for preset, (schema, priority, words) in terms.EXTRACTION_PRESETS.items():
        matched = F.array_compact(F.array(*[F.when(low.rlike(rf"(^|[^a-z0-9]){w}([^a-z0-9]|$)"), F.lit(w)) for w in sorted(words)]))
        options.append(F.struct(F.size(matched).alias("score"), F.lit(priority).alias("priority"), F.lit(preset).alias("preset"), F.lit(schema).alias("schema_name"), matched.alias("matched")))
    fallback = options[list(terms.EXTRACTION_PRESETS).index(terms.DEFAULT_PRESET)]
    best = F.greatest(*options)
    return F.when(best["score"] > 0, best).otherwise(fallback)


@query("t26_preset_suggestion", f"WITH {_preset_sql()} SELECT query_id, b.preset AS preset, b.schema_name AS schema_name, len(b.matched)::INT AS score, b.matched AS matched FROM ps")
def t26(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", preset_suggestion(F.col("query")).alias("b")).select("query_id", "b.preset", "b.schema_name", "b.score", "b.matched")


@query("t27_modality_counts", f"""
WITH {TURNS_SQL} SELECT video_id, count(*) FILTER (WHERE modality = 'visual' OR contains(id, ':visual:') OR contains(id, '+visual')) AS n_visual, count(*) FILTER (WHERE modality = 'audio') AS n_audio FROM turns GROUP BY video_id""")
def t27(spark, sf_dir):
    fused = (F.col("modality") == "visual") | F.contains("id", F.lit(":visual:")) | F.contains("id", F.lit("+visual"))
    return turns(spark, sf_dir).groupBy("video_id").agg(F.count_if(fused).alias("n_visual"), F.count_if(F.col("modality") == "audio").alias("n_audio"))


@query("t29_ingestion_plan", """
WITH d AS (SELECT o_orderkey, o_totalprice / 20 AS dur FROM orders WHERE o_totalprice > 0),
m AS (SELECT *, CASE WHEN dur <= 600 THEN 'short' WHEN dur <= 3600 THEN 'medium' ELSE 'long' END AS mode FROM d),
w AS (SELECT *, CASE mode WHEN 'short' THEN 2.0::DOUBLE WHEN 'medium' THEN 10.0::DOUBLE ELSE greatest(30.0::DOUBLE, ceil(dur / 240)) END AS win FROM m)
SELECT o_orderkey, mode, CASE mode WHEN 'short' THEN 128 WHEN 'medium' THEN 256 ELSE 512 END AS frames, win AS audio_window, ceil(dur / win)::BIGINT AS max_windows, CASE mode WHEN 'long' THEN 0 ELSE 1 END AS context FROM w""")
def t29(spark, sf_dir):
    d = table(spark, sf_dir, "orders").filter("o_totalprice > 0").select("o_orderkey", (F.col("o_totalprice") / 20).alias("dur"))
    mode = F.when(F.col("dur") <= 600, "short").when(F.col("dur") <= 3600, "medium").otherwise("long")
    pick = lambda s, m, x: F.when(F.col("mode") == "short", s).when(F.col("mode") == "medium", m).otherwise(x)
    d = d.withColumn("mode", mode).withColumn("audio_window", pick(2.0, 10.0, F.greatest(F.lit(30.0), F.ceil(F.col("dur") / 240).cast("double"))))
    return d.select("o_orderkey", "mode", pick(128, 256, F.lit(512)).alias("frames"), "audio_window", F.ceil(F.col("dur") / F.col("audio_window")).alias("max_windows"), pick(1, 1, F.lit(0)).alias("context"))


@query("t30_scorer_routing", f"""
WITH i AS ({_intent_sql()}), q AS (SELECT i.query_id, i.intent, {sql_words('a.query')} AS w, d.dur, d.whisper, d.clap FROM i JOIN (WITH {_ASKED_SQL} SELECT * FROM asked) a ON i.query_id = a.query_id, (VALUES (300, true, true), (900, true, true), (900, true, false), (900, false, true)) d(dur, whisper, clap))
SELECT query_id, dur, whisper, clap, CASE WHEN dur >= 600 AND (intent IN ('speech_semantic', 'mixed_av', 'global_summary', 'sound_event') OR (intent = 'temporal_before_after' AND list_has_any(w, ['ask', 'asks', 'asked', 'mention', 'mentions', 'said', 'say', 'says', 'speak', 'speaker', 'tell', 'tells', 'told'])))
  THEN CASE WHEN whisper AND clap THEN 'dispatcher' WHEN whisper THEN 'whisper' ELSE 'baseline' END ELSE 'baseline' END AS scorer FROM q""")
def t30(spark, sf_dir):
    d = spark.createDataFrame([(300, True, True), (900, True, True), (900, True, False), (900, False, True)], "dur int, whisper boolean, clap boolean")
    q = _asked(spark, sf_dir).withColumn("intent", T.query_intent("query")["intent"]).crossJoin(F.broadcast(d))
    spoken = F.arrays_overlap(T.ascii_words("query"), T.words_in(terms.ROUTED_SPEECH))
    wanted = (F.col("dur") >= 600) & (F.col("intent").isin("speech_semantic", "mixed_av", "global_summary", "sound_event") | ((F.col("intent") == "temporal_before_after") & spoken))
    return q.select("query_id", "dur", "whisper", "clap", F.when(wanted & F.col("whisper") & F.col("clap"), "dispatcher").when(wanted & F.col("whisper"), "whisper").otherwise("baseline").alias("scorer"))


@query("t31_cache_key", "SELECT doc_id, substr(sha256(doc_id::VARCHAR || '|' || lang || '|' || source), 1, 24) AS key, substr(sha256(source), 1, 16) AS path_key FROM documents")
def t31(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cache_key([F.col("doc_id").cast("string"), F.col("lang"), F.col("source")]).alias("key"), T.cache_key([F.col("source")], 16).alias("path_key"))


@query("t32_token_estimate", """
WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS v, count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS a FROM events GROUP BY user_id),
p(profile, tv, ta) AS (VALUES ('generic', 258, 32), ('gemini_default', 258, 32), ('gemini_low_res', 66, 32)),
t AS (SELECT user_id, profile, tv * v + ta * a AS base, tv * (v // 4) + ta * (a // 4) AS kept FROM c, p)
SELECT user_id, profile, base, kept, greatest(base - kept, 0) AS saved, round(CASE WHEN base = 0 THEN 0 ELSE greatest(base - kept, 0)::DOUBLE / base END, 6) AS ratio FROM t""")
def t32(spark, sf_dir):
    v = F.col("event_type").isin("view", "click")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(v).alias("v"), F.count_if(~v).alias("a"))
    p = spark.createDataFrame([(n, *x) for n, x in terms.TOKENS_PER_ITEM.items()], "profile string, tv int, ta int")
    t = c.crossJoin(F.broadcast(p)).select("user_id", "profile", (F.col("tv") * F.col("v") + F.col("ta") * F.col("a")).alias("base"), F.expr("tv * (v div 4) + ta * (a div 4)").alias("kept"))
    saved = F.greatest(F.col("base") - F.col("kept"), F.lit(0))
    return t.select("user_id", "profile", "base", "kept", saved.alias("saved"), F.round(F.coalesce(F.try_divide(saved, "base"), F.lit(0.0)), 6).alias("ratio"))


@query("t33_spatial_mask", """
WITH e AS (SELECT item_id, text, CASE WHEN regexp_matches(lower(text), 'text|title|caption|slide|screen says') THEN 'text_band' WHEN regexp_matches(lower(text), 'show|shown|visible|look|see|person|hand|object|action|scene') THEN 'center_object' ELSE 'hash' END AS strategy FROM benchmark),
p AS (SELECT item_id, strategy, i, i // 14 AS r, i % 14 AS c, sha256(item_id::VARCHAR || '|' || text || '|' || i::VARCHAR) AS h FROM e, range(0, 196) g(i)),
n AS (SELECT *, (('0x' || substr(h, 1, 8))::BIGINT::DOUBLE * 4294967296.0 + ('0x' || substr(h, 9, 8))::BIGINT::DOUBLE) / 18446744073709551615.0::DOUBLE AS noise,
  greatest(0.0, 1.0 - sqrt((r - 6.5) * (r - 6.5) + (c - 6.5) * (c - 6.5))::DOUBLE / sqrt(84.5::DOUBLE)) AS center, greatest(0.0, 1.0 - abs(r - 6.5)::DOUBLE / 6.5::DOUBLE) AS band, greatest(0.0, 1.0 - abs(c - 6.5)::DOUBLE / sqrt(84.5::DOUBLE)) AS col FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(CASE strategy WHEN 'text_band' THEN 0.6 * (0.75 * band + 0.25 * col) + 0.25 * center + 0.15 * noise WHEN 'center_object' THEN 0.7 * center + 0.3 * noise ELSE noise END, 9) DESC, i) AS rn FROM n)
SELECT item_id, strategy, list_sort(list(i::INT)) AS kept FROM s WHERE rn <= 69 GROUP BY item_id, strategy""")
def t33(spark, sf_dir):
    """Grid of 14 x 14, 35 % retained: round(68.6)."""
    low = F.lower("text")
    strategy = F.when(low.rlike("text|title|caption|slide|screen says"), "text_band").when(low.rlike("show|shown|visible|look|see|person|hand|object|action|scene"), "center_object").otherwise("hash")
    p = table(spark, sf_dir, "benchmark").withColumn("strategy", strategy).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(195))))
    h = F.sha2(F.concat_ws("|", F.col("item_id").cast("string"), "text", F.col("i").cast("string")), 256)
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("double")
    r, c, middle, reach = F.expr("i div 14"), F.col("i") % 14, 6.5, 84.5**0.5
    noise = (half(1) * 4294967296.0 + half(9)) / 18446744073709551615.0
    center = F.greatest(F.lit(0.0), 1.0 - F.sqrt((r - middle) * (r - middle) + (c - middle) * (c - middle)) / reach)
    band, col = F.greatest(F.lit(0.0), 1.0 - F.abs(r - middle) / middle), F.greatest(F.lit(0.0), 1.0 - F.abs(c - middle) / reach)
    score = F.when(F.col("strategy") == "text_band", 0.6 * (0.75 * band + 0.25 * col) + 0.25 * center + 0.15 * noise).when(F.col("strategy") == "center_object", 0.7 * center + 0.3 * noise).otherwise(noise)
    p = p.withColumn("score", F.round(score, 9)).withColumn("rn", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "i")))
    return p.filter("rn <= 69").groupBy("item_id", "strategy").agg(F.array_sort(F.collect_list("i")).alias("kept"))


@query("t34_spatial_tokens", "WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id), t AS (SELECT user_id, n * 196 AS base, round_even(n * 196 * 0.35::DOUBLE, 0)::BIGINT AS kept FROM c) SELECT *, round((1 - kept::DOUBLE / base) * 100, 6) AS reduction FROM t")
def t34(spark, sf_dir):
    c = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click")).groupBy("user_id").agg((F.count(F.lit(1)) * 196).alias("base"))
    return c.withColumn("kept", F.rint(F.col("base") * 0.35).cast("long")).withColumn("reduction", F.round((1 - F.col("kept") / F.col("base")) * 100, 6))


@query("t35_context_assembly", f"WITH {TURNS_SQL} SELECT video_id, string_agg('[' || printf('%.2f', t) || 's] ' || modality || ': ' || text, chr(10) ORDER BY t, id) AS context FROM turns GROUP BY video_id")
def t35(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct("t", "id", "modality", "text")))
    line = lambda x: F.concat(F.lit("["), F.format_string("%.2f", x["t"]), F.lit("s] "), x["modality"], F.lit(": "), x["text"])
    return turns(spark, sf_dir).groupBy("video_id").agg(items.alias("items")).select("video_id", F.array_join(F.transform("items", line), "\n").alias("context"))


@query("x6_distinct_first_wins", "WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) SELECT doc_id, arg_min(line, i) AS line, min(i)::INT AS pos FROM l GROUP BY doc_id, lower(line)")
def x6(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.groupBy("doc_id", F.lower("line").alias("k")).agg(F.min_by("line", "i").alias("line"), (F.min("i") + 1).alias("pos")).drop("k")
