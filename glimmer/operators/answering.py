"""Extractive answers: a cascade in which each branch answers a question or passes it on.

Selected evidence is as small as its budget, so a question is one row with its evidence as an array, and the cascade is
one ``coalesce`` of the branches: a branch is evaluated only for the questions that all before it have passed on, and
all questions are answered in one job with one shuffle. Branches: what a summary covers, the moment after or before
another, what is seen, what is said and seen of an entity, and the best sentence of the best evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as T
from .evidence import WRITTEN, marked

QUESTION = r"(?:^|[\s,;:])(why|what|how|when|where|who|which)\s+"
ON_SCREEN, PLACEHOLDER = "on-screen text near", "visual frame sampled at"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once and stands once in the expression, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _has(words: Column, of) -> Column:
    return F.arrays_overlap(words, T.words_in(of))


def content_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(T.ascii_words(text), lambda w: ~w.isin(terms.VISUAL_STOPWORDS) & (F.length(w) > 2)))


def _common(ws: Column, of) -> Column:
    return F.size(F.array_intersect(ws, T.words_in(of)))


# What a summary covers


def summary_score(text: Column) -> Column:
    """How much a text says about a topic: content and technical words, less administration, fillers and noise."""
    low = F.lower(text)
    singles = let(T.ascii_words(text), lambda raw: F.coalesce(F.try_divide(F.size(F.filter(raw, lambda w: F.length(w) == 1)), F.size(raw)), F.lit(0.0)))
    worth = let(content_terms(text), lambda ws: F.least(F.size(ws), F.lit(16)) / F.lit(8.0) + 0.45 * _common(ws, terms.GLOBAL_TOPIC_LABELS) - 0.7 * _common(ws, terms.GLOBAL_ADMIN_TERMS) - F.when(F.size(ws) < 3, 2.0).otherwise(0.0))
    return worth - 0.35 * T.count_contained(text, terms.GLOBAL_FILLER_PHRASES) - 3.0 * singles - F.when(F.startswith(low, F.lit(PLACEHOLDER)), 2.0).otherwise(0.0)


def summary_noise(text: Column) -> Column:
    return (_common(content_terms(text), terms.GLOBAL_ADMIN_TERMS) > 0) | (T.count_contained(text, terms.GLOBAL_FILLER_PHRASES) >= 2) | T.contains_any(F.lower(text), terms.GLOBAL_NOISE_PHRASES)


def _listed(labels: Column) -> Column:
    n = F.size(labels)
    several = F.concat(F.array_join(F.slice(labels, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.coalesce(F.get(labels, n - 1), F.lit("")))
    return F.when(n < 2, F.array_join(labels, "")).when(n == 2, F.array_join(labels, " and ")).otherwise(several)


def topic_labels(ws: Column) -> Column:
    """Labels of the technical words, in order and once; a label whose words are part of another's is left out."""
    names = F.create_map(*[F.lit(x) for pair in terms.GLOBAL_TOPIC_LABELS.items() for x in pair])
    named = F.array_distinct(F.transform(F.filter(ws, lambda w: w.isin(list(terms.GLOBAL_TOPIC_LABELS)) & ~w.isin(terms.GLOBAL_ADMIN_TERMS)), lambda w: F.try_element_at(names, w)))

    def inside(x: Column, y: Column) -> Column:
        a, b = F.split(x, " "), F.split(y, " ")
        return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) > 0)

    return let(named, lambda labels: F.filter(labels, lambda x: ~F.exists(labels, lambda y: inside(x, y))))


def topic_phrase(text: Column) -> Column:
    """The technical topics of a text, at most four, else its first words if it says enough; else an empty string."""
    ws = F.filter(T.ascii_words(text), lambda w: ~w.isin(terms.VISUAL_STOPWORDS) & ~w.isin(terms.GLOBAL_TOPIC_STOPWORDS) & (F.length(w) > 2))

    def of(ws: Column) -> Column:
        enough = (F.size(ws) >= 3) & (summary_score(text) > terms.GLOBAL_TOPIC_MIN_SCORE) & ~summary_noise(text)
        plain = F.when(enough, F.array_join(F.slice(ws, 1, 7), " ")).otherwise("")
        return let(F.slice(topic_labels(ws), 1, 4), lambda labels: F.when(F.size(labels) > 0, _listed(labels)).otherwise(plain))

    return let(ws, of)


def clean_snippet(text: Column) -> Column:
    out = F.regexp_replace(F.btrim(text), r"(?i)^(but\s+)?(what|the thing)\s+is\s+interesting\s+is\s+that\s+", "")
    out = F.regexp_replace(out, r"(?i)^(but\s+)?the\s+interesting\s+thing\s+is\s+that\s+", "")
    return F.btrim(F.btrim(F.regexp_replace(out, r"\s+", " ")), F.lit(" ,;:."))


def cut_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(" ,"))), lambda s: s != "")


def first_best(items: Column, *keys) -> Column:
    """The first of the items with the largest keys; null of none. Keys are functions of an item."""
    ranked = F.transform(items, lambda x, i: F.struct(*[(-k(x)).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), x.alias("x")))
    return F.array_min(ranked)["x"]


def snippet(text: Column) -> Column:
    """What a piece of evidence contributes to a summary: eight words on screen, else its most telling sentence."""
    shown = F.array_join(F.slice(F.filter(F.split(F.regexp_replace(text, r"(?s)^[^:]*:", ""), r"\s+"), lambda w: w != ""), 1, 8), " ")
    best = first_best(cut_sentences(text), lambda s: (topic_phrase(s) != "").cast("int"), lambda s: F.round(summary_score(s), 9))
    return clean_snippet(F.when(F.startswith(F.lower(F.btrim(text)), F.lit(ON_SCREEN)), shown).otherwise(F.coalesce(best, text)))


def topic(snip: Column) -> Column:
    thin = summary_noise(snip) | (summary_score(snip) <= terms.GLOBAL_TOPIC_MIN_SCORE)
    return F.when(snip == "", "").otherwise(F.coalesce(F.nullif(topic_phrase(snip), F.lit("")), F.when(thin, "").otherwise(F.rtrim(snip, F.lit(" .")))))


def agenda_topics(text: Column) -> Column:
    """Topics of a slide that lists what today brings, in order."""
    shown = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(text, r"(?s)^[^:]*:", "")), r"\s+", " "))
    low = F.lower(shown)
    agenda = F.startswith(F.lower(text), F.lit(ON_SCREEN)) & F.contains(low, F.lit("today")) & (T.contains_any(low, ["lecture", "agenda", "overview"]) | F.contains(shown, F.lit("*")))
    marks = F.lit(" -•*:;,.")
    pieces = F.filter(F.transform(F.split(F.regexp_replace(shown, r"(?i)^today\s*:?\s*", ""), r"\s+\*\s+|[•·]\s+|\s+-\s+"), lambda p: F.btrim(p, marks)), lambda p: p != "")

    def cleaned(p: Column) -> Column:
        p = F.regexp_replace(clean_snippet(p), r"(?i)^lecture\s+\d+\s*", "")
        p = F.regexp_replace(F.regexp_replace(p, r"\b([Cc])ont\s+eptual\b", "$1onceptual"), r"\b([Cc])oncept\s+ual\b", "$1onceptual")
        return F.btrim(F.btrim(F.regexp_replace(p, r"\s+", " ")), F.lit(" -:;,."))

    technical = lambda p: _common(content_terms(p), terms.GLOBAL_TOPIC_LABELS) > 0
    kept = F.filter(F.transform(pieces, cleaned), lambda p: (p != "") & (technical(p) | (~summary_noise(p) & (summary_score(p) > 0))))
    return F.when(agenda, F.array_distinct(kept)).otherwise(F.array().cast("array<string>"))


def _covers(topics: Column) -> Column:
    listed = F.array_join(F.transform(topics, lambda x: F.rtrim(x, F.lit(" ."))), "; ")
    return F.concat(F.lit("The video covers: "), F.nullif(listed, F.lit("")), F.lit("."))


def summary_answer(items: Column) -> Column:
    """items: struct(t, id, agenda, topic, gain). Agenda topics in order of time; else the strongest topics that are not
    much like a stronger one, in order of time."""
    planned = F.slice(F.flatten(F.transform(F.array_sort(items), lambda x: x["agenda"])), 1, terms.MAX_GLOBAL_TOPICS)
    telling = F.filter(items, lambda x: (x["topic"] != "") & (x["gain"] > 0))
    ranked = F.transform(F.array_sort(F.transform(telling, lambda x: F.struct((-x["gain"]).alias("g"), x["t"].alias("t"), x["id"].alias("id"), x["topic"].alias("topic"), content_terms(x["topic"]).alias("ws")))), lambda x: x)

    def add(acc: Column, x: Column) -> Column:
        alike = lambda y: F.coalesce(F.try_divide(F.size(F.array_intersect(x["ws"], y["ws"])), F.least(F.size(x["ws"]), F.size(y["ws"]))), F.lit(0.0)) >= terms.GLOBAL_TOPIC_OVERLAP
        return F.when(F.exists(acc, alike), acc).otherwise(F.array_append(acc, x))

    kept = let(ranked, lambda r: F.aggregate(r, F.slice(r, 1, 0), add))
    strongest = F.array_sort(F.transform(F.slice(kept, 1, terms.MAX_GLOBAL_TOPICS), lambda x: F.struct(x["t"], x["id"], x["topic"])))
    return F.coalesce(_covers(planned), _covers(F.transform(strongest, lambda x: x["topic"])))


# Sentences


def enumerated(query: Column, ss: Column) -> Column:
    """How-questions about ideas take an enumeration: the sentence from "One," on, with those of two and three after it."""
    asks = F.contains(F.concat(F.lit(" "), F.lower(query), F.lit(" ")), F.lit(" how ")) | F.startswith(F.btrim(F.lower(query)), F.lit("how"))
    asks = asks & _has(T.ascii_words(query), terms.ENUMERATED_TOPICS)

    def from_here(s: Column, i: Column) -> Column:
        step = lambda acc, x: F.when(((F.size(acc) == 1) & F.contains(F.lower(x), F.lit("two,"))) | ((F.size(acc) == 2) & F.contains(F.lower(x), F.lit("three,"))), F.array_append(acc, F.btrim(x))).otherwise(acc)
        three = lambda one: let(F.aggregate(F.slice(ss, i + 2, 2), F.array(one), step), lambda x: F.when(F.size(x) >= 3, F.array_join(x, " ")))
        found = let(F.btrim(F.regexp_replace(s, r"(?i)^.*?(?=\bOne,)", "")), lambda one: F.when(one != "", F.when(F.contains(F.lower(one), F.lit("three,")), one).otherwise(three(one))))
        return F.when(F.contains(F.lower(s), F.lit("one,")), found)

    return F.when(asks, F.get(F.filter(F.transform(ss, from_here), lambda x: x.isNotNull()), F.lit(0)))


def followup(query: Column, ss: Column, best: Column) -> Column:
    """Questions for a mistake take the answer that follows a sentence which only leads to it."""
    asks = F.contains(F.lower(query), F.lit("what")) & _has(T.ascii_words(query), terms.FOLLOWUP_TOPICS) & T.contains_any(F.lower(best), terms.SETUP_PHRASES)
    after = F.slice(ss, F.array_position(ss, best).cast("int") + 1, 4)
    found = F.get(F.filter(after, lambda x: T.contains_any(F.lower(x), terms.FOLLOWUP_PHRASES)), F.lit(0))
    whole = lambda s: let(F.regexp_replace(F.btrim(s), r"(?i)^they ", ""), lambda bare: F.concat(F.lit("Startups fail when they "), F.lower(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30)))
    unnamed = lambda s: F.array_contains(T.ascii_words(query), "startups") & ~F.contains(F.lower(s), F.lit("startup"))
    return F.when(asks, let(found, lambda s: F.when(unnamed(s), whole(s)).otherwise(s)))


def alike(query: Column, text: Column) -> Column:
    return let(T.tokens(query), lambda a: let(T.tokens(text), lambda b: T.jaccard(a, b)))


def asks_why(query: Column) -> Column:
    return F.startswith(F.lower(F.btrim(query)), F.lit("why"))


def best_sentence(query: Column, text: Column) -> Column:
    """An enumeration or follow-up if the question is of that kind, else the sentence most like the question; a why
    question looks for reasons too. Of a text without sentences, all of it."""
    score = lambda s: F.round(alike(query, s) + F.when(asks_why(query), 0.35 * T.count_contained(s, terms.WHY_ANSWER_TERMS)).otherwise(0.0), 9)

    def of(text: Column) -> Column:
        chosen = lambda ss: let(first_best(ss, score), lambda best: F.coalesce(enumerated(query, ss), followup(query, ss, best), best, text))
        return let(cut_sentences(text), chosen)

    return let(F.btrim(text), of)


# What is seen, and what is said of it


def seen_target(query: Column) -> Column:
    ws = F.filter(T.ascii_words(query), lambda w: ~w.isin(terms.VISUAL_STOPWORDS))
    return F.when(F.size(ws) > 0, F.array_join(ws, " ")).otherwise("the requested visual target")


def time_span(x: Column) -> Column:
    a, b = x["start"], x["stop"]
    two = F.format_string(" from %.2fs to %.2fs", F.least(a, b), F.greatest(a, b))
    return F.when(a.isNull() | b.isNull(), F.format_string(" near %.2f seconds", x["t"])).when(a == b, F.format_string(" near %.2f seconds", a)).otherwise(two)


def _of(items: Column, modality: str) -> Column:
    return F.filter(items, lambda x: x["modality"] == modality)


def seen_answer(query: Column, intent: Column, items: Column) -> Column:
    ws, low = T.ascii_words(query), F.btrim(F.lower(query))
    placed = low.rlike("^(where|when) ") & (F.size(F.array_except(ws, T.words_in(terms.VISUAL_STOPWORDS))) > 0)
    asks = (intent != "mixed_av") & ~marked(F.btrim(query), WRITTEN) & (_has(ws, terms.SEEN_WORDS) | placed)
    best = first_best(_of(items, "visual"), lambda x: x["s_visual"], lambda x: x["relevance"], lambda x: x["z"])
    return F.when(asks, let(best, lambda x: F.when(x.isNotNull(), F.concat(F.lit("Visual evidence shows "), seen_target(query), time_span(x), F.lit(".")))))


def entity_answer(query: Column, items: Column) -> Column:
    target, own = seen_target(query), F.array_except(T.ascii_words(query), T.words_in(terms.VISUAL_STOPWORDS))
    asks = ~F.btrim(F.lower(query)).rlike(QUESTION) & ~marked(F.btrim(query), WRITTEN) & (F.size(F.array_distinct(F.split(target, " "))) <= 5)
    seen = first_best(_of(items, "visual"), lambda x: x["s_visual"], lambda x: x["relevance"], lambda x: x["z"], lambda x: -x["rank"])
    said = F.filter(_of(items, "audio"), lambda x: F.arrays_overlap(own, T.ascii_words(x["text"])))
    said = first_best(said, lambda x: F.round(alike(query, x["text"]), 9), lambda x: x["relevance"], lambda x: x["z"], lambda x: -x["rank"])
    shows = let(seen, lambda x: F.when(x.isNotNull(), F.concat(F.lit("visual evidence shows "), target, time_span(x))))
    mentions = let(said, lambda x: F.when(x.isNotNull(), F.concat(F.lit("transcript evidence mentions "), target, time_span(x), F.lit(": "), F.nullif(best_sentence(query, x["text"]), F.lit("")))))
    parts = F.nullif(F.array_join(F.array(shows, mentions), "; "), F.lit(""))
    ended = lambda text: F.when(text.rlike(r"[.?!]$"), text).otherwise(F.concat(text, F.lit(".")))
    return F.when(asks, let(F.concat(F.lit("Selected evidence indicates that "), parts), ended))


# The best evidence


def target_score(query: Column, x: Column, items: Column) -> Column:
    """Where evidence lies in time to what the question says came first."""
    low = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    after, before = F.contains(low, F.lit(" after ")), F.contains(low, F.lit(" before "))
    opens = T.contains_any(low, [" opening ", " beginning ", " first ", " start "])
    first = F.array_min(F.transform(items, lambda y: y["t"]))
    clause = F.element_at(F.split(low, F.when(after, F.lit(" after ")).otherwise(F.lit(" before ")), 2), -1)
    anchor = F.filter(T.ascii_words(clause), lambda w: ~w.isin("a", "an", "and", "the", "this", "that", "what", "which"))
    found = F.transform(F.filter(items, lambda y: F.arrays_overlap(anchor, T.ascii_words(y["text"]))), lambda y: y["t"])
    side = lambda times: F.when(after, x["t"] > F.array_max(times)).otherwise(x["t"] < F.array_min(times))
    placed = let(found, lambda times: F.when(F.size(times) == 0, 0.0).when(F.arrays_overlap(anchor, T.ascii_words(x["text"])), -0.4).when(side(times), 0.6).otherwise(0.0))
    return F.when(after | before, placed).when(opens, F.greatest(1.5 - F.greatest(x["t"] - first, F.lit(0.0)) / 60.0, F.lit(-0.5))).otherwise(0.0)


def extracted_answer(query: Column, items: Column) -> Column:
    low = F.btrim(F.lower(query))
    spoken = F.filter(_of(items, "audio"), lambda x: ~F.startswith(F.lower(x["text"]), F.lit(PLACEHOLDER)))
    told = F.filter(items, lambda x: ~F.lower(x["text"]).rlike(f"^({PLACEHOLDER}|{ON_SCREEN})"))
    pool = F.when(marked(F.btrim(query), WRITTEN), items).when(low.rlike(QUESTION) & (F.size(spoken) > 0), spoken).otherwise(told)
    score = lambda x: F.round(alike(query, x["text"]) + F.when(asks_why(query), 0.25 * T.count_contained(x["text"], terms.WHY_ANSWER_TERMS)).otherwise(0.0) + target_score(query, x, items), 9)
    worded = lambda s: F.when(~asks_why(query) | F.lower(F.btrim(s)).rlike("^(because|he|she|they|the) "), s).otherwise(F.concat(F.lit("The evidence suggests: "), F.btrim(s)))
    return let(F.nullif(best_sentence(query, first_best(pool, score)["text"]), F.lit("")), worded)


@lru_cache(1)
def _expressions(application: str) -> tuple[dict[str, Column], Column]:
    """(columns of a row of evidence, the answer of a question): built once, since they name columns and no table."""
    summary, query, intent, items = F.col("intent") == "global_summary", F.col("query"), F.col("intent"), F.col("items")
    shown, snip = F.when(F.col("modality") == "audio", 0.2).otherwise(0.0), F.col("snippet")
    of_row = {
        "snippet": F.when(summary, snippet(F.col("text"))), "agenda": F.when(summary, agenda_topics(F.col("text"))), "topic": F.when(summary, topic(snip)),
        "gain": F.when(F.coalesce(snip, F.lit("")) != "", F.round(summary_score(snip) + shown, 9)),
    }
    told = F.transform(items, lambda x: F.struct(x["t"], x["id"], x["agenda"], x["topic"], x["gain"]))
    branches = {
        "summary": F.when(summary, summary_answer(told)), "temporal": F.when(F.col("target_text").isNotNull(), F.nullif(best_sentence(query, F.col("target_text")), F.lit(""))),
        "seen": seen_answer(query, intent, items), "entity": entity_answer(query, items), "extracted": extracted_answer(query, items),
    }

    def said(name: str, text: Column) -> Column:
        return let(text, lambda a: F.when(a.isNotNull(), F.struct(F.lit(name).alias("branch"), a.alias("answer"))))

    return of_row, F.inline_outer(F.array(F.coalesce(*[said(*x) for x in branches.items()])))


def answers(evidence: DataFrame, group: list[str], targets: DataFrame | None = None) -> DataFrame:
    """(group, query, intent, id, rank, t, start, stop, modality, text, s_visual, relevance, z) and, for questions about the
    order of moments, (group, target_text) -> (group, branch, answer); both null where no branch answers.

    Nothing about a summary is computed for other questions, and no later branch for a question that is answered."""
    of_row, answer = _expressions(evidence.sparkSession.sparkContext.applicationId)
    rows = evidence
    for name, column in of_row.items():  # one after another: those after the snippet read it
        rows = rows.withColumn(name, column)
    fields = ["rank", "id", "t", "start", "stop", "modality", "text", "s_visual", "relevance", "z", "agenda", "topic", "gain"]
    g = rows.groupBy(*group).agg(F.first("query").alias("query"), F.first("intent").alias("intent"), F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    g = g.join(targets, group, "left") if targets is not None else g.withColumn("target_text", F.lit(None).cast("string"))
    return g.select(*group, answer)
