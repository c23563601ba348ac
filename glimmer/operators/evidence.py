"""Evidence support, pruning, consolidation, warnings and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as T
from ..functions.terms import EXACT_TEXT, SPOKEN, WRITTEN

#: Thresholds of citations and of redundant evidence.
CITED_SUPPORT = 0.035
CITED_RELATIVE_SUPPORT = 0.35
REDUNDANT_SIMILARITY = 0.6
#: SQL over two rows: much the same words, or spans of one modality that overlap by half of the shorter.
ALIKE = f"size(array_intersect(x.toks, y.toks)) / greatest(1, size(array_union(x.toks, y.toks))) >= {REDUNDANT_SIMILARITY}D or (x.modality = y.modality and coalesce(try_divide(greatest(least(x.stop, y.stop) - greatest(x.start, y.start), 0D), least(x.stop - x.start, y.stop - y.start)), 0D) >= 0.5D)"


def marked(query: Column, words) -> Column:
    """Does the question hold one of the words between blanks?"""
    q = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    return T.contains_any(q, [f" {w} " for w in words])


def query_classes(query: Column, intent: Column) -> dict[str, Column]:
    first = intent == "speech_semantic"
    return {
        "transcript_first": first,
        "transcript_question": first & F.lower(query).rlike(r"(?:^|[\s,;:])(what|why|how|when|where|who|which)\s+"),
        "mixed_speech": (intent == "mixed_av") & marked(query, SPOKEN),
        "visual_text": marked(query, WRITTEN),
    }


def exact_text_answer(query: Column, answer: Column, strong_text: Column) -> Column:
    """Does the question ask for the words on screen, and does the answer give them, backed by strong on-screen text?"""
    q = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    asks = T.contains_any(q, [f" {p} " for p in EXACT_TEXT]) & ~T.contains_any(q, [f" {w} " for w in ("after", "before", "then", "next")])
    return asks & F.startswith(F.lower(answer), F.lit("on-screen text near")) & strong_text


def support(df: DataFrame) -> DataFrame:
    """(query, intent, answer, text, modality, relevance, z, anchor_t, anchor_score) -> the support scores and labels."""
    k = query_classes(F.col("query"), F.col("intent"))
    low = F.lower("text")
    ocr = F.startswith(low, F.lit("on-screen text near"))
    visual_only = F.startswith(low, F.lit("visual frame sampled at")) | ocr
    audio, visual = F.col("modality") == "audio", F.col("modality") == "visual"
    df = df.withColumns({
        "__c": T.tokens("text"), "__demote": k["transcript_first"] | k["mixed_speech"], "__vt": k["visual_text"],
    })
    df = df.withColumns({"s_answer": T.jaccard(T.tokens(F.coalesce("answer", F.lit(""))), F.col("__c")), "s_query": T.jaccard(T.tokens("query"), F.col("__c"))})
    a, q = F.col("s_answer"), F.col("s_query")
    seen = F.greatest("relevance", "z", q)
    seen = F.when(ocr, F.greatest(seen, q + 0.05)).otherwise(seen)
    seen = F.when(F.col("anchor_score") > 0, F.greatest(seen, F.least("anchor_score", F.lit(1.0)) * 0.5)).otherwise(seen)
    s_visual = F.when(~visual, 0.0).when(F.col("__demote"), F.least(q, F.lit(0.04))).when(F.col("__vt"), F.when(ocr, F.least(q, F.lit(0.2))).otherwise(0.0)).otherwise(F.least(seen, F.lit(1.0)))
    df = df.withColumns({"s_audio": F.when(audio & ~visual_only, 0.7 * a + 0.3 * q).otherwise(0.0), "s_ocr": F.when(ocr, 0.65 * a + 0.35 * q).otherwise(0.0), "s_visual": s_visual})
    anchor = F.least(F.greatest("anchor_score", F.lit(0.0)), F.lit(1.0))
    cross = F.when(F.col("anchor_t").isNull() & (F.col("anchor_score") <= 0), 0.0).when(visual, F.greatest(anchor, F.least(F.col("s_visual") + 0.1, F.lit(1.0)))).otherwise(F.greatest(anchor * 0.5, F.col("s_audio") * 0.25))
    df = df.withColumn("s_cross", cross).withColumn("__direct", F.greatest("s_audio", "s_ocr", "s_visual"))
    words = 0.7 * a + 0.3 * q
    score = F.when(F.col("__demote") & visual, F.greatest(words, F.least("s_cross", F.lit(0.04)))).otherwise(F.greatest(words, 0.75 * F.col("__direct") + 0.25 * F.col("s_cross")))
    df = df.withColumn("score", score)
    df = df.withColumn("support_label", F.when(F.col("score") >= 0.12, "strong").when(F.col("score") >= 0.05, "medium").otherwise("weak"))
    df = df.withColumn("grounding_label", F.when(F.col("__direct") >= 0.05, "direct").when((F.col("__direct") >= 0.03) | (F.col("s_cross") >= 0.03), "contextual").otherwise("weak"))
    return df.drop("__c", "__demote", "__vt", "__direct")


def prune(df: DataFrame, group: list[str], most: int = 4, least: int = 3) -> DataFrame:
    """Supported rows kept by score against the group's best; bounds are tighter for text and speech questions."""
    k = query_classes(F.col("query"), F.col("intent"))
    hi = F.least(F.lit(most), F.when(k["visual_text"] | k["mixed_speech"], 2).otherwise(most), F.when(k["transcript_question"], 1).otherwise(most))
    lo = F.least(F.lit(least), F.when(k["visual_text"] | k["mixed_speech"] | k["transcript_question"], 1).otherwise(least))
    w = W.partitionBy(*group)
    df = df.withColumns({"__hi": hi, "__lo": lo, "__n": F.count(F.lit(1)).over(w), "__r": F.row_number().over(w.orderBy(F.desc("score"), F.desc("relevance"), "t", "id"))})
    df = df.withColumn("__ok", F.col("score") >= F.greatest(F.lit(0.05), F.max("score").over(w) * 0.55))
    df = df.withColumn("__k", F.least(F.count_if("__ok").over(w), F.col("__hi")))
    kept = (F.col("__n") <= F.col("__hi")) | F.when(F.col("__k") < F.col("__lo"), F.col("__r") <= F.col("__lo")).otherwise(F.col("__r") <= F.col("__k"))
    return df.filter(kept).drop("__hi", "__lo", "__n", "__r", "__ok", "__k")


def drop_weak(df: DataFrame, group: list[str], least: int = 1) -> DataFrame:
    """Weakly grounded rows go if enough others stay."""
    w = W.partitionBy(*group)
    good = F.count_if(F.col("grounding_label") != "weak").over(w)
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("__all", (n <= least) | (good < least) | (good == n)).filter(F.col("__all") | (F.col("grounding_label") != "weak")).drop("__all")


def prune_to_citations(df: DataFrame, group: list[str], least: int = 1) -> DataFrame:
    """Supported rows (score, relevance, t, id) with ``cited``: those cited that pass the threshold stay, the best others
    above it fill up to as many as were cited; where they do not suffice all cited rows stay. Groups with fewer than
    ``least`` cited rows are left as they are."""
    w = W.partitionBy(*group)
    df = df.withColumn("__fine", F.col("score") >= F.greatest(F.lit(CITED_SUPPORT), CITED_RELATIVE_SUPPORT * F.max("score").over(w)))
    other = F.col("__fine") & ~F.col("cited")
    df = df.withColumns({
        "__cited": F.count_if("cited").over(w), "__good": F.count_if(F.col("cited") & F.col("__fine")).over(w), "__other": F.count_if(other).over(w),
        "__place": F.row_number().over(W.partitionBy(*group, other).orderBy(F.desc("score"), F.desc("relevance"), "t", "id")),
    })
    target = F.greatest(F.lit(least), F.col("__cited"))
    kept = F.when(F.col("__cited") < least, F.lit(True)).when(F.col("__good") + F.col("__other") < target, F.col("cited")).otherwise(F.col("__fine") & (F.col("cited") | (F.col("__place") <= target - F.col("__good"))))
    return df.filter(kept).drop("__fine", "__cited", "__good", "__other", "__place")


def first_fit(df: DataFrame, group: list[str], order: list[str], alike: str) -> DataFrame:
    """Rows join the first earlier-opened cluster that holds a row alike, else open one: an ordered fold, not
    components. ``alike`` is SQL over structs x (the row) and y (a member). Adds ``cluster``."""
    cols = [c for c in df.columns if c not in group]
    pool = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*cols).alias("row")))).alias("pool"))
    fold = f"""aggregate(transform(pool, p -> p.row),
        cast(array() as array<struct<cluster: int, row: {_struct_type(df, cols)}>>),
        (acc, x) -> array_append(acc, named_struct('cluster',
            coalesce(array_min(transform(filter(acc, m -> exists(array(m.row), y -> {alike})), m -> m.cluster)), coalesce(array_max(transform(acc, m -> m.cluster)), -1) + 1), 'row', x)))"""
    return pool.select(*group, F.explode_outer(F.expr(fold)).alias("m")).filter("m is not null").select(*group, F.col("m.cluster").alias("cluster"), "m.row.*")


def _struct_type(df: DataFrame, cols: list[str]) -> str:
    types = dict(df.dtypes)
    return "struct<" + ", ".join(f"`{c}`: {types[c]}" for c in cols) + ">"


def label_scores(df: DataFrame, labels: list[tuple[str, list[str]]]) -> DataFrame:
    """The best label of each text: its own words' overlap or its keywords', the larger; ties to the later name."""
    ws = F.array_except(T.ascii_words("text"), T.words_in(terms.KEYWORD_STOP))
    options = []
    for name, keywords in labels:
        own = [w for w in name.split() if w not in terms.KEYWORD_STOP]
        base = F.size(F.array_intersect(T.words_in(own), ws)) / F.lit(float(len(own)))
        allwords = sorted({*keywords, *own})
        options.append(F.struct(F.round(F.greatest(base, T.keyword_overlap(allwords, "text")), 9).alias("score"), F.lit(name).alias("label")))
    best = F.greatest(*options)
    return df.withColumn("__b", best).withColumns({"label": F.col("__b.label"), "label_score": F.col("__b.score")}).drop("__b")


def label_quality(cases: DataFrame, fields: int = 2) -> DataFrame:
    """(video_id, n, xs: items as structs turn, label, toks, conf, missing, a, z) -> rates and warning codes of each case."""
    k = F.size("xs")
    alike = f"""size(filter(xs, x -> exists(xs, y -> y.turn < x.turn and y.label = x.label
        and size(array_intersect(x.toks, y.toks)) / greatest(1, size(array_union(x.toks, y.toks))) >= {terms.DUPLICATE_ITEM_SIMILARITY}D)))"""
    total = lambda f: F.aggregate(F.transform("xs", f), F.lit(0.0), lambda s, x: s + x)
    r = cases.select(
        "video_id", "n", k.cast("long").alias("k"), (k / F.col("n")).alias("rate"), F.when(k < 2, 0.0).otherwise(F.try_divide(F.expr(alike), k)).alias("dup"),
        F.coalesce(F.try_divide(total(lambda x: x["missing"].cast("double")), k * fields), F.lit(0.0)).alias("weak"), F.coalesce(F.try_divide(total(lambda x: (x["z"] > x["a"]).cast("double")), k), F.lit(0.0)).alias("covered"),
        F.coalesce(F.try_divide(total(lambda x: x["conf"]), k), F.lit(0.0)).alias("conf"),
    )
    some = F.col("k") > 0
    rules = [
        ("no_items", (F.col("n") > 0) & ~some), ("over_extraction", (F.col("rate") > terms.MAX_EXTRACTION_RATE) & (F.col("n") >= 3)), ("high_duplicate_rate", F.col("dup") > terms.MAX_DUPLICATE_RATE),
        ("weak_fields", F.col("weak") > terms.MAX_WEAK_FIELD_RATE), ("weak_timestamps", some & (F.col("covered") < terms.MIN_TIMESTAMP_COVERAGE)), ("low_confidence", some & (F.col("conf") < terms.MIN_AVERAGE_CONFIDENCE)),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))
    names = {"rate": "extraction_rate", "dup": "duplicate_rate", "weak": "weak_field_rate", "covered": "timestamp_coverage_rate", "conf": "confidence"}
    return r.select("video_id", "n", "k", *[F.round(c, 6).alias(n) for c, n in names.items()], codes.alias("codes"))


def batch_cases(quality: DataFrame) -> DataFrame:
    """One result a case of a batch: counts, whether it passed (no error among its warnings) and the codes."""
    return quality.select("video_id", F.col("k").alias("item_count"), F.col("n").alias("evidence_count"), (~F.array_contains("codes", "no_items")).alias("quality_passed"), F.col("codes").alias("warning_codes"))


def should_retry(codes: Column, scorer: Column, current: Column, retry: Column, overridden: Column) -> Column:
    """Run transcription again with the stronger setting? Only for noisy transcripts of the speech scorer, with nothing
    overridden, and if the setting is stronger."""
    place = lambda q: F.array_position(T.words_in(terms.TRANSCRIPT_QUALITY), q)
    return F.array_contains(codes, "noisy_transcript_evidence") & (scorer == "whisper") & ~overridden & (place(retry) > place(current))


def smoke_failures(codes: Column, duration: Column, minimum: float, scorer: Column, expected: str) -> Column:
    """Quality failures, then a too short video, then a wrong audio scorer."""
    short = F.format_string(f"video duration %.2fs below required {minimum:.2f}s", duration)
    wrong = F.concat(F.lit("audio scorer "), F.coalesce(scorer, F.lit("unknown")), F.lit(f" did not match expected {expected}"))
    return F.concat(codes, F.array_compact(F.array(F.when(duration < minimum, short), F.when(~scorer.eqNullSafe(F.lit(expected)), wrong))))


def warnings(intent: Column, answer_words: Column, n: Column, backed: Column, noisy: Column, grounded: Column, strong: Column, reduction: Column) -> Column:
    """Codes of the quality gate, in order."""
    spoken = intent.isin("speech_semantic", "mixed_av", "sound_event", "global_summary")
    rules = [
        ("no_evidence", n == 0), ("weak_answer", answer_words < 6), ("missing_transcript_evidence", (backed == 0) & spoken), ("noisy_transcript_evidence", (backed > 0) & spoken & (F.try_divide(noisy, backed) >= 0.5)),
        ("ungrounded_evidence", (n > 0) & (grounded == 0)), ("weak_evidence_support", (n > 0) & (strong == 0)), ("low_token_reduction", reduction < 80.0),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))
