"""Text functions as Column expressions: all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words_in(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ascii_words(text) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z0-9]+)"), F.lit(1))


def tokens(text) -> Column:
    """Distinct words without stopwords."""
    return F.array_except(ascii_words(text), words_in(terms.STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def text_similarity(a, b) -> Column:
    return jaccard(tokens(a), tokens(b))


def lexical_relevance(query_tokens: Column, text_tokens: Column, saliency: Column | None = None) -> Column:
    """Saliency if there is one; else three quarters of the share of the query's tokens found and one of the text's."""
    shared = F.size(F.array_intersect(query_tokens, text_tokens))
    score = F.when((F.size(query_tokens) == 0) | (F.size(text_tokens) == 0), F.lit(0.0)).otherwise(0.75 * shared / F.size(query_tokens) + 0.25 * shared / F.size(text_tokens))
    return score if saliency is None else F.coalesce(saliency, score)


def time_kernel(a: Column, b: Column, sigma: float) -> Column:
    d = a - b
    return F.exp(-(d * d) / (sigma * sigma)) if sigma > 0 else F.lit(0.0)


def normalize_query(q) -> Column:
    return F.trim(F.regexp_replace(col(q), r"\s+", " "))


def contains_any(text: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def count_contained(text, phrases) -> Column:
    """How many of the phrases the lower-cased text contains."""
    low = F.lower(col(text))
    return sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def query_intent(q) -> Column:
    """struct(intent, reason): ordered rules over the question's words."""
    low, ws = F.lower(col(q)), ascii_words(q)
    has = lambda ts: F.arrays_overlap(ws, words_in(ts))
    speech, visual, temporal, sound = has(terms.SPEECH_TERMS), has(terms.VISUAL_TERMS), has(terms.TEMPORAL_TERMS), has(terms.SOUND_TERMS)
    whole, counting = has(terms.GLOBAL_TERMS), has(terms.COUNTING_TERMS) | F.contains(low, F.lit("how many"))
    conceptual = has(terms.CONCEPTUAL_TERMS) | (has(["what", "how"]) & ~visual)
    negative = has(terms.NEGATIVE_TERMS) | contains_any(low, terms.NEGATIVE_PHRASES)
    rules = [
        (F.size(ws) == 0, "mixed_av", "blank"),
        (negative, "negative_evidence", "negative"),
        (counting & ~speech, "counting_comparison", "counting"),
        (whole & ~(speech | visual | sound), "global_summary", "global_only"),
        (visual & speech & ~temporal & contains_any(low, terms.SCREEN_TEXT_PHRASES), "visual_object_action", "screen_text"),
        (speech & visual, "mixed_av", "speech_visual"),
        (temporal & (speech | visual | sound), "temporal_before_after", "temporal"),
        (conceptual & ~(visual | sound), "speech_semantic", "conceptual"),
        (speech, "speech_semantic", "speech"),
        (sound, "sound_event", "sound"),
        (visual, "visual_object_action", "visual"),
        (temporal, "temporal_before_after", "temporal"),
        (whole, "global_summary", "global"),
    ]
    answer = lambda i, r: F.struct(F.lit(i).alias("intent"), F.lit(terms.INTENT_REASONS[r]).alias("reason"))
    out = None
    for cond, intent, reason in rules:
        out = F.when(cond, answer(intent, reason)) if out is None else out.when(cond, answer(intent, reason))
    return out.otherwise(answer("mixed_av", "none"))


ASPECT_SPLIT = r"(?i)\b(?:and|then|while|before|after|when)\b|[,;]"


def aspect_modality(text) -> Column:
    low, ws = F.lower(col(text)), ascii_words(text)
    visual, audio = F.arrays_overlap(ws, words_in(terms.ASPECT_VISUAL_TERMS)), F.arrays_overlap(ws, words_in(terms.ASPECT_AUDIO_TERMS))
    return F.when(contains_any(low, terms.SCREEN_TEXT_PHRASES), "visual").when(visual & ~audio, "visual").when(audio & ~visual, "audio").otherwise("both")


def temporal_query(q) -> Column:
    """struct(direction, target, anchor) of the first after/before, or null."""
    parts = [F.regexp_extract(col(q), r"(?is)^(.*?)\b(after|before)\b(.*)$", i) for i in (1, 2, 3)]
    target, anchor = F.btrim(parts[0], F.lit(" ,?.")), F.btrim(parts[2], F.lit(" ,?."))
    return F.when((parts[1] != "") & (target != "") & (anchor != ""), F.struct(F.lower(parts[1]).alias("direction"), target.alias("target"), anchor.alias("anchor")))


def noisy_candidate(text) -> Column:
    """Eight words or more and either many non-ASCII characters or hardly any common word."""
    ws = F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z]+)"), F.lit(1))
    ascii_share = F.length(F.regexp_replace(col(text), r"[^\x00-\x7F]", "")) / F.greatest(F.length(col(text)), F.lit(1))
    common = F.size(F.filter(ws, lambda w: F.array_contains(words_in(terms.COMMON_TRANSCRIPT_WORDS), w)))
    return (F.size(ws) >= 8) & ((ascii_share < 0.92) | (F.try_divide(common, F.size(ws)) < 0.08))


def ocr_match(query, ocr) -> Column:
    q = F.array_except(ascii_words(query), words_in(sorted({*terms.COMMON_TRANSCRIPT_WORDS, *terms.VISUAL_QUERY_WORDS})))
    o = F.array_distinct(ascii_words(ocr))
    return F.when((F.size(q) == 0) | (F.size(o) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(q, o)) / F.size(q))


def collapse(text) -> Column:
    return F.trim(F.regexp_replace(col(text), r"[ \t\n\x0B\f\r]+", " "))


def plausible_ocr(text) -> Column:
    """The collapsed text if it looks like writing, else null. Clean characters: letters, digits, blanks, punctuation."""
    t = collapse(text)
    ws = F.regexp_extract_all(t, F.lit("([A-Za-z][A-Za-z'-]*)"), F.lit(1))
    clean = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s.,:;'\"\-!?()&/%$#@]", ""))
    long_ = F.size(F.filter(ws, lambda w: (F.length(w) >= 3) | F.array_contains(words_in(terms.OCR_FUNCTION_WORDS), F.lower(w))))
    total = F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w))
    ok = (F.length(t) >= 4) & (F.size(ws) >= 2) & (clean / F.greatest(F.length(t), F.lit(1)) >= 0.8) & (F.try_divide(long_, F.size(ws)) >= 0.7) & (F.try_divide(total, F.size(ws)) >= 3.5)
    return F.when(ok, t)


def information_score(text) -> Column:
    """Blank-separated tokens with three ASCII letters or more."""
    return F.size(F.filter(F.split(collapse(text), " "), lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 3))


def noisy_transcript(text) -> Column:
    """Two filler phrases, or few distinct longer words, or a fragment."""
    t = F.lower(collapse(text))
    phrases = sum((F.contains(t, F.lit(p)).cast("int") for p in ["a lot of", "and then", "basically", "kind of", "so this is", "this role", "we have"]), F.lit(0))
    ws = F.transform(F.split(t, " "), lambda w: F.btrim(w, F.lit(".,!?;:()[]{}")))
    content = F.filter(ws, lambda w: F.length(w) > 3)
    unique = F.size(F.array_distinct(content)) / F.greatest(F.size(content), F.lit(1))
    broken = (F.size(content) < 2) | F.endswith(t, F.lit(" of")) | F.endswith(t, F.lit(" a")) | F.endswith(t, F.lit(" the"))
    return (t == "") | (phrases >= 2) | (unique < 0.45) | broken


def has_transcript(text) -> Column:
    t = F.lower(collapse(text))
    return (t != "") & ~F.startswith(t, F.lit("visual frame sampled at")) & ~F.startswith(t, F.lit("on-screen text near"))


def term_recall(expected: Column, text) -> Column:
    """Share of the expected terms that the text contains; 1 when none is expected."""
    t = F.filter(F.transform(expected, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(F.size(t) == 0, F.lit(1.0)).otherwise(F.size(F.filter(t, lambda x: F.contains(F.lower(col(text)), x))) / F.size(t))


def letter(text) -> Column:
    """The first standalone A-D, or an empty string."""
    return F.regexp_extract(F.upper(col(text)), r"\b([ABCD])\b", 1)


def token_proxy(text) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4).cast("int"))


def cache_key(parts: list[Column], n: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n)


def normalize_code(code, prefix: str = "GLIM", length: int = 16, alphabet: str = "0123456789ABCDEFGHJKMNPQRSTVWXYZ") -> Column:
    """Typed access codes: case, separators and the prefix do not count, O reads 0, I and L read 1; null if impossible."""
    raw = F.regexp_replace(F.upper(col(code)), "[^0-9A-Z]", "")
    raw = F.when(F.startswith(raw, F.lit(prefix)) & (F.length(raw) == len(prefix) + length), F.substring(raw, len(prefix) + 1, length)).otherwise(raw)
    raw = F.translate(raw, "OIL", "011")
    return F.when(raw.rlike(f"^[{alphabet}]{{{length}}}$"), raw)


def answer_form(text) -> Column:
    return F.array_join(ascii_words(text), " ")


CHOICE_STOPWORDS = "a an and are because is it of or that the this to with".split()


def resolve_choice(value: Column, choices: Column) -> Column:
    """Index of the choice that a normalised answer means: its letter, a letter after "answer is", the first choice
    contained either way, or the largest share of a choice's words if it is 0.6 or more; else null."""
    place = lambda letter_: F.when(F.length(letter_) == 1, F.ascii(letter_) - 97)
    inside = lambda i: F.when(i < F.size(choices), i)
    forms = F.transform(choices, lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), " "))
    bare = lambda c: F.regexp_replace(c, r"^[a-z]\s+", "")
    holds = lambda c: (value == c) | F.contains(value, c) | ((bare(c) != "") & ((value == bare(c)) | F.contains(value, bare(c)) | F.contains(bare(c), value)))
    first = F.array_min(F.filter(F.transform(forms, lambda c, i: F.when(holds(c), i)), lambda i: i.isNotNull()))
    content = lambda s: F.array_except(F.filter(F.split(s, " "), lambda w: w != ""), words_in(CHOICE_STOPWORDS))
    share = lambda c: F.coalesce(F.try_divide(F.size(F.array_intersect(content(value), content(bare(c)))), F.size(content(bare(c)))), F.lit(0.0))
    best = F.array_max(F.transform(forms, lambda c, i: F.struct(share(c).alias("s"), (-i).alias("i"))))
    return F.coalesce(
        inside(place(F.when(value.rlike("^[a-z]$"), value))),
        inside(place(F.regexp_extract(value, r"\b(?:answer|option|choice|letter)(?:\s+is)?\s+([a-z])\b", 1))),
        first,
        F.when(best["s"] >= 0.6, -best["i"]),
    )


def answer_score(predicted: Column, expected: Column, choices: Column) -> Column:
    """1 or 0; null when nothing is expected."""
    p, e = answer_form(predicted), answer_form(expected)
    want = F.when(F.size(choices) > 0, resolve_choice(e, choices))
    return (
        F.when(expected.isNull() | (F.trim(expected) == ""), F.lit(None).cast("double"))
        .when(predicted.isNull() | (F.trim(predicted) == ""), 0.0)
        .when(p == e, 1.0)
        .when(want.isNotNull(), F.when(F.coalesce(resolve_choice(p, choices) == want, F.lit(False)), 1.0).otherwise(0.0))
        .otherwise(F.contains(p, e).cast("double"))
    )


def sentences(text) -> Column:
    """Cut after . ! ? before white space; no blank ones."""
    return F.filter(F.transform(F.split(col(text), r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def cited_ranks(answer, n) -> Column:
    """Ranks from 1 to n that an answer cites, in prose ("evidence 2") or in a list ("Evidence: 1, 3"), in order."""
    low = F.lower(col(answer))
    prose = F.regexp_extract_all(low, F.lit(r"evidence\s+(\d+)"), F.lit(1))
    listed = F.regexp_extract_all(F.regexp_extract(low, r"evidence:\s*([\d,\s]+)", 1), F.lit(r"(\d+)"), F.lit(1))
    ranks = F.filter(F.transform(F.concat(prose, listed), lambda v: v.try_cast("int")), lambda v: (v >= 1) & (v <= n))
    return F.array_sort(F.array_distinct(ranks))


def keyword_overlap(keywords, text) -> Column:
    """Share of the keywords that a text has, phrases as they stand and words as words."""
    low = F.lower(col(text))
    ws = F.array_except(ascii_words(col(text)), words_in(terms.KEYWORD_STOP))
    hits = [F.contains(low, F.lit(k)) if " " in k or "'" in k else F.array_contains(ws, k) for k in keywords]
    return sum((h.cast("int") for h in hits), F.lit(0)) / F.lit(float(len(keywords)))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def severity(text) -> Column:
    out = F.lit(None).cast("string")
    for level, ws in reversed(terms.SEVERITY.items()):
        out = F.when(F.arrays_overlap(ascii_words(col(text)), words_in(ws)), level).otherwise(out)
    return out


def requester(text) -> Column:
    """The first mention of someone who may speak or ask, by pattern order."""
    low = F.lower(col(text))
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 0), F.lit("")) for p in terms.REQUESTER_PATTERNS])


def sentence_with(text, keywords) -> Column:
    """The sentence with the largest share of the keywords, the first of equals, in 180 characters; null if none has any."""
    parts = F.filter(F.transform(F.split(col(text), "[.!?]+"), F.trim), lambda s: s != "")
    best = F.array_max(F.transform(parts, lambda s, i: F.struct(keyword_overlap(keywords, s).alias("n"), (-i).alias("i"), s.alias("s"))))
    return F.when(best["n"] > 0, shortened(best["s"], 180))


def suggested_response(text, label: Column) -> Column:
    out = F.when(F.arrays_overlap(ascii_words(col(text)), words_in(terms.REQUEST_WORDS)), terms.REQUEST_RESPONSE)
    for names, reply in reversed(terms.RESPONSES):
        out = F.when(contains_any(F.lower(label), names), reply).otherwise(out)
    return out
