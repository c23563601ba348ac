"""Finalisation against a loop that handles one question at a time, with its own thresholds and rules written out."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from glimmer.functions import terms
from glimmer.operators import finalisation as N

STOP = set(terms.STOPWORDS)


def toks(text):
    return set(re.findall("[a-z0-9]+", (text or "").lower())) - STOP


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def support(x, answer):
    """Speech questions alone: (score, direct, cross)."""
    c = toks(x["text"])
    a, q = jac(toks(answer), c), jac(toks(x["query"]), c)
    audio = x["modality"] == "audio"
    s_audio, s_visual = (0.7 * a + 0.3 * q if audio else 0.0), (0.0 if audio else min(q, 0.04))
    direct = max(s_audio, s_visual)
    score = 0.7 * a + 0.3 * q if not audio else max(0.7 * a + 0.3 * q, 0.75 * direct)
    return score, direct


def grounding(x, answer):
    _, direct = support(x, answer)
    return "direct" if direct >= 0.05 else "contextual" if direct >= 0.03 else "weak"


def best_first(rows, answer):
    return sorted(rows, key=lambda x: (-support(x, answer)[0], -x["relevance"], x["t"], x["id"]))


def to_answer(rows, answer):
    if len(rows) <= 4:
        return rows
    order = best_first(rows, answer)
    bound = max(0.05, 0.55 * support(order[0], answer)[0])
    good = [x for x in order if support(x, answer)[0] >= bound][:4]
    return good if len(good) >= 3 else order[:3]


def to_citations(rows, answer):
    ranks = {int(v) for v in re.findall(r"evidence\s+(\d+)", answer.lower())}
    listed = re.search(r"evidence:\s*([\d,\s]+)", answer.lower())
    ranks |= {int(v) for v in re.findall(r"\d+", listed[1])} if listed else set()
    ranks = {r for r in ranks if 1 <= r <= len(rows)}
    if len(rows) <= 1 or not ranks:
        return rows
    cited = [x for i, x in enumerate(rows) if i + 1 in ranks]
    bound = max(0.035, 0.35 * max(support(x, answer)[0] for x in rows))
    good = [x for x in cited if support(x, answer)[0] >= bound]
    rest = [x for x in best_first(rows, answer) if support(x, answer)[0] >= bound and x not in good]
    filled = good + rest[: len(cited) - len(good)]
    return filled if len(filled) >= len(cited) else cited


def merged(rows, answer):
    clusters = []
    for x in rows:
        for c in clusters:
            if any(jac(toks(x["text"]), toks(y["text"])) >= 0.6 for y in c):
                c.append(x)
                break
        else:
            clusters.append([x])
    return [best_first(c, answer)[0] for c in clusters]


def grounded(rows, answer):
    good = [x for x in rows if grounding(x, answer) != "weak"]
    return rows if len(rows) <= 1 or not good or len(good) == len(rows) else good


def answer_of(rows):
    """Cites every second row; says nothing on evidence without words of the question."""
    said = [x for x in rows if toks(x["query"]) & toks(x["text"])]
    if not said:
        return None
    return said[0]["text"] + (" Evidence: " + ", ".join(str(i + 1) for i in range(0, len(rows), 2)) if len(rows) % 3 else " see evidence 1 and evidence 40")


def loop(rows):
    def order(r):
        return sorted(r, key=lambda x: (x["t"], x["id"]))

    rows = order(rows)
    answer, rounds = answer_of(rows), 1
    for step, again in ((to_answer, False), (to_citations, True), (merged, True), (grounded, False)):
        if answer is None:
            continue
        kept = order(step(rows, answer))
        if len(kept) != len(rows):
            rows, answer, rounds = kept, answer_of(kept), rounds + 1
            if again and answer is not None:
                rows = order(to_citations(rows, answer))
    return rows, answer, rounds


def answerer(df):
    item = "struct(t, id, text, query)"
    g = df.groupBy("g").agg(F.expr(f"array_sort(collect_list({item}))").alias("xs"))
    stop = ", ".join(f"'{w}'" for w in sorted(STOP))
    words = "array_except(regexp_extract_all(lower({}), '([a-z0-9]+)', 1), array({}))"
    said = f"filter(xs, x -> arrays_overlap({words.format('x.query', stop)}, {words.format('x.text', stop)}))[0].text"
    cites = "if(size(xs) % 3 <> 0, concat(' Evidence: ', array_join(transform(filter(sequence(1, size(xs)), i -> i % 2 = 1), i -> string(i)), ', ')), ' see evidence 1 and evidence 40')"
    return g.select("g", F.expr(f"concat(get(filter(xs, x -> arrays_overlap({words.format('x.query', stop)}, {words.format('x.text', stop)})), 0).text, {cites})").alias("answer"))


def test_finalisation_as_looped(spark):
    rng = random.Random(21)
    vocabulary = "river stone lamp forest glass engine window paper cloud metal garden music".split()
    rows = []
    for g in range(160):
        query = " ".join(rng.sample(vocabulary, 3))
        texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 7))) for _ in range(4)]
        for i in range(rng.randrange(1, 9)):
            rows.append({"g": g, "id": f"i{i}", "t": float(rng.randrange(6) * 100 + i), "query": query, "intent": "speech_semantic", "text": rng.choice([rng.choice(texts), " ".join(rng.choice(vocabulary) for _ in range(5))]), "modality": rng.choice(["audio", "audio", "visual"]), "relevance": rng.randrange(9) / 8, "z": 0.0})
    for r in rows:
        r["start"], r["stop"], r["anchor_t"], r["anchor_score"] = r["t"], r["t"] + 1.0, None, 0.0
    names = ["g", "id", "t", "start", "stop", "query", "intent", "text", "modality", "relevance", "z", "anchor_t", "anchor_score"]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "g long, id string, t double, start double, stop double, query string, intent string, text string, modality string, relevance double, z double, anchor_t double, anchor_score double")
    got = {}
    for r in N.finalise(df, ["g"], answerer).orderBy("g", "rank").collect():
        got.setdefault(r.g, ([], r.answer, r.rounds))[0].append(r.id)
    seen = Counter()
    for g in range(160):
        kept, answer, rounds = loop([r for r in rows if r["g"] == g])
        assert got[g] == ([x["id"] for x in kept], answer, rounds), g
        seen[rounds] += 1
    assert {1, 2, 3} <= set(seen), seen
