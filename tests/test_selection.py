"""Folds against plain loops, and rules on small literal pools."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glimmer.functions import terms
from glimmer.functions import text as T
from glimmer.operators import evidence, scoring, selection
from glimmer.streaming.limits import decide

POOL = "g int, id string, t double, modality string, z double, anchor_t double, toks array<string>"


def greedy(pool, k, lam, sigma):
    """MMR by a plain loop, redundant audio neighbours dropped."""
    left, out = sorted(pool, key=lambda r: (r[2], r[1])), []

    def sim(a, b):
        s = math.exp(-((a[2] - b[2]) ** 2) / sigma**2)
        if a[3] == b[3]:
            return s
        v, u = (a, b) if a[3] == "visual" else (b, a)
        return 0.0 if v[5] is not None and v[5] == u[2] else 0.15 * s

    while left and len(out) < k:
        score = [r[4] if not out else lam * r[4] - (1 - lam) * max(sim(r, o) for o in out) for r in left]
        best = left[max(range(len(left)), key=lambda i: (score[i], -i))]
        out.append(best)
        left.remove(best)
        left = [r for r in left if not (best[3] == r[3] == "audio" and abs(best[2] - r[2]) <= 0.75 * sigma and min(len(best[6]), len(r[6])) >= 5 and len(set(best[6]) & set(r[6])) / len(set(best[6]) | set(r[6])) >= 0.35)]
    return [r[1] for r in out]


@pytest.mark.parametrize("preset", list(terms.PRESETS))
def test_mmr_equals_a_loop(spark, preset):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = [(g, f"c{i:03d}", float(rng.randrange(0, 200)), rng.choice(["visual", "audio"]), round(rng.gauss(0, 1), 3), rng.choice([None, float(rng.randrange(0, 200))]), rng.sample(vocabulary, rng.randrange(0, 9))) for g in range(12) for i in range(rng.randrange(1, 40))]
    got = selection.mmr_select(spark.createDataFrame(rows, POOL), ["g"], preset).collect()
    for g in range(12):
        picked = [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])]
        assert picked == greedy([r for r in rows if r[0] == g], *terms.PRESETS[preset])
        assert len(picked) <= terms.PRESETS[preset][0]


def test_constant_scores_have_no_spread(spark):
    rows = spark.createDataFrame([(1, 0.1), (1, 0.1), (1, 0.1), (2, 1.0), (2, 3.0)], "g int, s double")
    assert sorted(r.z for r in scoring.standardize(rows, "s", ["g"]).collect()) == [-1.0, 0.0, 0.0, 0.0, 1.0]


def test_anchor_needs_relevant_audio(spark):
    schema = "g int, id string, t double, modality string, relevance double, z double"
    rows = [(1, "a", 10.0, "audio", 0.5, 0.0), (1, "v", 12.0, "visual", 0.2, 0.1), (1, "far", 90.0, "visual", 0.2, 0.1), (2, "a", 10.0, "audio", 0.1, 0.0), (2, "v", 10.0, "visual", 0.2, 0.1)]
    out = {(r.g, r.id): r for r in scoring.audio_anchors(spark.createDataFrame(rows, schema), ["g"]).collect()}
    s = math.exp(-4 / 64)
    assert out[1, "v"].anchor_t == 10.0 and out[1, "v"].relevance == pytest.approx(0.2 + 0.1 * s) and out[1, "v"].z == pytest.approx(0.1 + 1.25 * s)
    assert out[1, "far"].anchor_t is None and out[2, "v"].anchor_score == 0.0


def test_uniform_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(1, i) for i in range(12)], "g int, t int")
    assert sorted(r.t for r in selection.uniform(rows, ["g"], 3, ["t"]).collect()) == [0, 6, 11]


def test_slots_follow_the_loop(spark):
    rng = random.Random(5)
    rows = [(1, f"s{i}", float(i), rng.randrange(1, 6), rng.random(), rng.random()) for i in range(7)]
    for budget in (0, 3, 7, 11, 100):
        got = {r.segment: r.slots for r in selection.allocate_slots(spark.createDataFrame(rows, "g int, segment string, start double, capacity int, peak double, mean double"), ["g"], budget).collect()} if budget else {r[1]: 0 for r in rows}
        order = sorted(rows, key=lambda r: (-(r[4] + 0.5 * r[5]), -r[3], r[2]))
        want = {r[1]: 0 for r in rows}
        total = min(budget, sum(r[3] for r in rows))
        for r in order[:total]:
            want[r[1]] = 1
        for _ in range(total - sum(want.values())):
            best = max(order, key=lambda r: -1 if want[r[1]] >= r[3] else (r[4] + 0.5 * r[5]) / (want[r[1]] + 1))
            want[best[1]] += 1
        assert got == want


@pytest.mark.parametrize("query,intent", [("How many cats", "counting_comparison"), ("why", "speech_semantic"), ("the music before", "temporal_before_after"), ("title says what he said", "visual_object_action"), ("", "mixed_av"), ("it is not there", "negative_evidence")])
def test_intents(spark, query, intent):
    assert spark.createDataFrame([(query,)], "q string").select(T.query_intent("q")["intent"]).first()[0] == intent


def test_first_fit_is_ordered(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([0, 10, 4, 6, 20])], "g int, i int, x int")
    out = evidence.first_fit(rows, ["g"], ["i"], "abs(x.x - y.x) <= 5").collect()
    assert {r.x: r.cluster for r in out} == {0: 0, 10: 1, 4: 0, 6: 0, 20: 2}


def test_refused_events_are_not_recorded(spark):
    e = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 1, 2, 3, 11, 12])], "k int, e long, t double")
    out = {r.e: r.wait for r in decide(e, "k", "t", "e", [(2, 10.0)]).collect()}
    assert out == {0: None, 1: None, 2: 8.0, 3: 7.0, 4: None, 5: None}
