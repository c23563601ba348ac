"""Quotas of a modality against the loop, and tasks that do not grow with the events."""

import random

from glimmer.plans import coverage
from glimmer.registry import QUERIES
from glimmer.sources import tables

SF = "/root/testdata/sf0.001"


def test_quota_equals_the_loop(spark):
    rng = random.Random(9)
    pool = [(g, f"i{i:02d}", float(rng.randrange(50)), rng.choice(["visual", "audio", "audio"]), rng.choice([rng.gauss(0, 1), 0.5])) for g in [*range(40), None] for i in range(rng.randrange(1, 14))]
    chosen = []
    for g in [*range(40), None]:
        own = [r for r in pool if r[0] == g]
        chosen += [(g, r[1], r[3], k + 1, rng.choice([0.25, rng.random()])) for k, r in enumerate(rng.sample(own, min(len(own), rng.randrange(1, 7))))]
    want = set()
    for g in range(40):
        mine = [c for c in chosen if c[0] == g]
        have = {c[1] for c in mine}
        left = sorted((r for r in pool if r[0] == g and r[3] == "visual" and r[1] not in have), key=lambda r: (-r[4], r[2], r[1]))
        came = left[: max(3 - sum(c[2] == "visual" for c in mine), 0)]
        others = sorted((c for c in mine if c[2] != "visual"), key=lambda c: (c[4], -c[3]))
        gone = {c[1] for c in others[: max(len(mine) + len(came) - 5, 0)]}
        want |= {(g, x) for x in have - gone} | {(g, r[1]) for r in came}
    c = spark.createDataFrame(chosen, "video_id long, id string, modality string, rank int, mmr double")
    p = spark.createDataFrame(pool, "video_id long, id string, t double, modality string, z double")
    got = [tuple(r) for r in coverage.with_quota(c, p, "visual", 3, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_quota_folds_each_pool_once(spark):
    for name in ("k15_audio_quota", "k17_visual_quota"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(sequence") + plan.count("aggregate([") + plan.count("aggregate(org") <= 1 and plan.count("Relation [") + plan.count("Relation[") <= 2


def test_more_events_are_more_tasks(spark, monkeypatch):
    n = tables.table(spark, SF, "events").count()
    monkeypatch.setattr(tables, "EVENTS_OF_A_TASK", n // 20)
    assert tables.event_candidates(spark, SF)._jdf.queryExecution().toRdd().getNumPartitions() >= 20


def test_events_are_dealt_once_for_a_choice_and_its_quota(spark):
    for name in ("k15_audio_quota", "k17_visual_quota"):
        df = QUERIES[name](spark, SF)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ReusedExchange" in final and final.count("FileScan parquet") == 1
