"""Coverage rules against loops over lists, group by group, and the running best pair against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from glimmer.operators import moments as M
from glimmer.operators import repair as R

MIN_ANCHOR = 0.25


class Loop:
    """One selection, repaired by plain statements over lists of dicts."""

    def __init__(self, pool, sel, k):
        self.pool, self.sel, self.k = pool, list(sel), k

    def kind(self, m, rows=None):
        return [x for x in (self.sel if rows is None else rows) if x["modality"] == m]

    def left(self, m):
        ids = {x["id"] for x in self.sel}
        return [x for x in self.kind(m, self.pool) if x["id"] not in ids]

    def drop(self, rows, floor=0):
        if len(rows) <= floor:
            return False
        self.sel.remove(min(rows, key=lambda x: x["mmr"]))
        return True

    def audio_first(self):
        return self.drop(self.kind("audio")) or self.drop(self.kind("visual"))

    def fill(self, incoming, have, target, drop):
        for x in incoming:
            if have >= target or (len(self.sel) >= self.k and not drop()):
                return
            self.sel.append(x)
            have += 1

    def anchors(self):
        def held():
            return [x for x in self.kind("visual") if (x["anchor_score"] or 0) >= MIN_ANCHOR]

        times = [x["anchor_t"] for x in held() if x["anchor_t"] is not None]
        own = [x for x in self.left("audio") if any(abs(x["t"] - t) < 1e-6 for t in times)]
        own.sort(key=lambda x: (-x["relevance"], -x["z"], x["t"], x["id"]))
        self.fill(own, len(self.kind("audio")), min(4, max(2, self.k // 3)), lambda: self.drop(held()))

    def opening(self):
        frames = self.kind("visual", self.pool)
        frames = [x for x in frames if x["text"].lower().startswith("on-screen text")] or frames
        if frames:
            x = min(frames, key=lambda y: (y["t"], y["id"]))
            if x["id"] not in {y["id"] for y in self.sel}:
                self.sel = sorted(self.sel, key=lambda y: -y["mmr"])[: self.k - 1] + [x]

    def pair(self, anchor, target):
        others = sorted((x for x in self.sel if x["id"] not in (anchor["id"], target["id"])), key=lambda y: -y["mmr"])
        self.sel = others[: max(self.k - 2, 0)] + [anchor, target]

    def counting(self, reach):
        taken, claims = {x["id"] for x in self.sel}, []
        for v in sorted(self.kind("visual"), key=lambda x: (-x["z"], -x["relevance"], x["t"], x["id"])):
            near = [x for x in self.kind("visual", self.pool) if x["id"] not in taken and abs(x["t"] - v["t"]) <= reach]
            if near:
                claims.append(min(near, key=lambda x: (abs(x["t"] - v["t"]), -x["z"], x["t"], x["id"])))
                taken.add(claims[-1]["id"])
        self.fill(claims, 0, len(claims), self.audio_first)

    def visual(self):
        if any(x["text"].lower().startswith("on-screen text near") and x["relevance"] >= 0.95 for x in self.kind("visual")):
            return
        rest = sorted(self.left("visual"), key=lambda x: (-x["z"], -x["relevance"], x["t"], x["id"]))
        self.fill(rest, len(self.kind("visual")), min(len(self.kind("visual", self.pool)), max(2, self.k // 2)), self.audio_first)

    def mixed(self):
        if self.k < 2 or not self.kind("visual", self.pool) or not self.kind("audio", self.pool):
            return
        for m, other in (("audio", "visual"), ("visual", "audio")):
            best = sorted(self.left(m), key=lambda x: (-x["relevance"], -x["z"], x["t"], x["id"]))[:1]
            self.fill(best, len(self.kind(m)), 1, lambda: self.drop(self.kind(other), 1))
        seen = [x["t"] for x in self.kind("visual")]
        if seen:
            near = sorted(self.left("audio"), key=lambda x: (min(abs(x["t"] - t) for t in seen), -x["z"], -x["relevance"], x["t"], x["id"]))
            self.fill(near, len(self.kind("audio")), min(len(self.kind("audio", self.pool)), max(2, self.k // 3)), lambda: self.drop(self.kind("visual"), 2))

    def thirds(self):
        heard = self.kind("audio", self.pool)
        if not heard:
            return
        lo, hi = min(x["t"] for x in heard), max(x["t"] for x in heard)

        def third(x):
            return min(int((x["t"] - lo) / max(hi - lo, 1.0) * 3), 2)

        for b in range(3):
            own = [x for x in heard if third(x) == b]
            chosen = [third(x) for x in self.kind("audio")]
            if not own or b in chosen:
                continue
            if len(self.sel) >= self.k:
                crowded = [x for x in self.kind("audio") if chosen.count(third(x)) > 1]
                if not self.drop(crowded) and not self.drop(self.kind("visual"), 1):
                    return
            self.sel.append(min(own, key=lambda x: (-x["z"], -x["relevance"], x["t"], x["id"])))

    def negative(self):
        rest = sorted(self.left("audio"), key=lambda x: (-x["z"], -x["relevance"], x["t"], x["id"]))
        self.fill(rest, len(self.kind("audio")), min(self.k, max(3, self.k // 2)), lambda: self.drop(self.kind("visual")))


INTENTS = ["visual_object_action", "temporal_before_after", "counting_comparison", "mixed_av", "global_summary", "negative_evidence", "speech_semantic"]
SCHEMA = "array<struct<id: string, modality: string, t: double, z: double, relevance: double, mmr: double, anchor_t: double, anchor_score: double, text: string>>"


def groups(seed, n):
    rng = random.Random(seed)
    out = []
    for g in range(n):
        mix = rng.choice([0.0, 0.2, 0.5, 0.8, 1.0])
        pool = []
        for i in range(rng.randrange(0, 14)):
            m = "visual" if rng.random() < mix else "audio"
            pool.append({"id": f"i{i:02d}", "modality": m, "t": float(rng.randrange(60)), "z": rng.randrange(-8, 9) / 4, "relevance": rng.choice([0.1, 0.5, 0.96]), "anchor_t": None, "anchor_score": None, "text": rng.choice(["", "On-screen text near x", "on-screen TEXT"])})
        heard = [x["t"] for x in pool if x["modality"] == "audio"]
        for x in pool:
            x["mmr"] = x["z"]
            if x["modality"] == "visual" and heard and rng.random() < 0.5:
                x["anchor_t"], x["anchor_score"] = rng.choice(heard), rng.choice([0.1, 0.25, 0.9])
        k = 4
        sel = [dict(x, mmr=rng.randrange(-6, 7) / 3) for x in rng.sample(pool, min(len(pool), rng.randrange(0, k + 1)))]
        pair = [dict(x, mmr=0.5) for x in rng.sample(pool, 2)] if len(pool) > 1 and rng.random() < 0.7 else [None, None]
        out.append({"g": g, "pool": sorted(pool, key=lambda x: (x["t"], x["id"])), "sel": sel, "intent": INTENTS[g % len(INTENTS)], "query": rng.choice(["the first frame", "a frame"]), "anchor": pair[0], "target": pair[1]})
    return out


def test_every_rule_as_looped(spark):
    gs, k, fired = groups(4, 700), 4, set()
    row = SCHEMA[6:-1]
    df = spark.createDataFrame([(g["g"], g["pool"], g["sel"], g["intent"], g["query"], g["anchor"], g["target"]) for g in gs], f"g long, pool {SCHEMA}, sel {SCHEMA}, intent string, query string, anchor {row}, target {row}")
    got = {g["g"]: [] for g in gs}
    for r in R.rows_of(R.repair(df, k, "contains(query, 'first')", pair=True), ["g"]).orderBy("g", "rank").collect():
        got[r.g].append((r.rank, r.id, r.mmr))
    for g in gs:
        x = Loop(g["pool"], g["sel"], k)
        steps = [("anchors", True, x.anchors), ("opening", g["intent"] == "visual_object_action" and "first" in g["query"], x.opening), ("pair", g["intent"] == "temporal_before_after" and g["anchor"], lambda: x.pair(g["anchor"], g["target"])), ("counting", g["intent"] == "counting_comparison", lambda: x.counting(12.0))]
        steps += [("visual", g["intent"] == "visual_object_action", x.visual), ("mixed", g["intent"] == "mixed_av", x.mixed), ("thirds", g["intent"] == "global_summary", x.thirds), ("negative", g["intent"] == "negative_evidence", x.negative)]
        for name, wanted, step in steps:
            before = [y["id"] for y in x.sel]
            if wanted:
                step()
            if before != [y["id"] for y in x.sel]:
                fired.add(name)
        assert got[g["g"]] == [(i + 1, y["id"], y["mmr"]) for i, y in enumerate(x.sel)], g
    assert fired == {"anchors", "opening", "pair", "counting", "visual", "mixed", "thirds", "negative"}


@pytest.mark.parametrize("floor", [0, 1, 2])
def test_evictions_keep_the_floor_and_earlier_ties(spark, floor):
    gs = groups(9, 80)
    df = spark.createDataFrame([(g["g"], g["sel"]) for g in gs], f"g long, sel {SCHEMA}")
    got = {r.g: r.left for r in df.select("g", F.expr(R.evict(R.AUDIO, floor)("sel")).alias("left")).collect()}
    for g in gs:
        x = Loop([], g["sel"], 4)
        if x.drop(x.kind("audio"), floor):
            assert [y.id for y in got[g["g"]]] == [y["id"] for y in x.sel]
        else:
            assert got[g["g"]] is None


def test_running_best_is_the_best_of_all_pairs(spark):
    rng = random.Random(8)
    rows = [(g, f"r{i:03d}", float(rng.choice([rng.randrange(0, 400), rng.uniform(0, 400)])), rng.randrange(0, 100) / 100, rng.randrange(0, 100) / 100) for g in range(12) for i in range(rng.randrange(0, 60))]
    reach = 37.0
    got = {(r.g, r.id): (r.target, r.gap) for r in M.running_best(spark.createDataFrame(rows, "g long, id string, t double, a double, b double"), ["g"], "a", "b", reach).collect()}
    want = {}
    for g, i, t, _, _ in rows:
        cands = [(-round(b - 0.25 * u / reach, 9), u, j) for h, j, u, _, b in rows if h == g and t < u <= t + reach]
        if cands:
            best = min(cands)
            want[g, i] = (best[2], best[1] - t)
    assert got == want
    pairs = {r.g: (r.anchor, r.target) for r in M.best_directed_pair(spark.createDataFrame(rows, "g long, id string, t double, a double, b double"), ["g"], "a", "b", reach).collect()}
    for g in {r[0] for r in rows}:
        every = [(-round(a + b2 + 0.25 * (1 - (u - t) / reach), 9), u - t, t, i, j) for h, i, t, a, _ in rows if h == g for h2, j, u, _, b2 in rows if h2 == g and t < u <= t + reach]
        assert pairs.get(g) == (min(every)[3:] if every else None)


def test_running_best_of_a_group_of_many_rows(spark):
    """100,000 rows of one group, all within reach of a thousand others: no plan node joins them."""
    df = spark.range(100_000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("id"), (F.col("id") * 1.0).alias("t"), (F.hash("id") % 97 / 97.0).alias("a"), (F.hash("id", F.lit(1)) % 89 / 89.0).alias("b"))
    best = M.best_directed_pair(df, ["g"], "a", "b", 1000.0)
    assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert best.count() == 1


@pytest.mark.parametrize("direction", ["after", "before"])
def test_sweep_finds_what_all_pairs_have(spark, direction):
    rng = random.Random(12)
    rows = [(g, f"r{i:03d}", float(rng.randrange(0, 300)), rng.choice([None, "a", "b", "c", *(f"s{k}" for k in range(12))]), float(rng.randrange(2)), rng.randrange(6) / 4) for g in range(10) for i in range(rng.randrange(0, 90))]
    df = spark.createDataFrame(rows, "g long, id string, t double, segment_id string, bonus double, target_score double")
    got = sorted((r.g, r.anchor, r.target, r.moved) for r in M.targets_by_sweep(df, ["g"], direction, 50.0).collect())
    want = []
    for g, i, t, s, *_ in rows:
        side = [x for x in rows if x[0] == g and (t < x[2] <= t + 50.0 if direction == "after" else t - 50.0 <= x[2] < t)]
        moved = [x for x in side if s is not None and x[3] is not None and x[3] != s]
        if moved:
            near = sorted({x[3] for x in moved}, key=lambda seg: min((abs(x[2] - t), x[2], x[1]) for x in moved if x[3] == seg))[:8]
            want += [(g, i, min((-x[4], -x[5], x[2], x[1]) for x in moved if x[3] == seg)[3], True) for seg in near]
        elif side:
            want.append((g, i, min((abs(x[2] - t), x[2], x[1]) for x in side)[2], False))
    assert got == sorted(want)
