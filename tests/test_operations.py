"""Streams, hooks, sinks and catalogs that no query covers."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glimmer.functions import hooks
from glimmer.operators import scoring, statistics
from glimmer.sources import files
from glimmer.streaming import limits


def test_decide_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(k, i, float(rng.randrange(0, 200))) for k in range(5) for i in range(rng.randrange(1, 80))]
    bounds = [(3, 10.0), (6, 60.0)]
    want = {}
    for k in range(5):
        seen = []
        for t, i in sorted((t, i) for key, i, t in rows if key == k):
            wait = max((seen[-c] + w - t if sum(s > t - w for s in seen) >= c else 0.0) for c, w in bounds)
            want[k, i] = max(1.0, float(-(-wait // 1))) if wait > 0 else None
            if wait <= 0:
                seen.append(t)
    got = {(r.k, r.e): r.wait for r in limits.decide(spark.createDataFrame(rows, "k int, e long, t double"), "k", "t", "e", bounds).collect()}
    assert got == want


def test_cap_refuses_while_two_are_active(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 1.0, 5.0), (1, 2, 2.0, 9.0), (1, 3, 6.0, 7.0), (2, 4, 0.0, 1.0)], "k int, e long, a double, z double")
    assert {r.e: r.admitted for r in limits.active_cap(rows, "k", "a", "z", "e").collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_progress_stream_ends_at_a_terminal_state(spark, tmp_path):
    src = tmp_path / "in"
    schema = "id long, state string, at double"
    rows = [(1, "queued", 1.0), (1, "queued", 2.0), (1, "reading", 3.0), (1, "ready", 4.0), (1, "reading", 5.0), (2, "queued", 1.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    out = limits.progress_stream(spark.readStream.schema(schema).parquet(str(src)), "id", "at", "state", expire=False)
    q = out.writeStream.format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.key, r.seen_at, r.state) for r in spark.table("progress").collect())
    assert got == [(1, 1.0, "queued"), (1, 3.0, "reading"), (1, 4.0, "ready"), (2, 1.0, "queued")]


def test_staged_answers_report_errors_and_go_on(spark, tmp_path):
    src, seen = tmp_path / "q", []
    spark.createDataFrame([("a",)], "question string").coalesce(1).write.parquet(str(src))

    def answer(batch):
        if batch.filter("question = 'b'").count():
            raise ValueError("no answer")
        return batch.withColumn("answer", F.lit("x"))

    def run():
        q = limits.staged_answers(spark.readStream.schema("question string").parquet(str(src)), answer, lambda stage, rows: seen.append((stage, [r.question for r in rows.collect()])), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()

    run()
    spark.createDataFrame([("b",)], "question string").coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert [s for s, _ in seen] == ["started", "selected", "done", "started", "error"]


def test_changes_and_sessions(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, None), (2, 2, None)], "k int, t int, s string")
    assert sorted((r.k, r.t) for r in limits.changes(rows, "k", "t", "s").collect()) == [(1, 1), (1, 3), (2, 1)]
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 03:00:00")], "k int, ts string").select("k", F.to_timestamp("ts").alias("ts"))
    assert sorted(r.n for r in limits.sessions(e, "ts", "10 minutes", "k").collect()) == [1, 2]


def test_hooks(spark):
    paths = spark.createDataFrame([("ab",), ("c",)], "path string")
    got = paths.select(hooks.prompt_scorer(lambda: lambda ps, prompts: [[len(p) * len(q) for q in prompts] for p in ps], ["x", "yy"])("path").alias("s")).collect()
    assert [r.s for r in got] == [[2.0, 4.0], [1.0, 2.0]]
    clips = spark.createDataFrame([(1, bytearray(b"hello"))], "id int, content binary")
    assert [tuple(r) for r in hooks.transcriber(clips, lambda: lambda b: bytes(b).decode().upper()).collect()] == [(1, "HELLO")]
    asked = spark.createDataFrame([("why", ["a", "b"]), (None, ["a"]), ("q", [])], "q string, e array<string>")
    assert [r.a for r in asked.select(hooks.answerer(lambda: hooks.echo)("q", "e").alias("a")).collect()] == ["a b", None, None]


def test_extractors(spark):
    frames = spark.createDataFrame([(1, 0, 2.0, "SALE"), (1, 1, 4.0, None)], "video_id int, frame_index int, timestamp_seconds double, ocr_text string")
    windows = spark.createDataFrame([(1, 0, 0.0, 30.0, "hello")], "video_id int, window_index int, start_seconds double, end_seconds double, transcript_text string")
    got = hooks.extract([(frames, hooks.frame_candidates), (windows, hooks.window_candidates)]).collect()
    assert {(r.id, r.modality, r.t, r.text) for r in got} == {("visual-0", "visual", 2.0, "On-screen text near 2 seconds: SALE"), ("visual-1", "visual", 4.0, "Visual frame sampled at 4.00 seconds"), ("audio-0", "audio", 15.0, "hello")}


def test_semantic_scores(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], [1.0, 0.0]), ("b", [0.0, 1.0], [1.0, 0.0]), (" ", None, [1.0, 0.0]), ("c", [-1.0, 0.0], [1.0, 0.0])], "text string, vector array<float>, query_vector array<float>")
    assert [r.saliency for r in hooks.semantic_scores(rows).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_manifests(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text('{"path": "a"}\n\n{"artifact": "b"}\n')
    (tmp_path / "array.json").write_text(json.dumps([{"compression_path": "c"}, {"path": "d"}], indent=1))
    assert sorted(r.path for r in files.read_manifest(spark, str(tmp_path / "lines.jsonl")).collect()) == ["a", "b"]
    assert sorted(r.path for r in files.read_manifest(spark, str(tmp_path / "array.json")).collect()) == ["c", "d"]
    files.write_manifest(spark.createDataFrame([("x",), ("y",)], "path string"), str(tmp_path / "out"))
    assert sorted(r.path for r in files.read_manifest(spark, str(tmp_path / "out")).collect()) == ["x", "y"]


def test_schemas(spark, tmp_path):
    for name in ("customer_objections", "sales_feedback"):
        (tmp_path / f"{name}.schema.json").write_text(json.dumps({"name": name, "description": "d", "item_type": "i", "labels": ["l"], "fields": [{"name": "f", "description": "", "required": True}]}, indent=1))
    catalog = files.read_schemas(spark, str(tmp_path))
    assert files.resolve_schema(catalog, name="Customer-Objections").head().name == "customer_objections"
    assert files.resolve_schema(catalog, preset="sales-feedback").head()["fields"][0].required
    for bad in ({}, {"name": "x", "preset": "y"}, {"name": "none"}, {"preset": "none"}, {"preset": "meeting-decisions"}):
        with pytest.raises(ValueError):
            files.resolve_schema(catalog, **bad)


def test_measured():
    sink = []
    with files.measured("fine", sink):
        pass
    with pytest.raises(KeyError), files.measured("bad", sink):
        {}["x"]
    assert [r["stage"] for r in sink] == ["fine", "bad"] and sink[1]["error"].startswith("KeyError") and sink[0]["wall_seconds"] >= 0


def test_bootstrap_paths_agree(spark, monkeypatch):
    rows = spark.createDataFrame([("p", i, float(i % 3), float(i % 5)) for i in range(40)], "g string, i int, a double, b double")
    one = sorted((r.resample, round(r.a, 9), round(r.b, 9)) for r in statistics.bootstrap(rows, ["g"], ["a", "b"], "i", 50).collect())
    monkeypatch.setattr(statistics, "MOST_VALUES", 1)
    assert sorted((r.resample, round(r.a, 9), round(r.b, 9)) for r in statistics.bootstrap(rows, ["g"], ["a", "b"], "i", 50).collect()) == one
    assert abs(np.mean([x[1] for x in one]) - 1.0) < 0.15


def test_spread_cume_dist(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randrange(20))) for _ in range(300)] + [("c", 5.0)]
    got = scoring.spread_cume_dist(spark.createDataFrame(rows, "k string, v double"), "k", "v", "pct", 7).collect()
    p = pd.DataFrame(rows, columns=["k", "v"])
    assert len(got) == len(rows)
    for r in got:
        assert r.pct == pytest.approx((p[p.k == r.k].v <= r.v).mean())


def test_bootstrap_draws_as_written_with_nulls_and_several_arrays(spark, monkeypatch):
    def index(r, i, n):
        h = (r * 1000003 + i) % 2**31
        for _ in range(2):
            h = ((h ^ (h >> 16)) * 73244475) % 2**31
        return (h ^ (h >> 16)) % n

    rows = [(g, i, None if i % 4 == 1 or g == 2 else float(i * i % 7)) for g in (1, 2, 3) for i in range(5 * g)]
    want = {}
    for g in (1, 2, 3):
        xs = [x for h, _, x in rows if h == g]
        for r in range(230):
            drawn = [x for i in range(len(xs)) if (x := xs[index(r, i, len(xs))]) is not None]
            want[g, r] = pytest.approx(sum(drawn) / len(xs)) if drawn else None
    df = spark.createDataFrame(rows, "g int, i int, x double").repartition(4)
    for most, strip in ((100, 1 << 18), (100, 4), (4, 6), (1, 100)):
        monkeypatch.setattr(statistics, "MOST_VALUES", most)
        monkeypatch.setattr(statistics, "STRIP", strip)
        out = statistics.bootstrap(df, ["g"], ["x"], "i", 230)
        assert {(r.g, r.resample): r.x for r in out.collect()} == want
        assert "Join Inner, (" not in out._jdf.queryExecution().optimizedPlan().toString()
