"""Files, model hooks and streams."""

import json

import numpy as np
from pyspark.sql import functions as F

from glimmer.functions import hooks
from glimmer.sources import files
from glimmer.streaming import limits


def test_jsonl_and_candidates(spark, tmp_path):
    rows = [{"id": "q", "video_id": "v", "query": "what", "duration_seconds": 9, "visual_candidates": [{"id": "a", "timestamp_seconds": 1.0, "text": "x"}], "audio_candidates": [{"id": "b", "timestamp_seconds": 2.0, "text": "y", "saliency_score": 0.5}]}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = {(r.id, r.modality, r.saliency_score) for r in files.candidates(files.read_jsonl(spark, str(tmp_path / "e.jsonl"))).collect()}
    assert got == {("a", "visual", None), ("b", "audio", 0.5)}


def test_malformed_lines_are_numbered(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert [r.line_number for r in files.malformed_lines(spark, str(tmp_path / "b.jsonl")).collect()] == [3]


def test_resolve_files(spark):
    e = spark.createDataFrame([("a", None), ("b", "given"), ("c", None)], "video_id string, video_path string")
    found = spark.createDataFrame([("/x/a.webm",), ("/x/y/a.mp4",), ("/x/c.txt",)], "path string")
    assert {r.video_id: r.video_path for r in files.resolve_files(e, found).collect()} == {"a": "/x/y/a.mp4", "b": "given", "c": None}


def test_artifacts_wrapped_and_bare(spark, tmp_path):
    for name, data in (("one", {"compression": {"query": "what is it", "selected": [1, 2]}}), ("two", {"query": "what else", "selected": [1]})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "compression.json").write_text(json.dumps(data))
    got = files.read_artifacts(spark, str(tmp_path), "query string, selected array<int>", query_terms=["what"])
    assert sorted(r.query for r in got.collect()) == ["what else", "what is it"]
    assert files.read_artifacts(spark, str(tmp_path), "query string, selected array<int>", least=2).count() == 1


def test_tagged_log_manifest_and_csv(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"record": "device"}\n{"record": "stage", "stage": "answer", "wall_seconds": 1.5, "extra": {"condition": "x"}}\n')
    device, stage = files.read_measurements(spark, str(tmp_path / "log.jsonl"))
    assert device.count() == 1 and stage.first().extra == {"condition": "x"}
    (tmp_path / "m.jsonl").write_text('{"path": "p"}\n{"compression_path": "q"}\n{}\n')
    assert sorted(r.path for r in files.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()) == ["p", "q"]
    items = spark.createDataFrame([("l", {"speaker": "team"})], "label string, values map<string, string>")
    files.write_items_csv(items, str(tmp_path / "csv"), ["speaker", "priority"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().speaker == "team"


def test_replace_partition(spark, tmp_path):
    out = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.partitionBy("k").parquet(out)
    files.replace_partition(spark.createDataFrame([(2, "c")], "k int, v string"), out, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c")]


def test_text_scorer(spark):
    embed = hooks.text_scorer(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    got = [r.v for r in spark.createDataFrame([("abc",), (" ",), (None,)], "t string").select(embed("t").alias("v")).collect()]
    assert got == [[3.0, 1.0], None, None]


def test_subprocess_answers(spark):
    got = hooks.subprocess_answers(spark.createDataFrame([("a",), ("b",)], "request string").coalesce(1), ["cat"]).collect()
    assert [r.answer for r in got] == ["a", "b"]


def test_limit_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, float(t)) for k in range(3) for i, t in enumerate([0, 1, 2, 3, 11, 12, 13, 30])]
    e = spark.createDataFrame([(k, k * 100 + i, t) for k, i, t in rows], "key long, tie long, t double")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = limits.limit_stream(stream, [(2, 10.0)], expire=False).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = sorted((r.tie, r.wait) for r in spark.table("limited").collect())
    want = sorted((r.tie, r.wait) for r in limits.decide(e, "key", "t", "tie", [(2, 10.0)]).collect())
    assert got == want


def test_windowed_counts_stream(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = limits.windowed_counts(s, "ts", "5 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.v) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
