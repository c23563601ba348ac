"""Queries: scenes and budgets over ``embeddings`` (a label is a video, the order of vec_id its time)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.terms import SCENE_SIMILARITY
from ..functions.vectors import cosine
from ..operators import crossing, selection
from ..registry import query
from ..sources.tables import table

THRESHOLD = 0.0  # the synthetic vectors of a label are farther apart than the frames of a scene

SCENES_SQL = f"""
  f AS (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::DOUBLE AS t, embedding::DOUBLE[] AS v FROM embeddings),
  c AS (SELECT label, vec_id, t, CASE WHEN coalesce(round(list_cosine_similarity(v, lag(v) OVER (PARTITION BY label ORDER BY vec_id)), 9) < {THRESHOLD}, false) THEN 1 ELSE 0 END AS cut FROM f),
  s AS (SELECT label, vec_id, t, 'scene-' || sum(cut) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT::VARCHAR AS scene, (vec_id % 97) / 97.0::DOUBLE AS rel FROM c),
  g AS (SELECT label, scene, min(t) AS start, max(t) AS stop, count(*) AS n, round(avg(rel), 9) AS mean, max(rel) AS peak FROM s GROUP BY label, scene)"""


def scenes(frames: DataFrame, threshold: float = SCENE_SIMILARITY) -> DataFrame:
    """(video, t, vector) -> scene: neighbours whose cosine is below the threshold begin a new one."""
    w = W.partitionBy("video").orderBy("t", "frame")
    cut = F.coalesce(F.round(cosine(F.col("vector"), F.lag("vector").over(w)), 9) < threshold, F.lit(False)).cast("int")
    rows = frames.withColumn("__cut", cut).drop("vector")
    return rows.withColumn("scene", F.concat(F.lit("scene-"), F.sum("__cut").over(w).cast("string"))).drop("__cut")


def scene_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("video", "scene").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count(F.lit(1)).alias("n"), F.round(F.avg("rel"), 9).alias("mean"), F.max("rel").alias("peak"))


def _scened(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    t = (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("double")
    return scenes(e.select(F.col("label").alias("video"), F.col("vec_id").alias("frame"), t.alias("t"), F.col("embedding").alias("vector"), ((F.col("vec_id") % 97) / 97.0).alias("rel")), THRESHOLD)


@query("w2_scene_segments", f"WITH {SCENES_SQL} SELECT label, vec_id, scene FROM s")
def w2(spark, sf_dir):
    return _scened(spark, sf_dir).select(F.col("video").alias("label"), F.col("frame").alias("vec_id"), "scene")


@query("a6_scene_stats", f"WITH {SCENES_SQL} SELECT label, scene, start, stop, n, round(mean, 6) AS mean, round(peak, 6) AS peak FROM g")
def a6(spark, sf_dir):
    return scene_stats(_scened(spark, sf_dir)).select(F.col("video").alias("label"), "scene", "start", "stop", "n", F.round("mean", 6).alias("mean"), F.round("peak", 6).alias("peak"))


@query("j9_scene_lookup", f"WITH {SCENES_SQL} SELECT s.label, s.vec_id, g.start, g.stop FROM s JOIN g ON s.label = g.label AND s.scene = g.scene")
def j9(spark, sf_dir):
    s = _scened(spark, sf_dir)
    return s.join(scene_stats(s).select("video", "scene", "start", "stop"), ["video", "scene"]).select(F.col("video").alias("label"), F.col("frame").alias("vec_id"), "start", "stop")


@query("k21_segment_budget", f"""
WITH {SCENES_SQL}, p AS (SELECT *, peak + 0.5::DOUBLE * mean AS pr FROM g),
  o AS (SELECT p.*, j, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN j = 1 THEN 0 ELSE 1 END, pr / j DESC, pr DESC, n DESC, start, scene, j) AS rn FROM p, range(1, 13) r(j) WHERE j <= greatest(n, 1)),
  k AS (SELECT label, scene, count(*) AS slots FROM o WHERE rn <= 12 GROUP BY label, scene)
SELECT p.label, p.scene, coalesce(k.slots, 0) AS slots FROM p LEFT JOIN k ON p.label = k.label AND p.scene = k.scene""")
def k21(spark, sf_dir):
    g = scene_stats(_scened(spark, sf_dir)).select("video", F.col("scene").alias("segment"), "start", F.col("n").cast("int").alias("capacity"), "peak", "mean")
    return selection.allocate_slots(g, ["video"], 12).select(F.col("video").alias("label"), F.col("segment").alias("scene"), "slots")


@query("u3_dispatcher", """
WITH q AS (SELECT max(CASE WHEN vec_id = 0 THEN embedding END)::DOUBLE[] AS speech, max(CASE WHEN vec_id = 1 THEN embedding END)::DOUBLE[] AS ambient, max(CASE WHEN vec_id = 2 THEN embedding END)::DOUBLE[] AS said, max(CASE WHEN vec_id = 3 THEN embedding END)::DOUBLE[] AS sound FROM embeddings),
s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], speech) - list_cosine_similarity(embedding::DOUBLE[], ambient) AS margin, list_cosine_similarity(embedding::DOUBLE[], said) AS a, list_cosine_similarity(embedding::DOUBLE[], sound) AS b FROM embeddings, q)
SELECT vec_id, round(margin, 9) > 0.05 AS speech, round(CASE WHEN round(margin, 9) > 0.05 THEN a ELSE b END, 6) AS score FROM s""")
def u3(spark, sf_dir):
    """Speech-like windows take the transcript's score, others the sound prompt's; probes are stored vectors."""
    e = table(spark, sf_dir, "embeddings")
    probe = {i: F.max(F.when(F.col("vec_id") == i, F.col("embedding"))).alias(f"p{i}") for i in range(4)}
    s = e.crossJoin(F.broadcast(e.filter("vec_id < 4").agg(*probe.values())))
    c = lambda i: cosine(F.col("embedding"), F.col(f"p{i}"))
    speech = F.round(c(0) - c(1), 9) > 0.05
    return s.select("vec_id", speech.alias("speech"), F.round(F.when(speech, c(2)).otherwise(c(3)), 6).alias("score"))


@query("w6_gold_rank", """
WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT q, label, vec_id, row_number() OVER (PARTITION BY q, label ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 9) DESC, vec_id) AS rank FROM embeddings, q),
g AS (SELECT q, label, min(rank) FILTER (WHERE vec_id % 20 BETWEEN 5 AND 7) AS gold FROM r GROUP BY q, label)
SELECT q, label, gold::INT AS gold_rank, coalesce(gold <= 1, false) AS hit1, coalesce(gold <= 5, false) AS hit5 FROM g""")
def w6(spark, sf_dir):
    """The first rank in an expected range, for each stored vector whose id is divisible by 50: one more than the rows that
    are nearer than the nearest expected one. Rows are counted where they are compared, none is ranked."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    g = crossing.first_expected(e, e.filter("id % 50 = 0").withColumnRenamed("id", "q"), "label", (F.col("id") % 20).between(5, 7))
    rank = F.col("rank")
    return g.select("q", "label", rank.alias("gold_rank"), F.coalesce(rank <= 1, F.lit(False)).alias("hit1"), F.coalesce(rank <= 5, F.lit(False)).alias("hit5"))
