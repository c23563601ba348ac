"""Tables bound to the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One question at least for each intent, and the clashes of their rules.
QUESTIONS = [
    ("q01", "What does the speaker say about the budget?"),
    ("q02", "Which logo is visible on the screen?"),
    ("q03", "What happens after the presenter shows the slide?"),
    ("q04", "Give an overview of the main theme."),
    ("q05", "Is there applause or music?"),
    ("q06", "How many people are wearing a shirt?"),
    ("q07", "Which topic is not discussed?"),
    ("q08", "Why did the engine fail?"),
    ("q09", "What on-screen text says who talks?"),
    ("q10", "Show the person who asks and then describe the scene, and the music"),
    ("q11", "before the alarm, what object appears?"),
    ("q12", "the of and in on with"),
    ("q13", "???"),
    ("q14", "The opening frame, then the title; the title"),
    ("q15", "summary"),
    ("q16", "next"),
]

#: Events that a task holds and sorts, about.
EVENTS_OF_A_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id string, query string")


QUESTIONS_SQL = "(VALUES " + ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in QUESTIONS) + ") questions(query_id, query)"


def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates(video_id, id, modality, t, saliency, segment_id): a user's events are one video's moments.

    Users are dealt over as many tasks as there are events for, and what follows by video stays where it is dealt: left
    to the shuffle's own number of partitions, the rows of a task, and what its sorts hold, would grow with the table."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.repartition(max(spark.sparkContext.defaultParallelism, -(-e.count() // EVENTS_OF_A_TASK)), "video_id")
    t = (F.col("us") - F.min("us").over(W.partitionBy("video_id"))) / F.lit(1e6)
    return e.select(
        "video_id",
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("id"),
        F.when(F.col("event_type").isin("view", "click"), "visual").otherwise("audio").alias("modality"),
        t.alias("t"),
        F.col("value").alias("saliency"),
        F.concat(F.lit("day-"), F.floor(t / 86400).cast("string")).alias("segment_id"),
    )


EVENT_CANDIDATES_SQL = """
  cand AS (
    SELECT video_id, id, modality, t, saliency, 'day-' || floor(t / 86400)::BIGINT::VARCHAR AS segment_id FROM (
      SELECT user_id AS video_id, 'e' || lpad(event_id::VARCHAR, 10, '0') AS id,
             CASE WHEN event_type IN ('view', 'click') THEN 'visual' ELSE 'audio' END AS modality,
             (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS t, value AS saliency
      FROM events))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 30 s: a conversation's turns; user turns are audio, others visual; the question is the first user turn."""
    c = table(spark, sf_dir, "conversations")
    first = c.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("query"))
    return c.join(first, "conv_id").select(
        F.col("conv_id").alias("video_id"), F.concat(F.lit("t"), F.lpad(F.col("turn").cast("string"), 5, "0")).alias("id"), "turn",
        F.when(F.col("role") == "user", "audio").otherwise("visual").alias("modality"), (F.col("turn") * 30.0 + 15.0).alias("t"), (F.col("turn") * 30.0).alias("start"), "text", "query",
    )


TURNS_SQL = """
  turns AS (
    SELECT c.conv_id AS video_id, 't' || lpad(turn::VARCHAR, 5, '0') AS id, turn, CASE WHEN role = 'user' THEN 'audio' ELSE 'visual' END AS modality,
           turn * 30.0::DOUBLE + 15.0::DOUBLE AS t, turn * 30.0::DOUBLE AS start, text, f.query
    FROM conversations c JOIN (SELECT conv_id, arg_min(text, (turn, text)) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id) f ON c.conv_id = f.conv_id)"""


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def sql_tokens(x: str) -> str:
    from ..functions.terms import STOPWORDS

    return f"list_filter(list_distinct({sql_words(x)}), lambda w: NOT list_contains({sql_list(STOPWORDS)}, w))"


def sql_jaccard(a: str, b: str) -> str:
    """Of two token-list expressions."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
