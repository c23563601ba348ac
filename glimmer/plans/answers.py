"""Queries: answers by cascade, and evidence finalised against them. What is asked and known comes from ``conversations``;
tests compare both with loops, since neither the cascade's string rules nor the iteration has a SQL form of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answering as A
from ..operators import evidence as E
from ..operators import finalisation as N
from ..operators.moments import best_directed_pair
from ..registry import query
from .evidence import selected
from .repairing import asked

G = ["video_id"]


def _evidence(rows):
    return E.support(rows).withColumn("stop", F.col("start") + 30.0)


def _targets(rows):
    """Texts of the best moments after another, for the questions that ask for one."""
    seen = rows.filter("modality = 'visual'").select(*G, "id", "t", F.col("relevance").alias("a"), (1 - F.col("relevance")).alias("b"))
    pairs = best_directed_pair(seen, G, "a", "b", 300.0)
    after = rows.withColumn("d", T.temporal_query("query")["direction"]).filter("d = 'after'").select(*G, F.col("id").alias("target"), F.col("text").alias("target_text"))
    return pairs.join(after, [*G, "target"]).select(*G, "target_text")


@query("e10_answer_cascade")
def e10_cascade(spark, sf_dir):
    """A question a conversation, of every intent in turn, answered from its turns by the first branch that can."""
    rows = N.ranked(_evidence(asked(selected(spark, sf_dir))), G)
    return A.answers(rows, G, _targets(rows))


def cited(rows):
    """The cascade's answer with the ranks of the evidence that it is like."""
    rows = rows.drop("answer").withColumn("stop", F.col("start") + 30.0)
    if "s_visual" not in rows.columns:
        rows = rows.withColumn("s_visual", F.col("relevance"))
    said = A.answers(rows, G, _targets(rows)).filter("answer is not null")
    like = rows.join(said, G).filter(T.text_similarity("answer", "text") >= 0.1).groupBy(*G).agg(F.array_join(F.array_sort(F.collect_list("rank")), ", ").alias("ranks"))
    return said.join(like, G, "left").select(*G, F.concat("answer", F.when(F.col("ranks").isNotNull(), F.concat(F.lit(" Evidence: "), F.col("ranks"))).otherwise("")).alias("answer"))


@query("e15_final_evidence")
def e15_rounds(spark, sf_dir):
    """Turns finalised against answers that cite them, answered again where pruning changed what is known."""
    out = N.finalise(selected(spark, sf_dir).drop("answer").withColumn("stop", F.col("start") + 30.0), G, cited)
    return out.select("video_id", "rank", "id", "rounds", "answer", F.round("score", 6).alias("score"), "grounding_label")
