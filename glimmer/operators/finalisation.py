"""Final evidence: answer, prune, answer again, until what is selected no longer changes with what is answered.

A delta iteration over four prunings: to the answer, to what it cites, of redundant evidence, of weak grounding. After
each one only the questions whose evidence it changed are answered again; all others keep their answer and are not read
by the next answering. Each step's rows are checkpointed, since the next one reads them twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import evidence as E
from .lineage import cut as cut_lineage

Answerer = Callable[[DataFrame], DataFrame]


def ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    """Ranks as an answer sees them: by time."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy("t", "id")))


def pruned_to_citations(rows: DataFrame, group: list[str]) -> DataFrame:
    """What the answer cites, by rank; a question whose answer cites nothing, or with one row, keeps all."""
    n = F.count(F.lit(1)).over(W.partitionBy(*group))
    rows = rows.withColumn("__n", n).withColumn("cited", F.array_contains(T.cited_ranks("answer", F.col("__n")), F.col("rank")))
    rows = rows.withColumn("cited", F.col("cited") | (F.col("__n") <= 1))
    return E.prune_to_citations(rows, group).drop("__n", "cited")


def consolidated(rows: DataFrame, group: list[str]) -> DataFrame:
    """Of each cluster of evidence that says the same, the best supported row."""
    c = E.first_fit(rows.withColumn("toks", T.tokens("text")), group, ["t", "id"], E.ALIKE)
    best = F.row_number().over(W.partitionBy(*group, "cluster").orderBy(F.desc("score"), F.desc("relevance"), "t", "id"))
    return c.withColumn("__r", best).filter("__r = 1").drop("__r", "cluster", "toks")


#: The prunings, in order, and whether an answer that one has changed is held to what it cites once more.
STEPS = ((E.prune, False), (pruned_to_citations, True), (consolidated, True), (E.drop_weak, False))


def finalise(evidence: DataFrame, group: list[str], answerer: Answerer, steps=STEPS) -> DataFrame:
    """(group, id, t, start, stop, query, intent, text, modality, relevance, z, anchor_t, anchor_score) -> the rows that
    stay, with rank, answer, their support and ``rounds``: how often the question was answered.

    ``answerer`` takes rows with ranks and gives (group, answer), null where there is none; questions without an answer
    keep all their evidence."""
    own = [c for c in evidence.columns if c not in ("answer", "rank")]
    kept_columns = [*own, "rank", "answer", "rounds"]
    size = F.count(F.lit(1)).over(W.partitionBy(*group))

    def cut(rows: DataFrame, step, due) -> DataFrame:
        """The step on the due questions with an answer; ``__again`` tells which of them lost rows."""
        rows = E.support(rows.select(*kept_columns, due.alias("__due"))).withColumn("__due", F.col("__due") & F.col("answer").isNotNull()).withColumn("__before", size)
        rows = step(rows.filter("__due"), group).unionByName(rows.filter("not __due"))
        return cut_lineage(ranked(rows, group).withColumn("__again", size != F.col("__before")).select(*kept_columns, "__again"))

    rows = cut_lineage(ranked(evidence.select(*own), group))
    rows = rows.join(answerer(rows), group, "left").withColumn("rounds", F.lit(1))
    for step, cited in steps:
        rows = cut(rows, step, F.lit(True))
        if rows.filter("__again").isEmpty():
            continue
        fresh = answerer(rows.filter("__again")).withColumnRenamed("answer", "__fresh")
        rows = rows.join(fresh, group, "left").withColumn("answer", F.when(F.col("__again"), F.col("__fresh")).otherwise(F.col("answer"))).withColumn("rounds", F.col("rounds") + F.col("__again").cast("int"))
        if cited:
            rows = cut(rows, pruned_to_citations, F.col("__again"))
    return E.support(rows.select(*kept_columns))
