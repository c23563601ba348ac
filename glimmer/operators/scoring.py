"""Scores of candidates: standardisation, best aspect, audio anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.text import time_kernel


def standardize(df: DataFrame, score: str, keys: list[str], out: str = "z") -> DataFrame:
    """Population z-score within the keys, to nine digits; 0 where all scores of a group are equal."""
    w = W.partitionBy(*keys)
    z = F.when(F.min(score).over(w) == F.max(score).over(w), F.lit(0.0)).otherwise((F.col(score) - F.avg(score).over(w)) / F.stddev_pop(score).over(w))
    return df.withColumn(out, F.round(z, 9) + F.lit(0.0))


def best_of_duplicates(df: DataFrame, keys: list[str], score: str, tie: list[str]) -> DataFrame:
    """One row a key: the highest score, the first in ``tie`` order among equals."""
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def nearest(left: DataFrame, right: DataFrame, group: list[str], radius: float, order: list[Column]) -> DataFrame:
    """Left rows (id, t) with the best right row (rid, rt, ...) of the same group within ``radius``; left outer.

    The group makes it an equi-join; the radius is a residual."""
    within = F.abs(F.col("l.t") - F.col("r.rt")) <= radius
    on = within
    for g in group:
        on = on & (F.col(f"l.{g}") == F.col(f"r.{g}"))
    pairs = left.alias("l").join(right.alias("r"), on, "left").select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in group])
    w = W.partitionBy(*group, "id").orderBy(*order)
    return pairs.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def audio_anchors(df: DataFrame, group: list[str], scale: float = 1.0) -> DataFrame:
    """Raise visuals near relevant audio: adds anchor_t and anchor_score, boosts relevance and z.

    Anchors are audio rows with at least 0.15 and at least 0.6 of the group's best; the kernel's sigma is 8 * scale.
    A group whose best audio is below 0.15 has no anchor and stays as it is. Scores below the floor can't win, so
    only anchors within the distance at which the kernel meets the floor are joined."""
    sigma = terms.ANCHOR_SIGMA * scale
    reach = sigma * (-_ln(terms.ANCHOR_MIN_SCORE)) ** 0.5 * (1 + 1e-9)
    best = F.max(F.when(F.col("modality") == "audio", F.col("relevance"))).over(W.partitionBy(*group))
    floor = F.greatest(F.lit(terms.ANCHOR_MIN_RELEVANCE), best * terms.ANCHOR_RELATIVE_RELEVANCE)
    marked = df.withColumn("__floor", F.when(best >= terms.ANCHOR_MIN_RELEVANCE, floor))
    anchors = marked.filter((F.col("modality") == "audio") & (F.col("relevance") >= F.col("__floor"))).select(*group, F.col("id").alias("rid"), F.col("t").alias("rt"))
    visual = nearest(marked.filter("modality = 'visual'"), anchors, group, reach, [F.abs(F.col("t") - F.col("rt")).asc_nulls_last(), "rt", "rid"])
    score = time_kernel(F.col("t"), F.col("rt"), sigma)
    kept = F.coalesce(score >= terms.ANCHOR_MIN_SCORE, F.lit(False))
    visual = visual.withColumn("anchor_score", F.when(kept, score).otherwise(0.0)).withColumn("anchor_t", F.when(kept, F.col("rt"))).drop("rid", "rt")
    visual = visual.withColumn("relevance", F.col("relevance") + terms.ANCHOR_RELEVANCE_BOOST * F.col("anchor_score")).withColumn("z", F.col("z") + terms.ANCHOR_NORMALIZED_BOOST * F.col("anchor_score"))
    audio = marked.filter("modality <> 'visual'").withColumn("anchor_score", F.lit(0.0)).withColumn("anchor_t", F.lit(None).cast("double"))
    return visual.unionByName(audio).drop("__floor")


def _ln(x: float) -> float:
    import math

    return math.log(x)


def spread_cume_dist(df: DataFrame, key: str, value: str, out: str, buckets: int = 1024) -> DataFrame:
    """Cumulative distribution of a value within a few large groups, without a task that holds a group: values are
    counted, counts added up bucket by bucket of the value's range, and accumulated inside buckets."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    ends = counts.groupBy(key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("__n").alias("__all"))
    place = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * (buckets - 1)), F.lit(0))
    rows = counts.join(ends, key).withColumn("__b", place)
    sums = rows.groupBy(key, "__b").agg(F.sum("__n").alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = F.sum("__n").over(W.partitionBy(key, "__b").orderBy(value))
    dist = rows.join(before, [key, "__b"]).select(key, value, ((F.col("__before") + inside) / F.col("__all")).alias(out))
    return df.join(dist, [key, value])
