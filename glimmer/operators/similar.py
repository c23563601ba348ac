"""Pairs of similar token sets inside a group, by prefix filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def candidates(sets: DataFrame, group: list[str], least: float) -> DataFrame:
    """(group, i, toks) with distinct tokens -> (group, i, j), i after j: pairs that may have Jaccard ``least`` or more.

    Two such sets share one of their first n - ceil(least * n) + 1 tokens in any one order of the tokens, and the smaller
    has at least ``least`` of the larger one's size. The order is the tokens' own, rarest in the group first, so what is
    joined are rare tokens; and where both stand tells how many tokens they can still share."""
    rows = sets.select(*group, "i", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    often = rows.groupBy(*group, "tok").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(W.partitionBy(*group, "i").orderBy("often", "tok"))
    prefix = rows.join(often, [*group, "tok"]).withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).drop("often")
    x, y = prefix.alias("x"), prefix.alias("y")
    on = (F.col("y.i") < F.col("x.i")) & (F.col("x.tok") == F.col("y.tok"))
    for g in group:
        on = on & (F.col(f"x.{g}") == F.col(f"y.{g}"))
    both = F.col("x.n") + F.col("y.n")
    can = F.least("x.place", "y.place") + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    near = can * (1 + least) >= least * both - 1e-9
    return x.join(y, on & near).select(*[F.col(f"x.{g}").alias(g) for g in group], F.col("x.i").alias("i"), F.col("y.i").alias("j")).distinct()


def similar(sets: DataFrame, group: list[str], least: float) -> DataFrame:
    """(group, i, j, similarity) of all pairs with Jaccard ``least`` or more, i after j. Empty sets are like none."""
    p = candidates(sets, group, least)
    own = sets.select(*group, "i", F.col("toks").alias("a"))
    other = sets.select(*group, F.col("i").alias("j"), F.col("toks").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    s = shared / (F.size("a") + F.size("b") - shared)
    return p.join(own, [*group, "i"]).join(other, [*group, "j"]).withColumn("similarity", s).filter(F.col("similarity") >= least).select(*group, "i", "j", "similarity")
