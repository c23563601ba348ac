"""Costs of stages that were measured for some rows, predicted for the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(measured: DataFrame, keys: list[str], x: str, y: str, cost: str) -> DataFrame:
    """(keys, x, y, cost) -> per_x, per_y, mean_rate, mean_cost, n of each key: least squares of cost on x and y without an
    intercept, by the normal equations, so that only five sums a key travel. per_x and per_y are null where the equations
    are singular (one row, or x and y in proportion); mean_rate is the mean of cost / x over rows with x, mean_cost of cost."""
    rows = measured.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(cost).cast("double").alias("c")).filter("c is not null")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    sums = [F.sum(F.when(both, F.col(a) * F.col(b))).alias(a + b) for a, b in ("xx", "xy", "yy", "xc", "yc")]
    s = rows.groupBy(*keys).agg(*sums, F.avg(F.try_divide("c", F.col("x"))).alias("mean_rate"), F.avg("c").alias("mean_cost"), F.count(F.lit(1)).alias("n"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    sound = det > 1e-9 * F.col("xx") * F.col("yy")
    one = lambda a, b: F.when(sound, (F.col(f"{a}c") * F.col(b + b) - F.col(f"{b}c") * F.col("xy")) / det)
    return s.select(*keys, one("x", "y").alias("per_x"), one("y", "x").alias("per_y"), "mean_rate", "mean_cost", "n")


def predicted(x: Column, y: Column) -> Column:
    """By the fit; where it is singular by the mean rate, where there is no x by the mean cost."""
    return F.coalesce(F.col("per_x") * x + F.col("per_y") * y, F.col("mean_rate") * x, F.col("mean_cost"))


def filled(rows: DataFrame, keys: list[str], x: str, y: str, cost: str) -> DataFrame:
    """The rows with ``spent``, measured or predicted, and ``known``: which of the two. Keys without any measured row stay
    null."""
    rates = fit(rows, keys, x, y, cost)
    out = rows.join(rates, keys, "left")
    return out.select(*rows.columns, F.coalesce(F.col(cost).cast("double"), predicted(F.col(x).cast("double"), F.col(y).cast("double"))).alias("spent"), F.col(cost).isNotNull().alias("known"))
