"""Paired resampling and percentiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

#: Bytes of all groups' values up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Values of a group that travel as one array.
MOST_VALUES = 1_000_000
#: Resamples that a task draws from an array, and draws at once.
PER_ROW = 100
STRIP = 1 << 18


def resample_index(resample: np.ndarray, position: np.ndarray, n: int) -> np.ndarray:
    """Pseudo-random indices below n, by integer steps modulo 2^31 that any engine repeats; one row a resample."""
    low = np.uint32(0x7FFFFFFF)
    h = ((resample.astype(np.int64) * 1000003) & 0x7FFFFFFF).astype(np.uint32)[:, None] + position.astype(np.uint32)[None]
    h &= low
    for _ in range(2):
        h ^= h >> np.uint32(16)
        h *= np.uint32(73244475)
        h &= low
    h ^= h >> np.uint32(16)
    h -= h // np.uint32(n) * np.uint32(n)
    return h


def _sums(columns: list[np.ndarray], begin: int, n: int, resamples: np.ndarray) -> np.ndarray:
    """(resample, column): sums of the drawn values that lie in a block of n positions, which begins at ``begin``."""
    padded = [np.append(c, 0.0) for c in columns]
    size = len(columns[0])
    out = np.zeros((len(resamples), len(columns)))
    at_once = max(1, STRIP // n)
    for r in range(0, len(resamples), at_once):
        for p in range(0, n, STRIP):
            i = resample_index(resamples[r : r + at_once], np.arange(p, min(p + STRIP, n)), n)
            if size < n:
                # what lies in another block, also before this one, becomes the place of the zero
                i = np.minimum(i - np.uint32(begin), np.uint32(size))
            for k, c in enumerate(padded):
                out[r : r + at_once, k] += c.take(i).sum(1)
    return out


def bootstrap(outcomes: DataFrame, keys: list[str], values: list[str], order: str, resamples: int) -> DataFrame:
    """(keys, resample, values): means over n draws with replacement from a group's n rows, the same draws for each value.
    Nulls add nothing; a mean of nulls alone is null.

    A group's values become an array for each MOST_VALUES rows, which go to all tasks if they are small, and resamples draw
    from it where it is, so no values are shuffled. A group of several arrays is drawn from each, and what they give is added."""
    n = outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    row = F.struct(*[F.col(v).cast("double").alias(v) for v in values])
    rows = outcomes.select(*keys, order, row.alias("row"))
    if n <= MOST_VALUES:
        pools = rows.groupBy(*keys).agg(F.lit(0).cast("long").alias("__b"), F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_list(F.struct(order, "row"))).alias("__p"))
    else:
        w = W.partitionBy(*keys)
        placed = rows.withColumn("__i", F.row_number().over(w.orderBy(order, "row")) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
        pools = placed.groupBy(*keys, F.floor(F.col("__i") / MOST_VALUES).alias("__b"), "__n").agg(F.array_sort(F.collect_list(F.struct("__i", "row"))).alias("__p"))
    pools = cut(pools.select(*keys, (F.col("__b") * MOST_VALUES).alias("__b"), "__n", F.transform("__p", lambda x: x["row"]).alias("__p")))
    spark = outcomes.sparkSession
    small = (pools.agg(F.sum(F.size("__p") * len(values) * 8)).head()[0] or 0) <= BROADCAST_BYTES
    firsts = spark.range(0, resamples, PER_ROW, -(-resamples // PER_ROW) if small else spark.sparkContext.defaultParallelism).select(F.col("id").alias("__r"))
    draws = firsts.join(F.broadcast(pools)) if small else firsts.crossJoin(pools)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                first, begin, size = (batch.column(c)[i].as_py() for c in ("__r", "__b", "__n"))
                rs = np.arange(first, min(first + PER_ROW, resamples))
                held = [batch.column("__p")[i].values.field(v) for v in values]
                sums = _sums([pc.fill_null(h, 0.0).to_numpy(zero_copy_only=False) for h in held], begin, size, rs)
                some = np.ones(sums.shape, bool)
                gaps = [k for k, h in enumerate(held) if h.null_count]
                if gaps:
                    some[:, gaps] = _sums([np.asarray(held[k].is_valid()).astype(np.float64) for k in gaps], begin, size, rs) > 0
                same = pa.array(np.full(len(rs), i))
                out = [*(batch.column(k).take(same) for k in keys), pa.array(rs.astype(np.int32)), pa.array(np.full(len(rs), size))]
                yield pa.record_batch([*out, *(pa.array(sums[:, k], mask=~some[:, k]) for k in range(len(values)))], names=[*keys, "resample", "__n", *values])

    types = "".join(f"{k} {outcomes.schema[k].dataType.simpleString()}, " for k in keys)
    drawn = draws.mapInArrow(draw, f"{types}resample int, __n long, {', '.join(f'{v} double' for v in values)}")
    if n > MOST_VALUES:
        drawn = drawn.groupBy(*keys, "resample", "__n").agg(*[F.sum(v).alias(v) for v in values])
    return drawn.select(*keys, "resample", *[(F.col(v) / F.col("__n")).alias(v) for v in values])


#: Buckets of a round of ``percentiles``, and rows of a bucket that are sorted in one task.
BUCKETS = 1024
MOST_SORTED = 100_000


def percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], between: bool, buckets: int = BUCKETS, most: int = MOST_SORTED) -> DataFrame:
    """(keys, value) -> a column for each p: the value at rank ceil(p * n) (``between`` false), or at rank p * (n - 1) counted
    from 0, linearly between its neighbours. Nulls do not count; keys without a value are left out.

    Distributed selection: each wanted rank has a range of values, at first all of them. A round counts the rows of its
    range in buckets, before any shuffle, and narrows the range to the bucket that holds the rank, until that has few rows
    or one value; only such rows are sorted. So no task holds the values of a key, and rounds are few."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__x")).filter("__x is not null")
    spans = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    wanted = []
    for name, p in ps.items():
        at = p * (F.col("__n") - 1) if between else F.greatest(F.ceil(F.lit(p) * F.col("__n")) - 1, F.lit(0)).cast("double")
        wanted += [F.struct(F.lit(name).alias("name"), F.floor(at).alias("rank"), (1 - (at - F.floor(at))).alias("share")), F.struct(F.lit(name).alias("name"), F.ceil(at).alias("rank"), (at - F.floor(at)).alias("share"))]
    state = spans.withColumn("w", F.explode(F.array(*wanted))).select(*keys, "w.*", F.lit(0).cast("long").alias("before"), "__n", "__lo", "__hi").filter("share > 0")
    on, of = [*keys, "name", "rank"], W.partitionBy(*keys, "name", "rank")
    state = cut(state)
    while not state.filter((F.col("__n") > most) & (F.col("__lo") < F.col("__hi"))).isEmpty():
        inside = rows.join(state, keys).filter((F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi")))
        bucket = F.least(F.floor(F.try_divide(F.col("__x") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * buckets), F.lit(buckets - 1))
        counted = inside.groupBy(*on, "share", "before", F.coalesce(bucket, F.lit(0)).alias("__b")).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        upto = counted.withColumn("__upto", F.col("before") + F.sum("__n").over(of.orderBy("__b")))
        state = cut(upto.filter((F.col("__upto") > F.col("rank")) & (F.col("__upto") - F.col("__n") <= F.col("rank"))).select(*keys, "name", "rank", "share", (F.col("__upto") - F.col("__n")).alias("before"), "__n", "__lo", "__hi"))
    one = state.filter("__lo = __hi").select(*keys, "name", "share", F.col("__lo").alias("__v"))
    inside = rows.join(state.filter("__lo < __hi"), keys).filter((F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi")))
    few = inside.withColumn("__r", F.row_number().over(of.orderBy("__x")) - 1 + F.col("before")).filter("__r = rank").select(*keys, "name", "share", F.col("__x").alias("__v"))
    both = one.unionByName(few).groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == n, F.col("__v") * F.col("share"))).alias(n) for n in ps])
    return both
