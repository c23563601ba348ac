"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time [0, 1], piecewise linear. Its integral is the source's weight,
and the weights share out the token budget (shares above ``cap`` times what a source holds are cut there and the excess
is shared again by weight). What a source has to deliver by a time, its cumulative demand, is its target times the
schedule's integral up to then. The source's documents stand in a fixed pseudo-random order, over which it is passed
again and again; a copy of a document is due when the demand reaches the middle of its tokens, so inverting the
demand gives the copy's position in training. Copies whose middle the demand does not reach before training ends have
no position and are not taken, so what is taken is within half a document of the target. Range-sorting by position
interleaves the sources as their schedules say.

One source may hold a third of the corpus: documents are grouped by (source, slice of the pseudo-random order of their
ids and texts, so one id may be on any number of rows; only rows equal in both share a slice), sizes are summed per slice before any shuffle, and only slices are accumulated per source, so no task meets a source.

Cases: null or empty texts have size 0 and are taken as others are, with 0 words; null sources form one source that
comes last; rows that share a doc_id (repeated rows too) are separate documents, ordered by doc_id and key (a hash of
the text in the query, of the whole row in ``mix``) and then arbitrarily among equal rows, which are interchangeable
except that only some may be taken; a null doc_id sorts first; of sources of size 0 (target 0) nothing is taken; an
empty table gives an empty result; other columns are carried by ``mix`` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import documents, keep, keyed_join, row_key, tagged, untagged, whole_row

#: Weight at times 0, 1/2 and 1, linear between, for the 1st, 2nd and 3rd weight class: integrals 1, 2 and 3.
SCHEDULES = ((1.5, 1.0, 0.5), (1.5, 2.5, 1.5), (1.5, 3.0, 4.5))
CAP = 3
#: Slices of a source's order. Fixed, so that the order and the result do not depend on the cluster.
SLICES = 1024

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def place(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 pseudo-random bits of a document's id and text, the same in any engine with md5. The text is part of it so that
    documents without an id, or with one id, do not all fall into one slice."""
    name = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def areas(schedule: tuple[float, ...]) -> list[float]:
    """The integral over each piece of a schedule whose knots are evenly spaced over [0, 1]."""
    h = 1.0 / (len(schedule) - 1)
    return [h * (a + b) / 2 for a, b in zip(schedule, schedule[1:])]


def targets(sizes: DataFrame, schedules=SCHEDULES, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> weight class and target. The weight is the schedule's integral. The level t with
    sum(min(weight * t, cap * size)) = sum(size) is found in closed form: sources in ascending cap * size / weight are
    full up to the one where the rest suffices. The table has one row a source and is accumulated in one window."""
    weights = [sum(areas(x)) for x in schedules]
    rows = sizes.withColumn("cls", (F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("cls") + 1)).withColumn("most", cap * F.col("source_size").cast("double"))
    rows = rows.withColumn("at", F.col("most") / F.col("weight"))
    up = W.orderBy("at", F.col("source").isNull(), "source")
    rows = rows.withColumn("full_before", F.coalesce(F.sum("most").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double"))
    rows = rows.withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    # the level is that of the first source that it does not fill; if it fills all, each has its most
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(W.partitionBy())["level"]
    return rows.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("weight") * level, F.col("most")))).select("source", "source_size", "cls", "target")


def inverse_demand(share: Column, cls: Column, schedules=SCHEDULES) -> Column:
    """The time by which a source with this weight class has delivered ``share`` of its target; null beyond its end.

    Between knots the weight is linear, a + (b - a) * u, and its integral h * (a * u + (b - a) * u * u / 2) is
    inverted with the stable root 2 * c / (a + sqrt(a * a + 2 * (b - a) * c))."""
    out = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        h, pieces, done = 1.0 / (len(schedule) - 1), areas(schedule), 0.0
        total, time = sum(pieces), F.lit(None).cast("double")
        steps = []
        for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
            c = (share * total - done) / h
            root = F.sqrt(F.greatest(F.lit(a * a) + 2 * (b - a) * c, F.lit(0.0)))
            steps.append((done + pieces[i], h * i + h * F.least(F.coalesce(F.try_divide(2 * c, F.lit(a) + root), F.lit(0.0)), F.lit(1.0))))
            done += pieces[i]
        for upto, value in reversed(steps):
            time = F.when(share * total <= upto, value).otherwise(time)
        out = F.when(cls == k, time).otherwise(out)
    return out


def plan(sized: DataFrame, schedules=SCHEDULES, cap: float = CAP, slices: int = SLICES) -> DataFrame:
    """(doc_id, xh, r, source, size) -> also source_size, target and positions: where in training each copy of the
    document that the mix takes is due, ascending."""
    rows = sized.withColumn("slice", F.shiftrightunsigned("r", 60 - (slices - 1).bit_length()))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sums = sums.withColumn("before", F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)))
    per_source = targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), schedules, cap)
    sums = sums.select("source", "slice", F.coalesce("before", F.lit(0)).alias("before"))
    s = sums.alias("s").join(per_source.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.*", "source_size", "cls", "target")
    rows = rows.alias("d").join(s.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.slice") == F.col("s.slice"))).select("d.*", "before", "source_size", "cls", "target")
    order = W.partitionBy("source", "slice").orderBy("r", F.col("doc_id").asc_nulls_first(), "xh").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # the demand that each pass over the source, up to ``cap`` of them, meets with the middle of the document
    middles = F.transform(F.sequence(F.lit(0), F.lit(int(cap) - 1)), lambda j: F.col("start") + j * F.col("source_size") + F.col("size") / 2.0)
    due = F.transform(middles, lambda m: inverse_demand(F.try_divide(m, "target"), F.col("cls"), schedules))
    return rows.withColumn("positions", F.filter(due, F.isnotnull)).drop("r", "slice", "before", "cls", "start")


def training_order(planned: DataFrame, *columns: str) -> DataFrame:
    """One row for each copy taken, with its training position, range-sorted by it."""
    placed = planned.select(*columns, F.explode("positions").alias("position"))
    return placed.repartitionByRange("position").sortWithinPartitions("position", *columns)


def sized(docs: DataFrame, key: Column | None = None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.xxhash64("text") if key is None else key).alias("xh"), place().alias("r"), F.col("source").cast("string").alias("source"), n_words().alias("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' own columns, one row for each copy taken, in training order.

    The plan is made from narrow rows and written down; the texts move once, in the range sort. Rows that agree in
    all columns are planned as one group: one of them stands for the copies of all."""
    planned = keep(plan(sized(docs, row_key(docs, whole_row(docs))), **options), "mix-plan")
    groups = planned.groupBy("doc_id", "xh").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("ats"), (F.count(F.lit(1)) > 1).alias("equal")).filter(F.size("ats") > 0)
    groups = keep(groups, "mix-places")
    rows = tagged(docs, whole=True)

    def taken(rows: DataFrame, some: DataFrame) -> DataFrame:
        return keyed_join(rows, some, "inner").select("r.row", "r.k", F.explode("s.ats").alias("position"))

    out = taken(rows, keep(groups.filter("not equal"), "mix-single"))
    twice = keep(groups.filter("equal"), "mix-equal")
    if not twice.isEmpty():
        out = out.unionByName(taken(keyed_join(rows, twice, "left_semi").dropDuplicates(["k", "xh"]), twice))
    return untagged(out.repartitionByRange("position", "k").sortWithinPartitions("position", "k"), docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it and the position of its first copy, in training order."""
    planned = keep(plan(sized(documents(spark, sf_dir))), "mix-plan")
    out = planned.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.size("positions") * F.col("size")).cast("long").alias("taken"),
        F.round(F.try_element_at("positions", F.lit(1)), 6).alias("position"),
    )
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS r
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::DOUBLE AS weight
  FROM d GROUP BY source),
a AS (SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / weight AS fill, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
b AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM a),
c AS (SELECT source, source_size, weight, least(most, coalesce(weight * (SELECT arg_min(level, fill) FROM b WHERE level <= fill), most))::DOUBLE AS target FROM b),
e AS (
  SELECT d.*, c.source_size, c.target, ((c.weight - 1) % 3)::INT AS cls,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY r, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
-- schedules: weight at times 0, 1/2, 1; integrals 1, 2, 3
k(cls, a, b, z, total) AS (VALUES (0, 1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE), (1, 1.5, 2.5, 1.5, 2.0), (2, 1.5, 3.0, 4.5, 3.0)),
m AS (
  SELECT e.*, a, b, z, (a + b) / 4 AS half, ((start + j * source_size + size / 2.0::DOUBLE) / nullif(target, 0)) * total AS due, total
  FROM e JOIN k USING (cls), range(0, 3) t(j)),
p AS (
  SELECT *, CASE WHEN due <= half THEN least(2 * (due / 0.5) / (a + sqrt(greatest(a * a + 2 * (b - a) * (due / 0.5), 0))), 1) * 0.5
                 WHEN due <= total THEN 0.5 + 0.5 * least(2 * ((due - half) / 0.5) / (b + sqrt(greatest(b * b + 2 * (z - b) * ((due - half) / 0.5), 0))), 1) END AS position
  FROM m)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * count(position))::BIGINT AS taken, round(min(position), 6) AS position
FROM p GROUP BY n, doc_id, size, source_size, target
"""
