"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is two aggregations and two joins over (src, dst) longs; it is written to the shared folder, so lineage
stays short and a lost executor costs one step. The centre of a star may have any number of neighbours: minima are
combined before the shuffle, and the joins are of the kind that Spark splits when a key is hot. The steps grow with the
logarithm of the number of nodes, and go on until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep


def components(edges: DataFrame) -> DataFrame:
    """(src, dst) longs -> (node, root): every node that an edge touches with the least node that it reaches."""
    now = keep(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src > dst").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
        # large star: the larger neighbours of a node are tied to the least of its neighbourhood
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        # small star: so are the smaller ones, and the node itself
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        small = small.unionByName(least.select("src", F.col("m").alias("dst")))
        now = keep(small.filter("src > dst").distinct(), "edges")
        # stars do not change any more when every node has one edge and no root has one
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    nodes = now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return nodes.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
