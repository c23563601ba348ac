"""Results of models, stored by what they were computed from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(content: str, model: str, settings: str = "") -> Column:
    """The address of a result: a digest of the content, the model's name and its settings; null of null content."""
    return F.sha2(F.concat_ws("|", F.sha2(F.col(content).cast("binary"), 256), F.lit(model), F.lit(settings)), 256)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing has been stored yet
        return spark.createDataFrame([], schema)


def cached(df: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], content: str, out: str, kind: str, model: str, settings: str = "") -> DataFrame:
    """``df`` with column ``out`` in place of ``content``: results stored under ``path`` are read, and only for contents
    without one ``compute`` runs, once for each content however many rows have it; it takes (key, content) and gives
    (key, out). New results are appended to the store before anything is read back, so a run that is repeated, or begun
    again after a loss, computes nothing that was stored. Rows with null content have a null result.

    Keys are joined without contents: a missing content is picked by one of its rows."""
    spark, schema = df.sparkSession, f"key string, {out} {kind}"
    rows = df.withColumn("__key", F.when(F.col(content).isNotNull(), content_key(content, model, settings)))
    missing = rows.filter("__key is not null").select(F.col("__key").alias("key"), content).join(stored(spark, path, schema).select("key"), "key", "left_anti")
    new = compute(missing.groupBy("key").agg(F.any_value(content).alias(content))).select("key", out)
    new.write.mode("append").parquet(path)
    # two runs at once may store a result twice
    results = stored(spark, path, schema).groupBy("key").agg(F.any_value(out).alias(out))
    return rows.join(results.withColumnRenamed("key", "__key"), "__key", "left").drop("__key", content)
