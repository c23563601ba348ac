"""Tables and files in the folder that driver and executors share, and joins that check a size before they broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A kept table is broadcast up to so many rows and decoded bytes; beyond, the join shuffles both sides.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 << 20


def base(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir if the cluster names one, else the session's checkpoint folder, else one of
    our own; that only on one machine, since executors elsewhere would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: this ends the lineage, and a lost executor costs nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def decoded_size(df: DataFrame) -> Column:
    """Bytes that a row takes when it is decoded: 8 a column and for an array's each element, and those of strings."""
    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StringType | T.BinaryType):
                return F.aggregate(c, F.lit(16).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
            return 16 + F.size(c) * 8
        if isinstance(kind, T.StringType | T.BinaryType):
            return 16 + F.octet_length(c)
        if isinstance(kind, T.StructType):
            return sum((F.coalesce(of(c[f.name], f.dataType), F.lit(8)) for f in kind.fields), F.lit(8))
        return F.lit(8)

    return sum((F.coalesce(of(F.col(f"`{f.name}`"), f.dataType), F.lit(8)) for f in df.schema.fields), F.lit(16)).cast("long")


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Is a kept table small by rows and decoded bytes? Its stored size, always known, says so first for large ones."""
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if stored > size:
        return False
    n, total = df.agg(F.count(F.lit(1)), F.sum(decoded_size(df))).head()
    return n <= rows and (total or 0) <= size


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a kept table for broadcast if it fits; otherwise leave the join to shuffle."""
    return F.broadcast(df) if fits(df, limit) else df


def text_key(text: str = "text") -> Column:
    """Tells apart rows that share a doc_id; computed by Spark at the scan, so it costs no Python."""
    return F.xxhash64(F.col(text))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text key and the text; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("xh"), F.col("text").cast("string").alias("text"), *more)


def row_key(docs: DataFrame, row: Column) -> Column:
    """A hash of all columns of a row: rows that agree in it are interchangeable."""
    return F.xxhash64(F.to_json(row) if "map<" in docs.schema.simpleString() else row)


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def tagged(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(row, k, xh): all columns as one struct, so that no name of theirs meets one of ours, and the row's key: doc_id and
    a hash of the text, or with ``whole`` of all columns."""
    row = whole_row(docs)
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("k"), (row_key(docs, row) if whole else text_key()).alias("xh"))


def untagged(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def keyed_join(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Tagged rows (r) joined with a kept table that has doc_id and xh (s); broadcast if it is small."""
    return rows.alias("r").join(small(keys).alias("s"), F.col("r.k").eqNullSafe(F.col("s.doc_id")) & (F.col("r.xh") == F.col("s.xh")), how)
