"""Exact nearest neighbours by cosine, for many queries at once.

Vectors are packed into chunks of rows that lie in one cell (their nearest of a few pivots) at about one distance from
it, queries into blocks, and every chunk meets every block once: the set of queries is stated, and the work of one
meeting is a matrix product in a task. A bounded sample of stored vectors, the pivots among them, tells what each query's
k-th neighbour has at least; by the triangle inequality a chunk whose distances to its pivot are too unlike a query's own
cannot hold a better one, and is skipped for that query. A meeting leaves k rows a query at most, which are merged.

Cosine is 0 where a vector has no length and null, hence no neighbour, where it is missing. Similarities are rounded to
nine digits before they are ranked; of equal ones the smaller id is nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stored vectors that pivots and first bounds come from, pivots among them, rows of a chunk and queries of a block.
SAMPLE = 1024
PIVOTS = 16
CHUNK = 2048
BLOCK = 1024
SLACK = 1e-8


def _unit(vs: list) -> np.ndarray:
    x = np.array(vs, np.float64).reshape(len(vs), -1 if vs else 0)
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of a batch's rows that have a vector."""
    v = batch.column("v")
    some = np.flatnonzero(np.asarray(v.is_valid()))
    return np.asarray(batch.column("id"))[some], _unit([v[int(i)].as_py() for i in some])


def _sample(vectors: DataFrame) -> np.ndarray:
    return _unit([r.v for r in vectors.filter("v is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def _packed(df: DataFrame, pivots: np.ndarray, size: int, name: str) -> DataFrame:
    """Rows by cell and distance, packed: ids, vectors and the nearest and farthest distance of each pack."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _matrix(batch)
            if len(ids):
                d = _distances(x, pivots)
                cell = d.argmin(1)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())], names=["id", "x", "cell", "r"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, xs, cells, rs = zip(*held)
            row = [np.array(ids, np.int64).tobytes()], [b"".join(xs)], [cells[0]], [min(rs)], [max(rs)], [len(ids)]
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, (pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int32()))], names=["ids", "xs", "cell", "low", "high", "n"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "x", "cell", "r"))):
                if held and (held[0][2] != row[2] or len(held) >= size):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    placed = df.select("id", "v").mapInArrow(place, "id long, x binary, cell int, r double")
    ordered = placed.repartitionByRange("cell", "r").sortWithinPartitions("cell", "r")
    packs = ordered.mapInArrow(pack, "ids binary, xs binary, cell int, low double, high double, n int")
    return packs.select(*[F.col(c).alias(f"{name}_{c}") for c in packs.columns])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, chunk: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, v), (id, v) -> (q, id, similarity, rank) of each query's k nearest vectors; and (met, skipped): pairs of a query
    and a vector that were multiplied or passed over."""
    sample = _sample(vectors)
    if not len(sample):
        spark = vectors.sparkSession
        return spark.createDataFrame([], "q long, id long, similarity double, rank int"), spark.createDataFrame([], "met long, skipped long")
    pivots = sample[:PIVOTS]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                get = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                qs, ids = np.frombuffer(get["q_ids"], np.int64), np.frombuffer(get["x_ids"], np.int64)
                q, x = np.frombuffer(get["q_xs"]).reshape(len(qs), -1), np.frombuffer(get["x_xs"]).reshape(len(ids), -1)
                at_least = np.sort(q @ sample.T, axis=1)[:, -k] if len(sample) >= k else np.full(len(qs), -2.0)
                d = _distances(q, pivots[get["x_cell"]][None])[:, 0]
                apart = np.maximum(np.maximum(d - get["x_high"], get["x_low"] - d) - SLACK, 0)
                use = np.flatnonzero(1 - apart * apart / 2 >= at_least - SLACK)
                s = np.round(q[use] @ x.T, 9)
                n = min(k, len(ids))
                # the k largest of each query, of equal ones the smaller ids
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :n]
                keep = np.take_along_axis(s, order, 1) >= at_least[use, None] - SLACK
                rows, cols = np.nonzero(keep)
                found = order[rows, cols]
                # a meeting's count comes as a row without a query
                met = len(use) * len(ids)
                yield pa.record_batch([
                    pa.array([None, *qs[use][rows].tolist()], pa.int64()), pa.array([met, *ids[found].tolist()], pa.int64()), pa.array([float(len(qs) * len(ids) - met), *s[rows, found].tolist()], pa.float64()),
                ], names=["q", "id", "similarity"])

    pairs = _packed(vectors, pivots, chunk, "x").crossJoin(_packed(queries, pivots, block, "q"))
    out = pairs.mapInArrow(meet, "q long, id long, similarity double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("similarity"), "id"))
    nearest = out.filter("q is not null").withColumn("rank", rank).filter(F.col("rank") <= k)
    return nearest, out.filter("q is null").agg(F.sum("id").alias("met"), F.sum("similarity").cast("long").alias("skipped"))
