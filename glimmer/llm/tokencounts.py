"""Token counts by separator scan of flat token files.

A flat file is nothing but ids (little-endian, two bytes where the vocabulary allows, else four), every document
followed by the end-of-document id: no header and no index. Files are cut into blocks of equal length that any task
may read; each block is searched for the end id in one vectorised step, and what straddles blocks is stitched by a
prefix scan: the running maximum of the last separator's place tells each block where its first document began.

The query first writes the corpus as such files. Which document is the k-th of a file is kept beside them, as a list
of doc_ids, for the files themselves do not say.

Cases: null or empty texts count 0; ids left over after the last separator are one more, unended document; an end id
that a text itself yields is impossible here, since special tokens in texts are encoded as ordinary text; rows that
share a doc_id are separate documents; null doc_ids are carried; an empty table writes nothing and gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoding import default_path, encoder
from .files import Reader, TaskFile
from .shared import documents, folder, keep

BLOCK_IDS = 1 << 20
#: Blocks that a task scans, once there are enough for all cores.
TASK_BLOCKS = 32
END = "<|endoftext|>"


def write_flat(docs: DataFrame, path: str, tokenizer: str, end: str = END) -> DataFrame:
    """(kept) uri, n_bytes, id_bytes, end_id, doc_ids in the file's order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, ids = encoder(tokenizer, ordinary=True), None, []
        end_id = enc.tokenizer.token_to_id(end)
        kind = "<u2" if enc.vocabulary <= 1 << 16 else "<u4"
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                out = out or TaskFile(path, ".bin")
                for x in enc.encode([(t or "").encode() for t in part.column("text").to_pylist()]):
                    out.write(np.append(x, np.uint32(end_id)).astype(kind).tobytes())
                ids += part.column("doc_id").to_pylist()
        if out is not None:
            n = out.at
            yield pa.record_batch([pa.array([out.close()]), pa.array([n], pa.int64()), pa.array([int(kind[2])], pa.int32()), pa.array([end_id], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["uri", "n_bytes", "id_bytes", "end_id", "doc_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keep(rows.mapInArrow(task, "uri string, n_bytes long, id_bytes int, end_id long, doc_ids array<long>"), "flat-files")


def count_flat(files: DataFrame, block_ids: int = BLOCK_IDS, n_tasks: int | None = None) -> DataFrame:
    """(uri, n_bytes, id_bytes, end_id) -> (uri, ordinal, n_tokens), separators not counted."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            for uri, size, width, end_id, k in zip(*(batch.column(c).to_pylist() for c in ("uri", "n_bytes", "id_bytes", "end_id", "block"))):
                if held[0] != uri:
                    held = (uri, Reader(uri))
                at = k * block_ids * width
                ids = np.frombuffer(held[1].read(at, min(block_ids * width, size - at)), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + k * block_ids
                rest = len(ids) + k * block_ids if at + block_ids * width >= size else None
                yield pa.record_batch(
                    [pa.array([uri]), pa.array([k], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([rest], pa.int64())],
                    names=["uri", "block", "n_ends", "last_end", "ends", "file_end"],
                )

    cuts = files.select("uri", "n_bytes", "id_bytes", "end_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / (F.col("id_bytes") * F.lit(block_ids))).cast("long"))).alias("block"))
    cuts = cuts.filter("n_bytes > 0")
    if n_tasks is None:
        n_blocks, cores = cuts.count(), files.sparkSession.sparkContext.defaultParallelism
        n_tasks = max(1, min(n_blocks, cores), -(-n_blocks // TASK_BLOCKS))
    blocks = keep(cuts.repartition(n_tasks).mapInArrow(task, "uri string, block long, n_ends long, last_end long, ends array<long>, file_end long"), "blocks")
    before = W.partitionBy("uri").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    scan = blocks.select("uri", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last_end").over(before), F.lit(-1).cast("long")).alias("end_before"))
    stitched = blocks.join(scan, ["uri", "block"])
    # ids after the file's last separator are a document of their own
    tail = F.col("file_end").isNotNull() & (F.col("file_end") > F.greatest("end_before", F.coalesce("last_end", F.lit(-1).cast("long"))) + 1)
    ends = F.concat("ends", F.when(tail, F.array("file_end")).otherwise(F.array().cast("array<long>")))
    each = stitched.select("uri", "docs_before", "end_before", ends.alias("ends"), F.posexplode(ends).alias("i", "end"))
    begin = F.when(F.col("i") == 0, F.col("end_before")).otherwise(F.expr("element_at(ends, greatest(i, 1))"))
    return each.select("uri", (F.col("docs_before") + F.col("i")).alias("ordinal"), (F.col("end") - begin - 1).alias("n_tokens"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_flat(documents(spark, sf_dir), folder(spark, "flat"), default_path())
    counts = count_flat(files)
    names = files.select("uri", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    return counts.join(names.withColumn("ordinal", F.col("ordinal").cast("long")), ["uri", "ordinal"]).select("doc_id", "n_tokens")
