"""Line dedup with two Bloom filters.

The filters are cut into segments by the hash of the line, so they grow with the corpus and no machine holds one
whole. A first pass hashes every line (each key once a document) and sends the hashes, packed by segment, to where the
segment is: one filter holds the keys seen once, the other those that were in the first already, and what enters the
second is a suspect. The suspects' hashes alone, as one filter again, go to all tasks; only lines that this filter may
hold are hashed with SHA-256, and the digests, counted by document inside each task, are shuffled and counted exactly.
False suspects cost a little shuffle and change nothing; no repeat can be missed. A last pass drops the lines where
they are read, so texts are not shuffled.

The filter of suspects is sized by their number up to a bound (FILTER_BITS, an eighth of it in repeated keys); beyond
it more lines become suspects and the result stays the same. The digests found are broadcast behind a check of their
number; beyond, every document is joined with its own.

Cases: null or empty text is one empty line; a key of fewer than ``min_key`` code points is never dropped; a line
that occurs twice in one document counts once; rows that share a doc_id are separate documents; very long lines are
keyed by their digest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .shared import BROADCAST_ROWS, documents, keep, keyed

#: Bits of a filter for each key that it may hold, and of the segments that the once- and twice-seen filters are cut to.
BITS_PER_LINE = 8
SEGMENT = 1 << 20
#: Bits of the filter of suspects that a task holds; more than 100 million repeated keys fill it.
FILTER_BITS = 1 << 30
MIN_DOCS = 10
MIN_KEY = 1

U64 = np.uint64


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & U64(bits - 1)).astype(np.int64), ((h >> U64(33)) * U64(0x9E3779B1) & U64(bits - 1)).astype(np.int64)


def _keys(data: np.ndarray, offs: np.ndarray, min_key: int):
    """Spans of all lines, spans of their keys, which keys are long enough, the keys' hashes and documents."""
    s, e, first = B.lines(data, offs)
    ts, te = B.stripped(data, s, e)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    use = np.flatnonzero(leads[te] - leads[ts] >= min_key)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))[use]
    return s, e, first, ts, te, use, B.hashes(data, ts[use], te[use], True), owner


def _filter_bits(keys: int, most: int, segment: int) -> int:
    return max(segment, min(most, 1 << max(1, BITS_PER_LINE * keys - 1).bit_length()))


def twice_seen(keyed_docs: DataFrame, lines: int, min_key: int, bits: int = SEGMENT) -> DataFrame:
    """(kept) packed hashes of the keys that two documents or more may have."""
    n_segments = max(1, -(-lines * BITS_PER_LINE // bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def sent() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            segment = (B.mix(h) % U64(n_segments)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            h, c, segment = h[order], c[order], segment[order]
            which, first = np.unique(segment, return_index=True)
            cut = [*first.tolist(), len(h)]
            packed = [[x.tobytes() for x in np.split(v, cut[1:-1])] for v in (h, c > 1)]
            return pa.record_batch([pa.array(which, pa.int64()), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], names=["segment", "hashes", "again"])

        for batch in batches:
            for _, _, data, offs in B.texts(batch, "text"):
                *_, h, owner = _keys(data, offs, min_key)
                pair = np.unique(np.stack([owner.astype(U64), h]), axis=1)[1] if len(h) else h
                held.append(pair)
                n += len(pair)
                if n > 2_000_000:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment; only one segment's two filters are held, and the suspects it has sent: what the
        twice-seen filter does not know is new, what it may know is looked up there, so no suspect is lost to it."""
        now, once, twice, sent = None, np.zeros(0, bool), np.zeros(0, bool), set()
        for batch in batches:
            out = []
            for k, packed, again in zip(*(batch.column(c).to_pylist() for c in ("segment", "hashes", "again"))):
                if k != now:
                    now, once, twice, sent = k, np.zeros(bits, bool), np.zeros(bits, bool), set()
                h = np.frombuffer(packed, U64)
                a, b = _probes(h, bits)
                seen = (once[a] & once[b]) | np.frombuffer(again, bool)
                known = np.flatnonzero(seen & twice[a] & twice[b])
                fresh = seen.copy()
                fresh[known] = [x not in sent for x in h[known].tolist()]
                sent.update(h[fresh].tolist())
                once[a] = once[b] = True
                twice[a[fresh]] = twice[b[fresh]] = True
                out.append(h[fresh].tobytes())
            yield pa.record_batch([pa.array(out, pa.binary()), pa.array([len(x) // 8 for x in out], pa.int64())], names=["hashes", "n"])

    parts = keyed_docs.select("text").mapInArrow(scan, "segment long, hashes binary, again binary")
    return keep(parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(meet, "hashes binary, n long").filter("n > 0"), "suspects")


def suspect_filter(suspects: DataFrame, most: int, segment: int = SEGMENT) -> tuple[bytes, int]:
    """The suspects' hashes as one filter of at most ``most`` bits, packed; it is gathered segment by segment."""
    bits = _filter_bits(suspects.agg(F.sum("n")).head()[0] or 0, most, segment)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), U64)
            at = np.unique(np.concatenate(_probes(h, bits)))
            which, first = np.unique(at // segment, return_index=True)
            yield pa.record_batch([pa.array(which, pa.int64()), pa.array([(x % segment).astype("<u4").tobytes() for x in np.split(at, first[1:])], pa.binary())], names=["segment", "at"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, np.zeros(0, bool)

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for k, at in zip(batch.column("segment").to_pylist(), batch.column("at").to_pylist()):
                if k != now:
                    if now is not None:
                        yield out()
                    now, seen = k, np.zeros(segment, bool)
                seen[np.frombuffer(at, "<u4")] = True
        if now is not None:
            yield out()

    merged = suspects.select("hashes").mapInArrow(scan, "segment long, at binary").repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment long, bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        whole[r.segment * segment // 8 : (r.segment + 1) * segment // 8] = np.frombuffer(r.bits, np.uint8)
    return whole.tobytes(), bits


def _suspect(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    a, b = _probes(h, bits)
    return (table[a >> 3] >> (7 - (a & 7)).astype(np.uint8) & table[b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1).astype(bool)


def _digests(data: np.ndarray, ts: np.ndarray, te: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [hashlib.sha256(raw[ts[i] : te[i]].translate(B.LOWER_BYTES)).digest() for i in at]


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_key: int = MIN_KEY, filter_bits: int = FILTER_BITS):
    """(digests of the keys found in ``min_docs`` documents or more with their first (doc_id, line), the filter)."""
    spark = docs.sparkSession
    n_lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).head()[0] or 0
    packed, bits = suspect_filter(twice_seen(docs, n_lines, min_key), filter_bits)
    shared = spark.sparkContext.broadcast(packed)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found: dict[bytes, list] = {}
            for a, _, data, offs in B.texts(batch, "text"):
                s, e, first, ts, te, use, h, owner = _keys(data, offs, min_key)
                hit = np.flatnonzero(_suspect(h, table, bits))
                last: dict[bytes, int] = {}
                for d, i, o in zip(_digests(data, ts, te, use[hit]), use[hit], owner[hit]):
                    if last.get(d) == o:
                        continue
                    last[d] = o
                    doc, line = ids[a + o], int(i - first[o])
                    x = found.get(d)
                    if x is None:
                        found[d] = [1, doc, line]
                    else:
                        x[0] += 1
                        if doc is not None and (x[1] is None or (doc, line) < (x[1], x[2])):
                            x[1:] = doc, line
            if found:
                yield pa.record_batch([pa.array(list(found), pa.binary()), *(pa.array([x[k] for x in found.values()], pa.int64()) for k in range(3))], names=["digest", "n", "doc_id", "line"])

    rows = docs.mapInArrow(suspects, "digest binary, n long, doc_id long, line long")
    # null ids sort last among first occurrences
    counted = rows.groupBy("digest").agg(F.sum("n").alias("n_docs"), F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "line")).alias("first"))
    return keep(counted.filter(F.col("n_docs") >= min_docs), "lines"), shared, bits


def _drop(shared, bits: int, min_key: int, hot, keep_first: bool):
    """hot: digest -> first (doc_id, line), or None if each row brings its own in column ``drop``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            own = batch.column("drop").to_pylist() if hot is None else None
            for a, b, data, offs in B.texts(batch, "text"):
                s, e, first, ts, te, use, h, owner = _keys(data, offs, min_key)
                hit = np.flatnonzero(_suspect(h, table, bits))
                gone = np.zeros(len(s), bool)
                seen: set[tuple[int, bytes]] = set()
                for d, i, o in zip(_digests(data, ts, te, use[hit]), use[hit], owner[hit]):
                    where = hot.value.get(d) if own is None else next(((x["doc_id"], x["line"]) for x in own[a + o] or () if x["digest"] == d), None)
                    if where is not None:
                        gone[i] = not (keep_first and where == (ids[a + o], int(i - first[o])) and (o, d) not in seen)
                        seen.add((o, d))
                raw, kept = data.tobytes(), []
                dropped = np.concatenate([[0], np.cumsum(gone)])
                counts = dropped[first[1:]] - dropped[first[:-1]]
                for k in range(b - a):
                    if counts[k]:
                        kept.append(b"\n".join([raw[s[j] : e[j]] for j in range(first[k], first[k + 1]) if not gone[j]]))
                    else:
                        kept.append(raw[offs[k] : offs[k + 1]])
                yield pa.record_batch([batch.column("doc_id")[a:b], batch.column("xh")[a:b], pa.array(np.diff(first), pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "xh", "n_lines", "n_dropped", "kept"])

    return task


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_key: int = MIN_KEY, keep_first: bool = False, broadcast_rows: int = BROADCAST_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text. ``keep_first`` keeps a key's first line in (doc_id, line) order."""
    rows = keyed(docs)
    hot, shared, bits = repeated_lines(rows, min_docs, min_key, filter_bits)
    schema = "doc_id long, xh long, n_lines long, n_dropped long, kept binary"
    if hot.count() <= broadcast_rows:
        table = docs.sparkSession.sparkContext.broadcast({bytes(r.digest): (r.first.doc_id, r.first.line) for r in hot.select("digest", "first").toLocalIterator()})
        out = rows.mapInArrow(_drop(shared, bits, min_key, table, keep_first), schema)
    else:
        def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filt = np.frombuffer(shared.value, np.uint8)
            for batch in batches:
                for a, _, data, offs in B.texts(batch, "text"):
                    _, _, _, ts, te, use, h, owner = _keys(data, offs, min_key)
                    hit = np.flatnonzero(_suspect(h, filt, bits))
                    pairs = list(dict.fromkeys(zip((owner[hit] + a).tolist(), _digests(data, ts, te, use[hit]))))
                    at = pa.array([p[0] for p in pairs], pa.int64())
                    yield pa.record_batch([batch.column("doc_id").take(at), batch.column("xh").take(at), pa.array([p[1] for p in pairs], pa.binary())], names=["doc_id", "xh", "digest"])

        theirs = rows.mapInArrow(lines_of, "doc_id long, xh long, digest binary").distinct().join(hot, "digest")
        theirs = theirs.groupBy(F.col("doc_id").alias("d"), F.col("xh").alias("x")).agg(F.collect_list(F.struct("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"))).alias("drop"))
        both = rows.join(theirs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xh") == F.col("x")), "left").select("doc_id", "xh", "text", "drop")
        out = both.mapInArrow(_drop(shared, bits, min_key, None, keep_first), schema)
    return out.select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("text"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, line, lower_ascii AS key FROM (
    SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line,
           translate(regexp_replace(unnest(ls), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
h AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(h.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN h ON l.key = h.key GROUP BY doc_id
"""
