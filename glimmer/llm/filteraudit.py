"""Audit of filters by a first-failure lookup: what each of five filters removes at each place in each order.

A text's failures are five bits. ``FIRST`` tells for each of the 32 sets of failures and each of the 120 orders the
step at which a text goes, so one scan serves all orders: a task counts its rows by part, label and failures, indexes
the table with what it has counted, adds up removals by part, order and step with np.bincount, and emits one array a
part; the arrays are summed by position. Texts stay where they are read: what travels is an id, a part, four bits and
a SHA-256, by which filter E tells copies.

E has no join on the text, of which a third of all rows may be copies: the smallest id of each text is found by
pre-aggregation, and a row is the first of its text if (id, text) is in that list, a key that spreads. Rows that agree
in id, text and part are counted before they travel on. Labels are broadcast behind a check of their size; beyond it
they are joined on the id and a salt of the text, by a shuffle: Spark takes the salted copies to be as small as the file
that they are made from, and would broadcast them.

Cases: null text is empty, null lang is the part ''; rows that share a doc_id are separate documents, and neither is a
copy of the other by E, which asks for a smaller id; a null doc_id is smaller than none, is never removed by E and has
no labels; a doc_id with several labels has quality or toxic if one of them says so, null labels say nothing; an empty
table gives an empty result; texts of any length are measured whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .shared import documents, fits, keep

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: FIRST[failures, order]: the step at which a text with these failures (bit k: filter k) goes; STEPS if it stays.
FIRST = np.array([[next((s for s, f in enumerate(order) if m >> FILTERS.index(f) & 1), STEPS) for order in ORDERS] for m in range(1 << STEPS)])

MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
SYMBOLS = b"#$%&*|"

#: Parts that a task counts before it emits them, and copies of a label row where labels are not broadcast.
PARTS_HELD = 256
SALTS = 16

#: Cells of a part's array: removals by order and step, failures and sole failures by filter, rows.
CELLS = len(ORDERS) * STEPS
FAILS, SOLE, ALL = CELLS, CELLS + STEPS, CELLS + 2 * STEPS
WIDTH = ALL + 1

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per text, how many of its bytes are flagged."""
    at = np.flatnonzero(flags)
    return np.diff(np.searchsorted(at, offs))


def distinct_words(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = B.hashes(data, s, e) ^ B.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    return np.bincount(owner[order[new]], minlength=len(first) - 1)


def failures(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits of filters A to D for each text."""
    s, e, first = B.words(data, offs)
    n = np.diff(first)
    points = np.diff(offs) - _sums(~_LEADS[data], offs)
    fails = (n < MIN_WORDS, 100 * distinct_words(data, s, e, first) < MIN_DISTINCT_PERCENT * n, 100 * _sums(_UPPER[data], offs) > MAX_UPPER_PERCENT * points, _sums(_SYMBOL[data], offs) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in B.texts(batch, "text"):
            raw = memoryview(data)
            digests = [hashlib.sha256(raw[offs[i] : offs[i + 1]]).digest() for i in range(b - a)]
            yield pa.record_batch([batch.column("doc_id")[a:b], batch.column("part")[a:b], pa.array(failures(data, offs), pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest): what the audit needs of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return keep(rows.mapInArrow(_measure, "doc_id long, part string, mask int, digest binary"), "audit")


def with_labels(rows: DataFrame, labels: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Adds (label): bit 0 if a label of the id says quality 1, bit 1 if one says toxic 1."""
    says = F.when(F.col("quality") == 1, 1).otherwise(0), F.when(F.col("toxic") == 1, 2).otherwise(0)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (says[0] + says[1]).alias("label")).filter("doc_id is not null and label > 0")
    marks = keep(marks.groupBy("doc_id").agg(F.bit_or("label").alias("label")), "marks")
    if fits(marks) if broadcast is None else broadcast:
        out = rows.join(F.broadcast(marks), "doc_id", "left")
    else:
        salted = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["doc_id", "salt"], "left").drop("salt")
    return out.withColumn("label", F.coalesce("label", F.lit(0)))


def judged(rows: DataFrame, labels: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """(part, mask, label, n): documents by part, all five failures and labels, not yet summed up."""
    named = rows.filter("doc_id is not null").groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    named = named.join(first, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E")))
    nameless = rows.filter("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    return with_labels(named, labels, broadcast).select("part", "mask", "label", "n").union(nameless.select("part", "mask", F.lit(0).alias("label"), "n"))


def _counted(seen: dict[str, np.ndarray]) -> pa.RecordBatch:
    """seen: part -> rows by label and failures. The lookup: each counted cell goes to its step in all orders at once."""
    parts = list(seen)
    part, label, mask = np.nonzero(np.stack([seen[p] for p in parts]))
    n = np.stack([seen[p] for p in parts])[part, label, mask]
    step = FIRST[mask]
    place = np.where(step < STEPS, np.arange(len(ORDERS)) * STEPS + step, WIDTH)
    bits = mask[:, None] >> np.arange(STEPS) & 1
    places = np.concatenate([place, np.where(bits == 1, FAILS + np.arange(STEPS), WIDTH), np.where((bits == 1) & (bits.sum(1, keepdims=True) == 1), SOLE + np.arange(STEPS), WIDTH), np.full((len(mask), 1), ALL)], axis=1)
    arrays = []
    for of in (np.ones(len(n), bool), label & 1 == 1, label & 2 == 2):
        at = part[of, None] * (WIDTH + 1) + places[of]
        total = np.bincount(at.ravel(), np.repeat(n[of], places.shape[1]), len(parts) * (WIDTH + 1)).astype(np.int64).reshape(len(parts), WIDTH + 1)[:, :WIDTH]
        arrays.append(B.lists(total.ravel(), np.arange(len(parts) + 1) * WIDTH, pa.int64()))
    return pa.record_batch([pa.array(parts, pa.string()), *arrays], names=["part", "removed", "good", "toxic"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    shape = 4, 1 << STEPS
    for batch in batches:
        coded = batch.column("part").dictionary_encode()
        names = coded.dictionary.to_pylist()
        cell = (np.asarray(coded.indices).astype(np.int64) * shape[0] + np.asarray(batch.column("label"))) * shape[1] + np.asarray(batch.column("mask"))
        total = np.bincount(cell, np.asarray(batch.column("n")), len(names) * shape[0] * shape[1]).astype(np.int64).reshape(len(names), *shape)
        for name, x in zip(names, total):
            seen[name] = seen[name] + x if name in seen else x
        if len(seen) > PARTS_HELD:
            yield _counted(seen)
            seen = {}
    if seen:
        yield _counted(seen)


def _report(cells: pd.DataFrame) -> pd.DataFrame:
    """One part's summed cells, WIDTH rows, as its 600 rows."""
    x = cells.sort_values("cell")
    removed, good, toxic = (x[c].to_numpy() for c in ("removed", "good", "toxic"))
    filters = np.array([[FILTERS.index(f) for f in order] for order in ORDERS]).ravel()
    by_step = removed[:CELLS]
    shapley = np.bincount(filters, by_step, STEPS).astype(np.int64)
    return pd.DataFrame({
        "part": x["part"].iloc[0], "filter_order": np.repeat(ORDERS, STEPS), "step": np.tile(np.arange(1, STEPS + 1), len(ORDERS)), "kept": removed[ALL] - by_step.reshape(-1, STEPS).cumsum(axis=1).ravel(),
        "removed": by_step, "redundant": removed[FAILS + filters] - by_step, "unique_fails": removed[SOLE + filters], "good_lost": good[:CELLS], "toxic_lost": toxic[:CELLS], "shapley": shapley[filters],
    })


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """A row for every part, order and step, with counts of what the step's filter does there."""
    arrays = judged(measured(docs), labels, broadcast).mapInArrow(_count, "part string, removed array<long>, good array<long>, toxic array<long>")
    cells = arrays.select("part", F.posexplode(F.arrays_zip("removed", "good", "toxic")).alias("cell", "x"))
    summed = cells.groupBy("part", "cell").agg(*[F.sum(f"x.{c}").alias(c) for c in ("removed", "good", "toxic")])
    return summed.groupBy("part").applyInPandas(_report, SCHEMA)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n,
         concat(CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM w JOIN first ON w.t = first.t LEFT JOIN marks USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, left(filter_order, step - 1) AS before FROM o, range(1, 6) r(step)),
g AS (SELECT *, contains(fails, letter) AS bad, before = '' OR translate(fails, before, '') = fails AS there FROM f, s),
c AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (WHERE there AND NOT bad) AS kept, sum(n) FILTER (WHERE there AND bad) AS removed,
         sum(n) FILTER (WHERE bad AND NOT there) AS redundant, sum(n) FILTER (WHERE fails = letter) AS unique_fails,
         sum(n) FILTER (WHERE there AND bad AND good) AS good_lost, sum(n) FILTER (WHERE there AND bad AND toxic) AS toxic_lost
  FROM g GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM c
"""
