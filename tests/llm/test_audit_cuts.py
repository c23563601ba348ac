"""The filter audit and the fill-in-the-middle cuts against direct Python."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from glimmer.llm import fillmiddle, filteraudit

from . import brute


def failing(docs):
    """Per document, the letters of the filters that it fails."""
    least = {}
    for d, t in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    out = []
    for d, t in docs:
        t, ws = t or "", brute.words(t)
        fails = "A" * (len(ws) < 100) + "B" * (100 * len(set(ws)) < 80 * len(ws)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        out.append(fails + "E" * (d is not None and d > least[t]))
    return out


def audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). Every order is walked, document by document."""
    fails = failing([d[:2] for d in docs])
    out = Counter()
    for part in {d[2] or "" for d in docs}:
        own = [(f, any(x[0] == d[0] and x[1] == 1 for x in labels), any(x[0] == d[0] and x[2] == 1 for x in labels)) if d[0] is not None else (f, False, False) for d, f in zip(docs, fails) if (d[2] or "") == part]
        rows, total = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                rows.append((part, "".join(order), step + 1, len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == f for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out.update((*r[:-1], total[r[-1]]) for r in rows)
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_op11_every_order_as_walked(spark, edge, broadcast):
    folder, docs, *_ = edge
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = Counter(tuple(r) for r in filteraudit.audit(d, labels, broadcast).select(COLUMNS).collect())
    assert got == audit([x[:3] for x in docs], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


def test_op11_a_hot_text_and_many_parts(spark):
    """A third of all rows are one text; there are more parts than a task holds."""
    rng = random.Random(5)
    rows = [(i, "copy of a text" if i % 3 == 0 else None if i % 7 == 0 else "Word " * rng.randrange(120) + rng.choice(["", "#"]), f"l{i % 300}") for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    got = filteraudit.judged(filteraudit.measured(d), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    want = Counter((p, sum(1 << "ABCDE".index(c) for c in f)) for (_, _, p), f in zip(rows, failing([r[:2] for r in rows])))
    assert {(r.part, r["mask"]): r.n for r in got.groupBy("part", "mask").agg(F.sum("n").alias("n")).collect()} == dict(want)
    assert filteraudit.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg(F.countDistinct("part"), F.count("*")).head()[:] == (300, 180_000)


def test_op11_labels_beyond_the_bound_are_shuffled(spark, edge):
    """Whatever Spark takes them to be: it does not count the copies by salt."""
    rows = spark.createDataFrame([(1, "", 0, b"")], "doc_id long, part string, mask int, digest binary")
    plan = filteraudit.with_labels(rows, spark.read.parquet(f"{edge[0]}/labels.parquet"), False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_op11_the_table_is_the_first_failure():
    assert filteraudit.FIRST.shape == (32, 120) and len(set(filteraudit.ORDERS)) == 120
    for m in range(32):
        for k, order in enumerate(filteraudit.ORDERS):
            s = filteraudit.FIRST[m, k]
            letters = {"ABCDE"[i] for i in range(5) if m >> i & 1}
            assert not letters & set(order[:s]) and (s == 5 or order[s] in letters)


def middle(doc_id, text, fim=100, spm=50):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 2, 3, 257, 1000, 1 << 22])
def test_op13_cuts_in_chunks_of_any_size(spark, edge, chunk):
    """Chunks of few bytes split sentinels, characters and lines; all rows but the longest go by them."""
    folder, docs, *_ = edge
    d = spark.read.parquet(f"{folder}/documents.parquet")
    most = 600 if chunk < 100 else 1 << 30
    if chunk < 100:
        d = d.filter(F.coalesce(F.length("text"), F.lit(0)) < most)
    made = fillmiddle.fill_middle(d, chunk_bytes=chunk).withColumn("back", fillmiddle.restored(F.col("output"), F.col("form")))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect())
    assert got == Counter((x[0], *middle(x[0], x[1]), x[1] or "") for x in docs if len(x[1] or "") < most)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_op13_shares_of_forms(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    n = Counter(r.form for r in fillmiddle.fill_middle(d, fim_percent=40, spm_percent=25).collect())
    assert abs(n["plain"] - 2400) < 130 and abs(n["spm"] - 400) < 80


def test_op13_blocks_agree_with_a_walk():
    """The composed functions against the automaton run byte by byte, from every state."""
    import numpy as np

    rng = random.Random(3)
    texts = ["".join(rng.choice("<PSM>\nab") for _ in range(n)).encode() for n in (0, 1, 255, 256, 257, 5000, 3)]
    offs = np.cumsum([0, *map(len, texts)])
    scan = fillmiddle.Scan(np.frombuffer(b"".join(texts), np.uint8), offs)
    to, met = scan.whole()
    for i, t in enumerate(texts):
        for s in range(fillmiddle.STATES):
            state, starts, sentinels = s, [], 0
            for k, c in enumerate(t):
                state, out = fillmiddle._step(state, int(fillmiddle.CLASS[c]))
                starts += [k] * (out % fillmiddle.SENTINEL)
                sentinels += out // fillmiddle.SENTINEL
            assert (to[i, s], met[i, s] % fillmiddle.SENTINEL, met[i, s] // fillmiddle.SENTINEL) == (state, len(starts), sentinels)
            assert [scan.line(i, k, s) for k in range(len(starts) + 1)] == [*starts, len(t)]
