"""Fill-in-the-middle documents: cuts found by a parallel automaton scan.

A text is cut into lines at two drawn places, and prefix, suffix and middle are put in another order between sentinels.
Lines begin where an automaton over bytes says so, and the same automaton tells whether the text holds a sentinel. It
need not run from the start: every block of BLOCK bytes is run from all its states at once and emits a function from
entry to exit state, with the line starts and sentinels met from each entry state. Functions compose associatively, so a
prefix scan over the blocks of a text (by doubling) gives each block's entry state and the lines before it, and the
block that holds the drawn line is found by bisection; only that block is looked into.

A text beyond ``chunk_bytes`` is scanned by many tasks: its chunks are spread by a shuffle, each emits its function in
the same way, the few functions of a text are composed in order, and the two chunks that hold its cuts are asked for
the place. Only the cuts travel back to the text. Smaller texts are cut where they are read, without a shuffle.

Which lines and which form follows from a hash of the seed and the doc_id, so reruns agree.

Cases: null and empty texts have no lines and are plain and empty; a text without a newline is one line; empty lines
are lines; texts that hold a sentinel stay as they are; a null doc_id hashes as no digits; rows that share a doc_id are
separate documents, each with its own text's cuts, and equal rows give equal results; texts of any length are cut whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .shared import documents, keep, small, text_key

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50
BLOCK = 256
CHUNK_BYTES = 4 << 20

# The automaton: 3 * (inside a line) + sentinel bytes just read ("", "<", "<P" or its like), over classes of bytes.
OTHER, NEWLINE, OPEN, LETTER, CLOSE, NOTHING = range(6)
STATES = 6
CLASS = np.zeros(256, np.uint8)
CLASS[10], CLASS[ord("<")], CLASS[ord(">")] = NEWLINE, OPEN, CLOSE
CLASS[list(b"PSM")] = LETTER
#: What a step emits: line starts, and sentinels in the upper bits.
SENTINEL = 1 << 32
_LEADS = (np.arange(256) & 0xC0) != 0x80


def _step(state: int, kind: int) -> tuple[int, int]:
    if kind == NOTHING:
        return state, 0
    inside, read = divmod(state, 3)
    found = SENTINEL if read == 2 and kind == CLOSE else 0
    read = 1 if kind == OPEN else 2 if read == 1 and kind == LETTER else 0
    return 3 * (kind != NEWLINE) + read, (not inside) + found


NEXT = np.array([[_step(s, k)[0] for k in range(6)] for s in range(STATES)], np.int64).ravel()
EMIT = np.array([[_step(s, k)[1] for k in range(6)] for s in range(STATES)], np.int64).ravel()


class Scan:
    """The blocks of several texts: inclusive prefixes of their transition functions and counts, by text.

    ``to[b, s]`` is the state after block b if its text was entered in state s, ``met[b, s]`` what has been emitted."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        size = np.diff(offs)
        n = -(-size // BLOCK)
        self.data, self.offs, self.first = data, offs, np.concatenate([[0], np.cumsum(n)])
        total = int(self.first[-1])
        kinds = np.full(total * BLOCK, NOTHING, np.uint8)
        kinds[np.arange(len(data)) + np.repeat(self.first[:-1] * BLOCK - offs[:-1], size)] = CLASS[data]
        kinds = np.ascontiguousarray(kinds.reshape(total, BLOCK).T)
        self.to = np.tile(np.arange(STATES), (total, 1))
        self.met = np.zeros((total, STATES), np.int64)
        for column in kinds:
            at = self.to * 6 + column[:, None]
            self.met += EMIT[at]
            self.to = NEXT[at]
        # prefix scan by doubling: a block's function after the one that ends ``reach`` blocks before it
        place = np.arange(total) - np.repeat(self.first[:-1], n)
        reach = 1
        while reach <= place.max(initial=0):
            late = np.flatnonzero(place >= reach)
            before = self.to[late - reach]
            met = self.met[late - reach] + np.take_along_axis(self.met[late], before, 1)
            to = np.take_along_axis(self.to[late], before, 1)
            self.to[late], self.met[late] = to, met
            reach *= 2

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text's function and counts; an empty text's are the identity and nothing."""
        some = np.diff(self.first) > 0
        to, met = np.tile(np.arange(STATES), (len(some), 1)), np.zeros((len(some), STATES), np.int64)
        to[some], met[some] = self.to[self.first[1:][some] - 1], self.met[self.first[1:][some] - 1]
        return to, met

    def line(self, text: int, k: int, state: int = 0) -> int:
        """The byte in ``text``, entered in ``state``, where its line k (from 0) begins; its end if there are fewer."""
        a, b = self.first[text], self.first[text + 1]
        block = a + int(np.searchsorted(self.met[a:b, state] % SENTINEL, k, "right"))
        if block == b:
            return int(self.offs[text + 1] - self.offs[text])
        entry, before = (state, 0) if block == a else (self.to[block - 1, state], self.met[block - 1, state] % SENTINEL)
        at = int(self.offs[text] + (block - a) * BLOCK)
        starts = np.flatnonzero(self.data[at : min(at + BLOCK, self.offs[text + 1])] == 10) + 1
        if entry < 3:
            starts = np.concatenate([[0], starts])
        return int(at - self.offs[text] + starts[k - before])


def _drawn(n: int, h1: int, h2: int) -> tuple[int, int]:
    """Lines before the middle and before the suffix."""
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


def _form(n_bytes: int, sentinels: int, h3: int, h4: int, fim_percent: int, spm_percent: int) -> str:
    return "plain" if not n_bytes or sentinels or h3 % 100 >= fim_percent else "spm" if h4 % 100 < spm_percent else "psm"


def _points(data: np.ndarray) -> int:
    return int(np.count_nonzero(_LEADS[data]))


def _text(raw: bytes, form: str, a: int, b: int) -> bytes:
    if form == "plain":
        return raw
    p, m, s = raw[:a], raw[a:b], raw[b:]
    parts = (PREFIX, p, SUFFIX, s, MIDDLE, m) if form == "psm" else (SUFFIX, s, PREFIX, p, MIDDLE, m)
    return b"".join(x.encode() if isinstance(x, str) else x for x in parts)


_OUT = "doc_id long, xh long, n long, form string, prefix_chars long, middle_chars long, output string"
_HASHES = ["h1", "h2", "h3", "h4"]


def _batch(batch: pa.RecordBatch, a: int, b: int, found: list[tuple]) -> pa.RecordBatch:
    """found: n, form, prefix and middle code points, output."""
    kinds = pa.int64(), pa.string(), pa.int64(), pa.int64()
    columns = [pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)]
    output = pa.array([x[4] for x in found], pa.binary()).cast(pa.string())
    return pa.record_batch([batch.column("doc_id")[a:b], batch.column("xh")[a:b], *columns, output], names=["doc_id", "xh", "n", "form", "prefix_chars", "middle_chars", "output"])


def _cut_here(fim_percent: int, spm_percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([np.asarray(batch.column(c)) for c in _HASHES], 1).tolist() if len(batch) else []
            for a, b, data, offs in B.texts(batch, "text"):
                scan = Scan(data, offs)
                met = scan.whole()[1][:, 0].tolist()
                raw, found = data.tobytes(), []
                for i in range(b - a):
                    n, (h1, h2, h3, h4) = met[i] % SENTINEL, h[a + i]
                    own = raw[offs[i] : offs[i + 1]]
                    form = _form(len(own), met[i] // SENTINEL, h3, h4, fim_percent, spm_percent)
                    if form == "plain":
                        found.append((n, form, None, None, own))
                        continue
                    p, m = (scan.line(i, k) for k in _drawn(n, h1, h2))
                    found.append((n, form, _points(data[offs[i] : offs[i] + p]), _points(data[offs[i] + p : offs[i] + m]), _text(own, form, p, m)))
                yield _batch(batch, a, b, found)

    return task


def _chunks(chunk_bytes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                buf = text.as_buffer()
                for k, at in enumerate(range(0, buf.size, chunk_bytes)):
                    piece = buf.slice(at, min(chunk_bytes, buf.size - at)).to_pybytes()
                    yield pa.record_batch([batch.column("doc_id")[i : i + 1], batch.column("xh")[i : i + 1], pa.array([k], pa.int32()), pa.array([piece], pa.binary())], names=["doc_id", "xh", "chunk", "data"])

    return task


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tos, mets, sizes, points = [], [], [], []
        for x in batch.column("data"):
            data = np.frombuffer(x.as_buffer(), np.uint8)
            to, met = Scan(data, np.array([0, len(data)])).whole()
            tos.append(to[0].tolist())
            mets.append(met[0].tolist())
            sizes.append(len(data))
            points.append(_points(data))
        yield pa.record_batch([batch.column("doc_id"), batch.column("xh"), batch.column("chunk"), pa.array(tos, pa.list_(pa.int64())), pa.array(mets, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(points, pa.int64())], names=["doc_id", "xh", "chunk", "to", "met", "size", "points"])


def _composed(fim_percent: int, spm_percent: int):
    """One giant text's chunk functions, in order: its form and, for each cut, the chunk, its entry state and the line in it."""

    def of(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("chunk")
        state, met, entries = 0, 0, []
        for to, emitted in zip(x["to"], x["met"]):
            entries.append((state, met % SENTINEL))
            state, met = int(to[state]), met + int(emitted[state])
        n, top = met % SENTINEL, x.iloc[0]
        size, points = (np.concatenate([[0], x[c].cumsum()]) for c in ("size", "points"))
        form = _form(int(size[-1]), met // SENTINEL, top.h3, top.h4, fim_percent, spm_percent)
        rows = []
        for cut, k in enumerate(_drawn(n, top.h1, top.h2)):
            at = max(0, int(np.searchsorted([e[1] for e in entries], k, "right")) - 1)
            rows.append((top.doc_id, top.xh, n, form, cut, at, entries[at][0], k - entries[at][1], int(size[at]), int(points[at])))
        return pd.DataFrame(rows, columns=["doc_id", "xh", "n", "form", "cut", "chunk", "state", "line", "bytes", "points"])

    return of


_CUTS = "doc_id long, xh long, n long, form string, cut int, chunk int, state int, line long, bytes long, points long"


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each cut in its chunk, added to what lies before the chunk."""
    for batch in batches:
        at, points = [], []
        rows = zip(batch.column("data"), *(batch.column(c).to_pylist() for c in ("state", "line", "bytes", "points")))
        for x, state, line, before, points_before in rows:
            data = np.frombuffer(x.as_buffer(), np.uint8)
            k = Scan(data, np.array([0, len(data)])).line(0, line, state)
            at.append(before + k)
            points.append(points_before + _points(data[:k]))
        names = ["doc_id", "xh", "n", "form", "cut"]
        yield pa.record_batch([*(batch.column(c) for c in names), pa.array(at, pa.int64()), pa.array(points, pa.int64())], names=[*names, "at", "points"])


def _cut_there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ns, forms, cuts = (batch.column(c).to_pylist() for c in ("n", "form", "cuts"))
        for i, text in enumerate(batch.column("text")):
            raw = text.as_buffer().to_pybytes()
            (a, pa_), (b, pb) = ((c["at"], c["points"]) for c in sorted(cuts[i], key=lambda c: c["cut"]))
            plain = forms[i] == "plain"
            yield _batch(batch, i, i + 1, [(ns[i], forms[i], None if plain else pa_, None if plain else pb - pa_, _text(raw, forms[i], a, b))])


def _giants(rows: DataFrame, chunk_bytes: int, fim_percent: int, spm_percent: int) -> DataFrame:
    chunks = rows.select("doc_id", "xh", "text").mapInArrow(_chunks(chunk_bytes), "doc_id long, xh long, chunk int, data binary")
    chunks = keep(chunks.repartition("doc_id", "xh", "chunk"), "chunks")
    by = ["doc_id", "xh", "chunk"]
    functions = chunks.mapInArrow(_functions, "doc_id long, xh long, chunk int, to array<long>, met array<long>, size long, points long")
    # equal rows have equal chunks: one of each is enough
    functions = functions.groupBy(by).agg(*[F.first(c).alias(c) for c in ("to", "met", "size", "points")]).withColumns(dict(zip(_HASHES, draws())))
    cuts = functions.groupBy("doc_id", "xh").applyInPandas(_composed(fim_percent, spm_percent), _CUTS)
    cuts = small(keep(cuts, "cuts")).alias("c")
    wanted = chunks.alias("k").join(cuts, F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("k.xh") == F.col("c.xh")) & (F.col("k.chunk") == F.col("c.chunk")))
    found = wanted.select("c.doc_id", "c.xh", "c.n", "c.form", "c.cut", "c.state", "c.line", "c.bytes", "c.points", "k.data").mapInArrow(_selected, "doc_id long, xh long, n long, form string, cut int, at long, points long")
    found = found.dropDuplicates(["doc_id", "xh", "cut"]).groupBy("doc_id", "xh", "n", "form").agg(F.collect_list(F.struct("cut", "at", "points")).alias("cuts"))
    found = small(keep(found, "found")).alias("f")
    both = rows.alias("r").join(found, F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.xh") == F.col("f.xh")))
    return both.select("r.doc_id", "r.xh", "r.text", "f.n", "f.form", "f.cuts").mapInArrow(_cut_there, _OUT)


def draws(seed: int = SEED) -> list[Column]:
    """Four numbers of a doc_id: the first digits of a hash, eight at a time."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text, from what was made of it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    psm, spm = (F.concat(*[F.get(parts, F.lit(k)) for k in order]) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, xh, n, form, prefix_chars, middle_chars and the output text of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("xh"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    here = rows.filter(F.octet_length("text") <= chunk_bytes).withColumns(dict(zip(_HASHES, draws()))).mapInArrow(_cut_here(fim_percent, spm_percent), _OUT)
    giant = rows.filter(F.octet_length("text") > chunk_bytes)
    return here if giant.isEmpty() else here.union(_giants(giant, chunk_bytes, fim_percent, spm_percent))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
             ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
