"""Personal data: fixed patterns, and what a skip-chain conditional random field adds to them.

Email addresses, IP addresses, card numbers and phone numbers in plain form are found by patterns (``base_spans``); each
pattern is run in time linear in the text. The field (``skipchain``) then labels the text's words: the patterns' spans
are what it knows, words that repeat or resemble each other anywhere in the text share a potential, and loopy messages
make their labels agree. So a number that is a phone number by its plus sign in one place is found where it is written
without; keys announced as such are found as kind ``secret``. A stretch of neighbours of one kind is a span if it is
whole (``WHOLE``) and meets no span of the patterns; the patterns' spans always stay.

Rows are judged one by one where they are read; nothing is shuffled, and the fitted field, a few thousand numbers, is
all that travels. Memory grows with the longest text.

Cases: null and empty texts have no spans; texts are searched whole; equal rows have equal spans; null doc_ids are
carried; an empty table gives an empty result; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from . import skipchain as S
from .shared import documents, keyed

#: Spans that the patterns find, in the order in which they are listed; the field adds to these, and secrets.
BASE = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS, MOST_PART = (13, 19), (9, 15), 255
#: Digits (of a secret: letters and digits) that a span of a kind must hold to be whole, where the field has found it.
WHOLE = {"card": (13, 19), "phone": (7, 15), "ip": (4, 12), "secret": (16, 1 << 30)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
#: An address as such, or with words for its signs: name, at, host.
_SPOKEN = re.compile(rb"(?<![^\s@])[^\s@]++@[^\s@]*[^\s@.,;:!?]|(?<!\S)(?!at\b)\S++\s+[(\[]?at[)\]]?\s+(?!at\b)[^\s.]+(?:\.[^\s.]+|\s+[(\[]?dot[)\]]?\s+[^\s.]+)+", re.I)
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(t: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(t):
        a = m.start()
        while a > done and t[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            done = m.end()
            yield a, done


def addresses(t: str) -> Iterator[tuple[int, int]]:
    """Fours of numbers joined by dots, taken from the left of each dotted run."""
    for m in _NUMBERS.finditer(t):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= MOST_PART for p in (x.lstrip("0") or "0" for x in four)):
                yield at, end
            at = end + 1


def numbers(t: str, pattern: re.Pattern, least: int, most: int, check: bool) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(t):
        if m.end() - m.start() < least:
            continue
        digits = re.sub("[^0-9]", "", m[0])
        if least <= len(digits) <= most and (not check or S.luhn(digits)):
            yield m.span()


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """By kind as in BASE, then by start."""
    out = [("email", *x) for x in emails(t)] if "@" in t else []
    out += [("ip", *x) for x in addresses(t)]
    out += [("card", *x) for x in numbers(t, _CARD, *CARD_DIGITS, True)]
    return out + ([("phone", *x) for x in numbers(t, _PHONE, *PHONE_DIGITS, False)] if "+" in t else [])


_DIGIT_OR_AT = np.zeros(256, bool)
_DIGIT_OR_AT[list(b"0123456789@")] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80
_SIGN = np.ones(256, bool)
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) + 1 for x in raw]) - 1
    return B.hashes(np.frombuffer(b" ".join(raw), np.uint8), ends - [len(x) for x in raw], ends, True)


_CLASS_HASHES = np.sort(_hashes(list(S.CLASS_OF)))


def _announcing(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which words are of a class, with up to one sign before and after them."""
    a, b = s + (_SIGN[data[s]] & (e - s > 1)), e - (_SIGN[data[e - 1]] & (e - s > 2))
    h = B.hashes(data, a, np.maximum(a + 1, b), True)
    at = np.minimum(np.searchsorted(_CLASS_HASHES, h), len(_CLASS_HASHES) - 1)
    return _CLASS_HASHES[at] == h


def _spread(flags: np.ndarray, owner: np.ndarray, reach: int) -> np.ndarray:
    """Flags, also of neighbours in the same text."""
    out = flags.copy()
    for k in range(1, reach + 1):
        same = owner[k:] == owner[:-k]
        out[k:] |= flags[:-k] & same
        out[:-k] |= flags[k:] & same
    return out


def _whole(kind: str, inner: bytes) -> Iterator[tuple[int, int]]:
    """The parts of a stretch of one kind that are whole; addresses that stand side by side are told apart."""
    if kind == "email":
        yield from (m.span() for m in _SPOKEN.finditer(inner))
        return
    low, high = WHOLE[kind]
    counts = (lambda c: not _SIGN[c]) if kind == "secret" else (lambda c: 48 <= c < 58)
    if low <= sum(map(counts, inner)) <= high:
        yield 0, len(inner)


def added_spans(field: S.Field, data: np.ndarray, offs: np.ndarray, known: list[list[tuple[str, int, int]]], skip: bool = True) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text beside the known spans; all offsets in bytes."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in known]
    s, e, first = B.words(data, offs)
    if not len(s):
        return found
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    evidence = (np.add.reduceat(_DIGIT_OR_AT[data], s, dtype=np.int32) > 0) | _announcing(data, s, e)
    active = _spread(evidence, owner, 1)
    near = np.flatnonzero(_spread(evidence, owner, 4))
    if not len(near):
        return found
    raw = data.tobytes()
    words = [raw[s[k] : e[k]].decode() for k in near]
    shapes = [S.shape(w) for w in words]
    breaks = np.flatnonzero((np.diff(near) > 1) | (owner[near][1:] != owner[near][:-1])) + 1
    xs = []
    for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(near)]):
        xs += S.surroundings([x[0] for x in shapes[a:b]], [x[1] for x in shapes[a:b]])
    use = np.flatnonzero(active[near])
    at, text = near[use], owner[near[use]]
    own = field.potentials([xs[k] for k in use])
    for d in np.unique(text):
        for kind, a, b in known[d]:
            # words of this text that the known span meets
            lo, hi = np.searchsorted(e[at], offs[d] + a, "right"), np.searchsorted(s[at], offs[d] + b, "left")
            own[lo:hi, S.LABELS.index(kind)] += S.KNOWN
    i = np.flatnonzero((np.diff(at) == 1) & (text[1:] == text[:-1]))
    si, sj = S.skip_edges([shapes[k][2] for k in use], text) if skip else (i[:0], i[:0])
    kinds = np.concatenate([np.zeros(len(i), np.int64), np.ones(len(si), np.int64)])
    p = field.beliefs(own, np.concatenate([i, si]), np.concatenate([i + 1, sj]), kinds)
    label = np.where(p.max(1) >= S.SURE, p.argmax(1), 0)
    starts = np.flatnonzero((label > 0) & np.concatenate([[True], (label[1:] != label[:-1]) | (np.diff(at) != 1) | (text[1:] != text[:-1]) | (label[1:] == S.LABELS.index("secret"))]))
    for k in starts.tolist():
        m = k + 1
        while m < len(at) and label[m] == label[k] and at[m] == at[m - 1] + 1 and text[m] == text[k] and S.LABELS[label[k]] != "secret":
            m += 1
        d, kind = int(text[k]), S.LABELS[label[k]]
        head, tail = words[use[k]], words[use[m - 1]]
        a = int(s[at[k]] - offs[d]) + len(head[: S.core(head)[0]].encode())
        b = int(s[at[m - 1]] - offs[d]) + len(tail[: S.core(tail)[1]].encode())
        inner = raw[offs[d] + a : offs[d] + b]
        for x, y in _whole(kind, inner) if b > a else ():
            x, y = a + x, a + y
            if all(y <= v or w <= x for _, v, w in known[d]):
                found[d].append((kind, x, y))
    return found


def _points_of(raw: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets, in ascending order of starts and disjoint, as code points."""
    out, at, n = [], 0, 0
    data = np.frombuffer(raw, np.uint8)
    for kind, a, b in spans:
        start = n + int(np.count_nonzero(_LEADS[data[at:a]]))
        end = start + int(np.count_nonzero(_LEADS[data[a:b]]))
        out.append((kind, start, end))
        at, n = b, end
    return out


def _bytes_of(t: str, n_bytes: int, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if len(t) == n_bytes:
        return list(spans)
    place, at, n = {}, 0, 0
    for k in sorted({x for span in spans for x in span[1:]}):
        n += len(t[at:k].encode())
        place[k], at = n, k
    return [(kind, place[a], place[b]) for kind, a, b in spans]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def _find(field: S.Field, skip: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in B.texts(batch, "text"):
                raw = data.tobytes()
                own = [raw[offs[i] : offs[i + 1]] for i in range(b - a)]
                base, known = [], []
                for r in own:
                    t = r.decode()
                    base.append(base_spans(t))
                    known.append(_bytes_of(t, len(r), base[-1]))
                more = added_spans(field, data, offs, known, skip)
                rows = []
                for r, spans, x in zip(own, base, more):
                    spans = [(*y, False) for y in spans] + [(*y, True) for y in _points_of(r, x)]
                    spans.sort(key=lambda y: (S.KINDS.index(y[0]), y[1]))
                    rows.append([dict(zip(("kind", "start", "end", "added"), y)) for y in spans])
                yield pa.record_batch([batch.column("doc_id")[a:b], batch.column("xh")[a:b], pa.array(rows, _SPAN)], names=["doc_id", "xh", "spans"])

    return task


def personal(docs: DataFrame, field: S.Field | None = None, skip: bool = True) -> DataFrame:
    """(doc_id, xh, spans): kind, start, end of every span, and whether the field added it; by kind, then start."""
    return keyed(docs).mapInArrow(_find(field or S.fitted(), skip), "doc_id long, xh long, spans array<struct<kind:string,start:long,end:long,added:boolean>>")


def _redact(field: S.Field):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.record_batch([pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.int64()), batch.column("text")], names=["doc_id", "xh", "text"])
            spans = [x for part in _find(field, True)(iter([keys])) for x in part.column("spans").to_pylist()]
            out = []
            for t, own in zip(batch.column("text").to_pylist(), spans):
                at, pieces = 0, []
                for x in sorted(own, key=lambda x: (x["start"], -x["end"])):
                    if x["start"] >= at:
                        pieces += [t[at : x["start"]], f"[{x['kind'].upper()}]"]
                    at = max(at, x["end"])
                out.append("".join([*pieces, t[at:]]) if own else t)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, batch.schema.field("text").type))

    return task


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; of spans that overlap, the first one names it."""
    return docs.mapInArrow(_redact(S.fitted()), docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: ~x["added"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
