"""The operators' results by direct Python, for small tables."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

BLANK = b" \t\n\x0b\x0c\r"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().split()


def quality(text):
    ws, t = words(text), text or ""
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, before, dup = t.split("\n"), set(), 0
    for line in lines:
        if line.encode().strip(BLANK):
            dup += line in before
            before.add(line)
    return len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(ws) < 10 or 100 * len(covered) > 20 * len(ws)


def substrings(docs, width):
    """docs: list of (doc_id, text) -> list of (doc_id, n_words, n_removed, sha)."""
    count = Counter(tuple(w[i : i + width]) for _, t in docs for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for d, t in docs:
        w = words(t)
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    ws = [w.translate(LOW) for w in words(text)]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    return [(docs[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(docs))]


def lines(docs, min_docs):
    def key(x):
        return x.encode().strip(BLANK).translate(LOW)

    n = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (key(x) and n[key(x)] >= min_docs)]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def tokens(docs, path, end, ordinary=False):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = ordinary
    out, at = [], 0
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def warc(pages):
    first = {}
    for p, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, h in pages:
        b = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and f != p and sum((y or "") == (h or "") for _, y in pages) > 1
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return out


def stretches(equal, lo, hi, least, percent):
    """The best stretch of equal[lo:hi] and those of what it leaves on either side, if they are leaks."""
    if hi - lo < least:
        return []
    best = now = 0
    start, span = lo, (lo, lo)
    for k in range(lo, hi):
        if now < 0:
            now, start = 0, k
        now += 1 if equal[k] else -2
        if now > best:
            best, span = now, (start, k + 1)
    s, e = span
    if s == e:
        return []
    same = sum(equal[s:e])
    found = [(s, e, same)] if e - s >= least and 100 * same >= percent * (e - s) else []
    return found + stretches(equal, lo, s, least, percent) + stretches(equal, e, hi, least, percent)


def leaks(docs, items, min_words=13, percent=75):
    """Every diagonal of every pair, without seeds: (doc_id, item_id, start, end, item start, equal words)."""
    out = []
    for d, t in docs:
        a = [w.translate(LOW) for w in words(t)]
        for i, u in items:
            b = [w.translate(LOW) for w in words(u)]
            found = []
            for shift in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                equal = [lo <= k < hi and a[k + shift] == b[k] for k in range(len(b))]
                if any(equal):
                    found += [(-same, s + shift, s, e + shift, same) for s, e, same in stretches(equal, lo, hi, min(min_words, len(b)), percent)]
            taken = []
            for _, start, own, end, same in sorted(found):
                if all(end <= s or e <= start for s, e in taken):
                    taken.append((start, end))
                    out.append((d, i, start, end, own, same))
    return out


def leak_pairs(docs, items):
    return {x[:2] for x in leaks(docs, items)}
