import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", ".", ","]) for _ in range(n))


#: Columns that operators use inside, under other meanings.
CLASHING = ["xh", "u", "unit", "n", "h", "size", "target", "slice", "r", "kept", "d", "x", "root", "ratio", "drop", "copy", "__d", "__x", "__k", "__at"]


def write(folder, name, columns, rows, extra=()):
    data = {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(columns)}
    for c in extra:
        data[c] = pa.array([f"{c}{i}" if i % 2 else None for i in range(len(rows))], pa.string())
    pq.write_table(pa.table(data), folder / f"{name}.parquet")


DOCS = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
ITEMS = [("item_id", pa.int64()), ("text", pa.string())]
LABELS = [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]
PAGES = [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]


def documents():
    rng = random.Random(7)
    base, passage = prose(rng, 300), prose(rng, 60)
    rows = [prose(rng, rng.randrange(5, 200)) for _ in range(40)]
    rows += [base] * 5 + [" ".join(w if rng.random() > 0.01 else "edited" for w in base.split(" ")) for _ in range(25)]
    rows += [prose(rng, 50) + " " + passage + "\nShared line.\n" + prose(rng, 40) for _ in range(15)] + [f"{prose(rng, 8)}\n  shared LINE.\t\nend" for _ in range(6)]
    rows += [None, "", "   \n\t ", "one", "two words", "a b c d e", "A B c d E", "a b c d e f", "x " * 50, "é è 😀 ü " * 30, "line\n\nline\nline", "\n", "no<P>cut\nhere\n", "<S\nP><\n<M\n>", "AB" * 90 + " c", prose(rng, 40_000), "<|endoftext|> it's <|startoftext|>"]
    out = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(rows)]
    out += [out[3], out[3], out[45]]  # repeated rows
    out += [(5, prose(rng, 30), None, "s1", 1), (None, base, "fr", "s2", 2), (None, None, None, None, None), (None, prose(rng, 25), "de", "s0", 3)]
    return out


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    """Nulls, empty and long texts, copies, near copies, repeated rows and ids, clashing columns."""
    d = tmp_path_factory.mktemp("edge")
    docs = documents()
    write(d, "documents", DOCS, docs, CLASHING)
    p = docs[75][1].split("\n")[0].split(" ")[50:90]
    items = [(1, " ".join(p)), (2, " ".join("other" if i % 6 == 3 else w for i, w in enumerate(p))), (3, None), (4, ""), (5, "tiny item"), (None, prose(random.Random(99), 30)), (7, "a b c d e f")]
    write(d, "benchmark", ITEMS, items, ["doc_id", "xh", "n"])
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 90, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (7, None, None), (1000, 1, 1)]
    write(d, "labels", LABELS, [(i, None if a is None else int(a), None if b is None else int(b)) for i, a, b in labels], ["label", "n", "salt"])
    pages = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (5, "u\r\nX: y", "é" * 700_000), (None, "http://n", "same"), (None, "n", "lonely"), (1, "http://a", "same"), (9, "z", "single")]
    write(d, "pages", PAGES, pages, ["sha", "n", "first"])
    return d, docs, items, pages


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name, columns in (("documents", DOCS), ("benchmark", ITEMS), ("pages", PAGES), ("labels", LABELS)):
        write(d, name, columns, [])
    return d
