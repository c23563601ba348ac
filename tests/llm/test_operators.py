"""Every operator against direct Python on a table of edge cases, and on an empty one."""

from collections import Counter, defaultdict

import pytest

from glimmer.llm import decontamination, licenses, linededup, mixing, quality, setjoin, substrings, tokenbits, tokencounts, warc
from glimmer.llm.encoding import default_path
from glimmer.llm.queries import queries
from glimmer.llm.shared import keep

from . import brute


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def pairs(docs):
    return [(d[0], d[1]) for d in docs]


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty, name):
    assert queries()[name](spark, str(empty)).count() == 0


def test_op1_targets_and_taken(spark, edge):
    folder, docs, *_ = edge
    out = mixing.op1(spark, str(folder)).collect()
    assert len(out) == len(docs)
    size = defaultdict(int)
    for d in docs:
        size[d[3]] += len(brute.words(d[1]))
    total = sum(size.values())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * size[s]
            open_.remove(s)
    by_size = {size[s]: s for s in names}
    taken = Counter()
    for r in out:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(target[s], abs=1e-5)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    largest = {s: max(len(brute.words(d[1])) for d in docs if d[3] == s) for s in names}
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.op1(spark, str(folder))
    assert rows(again, "doc_id", "size", "taken") == Counter((r.doc_id, r["size"], r.taken) for r in out)


def test_op1_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    grid = spark.range(0, 101).select((F.col("id") / 100).alias("s"))
    for cls, shape in enumerate(mixing.SCHEDULES):
        times = [r.t for r in grid.select(mixing.inverse_demand(F.col("s"), F.lit(cls)).alias("t")).collect()]
        for k, t in enumerate(times):
            a, b = shape[int(t * 2) if t < 1 else 1], shape[int(t * 2) + 1 if t < 1 else 2]
            u = t * 2 - int(t * 2) if t < 1 else 1.0
            used = (0 if t < 0.5 else 0.5 * (shape[0] + shape[1]) / 2) + 0.5 * (a * u + (b - a) * u * u / 2)
            assert used == pytest.approx((cls + 1) * k / 100, abs=1e-9)


def test_op1_mix_rows_follow_the_plan(spark, edge):
    folder, docs, *_ = edge
    d = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    want = Counter()
    planned = mixing.plan(mixing.sized(d))
    for r in planned.select("doc_id", "positions").collect():
        want[r.doc_id] += len(r.positions)
    assert +want == Counter(r.doc_id for r in mixed.select("doc_id").collect())
    order = mixing.training_order(planned, "doc_id").collect()
    assert [r.position for r in order] == sorted(r.position for r in order)


def test_op1_the_schedule_decides(spark, edge):
    folder, *_ = edge
    base = mixing.sized(spark.read.parquet(f"{folder}/documents.parquet"))

    def of(schedules):
        out = mixing.plan(base, schedules).collect()
        return {r.source: r.target for r in out}, Counter((r.doc_id, len(r.positions)) for r in out), Counter((r.doc_id, *r.positions) for r in out)

    targets, copies, positions = of(mixing.SCHEDULES)
    heavier = of((tuple(9 * x for x in mixing.SCHEDULES[0]), *mixing.SCHEDULES[1:]))
    assert heavier[0] != targets and heavier[1] != copies
    turned = of((mixing.SCHEDULES[0][::-1], *mixing.SCHEDULES[1:]))  # as heavy, but late instead of early
    assert turned[0] == targets and turned[1] == copies and turned[2] != positions


def test_op1_mix_keeps_rows_apart_that_differ_elsewhere(spark):
    d = spark.createDataFrame([(1, "a b c", "s", "x"), (1, "a b c", "t", "y"), (1, "a b c", "t", "y"), (2, "d e f", "s", "x")], "doc_id long, text string, source string, lang string")
    out = Counter(tuple(r) for r in mixing.mix(d).collect())
    assert out == Counter(tuple(r) for r in mixing.mix(d).collect())
    words = Counter()
    for row, n in out.items():
        words[row[2]] += 3 * n
    assert abs(words["s"] - 4) <= 3 and abs(words["t"] - 8) <= 3


def test_op1_rows_without_an_id_spread_over_slices(spark):
    from pyspark.sql import functions as F

    d = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"))
    slices = mixing.sized(d).groupBy(F.shiftrightunsigned("r", 50)).count()
    assert slices.count() == 1024 and slices.agg(F.max("count")).head()[0] < 60
    out = mixing.plan(mixing.sized(d))
    assert out.agg(F.sum(F.size("positions") * F.col("size"))).head()[0] == pytest.approx(40_000, abs=2)


LEAK = ("doc_id", "item_id", "start_word", "end_word", "item_start", "n_equal")


def test_op2_leaks(spark, edge):
    folder, docs, items, _ = edge
    short = [(d, t) for d, t in pairs(docs) if len(t or "") < 20_000]
    got = decontamination.op2(spark, str(folder))
    assert rows(got, *LEAK) == Counter(brute.leaks(short, items))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert {(d, 1) for d in range(70, 85)} <= got and {(d, 2) for d in range(70, 85)} <= got
    base = spark.read.parquet(f"{folder}/documents.parquet")
    left = decontamination.clean(base, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert left.columns == base.columns


def leaks_of(texts, items):
    import numpy as np

    known = {w: np.uint64(k + 1) for k, w in enumerate(sorted({w for t in texts for w in t.split()} | {w for _, t in items for w in t.split()}))}
    probe = decontamination.Probe([i for i, _ in items], [t for _, t in items])
    ws = [t.split() for t in texts]
    item_words = [w for _, t in items for w in t.split()]
    hash_of = dict(zip(item_words, probe.h.tolist()))
    h = np.array([hash_of.get(w, int(known[w])) for t in ws for w in t], np.uint64)
    return [(x[0], probe.ids[x[1]], *x[2:]) for x in probe.leaks(h, np.concatenate([[0], np.cumsum([len(t) for t in ws])]))]


def test_op2_all_passages(monkeypatch):
    import random

    rng = random.Random(4)
    item = " ".join(f"i{k}" for k in range(60))
    parts = item.split(" ")
    noise = lambda n: [f"n{rng.randrange(500)}" for _ in range(n)]
    texts = [
        " ".join(noise(30) + parts[:20] + noise(25) + parts[:20] + noise(9)),  # the same passage twice
        " ".join(parts[:20] + noise(20) + parts[40:]),  # two passages on one diagonal
        " ".join(parts[:14] + parts[30:50] + noise(3) + [w if k % 4 else "other" for k, w in enumerate(parts)]),
        " ".join(["same"] * 90), "", "i1 i2 i3",
    ]
    items = [(1, item), (2, " ".join(["same"] * 40)), (3, "i1 i2 i3"), (4, "")]
    want = sorted(brute.leaks(list(enumerate(texts)), items))
    assert sorted(leaks_of(texts, items)) == want
    monkeypatch.setattr(decontamination, "CELLS", 50)
    assert sorted(leaks_of(texts, items)) == want
    assert sum(x[:2] == (0, 1) for x in want) == 2 and sum(x[:2] == (1, 1) for x in want) == 2


def test_op2_a_text_of_one_word_is_no_trap():
    import time

    began = time.time()
    got = leaks_of([" ".join(["word"] * 32_000)], [(1, " ".join(["word"] * 200))])
    assert len(got) == 160 and time.time() - began < 60


def test_op2_blocks_agree(spark, edge, monkeypatch):
    folder, docs, *_ = edge
    d, i = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    one = rows(decontamination.leaks(d, i), "doc_id", "item_id", "start_word", "n_equal")
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 20)
    assert rows(decontamination.leaks(d, i), "doc_id", "item_id", "start_word", "n_equal") == one


def test_op2_every_accepted_stretch_meets_a_seed():
    import itertools

    import numpy as np

    for n in range(1, 21):
        item = [f"w{i}" for i in range(n)]
        probe = decontamination.Probe([0], [" ".join(item)])
        texts, want = [], 0
        for k in range(n // 4 + 1):
            for places in itertools.combinations(range(n), k):
                equal = np.ones(n, bool)
                equal[list(places)] = False
                if [int(x[0]) for x in decontamination.best_stretches(equal, np.array([n]))[:2]] == [0, n]:
                    texts += [f"x{i}" if i in places else w for i, w in enumerate(item)]
                    want += 1
        h = dict(zip(item, probe.h))
        words = np.array([h.get(w, np.uint64(7)) for w in texts], np.uint64)
        assert len(probe.leaks(words, np.arange(want + 1) * n)) == want, n


def test_op3_substrings(spark, edge):
    folder, docs, *_ = edge
    assert rows(substrings.op3(spark, str(folder)), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.substrings(pairs(docs), 35))


@pytest.mark.parametrize("width,hot", [(1, 2_000), (7, 1), (16, 1), (33, 1), (35, 1)])
def test_op3_widths_and_hot_hashes(spark, edge, monkeypatch, width, hot):
    folder, docs, *_ = edge
    monkeypatch.setattr(substrings, "HOT", hot)
    marked, texts = substrings.substrings(spark.read.parquet(f"{folder}/documents.parquet"), width)
    cut = texts.selectExpr("unit", "n_removed")
    got = marked.join(cut, "unit", "left").selectExpr("doc_id", "n_words", f"if(rep is not null and n_words >= {width}, n_words, coalesce(n_removed, 0)) as n_removed")
    assert rows(got, "doc_id", "n_words", "n_removed") == Counter(x[:3] for x in brute.substrings(pairs(docs), width))


def test_op3_levels_double():
    assert substrings.levels(35) == [9, 18, 35] and substrings.levels(7) == [7] and substrings.levels(1) == [1]
    assert substrings.levels(100) == [13, 25, 50, 100]


def test_op4_licenses(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = [
        "blah blah.\nReleased under the MIT License.\nblah", "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 1.1.", "The driver lost the license to drive.", None, "",
        "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts), "license": texts}), tmp_path / "documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses.op4(spark, str(tmp_path)).collect()}
    assert got == {(0, "MIT"), (1, "GPL-3.0"), (2, "GPL-2.0"), (3, "CC-BY-NC-4.0"), (4, "CC-BY-4.0"), (5, "Apache-2.0"), (10, "MIT")}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def found(text):
    return [(r[0], r[1], r[2]) for r in licenses.scan(text, licenses.default_templates())]


def test_op4_full_mit_text():
    got = found("MIT License\n\nCopyright (c) 2024 Jane Doe\n\n" + MIT)
    assert got == [(4, 21, "MIT")]  # one notice, over the blank lines
    assert {x[2] for x in found(MIT.replace("\n", "\n// "))} == {"MIT"}
    assert {x[2] for x in found(MIT.replace("\n\n", "\n"))} == {"MIT"}  # one block, with the disclaimer


def test_op4_adjacent_and_inline_notices():
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    assert found(f"{mit}\n{apache}") == [(0, 1, "MIT"), (1, 2, "Apache-2.0")]
    assert [x[2] for x in found(f"{mit} {apache} {mit}")] == ["MIT", "Apache-2.0", "MIT"]
    assert [x[2] for x in found("All of the files in this work are in the public and can be used as they are licensed under the Apache License, Version 2.0 and the conditions of that License.")] == ["Apache-2.0"]
    assert found("the use of this software is subject to the license\n" * 57 + MIT) == [(57, 74, "MIT")]  # across line 60
    assert not found("The MIT License and the Apache License are licenses.")


def test_op4_names_of_other_licenses():
    header = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    assert found(header.format("")) == [(0, 4, "GPL-3.0")]
    assert found(header.format("Lesser ")) == [(0, 4, "LGPL-3.0")]
    assert found(header.format("Affero ")) == [(0, 4, "AGPL-3.0")]
    assert not found("This work is licensed under the GNU Lesser General Public License, version 2.")


def test_op4_long_sentences_and_lines():
    import time

    gpl = "This work is licensed under the GNU General Public License, version 3."
    assert [x[2] for x in found(gpl[:-1] + ", which the authors of the collection and all of its many later editors chose together after a long debate in public")] == ["GPL-3.0"]
    assert [x[2] for x in found("for all we know today " + gpl[:-1] + " and others")] == ["GPL-3.0"]
    began = time.time()
    assert [x[2] for x in found("license and copyright of the software " * 13_000 + "Released under the MIT License. " + "the word " * 60_000)] == ["MIT"]
    assert time.time() - began < 30


def test_op4_whole_texts_and_ties():
    bsd = licenses.TEMPLATES["BSD-3-Clause"][0].replace("{", "").replace("}", "")
    assert [x[2] for x in found(bsd)] == ["BSD-3-Clause"]
    assert [x[2] for x in found(bsd.replace("3. Neither", "X").split("X")[0])] == ["BSD-2-Clause"]
    assert not found(bsd[bsd.index("THIS SOFTWARE") :])  # the disclaimer tells no license
    assert not found(MIT[MIT.index("THE SOFTWARE IS") :])
    for name, (text, *_) in licenses.TEMPLATES.items():
        assert [x[2] for x in found(text.replace("{", "").replace("}", ""))] == [name]
    assert [x[2] for x in found((MIT + "\n") * 3)] == ["MIT"] * 3


def test_op4_planted_notices_with_noise():
    """Notices with edits, wrapped and commented, in prose of several lengths: all found, at their lines, nothing else."""
    import random
    import re

    rng = random.Random(6)
    t = licenses.default_templates()
    prose = lambda n: " ".join("".join(rng.choices("bcdfglmnprst", k=1) + rng.choices("aeiou", k=1) + rng.choices("lmnrst", k=1)) for _ in range(n))
    for _ in range(60):
        lines, want = [], []
        for _ in range(rng.randrange(0, 4)):
            lines += [prose(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 5))]
            name = rng.choice(list(licenses.TEMPLATES))
            words = rng.choice(licenses.TEMPLATES[name])
            telling = {w.lower() for g in re.findall(r"\{([^}]*)\}", words) for w in licenses.WORD.findall(g)}
            words = words.replace("{", "").replace("}", "").split(" ")
            if len(words) > 40:
                plain = [k for k, w in enumerate(words) if not telling & {x.lower() for x in licenses.WORD.findall(w)}]
                for k in rng.sample(plain, len(plain) // 16):
                    words[k] = prose(1)
            begin = len(lines)
            while words:
                n = rng.randrange(6, 14)
                lines.append(rng.choice(["", "// ", "  * "]) + " ".join(words[:n]))
                words = words[n:]
            want.append((begin, name))
            lines += [prose(12)]
        got = licenses.scan("\n".join(lines), t)
        assert [x[2] for x in got] == [w[1] for w in want], "\n".join(lines)
        assert all(abs(x[0] - w[0]) <= 1 for x, w in zip(got, want))


def aligned(block, template):
    """Longest common subsequence: (equal, added, missing) words, by a table of its own."""
    n, m = len(block), len(template)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if block[i] == template[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    same, more, first, last = [], [], None, None
    while i < n and j < m:
        if block[i] == template[j]:
            same.append(block[i])
            first, last = (j if first is None else first), j
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            more.append(block[i])
            i += 1
        else:
            j += 1
    more += block[i:]
    less = list(template[first : last + 1]) if same else []
    for w in same:
        less.remove(w)
    return same, more, less


def test_op4_every_window_of_short_texts():
    """All windows of short texts against all short templates, aligned and compressed here: whatever satisfies the rules
    overlaps a reported notice, and every reported license is one that some window satisfies."""
    import math
    import random
    import re

    import zstandard

    rng = random.Random(9)
    split = lambda x: [w.lower() for w in re.findall(r"[a-z0-9][a-z0-9.-]*[a-z0-9]|[a-z0-9]", x, re.I | re.A)]
    telling_of = lambda x: {w for g in re.findall(r"{([^}]*)}", x) for w in split(g)}
    entries = [(name, x) for name, ts in licenses.TEMPLATES.items() for x in ts]
    tells = {p for _, x in entries for w in telling_of(x) for p in (w, *w.split("-")) if len(p) > 2 and re.search("[a-z]", p)}
    short = [(name, x) for name, x in entries if len(x.split()) < 12]
    plain = lambda x: x.replace("{", "").replace("}", "")
    squeeze = lambda data, d=None: len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))
    raw = {x: zstandard.ZstdCompressionDict(plain(x).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, x in short}
    n = 0
    for _ in range(60):
        ws = " ".join(rng.choice([*[plain(rng.choice(short)[1])] * 3, "the license of this work", "under the", "version 3", "not"]) for _ in range(3)).split(" ")
        for k in rng.sample(range(len(ws)), 1):
            ws[k] = rng.choice(["the", "MIT", "2.0", "other"])
        text = "\n".join(ws)
        lines = [(k, w) for k, line in enumerate(text.split("\n")) for w in split(line)]
        got = [(x[0], x[1], x[2]) for x in licenses.scan(text, licenses.default_templates())]
        right = set()
        for a in range(len(lines)):
            for b in range(a + 2, min(len(lines), a + 14) + 1):
                part = [w for _, w in lines[a:b]]
                before = [w for _, w in lines[max(0, a - 2) : a]]
                for name, x in short:
                    telling, own = telling_of(x), split(plain(x))
                    if not telling <= set(part) or part[0] not in own or part[-1] not in own:
                        continue
                    same, more, less = aligned(part, own)
                    if len(same) < math.ceil(0.7 * len(own)) or len(more) + len(less) > 0.2 * len(part) or telling & set(less) or (tells - set(own) - telling) & set(more) or {"not"} & {*before, *more}:
                        continue
                    data = " ".join(text.split("\n")[lines[a][0] : lines[b - 1][0] + 1]).encode()
                    if (squeeze(data) - squeeze(data, raw[x])) / squeeze(data) >= 0.3:
                        n += 1
                        right.add(name)
                        assert any(lines[a][0] < e and s < lines[b - 1][0] + 1 for s, e, _ in got), (name, part, got)
        assert {x[2] for x in got} <= right | {x for _, _, x in got if any(len(t.split()) >= 12 for t in licenses.TEMPLATES[x])}
    assert n > 60


def test_op4_the_ranking_decides(monkeypatch):
    """A notice that two licenses' templates explain with as many differences goes to the one that saves more bytes."""
    t = licenses.default_templates()
    header = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version 2 or 3 of the License, or (at your option) any later version."
    gpl2, gpl3 = header.format(";", ";"), header.format(":", ",")

    def names():
        return [[x[2] for x in licenses.scan(y, t)] for y in (gpl2, gpl3)]

    for text in (gpl2, gpl3):
        block = licenses.blocks(licenses.Words(text), t)[0]
        words = licenses.Words(text)
        assert all(licenses.confirmed(words, *block, i, t) for i, e in enumerate(t.entries) if e[0] in ("GPL-2.0", "GPL-3.0") and len(e[1]) > 40 and "program" in e[1])
    assert names() == [["GPL-2.0"], ["GPL-3.0"]]
    monkeypatch.setattr(licenses, "ranked", lambda data, templates: [(1, i) for i in range(len(templates.entries))])
    assert names() != [["GPL-2.0"], ["GPL-3.0"]]


def test_op4_every_template_compresses_every_block(monkeypatch):
    t, seen = licenses.default_templates(), []
    own = licenses.saved
    monkeypatch.setattr(licenses, "saved", lambda data, c, alone: seen.append((data, id(c))) or own(data, c, alone))
    licenses.scan("Released under the MIT License.", t)
    block = b"Released under the MIT License"
    assert {c for d, c in seen if d == block} == {id(e[3]) for e in t.entries}


def test_op4_families_tags_and_denials():
    for text, name in [
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"), ("Licensed under CC BY-NC-SA 2.0.", "CC-BY-NC-SA-2.0"), ("SPDX-License-Identifier: MIT", "MIT"),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"), ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.\n\n\"License\" shall mean the terms and conditions for use, reproduction,\nand distribution as defined by Sections 1 through 9 of this document.", "Apache-2.0"),
    ]:
        assert [x[2] for x in found(text)] == [name], text
    for text in ("This file is not licensed under the MIT License.", "It was never released under the MIT License.", "CC BY 4.0", "SPDX"):
        assert not found(text), text


def test_op5_counts(spark, edge):
    folder, docs, *_ = edge
    want = Counter((d, n - 1) for d, _, n, _ in brute.tokens(pairs(docs), default_path(), 0, ordinary=True))
    assert rows(tokencounts.op5(spark, str(folder)), "doc_id", "n_tokens") == want


def test_op5_blocks_are_stitched(spark, tmp_path):
    import numpy as np

    ids = [5, 5, 9, 9, 5, 5, 5, 5, 5, 5, 5, 9, 7, 9, 1, 2]
    path = tmp_path / "flat.bin"
    np.array(ids, "<u2").tofile(path)
    files = spark.createDataFrame([(f"file://{path}", 2 * len(ids), 2, 9)], "uri string, n_bytes long, id_bytes int, end_id long")
    for block in (1, 2, 3, 5, 100):
        got = [r.n_tokens for r in tokencounts.count_flat(files, block, 2).orderBy("ordinal").collect()]
        assert got == [2, 0, 7, 1, 2], block


@pytest.mark.parametrize("long", [2, 8, 64])
def test_op6_components(spark, edge, long):
    folder, docs, *_ = edge
    got = setjoin.Join(spark.read.parquet(f"{folder}/documents.parquet"), long=long).classes()
    assert rows(got, "doc_id", "n_shingles", "component_id") == Counter(brute.components(pairs(docs)))


def test_op6_one_of_each(spark, edge):
    folder, docs, *_ = edge
    d = spark.read.parquet(f"{folder}/documents.parquet")
    left = setjoin.one_of_each(d)
    assert left.columns == d.columns
    kept = left.collect()
    comps = brute.components(pairs(docs))
    n_groups = len({(c, None) if n else ("alone", i) for i, (_, n, c) in enumerate(comps)} | set())
    alone_null = [i for i, (d_, n, c) in enumerate(comps) if c is None and n]
    distinct = {c for _, n, c in comps if n and c is not None}
    shared_ids = sum(1 for d_, t in pairs(docs) if d_ == 5) - 1  # two texts under one id are two groups with one name
    assert len(kept) == len(distinct) + shared_ids + len(alone_null) + sum(1 for _, n, _ in comps if not n), n_groups


def test_op6_groups_that_long_lists_leave_open(spark, monkeypatch):
    """Texts of common shingles alone, in all sizes, and more long lists than are put last."""
    import random

    rng = random.Random(8)
    parts = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(14)]
    texts = [" ".join(rng.sample(parts, rng.randrange(3, 14))) for _ in range(150)]
    texts += [t + " tail" for t in texts[:20]] + [" ".join(t.split(" ")[:-3]) for t in texts[:20]]
    docs = list(enumerate(texts))
    want = Counter(brute.components(docs))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    for most in (200_000, 20):
        monkeypatch.setattr(setjoin, "MOST_LONG", most)
        assert rows(setjoin.Join(d, long=4).classes(), "doc_id", "n_shingles", "component_id") == want


def test_op7_lines(spark, edge):
    folder, docs, *_ = edge
    assert rows(linededup.op7(spark, str(folder)), "doc_id", "n_lines", "n_dropped", "kept_sha256") == Counter(brute.lines(pairs(docs), 10))


def test_op7_join_path_and_first(spark, edge):
    folder, docs, *_ = edge
    d = spark.read.parquet(f"{folder}/documents.parquet")
    a = rows(linededup.dedup_lines(d, broadcast_rows=400_000), "doc_id", "n_dropped", "text")
    assert rows(linededup.dedup_lines(d, broadcast_rows=-1), "doc_id", "n_dropped", "text") == a
    first = linededup.dedup_lines(d, keep_first=True).collect()
    assert sum("hared line." in r.text for r in first if r.doc_id is not None) == 1


def test_op7_small_filter(spark, edge, monkeypatch):
    """A filter far too small changes nothing; one of the usual size has few false suspects."""
    folder, docs, *_ = edge
    everything = linededup.suspect_filter
    d = spark.read.parquet(f"{folder}/documents.parquet")
    want = rows(linededup.dedup_lines(d), "doc_id", "n_dropped", "text")
    monkeypatch.setattr(linededup, "suspect_filter", lambda suspects, most, segment=64: everything(suspects, most, segment))
    assert rows(linededup.dedup_lines(d, filter_bits=64), "doc_id", "n_dropped", "text") == want


def test_op7_suspects_are_few_at_any_number_of_segments(spark):
    texts = [f"own line {i}\nanother {i * 7}\nshared {i // 2}" for i in range(2000)]
    docs = linededup.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    suspects = linededup.twice_seen(docs, 6000, 1, 1 << 10).agg({"n": "sum"}).head()[0]
    assert 1000 <= suspects <= 1600
    packed, bits = linededup.suspect_filter(linededup.twice_seen(docs, 6000, 1, 1 << 10), 1 << 30, 1 << 10)
    assert bits in (1 << 13, 1 << 14) and len(packed) == bits // 8


def test_op7_no_repeat_is_lost(spark):
    """200,000 keys in 10 documents each over 16 tasks, and as many in 9: filters fill, and every line of the first goes."""
    from pyspark.sql import functions as F

    def texts(first, copies):
        block = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("line "), (F.col("block") * 1000 + i).cast("string")))
        return spark.range(200 * copies).select((F.pmod("id", F.lit(200)) + first).alias("block")).select(F.concat_ws("\n", block).alias("text"))

    docs = keep(texts(0, 10).union(texts(1000, 9)).repartition(16).withColumn("doc_id", F.monotonically_increasing_id()), "many")
    out = linededup.dedup_lines(docs).groupBy((F.col("n_dropped") > 0).alias("hot")).agg(F.sum("n_lines").alias("n"), F.sum("n_dropped").alias("d")).collect()
    assert {(r.hot, r.n, r.d) for r in out} == {(True, 2_000_000, 2_000_000), (False, 1_800_000, 0)}


@pytest.mark.parametrize("bits", [64, 1 << 10, 1 << 14])
def test_op7_suspects_are_all_repeats_at_any_filling(spark, bits):
    """Counted exactly: whatever the filters' size, each hash of a repeat is among the suspects once."""
    import numpy as np

    texts = [f"own {i}\nthird {i // 3}\nhalf {i // 2}\nall" for i in range(3000)]
    docs = linededup.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8))
    sent = np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in linededup.twice_seen(docs, 12000, 1, bits).collect()])
    repeats = [f"third {i}" for i in range(1000)] + [f"half {i}" for i in range(1500)] + ["all"]
    ends = np.cumsum([len(x) + 1 for x in repeats]) - 1
    want = linededup.B.hashes(np.frombuffer(" ".join(repeats).encode(), np.uint8), ends - [len(x) for x in repeats], ends, True)
    assert len(sent) == len(set(sent.tolist())) and set(want.tolist()) <= set(sent.tolist())


def test_op8_tokens(spark, edge):
    folder, docs, *_ = edge
    assert rows(tokenbits.op8(spark, str(folder)), "doc_id", "start", "n_tokens", "ids_crc32") == Counter(brute.tokens(pairs(docs), default_path(), 2))


@pytest.mark.parametrize("bits", [1, 3, 11, 15, 16, 17, 20])
def test_op8_packing(tmp_path, bits):
    import numpy as np

    from glimmer.llm.files import TaskFile

    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << bits, n, dtype=np.uint32) for n in (0, 1, 7, 1000, 64, 3)]
    out = TaskFile(f"file://{tmp_path}", ".tid")
    w = tokenbits.Writer(out, bits, 64)
    for i, x in enumerate(ids):
        w.add(None if i == 2 else i, x)
    w.close()
    f = tokenbits.TokenFile(out.close())
    assert [list(f.document(i)) for i in range(len(ids))] == [list(x) for x in ids]
    assert [(d, list(x)) for d, _, x in f.each()] == [(None if i == 2 else i, list(x)) for i, x in enumerate(ids)]


def test_op8_words_encode_as_texts_do():
    from tokenizers import Tokenizer

    from glimmer.llm.encoding import encoder

    texts = ["It's the dog's <|endoftext|> don't", "ÀÉ é ﬁ  nbsp x", "Σίσυφος İstanbul ǅ", "a1b22 #*$%&|<> ...", "'s 's' ''ll", "日本語 中文", "\x00 \x1f a​b"]
    for ordinary in (False, True):
        t = Tokenizer.from_file(default_path())
        t.encode_special_tokens = ordinary
        assert [list(x) for x in encoder(default_path(), ordinary).encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_op9_warc(spark, edge):
    folder, _, _, pages = edge
    assert rows(warc.op9(spark, str(folder)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == Counter(brute.warc([(p, h) for p, _, h in pages]))


def test_op9_random_access(spark, edge, tmp_path):
    folder, _, _, pages = edge
    uris = [r.uri for r in warc.write(spark.read.parquet(f"{folder}/pages.parquet"), f"file://{tmp_path}/w", frame=100).collect()]
    n = 0
    for uri in uris:
        b = warc.SeekableBundle(uri)
        for rid in b.index:
            head, body = b.record(rid)
            assert head["WARC-Record-ID"] == rid
            n += 1
            if head["WARC-Type"] == "response":
                assert warc.digest(body) == head["WARC-Payload-Digest"].removeprefix("sha1:")
    assert n == len(pages)  # equal rows too have ids of their own


def test_op9_refers_to_the_response(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x"), (3, "http://c", "y"), (3, "http://c", "y"), (4, "http://d", "y"), (5, None, "z")], "page_id long, url string, html string").repartition(3)
    heads = [h for r in warc.write(pages, f"file://{tmp_path}/w").collect() for h, _ in warc.SeekableBundle(r.uri).each()]
    assert len({h["WARC-Record-ID"] for h in heads}) == 6
    by_page = {h["X-Page-ID"]: h for h in heads}
    assert by_page["2"]["WARC-Refers-To"] == by_page["1"]["WARC-Record-ID"]
    assert by_page["4"]["WARC-Type"] == "revisit" and by_page["4"]["WARC-Refers-To-Target-URI"] == "http://c" and "WARC-Refers-To" not in by_page["4"]
    few = [h for r in warc.write(pages, f"file://{tmp_path}/v", min_bytes=2).collect() for h, _ in warc.SeekableBundle(r.uri).each()]
    assert {h["WARC-Type"] for h in few} == {"response"} and len({h["WARC-Record-ID"] for h in few}) == 6


def test_op10_base_counts(spark, edge):
    folder, docs, *_ = edge
    got = rows(quality.op10(spark, str(folder)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == Counter((d, *brute.quality(t)) for d, t in pairs(docs))


def test_op10_bands(spark):
    import base64
    import random

    import zstandard

    rng = random.Random(1)
    c = zstandard.ZstdCompressor(level=quality.LEVEL)
    noise = base64.b64encode(rng.randbytes(6000))
    syllables = "the and ing er re on ti es st en ha th ou wh ly".split()
    prose = " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(2000)).encode()
    assert quality.compression(prose, c)[2]
    assert not quality.compression(noise, c)[2]
    assert not quality.compression(b"again and again " * 500, c)[2]
    assert not quality.compression(prose + noise + noise, c)[2]  # half of the chunks are noise
    assert not quality.compression(b"", c)[2]


def test_op10_last_chunk():
    import base64
    import random

    import zstandard

    rng = random.Random(2)
    c = zstandard.ZstdCompressor(level=quality.LEVEL)
    syllables = "the and ing er re on ti es st en ha th ou wh ly".split()
    prose = " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(2000)).encode()
    noise = base64.b64encode(rng.randbytes(6000))
    assert not quality.compression(prose[:2060] + noise[:1980], c)[2]  # half noise, under two whole chunks
    assert not quality.compression(prose[:4096] + noise[:2040], c)[2]  # noise after the last whole chunk
    assert all(quality.compression(prose[:n], c)[2] for n in range(2040, 4200))  # tails of any length are fair


def test_op10_passing_keeps_columns(spark, edge):
    folder, *_ = edge
    d = spark.read.parquet(f"{folder}/documents.parquet")
    left = quality.passing(d)
    assert left.schema == d.schema
    verdict = rows(quality.quality(d).filter("kept"), "doc_id")
    assert rows(left, "doc_id") == verdict


def test_words_put_together_from_pieces_have_the_library_s_ids():
    """Contractions, Latin-1 letters, marks, signs that normal forms change, and strings of special tokens."""
    import random

    from glimmer.llm.encoding import Encoder, default_path
    from tokenizers import Tokenizer

    parts = ["a", "B", "é", "É", "ß", "ẞ", "Ÿ", "×", "÷", "©", "́", "'s", "'ll", "'", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "²", "İ", "K", "Σ", ".", "--", "</w>", "　", "\x1c", "\x7f", "漢", "🙂", "Ġ", " "]
    rnd = random.Random(5)
    texts = ["", " ", *("".join(rnd.choices(parts, k=rnd.randint(1, 14))) for _ in range(3000))]
    library = Tokenizer.from_file(default_path())
    assert [x.tolist() for x in Encoder(default_path()).encode([t.encode() for t in texts])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


#: Written out again, so that a change of the module's own bands shows.
LIMITS = [(64, 0.0, 1.8), (128, 0.3, 1.2), (160, 0.3, 0.98), (200, 0.3, 0.93), (256, 0.3, 0.88), (384, 0.3, 0.83), (512, 0.3, 0.79), (768, 0.3, 0.76), (1024, 0.3, 0.74), (4096, 0.28, 0.66), (16384, 0.24, 0.6), (10**12, 0.2, 0.56)]


def kept_by_hand(text):
    """The verdict by streaming compression of pieces cut here."""
    import io

    import zstandard

    def fair(b):
        out = io.BytesIO()
        with zstandard.ZstdCompressor(level=3).stream_writer(out, closefd=False, size=len(b)) as w:
            w.write(b)
        low, high = next(x[1:] for x in LIMITS if len(b) <= x[0])
        return low <= len(out.getvalue()) / len(b) <= high

    b = (text or "").encode()
    if not b or brute.quality(text)[5] or not fair(b):
        return False
    pieces = [b[i : i + 512] for i in range(0, len(b), 512)] if len(b) > 512 else []
    return sum(len(p) for p in pieces if not fair(p)) <= 0.3 * len(b)


def test_op10_kept_by_another_call_path(spark):
    import base64
    import random

    rng = random.Random(31)
    syllables = "the and ing er re on ti es st en ha th ou wh ly".split()
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(n))
    noise = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    texts = [prose(rng.randrange(1, 700)) for _ in range(120)] + [prose(rng.randrange(10, 200)) + " " + noise(rng.randrange(20, 900)) for _ in range(120)]
    texts += [noise(n) for n in range(40, 1600, 40)] + [("word " * n) for n in range(1, 200, 9)] + [noise(400)[:512] + " " + prose(400), None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality.quality(d).collect()}
    assert got == {i: kept_by_hand(t) for i, t in enumerate(texts)}
    assert sum(got[i] for i in range(120)) > 90 and any(got.values())


@pytest.mark.parametrize("length", [2048, 2049, 4096, 20_000])
def test_op10_half_noise_goes(length):
    import base64
    import random

    import zstandard

    rng, c = random.Random(length), zstandard.ZstdCompressor(level=quality.LEVEL)
    syllables = "the and ing er re on ti es st en ha th ou wh ly".split()
    for _ in range(20):
        prose = " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(length // 3)).encode()
        noise = base64.b64encode(rng.randbytes(length))
        assert quality.compression(prose[:length], c)[2]
        assert not quality.compression(prose[: length // 2] + noise[: length - length // 2], c)[2]
        assert not quality.compression(noise[:length], c)[2] and not quality.compression(noise[:200], c)[2]
