"""License scans by conditional compression.

Candidate blocks are the stretches of a text, over any number of lines, in which word pairs of a template stand close
together. A block is compressed alone and with every template as a zstandard raw-content dictionary; the templates are
ranked by the bytes that they save. The winner is confirmed by the exact differences in wording, else the next in rank
is tried: the block's words are aligned with the best window of the template, and a license is reported if few words
differ, none of the words that tell licenses apart (names, versions) does, no name that tells another license is added
and the words before it do not deny it. What is left of the block on either side of the window is a block again. So
what stands around a notice is no difference, and a text may hold any number of notices on adjacent lines or in prose; a
license's bare name is none.

Texts in which no word pair of a template occurs are passed over by one vectorised look at the column's bytes. The
templates hold the whole text of short licenses, and of long ones (Apache, GPL, MPL) the notice and the opening.

Cases: null and empty texts have no notice; texts and lines of any length are scanned whole, in time proportional to
their length and the notices in them; a template's words may run over several lines; rows are judged one by one, so
equal rows are reported each, and null doc_ids are carried; of templates that save equally much the first wins; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import bytescan as B
from .shared import documents, keyed

#: Texts and usual notices of public licenses. Braces mark the words that tell licenses apart.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the {Apache} License, Version {2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Licensed under the {Apache} License, Version {2.0}.", "{Apache} License Version {2.0}, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, {sublicense}, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "Released under the {MIT} License.", "Licensed under the {MIT} License."),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the {GNU} {General} Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "This work is licensed under the {GNU} {General} Public License, version {3}.", "{GNU} {GENERAL} PUBLIC LICENSE Version {3}, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the {GNU} {General} Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "This work is licensed under the {GNU} {General} Public License, version {2}."),
    "LGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the {GNU} {Lesser} General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "This work is licensed under the {GNU} {Lesser} General Public License, version {3}.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the {GNU} {Affero} General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "This work is licensed under the {GNU} {Affero} General Public License, version {3}.",),
    "BSD-3-Clause": ("{Redistribution} and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to {endorse} or {promote} products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", "Licensed under the {BSD} {3-Clause} License."),
    "BSD-2-Clause": ("{Redistribution} and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", "Licensed under the {BSD} {2-Clause} License."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any {purpose} with or without {fee} is hereby granted, provided that the above copyright notice and this permission notice {appear} in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", "Released under the {ISC} License.", "Licensed under the {ISC} License."),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The {origin} of this software must not be {misrepresented}; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", "Licensed under the {zlib} License."),
    "Unlicense": ("This is free and {unencumbered} software released into the {public} {domain}. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>",),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or {organization} obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "Distributed under the {Boost} Software License, Version {1.0}."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the {GNU} {Lesser} General Public License as published by the Free Software Foundation; either version {2.1} of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.", "This work is licensed under the {GNU} {Lesser} General Public License, version {2.1}."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. {CC0} {1.0} Universal",),
}
#: Creative Commons licenses: code and name; each in the versions below, with the words that follow a version in a notice.
COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
TEMPLATES |= {f"CC-{code}-{v}": (f"Licensed under CC {{{code}}} {{{v}}}.", f"This work is licensed under a Creative Commons {{{name}}} {{{v}}} {port} License.") for v, port in VERSIONS.items() for code, name in COMMONS.items()}
#: Every license may be named by a tag line; GPL's tags say whether later versions may be chosen.
TEMPLATES = {name: (*texts, *(f"SPDX-License-Identifier: {{{tag}}}" for tag in ([name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name]))) for name, texts in TEMPLATES.items()}
DENIALS = "not never no isn aren cannot without".split()
WORD = re.compile(r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]", re.I | re.A)
LEVEL = 3
#: Words of a block beyond which it is cut, overlapping by the longest template.
MOST_WORDS = 1200
MIN_GAIN = 0.25
MAX_DIFFERENT = 0.2
#: A window must hold so much of the template, or so many of its words.
MIN_COVER = 0.7
MIN_COVERED = 30


_FILTER = 1 << 20
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-")] = True


def _pairs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filter places, texts) of the pairs of neighbouring words, as WORD finds them, in the texts' bytes."""
    edge = np.diff(np.concatenate([[0], _WORD_BYTES[data].view(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inside = np.flatnonzero(_WORD_BYTES[data] & (data != 0x2E) & (data != 0x2D))
    a, b = np.searchsorted(inside, s), np.searchsorted(inside, e)
    s, e = inside[a[b > a]], inside[b[b > a] - 1] + 1
    h = B.hashes(data, s, e, True)
    owner = np.searchsorted(offs, s, "right") - 1
    near = owner[1:] == owner[:-1]
    with np.errstate(over="ignore"):
        return (B.mix(h[:-1] * np.uint64(3) + h[1:]) & np.uint64(_FILTER - 1)).astype(np.int64)[near], owner[1:][near]


class Templates:
    def __init__(self, templates=TEMPLATES):
        self.entries = []
        for name, texts in templates.items():
            for text in texts:
                plain = text.replace("{", "").replace("}", "")
                data = zstandard.ZstdCompressionDict(plain.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
                self.entries.append((name, words(plain), {w.lower() for g in re.findall(r"\{([^}]*)\}", text) for w in WORD.findall(g)}, compressor))
        self.pairs: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for i, (_, ws, _, _) in enumerate(self.entries):
            for at, pair in enumerate(zip(ws, ws[1:])):
                self.pairs.setdefault(pair, []).append((i, at))
        # names that tell some license apart, also as parts of hyphenated ones: no window of another may add them
        tells = {p for _, _, ws, _ in self.entries for w in ws for p in (w, *w.split("-")) if len(p) > 2 and any(c.isalpha() for c in p)}
        self.foreign = [tells - set(ws) - telling for _, ws, telling, _ in self.entries]
        self.longest = max(len(ws) for _, ws, _, _ in self.entries)
        known = np.zeros(_FILTER, bool)
        for a, b in self.pairs:
            known[_pairs(np.frombuffer(f"{a} {b}".encode(), np.uint8), np.array([0, len(a) + len(b) + 1]))[0]] = True
        self.known = known
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@lru_cache(maxsize=1)
def default_templates() -> Templates:
    return Templates()


class Words:
    """A text's words with their places and lines."""

    def __init__(self, text: str):
        found = list(WORD.finditer(text))
        self.text, self.words = text, [m.group().lower() for m in found]
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def line(self, word: int) -> int:
        return bisect.bisect_left(self.breaks, self.starts[word])

    def part(self, a: int, b: int) -> str:
        """The text of words a to b, its white space as single blanks: how it is wrapped is no difference."""
        return " ".join(self.text[self.starts[a] : self.ends[b - 1]].split())


def windows(block: list[str], template: list[str]) -> Iterator[tuple[int, int, list[str], list[str], list[str]]]:
    """(start and end word, equal words, added words, missing words) of the stretches of a block that the template
    aligns with: what stands before and after a stretch is no difference."""
    if not block or not template:
        return
    ops = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    spans = []
    for cost in (1, 4):  # words a difference costs: over long gaps, and over few
        best = total = first = 0
        span = None
        for k, (op, a, b, c, d) in enumerate(ops):
            if total <= 0:
                total, first = 0, k
            total += b - a if op == "equal" else -cost * (b - a + d - c)
            if op == "equal" and total >= best:  # of equal sums the longer stretch
                best, span = total, (first, k + 1)
        if span and span not in spans:
            spans.append(span)
    for first, last in spans:
        own = ops[first:last]
        same = [w for op, a, b, _, _ in own if op == "equal" for w in template[a:b]]
        more = [w for op, _, _, c, d in own if op in ("insert", "replace") for w in block[c:d]]
        less = [w for op, a, b, _, _ in own if op in ("delete", "replace") for w in template[a:b]]
        yield own[0][3], own[-1][4], same, more, less


def saved(data: bytes, compressor, alone: int) -> int:
    """Bytes that a template's dictionary saves."""
    return alone - len(compressor.compress(data))


def ranked(data: bytes, templates: Templates) -> list[tuple[int, int]]:
    """(bytes saved, entry) of every template that saves any, most first; of equals the template that comes first."""
    alone = len(templates.alone.compress(data))
    found = [(saved(data, compressor, alone), i) for i, (*_, compressor) in enumerate(templates.entries)]
    return sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1]))


def enough(words: int) -> int:
    """Words that a window must share with a template of so many."""
    return min(MIN_COVERED, math.ceil(MIN_COVER * words))


def blocks(text: Words, templates: Templates) -> list[tuple[int, int]]:
    """(first word, end word) of the stretches in which so many different word pairs of one template stand as near to each
    other as in a window that may be confirmed; overlapping ones are one block."""
    hits: dict[int, list[tuple[int, int]]] = {}
    for at, pair in enumerate(zip(text.words, text.words[1:])):
        for i, place in templates.pairs.get(pair, ()):
            hits.setdefault(i, []).append((at, place))
    spans = []
    for i, places in hits.items():
        n = len(templates.entries[i][1])
        # at most a fifth differs, so a window's equal words form few runs and hold at least so many different pairs
        pairs = max(1, math.ceil(enough(n) * (1 - MAX_DIFFERENT / (1 - MAX_DIFFERENT)) - 1))
        longest, done, last = math.ceil(n / (1 - MAX_DIFFERENT)) + 1, -1, 0
        for k, (at, _) in enumerate(places):
            if at < done:
                continue
            while last < len(places) and places[last][0] < at + 2 * longest:
                last += 1
            done = at + longest
            if len({p for _, p in places[k:last]}) >= pairs:
                spans.append((at, places[last - 1][0] + 2))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    # a cut block's pieces overlap by what a window may hold
    step = MOST_WORDS - math.ceil(templates.longest / (1 - MAX_DIFFERENT)) - 1
    return [(c, min(b, c + MOST_WORDS)) for a, b in out for c in (a, *range(a + step, b - MOST_WORDS + step, step))]


def confirmed(text: Words, lo: int, hi: int, i: int, templates: Templates) -> tuple | None:
    """(first word, end word, gain, added words, missing words) of the window of a template in a block, if it is a notice."""
    _, own, telling, compressor = templates.entries[i]
    ws = text.words[lo:hi]
    if hi - lo < enough(len(own)) or not telling <= set(ws):
        return None
    for a, b, same, more, less in windows(ws, own):
        if len(same) < enough(len(own)) or len(more) + len(less) > MAX_DIFFERENT * (b - a) or not telling <= set(same) or telling & set(less) or templates.foreign[i] & set(more):
            continue
        if set(DENIALS) & {*text.words[max(0, lo + a - 2) : lo + a], *more}:
            continue
        data = text.part(lo + a, lo + b).encode()
        alone = len(templates.alone.compress(data))
        gain = saved(data, compressor, alone) / alone
        if gain >= MIN_GAIN:
            return lo + a, lo + b, gain, more, less
    return None


def scan(text: str, templates: Templates) -> list[tuple[int, int, str, float, list[str], list[str]]]:
    """(first and end line, license, gain, added words, missing words) of every notice."""
    w = Words(text)
    out, free, todo = [], [True] * len(w.words), blocks(w, templates)[::-1]
    while todo:
        lo, hi = todo.pop()
        while lo < hi and not free[lo]:  # pieces of a cut block overlap
            lo += 1
        if lo >= hi - 1:
            continue
        for _, i in ranked(w.part(lo, hi).encode(), templates):
            found = confirmed(w, lo, hi, i, templates)
            if found and all(free[found[0] : found[1]]):
                a, b, gain, more, less = found
                free[a:b] = [False] * (b - a)
                out.append((a, w.line(a), w.line(b - 1) + 1, templates.entries[i][0], round(gain, 4), more, less))
                todo += [(b, hi), (lo, a)]
                break
    return [x[1:] for x in sorted(out)]


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = default_templates()
    for batch in batches:
        rows = []
        for a, _, data, offs in B.texts(batch, "text"):
            places, owner = _pairs(data, offs)
            for i in (a + np.unique(owner[templates.known[places]])).tolist():
                doc_id = batch.column("doc_id")[i].as_py()
                rows += [(doc_id, *x) for x in scan(batch.column("text")[i].as_py(), templates)]
        if rows:
            c = list(zip(*rows))
            yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3]), pa.array(c[4], pa.float64()), pa.array(c[5], pa.list_(pa.string())), pa.array(c[6], pa.list_(pa.string()))], names=["doc_id", "first_line", "end_line", "license", "gain", "added_words", "missing_words"])


def licenses(docs: DataFrame) -> DataFrame:
    """One row a confirmed license notice."""
    return keyed(docs).mapInArrow(_task, "doc_id long, first_line long, end_line long, license string, gain double, added_words array<string>, missing_words array<string>")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))
