"""License notices and texts, found by conditional compression.

Lines that speak of licensing are candidate blocks. A block is compressed alone and with each
template as raw dictionary; a template that saves much of its own compressed size says much of the same,
however long the block is. The templates that save most are confirmed by the exact differences in wording:
the block's words are aligned with the template's, and what is missing or was put in is listed. The place of the
best one is taken out, and what lies before and after it is looked at in the same way, so a block
may hold any number of licenses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from siltstone.llm._common import slices

# Wordings of well-known notices and license texts.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
    "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
    "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare '
    "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
    "express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software "
    "Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will "
    "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "{0} for more details."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_CC = "This work is licensed under a Creative Commons {0} {1} International License."
TEMPLATES = {
    "MIT": ("Released under the MIT License.", _MIT),
    "ISC": ("Released under the ISC License.", _ISC),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", _BSD, _BSD + _BSD_END),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", _BSD + _BSD_3, _BSD + _BSD_3 + _BSD_END),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _GPL.format("General Public License", 2)),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _GPL.format("General Public License", 3)),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", _GPL.format("Lesser General Public License", 3)),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", _GPL.format("Affero General Public License", 3)),
    "MPL-2.0": ("Licensed under the Mozilla Public License, Version 2.0.", _MPL),
    "Zlib": ("Released under the zlib License.", _ZLIB),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", _BOOST),
    "Unlicense": ("Released into the public domain.", _UNLICENSE),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", _CC.format("Attribution", "4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike", "4.0")),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", _CC.format("Attribution-NoDerivatives", "4.0")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial", "4.0")),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", _CC.format("Attribution-NonCommercial-ShareAlike", "4.0")),
    "Proprietary": ("All rights reserved.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
#: How a license is called in running text.
NAMES = {
    "MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Apache-2.0": "Apache License, Version 2.0",
    "GPL-2.0": "GNU General Public License, version 2", "GPL-3.0": "GNU General Public License, version 3", "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3", "MPL-2.0": "Mozilla Public License, Version 2.0", "Zlib": "zlib License", "BSL-1.0": "Boost Software License",
}
#: What a line must hold to be part of a candidate block.
TRIGGERS = ("licens", "licenc", "copyright", "all rights reserved", "redistribut", "permission", "warrant", "public domain", "spdx", "creative commons", "proprietary", "gnu ", "unauthorized copying", "liable")
#: Lines without a trigger that a block may bridge.
BRIDGE = 2
#: Templates compared word by word save at least this share of what the best one saves, which must save LEAST of its own size.
NEAR, LEAST = 0.4, 0.35
#: Of templates of up to BRIEF words, which a compressor gains little from beside the cost of a match.
BRIEF, LEAST_BRIEF = 12, 0.1
_WORD = re.compile(r"[\w+.\-]*\w")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@cache
def _templates() -> list[tuple[str, list[str], zstandard.ZstdCompressor, int]]:
    """Name, words, compressor and size alone of each template."""
    out = []
    for name, texts in TEMPLATES.items():
        for text in (*texts, *filter(None, [NAMES.get(name)]), f"SPDX-License-Identifier: {name}"):
            # by words, so that line breaks and capitals don't count
            data = " ".join(words(text)).encode()
            # a compressor doesn't index the last bytes of a dictionary, so a short one is given several times
            raw = zstandard.ZstdCompressionDict(b" ".join([data] * max(1, 96 // len(data))), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, words(text), zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False), len(_alone().compress(data))))
    return out


@cache
def _alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, write_content_size=False)


_TRIGGER = re.compile("|".join(map(re.escape, TRIGGERS)))


def blocks(text: str, reach: int = 2_000, longest: int = 8_000) -> list[tuple[int, str]]:
    """(start, block): candidate blocks of a text in order; lines with a trigger, and what lies within ``BRIDGE`` lines between them.

    A long line gives ``reach`` characters before and after a trigger. A block of ``longest`` characters isn't
    continued; the next one begins ``reach`` characters before its end, so that a license at the cut is whole in one of them
    if it is no longer than that.
    """
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length; places must hold
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: list[list[int]] = []
    at = 0
    while hit := _TRIGGER.search(low, at):
        start = max(low.rfind("\n", 0, hit.start()) + 1, hit.start() - reach)
        stop = low.find("\n", hit.end())
        stop = min(len(low) if stop < 0 else stop, hit.end() + reach)
        near = spans and (start <= spans[-1][1] or low.count("\n", spans[-1][1], start) <= BRIDGE + 1 and start - spans[-1][1] <= reach)
        if near and (stop <= spans[-1][1] or spans[-1][1] - spans[-1][0] < longest):
            spans[-1][1] = max(stop, spans[-1][1])
        else:
            spans.append([max(0, min(start, spans[-1][1] - reach)) if near else start, stop])
        at = hit.end()
    return [(a, text[a:b]) for a, b in spans]


def place(block: list[str], template: list[str]) -> tuple[int, int]:
    """The range of the block's words that the template's may lie in: from the longest run that agrees to both sides, as long as
    the runs that follow are near enough for their size."""
    runs = [r for r in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if r.size]
    if not runs:
        return 0, 0
    core = max(range(len(runs)), key=lambda i: runs[i].size)
    first = last = core
    while first and runs[first].b - runs[first - 1].b - runs[first - 1].size <= runs[first].a - runs[first - 1].a + 2 * runs[first - 1].size:
        first -= 1
    while last + 1 < len(runs) and runs[last + 1].b - runs[last].b - runs[last].size <= runs[last + 1].a - runs[last].a + 2 * runs[last + 1].size:
        last += 1
    return runs[first].b, runs[last].b + runs[last].size


def differences(block: list[str], template: list[str]) -> tuple[list[str], int]:
    """Words of the template that the block lacks (-) and words put in between (+), and how many words agree."""
    out: list[str] = []
    agree = 0
    for kind, a, b, c, d in SequenceMatcher(None, template, block, autojunk=False).get_opcodes():
        if kind == "equal":
            agree += b - a
        else:
            out += [f"-{w}" for w in template[a:b]] + [f"+{w}" for w in block[c:d]]
    return out, agree


#: (license, status, reduction, words that agree, words of the template, differences, first and last character).
Finding = tuple[str, str, float, int, int, list[str], int, int]


def judge(block: str) -> list[Finding]:
    """The licenses of a block in order of place.

    ``exact``: no difference; ``variant``: at most a quarter as many differences as words. If none is confirmed
    in a whole block, the one that saves most is reported as ``unconfirmed``.
    """
    spots = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(block)]
    return sorted(_judge(spots, True), key=lambda f: (f[6], f[7], f[0]))


def _judge(spots: list[tuple[str, int, int]], whole: bool) -> Iterator[Finding]:
    found = [w for w, _, _ in spots]
    data = " ".join(found).encode()
    if not data or not (whole or _TRIGGER.search(data.decode())):
        return
    alone = len(_alone().compress(data))
    saved = [(alone - len(z.compress(data)), name, own, size) for name, own, z, size in _templates()]
    likely = [x for x in saved if x[0] > 0 and x[0] >= (LEAST if len(x[2]) > BRIEF else LEAST_BRIEF) * x[3]]
    if not likely:
        return
    most = max(x[0] / x[3] for x in likely)
    best = None
    for s, name, own, size in likely:
        if s / size >= NEAR * most or len(own) <= BRIEF:
            a, b = place(found, own)
            diffs, agree = differences(found[a:b], own)
            sure = 4 * len(diffs) <= len(own)
            rank = (sure, agree - 2 * len(diffs) if sure else s, s, name)
            if best is None or rank > best[0]:
                best = (rank, a, b, (name, "exact" if not diffs else "variant" if sure else "unconfirmed", s / alone, agree, len(own), diffs))
    rank, a, b, finding = best
    if not rank[0]:
        if whole and a < b:
            yield *finding, spots[a][1], spots[b - 1][2]
        return
    yield *finding, spots[a][1], spots[b - 1][2]
    yield from _judge(spots[:a], False)
    yield from _judge(spots[b:], False)


def _apart(found: list[tuple]) -> list[tuple]:
    """Findings (license, first, last character, ...) in order of place. Blocks overlap where a long one is cut; of what is found
    in both, whole and in part, the one of most words that agree stays."""
    out: list[tuple] = []
    for f in sorted(found, key=lambda f: (f[0], f[1], f[2])):
        if out and out[-1][0] == f[0] and f[1] < out[-1][2]:
            if f[6] > out[-1][6]:
                out[-1] = f
        else:
            out.append(f)
    return sorted(out, key=lambda f: (f[1], f[2], f[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_kept: int = 20_000, reach: int = 2_000, longest: int = 8_000) -> DataFrame:
    """(id, block, start, n_chars, license, status, reduction, n_agree, n_template, differences): a row for each license found.

    ``block`` counts the candidate blocks of the text from 0 (``reach`` and ``longest`` as in ``blocks``), ``start`` and
    ``n_chars`` tell the license's own place in the text; ``reduction`` is of the block, or of what was left of it. Null
    and empty texts and texts without such blocks give no row; repeated rows and repeated blocks give equal rows.
    Rows never leave their partition, so a line that a third of all documents share costs no shuffle;
    judgements of up to ``max_kept`` blocks are remembered by each task.
    """
    schema = (
        "id bigint, block bigint, start bigint, n_chars bigint, license string, status string, reduction double, n_agree bigint, n_template bigint, differences array<string>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Finding]] = {}
        for batch in slices(batches):
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = []
                for i, (start, block) in enumerate(blocks(text.as_py() or "", reach, longest)):
                    if block not in known:
                        if len(known) >= max_kept:
                            known.clear()
                        known[block] = judge(block)
                    own += [(name, start + a, start + b, i, *more) for name, *more, a, b in known[block]]
                rows += [(id_, i, a, b - a, name, status, round(reduction, 6), agree, size, diffs) for name, a, b, i, status, reduction, agree, size, diffs in _apart(own)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.int64()] * 2 + [pa.list_(pa.string())]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "block", "start", "n_chars", "license", "status", "reduction", "n_agree", "n_template", "differences"])

    return docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
