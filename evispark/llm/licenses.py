"""License scans by conditional compression.

Candidate blocks are found by cue words: where a cue of a template occurs in the text,
the block is what would hold the template's wording around it, wherever in a line or
sentence that is. Each block is compressed with zstandard alone and with the template as
a raw dictionary, and a cue's templates are ranked by how much of the size the dictionary
saves. All that save enough are then confirmed by their exact wording:
the template is fitted into the block word by word with the fewest edits; it is confirmed
when few words differ and none of the differing words tells licenses apart (numbers,
license names and clauses).

Templates are a table (license, text) of bounded size, a parameter. Each task caches the
verdicts of blocks it has seen, up to a bound, as the same notice recurs in many texts.
Time is linear in the text's length.

Defined cases: null and empty texts hold no license; of overlapping confirmed passages
the one with the most equal words less differing ones stays, then the first, then that of
the first name; equal ranks go in the order of names; repeated rows give equal rows; an
empty table gives an empty result; other columns are ignored, and a kept column named
``licenses`` gives way to the result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm.common import map_text, read_table

# Wording of public license notices.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_DISCLAIMER = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies."
)
_ISC_DISCLAIMER = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(name: str, version: str, later: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) {later}. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        f"WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


TEMPLATES = {
    "AGPL-3.0-notice": _gnu("GNU Affero General Public License", "3", "any later version"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": _BSD,
    "BSD-2-Clause-text": _BSD + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD + _BSD_THIRD,
    "BSD-3-Clause-text": _BSD + _BSD_THIRD + _BSD_DISCLAIMER,
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
        "part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by "
        "a source language processor."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": _gnu("GNU General Public License", "2", "any later version"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": _gnu("GNU General Public License", "3", "any later version"),
    "ISC": _ISC,
    "ISC-text": _ISC + _ISC_DISCLAIMER,
    "LGPL-2.1-notice": _gnu("GNU Lesser General Public License", "2.1", "any later version"),
    "LGPL-3.0-notice": _gnu("GNU Lesser General Public License", "3", "any later version"),
    "MIT": "Released under the MIT License.",
    "MIT-notice": _MIT,
    "MIT-text": _MIT + _MIT_DISCLAIMER,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution."
    ),
}
TEMPLATES |= {f"{name}-spdx": f"SPDX-License-Identifier: {name}" for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "ISC", "MPL-2.0")}

CUE = re.compile(  # zero-width, so that cues may overlap
    r"\b(?=(licen[sc]ed?\b|permission\s+(?:is|to)\b|redistribut\w+|(?:free\s+|unencumbered\s+)software|public\s+license\b|source\s+code\s+form|mit\s+license\b|spdx))",
    re.I,
)
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
TELLING = frozenset(
    "affero agpl apache bsd by cc commercial general gnu gpl isc lesser lgpl library mit mozilla mpl nc nd non not only public sa unlicense version".split()
)
CACHE = 50_000
CUES = 3  # of a template at most; the first ones


def _words(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words with their places; numbers of list items are no words."""
    out: list[tuple[str, int, int]] = []
    for m in WORD.finditer(text):
        numbered = len(m[0]) == 1 and m[0].isdigit() and text[m.end() : m.end() + 2] in (". ", ") ", ".\n") and not (out and out[-1][0] in ("version", "v"))
        if not numbered:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def _cue(found: re.Match) -> str:
    return " ".join(found[1].lower().replace("licence", "license").split())


def fit_words(want: list[str], have: list[str]) -> tuple[int, int, int, list[str]]:
    """The fewest word edits that turn ``want`` into some passage of ``have``, where that begins and ends, and the words that differ."""
    place = np.arange(len(have) + 1)
    code: dict[str, int] = {}
    own = [code.setdefault(w, len(code)) for w in want]
    other = np.array([code.setdefault(w, len(code)) for w in have], dtype=np.int64)
    table = np.zeros((len(want) + 1, len(have) + 1), dtype=np.int32)
    for i, w in enumerate(own, start=1):
        best = np.minimum(table[i - 1, 1:] + 1, table[i - 1, :-1] + (other != w))
        best = np.concatenate([[i], best])
        table[i] = np.minimum.accumulate(best - place) + place
    end = j = int(table[-1].argmin())
    i, differ = len(want), []
    while i:
        if j and table[i, j] == table[i - 1, j - 1] + (want[i - 1] != have[j - 1]):
            if want[i - 1] != have[j - 1]:
                differ += [want[i - 1], have[j - 1]]
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + 1:
            differ.append(want[i - 1])
            i -= 1
        else:
            differ.append(have[j - 1])
            j -= 1
    return int(table[-1, end]), j, end, differ


class LicenseScanner:
    def __init__(self, templates: dict[str, str], least_saved: float = 0.25, differing: float = 0.1):
        self.names = sorted(templates)
        self.words = {n: [w for w, _, _ in _words(templates[n])] for n in self.names}
        self.least_saved, self.differing = least_saved, differing
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.given = {
            n: zstandard.ZstdCompressor(
                level=3,
                dict_data=zstandard.ZstdCompressionDict(_flat(self.words[n]).ljust(8), dict_type=raw),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            for n in self.names
        }
        self.alone = {n: len(self.plain.compress(_flat(self.words[n]))) for n in self.names}
        # By cue: templates that hold it, with what lies before and after it in the block.
        self.around: dict[str, list[tuple[str, int, int]]] = {}
        for n in self.names:
            for m in list(CUE.finditer(templates[n]))[:CUES]:
                before = m.start() * 6 // 5 + (16 if m.start() else 0)
                self.around.setdefault(_cue(m), []).append((n, before, (len(templates[n]) - m.start()) * 5 // 4 + 24))
        self.seen: dict[tuple[str, str], tuple | None] = {}

    def saved(self, name: str, words: list[str]) -> float:
        """What the template saves as a dictionary, as a share of its own compressed size or the block's, whichever is less."""
        part = _flat(words)
        alone = len(self.plain.compress(part))
        return (alone - len(self.given[name].compress(part))) / min(alone, self.alone[name])

    def compare(self, name: str, have: list[tuple[str, int, int]]) -> tuple[int, int, int] | None:
        """(differing words, start, end) of the template's wording in the block's words, or None."""
        want = self.words[name]
        differ, first, last, words = fit_words(want, [w for w, _, _ in have])
        if last <= first or differ > self.differing * len(want):
            return None
        telling = TELLING if "cc" in want else TELLING - {"by"}
        return None if any(w in telling or w[0].isdigit() for w in words) else (differ, have[first][1], have[last - 1][2])

    def _block(self, name: str, block: str) -> tuple[float, str, tuple | None]:
        """What the template saves on the block, and its confirmed wording."""
        key = (name, block)
        if key not in self.seen:
            if len(self.seen) >= CACHE:
                self.seen = {}
            have = _words(block)
            saved = self.saved(name, [w for w, _, _ in have]) if have else 0.0
            self.seen[key] = (saved, name, self.compare(name, have) if saved >= self.least_saved else None)
        return self.seen[key]

    def scan(self, text: str | None) -> list[dict]:
        found = set()
        for m in CUE.finditer(text or ""):
            blocks = {}
            for name, before, after in self.around.get(_cue(m), ()):
                start = max(0, m.start() - before)
                blocks[name, start] = self._block(name, text[start : m.start() + after])
            ranked = sorted(((saved, name, start, match) for (name, start), (saved, _, match) in blocks.items() if match), key=lambda x: (-x[0], x[1], x[2]))
            for saved, name, start, (differ, a, b) in ranked:
                found.add((2 * differ - len(self.words[name]), start + a, name, start + b, differ, saved))
        kept: list[tuple] = []
        for _, start, name, end, differ, saved in sorted(found):
            at = bisect_left(kept, (start,))
            if (not at or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
                insort(kept, (start, end, name, differ, saved))
        return [{"license": n, "start": s, "end": e, "differing": d, "saved": float(v)} for s, e, n, d, v in kept]


def _flat(words: list[str]) -> bytes:
    return " ".join(words).encode("utf-8", "surrogatepass")


LICENSES = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("differing", T.IntegerType()),
            T.StructField("saved", T.DoubleType()),
        ]
    )
)


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, keep: list[str] | None = None, text_col: str = "text", **options) -> DataFrame:
    """The kept columns and ``licenses``: an array of (license, start, end, differing, saved), empty where there is none."""
    templates = TEMPLATES if templates is None else templates

    def make():
        scanner = LicenseScanner(templates, **options)
        return lambda texts: {"licenses": [scanner.scan(t) for t in texts]}

    return map_text(docs, make, [T.StructField("licenses", LICENSES)], keep, text_col)


def op4_license_scan(spark, sf_dir) -> DataFrame:
    """Every confirmed license passage of every document."""
    found = find_licenses(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("licenses").alias("x")).select("doc_id", "x.*")
