"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A text's units are its lines, its blocks between blank lines, the whole text, and windows of each template's number of words wherever
the template may stand, across lines and blocks (units with equal words count once). A unit is normalised (lower case, words of
letters and digits) and compared with templates by ``2 * |A n B| / (|A| + |B|)`` on their sets of bigrams. A Dice of t needs
``t / (2 - t) <= |A| / |B| <= (2 - t) / t``; with templates sorted by size these bounds leave a short range of candidates for each
unit, and most units none. It also needs t / (2 - t) of a template's bigrams, so a text without any of its rarest bigrams (those
beyond that share, and one more) holds no match: windows begin where such a bigram puts the template's first word.

The templates given here are statements, headers and short licences whole; ``read_templates`` reads longer ones from a folder.

Defined results: null or empty text and units of one word match nothing; ties keep the template that is first by name;
repeated rows are scanned one by one; an empty table gives no rows; other columns, whatever their names, are ignored. Texts of any
length are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ids_and_text, table

#: Public licence statements and texts, by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.""",
    "MIT": "Released under the MIT License.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-2-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MIT full text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution.""",
    "BSL-1.0 text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and
this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In
jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will
be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "GPL-3.0 full header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will
be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "LGPL-3.0 header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
    "0BSD text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
}
#: Least Dice coefficient in thousandths.
LEAST = 800
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def read_templates(folder: str) -> dict[str, str]:
    """Templates from the text files of a folder on the driver, by the files' names, beside those given here."""
    return TEMPLATES | {p.stem: p.read_text() for p in sorted(Path(folder).glob("*.txt"))}


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, least: int = LEAST):
        texts = {k: words(t) for k, t in (templates or TEMPLATES).items()}
        sets = [(frozenset(zip(w, w[1:], strict=False)), k) for k, w in texts.items()]
        self.least, self.by_size = least, sorted(sets, key=lambda x: (len(x[0]), x[1]))
        self.sizes = [len(s) for s, _ in self.by_size]
        #: by first word and second word of a rare bigram: (words of the template, words before the bigram)
        self.anchors: dict[str, dict[str, list[tuple[int, int]]]] = {}
        shared = Counter(b for s, _ in sets for b in s)
        for mine, name in sets:
            w, most = texts[name], len(mine) - -(-least * len(mine) // (2000 - least)) + 1
            rare = set(sorted(mine, key=lambda b: (shared[b], -len(b[0]) - len(b[1]), b))[:most])
            for i, b in enumerate(zip(w, w[1:], strict=False)):
                if b in rare:
                    self.anchors.setdefault(b[0], {}).setdefault(b[1], []).append((len(w), i))

    def candidates(self, n: int) -> range:
        """Places in by_size of the templates that a unit of n bigrams can reach."""
        t = self.least
        return range(bisect_left(self.sizes, -(-n * t // (2000 - t))), bisect_right(self.sizes, n * (2000 - t) // t))

    def unit(self, w: list[str]) -> tuple[str, int] | None:
        """(template, Dice in thousandths) of the best template of one unit."""
        if len(w) < 2:
            return None
        mine, best = set(zip(w, w[1:], strict=False)), None
        for k in self.candidates(len(mine)):
            b, name = self.by_size[k]
            dice = 2000 * len(mine & b) // (len(mine) + len(b))
            if dice >= self.least and (best is None or (-dice, name) < (-best[1], best[0])):
                best = name, dice
        return best

    def windows(self, w: list[str]) -> Iterator[list[str]]:
        """Where templates may stand in a text."""
        found, anchors = set(), self.anchors
        if anchors.keys().isdisjoint(w):
            return
        for i, x in enumerate(w[:-1]):
            if x in anchors:
                found.update((max(0, i - at), size) for size, at in anchors[x].get(w[i + 1], ()))
        for a, n in sorted(found):
            yield w[a : a + n]

    def text(self, text: str) -> list[tuple[str, int, int]]:
        """(template, Dice, units) of a text, by name."""
        found: dict[str, tuple[int, int]] = {}
        seen, blocks, lines, block = set(), [], [words(x) for x in text.split("\n")], []
        for w in [*lines, []]:
            if w:
                block.append(w)
            elif block:
                blocks.append(block)
                block = []
        units = [w for w in lines if w] + [list(chain.from_iterable(b)) for b in blocks if len(b) > 1]
        whole = list(chain.from_iterable(lines))
        if len(blocks) > 1:
            units.append(whole)
        units += self.windows(whole)
        for w in units:  # a window that repeats a line's words isn't counted again
            if (key := tuple(w)) not in seen:
                seen.add(key)
                if got := self.unit(w):
                    dice, n = found.get(got[0], (0, 0))
                    found[got[0]] = max(dice, got[1]), n + 1
        return [(k, d, n) for k, (d, n) in sorted(found.items())]


_FOUND = "doc_id long, n_licenses long, best_dice long, licenses string"


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: how many templates match, the best Dice in thousandths (0 for none), and name:dice:units of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            found = [scanner.text(t.as_py() or "") for t in batch.column("text")]
            cols = [[len(f) for f in found], [max((d for _, d, _ in f), default=0) for f in found], [",".join(f"{k}:{d}:{n}" for k, d, n in f) for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], [x.split()[0] for x in _FOUND.split(", ")])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, _FOUND)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
