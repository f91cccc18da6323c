"""Licence scans: word windows of a text against licence templates by the Dice coefficient over word bigrams.

Words are runs of letters, digits and non-ASCII characters, A-Z like a-z; so line breaks and comment signs are in no word,
and a notice is the same wrapped, in a comment block or inside a paragraph. The segments of a text are windows of
consecutive words; a window's bigrams and a template's are multisets, and their Dice coefficient is twice the common bigrams
by all. At a threshold t only windows with between t / (2 - t) and (2 - t) / t times a template's bigrams can reach it, and
the common ones must be t / (2 - t) of the template's at least; these bounds are exact. They are checked first for whole
batches, on arrays of hashed bigrams: a text is compared word by word with a template only if so many of the template's
bigrams stand within the longest window. A window that loses no common bigram without its first or last word is worse than
the shorter one, so only windows that lose one on either side are compared.

Of the windows at or above the threshold the best is taken, then the next best that has less than half of its words in
windows taken before, and so on: a notice is one match, and what else a text says is found beside it. Equal ones go by
length, the longer first, then by place. A window takes its best template; of equal ones the first by name.

Templates are one-line notices, opening paragraphs and whole licence texts of several paragraphs, so a licence file is one
match from its first paragraph to its last.

A text is scanned whole where it lies; the templates are a fixed list, so nothing is shuffled or gathered.

Defined cases: null, empty and wordless texts have no matches; an empty table gives no rows; one word has no bigram and matches nothing; repeated
notices are separate matches; in a very long text as many windows are held as it has bigrams of templates; columns with the name of the result column are replaced; thresholds are above 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import chunks, gram_hashes, joined, prepare, reserved, text_bytes, word_bounds, word_hashes

THRESHOLD = 0.8
#: Fixed values: (licence, text) of notices and opening paragraphs.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Fixed values: (licence, paragraphs) of whole licence texts.
WHOLE_TEXTS = [
    (
        "BSD-2-Clause",
        [
            'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
            'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        ],
    ),
    (
        "BSD-3-Clause",
        [
            'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
            '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
            'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        ],
    ),
    (
        "BSL-1.0",
        [
            'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
            'The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        ],
    ),
    (
        "ISC",
        [
            'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
            'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        ],
    ),
    (
        "MIT",
        [
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
            'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        ],
    ),
    (
        "Unlicense",
        [
            'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
            'In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        ],
    ),
    (
        "Zlib",
        [
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
            'Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:',
            '1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.',
        ],
    ),
]
TEMPLATES += [(name, "\n\n".join(text)) for name, text in WHOLE_TEXTS]
RESULT = "licenses"

_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes that are in no word.
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def bigrams(text: str) -> Counter:
    words = _WORD.findall(text.translate(_LOWER))
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    n = a.total() + b.total()
    return 2 * (a & b).total() / n if n else 0.0


def segments(text: str) -> list[tuple[int, int]]:
    """Character spans of the word windows that match one of the fixed templates, by start."""
    return [m[2:] for m in _fixed().matches(text)]


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and hashes."""
    starts, ends = word_bounds(data, _APART)
    return starts, word_hashes(data, starts, ends)


class Templates:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("a threshold is above 0 and at most 1")
        self.names = [n for n, _ in templates]
        self.grams = [bigrams(t) for _, t in templates]
        self.sizes = [g.total() for g in self.grams]
        self.threshold = threshold
        share = threshold / (2 - threshold)
        #: The fewest common bigrams of a match with each template, and the most bigrams of its window.
        self.least = [max(1, math.ceil(share * n - 1e-9)) for n in self.sizes]
        self.most = [math.floor(n / share + 1e-9) for n in self.sizes]
        self.having: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, grams in enumerate(self.grams):
            for g in grams:
                self.having[g].append(k)
        own = [np.unique(gram_hashes(_hashed(joined([t.encode()])[0])[1], 2)) for _, t in templates]
        self.known = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        #: template x known bigram
        self.has = np.array([np.isin(self.known, o) for o in own]) if own else np.zeros((0, 0), bool)

    def candidates(self, texts: list[bytes | None]) -> np.ndarray:
        """For each text the templates of which it has bigrams enough within the longest window."""
        out = np.zeros((len(texts), len(self.names)), bool)
        data, places = joined(texts)
        starts, words = _hashed(data)
        grams = gram_hashes(words, 2)
        if not len(grams) or not len(self.known):
            return out
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        hit = np.flatnonzero(self.known[at] == grams)
        at = at[hit]
        text = np.searchsorted(np.searchsorted(starts, places), hit, "right") - 1
        for k, least in enumerate(self.least):
            own = np.flatnonzero(self.has[k][at])
            if self.sizes[k] and len(own) >= least:
                a, b = own[: len(own) - least + 1], own[least - 1 :]
                out[text[a[(hit[b] - hit[a] < self.most[k]) & (text[a] == text[b])]], k] = True
        return out

    def _starts(self, grams: list[tuple[str, str]], candidates: list[int] | None) -> dict[int, tuple[np.ndarray, ...]]:
        """For each template that may match: where its bigrams stand, their numbers, the place from which on each is counted in
        common (its own number of equal bigrams before it), and the next equal bigram."""
        places: dict[int, list[int]] = defaultdict(list)
        for i, g in enumerate(grams):
            for k in self.having.get(g, ()):
                places[k].append(i)
        out = {}
        for k in places if candidates is None else candidates:
            at, own = places[k], self.grams[k]
            since, after = np.full(len(at), -1), np.full(len(at), len(at))
            before: dict[tuple[str, str], list[int]] = defaultdict(list)
            for j, i in enumerate(at):
                seen = before[grams[i]]
                if seen:
                    after[seen[-1]] = j
                if len(seen) >= own[grams[i]]:
                    since[j] = seen[-own[grams[i]]]
                seen.append(j)
            out[k] = (np.array(at, np.int64), since, after)
        return out

    def _best(self, k: int, told: tuple[np.ndarray, ...], i: int, below: tuple[float, int] | None, taken: np.ndarray) -> tuple[float, int] | None:
        """(-dice, -bigrams) of the best window of template k from its i-th bigram on that comes after ``below`` and of which
        less than half is taken. A window matches and loses common bigrams at both ends if cut."""
        at, since, after = told
        least, most, size = self.least[k], self.most[k], self.sizes[k]
        if i + least > len(at) or at[i + least - 1] - at[i] >= most:
            return None
        stop = int(np.searchsorted(at, at[i] + most))
        counted = since[i:stop] < i
        j = int(after[i])
        while j < stop and counted[j - i]:  # one that isn't counted stands in for the first
            j = int(after[j])
        stop = min(stop, j)
        counted = counted[: stop - i]
        n = at[i:stop] - at[i] + 1
        dice = 2 * np.cumsum(counted) / (n + size)
        good = counted & (dice >= self.threshold)
        if below is not None:
            good &= (-dice > below[0]) | ((-dice == below[0]) & (-n > below[1]))
        if good.any():
            words = n + 1
            part = taken[at[i] : at[i] + most + 2]
            if part.any():
                good &= 2 * np.cumsum(part)[words - 1] < words
            if good.any():
                top = dice[good].max()
                return -float(top), -int(n[good & (dice == top)].max())
        return None

    def matches(self, text: str, candidates: list[int] | None = None) -> list[tuple[str, float, int, int]]:
        """(licence, dice, start, end) of the best windows, by start; all templates are candidates by default.

        The best window of all is taken first, then the best of which less than half is taken, and so on. Only the best one
        that is still open is held for each first bigram; the next is looked for when that one falls to others.
        """
        lower = text.translate(_LOWER)
        words = [(m.start(), m.end()) for m in _WORD.finditer(lower)]
        texts = [lower[a:b] for a, b in words]
        told = self._starts(list(zip(texts, texts[1:])), candidates)
        taken = np.zeros(len(words), np.int8)
        waiting = []
        for k, own in told.items():
            for i in range(len(own[0]) - self.least[k] + 1):
                if (best := self._best(k, own, i, None, taken)) is not None:
                    waiting.append((*best, int(own[0][i]), self.names[k], k, i))
        heapify(waiting)
        out = []
        while waiting:
            d, n, first, name, k, i = waiting[0]
            end = first - n + 1
            if 2 * int(taken[first:end].sum()) < end - first:
                taken[first:end] = 1
                out.append((name, -d, words[first][0], words[end - 1][1]))
            if (best := self._best(k, told[k], i, (d, n), taken)) is None:
                heappop(waiting)
            else:
                heapreplace(waiting, (*best, first, name, k, i))
        return sorted(out, key=lambda m: m[2:])


@cache
def _fixed() -> Templates:
    return Templates(TEMPLATES, THRESHOLD)


_MATCH = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
_SQL = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _scan(templates: list[tuple[str, str]], threshold: float, text: str, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            texts = text_bytes(batch.column(text))
            found: list[list[dict]] = []
            for a, b in chunks(texts):
                may = known.candidates(texts[a:b])
                for t, row in zip(texts[a:b], may, strict=True):
                    own = known.matches(t.decode("utf-8", "replace"), np.flatnonzero(row).tolist()) if t and row.any() else []
                    found.append([dict(zip(("license", "dice", "start", "end"), m, strict=True)) for m in own])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(found, pa.list_(_MATCH))], names=[*carry, RESULT])

    return run


def scan_licenses(docs: DataFrame, *, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) with licenses: matched segments as (license, dice, start, end) in code points."""
    prepare(docs.sparkSession)
    docs = reserved(docs, RESULT)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != RESULT]
    source = docs.select(*dict.fromkeys([*carry, text]))
    return source.mapInArrow(_scan(templates, threshold, text, carry), T.StructType([source.schema[c] for c in carry] + [T.StructField(RESULT, _SQL)]))


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (distinct names, sorted), best_license and best_dice of each document."""
    found = scan_licenses(docs, carry=["doc_id"])
    best = F.array_max(F.transform(RESULT, lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license"))))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(RESULT, lambda m: m["license"]))), ",")
    return found.select("doc_id", F.size(RESULT).cast("long").alias("n_matches"), names.alias("licenses"), best["license"].alias("best_license"), best["dice"].alias("best_dice"))
