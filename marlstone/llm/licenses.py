"""License scans: winnowed fingerprints in an inverted index pick candidates, banded alignment measures them.

Words are lower case, ASCII marks set them apart. Every run of K words has a hash; of every WINDOW neighbouring runs
the smallest is kept, in templates and in texts alike, so that any WINDOW + K - 1 equal words share a fingerprint. The
index (fingerprint -> template, place) is as large as the templates, which are few and part of the program.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import PLACES, mix, release, slices, text_array, word_blocks

K, WINDOW, BAND = 3, 3, 8
#: Fixed texts: notices as their licences word them (public), a name and a text each.
TEMPLATES: list[tuple[str, str]] = [
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT-line", "Released under the MIT License."),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "GPL-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or "
        "altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "MPL-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "LGPL-3.0-header",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "GPL-2.0-header",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("CC-BY-SA-4.0-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0-line", "This work is marked with CC0 1.0 Universal."),
]


def winnowed(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one run of words, and their places: the smallest run hash of each window (the last, if equal)."""
    n = len(hashes) - K + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = mix(sum(hashes[j : n + j] * PLACES[j] for j in range(K)))
    if n <= WINDOW:
        at = np.array([n - 1 - int(np.argmin(runs[::-1]))])
    else:
        views = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
        at = np.unique(np.arange(len(views)) + WINDOW - 1 - np.argmin(views[:, ::-1], axis=1))
    return runs[at], at


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        _, _, hashes, counts, _, _ = next(word_blocks(text_array(pa.array([t for _, t in templates]))))
        ends = np.cumsum(counts)
        self.words = [hashes[e - c : e] for e, c in zip(ends, counts, strict=True)]
        rows = sorted((int(h), k, int(p)) for k, w in enumerate(self.words) for h, p in zip(*winnowed(w), strict=True))
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.places = [(k, p) for _, k, p in rows]
        self.known = np.unique(self.hashes)

    def candidates(self, hashes: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(template, place of its first word in the text, as the fingerprint says) by neighbouring diagonals."""
        prints, at = winnowed(hashes)
        spot = np.minimum(np.searchsorted(self.known, prints), len(self.known) - 1)
        out: dict[int, set[int]] = {}
        for h, p in zip(prints[self.known[spot] == prints], at[self.known[spot] == prints].tolist(), strict=True):
            for j in range(int(np.searchsorted(self.hashes, h)), int(np.searchsorted(self.hashes, h, "right"))):
                k, q = self.places[j]
                out.setdefault(k, set()).add(p - q)
        merged: dict[tuple[int, int], list[int]] = {}
        for k, diagonals in out.items():
            head = None
            for d in sorted(diagonals):
                if head is None or d - merged[k, head][-1] > BAND:
                    head = d
                    merged[k, head] = []
                merged[k, head].append(d)
        return merged


def align(template: np.ndarray, words: np.ndarray, low: int, high: int, need: float) -> list[tuple[int, int, int]]:
    """(matched words, first, last matched word in the text + 1) of alignments within diagonals low..high, best first.

    Local alignment: +2 for equal words, -1 for a substitution or a gap; of equal scores the earliest. Of alignments
    with one first word the best counts; those that match fewer than ``need`` words or overlap a better one are left out.
    """
    m, n = len(template), len(words)
    width = high - low + 1
    none = (0, 0, -1, -1)  # score, matches, first, last
    row, best = [none] * (width + 2), {}
    for i in range(m):
        new = [none] * (width + 2)
        for c in range(1, width + 1):
            j = i + low + c - 1
            if not 0 <= j < n:
                continue
            s, k, first, last = row[c]
            if template[i] == words[j]:
                cell = (s + 2, k + 1, first if k else j, j)
            else:
                cell = (s - 1, k, first, last)
                for other in (row[c + 1], new[c - 1]):
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, *other[1:])
            new[c] = cell if cell[0] > 0 else none
            if cell[0] > best.get(cell[2], none)[0]:
                best[cell[2]] = cell
        row = new
    out: list[tuple[int, int, int]] = []
    for _, matched, first, last in sorted(best.values(), key=lambda x: -x[0]):
        if matched >= need and all(last < a or first >= b for _, a, b in out):
            out.append((matched, first, last + 1))
    return out


MATCHES = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan_licenses(df: DataFrame, text: str = "text", least: float = 0.8, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Adds ``licenses``: array<struct<license, coverage, start, end>> by start, in code points, end exclusive.

    coverage is the share of the template's words that the alignment matches; at least ``least``. Where two templates
    match overlapping spans, the one with more matched words stays (then the first named). Null and empty texts give an
    empty array; other columns pass; a column already named so is replaced. Whole texts are scanned. Repeated rows give
    repeated results, an empty table an empty one.
    """
    keep = [c for c in df.columns if c != "licenses"]
    df = df.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*df.schema.fields, T.StructField("licenses", MATCHES)])
    at = keep.index(text)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    chosen = TEMPLATES if templates is None else templates

    def run(batches):
        index = Index(chosen)
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts, out = text_array(batch.column(at)), []
            raw = texts.buffers()[2]
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else []
            for first, last, hashes, counts, starts, ends in word_blocks(texts):
                begin = 0
                for k, count in zip(range(first, last), counts.tolist(), strict=True):
                    words = hashes[begin : begin + count]
                    found = _matches(index, words, least)
                    if found:
                        here = np.frombuffer(raw, np.uint8)[offsets[k] : offsets[k + 1]]
                        points = np.concatenate(([0], np.cumsum((here & 0xC0) != 0x80)))
                        shift = offsets[k] - offsets[first]
                        found = [{"license": index.names[t], "coverage": m / len(index.words[t]), "start": int(points[starts[begin + a] - shift]), "end": int(points[ends[begin + b - 1] - shift])} for t, m, a, b in found]
                    out.append(found)
                    begin += count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*keep, "licenses"])
        release()

    return df.mapInArrow(run, schema)


def _matches(index: Index, words: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, last word + 1), by place, without overlaps."""
    found = []
    for (k, head), diagonals in index.candidates(words).items():
        low, high, size = head - BAND, diagonals[-1] + BAND, len(index.words[k])
        parts = [(max(0, low), min(len(words), high + size))]
        while parts:  # what lies before, between and after matches is aligned again until nothing reaches the coverage
            begin, end = parts.pop()
            if end - begin < max(1, least * size):
                continue
            made = align(index.words[k], words[begin:end], max(low - begin, 1 - size), min(high, end - 1) - begin, least * size)
            found += [(k, matched, a + begin, b + begin) for matched, a, b in made]
            if made:
                cuts = sorted((a + begin, b + begin) for _, a, b in made)
                parts += zip([begin, *(b for _, b in cuts)], [*(a for a, _ in cuts), end], strict=True)
    taken: list[tuple[int, int, int, int]] = []
    spots: list[tuple[int, int]] = []
    from bisect import bisect_left

    for x in sorted(found, key=lambda x: (-x[1], x[0], x[2])):
        i = bisect_left(spots, (x[2], x[3]))
        if (i == len(spots) or spots[i][0] >= x[3]) and (i == 0 or spots[i - 1][1] <= x[2]):
            spots.insert(i, (x[2], x[3]))
            taken.append(x)
    return sorted(taken, key=lambda x: x[2])
