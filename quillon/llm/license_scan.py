"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates become words (letters and digits, A-Z lower-cased) and shingles of five words. Each template is cut
into windows of a power of two of shingles that overlap by half, and each text into windows of those sizes at a quarter's
stride, so that some text window is off a template window by an eighth at most. One-row bands of 16 coordinates find a
pair of windows of similarity 0.55 (a template with a fifth of its shingles lost) with a chance of 0.999997, and cost no
false candidates, for an equal coordinate means a common shingle. What is found is confirmed on the text itself,
and of notices that claim the same words the fullest is reported.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, hash_texts, kind_of, mix32, mix64, only

WIDTH, BANDS, PERCENT = 5, 16, 80
_NONE = np.uint32(0xFFFFFFFF)
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Notices of public licenses, by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause OR BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("MIT", "licensed under the MIT License"),
    ("MIT", "distributed under the MIT License"),
    ("ISC", "licensed under the ISC License"),
    ("BSD-2-Clause", "licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "licensed under the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0"),
    ("CC-BY-ND-4.0", "licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "licensed under CC BY-NC-ND 4.0"),
]


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the five words from each word on (0 where fewer are left in the text), and each text's word offsets."""
    h, off = hash_texts(texts, _TABLE)
    n = max(0, len(h) - WIDTH + 1)
    g = h[:n]
    for j in range(1, WIDTH):
        g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j])
    g = np.concatenate([g | np.uint64(1), np.zeros(len(h) - n, np.uint64)])
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(h))
    g[left < WIDTH] = 0
    return g, off


@dataclass
class Index:
    """Templates as shingle sets, and for each window size the coordinates of their windows."""

    names: list[str]
    sets: list[dict[int, int]]
    lengths: list[int]
    keys: dict[int, tuple[np.ndarray, np.ndarray]]  # size -> sorted (band << 32 | coordinate), template of each
    bits: dict[int, np.ndarray]

    @classmethod
    def build(cls, templates: list[tuple[str, str]]) -> Index:
        names, sets, lengths = [], [], []
        found: dict[int, list[tuple[int, int]]] = {}
        for name, text in templates:
            g, _ = shingles([text])
            g = g[g > 0]
            if not len(g):
                continue
            size = 1 << (len(g).bit_length() - 1)
            for start in {*range(0, len(g) - size + 1, max(1, size // 2)), len(g) - size}:
                for band in range(BANDS):
                    found.setdefault(size, []).append((band << 32 | int(_places(g[start : start + size], band).min()), len(names)))
            names.append(name)
            sets.append({int(v): i for i, v in enumerate(np.unique(g))})
            lengths.append(len(g))
        keys, bits = {}, {}
        for size, pairs in found.items():
            pairs = sorted(set(pairs))
            keys[size] = (np.array([k for k, _ in pairs], np.uint64), np.array([t for _, t in pairs], np.int64))
            bits[size] = np.zeros(1 << 16, bool)
            bits[size][(keys[size][0] & np.uint64(0xFFFF)).astype(np.int64)] = True
        return cls(names, sets, lengths, keys, bits)


def _places(g: np.ndarray, band: int) -> np.ndarray:
    """Each shingle's place under the band's permutation; the last place where there is no shingle."""
    return np.where(g == 0, _NONE, mix32((g >> np.uint64(32)).astype(np.uint32) ^ np.uint32((band + 1) * 0x9E3779B1 & 0xFFFFFFFF)))


def candidates(index: Index, g: np.ndarray) -> np.ndarray:
    """Rows (template, word position, window size) of windows that share a band coordinate with a template window."""
    out = []
    top = max(index.keys, default=0)
    for band in range(BANDS):
        m, size = _places(g, band), 1
        while size <= top and len(m):
            if size in index.keys:
                stride = max(1, size // 4)
                at = m[::stride]
                hit = np.flatnonzero(index.bits[size][at & np.uint32(0xFFFF)] & (at != _NONE))
                if len(hit):
                    key = at[hit].astype(np.uint64) | np.uint64(band << 32)
                    keys, owners = index.keys[size]
                    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    for i in np.flatnonzero(hi > lo):
                        out += [(int(owners[j]), int(hit[i]) * stride, size) for j in range(lo[i], hi[i])]
            m = np.minimum(m[:-size], m[size:]) if len(m) > size else np.minimum.accumulate(m[::-1])[:0]
            size *= 2
    return np.array(sorted(set(out)), np.int64).reshape(-1, 3)


def best_run(wanted: dict[int, int], length: int, g: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Disjoint runs (first, last word shingle, distinct shingles) in g[lo:hi], of at most 5/4 of the template's length, that hold enough of it.

    Left to right: of the runs that overlap the first that holds enough, the fullest, then shortest, then first.
    """
    need, span = -(-PERCENT * len(wanted) // 100), length + length // 4
    hits = [(i, wanted[v]) for i, v in enumerate(g[lo:hi].tolist(), lo) if v in wanted]
    runs, count, a = [], {}, 0
    for b, (at, which) in enumerate(hits):
        count[which] = count.get(which, 0) + 1
        while hits[a][0] <= at - span or count[hits[a][1]] > 1 and a < b:
            k = hits[a][1]
            count[k] -= 1
            if not count[k]:
                del count[k]
            a += 1
        if len(count) >= need:
            runs.append((hits[a][0], at, len(count)))
    out: list[tuple[int, int, int]] = []
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] <= runs[i][1]:
            j += 1
        best = max(runs[i : j + 1], key=lambda r: (r[2], r[0] - r[1], -r[0]))
        out.append(best)
        i = j + 1
        while i < len(runs) and runs[i][0] <= best[1]:
            i += 1
    return out


def _confirmed(index: Index, g: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For each text (template, first, last word shingle, distinct shingles) of every template's confirmed runs."""
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(off) - 1)]
    regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
    rows = candidates(index, g)
    owners = np.searchsorted(off, rows[:, 1], "right") - 1
    for (t, at, size), doc in zip(rows.tolist(), owners.tolist(), strict=True):
        # A window may begin in the text before; both are looked at, each within its own words.
        for d in {doc, min(len(off) - 2, int(np.searchsorted(off, at + size - 1, "right")) - 1)}:
            reach = 2 * index.lengths[t]
            regions.setdefault((d, t), []).append((max(int(off[d]), at - reach), min(int(off[d + 1]), at + size + reach)))
    for (d, t), parts in regions.items():
        lo, hi = None, None
        joined = []
        for a, b in sorted(parts):
            if hi is not None and a <= hi:
                hi = max(hi, b)
            else:
                if hi is not None:
                    joined.append((lo, hi))
                lo, hi = a, b
        joined.append((lo, hi))
        for a, b in joined:
            for first, last, n in best_run(index.sets[t], index.lengths[t], g, a, b):
                found[d].append((t, first, last, n))
    return found


def _notices(index: Index, runs: list[tuple[int, int, int, int]], start: int) -> list[tuple[str, int, int, int]]:
    found = {(index.names[t], first - start, last + WIDTH - start, 100 * n // len(index.sets[t])) for t, first, last, n in runs}
    return sorted(found, key=lambda m: (m[1], m[2], m[0]))


def find(index: Index, texts: list[str | None]) -> list[list[tuple[str, int, int, int]]]:
    """For each text (license, first word, end word, percent of the template's shingles) of confirmed notices, rivals too, in order."""
    g, off = shingles(texts)
    return [_notices(index, runs, int(off[d])) for d, runs in enumerate(_confirmed(index, g, off))]


def tell(index: Index, texts: list[str | None]) -> list[list[tuple[str, int, int, int]]]:
    """find() with one notice of each set of rivals, which are runs that claim a shingle of the text in common.

    The run of most shingles wins, so that a whole text beats its preamble; of equals that of greatest containment, then
    the first.
    """
    g, off = shingles(texts)
    out = []
    for d, runs in enumerate(_confirmed(index, g, off)):
        won: list[tuple[int, int, int, int]] = []
        claimed: set[int] = set()
        for t, first, last, n in sorted(set(runs), key=lambda r: (-r[3], len(index.sets[r[0]]), r[1], r[2], r[0])):
            mine = {i for i, v in enumerate(g[first : last + 1].tolist(), first) if v in index.sets[t]}
            if not mine & claimed:
                claimed |= mine
                won.append((t, first, last, n))
        out.append(_notices(index, won, int(off[d])))
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_notices, licenses (distinct names, sorted, comma-joined), notices (name:first:end:percent).

    Words are counted from 0, ends are exclusive. Null, empty and wordless texts have no notices. Repeated rows give a row
    each; empty tables give none; other columns are not looked at. Templates of fewer than five words are never found.
    """
    index = Index.build(TEMPLATES if templates is None else templates)

    def run(parts):
        for part in parts:
            texts = part.column(1).to_pylist()
            n, names, notices = [], [], []
            for a, b in batches(texts):
                for found in tell(index, texts[a:b]):
                    n.append(len(found))
                    names.append(",".join(sorted({f[0] for f in found})))
                    notices.append(",".join(f"{x}:{i}:{j}:{p}" for x, i, j, p in found))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(notices, pa.string())], ["id", "n_notices", "licenses", "notices"])

    kind = kind_of(docs, id_col)
    return only(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_notices long, licenses string, notices string").select(F.col("id").alias(id_col), "n_notices", "licenses", "notices")
