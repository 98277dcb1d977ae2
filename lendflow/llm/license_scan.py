"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

Words are runs of letters and digits, case folded; a shingle is a run of ``WIDTH`` words.  A template of m
shingles is looked up in windows of 2M shingles that start every M, M being the power of two from m up:
wherever the template stands, one window holds it whole.  A window's signature is the smallest value of
each of a number of hash functions, each a band of its own.  The number is taken so that a window with
``SHARE`` of a template's shingles shares no band with it with probability ``MISS`` at most; as templates
hardly share shingles with other text, single values are already selective.

Retrieved pairs are verified: a document matches a template if some stretch of M of its shingles holds
``SHARE`` of the template's distinct shingles.  The scan is one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendflow.llm.common import mix64, shingle_hashes, text_slices, word_hashes, word_spans

WIDTH = 5
SHARE = 0.8
MISS = 1e-6
PASS_TEMPLATES = 2000                # templates looked up in one pass; more take several passes

_LETTERS = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _LETTERS[_a:_b] = True

# Notices of public licenses, as their own texts give them.
NOTICES = (
    ("MIT statement", "Released under the MIT License."),
    ("Apache-2.0 statement", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0 statement", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0 statement", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 statement", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0 statement",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT permission",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("Apache-2.0 header",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
     "KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("GPL-3.0 header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("GPL-2.0 header",
     "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
     "option) any later version."),
    ("MPL-2.0 header",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD conditions",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met:"),
    ("ISC permission",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass
class Template:
    key: str
    shingles: np.ndarray             # distinct, sorted

    @property
    def block(self) -> int:
        """Half a window, and the distance between windows."""
        return 1 << max(0, len(self.shingles) - 1).bit_length()


def shingles_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(raw, offsets, _LETTERS)
    return shingle_hashes(word_hashes(raw, starts, ends, lower=True), first, WIDTH)


def window_shingles(block: int) -> int:
    return 2 * block if block > 1 else 1


def needed(size: int) -> int:
    """Shingles of a template of ``size`` that a match must hold."""
    return math.ceil(round(SHARE * size, 9))


def bands(block: int) -> int:
    """Hash functions that keep the chance of missing a match of any template of this block within MISS."""
    sizes = range(block // 2 + 1, block + 1)
    least = min(needed(m) / (window_shingles(block) + m - needed(m)) for m in sizes)
    return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))


def factors(count: int) -> np.ndarray:
    """Multipliers of the hash functions."""
    return mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


class Retriever:
    """Signatures of the templates, by block size."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = [t for t in templates if len(t.shingles)]
        self.by_block: dict[int, list[int]] = {}
        for i, t in enumerate(self.templates):
            self.by_block.setdefault(t.block, []).append(i)
        most = max((bands(b) for b in self.by_block), default=0)
        self.factors = factors(most)
        # Per hash function and block: sorted smallest values and their templates, and a coarse bitmap.
        self.values: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for block, members in self.by_block.items():
            for k in range(bands(block)):
                low = np.array([self._hash(self.templates[i].shingles, k).min() for i in members], dtype=np.uint32)
                order = np.argsort(low, kind="stable")
                coarse = np.zeros(1 << 16, dtype=bool)
                coarse[low >> np.uint32(16)] = True
                self.values[block, k] = low[order], np.array(members)[order], coarse

    def _hash(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h * self.factors[k]) >> np.uint64(32)).astype(np.uint32)

    def candidates(self, h: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(row, template) pairs of which a window over the row shares a band with the template."""
        found: set[tuple[int, int]] = set()
        n, largest = len(h), max(self.by_block, default=0)
        if not n:
            return found
        for k in range(len(self.factors)):
            low, block = self._hash(h, k), 1
            while block <= largest:
                if (block, k) in self.values:
                    whole = low if block == 1 else np.minimum(low, np.append(low[1:], np.uint32(0xFFFFFFFF)))
                    values, members, coarse = self.values[block, k]
                    for w in np.flatnonzero(coarse[whole >> np.uint32(16)]).tolist():
                        a, b = np.searchsorted(values, whole[w], side="left"), np.searchsorted(values, whole[w], side="right")
                        if a < b:
                            begin, stop = w * block, min(n, w * block + window_shingles(block))
                            rows = range(int(np.searchsorted(first, begin, side="right")) - 1,
                                         int(np.searchsorted(first, stop - 1, side="right")))
                            found.update((r, int(t)) for r in rows for t in members[a:b])
                # Minima of blocks twice as long.
                if len(low) % 2:
                    low = np.append(low, np.uint32(0xFFFFFFFF))
                low, block = np.minimum(low[::2], low[1::2]), block * 2
        return found


def best_stretch(h: np.ndarray, template: np.ndarray, reach: int) -> tuple[int, int, int]:
    """(distinct template shingles, first, last place) of the stretch of at most ``reach`` shingles that
    holds most of them; the earliest of equals."""
    at = np.flatnonzero(np.isin(h, template))
    which = np.searchsorted(template, h[at])
    best = (0, 0, 0)
    inside: dict[int, int] = {}
    lo = 0
    for hi in range(len(at)):
        inside[int(which[hi])] = inside.get(int(which[hi]), 0) + 1
        while at[hi] - at[lo] >= reach:
            left = int(which[lo])
            inside[left] -= 1
            if not inside[left]:
                del inside[left]
            lo += 1
        if len(inside) > best[0]:
            best = (len(inside), int(at[lo]), int(at[hi]))
    return best


def templates_of(notices: Sequence[tuple[str, str]]) -> list[Template]:
    out = []
    for key, body in notices:
        raw = np.frombuffer(body.encode(), dtype=np.uint8)
        h, _ = shingles_of(raw, np.array([0, len(raw)]))
        out.append(Template(key, np.unique(h)))
    return out


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = NOTICES, text: str = "text",
         doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, template, template_shingles, matched, containment, start_word, end_word): one row per
    document and template that match, with the stretch of words that holds most of the template.

    Templates with fewer than ``WIDTH`` words are one shingle, their whole sequence, and match documents
    that consist of it.  Null and empty texts match nothing; a null doc_id gives rows with a null id; rows that
    repeat an id give their own rows; other columns are ignored; an empty table gives an empty result.
    """
    schema = ("doc_id long, template string, template_shingles long, matched long, containment double, "
              "start_word long, end_word long")
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    chosen = docs.select(F.col(doc_id).cast("long"), F.col(text).alias("body"))

    def one_pass(part: Sequence[tuple[str, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            retriever = Retriever(templates_of(part))
            for batch in batches:
                rows: list[tuple] = []
                for lo, _, raw, offsets in text_slices(batch, "body"):
                    h, first = shingles_of(raw, offsets)
                    for r, t in sorted(retriever.candidates(h, first)):
                        template = retriever.templates[t]
                        size = len(template.shingles)
                        n, a, b = best_stretch(h[first[r]:first[r + 1]], template.shingles, template.block)
                        if n >= needed(size):
                            rows.append((batch.column(0)[lo + r].as_py(), template.key, size, n, n / size, a,
                                         b + WIDTH))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)],
                                                 names=names)
        return chosen.mapInArrow(run, schema)

    parts = [notices[i:i + PASS_TEMPLATES] for i in range(0, len(notices), PASS_TEMPLATES)] or [()]
    out = one_pass(parts[0])
    for part in parts[1:]:
        out = out.unionByName(one_pass(part))
    return out
