"""License scans by patience alignment (operator 6).

A license text is found where it aligns with a stretch of a document: words that occur once in
both are anchors, the longest increasing subsequence of their places is kept, and the gaps
between anchors are aligned in the same way. The share of the template's words that are matched
is its coverage. Words are runs of ASCII letters and digits, without regard to case.

A stretch can reach a coverage only if it holds that many words of the template. Running counts
of such words over windows of bounded length find all stretches that can, and only those are
aligned. Documents are independent, so there is no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skumetry.llm import textbytes

#: Share of a template's words that must be matched.
MIN_COVERAGE = 0.8
#: A match may be longer than its template by this share.
STRETCH = 0.25

# Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
}
# End of fixed values.

_PARTS = np.zeros(256, bool)
for _range in (b"09", b"az", b"AZ"):
    _PARTS[_range[0]: _range[1] + 1] = True


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and begin and end (code points within the text) and texts' first words."""
    data, offsets = textbytes.flatten(column, lower=True)
    starts, ends, firsts = textbytes.words(data, offsets, _PARTS)
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    base = np.repeat(points[offsets[:-1]], np.diff(firsts))
    return textbytes.range_hashes(data, starts, ends), points[starts] - base, points[ends] - base, firsts, offsets


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops, piles, before = [], [], []
    for i, value in enumerate(values):
        at = bisect_left(tops, value)
        before.append(piles[at - 1] if at else -1)
        tops[at: at + 1], piles[at: at + 1] = [value], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places in two word sequences, in order, by patience alignment."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if a[i] in place]
        anchors = [anchors[i] for i in increasing([j for _, j in anchors])]
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


def template_words(templates: dict[str, str]) -> dict[str, np.ndarray]:
    return {name: hashed_words(pa.array([text]))[0] for name, text in templates.items()}


def _best(target: list[int], words: np.ndarray, windows: list[tuple[int, int]], best: tuple | None) -> tuple[int, int, int] | None:
    """Matched words, first and last place of the window that aligns best, if better than ``best``."""
    for begin, end in windows:
        pairs = align(target, words[begin:end].tolist())
        if pairs and (best is None or len(pairs) > best[0]):
            best = (len(pairs), begin + pairs[0][1], begin + pairs[-1][1])
    return best


def matches(words: np.ndarray, template: np.ndarray, min_coverage: float) -> list[tuple[float, int, int]]:
    """Coverage, first and last word of each stretch of ``words`` that the template covers."""
    size = len(template)
    known = np.isin(words, template)
    if not size or known.sum() < min_coverage * size:
        return []
    width = int(size * (1 + STRETCH)) + 1
    upto = np.r_[0, np.cumsum(known)]
    out, target, todo = [], template.tolist(), [(0, len(words))]
    while todo:
        low, high = todo.pop()
        held = upto[np.minimum(np.arange(low, high) + width, high)] - upto[low:high]
        can = low + np.flatnonzero(known[low:high] & (held >= min_coverage * size))
        at, free = 0, low
        while at < len(can):
            # The best of the windows that begin within a template's length of this one.
            near = can[at: np.searchsorted(can, can[at] + size)]
            fullest = near[held[near - low] == held[near - low].max()]
            begins = sorted({int(fullest[0]), int(fullest[-1]), int(near[0])})
            best = _best(target, words, [(b, min(b + width, high)) for b in begins], None)
            if best:  # the window may have begun too early or late: look around what was matched
                best = _best(target, words, [(max(best[1] - size // 4, free), min(best[2] + 1 + size // 4, high))], best)
            if best and best[0] >= min_coverage * size:
                out.append((best[0] / size, best[1], best[2]))
                # Stretches that end before the match are still to be looked at.
                todo.append((max(min(int(can[at]), best[1] - width), free), best[1]))
                free = best[2] + 1
                at = int(np.searchsorted(can, free))
            else:
                at += 1
    return sorted(out, key=lambda m: m[1])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs`` without its text, with ``licenses``: an array of ``name``, ``begin``, ``end``, ``coverage``.

    Begin and end count code points, the end is exclusive. Of overlapping matches the one with
    most matched words stays. Null and empty texts have none. Repeated rows are kept; a column
    named ``licenses`` is replaced, other columns are kept.
    """
    keep = [c for c in docs.columns if c not in ("text", "licenses")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    fields = [docs.schema[c] for c in keep]
    match = T.StructType([T.StructField("name", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("coverage", T.DoubleType())])
    schema = T.StructType([*fields, T.StructField("licenses", T.ArrayType(match))])
    arrow = pa.list_(pa.struct([("name", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))
    wanted = template_words(templates)
    vocabulary = np.unique(np.concatenate(list(wanted.values())))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textbytes.slices(batches):
            hashes, begins, ends, firsts, _ = hashed_words(batch.column("text"))
            known = vocabulary[np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)] == hashes
            of = np.repeat(np.arange(batch.num_rows), np.diff(firsts))[known]
            present, out = hashes[known], [[] for _ in range(batch.num_rows)]
            cuts = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
            for row in range(batch.num_rows):
                own = set(present[cuts[row]: cuts[row + 1]].tolist())
                hits = []
                for name, template in wanted.items():
                    if own and sum(w in own for w in template.tolist()) >= min_coverage * len(template):
                        a, b = int(firsts[row]), int(firsts[row + 1])
                        hits += [(-round(c * len(template)), i, j, name, c) for c, i, j in matches(hashes[a:b], template, min_coverage)]
                taken = []
                for _, i, j, name, c in sorted(hits):
                    if all(j < p or i > q for p, q in taken):
                        taken.append((i, j))
                        out[row].append({"name": name, "begin": int(begins[firsts[row] + i]), "end": int(ends[firsts[row] + j]), "coverage": c})
                out[row].sort(key=lambda x: x["begin"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, arrow)], schema.names)

    return docs.mapInArrow(find, schema)
