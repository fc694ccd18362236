"""Licence scan: winnowed template fingerprints in an inverted index, then banded alignment.

Words are compared lower-cased and without ASCII punctuation. Of every template the winnowed ``k``-word shingles
go into an index, which travels with the tasks (templates are a parameter, at most ``MAX_TEMPLATE_WORDS`` words
together). A document's shingles are looked up; each hit is a seed, and
a banded alignment of the template with the text around its diagonal reports how much of the template matched and
where. The words of a match are taken; the text left between matches is aligned again for every seed in it.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.words import Hasher, Words, slices, window_argmin

MAX_TEMPLATE_WORDS = 1 << 22
K, WINNOW, BAND = 3, 2, 8

#: Well-known notices, as public licences give them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met""",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bare_words(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, which of them hold more than punctuation, and hashes of those without case and punctuation."""
    words = Words(column)
    mark = np.zeros(256, bool)
    mark[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
    keep = ~mark[words.text]
    at = np.append(0, np.cumsum(keep))
    text = words.text[keep]
    start, end = at[words.start], at[words.end]
    full = start < end
    return words, full, Hasher(lower=True).words(text, start[full], end[full])


def align(a: np.ndarray, b: np.ndarray, band: int) -> tuple[int, int, int]:
    """Banded alignment of all of ``a`` with a stretch of ``b`` that may begin and end anywhere.

    ``a[i]`` may match ``b[j]`` for |j - i - band| <= band. Returns matched words and the first and last place
    in ``b`` of the best alignment: most matches, then fewest skipped words of ``b``.
    """
    width = 2 * band + 1
    # best[d]: (score, matches, first) at diagonal d; a match counts 4, a skipped word of b inside costs 1
    score, matched, first = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1, np.int64)
    best = (0, 0, 0, -1)
    for i in range(len(a)):
        for d in range(width):
            j = i + d
            options = [(score[d], matched[d], first[d])]
            if j < len(b) and a[i] == b[j]:
                options[0] = (score[d] + 4, matched[d] + 1, first[d] if first[d] >= 0 else j)
            if d + 1 < width:  # a[i] has no partner
                options.append((score[d + 1], matched[d + 1], first[d + 1]))
            if d and first[d - 1] >= 0:  # b[j] has no partner; row i of diagonal d - 1 is already renewed
                options.append((score[d - 1] - 1, matched[d - 1], first[d - 1]))
            take = max(options, key=lambda o: (o[0], o[2]))
            score[d], matched[d], first[d] = take
            if score[d] > best[0] and j < len(b) and a[i] == b[j]:
                best = (int(score[d]), int(matched[d]), int(first[d]), j)
    return best[1], best[2], best[3]


def build_index(templates: dict[str, str], k: int, winnow: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Template words, and the index as sorted fingerprints with their template and place."""
    words, prints = [], []
    for number, text in enumerate(templates.values()):
        _, _, hashes = bare_words(pa.array([text]))
        grams = Hasher().shingles(hashes, min(k, max(1, len(hashes))))
        chosen = np.unique(window_argmin(grams, min(winnow, len(grams)))) if len(grams) else np.zeros(0, np.int64)
        words.append(hashes)
        prints += [(grams[p], number, p) for p in chosen] if len(hashes) >= k else []
    if sum(map(len, words)) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates are too large to travel with every task")
    prints.sort(key=lambda x: int(x[0]))
    return words, *(np.array([p[i] for p in prints], kind) for i, kind in enumerate((np.uint64, np.int64, np.int64)))


_MATCHES = "doc_id long, license string, coverage double, matched_words long, start_word long, end_word long"


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None,
    coverage: float = 0.8, k: int = K, winnow: int = WINNOW, band: int = BAND,
) -> DataFrame:
    """``(doc_id, license, coverage, matched_words, start_word, end_word)``, one row per match of a template.

    ``coverage`` is the share of the template's words that the alignment matched; matches below the parameter are
    left out. ``end_word`` lies behind the last matched word. Two matches of a template in one document do not
    overlap, but may touch. ``templates`` map names to texts, or are a table ``(license, text)``, as read from a folder of
    licence texts. Templates shorter than ``k`` words are not looked for. Null and empty texts match nothing; a
    null id stays null; each of several rows with one id gives its own matches. Extra columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    if isinstance(templates, DataFrame):
        templates = {r["license"]: r["text"] for r in templates.where("license IS NOT NULL AND text IS NOT NULL").orderBy("license", "text").select("license", "text").collect()}
    names = list(templates)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, prints, owner, offset = build_index(templates, k, winnow)
        hasher = Hasher()
        for batch in batches:
            for piece in slices(batch, "text"):
                words, full, hashes = bare_words(piece.column("text"))
                row = words.row_of_word()[full]
                place = np.flatnonzero(full) - words.bounds[row]
                grams = hasher.shingles(hashes, k)
                if not len(grams) or not len(prints):
                    continue
                low, high = np.searchsorted(prints, grams, "left"), np.searchsorted(prints, grams, "right")
                hit = np.flatnonzero((high > low) & (row[: len(grams)] == row[k - 1 :]))
                seeds = sorted((row[p], owner[e], p - offset[e], p) for p in hit for e in range(low[p], high[p]))
                out, taken, last, failed = [], [], None, set()
                for r, t, begin, p in seeds:
                    if last != (r, t):
                        last, taken, failed = (r, t), [], set()
                        own = np.searchsorted(row, r), np.searchsorted(row, r, "right")
                    form = forms[t]
                    while True:
                        at = bisect_right(taken, (p, len(hashes)))
                        left = taken[at - 1][1] if at else own[0]  # the text between two matches
                        right = taken[at][0] if at < len(taken) else own[1]
                        if left > p or (begin, left, right) in failed:
                            break
                        lo = begin - band
                        region = hashes[max(lo, left) : min(right, begin + len(form) + band)]
                        n = 0
                        if np.isin(form, region).sum() >= coverage * len(form):  # else no alignment can reach it
                            pad = np.zeros(max(0, left - lo), np.uint64)  # the band may begin before the text
                            n, first, end = align(form, np.append(pad, region), band)
                        if not n or n < coverage * len(form):
                            failed.add((begin, left, right))
                            break
                        insort(taken, (int(lo + first), int(lo + end) + 1))
                        out.append((int(r), names[t], n / len(form), n, int(place[lo + first]), int(place[lo + end]) + 1))
                ids = piece.column("doc").take(pa.array([x[0] for x in out], pa.int64()))
                columns = [ids] + [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), 1)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "coverage", "matched_words", "start_word", "end_word"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(task, _MATCHES)
