"""License scans: winnowed fingerprints in an inverted index, then banded alignment of the candidates.

Templates are word sequences. Their word GRAM-grams are winnowed, and the index maps each kept fingerprint to its
places in templates. A text's GRAM-grams are looked up in the index; hits of one template that go forward in both on
neighbouring diagonals are a chain. The text is aligned with the template through a chain: between its hits, and before
and behind them as far as that gains, a matched word counting twice as much as a word of the text that the template
lacks. Alignments stay in a band of BAND words around the chain. Of alignments that overlap in the text the best stays,
whatever its template; those that can only lie inside one that stays are not made.
"""

from __future__ import annotations

import bisect
import heapq
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_groups

GRAM, WINNOW, BAND = 3, 2, 8
LEAST_COVERAGE = 0.8
#: Templates go to all tasks; more text than this is refused.
MAX_TEMPLATE_CHARS = 5_000_000

#: In longer templates, fingerprints that occur more than once are not looked up.
LONG_WORDS = 150

#: Notices and, from the folder `licenses`, whole texts of well-known public licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-line": "Released under the MIT License.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "lgpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
TEMPLATES |= {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
OUTPUT = "doc_id long, matches array<struct<license:string,coverage:double,spans:array<struct<start:int,end:int>>>>"
_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))
_WORD = re.compile(r"[^\W_]+")


def lowered(text: str) -> str:
    """In lower case, with as many code points, so that words stay where they are."""
    return text.replace("\u0130", "i").lower()


def words_of(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


class Index:
    """Inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: dict[str, str], least_coverage: float = LEAST_COVERAGE):
        self.least_coverage = least_coverage
        self.names = sorted(n for n in templates if words_of(templates[n]))
        words = [words_of(templates[n]) for n in self.names]
        vocabulary = sorted({w for x in words for w in x})
        self.number = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.base = np.uint64(len(vocabulary) + 2)
        self.templates = [np.array([self.number[w] for w in x], np.int64) for x in words]
        places: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.templates):
            prints = self.grams(ids)
            single = np.ones(len(prints), bool)
            if len(ids) > LONG_WORDS:
                _, number, times = np.unique(prints, return_inverse=True, return_counts=True)
                single = times[number] == 1
            for k in winnow(self.mixed(prints)):
                if single[k]:
                    places.setdefault(int(prints[k]), []).append((t, int(k)))
        #: Templates without a GRAM-gram are looked for as they are.
        self.short = [(t, x.tolist()) for t, x in enumerate(self.templates) if len(x) < GRAM]
        self.counts = [np.bincount(x, minlength=len(vocabulary) + 1) for x in self.templates]
        self.keys = np.array(sorted(places), np.uint64)
        self.places = [places[int(k)] for k in self.keys]

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Exact numbers of GRAM-grams; those with a word that no template has are never in the index."""
        n = max(0, len(ids) - GRAM + 1)
        out = np.zeros(n, np.uint64)
        for k in range(GRAM):
            out = out * self.base + ids[k : k + n].astype(np.uint64)
        return out

    def mixed(self, prints: np.ndarray) -> np.ndarray:
        return (prints + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)

    def seeds(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Hits (position in the text, place in the template) of each template that the text has words enough for."""
        known = ids > 0
        whole = known[: max(0, len(ids) - GRAM + 1)].copy()
        for k in range(1, GRAM):
            whole &= known[k : k + len(whole)]
        at = np.flatnonzero(whole)
        if not len(at) or not len(self.keys):
            return {}
        prints = self.grams(ids)[at]
        where = np.searchsorted(self.keys, prints)
        where[where == len(self.keys)] = 0
        hit = self.keys[where] == prints
        found: dict[int, list[tuple[int, int]]] = {}
        for position, key in zip(at[hit].tolist(), where[hit].tolist()):
            for t, offset in self.places[key]:
                found.setdefault(t, []).append((position, offset))
        if not found:
            return {}
        # Each word of a text stands for one word of a template in a chain, so these can't reach the coverage.
        have = np.bincount(ids, minlength=len(self.number) + 1)
        return {t: x for t, x in found.items() if np.minimum(have, self.counts[t]).sum() >= self.least_coverage * len(self.templates[t])}

    def matches(self, text: str) -> list[dict]:
        low = lowered(text)
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in _WORD.findall(low)), np.int64)
        # Candidates by the score that they can have at most; one that was aligned, by its score.
        heap: list[tuple] = []
        for t, found in self.seeds(ids).items():
            for chain in chains(found, len(self.templates[t])):
                heap.append((-2 * len(self.templates[t]), 0, 0.0, t, chain[0][0], len(heap), chain, None))
        for t, own in self.short:
            for p in np.flatnonzero(np.all([ids[k : len(ids) - len(own) + 1 + k] == w for k, w in enumerate(own)], axis=0) if len(ids) >= len(own) else []):
                heap.append((-2 * len(own), 1, -1.0, t, int(p), len(heap), None, [(k, int(p) + k) for k in range(len(own))]))
        if not heap:
            return []
        heapq.heapify(heap)
        kept: list[tuple[int, int, int, list]] = []  # disjoint: first and last word, template, pairs
        while heap:
            _, _, _, t, _, number, chain, pairs = heapq.heappop(heap)
            template = self.templates[t]
            if pairs is None:
                # As far as an alignment through the chain can reach.
                first, last = chain[0][0] - chain[0][1] - BAND, chain[-1][0] - chain[-1][1] + len(template) - 1 + BAND
                k = bisect.bisect_right(kept, max(0, first), key=lambda x: x[0]) - 1
                if k >= 0 and kept[k][1] >= min(last, len(ids) - 1):
                    continue
                pairs = align(template, ids, chain)
                score = 3 * len(pairs) - (pairs[-1][1] - pairs[0][1] + 1)
                heapq.heappush(heap, (-score, 1, -len(pairs) / len(template), t, pairs[0][1], number, None, pairs))
                continue
            first, last = pairs[0][1], pairs[-1][1]
            k = bisect.bisect_right(kept, last, key=lambda x: x[0])
            if not k or kept[k - 1][1] < first:
                kept.insert(k, (first, last, t, pairs))
        out, spans = [], None
        for t in sorted({r[2] for r in kept}):
            own, covered = [r for r in kept if r[2] == t], np.zeros(len(self.templates[t]), bool)
            for r in own:
                covered[[i for i, _ in r[3]]] = True
            if covered.mean() >= self.least_coverage:
                spans = spans or [m.span() for m in _WORD.finditer(low)]
                best = [r for r in own if len(r[3]) >= self.least_coverage * len(covered)] or own
                out.append({"license": self.names[t], "coverage": float(covered.mean()), "spans": [{"start": spans[a][0], "end": spans[b][1]} for a, b, *_ in best]})
        return out


def winnow(prints: np.ndarray) -> list[int]:
    """Places of the smallest value, the last of equals, of each window of WINNOW values."""
    if not len(prints):
        return []
    return sorted({k + w - 1 - int(prints[k : k + w][::-1].argmin()) for w in [min(WINNOW, len(prints))] for k in range(len(prints) - w + 1)})


def chains(seeds: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Chains of seeds that go forward in the text and in the template, each on a diagonal near that of the last."""
    done: list[list[tuple[int, int]]] = []
    open_: list[list[tuple[int, int]]] = []
    for p, o in sorted(seeds):
        if open_ and open_[0][-1][0] < p - size - BAND:
            done += [c for c in open_ if c[-1][0] < p - size - BAND]
            open_ = [c for c in open_ if c[-1][0] >= p - size - BAND]
        fits = [c for c in open_ if c[-1][0] < p and c[-1][1] < o and abs(p - o - c[-1][0] + c[-1][1]) <= BAND]
        if fits:
            min(fits, key=lambda c: (abs(p - o - c[-1][0] + c[-1][1]), -c[-1][0])).append((p, o))
        else:
            open_.append([(p, o)])
    return done + open_


def align(template: np.ndarray, ids: np.ndarray, chain: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs (place in template, position in text) of equal words, in order, of the best alignment through the chain."""
    fixed: list[tuple[int, int]] = []
    for p, o in chain:
        fixed += [(o + k, p + k) for k in range(GRAM) if not fixed or o + k > fixed[-1][0] and p + k > fixed[-1][1]]
    (i, j), (x, y) = fixed[0], fixed[-1]
    start = max(0, j - i - BAND)
    before = banded(template[:i][::-1], ids[start:j][::-1], False)
    out = [(i - 1 - a, j - 1 - b) for a, b in before[::-1]] + fixed[:1]
    for (a, b), (c, d) in zip(fixed, fixed[1:]):
        if c > a + 1 and d > b + 1:
            out += [(a + 1 + k, b + 1 + m) for k, m in banded(template[a + 1 : c], ids[b + 1 : d], True)]
        out.append((c, d))
    rest = template[x + 1 :]
    return out + [(x + 1 + a, y + 1 + b) for a, b in banded(rest, ids[y + 1 : y + 1 + len(rest) + BAND], False)]


def banded(a: np.ndarray, b: np.ndarray, whole: bool) -> list[tuple[int, int]]:
    """Pairs of equal words that make the most of 2 for each and -1 for each word of b passed over.

    Those of b behind the last pair count only if the whole of b is to be aligned.
    """
    m, n = len(a), len(b)
    if not m or not n:
        return []
    low, high = (min(0, n - m) - BAND, max(0, n - m) + BAND) if whole else (-BAND, BAND)
    width, worst = high - low + 1, -(1 << 30)
    steps = np.arange(width, dtype=np.int64)
    score = np.full((m + 1, width + 2), worst, np.int64)  # [i, d + 1]: i words of a, i + low + d of b
    at = steps + low
    score[0, 1:-1] = np.where((at >= 0) & (at <= n), -at, worst)
    for i in range(1, m + 1):
        at = steps + (low + i)
        equal = (at >= 1) & (at <= n) & (b[np.clip(at - 1, 0, n - 1)] == a[i - 1])
        row = np.maximum(score[i - 1, 2:], np.where(equal, score[i - 1, 1:-1] + 2, worst))
        row = np.maximum.accumulate(row + steps) - steps
        row[(at < 0) | (at > n)] = worst
        score[i, 1:-1] = row
    i, d = (m, n - m - low + 1) if whole else divmod(int(score.argmax()), width + 2)
    pairs: list[tuple[int, int]] = []
    while i > 0:
        j = i + low + d - 1
        if 1 <= j <= n and a[i - 1] == b[j - 1] and score[i, d] == score[i - 1, d] + 2:
            i -= 1
            pairs.append((i, j - 1))
        elif score[i, d] == score[i - 1, d + 1]:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return pairs[::-1]


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """One row for each row of documents: doc_id, matches (license, coverage, spans), by license.

    A match covers `least_coverage` of the template's words or more; spans are code points of the text. Null and empty
    texts match nothing; whole texts are scanned; repeated rows each give a row; templates of fewer than GRAM words
    match where all their words stand in a row, and those without words nowhere; an empty table gives an empty result;
    columns besides doc_id and text are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(map(len, templates.values())) > MAX_TEMPLATE_CHARS:
        raise ValueError(f"the templates hold more than {MAX_TEMPLATE_CHARS} characters")
    shared = documents.sparkSession.sparkContext.broadcast(dict(templates))

    def run(batches):
        index = Index(shared.value, least_coverage)
        for batch, texts in text_groups(batches):
            found = [index.matches(t or "") if index.templates else [] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _MATCHES)], names=["doc_id", "matches"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUTPUT)
