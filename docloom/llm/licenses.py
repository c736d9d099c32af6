"""License scan: winnowed fingerprints pick templates, banded alignment measures what matches.

Templates and texts are sequences of words (runs of ASCII letters, digits and non-ASCII
characters, A-Z in lower case).  Of every WINDOW consecutive GRAM-word runs the one with the
least hash is kept; the templates' kept runs form an inverted index of fixed size.  A text's
kept runs that occur there are seeds (text position, template position).  Seeds of one template
that follow each other in both, on diagonals at most BAND apart, form a chain; long chains of a
whole license are joined over larger insertions and gaps.  Each chain is a candidate: a local
alignment inside a band that follows it gives the matched template words (coverage) and the span
in the text.  A chain uses a template position once, so a text that repeats a license has a chain
for each repetition, and work grows with the length of the text.  Runs with a word that no
template has can't be in the index and get the largest hash, which keeps the guarantee that every
shared run of GRAM + WINDOW - 1 words shares a kept one.

Each text is scanned whole inside one task and nothing is shuffled.

Defined cases: a null or empty text has no match; repeated notices give one match each; equal
rows get equal answers; a whole license needs a chain of LINKS seeds, dense enough for its
coverage; of overlapping matches, of whatever license, the one with the best alignment stays, then the better covered, then the earlier; a notice needs the words that tell
it from its siblings (nc, sa, lesser, version numbers); a span that only opens a BSD license
names none; spans count code points, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from dataclasses import dataclass
from itertools import product
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import arrow_map

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
LINKS = 4  # seeds of the least chain of a whole license

BODIES = ("BSD-3-Clause", "BSD-2-Clause", "MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0")
_FREE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU", "Public License as published by the Free Software Foundation, either", "any later version.",
)


def _creative_commons():
    """Notices of the six licenses in their versions and spellings."""
    words_of = {"BY": ("Attribution",), "NC": ("NonCommercial", "Non-Commercial"), "SA": ("ShareAlike", "Share Alike"), "ND": ("NoDerivatives", "No Derivatives", "NoDerivs")}
    for kind in ("BY-NC", "BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version, law in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
            name = f"CC-{kind}-{version}"
            yield name, f"Licensed under CC {kind} {version}."
            if version == "4.0":
                yield name, f"Licensed under CC {kind} 4."
            for spelled in product(*[words_of[k] for k in kind.split("-")]):
                yield name, f"This work is licensed under a Creative Commons {'-'.join(spelled)} {version} {law} License."


# Public license notices and whole texts, (license, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-1.1", "Licensed under the Mozilla Public License, Version 1.1."),
    ("ISC", "Released under the ISC License."),
    *_creative_commons(),
    *((name, (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8").strip().rstrip(".")) for name in BODIES),
    *((name, f"{_FREE[0]} {kind} {_FREE[1]} {version} {_FREE[2]}") for name, kind, version in (
        ("GPL-2.0", "General", "version 2 of the License, or (at your option)"), ("AGPL-3.0", "Affero General", "version 3 of the License, or (at your option)"),
        ("LGPL-2.1", "Lesser General", "version 2.1 of the License, or (at your option)"), ("LGPL-3.0", "Lesser General", "version 3 of the License, or (at your option)"))),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
)

# Words that tell siblings apart.  A notice counts only with its own ones, all of them, and no other inside its span.
MARKS = {b"nc", b"sa", b"nd", b"noncommercial", b"commercial", b"sharealike", b"alike", b"noderivatives", b"derivatives", b"noderivs", b"derivs", b"lesser", b"affero", b"library"}
NOTICE = 120  # words; longer templates are whole licenses, told apart by their alignment

_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010FFFF]+")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()


def kept(hashes: np.ndarray) -> np.ndarray:
    """Positions of the least hash (the last one if equal) of every WINDOW neighbours; of all, if there are fewer."""
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())] if len(hashes) else [], int)
    view = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(view)) + WINDOW - 1 - view.argmin(1))


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    start: int
    end: int


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        texts = [words(t) for _, t in templates]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        texts_of = {i: w for w, i in self.vocabulary.items()}
        self.templates = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]
        marks = {i for w, i in self.vocabulary.items() if w in MARKS}
        self.required: list[dict[int, int]] = []  # of a notice: word -> bit
        self.marks = np.array(sorted(marks), np.int64)
        for t in self.templates:
            own = [w for w in dict.fromkeys(t.tolist()) if w in marks or texts_of[w].isdigit()] if len(t) <= NOTICE else []
            self.required.append({w: 1 << k for k, w in enumerate(own)})
        self.bags = [np.unique(t, return_counts=True) for t in self.templates]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, t in enumerate(self.templates):
            h = self._hashes(t)
            for i in kept(h):
                self.index[int(h[i])].append((n, int(i)))
        self.listed = np.array(sorted(self.index), np.uint64)

    @staticmethod
    def _hashes(ids: np.ndarray) -> np.ndarray:
        if len(ids) < GRAM:
            return np.zeros(0, np.uint64)
        h, known = np.zeros(len(ids) - GRAM + 1, np.uint64), np.ones(len(ids) - GRAM + 1, bool)
        for j in range(GRAM):
            part = ids[j : len(ids) - GRAM + 1 + j]
            known &= part > 0
            h = (h + part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.where(known, h >> np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))

    def scan(self, text: str | None) -> list[Match]:
        own = words(text) if text else []
        if len(own) < GRAM:
            return []
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in own), np.int64, len(own))
        h = self._hashes(ids)
        if not (h < np.uint64(1 << 63)).any():
            return []
        at = kept(h)
        at = at[self.listed[np.minimum(np.searchsorted(self.listed, h[at]), len(self.listed) - 1)] == h[at]]
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in at.tolist():
            for n, j in self.index[int(h[i])]:
                seeds[n].append((i, j))
        everywhere = np.bincount(ids, minlength=len(self.vocabulary) + 1)
        found: list[tuple[str, float, int, int, int]] = []
        for n, pairs in seeds.items():
            if self._enough(n, everywhere):
                for chain in chains(pairs, len(self.templates[n])):
                    found += self._candidate(n, ids, chain)
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        out: list[tuple[str, float, int, int, int]] = []
        firsts: list[int] = []  # of the matches in out, which never overlap and stand in their order
        for m in sorted(found, key=lambda m: (-m[4], -m[1], m[2], m[0])):
            k = bisect(firsts, m[3])
            if k == 0 or out[k - 1][3] < m[2]:
                firsts.insert(k, m[2])
                out.insert(k, m)
        return [Match(n, c, spans[a][0], spans[b][1]) for n, c, a, b, _ in sorted(out, key=lambda m: (m[2], m[0]))]

    def _enough(self, n: int, counts: np.ndarray) -> bool:
        """Whether enough words of template n are among the counted ones, in any order."""
        own, times = self.bags[n]
        return np.minimum(counts[own], times).sum() >= COVERAGE * len(self.templates[n])

    def _candidate(self, n: int, ids: np.ndarray, chain: list[tuple[int, int]]) -> list[tuple[str, float, int, int, int]]:
        """The match of template n along a chain, or nothing: name, coverage, first and last word, score."""
        t, required = self.templates[n], self.required[n]
        low, high = band(chain, len(t))
        begin, end = max(0, int(low.min())), min(len(ids), int(high.max()))
        near = ids[begin:end]
        if not self._enough(n, np.bincount(near, minlength=len(self.vocabulary) + 1)):
            return []
        matched, first, last, score, seen = align(t, near, low - begin, high - begin, required)
        if matched < COVERAGE * len(t) or seen != (1 << len(required)) - 1:
            return []
        span = near[first : last + 1]
        if len(t) <= NOTICE and any(int(w) not in required for w in span[np.isin(span, self.marks)]):
            return []
        return [(self.names[n], matched / len(t), begin + first, begin + last, score)]


def _taken_apart(scores: list[float], before: list[int]) -> list[list[int]]:
    """Every element once: the best end first, followed back until an element that another path has."""
    free, out = [True] * len(scores), []
    for end in sorted(range(len(scores)), key=lambda k: (-scores[k], k)):
        path = []
        while end >= 0 and free[end]:
            free[end] = False
            path.append(end)
            end = before[end]
        if path:
            out.append(path[::-1])
    return out


def chains(seeds: list[tuple[int, int]], length: int) -> list[list[tuple[int, int]]]:
    """Seeds (text position, template position), by text position, as chains that rise in both.

    A seed follows the seed with the longest chain among the last ones of the diagonals within
    BAND, the nearest diagonal if equal.  Of a whole license, where stray seeds are common, no step
    passes 4 * BAND words; chains of at least LINKS seeds are then linked in the same way over
    drifts of up to a fifth of its length.
    """
    whole = length > NOTICE
    reach = 4 * BAND if whole else max(4 * BAND, length // 2)
    near = sorted(range(-BAND, BAND + 1), key=abs)
    scores: list[float] = []
    before: list[int] = []
    last: dict[int, int] = {}
    for k, (i, j) in enumerate(seeds):
        best, link = 0.0, -1
        for step in near:
            p = last.get(i - j + step, -1)
            if p >= 0 and seeds[p][0] < i and seeds[p][1] < j and i - seeds[p][0] <= reach and scores[p] - abs(step) / BAND > best:
                best, link = scores[p] - abs(step) / BAND, p
        scores.append(best + 1)
        before.append(link)
        last[i - j] = k
    found = [[seeds[k] for k in path] for path in _taken_apart(scores, before)]
    if not whole:  # a step to another diagonal may lead into a repetition: its two sides are candidates as well
        return found + [p for c in found for p in _straight(c) if len(p) < len(c)]
    found = sorted(c for c in found if len(c) >= LINKS)
    scores, before, oldest = [], [], 0
    for k, c in enumerate(found):
        (i, j), best, link = c[0], 0.0, -1
        while found[oldest][0][0] < i - 2 * length:  # no chain spans more, see band()
            oldest += 1
        for p in range(oldest, k):
            a, b = found[p][-1]
            drift = abs((i - j) - (a - b))
            if a < i and b < j and i - a <= length // 2 and drift <= length // 5 and scores[p] - drift / BAND > best:
                best, link = scores[p] - drift / BAND, p
        scores.append(best + len(c))
        before.append(link)
    linked = ([s for k in path for s in found[k]] for path in _taken_apart(scores, before))
    return [c for c in linked if attainable(c, length) >= COVERAGE * length]


def _straight(chain: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Its pieces on one diagonal."""
    cuts = [0, *(k for k in range(1, len(chain)) if chain[k][0] - chain[k][1] != chain[k - 1][0] - chain[k - 1][1]), len(chain)]
    return [chain[a:b] for a, b in zip(cuts, cuts[1:])]


def attainable(chain: list[tuple[int, int]], length: int) -> float:
    """Most template words that can match along a chain.

    Where seeds are further apart than every shared run of GRAM + WINDOW - 1 words allows, one
    word of each such run must differ.
    """
    run = GRAM + WINDOW - 1
    gaps = np.diff([0, *(j for _, j in chain), length])
    return float(np.where(gaps <= run, gaps, np.minimum(gaps, gaps * (run - 1) / run + run)).sum())


def band(chain: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last text position of each template row: BAND to both sides of the chain, and of both ends of a step."""
    rows = np.arange(length)
    at = np.array([j for _, j in chain])
    drift = np.array([i - j for i, j in chain])
    after = np.minimum(np.searchsorted(at, rows), len(at) - 1)
    ahead = np.where(rows > at[-1], after, np.maximum(after - 1, 0))
    side = min(BAND, length - 1)  # a longer insertion never pays, and the next repetition lies length away
    return rows + np.minimum(drift[after], drift[ahead]) - side, rows + np.maximum(drift[after], drift[ahead]) + side + 1


def align(template: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, required: dict[int, int]) -> tuple[int, int, int, int, int]:
    """Best local alignment with row r inside text positions low[r]..high[r]-1: matched words, first and last text word, score, bits of the required words that match.

    A match counts 2, a mismatch, insertion or deletion -1.  A row is computed at once: what an
    insertion hands on inside it is a running maximum.
    """
    n = len(ids)
    low, high = np.clip(low, 0, n).tolist(), np.clip(high, 0, n).tolist()
    score = np.zeros(n + 1, np.int64)  # cell j + 1 is text position j, cells without an alignment hold 0
    state = np.zeros((3, n + 1), np.int64)  # matched words, first word, bits of the required words
    steps = np.arange(max(b - a for a, b in zip(low, high, strict=True)) + 1)
    best, old = (0, 0, 0, 0, 0), (0, 0)
    for r, t in enumerate(template.tolist()):
        a, b = low[r], high[r]
        if a >= b:
            score[old[0] + 1 : old[1] + 1] = 0
            continue
        ar, same = steps[: b - a], ids[a:b] == t
        diagonal, own = score[a:b], state[:, a:b].copy()
        fresh = diagonal == 0
        own[:, fresh] = 0
        own[1, fresh] = ar[fresh] + a
        own[0] += same
        if t in required:
            own[2, same] |= required[t]
        cell = diagonal + np.where(same, 2, -1)
        above = score[a + 1 : b + 1] - 1
        up = above > cell
        if up.any():
            cell = np.where(up, above, cell)
            own = np.where(up, state[:, a + 1 : b + 1], own)
        value = cell + ar
        top = np.maximum.accumulate(value)
        source = np.maximum.accumulate(np.where(value == top, ar, 0))
        cell, own = np.maximum(top - ar, 0), own[:, source]
        score[old[0] + 1 : old[1] + 1] = 0
        score[a + 1 : b + 1], state[:, a + 1 : b + 1], old = cell, own, (a, b)
        k = int(np.argmax(cell * (len(template) + 1) + own[0]))
        if (cell[k], own[0, k]) > best[:2]:
            best = (int(cell[k]), int(own[0, k]), int(own[1, k]), int(own[2, k]), a + k)
    points, matched, first, seen, last = best
    return matched, first, last, points, seen


def scan_licenses(docs: DataFrame, *keep: Column, templates=TEMPLATES) -> DataFrame:
    """The columns ``keep``, n_matches, licenses (distinct, sorted) and matches (license:coverage:start:end) of every row."""

    def run(pieces):
        scanner = Scanner(templates)
        for p in pieces:
            found = [scanner.scan(t) for t in p.pop("_text")]
            yield {
                **p, "n_matches": [len(f) for f in found], "licenses": [",".join(sorted({m.license for m in f})) for f in found],
                "matches": [",".join(f"{m.license}:{m.coverage:.4f}:{m.start}:{m.end}" for m in f) for f in found],
            }

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n != "_text")
    return arrow_map(rows, run, f"{schema}n_matches long, licenses string, matches string")
