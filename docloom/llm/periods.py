"""Periodic runs of words, caught online by dyadic blocks.

A text is read word by word, in appended stretches of bounded size.  On every level a block of
L = 1, 2, 4, ... words that is complete becomes a catcher: it waits for its words to come again
2L - 1 to 4L - 2 words later.  So at every appended word exactly two catchers of each level are
due, and the newest L words (a suffix of what has been read) are compared with both, through
sums of word codes times powers, for all words of a stretch at once.  Every square of period q
holds a whole block of the level that waits for q, so none is missed.

A hit is a block that stands again q words later.  Hits of one period on neighbouring blocks
are one stretch; only a stretch's outer ends are carried on, by halving the compared length.
The stretch read with its shift is a run of period q; of several periods of the same words the
smallest stays.  Runs are compared word by word before they are reported, and a stretch that a
chance equality of sums has spoilt is cut from the words themselves.

Work is n log n words per text, memory a few numbers per word of one text.

Defined cases: a null or empty text has no words and no runs; a text of any length is read
whole; equal rows get equal answers; words are compared as bytes, so nothing but the blanks
``\\x20\\x09-\\x0D`` parts words; of runs with the same exponent the earliest start, then the
smallest period, is the one shown; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import arrow_map

STEP = 1 << 16  # words of one appended stretch
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_CODES = np.uint64(0xD1B54A32D192ED03)


@dataclass
class SquareCatcher:
    """Reads word numbers online; :meth:`append` returns the squares that the new words complete, :meth:`runs` all runs so far.

    ``longest`` says that no run is longer than so many words (of several texts read as one: the longest text).
    """

    least: int = 24
    exponent: int = 3
    longest: int | None = None
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sums: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))  # of code times power, up to each word
    back: np.ndarray = field(default_factory=lambda: np.ones(1, np.uint64))  # inverse power of each place
    power: np.ndarray = field(default_factory=lambda: np.ones(1, np.uint64))  # the next word's power
    chains: np.ndarray = field(default_factory=lambda: np.empty((0, 4), np.int64))  # block size, period, first and last block
    merged: int = 0

    def append(self, words: np.ndarray) -> np.ndarray:
        """Read on; what these words complete, as rows (block size, period, first block's start, last block's start)."""
        old, n = len(self.words), len(self.words) + len(words)
        power = np.cumprod(np.concatenate((self.power, np.full(len(words), _BASE, np.uint64))))
        inverse = np.full(len(words), pow(_BASE, -1, 1 << 64), np.uint64)
        code = (words.astype(np.uint64) + np.uint64(1)) * _CODES
        code ^= code >> np.uint64(29)
        code *= _CODES
        self.sums = np.concatenate((self.sums, self.sums[-1] + np.cumsum(code * power[:-1])))
        self.back = np.concatenate((self.back[:-1], np.cumprod(np.concatenate((self.back[-1:], inverse)))))
        self.power, self.words = power[-1:], np.concatenate((self.words, words))
        found, size = [], 1
        while 3 * size - 1 <= n and (self.longest is None or self.exponent * (2 * size - 1) <= self.longest):
            at = max(old - size + 1, 2 * size - 1)  # where the newest `size` words start, for the first new word
            if at <= n - size:
                suffix = self._mark(slice(at, n - size + 1), size)
                due = np.arange(at - (2 * size - 1), n - size + 1 - (2 * size - 1)) // size
                block = self._mark(slice(0, (int(due[-1]) + 1) * size, size), size)
                for back in (0, 1):
                    skip = int(np.searchsorted(due, back))
                    here = np.flatnonzero(block[due[skip:] - back] == suffix[skip:]) + skip
                    if len(here):
                        start = (due[here] - back) * size
                        found.append(np.stack((np.full(len(here), size), at + here - start, start, start), 1))
            size *= 2
        made = _merge(np.concatenate(found)) if found else self.chains[:0]
        self.chains = np.concatenate((self.chains, made))
        if len(self.chains) > 2 * self.merged + STEP:
            self.chains = _merge(self.chains)
            self.merged = len(self.chains)
        return made

    def _mark(self, at, size: int) -> np.ndarray:
        """A number for the ``size`` words from each place on, the same wherever they stand."""
        if isinstance(at, slice):
            return (self.sums[at.start + size : at.stop + size : at.step] - self.sums[at]) * self.back[at]
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def _stretches(self) -> np.ndarray:
        """Rows (start, end, period): stretches whose words equal those one period later, read as far as they go."""
        if not len(self.chains):
            return np.empty((0, 3), np.int64)
        size, period, left, last = _merge(self.chains).T.copy()
        right = last + size
        n, step = len(self.words), int(size.max()) // 2 or 1
        while step:  # a stretch ends less than one block beyond its outer blocks
            at = np.flatnonzero((step <= size) & (left >= step))
            here = left[at] - step
            more = at[self._mark(here, step) == self._mark(here + period[at], step)]
            left[more] -= step
            at = np.flatnonzero((step <= size) & (right + period + step <= n))
            more = at[self._mark(right[at], step) == self._mark(right[at] + period[at], step)]
            right[more] += step
            step //= 2
        return np.stack((left, right + period, period), 1)

    def runs(self) -> np.ndarray:
        """Rows (start, length, period) by start, then period."""
        at = self._stretches()
        if not len(at):
            return at
        long = at[:, 1] - at[:, 0] >= np.maximum(self.least, self.exponent * at[:, 2])
        at = at[long]
        at = at[np.lexsort((at[:, 2], at[:, 1], at[:, 0]))]
        keep = np.r_[True, (at[1:, :2] != at[:-1, :2]).any(1)] if len(at) else np.empty(0, bool)
        made = [(s, e - s, q) for s, e, q in at[keep].tolist()]
        if not all(self._holds(s, m, q) for s, m, q in made):  # sums were equal by chance
            made = self._read(sorted({int(q) for q in at[:, 2]}))
        return np.array(sorted(made, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)

    def _holds(self, start: int, length: int, q: int) -> bool:
        w, end = self.words, start + length
        whole = np.array_equal(w[start : end - q], w[start + q : end])
        return whole and (start == 0 or w[start - 1] != w[start - 1 + q]) and (end == len(w) or w[end] != w[end - q])

    def _read(self, periods: list[int]) -> list[tuple[int, int, int]]:
        """The same runs from the words alone."""
        made: dict[tuple[int, int], int] = {}
        for q in periods:
            edge = np.flatnonzero(np.diff(np.r_[False, self.words[q:] == self.words[:-q], False].astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a + q >= max(self.least, self.exponent * q):
                    made.setdefault((a, b + q), q)
        return [(s, e - s, q) for (s, e), q in made.items()]


def _merge(chains: np.ndarray) -> np.ndarray:
    """Rows of one period whose blocks are neighbours as one row."""
    chains = chains[np.lexsort((chains[:, 2], chains[:, 1]))]
    new = np.r_[True, (chains[1:, 1] != chains[:-1, 1]) | (chains[1:, 2] != chains[:-1, 3] + chains[1:, 0])]
    first = np.flatnonzero(new)
    made = chains[first]
    made[:, 3] = chains[np.r_[first[1:], len(chains)] - 1, 3]
    return made


def runs_of(texts: list[list[bytes]], least: int = 24, exponent: int = 3) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period).

    Short texts are read one after another as one sequence, with a word of its own after each,
    so no run leaves its text.
    """
    made = [np.empty((0, 3), np.int64)] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if len(t) >= max(least, exponent)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        own, total = [], 0
        while at < len(order) and (not own or total + len(texts[order[at]]) <= STEP // 2):
            own.append(order[at])
            total += len(texts[order[at]]) + 1
            at += 1
        number: dict[bytes, int] = {}
        joined: list[int] = []
        for k, i in enumerate(own):
            joined += [number.setdefault(w, len(number)) for w in texts[i]]
            joined.append(-2 - k)
        codes = np.array(joined, np.int64)
        reader = SquareCatcher(least, exponent, len(texts[own[-1]]))
        for a in range(0, len(codes), STEP):
            reader.append(codes[a : a + STEP])
        runs = reader.runs()
        starts = np.cumsum([0, *[len(texts[i]) + 1 for i in own]])
        for i, start, part in zip(own, starts[:-1], np.split(runs, np.searchsorted(runs[:, 0], starts[1:-1])), strict=True):
            made[i] = part - [start, 0, 0]
    return made


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that stay when every run keeps its first period only."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for s, m, q in runs.tolist():
        if best is None or (m * best[2], -s, -q) > (best[1] * q, -best[0], -best[2]):
            best = (s, m, q)
    return best


def periodic_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """For one document in ten, by its id: the words from some place on repeat with some period; others as they are."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, *keep: Column, least: int = 24, exponent: int = 3, prepare=None) -> DataFrame:
    """The columns ``keep``, n_runs, the strongest run (start, length, period), exponent_milli, all ``runs``, ``collapsed_text``.

    ``collapsed_text`` holds the text's words, one blank between them, where every run keeps its
    first period only.  ``prepare(words, doc_id)`` may change a document's words first.
    """

    def run(pieces: Iterator[dict]):
        names = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed_text")
        for p in pieces:
            made: dict[str, list] = {k: [] for k in names}
            texts = [t.encode("utf-8", "surrogatepass").split() for t in p.pop("_text")]
            ids = p.pop("_id")
            texts = [prepare(t, i) for t, i in zip(texts, ids, strict=True)] if prepare else texts
            for words, found in zip(texts, runs_of(texts, least, exponent), strict=True):
                best = strongest(found)
                kept = b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass")
                values = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, found.tolist(), kept)
                for k, v in zip(names, values, strict=True):
                    made[k].append(v)
            yield {**p, **made}

    rows = docs.select(*keep, F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n not in ("_id", "_text"))
    return arrow_map(rows, run, f"{schema}n_runs long, start long, length long, period long, exponent_milli long, runs array<array<long>>, collapsed_text string")
