"""Secret scan: fixed patterns, and two character Markov models that add what patterns miss.

The models are trained from labelled samples of the corpus itself: what the patterns match
teaches the model of random strings, all other text the model of ordinary identifiers, but for
long runs with a digit, which are the ones to judge.
A run of identifier characters is judged whole and reported when the log-likelihood ratio of
the two models is high, in total and per character; of a run that patterns cover in part, the
other parts are reported, each if its own ratio per character is high.

Both models have order two over 64 identifier characters and a boundary; probabilities back
off to order one, order zero and, for random strings, a uniform share, so an unseen alphabet
of secrets is not ruled out.  Their tables have a fixed size.  Counts come from all texts.

Defined cases: a null or empty text has no spans; texts of any length are scanned whole;
spans count code points, end exclusive; added spans never overlap a pattern's span, and may touch it; equal
rows get equal answers; with no secret in the corpus the random model is uniform.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import arrow_map

# The patterns of the contract; least lengths are checked on the whole match, or on group 2.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is one match, so the least length may stand in the pattern
KINDS = ("assign", "access", "hex", "markov")
WORDS_AHEAD = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT = re.compile("[0-9]")
EDGE = 66
SYMBOLS = 67
_TABLE = np.full(256, EDGE, np.int64)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"):
    _TABLE[_c] = min(_i, EDGE - 1)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the fixed patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS_AHEAD):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def trigrams(raw: bytes) -> np.ndarray:
    """Cell of (two characters before, character) for each character of ``raw``; edges before its start."""
    s = _TABLE[np.frombuffer(raw, np.uint8)]
    s = np.concatenate(([EDGE, EDGE], s))
    return ((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[s[2:] != EDGE]


def _ordinary(run: re.Match) -> str:
    """A long run with a digit is what is to be judged, so it teaches nothing."""
    return "\n" if _DIGIT.search(run[0]) else run[0]


def smoothed(counts: np.ndarray, uniform: float, strength: float = 8.0) -> np.ndarray:
    """Log probabilities of a character after two others, backing off to shorter contexts."""
    c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)[:, :, :EDGE].astype(float)
    one, zero = c.sum(0), c.sum((0, 1))
    p0 = (1 - uniform) * (zero + 1.0) / (zero.sum() + EDGE) + uniform / EDGE
    p1 = (one + strength * p0) / (one.sum(1, keepdims=True) + strength)
    p2 = (c + strength * p1[None]) / (c.sum(2, keepdims=True) + strength)
    full = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS))
    full[:, :, :EDGE] = np.log(p2)
    return full.reshape(-1)


@dataclass
class Model:
    """Log-likelihood ratio (random : ordinary) of each trigram cell, and the two limits."""

    ratio: np.ndarray
    total: float = 18.0
    per_character: float = 0.9

    def gains(self, run: str) -> np.ndarray:
        return self.ratio[trigrams(run.encode())]

    def secret(self, run: str) -> bool:
        gain = self.gains(run)
        s = float(gain.sum())
        return s >= self.total and s >= self.per_character * len(run)

    def rest(self, run: str, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Parts of a secret run outside ``covered`` (in order, without overlaps) that are random themselves, not words beside a secret."""
        if not self.secret(run):
            return []
        gain = self.gains(run)
        ends = [0, *(x for span in covered for x in span), len(run)]
        return [(a, b) for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b and float(gain[a:b].sum()) >= self.per_character * (b - a)]


def train(docs: DataFrame) -> Model:
    def count(pieces):
        size = SYMBOLS**3
        total = np.zeros((2, size), np.int64)
        for p in pieces:
            plain, secret = [], []
            for text in p["text"]:
                at = 0
                for start, _, end, inner in base_spans(text):
                    if start >= at:
                        plain.append(text[at:start])
                    if end > at:
                        secret.append(text[max(inner, at) : end])
                        at = end
                plain.append(text[at:])
            total[0] += np.bincount(trigrams(CANDIDATE.sub(_ordinary, "\n\n".join(plain)).encode("utf-8", "surrogatepass")), minlength=size)
            total[1] += np.bincount(trigrams("\n\n".join(secret).encode("utf-8", "surrogatepass")), minlength=size)
        cells = np.flatnonzero(total.any(0))
        yield {"cell": cells, "ordinary": total[0, cells], "secret": total[1, cells]}

    cells = arrow_map(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), count, "cell int, ordinary long, secret long")
    counts = np.zeros((2, SYMBOLS**3))
    for r in cells.groupBy("cell").agg(F.sum("ordinary").alias("o"), F.sum("secret").alias("s")).toLocalIterator():  # one row per cell: a fixed bound
        counts[:, r["cell"]] = r["o"], r["s"]
    return Model((smoothed(counts[1], 0.5) - smoothed(counts[0], 0.0)).astype(np.float32))


def all_spans(text: str, model: Model) -> list[tuple[int, int, int]]:
    """(start, kind, end): the patterns' spans, and runs that the models add, by start, then kind."""
    base = base_spans(text)
    spans = [(s, k, e) for s, k, e, _ in base]
    taken: list[tuple[int, int]] = []  # what the patterns cover, overlaps merged
    for s, _, e, _ in base:
        if taken and s <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], e))
        else:
            taken.append((s, e))
    i = 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        covered = []
        for k in range(i, len(taken)):
            if taken[k][0] >= e:
                break
            covered.append((max(taken[k][0], s) - s, min(taken[k][1], e) - s))
        spans += [(s + a, 3, s + b) for a, b in model.rest(m.group(), covered)]
    return sorted(spans)


def joined(spans: Iterator[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """The columns ``keep``, n_assign, n_access, n_hex, base_sha256, spans, n_markov for every row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(pieces):
        for p in pieces:
            made = {**{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
            for text in p.pop("_text"):
                spans = all_spans(text, handle.value)
                for i, k in enumerate(KINDS):
                    made[f"n_{k}"].append(sum(x[1] == i for x in spans))
                made["base_sha256"].append(hashlib.sha256(joined(x for x in spans if x[1] < 3).encode()).hexdigest())
                made["spans"].append(joined(spans))
            yield {**p, **made}

    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n != "_text")
    return arrow_map(rows, run, f"{schema}n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def masked(docs: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark`` and ``n_chars`` brought up to date; other columns as they are."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(pieces):
        for p in pieces:
            texts, sizes = [], []
            for text, n in zip(p["text"], p["n_chars"], strict=True):
                out, at = [], 0
                for s, _, e in all_spans(text, handle.value) if text else ():
                    if e > at:
                        out += [text[at:s], mark] if s >= at else []
                        at = max(at, e)
                if out:
                    text = "".join(out) + text[at:]
                    n = len(text)
                texts.append(text)
                sizes.append(n)
            yield {**p, "text": texts, "n_chars": sizes}

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return arrow_map(docs, run, schema)
