"""URL filter: glob rules as one bit-parallel automaton over each canonical URL.

All rules are packed into multiword Shift-And masks.  A rule with m tokens owns m + 1
neighbouring bits (how many tokens are matched), wildcards are self-loops, and one step
per character moves every state of every rule of every URL in the batch:

    D = ((D << 1) & next[c]) | (D & loop[c])

Globs: ``*`` any run without ``/``, ``**`` any run, ``?`` one character but ``/``;
everything else stands for itself.  The canonical URL is ``.host/path``: the scheme, user
query and fragment are gone and the host is in lower case, so that ``*.example.com/en/**``
is a host with all its subdomains and a path prefix.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no
rule; very long URLs run in smaller batches; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import arrow_map, ascii_lower


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


# The rules of the contract, and the globs that decide where no rule fits.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
SPAM_GLOBS = ("*.*spam*/**", "*.*pills*/**", "*.*casino*/**")

CELLS = 4_000_000


class GlobSet:
    """Compiled masks of a list of globs; :meth:`match` gives a boolean per URL and glob."""

    def __init__(self, globs: Sequence[str]):
        plans, literals = [], {"/"}
        for g in globs:
            tokens, loops, i = [], {}, 0
            while i < len(g):
                if g[i] == "*":
                    wide = g[i : i + 2] == "**"
                    loops[len(tokens)] = loops.get(len(tokens), False) or wide
                    i += 1 + wide
                else:
                    tokens.append(None if g[i] == "?" else g[i])
                    literals.add(g[i])
                    i += 1
            plans.append((tokens, loops))
        self.letters = np.array(sorted(map(ord, literals)), np.uint32)
        size = sum(len(t) + 1 for t, _ in plans)
        self.words = max(1, -(-size // 64))
        symbols = len(self.letters) + 1  # the last symbol stands for every other character
        self.next = np.zeros((symbols, self.words), np.uint64)
        self.loop = np.zeros((symbols, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = []
        slash = int(np.searchsorted(self.letters, ord("/")))
        base = 0
        for tokens, loops in plans:
            self._set(self.start, base)
            for j, t in enumerate(tokens, 1):
                for s in range(symbols) if t is None else (int(np.searchsorted(self.letters, ord(t))),):
                    if t is not None or s != slash:
                        self._set(self.next[s], base + j)
            for j, wide in loops.items():
                for s in range(symbols):
                    if wide or s != slash:
                        self._set(self.loop[s], base + j)
            self.final.append(base + len(tokens))
            base += len(tokens) + 1

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == points
        return np.where(known, at, len(self.letters)).astype(np.int16)

    def match(self, texts: Sequence[str]) -> np.ndarray:
        hit = np.zeros((len(texts), len(self.final)), bool)
        codes = [self.symbols(t) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(codes[i]))
        at = 0
        while at < len(order):
            width = max(1, len(codes[order[at]]))
            part = order[at : at + max(1, CELLS // width)]
            at += len(part)
            hit[part] = self._run([codes[i] for i in part], width)
        return hit

    def _run(self, codes: list[np.ndarray], width: int) -> np.ndarray:
        """Codes come longest first, so the URLs still running are always a prefix."""
        sizes = np.array([len(c) for c in codes])
        grid = np.full((width, len(codes)), len(self.letters), np.int16)
        for i, c in enumerate(codes):
            grid[: len(c), i] = c
        state = np.repeat(self.start[None], len(codes), 0)
        one, top = np.uint64(1), np.uint64(63)
        for t in range(width):
            n = int(np.searchsorted(-sizes, -t, "left"))
            if not n:
                break
            c, d = grid[t, :n], state[:n]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:n] = (moved & self.next[c]) | (d & self.loop[c])
        words = np.array(self.final) // 64
        bits = (np.array(self.final) % 64).astype(np.uint64)
        return ((state[:, words] >> bits) & one).astype(bool)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path of a URL; both empty for null or without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, block_globs: Sequence[str] = SPAM_GLOBS) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict, spam_glob (that decided instead).

    Without a fitting rule, a URL that any of ``block_globs`` matches is blocked and every other one allowed.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = GlobSet([r.glob for r in ranked] + list(block_globs))

    def run(pieces):
        for p in pieces:
            hit = globs.match([f".{h}{q}" for h, q in zip(p["host"], p["path"], strict=True)])
            rule, verdict, glob = [], [], []
            for row in hit:
                first = int(row.argmax()) if row.any() else -1
                own = ranked[first] if 0 <= first < len(ranked) else None
                rule.append(own and own.name)
                glob.append(block_globs[first - len(ranked)] if first >= len(ranked) else None)
                verdict.append(own.verdict if own else "block" if first >= 0 else "allow")
            yield {**p, "rule": rule, "verdict": verdict, "spam_glob": glob}

    host, path = url_parts(F.col("url"))
    return arrow_map(
        pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")),
        run, "page_id long, host string, path string, rule string, verdict string, spam_glob string", rows=4096,
    )


URL_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), h AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw, r FROM p
), u AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path
  FROM h
), f AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM u
), g AS (
  SELECT *, CASE WHEN rule IS NOT NULL OR NOT starts_with(path, '/') THEN NULL
    WHEN host LIKE '%spam%' THEN '*.*spam*/**'
    WHEN host LIKE '%pills%' THEN '*.*pills*/**'
    WHEN host LIKE '%casino%' THEN '*.*casino*/**'
  END AS spam_glob FROM f
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL OR spam_glob IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       spam_glob
FROM g
"""
