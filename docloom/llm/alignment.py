"""Two tokenizers' tokens of the same text, aligned by coalescing byte intervals.

Tokens of both kinds are byte ranges.  Sorted by start (``lexsort``), with the running maximum
of their ends (``maximum.accumulate``), a group of tokens ends where the next start reaches that
maximum; inside a group every pair of ranges that overlap is a link.  Whole batches are
coalesced at once: each piece of text has its own stretch of the byte line.

Both tokenizers part a text before a single blank between two characters that are no blanks,
so such pieces of a text are tokenised, aligned and remembered one by one.  A text with any other
white space beside a blank is tokenised as one piece.

The counts of linked id pairs come from all texts.  The most frequent pairs (at most
``KEPT_PAIRS``) and each B id's greatest count (one row per id) travel to the tasks; rarer pairs
meet their counts in a join, where none of them is hot, since each has at most one
``KEPT_PAIRS``-th of all links.

Defined cases: a null or empty text, and one whose tokens do not spell blank + text byte by byte,
has no tokens: zeros, and ''.  Texts of any length are tokenised whole; equal rows count and
answer one by one, a null doc_id too; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import Scratch, arrow_map, documents
from docloom.llm.packing import byte_letters

A_FILE, B_FILE, RANKS_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
KEPT_PAIRS = 1 << 20
CACHED_PIECES = 300_000
CACHED_LENGTH = 64
FLUSH = 1 << 19  # distinct pairs that a task holds before it hands their counts on
_BEYOND_LATIN = "\u0250"
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_SPACE = "\N{LOWER ONE EIGHTH BLOCK}"


def coalesce(start: np.ndarray, end: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): tokens of both kinds by start, and the number of each one's group of overlapping ranges."""
    order = np.lexsort((second, start))
    reach = np.maximum.accumulate(end[order])
    return order, np.cumsum(np.r_[False, start[order][1:] >= reach[:-1]])


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of all pairs of ranges that overlap; both kinds lie in order and apart."""
    first = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_start, a_end, "left") - first
    a = np.repeat(np.arange(len(a_start)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Aligned(NamedTuple):
    """One piece: numbers of A and B tokens, its groups as text, and its links (A id << 16 | B id) as bytes."""

    n_a: int
    n_b: int
    shown: str
    links: bytes


class TwoTokenizers:
    """Both tokenizers, their tokens' bytes, and the pieces aligned so far."""

    def __init__(self, a_path: str, b_path: str, ranks_path: str | None = None):
        import sentencepiece

        self.a_path, self.full = a_path, None
        value = {letter: byte for byte, letter in enumerate(byte_letters())}
        with open(a_path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        a_bytes = [b""] * (max(entries.values()) + 1)
        for shown, i in entries.items():
            a_bytes[i] = bytes([value[c] for c in shown]) if all(c in value for c in shown) else shown.encode()
        self.ranked = ranked(ranks_path) if ranks_path else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)]
        #: no piece goes on over a blank, so a text may be parted before one
        self.parts = not any(_SPACE in p.lstrip(_SPACE) for p in names)
        self.bytes = (a_bytes, b_bytes)
        self.size = tuple(np.array([len(x) for x in own], np.int64) for own in self.bytes)
        #: every id as text with what may follow it: more of its kind, the other kind, the next group, nothing
        self.shown = [[f"{i}{mark}" for i in range(max(map(len, self.bytes)))] for mark in (",", "|", ";", "")]
        self.known: dict[str, Aligned | None] = {}

    def a_ids(self, text: str) -> list[int]:
        """A's ids of blank + text; the ranks of the same vocabulary give them sooner where letters are Latin."""
        if self.ranked is not None and (text.isascii() or max(text) < _BEYOND_LATIN):
            return self.ranked.encode_ordinary(" " + text)
        if self.full is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.a_path)
            self.full.encode_special_tokens = True
        return self.full.encode(" " + text, add_special_tokens=False).ids

    def align(self, pieces: list[str]) -> list[Aligned | None]:
        """Each piece behind a blank, all in one go; None where one kind's tokens do not spell it."""
        joined = " ".join(pieces)
        raw = b" " + joined.encode()
        ids = [np.array(self.a_ids(joined), np.int64), np.array(self.b.encode(joined), np.int64)]
        if any(b"".join([table[t] for t in own.tolist()]) != raw for own, table in zip(ids, self.bytes, strict=True)):
            half = len(pieces) // 2
            return self.align(pieces[:half]) + self.align(pieces[half:]) if half else [None]
        ends = [np.cumsum(size[own]) for own, size in zip(ids, self.size, strict=True)]
        starts = [np.r_[0, e[:-1]] for e in ends]
        kind = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
        order, group = coalesce(np.concatenate(starts), np.concatenate(ends), kind)
        by = np.lexsort((kind[order], group))  # A's tokens of a group, then B's
        order, group = order[by], group[by]
        kind, own = kind[order], np.concatenate(ids)[order]
        edge = np.cumsum([0, *[len(p.encode()) + 1 for p in pieces]])  # where pieces start on the byte line
        at = np.searchsorted(np.concatenate(starts)[order], edge)  # starts rise from piece to piece
        mark = np.where(group[1:] != group[:-1], 2, np.where(kind[1:] != kind[:-1], 1, 0))
        mark = np.r_[mark, 3]
        mark[at[1:] - 1] = 3
        shown = [self.shown[m][i] for m, i in zip(mark.tolist(), own.tolist(), strict=True)]
        left, right = overlaps(starts[0], ends[0], starts[1], ends[1])
        links = (ids[0][left] << 16 | ids[1][right]).astype("<u4").tobytes()
        cut = [np.searchsorted(x, edge).tolist() for x in (starts[0], starts[1], starts[0][left])]
        at = at.tolist()
        return [
            Aligned(a1 - a0, b1 - b0, "".join(shown[s0:s1]), links[4 * l0 : 4 * l1])
            for a0, a1, b0, b1, l0, l1, s0, s1 in zip(cut[0], cut[0][1:], cut[1], cut[1][1:], cut[2], cut[2][1:], at, at[1:], strict=False)
        ]

    def pieces(self, text: str) -> list[str]:
        """The text in pieces that both tokenizers treat one by one, with a blank before each; whole if blanks do not stand alone."""
        if not self.parts or text[0].isspace() or text[-1].isspace() or "  " in text:
            return [text]
        if any(c in text and (f" {c}" in text or f"{c} " in text) for c in _WHITE):
            return [text]
        return text.split(" ")

    def texts(self, texts: list[str]) -> list[list[Aligned] | None]:
        """The aligned pieces of each text; None for a text without tokens."""
        parts = [self.pieces(t) if t else [] for t in texts]
        known = self.known
        fresh = {p: None for own in parts if len(own) > 1 for p in own if p not in known}
        new = dict(zip(fresh, self.align(list(fresh)), strict=True)) if fresh else {}
        out = []
        for own in parts:
            found = self.align(own) if len(own) == 1 else [new[p] if p in new else known[p] for p in own]
            out.append(None if not found or None in found else found)
        if len(known) < CACHED_PIECES:
            known.update({p: a for p, a in new.items() if len(p) <= CACHED_LENGTH})
        return out


def ranked(path: str):
    """The byte-level vocabulary as ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_LOADED: dict[tuple, TwoTokenizers] = {}


def tokenizers(*paths: str | None) -> TwoTokenizers:
    """One pair per worker process."""
    if paths not in _LOADED:
        _LOADED[paths] = TwoTokenizers(*paths)
    return _LOADED[paths]


_TABLE = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs binary, counts binary"


def _aligned(docs: DataFrame, *paths: str | None) -> DataFrame:
    """One row per document with its links; and, without row_id, rows of pairs with how often a task has met them."""
    names = [c.split(" ")[0] for c in _TABLE.split(", ")]

    def counted(pairs: np.ndarray, counts: np.ndarray) -> dict:
        row = {k: [None] for k in names}
        return {**row, "pairs": [pairs.astype("<u4").tobytes()], "counts": [counts.astype("<i8").tobytes()]}

    def run(batches: Iterator[dict]):
        context = TaskContext.get()
        number = context.partitionId() << 36 if context else 0
        both = tokenizers(*paths)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = limit = 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in names}
            for doc_id, found in zip(batch["doc_id"], both.texts(batch["text"]), strict=True):
                found = found or []
                links = b"".join([p.links for p in found])
                digest = hashlib.sha256(";".join([p.shown for p in found]).encode()).hexdigest() if found else ""
                n_a, n_b, n_links = sum([p[0] for p in found]), sum([p[1] for p in found]), len(links) // 4
                # of two kinds that both tile a text, every end but the groups' ends starts one more link
                values = (number, doc_id, n_a, n_b, n_a + n_b - n_links, n_links, digest, links, None, None)
                for k, v in zip(names, values, strict=True):
                    rows[k].append(v)
                number += 1
            held.append(np.unique(np.frombuffer(b"".join(rows["links"]), "<u4"), return_counts=True))
            size += len(held[-1][0])
            if size > limit:
                held = [_sums(held)]
                size = len(held[0][0])
                limit = 2 * size + FLUSH // 4
                if size > FLUSH:
                    yield counted(*held.pop())
                    size = limit = 0
            yield rows
        if held:
            yield counted(*_sums(held))

    return arrow_map(documents(docs), run, _TABLE, rows=128)


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs with the sums of their counts."""
    pairs = np.concatenate([p for p, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    own, at = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, counts)
    return own, total


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: how many links of the corpus hold each pair of ids."""

    def run(batches: Iterator[dict]):
        for b in batches:
            for pairs, counts in zip(b["pairs"], b["counts"], strict=True):
                yield {"pair": np.frombuffer(pairs, "<u4").astype(np.int64), "n": np.frombuffer(counts, "<i8")}

    rows = arrow_map(aligned.where("pairs is not null").select("pairs", "counts"), run, "pair long, n long")
    return rows.groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, scratch: Scratch, a_path: str, b_path: str, ranks_path: str | None = None, kept_pairs: int = KEPT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    aligned = scratch.store(_aligned(docs, a_path, b_path, ranks_path))
    counts = scratch.store(_pair_counts(aligned))
    best = np.zeros(1 << 16, np.int64)  # one number per B id
    for r in counts.groupBy(F.col("pair").bitwiseAND(0xFFFF).alias("b")).agg(F.max("n").alias("n")).toLocalIterator():
        best[r["b"]] = r["n"]
    least = _least_kept(counts, kept_pairs)
    frequent = counts.where(F.col("n") >= least).toArrow()  # at most kept_pairs rows
    pairs, n = frequent["pair"].to_numpy().astype(np.uint32), frequent["n"].to_numpy()
    order = np.argsort(pairs)
    handle = spark.sparkContext.broadcast((pairs[order], n[order], best))

    def run(batches: Iterator[dict]):
        own, n, best = handle.value
        for b in batches:
            raw = b.pop("links")
            links = np.frombuffer(b"".join(raw), "<u4")
            doc = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
            at = np.minimum(np.searchsorted(own, links), max(len(own) - 1, 0))
            hit = own[at] == links if len(own) else np.zeros(len(links), bool)
            got = np.where(hit, n[at], 0) if len(own) else np.zeros(len(links), np.int64)
            top = hit & (got == best[links & 0xFFFF])
            rare, times = np.unique(doc[~hit] << 32 | links[~hit].astype(np.int64), return_counts=True)
            cut = np.searchsorted(rare >> 32, np.arange(len(raw) + 1))
            b["count_sum"] = _by_doc(doc, got, len(raw))
            b["n_best"] = _by_doc(doc, top, len(raw))
            b["rare"] = [[{"pair": p, "times": t} for p, t in zip((rare[i:j] & 0xFFFFFFFF).tolist(), times[i:j].tolist(), strict=True)] for i, j in zip(cut, cut[1:], strict=False)]
            yield b

    names = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    rows = aligned.where("row_id is not null").select(*[c.split(" ")[0] for c in names.split(", ")], "links")
    done = arrow_map(rows, run, f"{names}, n_best long, count_sum long, rare array<struct<pair: long, times: long>>")
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least <= 1:  # every pair is among the frequent ones
        return done.select(*result)
    done = scratch.store(done)
    tops = spark.createDataFrame([(i, int(v)) for i, v in enumerate(best) if v], "b int, top long")
    met = done.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.pair", "r.times").join(counts.where(F.col("n") < least), "pair")
    met = met.withColumn("b", F.col("pair").bitwiseAND(0xFFFF).cast("int")).join(F.broadcast(tops), "b")
    more = met.groupBy("row_id").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("_best"))
    both = done.drop("rare").join(more, "row_id", "left")
    return both.withColumns({"count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0))}).select(*result)


def _by_doc(doc: np.ndarray, values: np.ndarray, n: int) -> list[int]:
    """Exact sums of whole numbers per document."""
    total = np.zeros(n, np.int64)
    np.add.at(total, doc, values)
    return total.tolist()


def _least_kept(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` pairs have it or more; counts are looked at by size class."""
    fine = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 1024 - 640)  # at most 1024 + 64 * 53 classes
    sizes = counts.groupBy(fine.cast("int").alias("c")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).collect()
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r["c"]):
        total += r["k"]
        if total > most:
            return least if least is not None else 1 << 62
        least = r["n"]
    return 1 if least is None else min(least, 1)
