"""Vector bin packing of tokenised documents under limits on tokens, segments and loss tokens.

One pass: a task tokenises its documents, cuts off full sequences, and keeps the rests in
a buffer.  Whenever the buffer is full it is packed bin by bin with the dot-product
heuristic: of all items that fit, take the one whose demand vector has the largest inner
product with what the bin has left, both measured in shares of the limits.  When nothing
fits, the largest rest is cut to fill the gap, so a bin normally closes without padding.
Bins that stay short at the end of a partition are cut into lengths that are powers of two,
which need no padding.

Nothing is shuffled: memory is bounded by the buffer, and a lost task is repeated with the
same result, as sequence ids come from the partition's number and its order.

Defined cases: a null or empty text has the end token only; a text of any length is cut;
equal rows are packed one by one; ties go to the item that came first; an empty table
gives no rows.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docloom.llm.base import arrow_map, documents

TOKENIZER_FILE = "word_bpe_49k.json"
CACHE_ENTRIES = 300_000
CACHED_LENGTH = 48


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 64
    loss_tokens: int = 4096


@dataclass
class Piece:
    """Consecutive tokens of one document; the first token of a piece bears no loss unless it has context."""

    doc: int
    start: int
    ids: np.ndarray
    total: int
    lossless: int = 1

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, max(0, len(self.ids) - self.lossless)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, self.ids[:n], self.total, self.lossless)
        return head, Piece(self.doc, self.start + n, self.ids[n:], self.total, self.lossless)


def pack(pieces: list[Piece], limits: Limits, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Bins from ``pieces``; unless ``last``, the pieces of a bin that stays short come back for the next round."""
    bound = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    pieces = list(pieces)
    size = np.array([p.demand() for p in pieces], float).reshape(-1, 3)
    alive = np.ones(len(pieces), bool)
    bins: list[list[Piece]] = []
    while alive.any():
        left, own, used = bound.copy(), [], []
        while True:
            fits = alive & (size <= left).all(1)
            reserve = left[1] == 1 and left[0] < limits.tokens  # the last segment closes the gap if a rest can
            if reserve:
                fits &= size[:, 0] == left[0]
            if fits.any():
                score = np.where(fits, (size / bound) @ (left / bound), -1.0)
                i = int(score.argmax())
                own.append(pieces[i])
                used.append(i)
                left -= size[i]
                alive[i] = False
                if left[0] == 0 or left[1] == 0:
                    break
                continue
            gap = int(min(left[0], left[2]))
            i = int(np.where(alive, size[:, 0], -1.0).argmax()) if alive.any() else -1
            if gap <= 0 or left[1] < 1 or i < 0:
                break
            if size[i, 0] <= gap:  # reserve held it back, or only its loss tokens were too many
                take = i if (size[i] <= left).all() else -1
                if take < 0:
                    break
                own.append(pieces[i])
                used.append(i)
                left -= size[i]
                alive[i] = False
                continue
            head, rest = pieces[i].cut(gap)
            own.append(head)
            left -= np.array(head.demand(), float)
            pieces[i] = rest
            size[i] = rest.demand()
        if left[0] > 0 and not last and not alive.any():
            return bins, own
        bins.append(own)
    return bins, []


def sequences(bins: list[list[Piece]], limits: Limits) -> Iterator[list[Piece]]:
    """Full bins as they are; a short one as sequences whose lengths are powers of two."""
    for own in bins:
        total = sum(len(p.ids) for p in own)
        if total == limits.tokens:
            yield own
            continue
        queue = list(own)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            out = []
            while room:
                p = queue.pop(0)
                if len(p.ids) > room:
                    p, rest = p.cut(room)
                    queue.insert(0, rest)
                out.append(p)
                room -= len(p.ids)
            yield out


#: A run of letters, then a run of marks: two parts for the tokenizer, both in one byte-level alphabet.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?:;()%*#$&\"-]*)").fullmatch


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible in Latin-1, else the next one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + hidden.index(b)) for b in range(256)]


class _Runs(dict):
    """Ids of runs of letters or marks in lower case, straight from the merge model."""

    def __init__(self, merge):
        super().__init__({"": b""})
        self.merge, self.letters = merge, byte_letters()

    def __missing__(self, run: str) -> bytes:
        shown = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
        made = id_bytes([t.id for t in self.merge(shown)])
        if len(self) < CACHE_ENTRIES and len(run) <= CACHED_LENGTH:
            self[run] = made
        return made


class WordEncoder(dict):
    """Token ids of texts; the parts between blanks are encoded one by one and remembered.

    White space never reaches this tokenizer's model, so the parts between blanks are
    independent.  A plain part (letters, then marks) goes straight to the merge model, letters
    and marks apart and in lower case, which is what the tokenizer's own steps give; every
    other part takes those steps.  Frequent parts come early, so a full memory simply takes
    no more.
    """

    def __init__(self, path: str):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.steps = Tokenizer.from_file(path)
        self.runs = _Runs(self.steps.model.tokenize)

    def __missing__(self, part: str) -> bytes:
        plain = PLAIN(part)
        made = self.runs[plain[1].lower()] + self.runs[plain[2]] if plain else id_bytes(self.steps.encode(part, add_special_tokens=False).ids)
        if len(self) < CACHE_ENTRIES and len(part) <= CACHED_LENGTH:
            self[part] = made
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]


def id_bytes(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(), buffer: int = 512) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens."""

    def run(pieces):
        context = TaskContext.get()
        number = context.partitionId() << 36 if context else 0
        words, held = encoder(tokenizer_path), []
        end = np.array([end_id], "<u4").tobytes()
        rows: dict[str, list] = {}

        def fresh():
            return {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")}

        def place(group):
            nonlocal number
            at = 0
            for p in group:
                for k, v in zip(rows, (p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, number, at, p.demand()[2]), strict=True):
                    rows[k].append(v)
                at += len(p.ids)
            number += 1

        for batch in pieces:
            rows = fresh()
            for doc, raw in zip(batch["doc_id"], words.encode(batch["text"]), strict=True):
                ids = np.frombuffer(raw + end, "<u4")
                whole = len(ids) // limits.tokens * limits.tokens if limits.loss_tokens >= limits.tokens else 0
                for at in range(0, whole, limits.tokens):
                    place([Piece(doc, at, ids[at : at + limits.tokens], len(ids))])
                if whole < len(ids):
                    held.append(Piece(doc, whole, ids[whole:], len(ids)))
            if len(held) >= buffer:
                bins, held = pack(held, limits, last=False)
                for group in sequences(bins, limits):
                    place(group)
            yield rows
        rows = fresh()
        bins, _ = pack(held, limits, last=True)
        for group in sequences(bins, limits):
            place(group)
        yield rows

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    return arrow_map(documents(docs), run, schema, rows=128)
