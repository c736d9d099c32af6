"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field labels the words of a passage as outside, or as the first or a further word of an
e-mail address, an IP address, a card number or a phone number.  Its features are word shapes
(letters, digits by number, marks), the number of digits and known cue words, of the word itself
and of both neighbours.  It is trained on the driver from a small labelled table (at most
``ROWS`` rows, the ones with the least hash) by gradient ascent of the penalised likelihood, and
decoded by Viterbi, all passages of a batch at once.

A passage is a stretch of words in one line: every word with a digit, ``@``, ``+`` or a bracket, or a
spelt-out dot, and ``REACH`` words on both sides.  Other words are outside by definition; they are
found by byte masks and never touched one by one.

Defined cases: a null or empty text has no spans; texts of any length are scanned whole; spans count
code points, end exclusive; of an added span only the parts that no pattern covers are reported,
where they hold ``LEAST`` letters or digits and, if a pattern covers the rest, a digit or ``@``; equal rows get equal answers; an empty table gives no rows;
with no labelled rows nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.base import arrow_map

# The patterns of the contract, written so that each character is looked at a bounded number of times.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"crf_{k}" for k in KINDS)

ROWS = 2000  # labelled rows to learn from, at most
REACH = 3  # words of context on both sides
LEAST = 4
LABELS = 1 + 2 * len(KINDS)  # outside; first and further words of each kind
SPELT_DOTS = (b" dot ", b" punkt ", b" punto ", b" point ")
KNOWN_WORDS = 200_000


# ------------------------------------------------------------------ patterns
def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def luhn(digits: str) -> bool:
    return not sum(d if (len(digits) - i) % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits))) % 10


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 40 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# ------------------------------------------------------------------ features
_EDGE = "\"'`,;:!?.*#$%&<>{}|=~^\\/_"
_PART = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_MARKS = "@.+-()[]:/%"


def shapes(word: str) -> tuple[str, str]:
    """The word's shape with the lengths of its runs of digits, and a coarser one without lengths or repeats."""
    fine, coarse = [], []
    for p in _PART.findall(word[:80]):
        if "0" <= p[0] <= "9":
            n = len(p)
            fine.append(f"d{n if n < 5 else '6' if n < 7 else '8' if n < 9 else '12' if n < 13 else '19' if n < 20 else '+'}")
            coarse.append("d")
        elif p.isalpha():
            fine.append("A" if p.isupper() else "a")
            coarse.append("a")
        else:
            fine.append(p if p in _MARKS else "?")
            coarse.append(fine[-1])
    short = [c for i, c in enumerate(coarse) if i < 2 or coarse[i - 2 : i] != coarse[i : i + 2]]
    return "".join(fine[:16]), "".join(short[:10])


def features(word: str, cues: frozenset[str]) -> tuple[list[str], list[str]]:
    """Features of a word for itself, and those that its neighbours see."""
    core = word.strip(_EDGE)
    fine, coarse = shapes(core)
    n = sum("0" <= c <= "9" for c in core[:80])
    amount = f"n={n if n < 5 else '5' if n < 7 else '7' if n < 10 else '10' if n < 13 else '13' if n < 20 else '+'}"
    low = core.lower().strip("()[]")
    known = f"w={low}" if low in cues else "w=*" if low.isalpha() else "w="
    seen = [known, f"c={coarse}", amount]
    return [*seen, f"s={fine}", f"b={core[:1] if core[:1] in _MARKS else ''}", f"m={'@' in core}{core.count('.') > 0}{low.isalpha()}"], seen


@dataclass
class Field:
    """Weights of the features for the word (0), the one before (1) and the one after (2), and of label pairs."""

    cues: frozenset[str]
    weight: dict[tuple[int, str], np.ndarray]
    move: np.ndarray
    begin: np.ndarray
    finish: np.ndarray
    known: dict[bytes, int] = field(default_factory=dict)
    table: list[np.ndarray] = field(default_factory=list)  # three rows of label scores per distinct set of features
    sets: dict[tuple, int] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "table": [], "sets": {}}

    def classes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear(), self.table.clear(), self.sets.clear()
        for w in words:
            if w not in self.known:
                own, seen = features(w.decode("utf-8", "replace"), self.cues)
                key = (*own,)
                if key not in self.sets:
                    self.sets[key] = len(self.table)
                    none = np.zeros(LABELS)
                    self.table.append(np.stack([sum((self.weight.get((k, f), none) for f in fs), none) for k, fs in enumerate((own, seen, seen))]))
                self.known[w] = self.sets[key]
        return np.array([self.known[w] for w in words], np.int64)

    def labels(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """The best label of every word; ``sizes`` says how many words each passage has."""
        if not len(words):
            return np.empty(0, np.int64)
        at = self.classes(words)
        table = np.stack(self.table)
        first = np.cumsum(sizes) - sizes
        score = table[at, 0]
        inner = np.ones(len(at), bool)
        inner[first] = False
        score[inner] += table[at[:-1], 1][inner[1:]]
        score[:-1][inner[1:]] += table[at[1:], 2][inner[1:]]
        return viterbi(score, sizes, self.move, self.begin, self.finish)


def viterbi(score: np.ndarray, sizes: np.ndarray, move: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> np.ndarray:
    """Best label paths of passages that lie one after another in ``score``; of equal labels the smaller."""
    order = np.argsort(-sizes, kind="stable")
    first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    best = score[first] + begin
    back = np.zeros(score.shape, np.int8)
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")  # passages with a word at each place
    for t in range(1, int(size[0])):
        n = active[t]
        ways = best[:n, :, None] + move
        back[first[:n] + t] = ways.argmax(1)
        best[:n] = ways.max(1) + score[first[:n] + t]
    label = (best + finish).argmax(1)
    out = np.zeros(len(score), np.int64)
    for t in range(int(size[0]) - 1, -1, -1):
        n = active[t]
        out[first[:n] + t] = label[:n]
        label[:n] = back[first[:n] + t, label[:n]] if t else label[:n]
    return out


# ------------------------------------------------------------------ passages
def _byte_mask(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[np.frombuffer(chars, np.uint8)] = True
    return mask


_BLANK = _byte_mask(bytes(range(33)))
_MARK = _byte_mask(b"0123456789@+[(")


@dataclass
class Passages:
    """Words of all passages of a batch of texts: bytes from-to in the joined texts, and passage sizes."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    sizes: np.ndarray
    point: np.ndarray  # code points before each byte
    text_at: np.ndarray  # first byte of each text

    def words(self) -> list[bytes]:
        return [self.raw[s:e] for s, e in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def passages(texts: list[str]) -> Passages:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(parts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    marked = np.zeros(len(start), bool)
    if len(start):
        marked = np.logical_or.reduceat(_MARK[data], start)
        for dot in SPELT_DOTS:
            at = raw.find(dot)
            while at >= 0:
                marked[np.searchsorted(start, at + 1)] = True
                at = raw.find(dot, at + 1)
    line = np.cumsum(data == 10)[start] if len(start) else start
    near = np.zeros(len(start) + 1, np.int64)
    hits = np.flatnonzero(marked)
    np.add.at(near, np.maximum(hits - REACH, np.searchsorted(line, line[hits], "left")), 1)
    np.add.at(near, np.minimum(hits + REACH + 1, np.searchsorted(line, line[hits], "right")), -1)
    kept = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    new = np.r_[True, (np.diff(kept) > 1) | (np.diff(line[kept]) > 0)] if len(kept) else np.empty(0, bool)
    firsts = np.flatnonzero(new)
    sizes = np.diff(np.r_[firsts, len(kept)])
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    text_at = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]]) if parts else np.empty(0, np.int64)
    return Passages(raw, start[kept], end[kept], sizes, point, text_at)


_TRIM = re.compile(rb"[A-Za-z0-9+(\x80-\xff].*[A-Za-z0-9)\x80-\xff]|[A-Za-z0-9\x80-\xff]", re.DOTALL)


def added_spans(texts: list[str], model: Field) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the field finds in each text."""
    made: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    p = passages(texts)
    label = model.labels(p.words(), p.sizes)
    kind = (label + 1) // 2 - 1
    whole = np.zeros(len(label), bool)
    whole[np.cumsum(p.sizes) - p.sizes] = True
    go_on = (label > 0) & (label % 2 == 0) & np.r_[False, kind[1:] == kind[:-1]] & ~whole
    firsts = np.flatnonzero((label > 0) & ~go_on)
    ends = np.flatnonzero((label > 0) & ~np.r_[go_on[1:], False])
    for a, b in zip(firsts.tolist(), ends.tolist(), strict=True):
        at = int(p.start[a])
        m = _TRIM.search(p.raw, at, int(p.end[b]))
        if m:
            text = int(np.searchsorted(p.text_at, at, "right")) - 1
            zero = p.point[p.text_at[text]]
            made[text].append((int(p.point[m.start()] - zero), int(kind[a]), int(p.point[m.end()] - zero)))
    return made


def uncovered(text: str, spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The parts of ``spans`` outside ``base`` that hold enough letters or digits."""
    made, k, covered = [], 0, sorted((s, e) for s, _, e in base)
    for start, kind, end in spans:
        at = start
        while k and covered[k - 1][1] > start:
            k -= 1
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        j = k
        while at < end:
            stop = min(end, covered[j][0]) if j < len(covered) else end
            part = text[at:stop]
            trimmed = part.strip(" ,;:-./")
            told = (at, stop) == (start, end) or any("0" <= c <= "9" or c == "@" for c in trimmed)
            if told and sum(c.isalnum() for c in trimmed) >= LEAST:
                s = at + part.index(trimmed)
                made.append((s, kind, s + len(trimmed)))
            if j >= len(covered):
                break
            at = max(at, covered[j][1])
            j += 1
    return made


# ------------------------------------------------------------------ training
def train(labelled: DataFrame, rows: int = ROWS) -> Field:
    """A field from ``text, spans`` (spans as ``kind:start:end``, comma-joined), of at most ``rows`` distinct rows."""
    few = labelled.select(F.col("text").cast("string").alias("text"), F.col("spans").cast("string").alias("spans")).where("text is not null").distinct()
    few = few.orderBy(F.xxhash64("text", "spans"), "text", "spans").limit(rows).collect()
    return fit([(r["text"], r["spans"] or "") for r in few])


def _labelled(text: str, spans: str) -> tuple[Passages, np.ndarray]:
    p = passages([text])
    label = np.zeros(len(p.start), np.int64)
    for s in filter(None, spans.split(",")):
        kind, a, b = s.split(":")
        inside = np.flatnonzero((p.point[p.end] > int(a)) & (p.point[p.start] < int(b)))
        label[inside] = 2 + 2 * KINDS.index(kind)
        label[inside[:1]] -= 1
    return p, label


def fit(rows: list[tuple[str, str]], steps: int = 100, penalty: float = 0.02) -> Field:
    """Penalised maximum likelihood by Adam steps over all passages at once."""
    words, labels, sizes = [], [], []
    for text, spans in rows:
        p, label = _labelled(text, spans)
        words += [w.decode("utf-8", "replace") for w in p.words()]
        labels.append(label)
        sizes += p.sizes.tolist()
    low = [w.strip(_EDGE).lower().strip("()[]") for w in words]
    count: dict[str, int] = {}
    for w in low:
        count[w] = count.get(w, 0) + w.isalpha()
    cues = frozenset(w for w, n in count.items() if n >= 3)
    if not sizes:
        zero = np.zeros(LABELS)
        return Field(cues, {}, np.zeros((LABELS, LABELS)), np.r_[1.0, zero[1:]], zero)
    label, size = np.concatenate(labels), np.array(sizes)
    first = np.cumsum(size) - size
    starts = set(first.tolist())
    number: dict[tuple[int, str], int] = {}
    where: list[tuple[int, int]] = []
    own = [features(w, cues) for w in words]
    for i, (mine, _) in enumerate(own):
        seen = [(0, f) for f in mine]
        seen += [(1, f) for f in own[i - 1][1]] if i not in starts else []
        seen += [(2, f) for f in own[i + 1][1]] if i + 1 < len(own) and i + 1 not in starts else []
        where += [(i, number.setdefault(f, len(number))) for f in seen]
    x = np.zeros((len(words), len(number)), np.float32)
    x[tuple(np.array(where).T)] = 1.0
    true = np.zeros((len(words), LABELS), np.float32)
    true[np.arange(len(words)), label] = 1.0
    k = len(number)
    theta = np.zeros((k + LABELS + 2, LABELS))
    inner = np.ones(len(words), bool)
    inner[first] = False
    seen_moves = np.zeros((LABELS, LABELS))
    np.add.at(seen_moves, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1.0)
    seen_ends = np.stack((true[first].sum(0), true[first + size - 1].sum(0)))
    rise, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        score = (x @ theta[:k].astype(np.float32)).astype(float)
        one, two = _expected(score, size, theta[k : k + LABELS], theta[k + LABELS], theta[-1])
        grad = np.concatenate((x.T @ (true - one.astype(np.float32)), seen_moves - two, seen_ends - np.stack((one[first].sum(0), one[first + size - 1].sum(0))))) - penalty * theta
        rise, spread = 0.9 * rise + 0.1 * grad, 0.99 * spread + 0.01 * grad * grad
        theta += 0.1 * (rise / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    weight = {f: theta[i] for f, i in number.items()}
    return Field(cues, weight, theta[k : k + LABELS], theta[k + LABELS], theta[-1])


def _expected(score: np.ndarray, sizes: np.ndarray, move: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of every word's labels, and expected numbers of label pairs, by scaled forward and backward sums."""
    order = np.argsort(-sizes, kind="stable")
    first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    long = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, long + 1), "right")
    step = np.exp(move)
    local = np.exp(score - score.max(1, keepdims=True))
    alpha, beta = np.zeros_like(local), np.zeros_like(local)
    a = local[first] * np.exp(begin)
    alpha[first] = a / a.sum(1, keepdims=True)
    for t in range(1, long):
        at = first[: active[t]] + t
        a = (alpha[at - 1] @ step) * local[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((LABELS, LABELS))
    beta[first + size - 1] = np.exp(finish)
    for t in range(long - 1, 0, -1):
        at = first[: active[t]] + t
        right = local[at] * beta[at]
        b = right @ step.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
        joint = alpha[at - 1][:, :, None] * step * right[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    one = alpha * beta
    return one / one.sum(1, keepdims=True), pairs


# ------------------------------------------------------------------ labelled table
#: Sentences of the labelled table; a name in braces is filled by rule, the four kinds are labelled.
SENTENCES = [
    "write to {email} today", "mail: {email}", "e-mail {email} or call {phone}", "contact {email}, please", "Kontakt: {email} oder Telefon {phone}",
    "bitte an {email} schreiben", "correo {email} y teléfono {phone}", "envoyez un message à {email} merci", "reach me at {spelt} any time", "schreib an {spelt} bitte",
    "call {phone} now", "tel. {phone}", "Tel: {phone}", "phone {phone} after {time}", "mobile {phone} or {phone}", "fax {phone}", "ring {phone} and ask",
    "Telefon {phone} erreichbar", "rufen Sie {phone} an", "teléfono {phone} por favor", "llame al {phone} hoy", "appelez le {phone} demain", "tél. {phone}", "my number is {phone} thanks",
    "the words {phone} stand here", "these words {card} stand here", "the host {ip} answered", "words {ip} and words", "ping {ip} failed {count} times", "server {ip} port {port}",
    "from {ip} to {ip}", "Adresse {ip} gesperrt", "la dirección {ip} falla", "card {card} expired", "credit card {card} declined", "Karte {card} gesperrt", "tarjeta {card} caducada",
    "carte {card} expirée", "paid with {card} on {date}", "numbers {card} {card} stand here", "visa {card}", "charge {card} for {price}",
    "in {year} there were {count} people", "on {date} at {time}", "the price is {price} for {count} pieces", "version {version} of {year}", "section {section} and page {count}",
    "order {order} shipped on {date}", "Bestellung {order} vom {date}", "between {year} and {year}", "{count}. the first item", "about {share} of all {count}", "see chapter {section} (page {count})",
    "isbn {isbn} printed in {year}", "the code {hex} was used", "commit {hex} by hand", "id {order} of {count}", "({count}) a list item", "zip {zip} town", "en {year} hubo {count} casos", "im Jahr {year} waren es {count}",
    "en {year} il y avait {count} cas", "temperature {decimal} and {decimal}", "position {decimal} {decimal}", "room {count} floor {count}", "the sum {large} was paid", "x + y = {count}", "(see below) and [more]", "words (in brackets) stand here",
    "at noon the dot moved on a point", "the point was clear", "el punto es claro", "der punkt ist klar", "ein text (ohne daten) steht hier", "token {hex} and key {hex}", "{email} et de la ville", "a {email} de que el", "von {email} in de stadt", "words {email} at the com",
    "{phone} et de {count} words", "line {count} column {count}", "{count} + {count} are {count}",
]


class _Filler:
    """Fills the sentences' slots from one stream of whole numbers, the same every time."""

    def __init__(self):
        self.state = 20_231

    def pick(self, n: int) -> int:
        self.state = (self.state * 6_364_136_223_846_793_005 + 1_442_695_040_888_963_407) % (1 << 64)
        return (self.state >> 33) % n

    def digits(self, *groups: int) -> list[str]:
        return ["".join([str(1 + self.pick(9)), *[str(self.pick(10)) for _ in range(n - 1)]]) for n in groups]

    def letters(self, n: int) -> str:
        return "".join([chr(97 + self.pick(26)) for _ in range(n)])

    def fill(self, slot: str) -> str:
        n, d, a = self.pick, self.digits, self.letters
        if slot == "email":
            return [f"{a(5)}@{a(6)}.com", f"{a(3)}.{a(5)}@{a(4)}.example.org", f"{a(4)}{d(2)[0]}@{a(4)}{d(1)[0]}.{a(7)}.com", f"{a(4)}[at]{a(6)}.de", f"{a(5)}(at){a(5)}.com", f"{a(2)}_{a(4)}@{a(5)}", f"{a(5)}@{a(5)},com"][n(7)]
        if slot == "spelt":
            return [f"{a(5)} at {a(6)} dot com", f"{a(5)} (at) {a(6)} (dot) org", f"{a(4)} [at] {a(5)} [dot] de", f"{a(5)} at {a(4)} punkt de", f"{a(4)} @ {a(5)} . com"][n(5)]
        if slot == "phone":
            form = ["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+1 ({}) {}-{}", "{} {} {}", "1-{}-{}-{}"][n(6)]
            other = ["0{} {}", "0{}/{}", "+49 {} {}", "+{}{}", "00{} {}"][n(5)]
            return form.format(*d(3, 3, 4)) if n(3) else other.format(*d(3, 7))
        if slot == "card":
            return [" ", "", "-", "", ""][n(5)].join(d(4, 4, 4, 4)) if n(4) else " ".join(d(4, 6, 5))
        if slot == "ip":
            return ".".join([str(n(256)) for _ in range(4)]) + ["", "", ":8080", "/24"][n(4)]
        return {
            "year": lambda: str(1900 + n(140)), "count": lambda: d(1 + n(4))[0], "port": lambda: d(4)[0], "time": lambda: f"{n(24)}:{10 + n(50)}",
            "date": lambda: [f"{1 + n(28)}.{1 + n(12)}.{1990 + n(40)}", f"{1990 + n(40)}-{10 + n(3)}-{10 + n(18)}", f"{1 + n(12)}/{1 + n(28)}/{1990 + n(40)}"][n(3)],
            "price": lambda: ["${}.{}", "{},{} EUR", "€{}.{}"][n(3)].format(*d(1 + n(4), 2)), "version": lambda: ["{}.{}", "v{}.{}", "{}.{}.0"][n(3)].format(*d(1, 1)),
            "section": lambda: ["{}.{}", "{}.{}.1", "{}({})"][n(3)].format(*d(1, 1)), "order": lambda: ["{}", "A-{}", "#{}"][n(3)].format(d(5 + n(4))[0]), "share": lambda: f"{n(100)}%",
            "isbn": lambda: "978-{}-{}-{}-{}".format(*d(1, 2, 6, 1)), "hex": lambda: "".join(["0123456789abcdef"[n(16)] for _ in range(8 + n(30))]), "zip": lambda: d(5)[0],
            "decimal": lambda: "{}.{}".format(*d(1 + n(2), 1 + n(4))), "large": lambda: ",".join(d(1 + n(3), 3, 3)),
        }[slot]()


def examples(spark: SparkSession, times: int = 6) -> DataFrame:
    """The labelled table ``text, spans``: every sentence ``times`` times, half of them with other words around."""
    fill, rows = _Filler(), []
    for k in range(times):
        for sentence in SENTENCES:
            text, spans = "", []
            for part in re.split(r"(\{\w+\})", sentence):
                if not part.startswith("{"):
                    text += re.sub(r"[^\W\d_]{3,}", lambda m: fill.letters(len(m[0])), part) if k % 2 and fill.pick(2) else part
                    continue
                made, kind = fill.fill(part[1:-1]), {"spelt": "email"}.get(part[1:-1], part[1:-1])
                if kind in KINDS:
                    spans.append(f"{kind}:{len(text)}:{len(text) + len(made)}")
                text += made
            rows.append((text, ",".join(spans)))
    return spark.createDataFrame(rows, "text string, spans string")


# ------------------------------------------------------------------ scan
def joined(spans: Iterator[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Field, *keep: Column) -> DataFrame:
    """The columns ``keep``, the number of base spans of each kind, n_added, base_sha256 and all spans of every row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # its size is bound by the labelled rows

    def run(pieces: Iterator[dict]):
        for p in pieces:
            texts = p.pop("_text")
            made: dict[str, list] = {**{f"n_{k}": [] for k in KINDS}, "n_added": [], "base_sha256": [], "spans": []}
            for text, more in zip(texts, added_spans(texts, handle.value), strict=True):
                base = base_spans(text)
                more = uncovered(text, more, base)
                for i, k in enumerate(KINDS):
                    made[f"n_{k}"].append(sum(x[1] == i for x in base))
                made["n_added"].append(len(more))
                shown = [(s, k, KINDS[k], e) for s, k, e in base]
                made["base_sha256"].append(hashlib.sha256(joined((s, n, e) for s, _, n, e in shown).encode()).hexdigest())
                shown = sorted(shown + [(s, len(KINDS) + k, ADDED[k], e) for s, k, e in more])
                made["spans"].append(joined((s, n, e) for s, _, n, e in shown))
            yield {**p, **made}

    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n != "_text")
    return arrow_map(rows, run, f"{schema}{', '.join(f'n_{k} long' for k in KINDS)}, n_added long, base_sha256 string, spans string")
