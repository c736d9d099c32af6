"""Hidden Markov language model: Baum-Welch over the whole corpus, exact scores by forward recursion.

Symbols.  Words are lower-cased (A-Z) runs between ASCII white space, then one end.  A word
that makes up at least 1 / HEAD_SHARE of the training tokens is a symbol of its own (so there
are at most HEAD_SHARE of them, by arithmetic); the others fall into CLASSES ending classes.
A state emits a symbol, and a class emits its words by their smoothed training counts.  As
that last factor does not depend on the state,

    log P(text) = forward(symbols) + sum over rare words of log P(word | class),

so the recursion needs a table of fixed size, and rare words meet their counts in one join.

Training.  Word counts come from all training texts.  Each Baum-Welch pass runs over the
training texts in segments of at most SEGMENT tokens; every task adds up its expected counts,
Spark sums them by symbol, and only that bounded table reaches the driver.  Passes go on until
one gains less than GAIN of log-likelihood a token.

Scoring is exact: a scaled forward recursion over the whole text, many texts at a time.

Defined cases: a null or empty text is the end alone; an id that is null counts as the empty
string for the fold; equal rows get equal scores; an unseen word has its class's share of the
unseen; without training texts every token has the base share of one word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import Scratch, arrow_map, documents, id_remainder

END = b"\n"  # no word holds a line feed
ALPHA = 0.1
CLASSES = 4096
HEAD_SHARE = 1 << 17  # symbols of their own
KNOWN_SHARE = 1 << 20  # words whose counts every task holds
STATES = 6
SEGMENT = 512
FIT = -2 - STATES  # row of the log-likelihood, after those of the moves
GAIN = 0.005  # natural logarithm a token
FLUSH = 150_000
TRAIN_TOKENS, SCORE_TOKENS, BATCH_TEXTS = 600_000, 2_000_000, 8192  # training keeps every step's state shares, scoring only the last


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_class(word: bytes) -> int:
    """Class of a rare word: words that end alike share one."""
    return zlib.crc32(word[-3:]) % CLASSES


def word_counts(training: DataFrame) -> DataFrame:
    """word (binary, END for ends) and its count n, added up before the shuffle."""

    def run(pieces):
        seen: Counter = Counter()

        def out():
            return {"word": list(seen), "n": list(seen.values())}

        for p in pieces:
            for text in p["text"]:
                seen.update(tokens(text))
            seen[END] += len(p["text"])
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        yield out()

    return arrow_map(training, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What a task knows of the training counts."""

    train_tokens: int
    distinct: int
    index: dict[bytes, int]  # frequent words, most frequent first
    counts: np.ndarray
    symbols: np.ndarray  # symbol of each frequent word
    inner: np.ndarray  # log10 P(word | symbol) of each frequent word
    heads: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    prior: np.ndarray  # share of each symbol in training

    @property
    def size(self) -> int:
        return self.heads + CLASSES

    def base(self, n):
        return np.log10((n + ALPHA) / (self.train_tokens + ALPHA * (self.distinct + 1)))


def lexicon(counts: DataFrame) -> Lexicon:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, distinct = int(total["n"]), int(total["v"])
    known = counts.where(F.col("n") * KNOWN_SHARE >= n_all).toArrow() if n_all else None  # fewer than KNOWN_SHARE rows
    words = known["word"].to_pylist() if known else []
    n = known["n"].to_numpy() if known else np.zeros(0, np.int64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], n[order].astype(float)
    heads = int((n * HEAD_SHARE >= n_all).sum())
    least = float(n_all) / HEAD_SHARE
    kind = (F.crc32(F.substring("word", -3, 3)) % CLASSES).alias("kind")
    rows = counts.where(F.col("n") < least).groupBy(kind).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # one row per class
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rows:
        class_tokens[r["kind"]], class_words[r["kind"]] = r["n"], r["v"]
    kinds = np.array([word_class(w) for w in words], int)
    at = np.arange(len(words))
    symbols = np.where(at < heads, at, heads + kinds) if len(words) else np.zeros(0, int)
    inner = np.where(at < heads, 0.0, np.log10((n + ALPHA) / (class_tokens[kinds] + ALPHA * (class_words[kinds] + 1)))) if len(words) else np.zeros(0)
    prior = np.concatenate((n[:heads], class_tokens + ALPHA))
    return Lexicon(n_all, distinct, {w: i for i, w in enumerate(words)}, n, symbols.astype(np.int32), inner, heads, class_tokens, class_words, prior / prior.sum())


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Every text as symbols (int32, little-endian), with what frequent words add and the rare words left over."""
    handle = docs.sparkSession.sparkContext.broadcast(lex)

    def run(pieces):
        x = handle.value
        get, base = x.index.get, x.base(x.counts)
        missing = [-1]
        for p in pieces:
            made = {k: [] for k in ("n_tokens", "known", "base", "inner", "symbols", "words", "times")}
            for text in p.pop("text"):
                words = tokens(text)
                words.append(END)
                at = np.fromiter(map(get, words, missing * len(words)), np.int32, len(words))
                hit = at >= 0
                sym = np.empty(len(words), "<i4")
                own = at[hit]
                sym[hit] = x.symbols[own]
                rare = [words[i] for i in np.flatnonzero(~hit)]
                if rare:
                    sym[~hit] = [x.heads + zlib.crc32(w[-3:]) % CLASSES for w in rare]
                left = Counter(rare)
                for k, v in (("n_tokens", len(words)), ("known", len(own)), ("base", float(base[own].sum())), ("inner", float(x.inner[own].sum())),
                             ("symbols", sym.tobytes()), ("words", list(left)), ("times", list(left.values()))):
                    made[k].append(v)
            yield {**p, **made}

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    return arrow_map(rows, run, f"{schema}, n_tokens long, known long, base double, inner double, symbols binary, words array<binary>, times array<int>")


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def first_model(lex: Lexicon) -> Hmm:
    """Sticky states whose emissions are the training shares with fixed pseudo-random tilts."""
    rng = np.random.default_rng(7)
    tilt = lex.prior[:, None] * np.exp(1.0 * rng.standard_normal((lex.size, STATES)))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Hmm(np.full(STATES, 1 / STATES), move, tilt / tilt.sum(0))


def batches(pieces, column: str, enough: int):
    """Piece columns gathered until they hold ``enough`` tokens."""
    held: dict[str, list] = {}
    size = 0
    for p in pieces:
        for k, v in p.items():
            held.setdefault(k, []).extend(v)
        size += sum(map(len, p[column])) // 4
        if size >= enough or len(held[column]) >= BATCH_TEXTS:
            yield held
            held, size = {}, 0
    if held:
        yield held


def side_by_side(sequences: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order by length, longest first, and for each time step the symbols of the sequences still running."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.concatenate([sequences[i] for i in order])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    running = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # sequences longer than t
    return order, [flat[begin[:n] + t] for t, n in enumerate(running)]


def expected(model: Hmm, sequences: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected emission (symbols x states), transition and start counts."""
    return sweeps(model, sequences, size)[:3]


def sweeps(model: Hmm, sequences: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts, and the log-likelihood: one forward and one backward sweep."""
    _, steps = side_by_side(sequences)
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    alphas, scales, seen = [], [], []
    a = None
    for t, s in enumerate(steps):
        e = emit[s]
        a = (model.start.astype(np.float32) if t == 0 else a[: len(s)] @ move) * e
        c = np.maximum(a.sum(1, keepdims=True), np.float32(1e-30))
        a = a / c
        alphas.append(a)
        scales.append(c)
        seen.append(e)
    beta = np.ones_like(alphas[0])
    moves = np.zeros((STATES, STATES))
    gammas = [alphas[-1]]
    for t in range(len(steps) - 1, 0, -1):
        n = len(steps[t])
        back = seen[t] * beta[:n] / scales[t]
        moves += alphas[t - 1][:n].T @ back
        beta[:n] = back @ move.T
        gammas.append(alphas[t - 1] * beta[: len(alphas[t - 1])])
    gammas.reverse()
    flat = np.concatenate(steps)
    gamma = np.concatenate(gammas)
    counts = np.stack([np.bincount(flat, weights=gamma[:, k], minlength=size) for k in range(STATES)], 1)
    return counts, moves * model.move, gammas[0].sum(0), float(np.log(np.concatenate(scales), dtype=np.float64).sum())


def baum_welch(training: DataFrame, model: Hmm, lex: Lexicon) -> tuple[Hmm, float]:
    """One pass over ``training`` (column symbols), and the log-likelihood of the model before it."""
    handle = training.sparkSession.sparkContext.broadcast(model)
    size = lex.size
    names = [f"c{k}" for k in range(STATES)]

    def run(pieces):
        emit, move, start, total = np.zeros((size, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES), 0.0
        for held in batches(pieces, "symbols", TRAIN_TOKENS):
            parts = [s[i : i + SEGMENT] for s in (np.frombuffer(b, "<i4") for b in held["symbols"]) for i in range(0, len(s), SEGMENT)]
            e, m, b, fit = sweeps(handle.value, parts, size)
            emit, move, start, total = emit + e, move + m, start + b, total + fit
        at = np.flatnonzero(emit.any(1))
        table = np.concatenate((emit[at], move, start[None], np.full((1, STATES), total)))
        label = np.concatenate((at, -2 - np.arange(STATES), [-1, FIT]))
        yield {"symbol": label, **{n: table[:, k] for k, n in enumerate(names)}}

    sums = arrow_map(training.select("symbols"), run, "symbol int, " + ", ".join(f"{n} double" for n in names))
    table = sums.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # one row per symbol and state
    label = table["symbol"].to_numpy()
    values = np.stack([table[n].to_numpy() for n in names], 1) if len(label) else np.zeros((0, STATES))
    emit = np.zeros((size, STATES))
    emit[label[label >= 0]] = values[label >= 0]
    move, start, total = np.ones((STATES, STATES)), np.ones(STATES), 0.0
    for x, v in zip(label, values, strict=True):
        if x == FIT:
            total = float(v[0])
        elif x <= -2:
            move[-2 - x] += v
        elif x == -1:
            start += v
    back = 50.0  # pseudo-tokens of the training shares in every state
    emit = (emit + back * lex.prior[:, None]) / (emit.sum(0) + back)
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit), total


def train(training: DataFrame, lex: Lexicon) -> Hmm:
    """Baum-Welch over ``training`` until a pass gains less than GAIN a token."""
    model, before = first_model(lex), -math.inf
    while True:
        model, now = baum_welch(training, model, lex)
        if now - before < GAIN * max(1, lex.train_tokens):
            return model
        before = now


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each sequence, scaled at every step."""
    order, steps = side_by_side(sequences)
    total = np.zeros(len(sequences))
    a = None
    for t, s in enumerate(steps):
        a = (model.start if t == 0 else a[: len(s)] @ model.move) * model.emit[s]
        c = a.sum(1)
        a = a / c[:, None]
        total[: len(s)] += np.log10(c)
    out = np.empty(len(sequences))
    out[order] = total
    return out


def score_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    rows = documents(docs).withColumn("held_out", id_remainder(F.col("doc_id"), 10) == 0)
    counts = scratch.store(word_counts(rows.where(~F.col("held_out")).select("text")))
    lex = lexicon(counts)
    encoded = scratch.store(encode(rows, lex))

    model = train(encoded.where(~F.col("held_out")), lex)

    handle = spark.sparkContext.broadcast(model)

    def run(pieces):
        for held in batches(pieces, "symbols", SCORE_TOKENS):
            held["states"] = forward(handle.value, [np.frombuffer(b, "<i4") for b in held.pop("symbols")])
            yield held

    scored = arrow_map(
        encoded.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "symbols"), run,
        "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, states double",
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    kind = (F.crc32(F.substring("word", -3, 3)) % CLASSES).cast("int")
    inside = F.array(*[F.lit(float(v)) for v in lex.class_tokens + ALPHA * (lex.class_words + 1)])
    rare = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare = (
        rare.join(counts, "word", "left")
        .select(
            "row", F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"),
            (F.col("times") * (F.log10(n + ALPHA) - F.lit(math.log10(lex.train_tokens + ALPHA * (lex.distinct + 1))))).alias("base"),
            (F.col("times") * (F.log10(n + ALPHA) - F.log10(F.get(inside, kind)))).alias("inner"),
        )
        .groupBy("row").agg(F.sum("known").alias("r_known"), F.sum("base").alias("r_base"), F.sum("inner").alias("r_inner"))
    )
    zero = F.lit(0.0)
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("r_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lex.train_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"),
        (F.col("states") + F.col("inner") + F.coalesce("r_inner", zero)).alias("score"),
    )
