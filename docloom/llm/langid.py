"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text in which every run of non-letters
is one blank; weights are (1 + log tf) * idf, scaled to length one.  Document frequencies
come from all learning documents.  The regression itself is fitted on a sample of at most
``per_class`` distinct texts per language (a bound, not a share; the ones with the least hashes, so
copies take no one's place and a repeated task draws the same), by follow-the-regularised-leader
with an elastic-net penalty, and its confidence is calibrated by one temperature on a fifth
of that sample.  Half of the least score in that fifth is the model's ``floor``: a text scored lower
is of no learned language.  Only the text enters a prediction, and all of it.

Defined cases: a null text or one without letters is ``und`` with score 0; rows without
language are predicted, not learned from; with no language to learn, all is ``und``; with more than ``MAX_CLASSES`` languages learning raises
ValueError; equal rows get equal answers; ties go to the language that sorts first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import arrow_map, id_remainder
from docloom.plans.scale import top_k

BITS = 15
WIDTH = 1 << BITS
UNKNOWN = "und"
MAX_CLASSES = 500


@dataclass(frozen=True)
class Training:
    per_class: int = 800
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001


_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter, for all code points."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams, or None if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()[points]
    if not known.any():
        return None
    points = np.where(known, points, np.uint32(32))
    keep = known.copy()
    keep[1:] |= known[:-1]  # the first blank of a run
    c = np.concatenate(([np.uint32(32)], points[keep], [np.uint32(32)]))
    two = c[:-1] * np.uint32(0x01000193) + c[1:]
    three = two[:-1] * np.uint32(0x01000193) + c[2:]
    grams = np.concatenate((c[1:-1], two ^ np.uint32(0x5BD1E995), three ^ np.uint32(0x1B873593)))
    grams ^= grams >> np.uint32(15)
    return np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=WIDTH)


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1.0 + np.log(counts[at])) * idf[at]
    return at, x / max(1e-12, math.sqrt(float(x @ x)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, t: Training) -> np.ndarray:
    """Weights (width x classes) after ``epochs`` passes in the given order."""
    z, n = np.zeros((WIDTH, classes)), np.zeros((WIDTH, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= t.l1, 0.0, (np.sign(zi) * t.l1 - zi) / ((t.beta + np.sqrt(ni)) / t.alpha + t.l2))

    for _ in range(t.epochs):
        for at, x, y in examples:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            moved = ni + g * g
            z[at] = zi + g - (np.sqrt(moved) - np.sqrt(ni)) / t.alpha * w
            n[at] = moved
    return weights(z, n)


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden-section search on its logarithm.

    Targets are (n + 1) / (n + 2) rather than 1, so that a sample without an error doesn't claim certainty.
    """
    if not len(truth):
        return 1.0

    def loss(u: float) -> float:
        v = logits / math.exp(u)
        v = v - v.max(1, keepdims=True)
        log_p = v - np.log(np.exp(v).sum(1, keepdims=True))
        right = log_p[np.arange(len(truth)), truth]
        wrong = (log_p.sum(1) - right) / max(1, log_p.shape[1] - 1)
        return -float(((1 - slack) * right + slack * wrong).mean())

    slack = 1 / (len(truth) + 2)
    lo, hi, r = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float
    floor: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        at, x = vector(counts, self.idf)
        p = softmax((x @ self.weights[at]) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(docs: DataFrame, t: Training = Training()) -> Model:
    """Learn from the rows of ``docs`` that have a language."""
    known = docs.where(F.col("lang").isNotNull()).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_CLASSES + 1).collect()}
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} languages")
    names = sorted(sizes)
    if not names:
        return Model([], np.ones(WIDTH), np.zeros((WIDTH, 0)), 1.0)

    def frequencies(pieces):
        total, n = np.zeros(WIDTH, np.int64), 0
        for p in pieces:
            for text in p["text"]:
                counts = gram_counts(text)
                if counts is not None:
                    total += counts > 0
                    n += 1
        at = np.flatnonzero(total)
        yield {"gram": np.append(at, -1), "df": np.append(total[at], n)}

    df = np.zeros(WIDTH + 1)
    for r in arrow_map(known, frequencies, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():  # one row per feature at most
        df[r["gram"]] = r["df"]
    idf = np.log((1.0 + df[WIDTH]) / (1.0 + df[:WIDTH])) + 1.0

    h = F.xxhash64("text")
    kinds = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()}  # at most MAX_CLASSES rows
    share = F.create_map(*[v for k in names for v in (F.lit(k), F.lit(min(1.0, 2.0 * t.per_class / kinds[k])))])
    least = known.withColumn("h", h).where((F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)))
    drawn = top_k(least.groupBy("lang", "h").agg(F.min("text").alias("text")), ["lang"], [F.pmod("h", F.lit(1 << 30)), F.col("h")], t.per_class)

    def features(pieces):
        for p in pieces:
            made = {"lang": [], "at": [], "x": []}
            for text, lang in zip(p["text"], p["lang"], strict=True):
                counts = gram_counts(text)
                if counts is not None:
                    at, x = vector(counts, idf)
                    made["lang"].append(lang)
                    made["at"].append(at.astype("<u2").tobytes())
                    made["x"].append(x.astype("<f4").tobytes())
            yield made

    rows = arrow_map(drawn.select("lang", "text"), features, "lang string, at binary, x binary").collect()  # at most per_class rows a language
    examples = sorted(((r["at"], r["x"], names.index(r["lang"])) for r in rows), key=lambda r: hash_order(r[0], r[1]))
    examples = [(np.frombuffer(a, "<u2"), np.frombuffer(x, "<f4").astype(float), y) for a, x, y in examples]
    held, used = examples[::5], [e for i, e in enumerate(examples) if i % 5]
    w = ftrl(used or held, len(names), t)
    logits = np.array([x @ w[at] for at, x, _ in held]).reshape(len(held), len(names))
    heat = temperature(logits, np.array([y for *_, y in held], int))
    floor = min((float(softmax(row / heat).max()) for row in logits), default=0.0) / 2
    return Model(names, idf, w.astype(np.float32), heat, floor)


def hash_order(a: bytes, b: bytes) -> bytes:
    """A fixed order that mixes the classes and doesn't depend on partitions."""
    import hashlib

    return hashlib.blake2b(a + b, digest_size=16).digest()


def identify(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """The columns ``keep``, then lang_pred and score, for every row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(pieces):
        for p in pieces:
            made = [handle.value.predict(t) for t in p.pop("_text")]
            yield {**p, "lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "_text")
    return arrow_map(rows, run, f"{schema}, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    out = id_remainder(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~out))
    return identify(docs, model, F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"))
