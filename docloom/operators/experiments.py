"""Numeric workloads: scores, paired tests, resampling, sampling distributions, classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.stats import safe_sd, t_critical, t_p_value
from docloom.session import cut_lineage

# Score weights and review thresholds.
WEIGHTS = (0.50, 0.30, 0.20)
SCORE_LIMIT = 1.5
TEMPERATURE_LIMIT = 80
# Bootstrap seed and number of resamples.
RESAMPLES = 10_000
MAX_SIGN_PAIRS = 24


def column_stats(df: DataFrame, cols: list[str], ddof: int = 0) -> DataFrame:
    """One row with mean and deviation of each column (population deviation by default)."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols], *[sd(c).alias(f"sd_{c}") for c in cols])


def weighted_score(df: DataFrame, cols: list[str], weights=WEIGHTS, ddof: int = 0) -> DataFrame:
    """Weighted sum of z-scores; the one-row statistics are broadcast."""
    d = df.join(F.broadcast(column_stats(df, cols, ddof)))
    score = sum(
        ((F.col(c) - F.col(f"mean_{c}")) / safe_sd(F.col(f"sd_{c}")) * w for c, w in zip(cols, weights)), F.lit(0.0)
    )
    return d.withColumn("load_score", score).drop(*[f"{p}_{c}" for p in ("mean", "sd") for c in cols])


def needs_review(score: Column, temperature: Column) -> Column:
    return (score > SCORE_LIMIT) | (temperature > TEMPERATURE_LIMIT)


def paired_test(diffs: DataFrame, d: str, keys: list[str] | None = None) -> DataFrame:
    """One-sample t of paired differences with its p value and 95 % interval."""
    g = diffs.groupBy(*(keys or [])).agg(
        F.count(d).alias("n"), F.avg(d).alias("media"), F.stddev_samp(d).alias("sd"),
        F.sum(F.when(F.col(d) > 0, 1).otherwise(0)).cast("bigint").alias("favorecen_b"),
        F.sum(F.when(F.col(d) < 0, 1).otherwise(0)).cast("bigint").alias("favorecen_a"),
    )
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    df_ = (F.col("n") - 1).cast("double")
    g = g.withColumn("se", se).withColumn("t", F.when(F.col("se") != 0, F.col("media") / F.col("se"))).withColumn("gl", df_)
    g = g.withColumn("p", t_p_value("t", "gl")).withColumn("_q", t_critical(F.lit(0.975) + F.col("gl") * 0, "gl"))
    return g.withColumn("ic_bajo", F.col("media") - F.col("_q") * F.col("se")).withColumn(
        "ic_alto", F.col("media") + F.col("_q") * F.col("se")).drop("_q")


def sign_flip_test(diffs: DataFrame, d: str, order: str) -> DataFrame:
    """Exact sign-flip test over all 2^n sign patterns of the n differences.

    The pattern space is the work here, not the table: n beyond 24 pairs raises
    (16.7 million patterns).  Patterns are spread over tasks by a repartition.
    """
    few = diffs.limit(MAX_SIGN_PAIRS + 1)
    one = few.agg(F.array_sort(F.collect_list(F.struct(order, d))).alias("p"), F.count("*").alias("n"))
    one = one.select(
        F.transform("p", lambda x: x[d].cast("double")).alias("d"),
        F.when(F.col("n") <= MAX_SIGN_PAIRS, F.col("n")).otherwise(
            F.raise_error(F.lit(f"exact sign flips need at most {MAX_SIGN_PAIRS} pairs")).cast("bigint")).alias("n"),
    )
    power = lambda e: F.pow(F.lit(2.0), e).cast("long")
    width = power(F.least(F.col("n"), F.lit(10)))
    last_block = power(F.greatest(F.col("n") - 10, F.lit(0))) - 1
    blocks = one.select("d", "n", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("b")).repartition("b")
    patterns = blocks.select("d", "n", F.explode(F.sequence(F.col("b") * width, F.col("b") * width + width - 1)).alias("s"))
    total = F.aggregate(
        F.transform("d", lambda x, i: F.when((F.expr("s") / F.pow(F.lit(2.0), i)).cast("long") % 2 == 0, x).otherwise(-x)),
        F.lit(0.0), lambda a, x: a + x)
    seen = F.abs(F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    return patterns.agg(
        F.count("*").alias("configuraciones"),
        F.sum(F.when(F.abs(total / F.col("n")) >= seen - F.lit(1e-12), 1).otherwise(0)).cast("bigint").alias("extremas"),
    ).withColumn("p_signos", F.col("extremas") / F.col("configuraciones"))


def poisson_bootstrap(df: DataFrame, value: str, key: str, resamples: int = 200) -> DataFrame:
    """Bootstrap means of a large table: each row enters each resample Poisson(1) times.

    Weights come from a hash of the row key, so a lost task recomputes the same
    resamples; every task emits only its partial sums.
    """
    fields = ", ".join(f"s{r} double, w{r} double" for r in range(resamples))

    def sums(batches):
        s, w = np.zeros(resamples), np.zeros(resamples)
        salt = (np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        cuts = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])
        for b in batches:
            for at in range(0, len(b), 4096):
                k = b[key].to_numpy()[at : at + 4096].astype(np.int64).view(np.uint64)
                v = b[value].to_numpy()[at : at + 4096].astype(float)
                with np.errstate(over="ignore"):
                    z = k[:, None] * np.uint64(0xBF58476D1CE4E5B9) + salt[None, :]
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    z ^= z >> np.uint64(31)
                n = np.searchsorted(cuts, (z >> np.uint64(11)) / float(1 << 53)).astype(float)
                s += v @ n
                w += n.sum(axis=0)
        yield pd.DataFrame([np.column_stack([s, w]).ravel()], columns=[f"{p}{r}" for r in range(resamples) for p in ("s", "w")])

    part = df.select(key, value).where(F.col(value).isNotNull()).mapInPandas(sums, fields)
    total = part.agg(*[F.sum(f"{p}{r}").alias(f"{p}{r}") for r in range(resamples) for p in ("s", "w")])
    means = F.array_sort(F.array(*[F.col(f"s{r}") / F.col(f"w{r}") for r in range(resamples)]))
    pick = lambda q: F.element_at(means, int(round(q * (resamples - 1))) + 1)
    return total.select(F.lit(resamples).alias("remuestras"), pick(0.025).alias("bajo"), pick(0.975).alias("alto"))


def softmax(df: DataFrame, keys: list[str], logit: str, temperature: float, out: str = "p") -> DataFrame:
    """Max-normalised softmax per key; maxima and sums are aggregates joined back."""
    z = F.col(logit) / temperature
    top = df.groupBy(*keys).agg(F.max(z).alias("_m"))
    e = df.join(top, keys) if keys else df.join(F.broadcast(top))
    e = e.withColumn("_e", F.exp(z - F.col("_m")))
    tot = e.groupBy(*keys).agg(F.sum("_e").alias("_s"))
    e = e.join(tot, keys) if keys else e.join(F.broadcast(tot))
    return e.withColumn(out, F.col("_e") / F.col("_s")).drop("_m", "_e", "_s")


def top_p(df: DataFrame, keys: list[str], p: str, item: str, mass: float = 0.9) -> DataFrame:
    """Smallest set of most likely items whose mass reaches ``mass``, renormalised."""
    w = Window.partitionBy(*keys).orderBy(F.col(p).desc(), item).rowsBetween(Window.unboundedPreceding, -1)
    kept = df.withColumn("_before", F.coalesce(F.sum(p).over(w), F.lit(0.0))).where(F.col("_before") < mass)
    tot = kept.groupBy(*keys).agg(F.sum(p).alias("_t"))
    kept = kept.join(tot, keys) if keys else kept.join(F.broadcast(tot))
    return kept.withColumn("p_top", F.col(p) / F.col("_t")).drop("_before", "_t")


def gaussian_nb(train: DataFrame, test: DataFrame, label: str, features: list[str], key: str) -> DataFrame:
    """Gaussian naive Bayes from per-class moments: one aggregation, one scoring pass.

    The model table has one row per class and rides along as a broadcast array.
    """
    var_floor = train.agg(F.greatest(*[F.var_pop(f) for f in features]).alias("_v")) if len(features) > 1 else train.agg(
        F.var_pop(features[0]).alias("_v"))
    model = train.groupBy(label).agg(
        F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.var_pop(f).alias(f"v_{f}") for f in features])
    packed = model.join(F.broadcast(var_floor)).agg(
        F.sum("n").alias("total"),
        F.array_sort(F.collect_list(F.struct(label, "n", *[f"m_{f}" for f in features],
                     *[(F.col(f"v_{f}") + F.col("_v") * 1e-9).alias(f"v_{f}") for f in features]))).alias("classes"))
    scored = test.join(F.broadcast(packed))

    def loglik(c: Column) -> Column:
        s = F.log(c["n"] / F.col("total"))
        for f in features:
            s = s - F.log(c[f"v_{f}"] * (2 * np.pi)) / 2 - F.pow(F.col(f) - c[f"m_{f}"], 2) / (c[f"v_{f}"] * 2)
        return F.struct(s.alias("s"), c[label].alias("c"))

    best = F.array_max(F.transform("classes", loglik))
    return scored.select(key, label, best["c"].alias("pred"))


def class_report(pred: DataFrame, label: str) -> DataFrame:
    """Accuracy and macro F1 from the confusion counts, scored once."""
    cells = cut_lineage(pred.groupBy(label, "pred").agg(F.count("*").alias("n")))
    truth = cells.groupBy(F.col(label).alias("c")).agg(
        F.sum("n").alias("t"), F.sum(F.when(F.col(label) == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    given = cells.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("g"))
    j = truth.join(given, "c", "full").na.fill(0)
    f1 = F.when(F.col("t") + F.col("g") > 0, 2 * F.col("tp") / (F.col("t") + F.col("g"))).otherwise(0.0)
    return j.agg(F.sum("t").cast("bigint").alias("n"), (F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1"))
