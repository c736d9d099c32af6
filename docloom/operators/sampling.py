"""Exact stratified splits, reproducible categorical draws, and logistic regression from summed normal equations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.search import ranks_of
from docloom.session import cut_lineage

CELLS = 64
_BITS = 48


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 48 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("bigint") / F.lit(float(1 << _BITS))


def stratified_split(df: DataFrame, key: str, label: str, share: float, seed: str = "split") -> DataFrame:
    """``df`` with ``prueba``: of each class the nearest whole number to ``share`` of its rows, those with the least hashes.

    A null class is a class of its own.  Places are counted inside ranges of (class, hash), so a class with most of the
    rows is not sorted in one task.  ``key`` must be unique; equal keys are split alike.
    """
    order = F.concat(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.lit(":"), F.col(key).cast("string"))
    rows = cut_lineage(df.select(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_class"), F.coalesce(order, F.lit("")).alias("_h")).distinct())
    placed = ranks_of(rows, ["_class"], "_h")
    sizes = rows.groupBy("_class").agg(F.count(F.lit(1)).alias("_n"))
    chosen = placed.join(F.broadcast(sizes), "_class").where(F.col("pos") <= F.floor(F.col("_n") * share + 0.5)).select("_class", "_h", F.lit(1).alias("_t"))
    tagged = df.withColumn("_class", F.coalesce(F.col(label).cast("string"), F.lit(""))).withColumn("_h", F.coalesce(order, F.lit("")))
    return tagged.join(chosen, ["_class", "_h"], "left").withColumn("prueba", F.coalesce("_t", F.lit(0))).drop("_class", "_h", "_t")


def categorical_draws(df: DataFrame, keys: Sequence[str], item: str, p: str, draws: int, seed: str = "draw") -> DataFrame:
    """``*keys, draw, item``: ``draws`` draws per key from its distribution, by inverse cumulative probability.

    Uniforms come from hashes of key, number and seed, so any task may repeat them.  Draws meet the intervals through cells of
    [0, 1): an interval lies in the cells that it touches, and the join is an equality on key and cell.  Weights need not add up to one.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(item).rowsBetween(Window.unboundedPreceding, -1)
    total = df.groupBy(*keys).agg(F.sum(p).alias("_t"))
    cdf = df.where(F.col(p) > 0).join(total, keys).withColumn("_lo", F.coalesce(F.sum(p).over(w), F.lit(0.0)) / F.col("_t"))
    cdf = cdf.withColumn("_hi", F.col("_lo") + F.col(p) / F.col("_t"))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(item).desc())) == 1  # rounding leaves no gap at the end
    cdf = cdf.withColumn("_hi", F.when(last, F.lit(1.0)).otherwise(F.col("_hi")))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    spread = cdf.select(*keys, item, "_lo", "_hi", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))).alias("_cell"))
    numbers = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    numbers = numbers.withColumn("_u", uniform(*[F.col(k) for k in keys], F.col("draw"), F.lit(seed)))
    met = numbers.withColumn("_cell", cell(F.col("_u"))).join(spread, [*keys, "_cell"])
    return met.where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select(*keys, "draw", item)


def logistic_fit(df: DataFrame, label: str, features: Sequence[str], steps: int = 8, ridge: float = 0.01) -> np.ndarray:
    """Intercept and weights after a fixed number of Newton steps on the penalised log likelihood.

    Each step is one aggregation of the gradient and the upper half of the normal equations; the driver solves a system
    whose size is the number of features.  Rows with a null or a non-finite value take no part; without rows all weights are zero.
    """
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(label).cast("double")
    fine = y.isNotNull()
    for f in features:
        fine &= F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) < F.lit(float("inf")))
    rows = cut_lineage(df.where(fine).select(y.alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)]))
    n = len(x)
    at = [F.col(f"_x{i}") for i in range(n)]
    beta = np.zeros(n)
    for _ in range(steps):
        z = sum((at[i] * float(beta[i]) for i in range(n)), F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        part = rows.withColumn("_p", p)
        sums = [F.sum((F.col("_y") - F.col("_p")) * at[i]) for i in range(n)]
        sums += [F.sum(F.col("_p") * (1 - F.col("_p")) * at[i] * at[j]) for i in range(n) for j in range(i, n)]
        got = part.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        values = [v or 0.0 for v in got]
        hess = np.zeros((n, n))
        hess[np.triu_indices(n)] = values[n:]
        hess = hess + np.triu(hess, 1).T + ridge * np.eye(n)
        beta = beta + np.linalg.solve(hess, np.array(values[:n]) - ridge * beta)
    return beta


def logistic_scores(df: DataFrame, features: Sequence[str], beta: np.ndarray) -> Column:
    """The probability of label 1 as an expression."""
    z = sum((F.col(f).cast("double") * float(b) for f, b in zip(features, beta[1:], strict=True)), F.lit(float(beta[0])))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
