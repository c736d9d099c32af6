"""Distribution functions and small statistical expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile by bisection on the two-sided tail."""
    tail, lo, hi = 2 * (1 - p), 0.0, 1.0
    while t_two_sided(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > tail else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([
        t_two_sided(x, n) if pd.notna(x) and pd.notna(n) and n > 0 else np.nan for x, n in zip(t, df)
    ])


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(q, n) if pd.notna(n) and n > 0 else np.nan for q, n in zip(p, df)])


def safe_sd(sd: Column) -> Column:
    """A zero deviation counts as one."""
    return F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def kappa(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Cohen's kappa of a 2×2 table; NULL when empty or when chance agreement is total."""
    n = (tp + tn + fp + fn).cast("double")
    n = F.when(n > 0, n)
    po = (tp + tn) / n
    pa, pb = (tp + fn) / n, (tp + fp) / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(pe != 1, (po - pe) / (1 - pe))
