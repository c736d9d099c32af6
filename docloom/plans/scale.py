"""Building blocks that keep joins, prefix scans and top-k safe when one key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


def hot_keys(counts: DataFrame, keys: Sequence[str], count_col: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than one task should get, and into how many parts (``_salts``) they are split.

    The counts add up to the number of rows, so at most one row in ``rows`` of the table is
    listed: a few thousand keys on billions of rows.
    """
    return counts.where(F.col(count_col) > rows).select(*keys, F.ceil(F.col(count_col) / rows).cast("int").alias("_salts"))


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    hot: DataFrame,
    spread_on: Sequence[str | Column],
    how: str = "inner",
) -> DataFrame:
    """Equi join of a skewed ``left`` with a ``right`` that has one row per key.

    Rows of hot keys are spread over as many sub-keys as they need and the few matching
    right rows are repeated once per sub-key; everything else joins as usual.
    ``hot`` comes from :func:`hot_keys`; the planner broadcasts it when it is small.
    """
    keys = list(keys)
    flagged = hot.select(*keys, "_salts")
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*spread_on), F.col("_salts")).cast("int")).otherwise(F.lit(0))
    l = left.join(flagged, keys, "left").withColumn("_salt", salt).drop("_salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    r = right.join(flagged, keys, "left").withColumn("_salt", every).drop("_salts")
    return l.join(r, [*keys, "_salt"], how).drop("_salt")


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str | Column],
    how: str = "inner",
) -> DataFrame:
    """:func:`salted_lookup` with the hot keys counted from the key columns of ``left``."""
    counts = left.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return salted_lookup(left, right, keys, hot_keys(counts, keys, "_n"), spread_on, how)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: dict[str, str],
) -> DataFrame:
    """Inclusive running sums ``{new column: value column}`` without one task per key.

    ``bucket`` must be non-decreasing along ``order`` and hold a bounded number of
    rows per key.  Sums run inside each bucket, bucket totals are scanned on a
    table that is smaller by the bucket size, and the offset is added back.
    """
    keys, order = list(keys), list(order)
    d = df.withColumn("_b", bucket)
    totals = d.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(v).over(inside).alias(f"_i_{n}") for n, v in values.items()])
    out = d.join(offsets, [*keys, "_b"])
    for n in values:
        out = out.withColumn(n, F.col(f"_i_{n}") + F.col(f"_o_{n}"))
    return out.drop("_b", *[f"_i_{n}" for n in values], *[f"_o_{n}" for n in values])


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Last non-null ``value`` strictly before each row, with the same bucket scheme."""
    keys = list(keys)
    d = df.withColumn("_b", bucket).withColumn("_v", value)
    ends = d.where(F.col("_v").isNotNull()).groupBy(*keys, "_b").agg(F.max_by("_v", order).alias("_e"))
    grid = d.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.select(*keys, "_b", F.last("_e", ignorenulls=True).over(before).alias("_c"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_p", F.last("_v", ignorenulls=True).over(inside))
    return (
        d.join(carried, [*keys, "_b"], "left")
        .withColumn(name, F.coalesce("_p", "_c"))
        .drop("_b", "_v", "_p", "_c")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], bucket: Column
) -> DataFrame:
    """Exact linear-interpolation quantiles per key from value counts and a prefix scan.

    Duplicates collapse in the map-side count; no group is gathered in one task.
    ``bucket`` is a non-decreasing function of ``value``.  Columns ``q0, q1, …``.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sum(counts, keys, [value], bucket, {"_cum": "_n"})
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    placed = cum.join(sizes, keys) if keys else cum.join(F.broadcast(sizes))
    aggs, finals = [], []
    for i, q in enumerate(qs):
        pos = (F.col("_size") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.min(F.when(F.col("_cum") > lo, F.col(value))).alias(f"_lo{i}"),
            F.min(F.when(F.col("_cum") > hi, F.col(value))).alias(f"_hi{i}"),
            F.max(pos - lo).alias(f"_f{i}"),
        ]
        finals.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}"))
    return placed.groupBy(*keys).agg(*aggs).select(*keys, *finals)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key; the rank filter is applied before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
