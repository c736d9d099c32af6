"""Is every figure of a text backed by a measured value within its own rounding?

A figure with d decimals is a point of the grid of width 10^-d, so "some measured
value rounds to it" is an equality of grid points: each distinct measured value
is mapped to the one or two points it supports, duplicates are dropped map-side,
and the band join becomes an equi join on (decimals, point) with no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.figures import figures, fits, readings
from docloom.functions.text import without_code
from docloom.plans.scale import lookup
from docloom.session import cut_lineage

GRID_LEVELS = list(range(2, 9))
FINE = 8


def _scale(d: Column) -> Column:
    return F.pow(F.lit(10.0), d)


def _points(measured: DataFrame) -> DataFrame:
    """Distinct (decimals, point) supported by the measured values."""
    a = F.col("value")
    lv = measured.select(F.col("value").cast("double").alias("value")).distinct().select(
        "value", F.explode(F.array(*map(F.lit, GRID_LEVELS))).alias("decimals"))
    k = F.rint(a * _scale(F.col("decimals")))
    return (
        lv.select("value", "decimals", F.explode(F.array(k - 1, k, k + 1)).alias("k"))
        .where(fits(a, F.col("k") / _scale(F.col("decimals")), F.col("decimals")))
        .select("decimals", "k").distinct()
    )


def supported_values(need: DataFrame, measured: DataFrame) -> DataFrame:
    """Rows (value, decimals) of ``need`` that some measured value supports."""
    need = need.select("value", "decimals").distinct()
    coarse = need.where(F.col("decimals") <= FINE).withColumn("k", F.rint(F.col("value") * _scale(F.col("decimals"))))
    hit = coarse.join(_points(measured), ["decimals", "k"], "left_semi").select("value", "decimals")
    cell = lambda c: F.rint(c * _scale(F.lit(FINE)))
    fine = need.where(F.col("decimals") > FINE).withColumn(
        "cell", F.explode(F.array(*[cell(F.col("value")) + o for o in (-1, 0, 1)])))
    m = measured.select(F.col("value").cast("double").alias("a")).distinct().withColumn("cell", cell(F.col("a")))
    deep = fine.join(m, "cell").where(fits(F.col("a"), F.col("value"), F.col("decimals"))).select("value", "decimals")
    return hit.unionByName(deep).distinct()


def own_figures(docs: DataFrame, key: str, text: str, per_reading: bool) -> DataFrame:
    """One row per reading: ``key, pos, raw, value, decimals``.

    ``per_reading`` gives every reading its own position, so a percentage counts
    twice; otherwise its readings share one position.
    """
    f = docs.select(key, F.posexplode(figures(without_code(F.col(text)))).alias("pos", "f"))
    f = f.select(key, "pos", F.col("f.raw").alias("raw"), F.posexplode(readings(F.col("f"))).alias("alt", "r"))
    if per_reading:
        f = f.withColumn("pos", F.col("pos") * 2 + F.col("alt"))
    return f.select(key, "pos", "raw", "alt", "r.value", "r.decimals")


def check_figures(docs: DataFrame, key: str, text: str, given: DataFrame, measured: DataFrame, per_reading: bool = False) -> DataFrame:
    """One row per figure that needs support: ``key, pos, raw, value, decimals, ok``.

    Figures without a two-decimal reading and figures the statement gives are left out.
    """
    r = cut_lineage(own_figures(docs, key, text, per_reading))
    known = given.select("value").distinct().withColumn("given", F.lit(1))
    r = lookup(r, known, ["value"], [key, "pos"], "left")
    deep = F.col("decimals") >= 2
    ok = supported_values(r.where(deep & F.col("given").isNull()), measured).withColumn("hit", F.lit(1))
    r = lookup(r, ok, ["value", "decimals"], [key, "pos"], "left")
    last = F.struct("alt", "value", "decimals")
    g = r.groupBy(key, "pos").agg(
        F.first("raw").alias("raw"),
        F.max(F.when(deep, last)).alias("v"),
        F.max(F.coalesce("given", F.lit(0))).alias("given"),
        F.max(F.when(deep, F.coalesce("hit", F.lit(0)))).alias("ok"),
    )
    return g.where(F.col("v").isNotNull() & (F.col("given") == 0)).select(
        key, "pos", "raw", "v.value", "v.decimals", F.col("ok").cast("int").alias("ok"))


def provenance_summary(docs: DataFrame, key: str, checked: DataFrame) -> DataFrame:
    """Per document: supported fraction (1 without figures), total, unsupported figures in order."""
    g = checked.groupBy(key).agg(
        F.avg("ok").alias("f"), F.count("*").alias("t"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("ok") == 0, F.col("raw")))), "|").alias("s"))
    return docs.select(key).join(g, key, "left").select(
        key, F.coalesce("f", F.lit(1.0)).alias("fraccion"), F.coalesce("t", F.lit(0)).alias("total"),
        F.coalesce("s", F.lit("")).alias("sin_origen"))


def suggestions(unsupported: DataFrame, measured: DataFrame) -> DataFrame:
    """For each unsupported (value, decimals): nearest measured value, else one off by a power of ten.

    Cells keep only their smallest and largest measured value: for a grid point the
    nearest value of a cell below is its largest, of a cell above its smallest.
    """
    every = cut_lineage(unsupported.select("value", "decimals").distinct())  # both sides are read by several steps
    need = every.where(F.col("decimals") <= FINE)
    m = cut_lineage(measured.select(F.col("value").cast("double").alias("a")).distinct())
    lv = m.select("a", F.explode(F.array(*map(F.lit, GRID_LEVELS))).alias("decimals"))
    cells = lv.groupBy("decimals", F.floor(F.col("a") * _scale(F.col("decimals"))).cast("double").alias("cell")).agg(
        F.min("a").alias("lo"), F.max("a").alias("hi"))
    k = F.rint(F.col("value") * _scale(F.col("decimals")))
    n = need.select("value", "decimals", F.explode(F.array(*[F.lit(o) for o in (-3, -2, -1, 0, 1, 2)])).alias("o"))
    n = n.withColumn("cell", k + F.col("o"))
    c = n.join(cells, ["decimals", "cell"]).select(
        "value", "decimals", F.explode(F.array("lo", "hi")).alias("a"))
    near = c.where(F.abs(F.col("a") - F.col("value")) <= F.lit(1.5) * _scale(-F.col("decimals"))).groupBy("value", "decimals").agg(
        F.min_by("a", F.struct(F.abs(F.col("a") - F.col("value")), F.col("a"))).alias("medido"))
    # Finer figures: the measured values of the neighbouring cells of the finest level, as in supported_values.
    cell = lambda c: F.rint(c * _scale(F.lit(FINE)))
    fine = every.where(F.col("decimals") > FINE)
    close = fine.withColumn("cell", F.explode(F.array(*[cell(F.col("value")) + o for o in (-1, 0, 1)]))).join(m.withColumn("cell", cell(F.col("a"))), "cell")
    close = close.where(F.abs(F.col("a") - F.col("value")) <= F.lit(1.5) * _scale(-F.col("decimals"))).groupBy("value", "decimals").agg(
        F.min_by("a", F.struct(F.abs(F.col("a") - F.col("value")), F.col("a"))).alias("medido"))
    near, need = cut_lineage(near.unionByName(close)), every
    out = near.select("value", "decimals", "medido", F.lit("redondeo").alias("pista"), F.lit(0).alias("exponente"))
    rest = need.where(F.col("value") > 0).join(near, ["value", "decimals"], "left_anti").withColumn("K", k)
    rest = rest.withColumn("s", F.length(F.col("K").cast("decimal(38,0)").cast("string")))
    p = m.where(F.col("a") > 0).withColumn("e", F.floor(F.log10("a")).cast("int"))
    sig = p.select("a", "e", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("s"))
    mant = F.col("a") / _scale(F.col("e") - F.col("s") + 1)
    r0 = F.rint(mant)
    sig = sig.select("a", "s", F.explode(F.array(r0 - 1, r0, r0 + 1)).alias("K0"), mant.alias("m")).where(
        F.abs(F.col("m") - F.col("K0")) <= F.lit(0.5) + F.lit(1e-9))
    sig = sig.select("a", "s", F.when(F.col("K0") == _scale(F.col("s")), F.col("K0") / 10).otherwise(F.col("K0")).alias("K"))
    sig = sig.groupBy("s", "K", F.floor(F.log10("a")).alias("e")).agg(F.min("a").alias("a"))
    ex = F.round(F.log10(F.col("a") / F.col("value")))
    far = rest.join(sig, ["s", "K"]).where((ex != 0) & fits(F.col("a") / _scale(ex), F.col("value"), F.col("decimals")))
    far = far.groupBy("value", "decimals").agg(F.min("a").alias("medido"))
    return out.unionByName(far.select("value", "decimals", "medido", F.lit("escala").alias("pista"), F.round(F.log10(F.col("medido") / F.col("value"))).cast("int").alias("exponente")))

