"""Figures in text: extraction with decimals and percent readings, artifact values, marking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import strip

W = r"[\p{L}\p{N}_]"
# How a figure looks in prose, in an artifact, and in a first rough scan.
FIGURE = r"(?<![\p{L}\p{N}_.,])(\d+(?:[.,]\d+)?)(\s?%)?(?![\p{L}\p{N}_])"
ARTIFACT_VALUE = r"(?<![\p{L}\p{N}_.])(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\p{L}\p{N}_.])"
ROUGH_FIGURE = r"(?<![\p{L}\p{N}_.])(?:0[.,]\d{2,4}|\d{2}[.,]\d{1,2}\s?%)"
UNSUPPORTED_MARK = "[cifra sin respaldo]"


def _parsed(raw: Column) -> Column:
    number = F.replace(F.regexp_extract(raw, r"^\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit("."))
    dot = F.instr(number, ".")
    return F.struct(
        strip(raw).alias("raw"),
        number.cast("double").alias("value"),
        F.when(dot > 0, F.length(number) - dot).otherwise(0).cast("int").alias("decimals"),
        raw.endswith("%").alias("percent"),
    )


def figures(c: Column) -> Column:
    """``array<struct<raw, value, decimals, percent>>`` in text order."""
    return F.transform(F.regexp_extract_all(c, F.lit(FIGURE), F.lit(0)), _parsed)


def readings(fig: Column) -> Column:
    """Possible values of one figure: a percentage also reads as a fraction."""
    plain = F.struct(fig["value"].alias("value"), fig["decimals"].alias("decimals"))
    part = F.struct((fig["value"] / 100).alias("value"), (fig["decimals"] + 2).alias("decimals"))
    return F.when(fig["percent"], F.array(part, plain)).otherwise(F.array(plain))


def numbers(c: Column) -> Column:
    """Every reading of every figure, flattened: the evaluator's view of a text."""
    return F.flatten(F.transform(figures(c), readings))


def artifact_values(c: Column) -> Column:
    """Numbers written by a run, scientific notation included."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(ARTIFACT_VALUE), F.lit(1)), lambda s: s.try_cast("double")
    )


def rough_figures(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(ROUGH_FIGURE), F.lit(0))


def fits(measured: Column, value: Column, decimals: Column) -> Column:
    """Equal within the rounding of the figure's own decimals."""
    return F.abs(measured - value) <= F.lit(0.5) * F.pow(F.lit(10.0), -decimals) + F.lit(1e-9)


def within(value: Column, truth: Column | float, tol: Column | float) -> Column:
    return F.abs(value - truth) <= tol + F.lit(1e-12)


def mark_unsupported(text: Column, raws: Column) -> Column:
    """Replace each listed figure by a visible mark, longest first."""
    ordered = F.array_sort(
        F.array_distinct(raws), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(
            F.when(a < b, -1).when(a > b, 1).otherwise(0))
    )
    quoted = F.transform(
        ordered,
        lambda r: F.concat(F.lit(r"(?<![\p{L}\p{N}_.,])\Q"), r, F.lit(r"\E(?![\p{L}\p{N}_])")),
    )
    return F.aggregate(
        quoted, text, lambda acc, p: F.regexp_replace(acc, p, F.lit(UNSUPPORTED_MARK))
    )


def fraction_in_detail(detail: Column, ok: Column) -> Column:
    """Fraction printed in a check's detail; 1.00 for a passed check without one."""
    m = F.regexp_extract(detail, r"\(([\d.]+)\)", 1)
    return F.when(m != "", m).when(ok == 1, F.lit("1.00")).otherwise(F.lit(""))


def short_number(x: Column) -> Column:
    """No decimals for whole or large numbers, else one."""
    whole = (F.abs(x - F.rint(x)) < 1e-9) | (F.abs(x) >= 100)
    return F.when(whole, F.format_string("%d", F.rint(x).cast("long"))).otherwise(
        F.format_string("%.1f", F.rint(x * 10) / 10)
    )


def mean_range(mean: Column, low: Column, high: Column) -> Column:
    """``mean (min–max)``, or the single value when nothing varies."""
    return F.when(mean.isNull(), F.lit("—")).when(low == high, short_number(low)).otherwise(
        F.concat(short_number(mean), F.lit(" ("), short_number(low), F.lit("–"), short_number(high), F.lit(")"))
    )
