"""Code-side verdict over executions: an ordered list of reasons, approved only when it is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording that asks for a figure, metric names whose perfection is suspicious.
WANTS_FIGURE = r"(?i)figura|gr[aá]fic|curva|plot|png|dibuja|barras|histograma"
METRIC_PREFIX = r"^(acc|exact|f1|precision|recall|auc|r2)"
PERFECT = 0.999


def not_finite(v: Column) -> Column:
    return F.isnan(v) | v.isin(float("inf"), float("-inf"))


def is_metric(path: Column) -> Column:
    """Last key of a dotted path, list index removed, starts like a metric name."""
    return F.lower(F.regexp_extract(F.substring_index(path, ".", -1), r"^[^\[]*", 0)).rlike(METRIC_PREFIX)


def reasons(returncode: Column, error: Column, leaves: Column, wants: Column, files: Column) -> Column:
    """Ordered reasons for rejection.  ``leaves`` is ``array<struct<path, value>>`` or NULL without results."""
    ok = returncode == 0
    bad = F.filter(leaves, lambda x: not_finite(x["value"]))
    perfect = F.filter(leaves, lambda x: is_metric(x["path"]) & (x["value"] >= PERFECT))
    names = lambda a: F.array_join(F.transform(a, lambda x: x["path"]), ", ")
    return F.array_compact(F.array(
        error,
        F.when(~ok & error.isNull(), F.concat(F.lit("el script terminó con código "), returncode.cast("string"))),
        F.when(ok & leaves.isNull(), F.lit("no escribió resultados.json (es el contrato)")),
        F.when(ok & (F.size(leaves) == 0), F.lit("resultados.json no es un objeto con cifras")),
        F.when(ok & (F.size(bad) > 0), F.concat(F.lit("hay NaN o infinitos en resultados.json: "), names(bad))),
        F.when(ok & (F.size(perfect) > 0), F.concat(F.lit("plausibilidad: métricas ≥ 0,999 en un problema con ruido: "), names(perfect))),
        F.when(ok & wants.rlike(WANTS_FIGURE) & ~F.exists(files, lambda f: f.endswith(".png")),
               F.lit("el criterio pide una figura y el script no guardó ningún PNG")),
    ))
