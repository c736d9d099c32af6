"""Checks, truths and tasks as tables: one plan runs every task's own list of checks.

A check is a row; its type says which expression judges the deliverable.  Expected values are named
queries, each with one value, so a truth is computed from the data and not written into the check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import figures as fg
from docloom.functions import text as tx
from docloom.operators.checks import WINDOW, _result
from docloom.plans.scale import lookup

CHECK_SCHEMA = (
    "tarea STRING, check STRING, tipo STRING, lista ARRAY<STRING>, en_orden BOOLEAN, valor DOUBLE, etiqueta STRING, "
    "verdad STRING, tolerancia DOUBLE, patron STRING, minimo DOUBLE"
)
TOLERANCE = 0.005


def truth_table(spark: SparkSession, named: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """``verdad, esperado``: the value of each named query; a query without a row gives NULL."""
    out = spark.createDataFrame([], "verdad STRING, esperado DOUBLE")
    for name, query in named.items():
        df = query()
        value = df.toDF("v", *df.columns[1:]).select(F.col("v").cast("double").alias("v")).agg(F.max("v").alias("esperado"))
        out = out.unionByName(value.select(F.lit(name).alias("verdad"), "esperado"))
    return out


def checks_by_task(checks: DataFrame, truths: DataFrame) -> DataFrame:
    """``tarea, _checks``: the list of each task, expected values filled in; a task's own list bounds the row."""
    c = checks.join(truths, "verdad", "left")
    fields = [f for f in checks.columns if f != "tarea"]
    return c.groupBy("tarea").agg(F.sort_array(F.collect_list(F.struct("check", *[f for f in fields if f != "check"], "esperado"))).alias("_checks"))


def _sections(text: Column, c: Column) -> Column:
    def judge(at: Column) -> Column:
        missing = F.filter(F.zip_with(at, c["lista"], lambda p, s: F.when(p < 0, s)), lambda x: x.isNotNull())
        wrong = F.coalesce(c["en_orden"], F.lit(False)) & (at != F.sort_array(at))
        return tx.let(missing, lambda m: _result((F.size(m) == 0) & ~wrong, F.when(
            F.size(m) > 0, F.concat(F.lit("faltan: "), F.array_join(m, ", "))).when(wrong, "las secciones están fuera de orden").otherwise("todas, en orden")))

    return tx.let(tx.heading_offsets(text, c["lista"]), judge)


def _contains(text: Column, c: Column) -> Column:
    missing = F.filter(c["lista"], lambda w: ~F.regexp_like(text, tx.word_pattern(w)))
    return tx.let(missing, lambda m: _result(F.size(m) == 0, F.when(F.size(m) == 0, "todos presentes").otherwise(F.concat(F.lit("faltan "), F.array_join(m, ", ")))))


def _figure(text: Column, c: Column) -> Column:
    plain = tx.squeeze(tx.without_code(text))
    after = F.regexp_extract_all(plain, F.concat(F.lit("(?s)(?:"), c["etiqueta"], F.lit(f")(?=(.{{0,{WINDOW}}}))")), F.lit(1))
    found = F.when(c["tipo"] == "cifra_presente", fg.numbers(plain)).otherwise(F.flatten(F.transform(after, fg.numbers)))
    tolerance = F.coalesce(c["tolerancia"], F.lit(TOLERANCE))
    hit = F.exists(found, lambda r: F.abs(r["value"] - c["esperado"]) <= tolerance + F.lit(1e-12))
    told = F.concat(F.lit("verdad="), F.when(c["esperado"].isNull(), "?").otherwise(F.format_string("%.4f", c["esperado"])), F.lit(" ±"), tolerance.cast("string"), F.lit("; "))
    return tx.let(F.coalesce(hit, F.lit(False)), lambda h: _result(h, F.concat(told, F.when(h, "hallada").otherwise("no hallada"))))


def _words(text: Column, c: Column) -> Column:
    return tx.let(tx.word_count(text), lambda n: _result(n <= c["valor"], F.concat(n.cast("string"), F.lit(" palabras"))))


def _pages(text: Column, c: Column) -> Column:
    return _result(F.col("paginas") <= c["valor"], F.concat(F.col("paginas").cast("string"), F.lit(" páginas")))


def _files(text: Column, c: Column) -> Column:
    n = F.size(F.filter(F.col("archivos"), lambda p: F.regexp_like(p, c["patron"])))
    return tx.let(n, lambda k: _result(k >= F.coalesce(c["minimo"], F.lit(1.0)), F.concat(k.cast("string"), F.lit(" archivo(s) con "), c["patron"])))


#: Type, expression, further column it reads (None: only the text), whether it needs a deliverable.
KINDS = [
    ("secciones", _sections, None, True), ("palabras_max", _words, None, True), ("contiene", _contains, None, True), ("cifra", _figure, None, True),
    ("cifra_presente", _figure, None, True), ("paginas_max", _pages, "paginas", True), ("archivo", _files, "archivos", False),
]


def run_check_table(deliverables: DataFrame, key: str, checks: DataFrame, truths: DataFrame) -> DataFrame:
    """``key, tarea, check, tipo, ok, detalle`` of every deliverable under the checks of its own task.

    ``deliverables``: ``key, tarea, text`` and, if checks read them, ``paginas`` and ``archivos``.  Texts meet their task's
    list once and are judged in the row; a task with a third of all deliverables is spread.
    A missing text fails as such, an unknown type by name, and a deliverable of a task without checks gives no row.
    """
    there = lookup(deliverables, checks_by_task(checks, truths), ["tarea"], [key])
    text = F.col("text")

    def judged(c: Column) -> Column:
        r = _result(F.lit(False), F.concat(F.lit("tipo desconocido: "), c["tipo"]))
        for tipo, build, column, needs in reversed(KINDS):
            if column is None or column in deliverables.columns:
                own = F.when(text.isNull(), _result(F.lit(False), F.lit("no hay entregable"))).otherwise(build(text, c)) if needs else build(text, c)
                r = F.when(c["tipo"] == tipo, own).otherwise(r)
        return r

    one = there.select(key, "tarea", "text", *[k[2] for k in KINDS if k[2] in deliverables.columns], F.explode("_checks").alias("c"))
    one = one.select(key, "tarea", F.col("c.check").alias("check"), F.col("c.tipo").alias("tipo"), judged(F.col("c")).alias("r"))
    return one.select(key, "tarea", "check", "tipo", "r.ok", "r.detalle")
