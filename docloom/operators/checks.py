"""Declarative checks of a deliverable: each check type is one expression over the text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import figures as fg
from docloom.functions import text as tx

WINDOW = 160
PLAIN = "_plain"


def _result(ok: Column, detail: Column) -> Column:
    return F.struct(F.coalesce(ok, F.lit(False)).cast("int").alias("ok"), F.coalesce(detail, F.lit("")).alias("detalle"))


def _sections(text: Column, spec: dict[str, Any]) -> Column:
    names = F.array(*map(F.lit, spec["lista"]))
    ordered = F.lit(bool(spec.get("en_orden")))

    def judge(at: Column) -> Column:
        missing = F.filter(F.zip_with(at, names, lambda p, s: F.when(p < 0, s)), lambda x: x.isNotNull())
        disordered = ordered & (at != F.sort_array(at))
        detail = (F.when(F.size(missing) > 0, F.concat(F.lit("faltan: "), F.array_join(missing, ", ")))
                  .when(disordered, "las secciones están fuera de orden").otherwise("todas, en orden"))
        return _result((F.size(missing) == 0) & ~disordered, detail)

    return tx.let(tx.heading_offsets(text, names), judge)


def _words(text: Column, spec: dict[str, Any]) -> Column:
    return tx.let(tx.word_count(text), lambda n: _result(n <= spec["valor"], F.concat(n.cast("string"), F.lit(" palabras"))))


def _contains(text: Column, spec: dict[str, Any]) -> Column:
    return tx.let(tx.missing_words(text, spec["lista"]), lambda miss: _result(
        F.size(miss) == 0, F.when(F.size(miss) == 0, "todos presentes").otherwise(F.concat(F.lit("faltan "), F.array_join(miss, ", ")))))


def _figure(text: Column, spec: dict[str, Any]) -> Column:
    plain = F.col(PLAIN)  # made once for all figure checks
    if spec["tipo"] == "cifra_presente":
        found = fg.numbers(plain)
    else:
        after = F.regexp_extract_all(plain, F.lit(f"(?s)(?:{spec['etiqueta']})(?=(.{{0,{WINDOW}}}))"), F.lit(1))
        found = F.flatten(F.transform(after, fg.numbers))
    hit = F.exists(found, lambda r: fg.within(r["value"], spec["verdad"], spec.get("tolerancia", 0.005)))
    told = F.lit(f"verdad={spec['verdad']:.4f} ±{spec.get('tolerancia', 0.005)}; ")
    return tx.let(hit, lambda h: _result(h, F.concat(told, F.when(h, "hallada").otherwise("no hallada"))))


def _pages(text: Column, spec: dict[str, Any]) -> Column:
    n = F.col(spec.get("columna", "paginas"))
    return _result(n <= spec["valor"], F.concat(n.cast("string"), F.lit(" páginas")))


def _paths(text: Column, spec: dict[str, Any]) -> Column:
    n = F.size(F.filter(F.col(spec["columna"]), lambda p: p.rlike(spec["patron"])))
    return tx.let(n, lambda k: _result(k >= spec.get("minimo", 1), F.concat(k.cast("string"), F.lit(" archivo(s)"))))


def _provenance(text: Column, spec: dict[str, Any]) -> Column:
    share = F.col(spec["columna"])
    return _result(share >= spec.get("minimo", 1.0), F.concat(F.lit("procedencia "), F.format_string("%.2f", share)))


def _executed(text: Column, spec: dict[str, Any]) -> Column:
    return notebook_executed(F.col(spec["columna"]))


def _intact(text: Column, spec: dict[str, Any]) -> Column:
    return protected_cells(F.col(spec["columna"]), F.col(spec["contrato"]))


def _complete(text: Column, spec: dict[str, Any]) -> Column:
    """Cells whose contract fixes no hash are the editable ones; none may still be a placeholder."""
    open_cells = F.filter(F.zip_with(F.col(spec["columna"]), F.col(spec["contrato"]), lambda c, r: F.when(
        r["sha256"].isNull() & pending_text_cell(F.array_join(c["source"], "")), c["id"])), lambda x: x.isNotNull())
    return tx.let(F.size(open_cells), lambda n: _result(n == 0, F.concat(n.cast("string"), F.lit(" celdas por escribir"))))


#: Checks that read other columns than the text and hold without a deliverable.
COLUMN_CHECKS = {
    "archivo": _paths, "procedencia": _provenance, "ipynb_ejecutado": _executed, "celdas_intactas": _intact, "celdas_completas": _complete,
}
TEXT_CHECKS = {
    "secciones": _sections, "palabras_max": _words, "contiene": _contains, "cifra": _figure,
    "cifra_presente": _figure, "paginas_max": _pages,
}


def run_checks(docs: DataFrame, key: str, text: str, checks: list[dict[str, Any]]) -> DataFrame:
    """One row per document and check: ``key, check, tipo, ok, detalle``; no shuffle.

    A NULL text fails as a missing deliverable, an unknown type fails by name.
    """
    c = F.col(text)
    if any(TEXT_CHECKS.get(spec["tipo"]) is _figure for spec in checks):
        docs = docs.withColumn(PLAIN, tx.squeeze(tx.without_code(c)))
    rows = []
    for spec in checks:
        build = TEXT_CHECKS.get(spec["tipo"]) or COLUMN_CHECKS.get(spec["tipo"])
        r = build(c, spec) if build else _result(F.lit(False), F.lit(f"tipo desconocido: {spec['tipo']}"))
        if spec["tipo"] not in COLUMN_CHECKS:
            r = F.when(c.isNull(), _result(F.lit(False), F.lit("no hay entregable"))).otherwise(r)
        rows.append(F.struct(F.lit(spec["id"]).alias("check"), F.lit(spec["tipo"]).alias("tipo"), r.alias("r")))
    return docs.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.check", "x.tipo", "x.r.ok", "x.r.detalle")


def files_check(files: DataFrame, key: str, path: str, pattern: str, minimum: int = 1) -> DataFrame:
    """``archivo``: at least ``minimum`` paths of each run match the pattern."""
    hits = F.sum(F.when(F.col(path).rlike(pattern), 1).otherwise(0))
    return files.groupBy(key).agg(hits.cast("bigint").alias("n")).select(
        key, (F.col("n") >= minimum).cast("int").alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" archivo(s)")).alias("detalle"))


def notebook_executed(cells: Column) -> Column:
    """``ipynb_ejecutado``: code cells exist, all were run, none failed.

    Cells are ``struct<cell_type, execution_count, outputs: array<struct<output_type,…>>>``.
    """
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    idle = F.size(F.filter(code, lambda c: c["execution_count"].isNull()))
    failed = F.size(F.filter(F.flatten(F.transform(code, lambda c: F.coalesce(
        F.transform(c["outputs"], lambda o: o["output_type"]), F.array().cast("array<string>")))), lambda t: t == "error"))
    return _result((F.size(code) > 0) & (idle == 0) & (failed == 0), F.concat_ws(
        ", ", F.concat(F.size(code).cast("string"), F.lit(" celdas de código")),
        F.concat(idle.cast("string"), F.lit(" sin ejecutar")), F.concat(failed.cast("string"), F.lit(" con error"))))


def protected_cells(cells: Column, contract: Column) -> Column:
    """``celdas_intactas``: same ids in the same order and unchanged hashes of protected cells."""
    ids = F.transform(cells, lambda c: c["id"])
    want = F.transform(contract, lambda r: r["id"])
    changed = F.filter(F.zip_with(cells, contract, lambda c, r: F.when(
        r["sha256"].isNotNull() & (F.sha2(F.array_join(c["source"], ""), 256) != r["sha256"]), r["id"])), lambda x: x.isNotNull())
    return F.when(~ids.eqNullSafe(want), _result(F.lit(False), F.lit("los ids o el orden de las celdas cambiaron"))).otherwise(
        _result(F.size(changed) == 0, F.concat(F.size(changed).cast("string"), F.lit(" celdas protegidas cambiadas"))))


def pending_text_cell(source: Column) -> Column:
    """An editable text cell still to be written: placeholder or fewer than ten characters."""
    first = F.instr(source, "\n\n")
    body = tx.strip(F.when(first > 0, F.substring(source, first + 2, F.length(source))).otherwise(source))
    return source.rlike("ESCRIBE AQU[IÍ]") | (F.length(body) < 10)


def tally(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.sum("ok").cast("bigint").alias("aprobadas"), F.count("*").alias("total"))
