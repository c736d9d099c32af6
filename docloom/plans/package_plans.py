"""Registered plans over packages of files: written from the tables first, then read back through the package source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.operators import sections as sec
from docloom.session import ensure_checkpoint_dir, table
from docloom.sources import package as pk
from docloom.sources import readers, writers

RUNS = 40  # folders that the turns are dealt to


def _folder(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/p-{uuid.uuid4().hex}"


def _by_run(df, at, suffix, name):
    """One text file per run folder (a run's rows stay in order of their key); the folder names the run."""
    return _stored(df.select(F.concat(F.lit("run-"), (F.col("conv_id") % RUNS).cast("string"), F.lit(f"/{name}.{suffix}")).alias("path"), "conv_id", "turn", F.col("linea")), at)


def _stored(rows, at):
    """Files below ``at`` from ``path, conv_id, turn, linea``, each written by the one task that holds its rows, in their order."""

    def write(batches):
        import posixpath

        import pandas as pd

        system, base = pk._open(at)
        path, out, n = None, None, 0
        try:
            for b in batches:
                for p, lines in b.groupby("path", sort=False)["linea"]:
                    if p != path:
                        if out:
                            out.close()
                        system.create_dir(posixpath.dirname(posixpath.join(base, p)))
                        path, out, n = p, system.open_output_stream(posixpath.join(base, p)), n + 1
                    out.write(("\n".join(lines) + "\n").encode())
        finally:
            if out:
                out.close()
        yield pd.DataFrame({"n": [n]})

    dealt = rows.select("path", "conv_id", "turn", "linea").repartition("path").sortWithinPartitions("path", "conv_id", "turn", "linea")
    return dealt.select("path", "linea").mapInPandas(write, "n long").agg(F.sum("n")).first()


def _run(path="path"):
    return F.regexp_extract(path, r"^run-(\d+)/", 1).cast("bigint")


def package_lines(spark, sf):
    """Texts of all turns as Markdown, log and JSON lines of many runs, read by byte ranges much smaller than the files."""
    at = _folder(spark)
    c = table(spark, sf, "conversations")
    flat = F.regexp_replace("text", r"[\r\n]", " ")
    _by_run(c.select("conv_id", "turn", flat.alias("linea")), at, "md", "informe")
    _by_run(c.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("log "), flat).alias("linea")), at, "log", "output/traza")
    _by_run(c.select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn")).alias("linea")), at, "jsonl", "datos")
    r = pk.read_package(spark, at, byte_range=4096)
    shown = pk.input_lines(r).select(_run().alias("run"), "clase", "pos", "texto")
    seen = pk.read_package(spark, at, input_only=True, byte_range=4096).groupBy(_run().alias("run")).agg(F.count(F.lit(1)).alias("de_entrada"))
    g = shown.groupBy("run", "clase").agg(F.count(F.lit(1)).alias("lineas"), F.sum(F.length("texto")).cast("bigint").alias("caracteres"), F.count_distinct("pos").alias("posiciones"))
    return g.join(seen, "run")


def package_notebooks(spark, sf):
    """Every conversation as a notebook, cells streamed one by one: sources and outputs by kind."""
    at = _folder(spark)
    c = table(spark, sf, "conversations")
    out = F.to_json(F.struct(F.lit("stream").alias("output_type"), F.concat(F.lit("salida "), F.col("turn").cast("string")).alias("text")))
    head = F.to_json(F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type"), F.array("text", F.lit("\nfin")).alias("source")))
    cell = F.concat(F.expr("left(h, length(h) - 1)"), F.when(F.col("role") == "assistant", F.concat(F.lit(',"outputs":['), "o", F.lit("]"))).otherwise(""), F.lit("}"))
    rows = c.select("conv_id", "turn", "role", head.alias("h"), out.alias("o")).select("conv_id", "turn", cell.alias("c"))
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("z"))
    line = F.concat(F.when(F.col("turn") == F.col("a"), '{"cells": [').otherwise(","), "c", F.when(F.col("turn") == F.col("z"), '], "nbformat": 4}').otherwise(""))
    j = rows.join(first, "conv_id").select(F.concat(F.lit("run-"), F.col("conv_id").cast("string"), F.lit("/solucion.ipynb")).alias("path"), "conv_id", "turn", line.alias("linea"))
    _stored(j, at)
    r = pk.read_package(spark, at)
    said = pk.deliverable_lines(r).groupBy(_run().alias("conv_id")).agg(F.count(F.lit(1)).alias("partes"))
    g = r.groupBy(_run().alias("conv_id")).agg(
        F.count_distinct("parte").alias("celdas"), F.sum((F.col("campo") == "code").cast("int")).cast("bigint").alias("codigo"), F.sum((F.col("campo") == "text").cast("int")).cast("bigint").alias("salidas"),
        F.sum(F.when(F.col("campo").isin("code", "markdown"), F.length("texto"))).cast("bigint").alias("caracteres"), F.max(F.when(F.col("campo") == "text", F.col("texto"))).alias("ultima"))
    return g.join(said, "conv_id", "left").na.fill(0, ["partes"])


def package_deliverables(spark, sf):
    """Files of many runs at several depths: of each run the deliverable, those at the top first, with its lines."""
    at = _folder(spark)
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[\r\n]", " ").alias("linea"))
    where = F.when(F.col("turn") % 3 == 0, "b/informe.md").when(F.col("turn") % 3 == 1, "a/b/informe.md").otherwise("informe.txt")
    top = F.when((F.col("conv_id") % RUNS % 4 == 0) & (F.col("turn") % 3 == 0), "zz.md").otherwise(where)
    _stored(c.select(F.concat(F.lit("run-"), (F.col("conv_id") % RUNS).cast("string"), F.lit("/"), top).alias("path"), "conv_id", "turn", "linea"), at)
    files = pk.file_list(spark, at)
    d = pk.deliverables(files, r"\.md$", _run())
    r = pk.deliverable_lines(pk.read_package(spark, at, byte_range=1 << 16))
    return d.join(r, "path").groupBy("run", "path").agg(F.count(F.lit(1)).alias("lineas"), F.sum(F.length("texto")).cast("bigint").alias("caracteres"))


def package_notes(spark, sf):
    """Pages as Markdown notes of many sources, packed into chunks after the package source has read their lines."""
    at = _folder(spark)
    d = table(spark, sf, "documents").where(F.col("text") != "")
    parts = F.filter(F.split("text", "\n"), lambda x: ~x.startswith("#") & ~x.startswith("`") & (F.trim(x) != ""))
    body = d.select("doc_id", F.posexplode(F.concat(F.array(F.concat(F.lit("## Nota "), F.col("doc_id").cast("string"))), parts)).alias("turn", "linea"))
    _stored(body.select(F.concat(F.lit("notas/n"), (F.col("doc_id") % 64).cast("string"), F.lit(".md")).alias("path"), F.col("doc_id").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.regexp_replace("linea", r"[\x{85}\x{2028}\x{2029}\x0B\x0C\x1C-\x1E\r]", " ").alias("linea")), at)
    r = pk.read_package(spark, at, byte_range=1 << 16)
    n = sec.note_line_chunks(r.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("fuente"), "pos", "texto"), "fuente", "pos", "texto")
    return n.groupBy("fuente").agg(F.count(F.lit(1)).alias("fragmentos"), F.sum(F.size("titulos")).cast("bigint").alias("titulos"))


def new_and_attempt_files(spark, sf):
    """Files that appeared during a run, and the attempt folders of each subtask with their files."""
    before, after = _folder(spark), _folder(spark)
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.lit("x").alias("linea"))
    kind = F.when(F.col("turn") % 4 == 3, "rechazados").otherwise("subtareas")
    path = F.concat(kind, F.lit("/T"), (F.col("conv_id") % 20).cast("string"), F.lit("/intento-"), F.col("turn").cast("string"), F.lit("/f"), (F.col("conv_id") % 3).cast("string"), F.lit(".csv"))
    files = c.select(path.alias("path"), "conv_id", "turn", "linea")
    _stored(files.where("turn < 2"), before)
    _stored(files, after)
    fresh = readers.new_files(pk.file_list(spark, before), pk.file_list(spark, after)).select(F.concat(F.lit("/"), "path").alias("path"))
    return readers.attempt_files(fresh)


def vector_cache(spark, sf):
    """Vectors written to the cache by id and read back: every id once, the same numbers."""
    at = _folder(spark)
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    writers.write_vectors(e, at)
    j = e.join(spark.read.parquet(at).withColumnRenamed("embedding", "b"), "vec_id")
    return j.select("vec_id", (F.col("embedding") == F.col("b")).cast("int").alias("igual"), F.size("b").cast("bigint").alias("ancho"))


QUERIES = {f.__name__: f for f in (package_lines, package_notebooks, package_deliverables, package_notes, new_and_attempt_files, vector_cache)}

_FLAT = "regexp_replace(text, '[\\r\\n]', ' ', 'g')"
ORACLES = {
    "package_lines": f"""WITH c AS (SELECT conv_id % {RUNS} AS run, role, length({_FLAT}) AS n, length('{{"conv_id":' || conv_id || ',"turn":' || turn || '}}') AS m FROM conversations), e AS (SELECT run, 2 * count(*) AS de_entrada FROM c GROUP BY run),
        g AS (SELECT run, 'md' AS clase, count(*) AS lineas, sum(n)::BIGINT AS caracteres FROM c GROUP BY run UNION ALL SELECT run, 'jsonl', count(*), sum(m)::BIGINT FROM c GROUP BY run UNION ALL SELECT run, 'log', count(*), sum(n + 4)::BIGINT FROM c WHERE role = 'user' GROUP BY run)
        SELECT g.*, lineas AS posiciones, de_entrada FROM g JOIN e USING (run)""",
    "package_notebooks": """SELECT conv_id, count(*) AS celdas, count(*) FILTER (WHERE role = 'assistant') AS codigo, count(*) FILTER (WHERE role = 'assistant') AS salidas, sum(length(text) + 4)::BIGINT AS caracteres,
        max('salida ' || turn) FILTER (WHERE role = 'assistant') AS ultima, count(*) AS partes FROM conversations GROUP BY conv_id""",
    "package_deliverables": f"""WITH c AS (SELECT conv_id % {RUNS} AS run, length({_FLAT}) AS n, CASE WHEN turn % 3 = 0 AND conv_id % {RUNS} % 4 = 0 THEN 'zz.md' WHEN turn % 3 = 0 THEN 'b/informe.md' WHEN turn % 3 = 1 THEN 'a/b/informe.md' ELSE 'informe.txt' END AS p FROM conversations),
        d AS (SELECT run, arg_min(p, (len(string_split(p, '/')), p)) AS p FROM c WHERE p LIKE '%.md' GROUP BY run) SELECT d.run, 'run-' || d.run || '/' || d.p AS path, count(*) AS lineas, sum(n)::BIGINT AS caracteres FROM d JOIN c ON c.run = d.run AND c.p = d.p GROUP BY d.run, d.p""",
    "package_notes": """SELECT 'n' || doc_id % 64 AS fuente, count(*) AS fragmentos, count(*)::BIGINT AS titulos FROM documents WHERE text <> '' GROUP BY 1""",
    "new_and_attempt_files": """SELECT 'T' || conv_id % 20 AS subtarea, CASE WHEN turn % 4 = 3 THEN 'RECHAZADO' ELSE 'intento' END AS clase, 'intento-' || turn AS intento, count(DISTINCT conv_id % 3) AS archivos FROM conversations WHERE turn >= 2 GROUP BY ALL""",
    "vector_cache": "SELECT vec_id, 1::INT AS igual, len(embedding)::BIGINT AS ancho FROM embeddings",
}
