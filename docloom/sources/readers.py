"""Readers: document packages, notebooks, event logs, typed CSV, artifacts, deliverables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.figures import artifact_values, numbers
from docloom.functions.text import normalise_text, py_lines

# Artifact suffixes, paths that never back a figure, folders that are not input.
ARTIFACT_SUFFIXES = ["json", "csv", "txt", "log", "out"]
NOT_EVIDENCE = r"traza|grafo|comunidades|plan|resumen|cache|enunciado|\.mpl"
HANDED_ON = ["json", "csv", "png", "parquet", "npy", "txt"]
CONSOLE = ["stdout.txt", "stderr.txt"]
NOT_INPUT = r"/(\.venv|output|__pycache__)/"

TRACE_SCHEMA = (
    "seq BIGINT, ts DOUBLE, tipo STRING, agente STRING, subtarea STRING, modelo STRING, tokens_entrada BIGINT, "
    "tokens_salida BIGINT, latencia_s DOUBLE, fin STRING, intento BIGINT, error STRING, decision STRING, motivo STRING, "
    "por STRING, status STRING, returncode BIGINT, duracion_s DOUBLE, archivos ARRAY<STRING>, subtareas MAP<STRING,STRING>"
)
NOTEBOOK_SCHEMA = (
    "cells ARRAY<STRUCT<id: STRING, cell_type: STRING, execution_count: BIGINT, source: VARIANT, outputs: ARRAY<STRUCT<"
    "output_type: STRING, text: VARIANT, data: MAP<STRING, VARIANT>>>>>"
)


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Whole files under ``root`` with their path; the order of paths is the reading order."""
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return r.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def joined(v: Column) -> Column:
    """Notebook text fields are a string or a list of strings."""
    parts = F.try_variant_get(v, "$", "array<string>")
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(parts, "")), F.try_variant_get(v, "$", "string"), F.lit(""))


def notebooks(spark: SparkSession, root: str) -> DataFrame:
    """``path, cells`` with source and output texts flattened."""
    raw = spark.read.schema(NOTEBOOK_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.ipynb").json(root)

    def output(o: Column) -> Column:
        data = lambda k: F.when(F.map_contains_key(o["data"], k), joined(F.element_at(o["data"], k)))
        return F.struct(o["output_type"].alias("output_type"), F.when(o["text"].isNotNull(), joined(o["text"])).alias("text"),
                        data("text/plain").alias("plain"), data("text/markdown").alias("markdown"),
                        F.coalesce(F.map_contains_key(o["data"], "image/png"), F.lit(False)).alias("png"))

    cell = lambda c: F.struct(c["id"].alias("id"), c["cell_type"].alias("cell_type"), c["execution_count"].alias("execution_count"),
                              joined(c["source"]).alias("source"),
                              F.transform(F.coalesce(c["outputs"], F.array()), output).alias("outputs"))
    return raw.select(F.col("_metadata.file_path").alias("path"), F.transform("cells", cell).alias("cells"))


def notebook_text(cells: Column, with_outputs: bool = True) -> Column:
    """Markdown sources and, on request, the text outputs of code cells."""
    outs = lambda c: F.flatten(F.transform(c["outputs"], lambda o: F.array_compact(F.array(o["text"], o["plain"], o["markdown"]))))
    none = F.array().cast("array<string>")
    part = lambda c: F.when(c["cell_type"] == "markdown", F.array(c["source"])).when(
        (c["cell_type"] == "code") & F.lit(with_outputs), outs(c)).otherwise(none)
    return F.array_join(F.flatten(F.transform(cells, part)), "\n")


def notebook_outputs(cells: Column) -> Column:
    outs = lambda c: F.array_join(F.transform(c["outputs"], lambda o: F.concat(F.coalesce(o["text"], F.lit("")), F.coalesce(o["plain"], F.lit("")))), "\n")
    return F.array_join(F.transform(cells, outs), "\n")


def package_lines(spark: SparkSession, root: str) -> DataFrame:
    """``path, lines`` of every readable file of a package (Markdown, text, notebook sources)."""
    text = _files(spark, root, "*.{md,txt}").select("path", py_lines(normalise_text(F.col("text"))).alias("lines"))
    nb = notebooks(spark, root).select("path", F.flatten(F.transform("cells", lambda c: py_lines(c["source"]))).alias("lines"))
    return text.unionByName(nb)


def data_folder(path: str) -> str | None:
    """The package itself, or the ``data`` folder beside a single input file."""
    if os.path.isdir(path):
        return path
    beside = os.path.join(os.path.dirname(path), "data")
    return beside if os.path.isdir(beside) else None


def notes(spark: SparkSession, root: str) -> DataFrame:
    """``fuente, lines`` of the Markdown notes."""
    f = _files(spark, root, "*.md")
    return f.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("fuente"), py_lines(F.col("text")).alias("lines"))


def notes_fingerprint(spark: SparkSession, root: str, *settings: str) -> str:
    """Twelve hex digits over file names, contents and settings: one digest per file, then one over all."""
    f = _files(spark, root, "*.md").select(F.sha2(F.concat_ws("|", F.regexp_extract("path", r"([^/]+)$", 1), F.sha2("text", 256)), 256).alias("h"))
    # Digests are folded order-free on the cluster: the driver sees one number per 32-bit lane.
    lanes = f.agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)])
    row = lanes.select(F.left(F.sha2(F.concat_ws("|", *map(F.lit, settings), "n", *[f"s{i}" for i in range(8)]), 256), F.lit(12))).first()
    return row[0]


def traces(spark: SparkSession, glob: str) -> DataFrame:
    """Event logs, one JSON object per line; the task id comes from the folder ``tarea-<id>``."""
    d = spark.read.schema(TRACE_SCHEMA).json(glob)
    return d.withColumn("tarea", F.regexp_extract(F.col("_metadata.file_path"), r"tarea-([^/]+)/", 1))


def check_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema("tarea STRING, check STRING, tipo STRING, ok INT, detalle STRING").csv(path)


def judge_rows(spark: SparkSession, path: str) -> DataFrame:
    """Judge verdicts; an empty verdict is NULL."""
    return spark.read.option("header", "true").schema(
        "variante STRING, repeticion INT, tarea STRING, check STRING, tipo STRING, golden INT, juez INT, detalle STRING, formato STRING, razon STRING").csv(path)


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def input_text(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of what a run was given; notebooks give their sources only."""
    f = _files(spark, root, "*.{md,txt}").select("path", "text")
    nb = notebooks(spark, root).select("path", F.array_join(F.transform("cells", lambda c: c["source"]), "\n").alias("text"))
    return f.unionByName(nb).where(~F.col("path").rlike(NOT_INPUT))


def artifact_numbers(spark: SparkSession, root: str, exclude: list[str] = (), evaluator: bool = True) -> DataFrame:
    """``value`` rows of everything the runs wrote, notebook outputs included.

    Files of any size are read line by line.  The evaluator reads figures and skips paths that are no evidence; the writer's
    own check reads scientific notation as well and skips temporary folders.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ARTIFACT_SUFFIXES) + "}").text(root)
    f = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rel = F.replace(F.col("path"), F.lit(root.rstrip("/")), F.lit(""))
    f = f.where(~rel.rlike(NOT_EVIDENCE)) if evaluator else f.where(~F.col("path").rlike(r"/\.tmp/"))
    if exclude:
        f = f.where(~F.col("path").rlike("(" + "|".join(f"\\Q{e}\\E" for e in exclude) + ")$"))
    nb = notebooks(spark, root).select(notebook_outputs(F.col("cells")).alias("text"))
    text = f.select("text").unionByName(nb)
    if evaluator:
        return text.select(F.explode(numbers(F.col("text"))).alias("r")).select("r.value")
    return text.select(F.explode(artifact_values(F.col("text"))).alias("value"))


def deliverable_path(files: DataFrame, pattern: str) -> DataFrame:
    """First path that matches, those at the top of the folder before deeper ones."""
    depth = F.size(F.split("path", "/"))
    return files.where(F.col("path").rlike(pattern)).agg(F.min_by("path", F.struct(depth, F.col("path"))).alias("path"))


def approved_outputs(files: DataFrame, approved: DataFrame, subtask: str) -> DataFrame:
    """Files of approved subtasks that later ones may read."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kept = name.rlike(r"\.(" + "|".join(HANDED_ON) + ")$") & ~name.isin(*CONSOLE)
    return files.where(kept).join(approved.select(subtask).distinct(), subtask, "left_semi")


def new_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that appeared during a run."""
    return after.select("path").exceptAll(before.select("path"))


def attempt_files(files: DataFrame) -> DataFrame:
    """Attempt folders of each subtask, approved and rejected, with their files."""
    p = F.col("path")
    kind = F.when(p.contains("/rechazados/"), "RECHAZADO").when(p.contains("/subtareas/"), "intento")
    a = files.where(kind.isNotNull()).select(
        F.regexp_extract("path", r"/(?:subtareas|rechazados)/([^/]+)/", 1).alias("subtarea"), kind.alias("clase"),
        F.regexp_extract("path", r"/(intento-[^/]+)/", 1).alias("intento"), F.regexp_extract("path", r"([^/]+)$", 1).alias("archivo"))
    return a.where(F.col("intento") != "").groupBy("subtarea", "clase", "intento").agg(F.count("*").alias("archivos"))
