"""Registered plans that write a table with a sink and read it back with the matching reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions.text import MASK
from docloom.operators import graph as gr
from docloom.session import ensure_checkpoint_dir, table
from docloom.sources import readers, writers


def _folder(spark):
    """A new folder under the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/io-{uuid.uuid4().hex}"


def io_csv(spark, sf):
    """CSV sink with a header, typed CSV scan."""
    at = _folder(spark)
    writers.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), at)
    return readers.typed_csv(spark, at, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")


def io_event_log(spark, sf):
    """Event logs of several tasks as JSON lines, scanned by one glob; the task comes from the folder."""
    at = _folder(spark)
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("tipo"), F.col("user_id").cast("string").alias("agente"), F.col("value").alias("latencia_s"))
    for t in ("A", "B"):
        e.where((F.col("seq") % 2 == 0) == F.lit(t == "A")).write.json(f"{at}/tarea-{t}/")
    return readers.traces(spark, f"{at}/tarea-*/").groupBy("tarea", "tipo").agg(
        F.count("*").alias("n"), F.count_distinct("agente").alias("agentes"), F.round(F.sum("latencia_s"), 2).alias("latencia"))


def io_masked_log(spark, sf):
    """A log with secrets in it, masked on the way to its copy."""
    at = _folder(spark)
    c = table(spark, sf, "conversations")
    secret = F.concat(F.lit('token = "abcd'), F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit('"'))
    c.select(F.to_json(F.struct("conv_id", "turn", secret.alias("motivo")))).write.text(f"{at}/raw")
    writers.masked_log(spark, f"{at}/raw", f"{at}/masked")
    m = spark.read.text(f"{at}/masked")
    return m.select(F.get_json_object("value", "$.conv_id").cast("bigint").alias("conv_id"), F.col("value").contains(MASK).cast("int").alias("tapada"),
                    F.col("value").contains("abcd0").cast("int").alias("visible")).groupBy("conv_id").agg(
        F.count("*").alias("lineas"), F.sum("tapada").alias("tapadas"), F.sum("visible").alias("visibles"))


def io_artifacts(spark, sf):
    """Artifact files of any size, read line by line for the numbers they hold."""
    at = _folder(spark)
    table(spark, sf, "events").select(F.concat(F.lit("medida "), "event_type", F.lit(" = "), F.format_string("%.2f", "value"))).write.text(f"{at}/run")
    n = readers.artifact_numbers(spark, f"{at}/run")
    return n.groupBy(F.floor(F.col("value") / 10).alias("decena")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("suma"))


def io_graph(spark, sf):
    """Nodes and edges of a graph, stored and read again."""
    at = _folder(spark)
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).groupBy("a", "b").agg(F.count("*").alias("w"))
    nodes = gr.both_ways(e).groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    writers.write_graph(nodes, e, at)
    back = spark.read.parquet(f"{at}/edges")
    return gr.both_ways(back).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("vecinos")).join(spark.read.parquet(f"{at}/nodes"), "node")


def io_json_documents(spark, sf):
    """JSON documents, one object per file part, scanned with a fixed schema."""
    at = _folder(spark)
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("media"))
    p.write.json(at)
    return spark.read.schema("p_brand STRING, n BIGINT, media DOUBLE").json(at)


def io_check_results(spark, sf):
    """Check results and judge verdicts as CSV; an empty verdict is NULL when it is read."""
    at = _folder(spark)
    d = table(spark, sf, "labels")
    writers.write_csv(d.select(F.lit("A").alias("tarea"), F.concat(F.lit("K"), "doc_id").alias("check"), F.lit("cifra").alias("tipo"), F.col("quality").alias("ok"), F.lit("x").alias("detalle")), f"{at}/checks")
    seen = F.when(F.col("doc_id") % 3 != 0, F.col("toxic").cast("string")).otherwise("")
    writers.write_csv(d.select(
        F.lit("v").alias("variante"), F.lit(1).alias("repeticion"), F.lit("A").alias("tarea"), F.concat(F.lit("K"), "doc_id").alias("check"), F.lit("cifra").alias("tipo"),
        F.col("quality").alias("golden"), seen.alias("juez"), F.lit("").alias("detalle"), F.lit("completo").alias("formato"), F.lit("r").alias("razon")), f"{at}/judge")
    c = readers.check_results(spark, f"{at}/checks").select("check", "ok")
    return c.join(readers.judge_rows(spark, f"{at}/judge").select("check", "golden", "juez"), "check")


def io_input_text(spark, sf):
    """Texts a run was given: every turn of every conversation, dealt to forty folders, read as whole files."""
    at = _folder(spark)
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 40).cast("string").alias("k"), F.regexp_replace("text", r"[\r\n]", " ").alias("text"))
    c.write.partitionBy("k").text(f"{at}/in")
    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    r = readers.input_text(spark, f"{at}/in").select(F.regexp_extract("path", r"/k=([^/]+)/", 1).cast("bigint").alias("k"), lines.alias("l"))
    return r.groupBy("k").agg(F.sum(F.size("l")).cast("bigint").alias("turnos"), F.sum(F.aggregate("l", F.lit(0), lambda a, x: a + F.length(x))).cast("bigint").alias("n"))


def io_verified(spark, sf):
    """Parquet written, read back and compared as a multiset with its source, both ways."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    r = writers.verified_parquet(o, _folder(spark))
    return o.agg(F.count("*").alias("filas")).select("filas", *[F.lit(int(v)).alias(k) for k, v in r.items()])


QUERIES = {f.__name__: f for f in (io_csv, io_event_log, io_masked_log, io_artifacts, io_graph, io_json_documents, io_check_results, io_input_text, io_verified)}

ORACLES = {
    "io_csv": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "io_event_log": "SELECT CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS tarea, event_type AS tipo, count(*) AS n, count(DISTINCT user_id) AS agentes, round(sum(value), 2) AS latencia FROM events GROUP BY ALL",
    "io_masked_log": "SELECT conv_id, count(*) AS lineas, count(*) AS tapadas, 0::BIGINT AS visibles FROM conversations GROUP BY conv_id",
    "io_artifacts": "SELECT floor(v / 10)::BIGINT AS decena, count(*) AS n, round(sum(v), 2) AS suma FROM (SELECT printf('%.2f', value)::DOUBLE AS v FROM events) GROUP BY 1",
    "io_graph": "WITH e AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS w FROM lineitem GROUP BY ALL), x AS (SELECT a AS u, w FROM e UNION ALL SELECT b, w FROM e) SELECT u AS node, count(*) AS vecinos, sum(w)::BIGINT AS k FROM x GROUP BY u",
    "io_json_documents": "SELECT p_brand, count(*) AS n, round(avg(p_size), 6) AS media FROM part GROUP BY p_brand",
    "io_check_results": "SELECT 'K' || doc_id::VARCHAR AS \"check\", quality::INT AS ok, quality::INT AS golden, CASE WHEN doc_id % 3 <> 0 THEN toxic::INT END AS juez FROM labels",
    "io_input_text": "SELECT conv_id % 40 AS k, count(*) AS turnos, sum(length(text))::BIGINT AS n FROM conversations GROUP BY 1",
    "io_verified": "SELECT count(*) AS filas, 1 AS columns, 1 AS schema, 1 AS lost, 1 AS added FROM orders",
}
