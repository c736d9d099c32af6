"""Registered plans for verdicts, candidate sections, index costs and the draft-loop audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.figures import fraction_in_detail
from docloom.operators import critic
from docloom.operators import sections as sec
from docloom.plans.text_plans import ORACLES as TEXT_SQL
from docloom.plans.text_plans import page_lines
from docloom.session import table


def critic_verdicts(spark, sf):
    """One execution per event: results, files and criterion come from its type and value."""
    t, v = F.col("event_type"), F.col("value")
    leaf = lambda p, x: F.struct(F.lit(p).alias("path"), x.alias("value"))
    leaves = (F.when(t == "error", F.lit(None)).when(t == "signup", F.array().cast("array<struct<path:string,value:double>>"))
              .otherwise(F.array(leaf("m.accuracy", v / 100), leaf("m.loss", F.when(v < 1, F.lit(float("nan"))).otherwise(v)))))
    e = table(spark, sf, "events").select(
        "event_id", F.when(v > 200, 1).otherwise(0).alias("rc"), F.when(v > 300, F.lit("tiempo agotado")).alias("err"), leaves.alias("lv"),
        F.when(t == "view", F.lit("dibuja una curva")).otherwise(F.lit("calcula la media")).alias("w"),
        F.when(F.col("user_id") % 2 == 0, F.array(F.lit("a.png"))).otherwise(F.array(F.lit("a.csv"))).alias("f"))
    r = critic.reasons(F.col("rc"), F.col("err"), F.col("lv"), F.col("w"), F.col("f"))
    return e.select("event_id", F.array_join(r, "; ").alias("motivos"), (F.size(r) == 0).cast("int").alias("aprobado"))


def candidate_sections(spark, sf):
    """Sections worth extracting from: with text, and only work sections where a page has any."""
    d = table(spark, sf, "pages").select("page_id", sec.segment(sec.plain_lines(page_lines())).alias("s"))
    filled = F.filter("s", lambda x: x["texto"] != "")
    work = F.filter(filled, lambda x: x["trabajo"])
    return d.select("page_id", F.explode(F.when(F.size(work) > 0, work).otherwise(filled)).alias("x")).select("page_id", "x.titulo", F.md5("x.texto").alias("md5"))


def index_costs(spark, sf):
    """Cost table of the text index per language: chunks, distinct sources, characters."""
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("fragmentos"), F.count_distinct("source").alias("fuentes"), F.sum("n_chars").cast("bigint").alias("caracteres"))


def provenance_column(spark, sf):
    """The fraction printed in each check's detail, 1.00 for a pass without one."""
    ok = F.col("quality")
    d = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("7/9 cifras respaldadas ("), F.format_string("%.2f", (F.col("doc_id") % 100) / 100.0), F.lit(")"))).otherwise("sin cifras")
    return table(spark, sf, "labels").select("doc_id", fraction_in_detail(d, ok).alias("procedencia"))


def unioned_sources(spark, sf):
    """Lines of documents, pages' URLs and conversation turns as one line source with counts per kind."""
    parts = [("documento", "documents", F.explode(F.split("text", "\n"))), ("url", "pages", F.col("url")), ("turno", "conversations", F.explode(F.split("text", "\n")))]
    out = None
    for kind, name, line in parts:
        p = table(spark, sf, name).select(line.alias("texto")).withColumn("fuente", F.lit(kind))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("fuente").agg(F.count("*").alias("lineas"), F.sum(F.length("texto")).cast("bigint").alias("caracteres"))


def cross_checked_keys(spark, sf):
    """Cross-check of two copies of a table: keys and values of the line totals per order against the orders table."""
    net = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("lineas"), net.alias("neto"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("orden"), "o_totalprice")
    same = F.abs(F.col("neto") - F.col("o_totalprice")) <= 1000
    j = li.join(o, "k", "full")
    return j.agg(F.count("*").alias("claves"), F.sum(F.col("lineas").isNull().cast("int")).cast("bigint").alias("sin_lineas"),
                 F.sum(F.col("orden").isNull().cast("int")).cast("bigint").alias("sin_orden"),
                 F.sum(same.cast("int")).cast("bigint").alias("valores_cercanos"), F.sum((~same).cast("int")).cast("bigint").alias("valores_distintos"))


QUERIES = {f.__name__: f for f in (critic_verdicts, candidate_sections, index_costs, provenance_column, unioned_sources, cross_checked_keys)}

_PS = TEXT_SQL["page_sections"]
_TAIL = _PS[_PS.rindex("SELECT page_id, sec_no, titulo"):]

ORACLES = {
    "critic_verdicts": """WITH e AS (SELECT *, CASE WHEN value > 200 THEN 1 ELSE 0 END AS rc, event_type NOT IN ('error','signup') AS full_ FROM events),
        r AS (SELECT event_id, list_filter([CASE WHEN value > 300 THEN 'tiempo agotado' END, CASE WHEN rc = 1 AND value <= 300 THEN 'el script terminó con código 1' END,
          CASE WHEN rc = 0 AND event_type = 'error' THEN 'no escribió resultados.json (es el contrato)' END, CASE WHEN rc = 0 AND event_type = 'signup' THEN 'resultados.json no es un objeto con cifras' END,
          CASE WHEN rc = 0 AND full_ AND value < 1 THEN 'hay NaN o infinitos en resultados.json: m.loss' END,
          CASE WHEN rc = 0 AND full_ AND value / 100 >= 0.999 THEN 'plausibilidad: métricas ≥ 0,999 en un problema con ruido: m.accuracy' END,
          CASE WHEN rc = 0 AND event_type = 'view' AND user_id % 2 <> 0 THEN 'el criterio pide una figura y el script no guardó ningún PNG' END], lambda x: x IS NOT NULL) AS m FROM e)
        SELECT event_id, array_to_string(m, '; ') AS motivos, (len(m) = 0)::INT AS aprobado FROM r""",
    "candidate_sections": _PS.replace(_TAIL, "SELECT page_id, titulo, md5(tx) AS md5 FROM r WHERE tx <> ''"),
    "index_costs": "SELECT lang, count(*) AS fragmentos, count(DISTINCT source) AS fuentes, sum(n_chars)::BIGINT AS caracteres FROM documents GROUP BY lang",
    "provenance_column": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN printf('%.2f', (doc_id % 100) / 100.0::DOUBLE) WHEN quality = 1 THEN '1.00' ELSE '' END AS procedencia FROM labels",
    "unioned_sources": "WITH l AS (SELECT 'documento' AS fuente, unnest(string_split(text, chr(10))) AS t FROM documents UNION ALL SELECT 'url', url FROM pages UNION ALL SELECT 'turno', unnest(string_split(text, chr(10))) FROM conversations) SELECT fuente, count(*) AS lineas, sum(length(t))::BIGINT AS caracteres FROM l GROUP BY fuente",
    "cross_checked_keys": """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS neto FROM lineitem GROUP BY 1)
        SELECT count(*) AS claves, count(*) FILTER (WHERE l.k IS NULL) AS sin_lineas, count(*) FILTER (WHERE o_orderkey IS NULL) AS sin_orden,
          count(*) FILTER (WHERE abs(neto - o_totalprice) <= 1000) AS valores_cercanos, count(*) FILTER (WHERE abs(neto - o_totalprice) > 1000) AS valores_distintos FROM l FULL JOIN orders ON k = o_orderkey""",
}
