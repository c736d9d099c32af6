"""Registered plans for literal quotes, nested sizes, embedding events, heading kinds and the lists an assignment states."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions import limits as lm
from docloom.functions import text as tx
from docloom.functions.nested import container_sizes
from docloom.functions.quotes import quote_spans
from docloom.functions.vectors import embedding_with_events
from docloom.operators import sections as sec
from docloom.session import ensure_checkpoint_dir, table


def _folder(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/d-{uuid.uuid4().hex}"


def literal_quotes(spark, sf):
    """Two quotes per text, one with markup around and wider blanks, one with a foreign word: the spans they stand at."""
    d = table(spark, sf, "documents").select("doc_id", "text", tx.words(F.col("text")).alias("w")).where(F.size("w") >= 12)
    true = F.concat(F.lit("«**"), F.array_join(F.slice("w", F.lit(4), F.lit(8)), "  "), F.lit("**»"))
    false = F.concat(F.array_join(F.slice("w", F.lit(4), F.lit(4)), " "), F.lit(" xyzzyx "), F.get("w", F.lit(8)))
    found = d.select("doc_id", "text", F.posexplode(quote_spans(F.col("text"), F.array(true, false))).alias("n", "s"))
    return found.select("doc_id", F.col("n").cast("bigint").alias("n"), F.col("s.ini").cast("bigint").alias("ini"), F.col("s.fin").cast("bigint").alias("fin"),
                        F.md5(F.substring("text", F.col("s.ini") + 1, F.col("s.fin") - F.col("s.ini"))).alias("md5"))


def index_nested_sizes(spark, sf):
    """Stored indexes of any shape, one per brand, read as VARIANT: how many members the lists and maps at each path hold."""
    p = table(spark, sf, "part")
    types = p.groupBy("p_brand", "p_type").agg(F.sort_array(F.collect_list("p_partkey")).alias("k"))
    types = types.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "k"))).alias("entidades"))
    own = p.groupBy("p_brand").agg(F.collect_list("p_name").alias("fragmentos"), F.count(F.lit(1)).alias("n"), F.transform(F.collect_set("p_size"), lambda s: F.array(s, s + 1)).alias("comunidades"))
    j = own.join(types, "p_brand").select("p_brand", F.to_json(F.struct(
        F.struct("n", F.lit(0).alias("salida")).alias("tokens"), "fragmentos", F.struct("entidades").alias("fusion"), "comunidades")).alias("value"))
    at = _folder(spark)
    j.select(F.concat_ws("\t", "p_brand", "value").alias("value")).write.text(at)
    back = spark.read.text(at).select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("marca"), F.parse_json(F.split_part("value", F.lit("\t"), F.lit(2))).alias("v"))
    return container_sizes(back, ["marca"], "v")


def embedding_events(spark, sf):
    """Vectors of all turns and the event rows of the same pass: texts, width, and that every batch tells its time."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    vectors, events = embedding_with_events(c, ["conv_id", "turn"], "text", _folder(spark))
    seen = events.agg(F.sum("textos").cast("bigint").alias("textos"), F.max("dimension").alias("dimension"), (F.min("latencia_s") >= 0).alias("con_tiempo"))
    return vectors.agg(F.count(F.lit(1)).alias("vectores"), F.min(F.size("embedding")).alias("ancho")).join(seen)


def section_branches(spark, sf):
    """Conversations as typeset pages: headings by size, by size and weight, by weight and wording; notes that only look like one.

    ``candidata`` marks what extraction reads: work sections with text, or all sections where there is no work section.
    """
    c = table(spark, sf, "conversations")
    n, k = F.col("turn").cast("string"), F.col("turn") % 3
    line = lambda t, size, bold: F.struct(t.alias("texto"), size.cast("double").alias("tam"), bold.alias("negrita"), (F.col("turn") + 1).cast("int").alias("pagina"))
    work = (k == 1) & (F.col("conv_id") % 4 != 0)
    head = F.when(work, F.concat(F.lit("parte "), n, F.lit(" del trabajo"))).when(k == 0, F.concat(F.lit("Apartado "), n)).otherwise(F.concat(F.lit("Título "), n))
    size = F.when(work, 10.0).when(k == 0, 11.2).otherwise(14.0)
    body = F.concat(F.lit("Cuerpo de la conversación, siempre más largo que cuarenta letras: "), tx.squeeze(F.col("text")))
    lines = F.array(line(head, size, work | (k == 0)), line(body, F.lit(10.0), F.lit(False)), line(F.concat(F.lit("nota "), n), F.lit(11.2), F.lit(False)))
    d = c.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", lines.alias("l")))), lambda x: x["l"])).alias("lines"))
    s = sec.sections_table(d, "conv_id", "lines")
    has = s.groupBy("conv_id").agg(F.max(F.col("trabajo").cast("int")).alias("_w"))
    return s.join(has, "conv_id").select(
        "conv_id", F.col("sec_no").cast("bigint").alias("sec_no"), "titulo", "clave", F.col("trabajo").cast("int").alias("trabajo"), F.col("pagina").cast("bigint").alias("pagina"), F.md5("texto").alias("md5"),
        ((F.col("texto") != "") & (F.col("trabajo") | (F.col("_w") == 0))).cast("int").alias("candidata"))


def _assignment():
    i = F.col("doc_id").cast("string")
    return F.concat(F.lit("El informe tiene las secciones en este orden: Resumen, Datos y Método"), F.when(F.col("doc_id") % 2 == 0, F.lit(", Límites (sin código)")).otherwise(F.lit(" y notas")),
                    F.lit(". Guarde output/tabla_"), i, F.lit(".csv y resultados/fig/g"), i, F.lit(".png, otra vez output/tabla_"), i, F.lit(".csv. "), tx.squeeze(F.col("text")))


def required_lists(spark, sf):
    """Sections and files that an assignment names, whole texts read."""
    d = table(spark, sf, "documents").select("doc_id", _assignment().alias("t"))
    return d.select("doc_id", F.array_join(lm.required_sections(F.col("t")), "|").alias("secciones"), F.array_join(lm.required_files(F.col("t")), "|").alias("archivos"))


def compatibility_forms(spark, sf):
    """Ligatures, wide digits and superscripts put into the texts and normalised away again."""
    wide = F.translate(F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("ff"), F.lit("ﬀ")), "0123456789", "０１２３４５６７８９")
    t = F.concat(wide, F.lit(" x² ½"))
    return table(spark, sf, "documents").select("doc_id", (t != tx.normalise_text(t)).cast("int").alias("cambia"), F.md5(tx.normalise_text(t)).alias("md5"))


QUERIES = {f.__name__: f for f in (literal_quotes, index_nested_sizes, embedding_events, section_branches, required_lists, compatibility_forms)}

_SQUEEZED = r"array_to_string(list_filter(regexp_split_to_array(text, '[\s\x{A0}\x{202F}]+'), lambda w: w <> ''), ' ')"
ORACLES = {
    "literal_quotes": r"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\s\x{A0}\x{202F}]+'), lambda w: w <> '') AS w FROM documents),
        q AS (SELECT doc_id, text, array_to_string(w[4:11], ' ') AS q FROM d WHERE len(w) >= 12),
        c AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) AS i, unnest(string_split(lower(text), '')) AS ch FROM q),
        k AS (SELECT *, regexp_matches(ch, '^[\s\x{A0}\x{202F}]$') AS b FROM c WHERE NOT list_contains(string_split('*`_«»"''“”', ''), ch)),
        n AS (SELECT *, b AND coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY i), true) AS skip FROM k),
        f AS (SELECT doc_id, i, CASE WHEN b THEN ' ' ELSE ch END AS ch, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM n WHERE NOT skip),
        t AS (SELECT doc_id, string_agg(ch, '' ORDER BY p) AS form FROM f GROUP BY doc_id),
        g AS (SELECT q.doc_id, q.text, lower(regexp_replace(q.q, '[*`_«»"''“”]', '', 'g')) AS g0, form FROM q JOIN t USING (doc_id)),
        h AS (SELECT doc_id, text, form, trim(regexp_replace(g0, ' +', ' ', 'g')) AS g FROM g),
        a AS (SELECT doc_id, text, CASE WHEN length(g) >= 12 THEN strpos(form, g) ELSE 0 END AS p, length(g) AS m FROM h),
        s AS (SELECT a.doc_id, 0::BIGINT AS n, x.i - 1 AS ini, y.i AS fin, a.text FROM a LEFT JOIN f x ON x.doc_id = a.doc_id AND x.p = a.p LEFT JOIN f y ON y.doc_id = a.doc_id AND a.p > 0 AND y.p = a.p + a.m - 1)
        SELECT doc_id, n, ini, fin, CASE WHEN ini IS NOT NULL THEN md5(substr(text, ini + 1, fin - ini)) END AS md5 FROM s UNION ALL SELECT doc_id, 1::BIGINT, NULL, NULL, NULL FROM q""",
    "index_nested_sizes": """SELECT p_brand AS marca, '$' AS ruta, 'mapa' AS tipo, 4::BIGINT AS n FROM part GROUP BY p_brand
        UNION ALL SELECT p_brand, '$.tokens', 'mapa', 2 FROM part GROUP BY p_brand UNION ALL SELECT p_brand, '$.fusion', 'mapa', 1 FROM part GROUP BY p_brand
        UNION ALL SELECT p_brand, '$.fragmentos', 'lista', count(*) FROM part GROUP BY p_brand UNION ALL SELECT p_brand, '$.fusion.entidades', 'mapa', count(DISTINCT p_type) FROM part GROUP BY p_brand
        UNION ALL SELECT p_brand, '$.fusion.entidades.' || p_type, 'lista', count(*) FROM part GROUP BY p_brand, p_type
        UNION ALL SELECT p_brand, '$.comunidades', 'lista', count(DISTINCT p_size) FROM part GROUP BY p_brand UNION ALL SELECT p_brand, '$.comunidades[]', 'lista', 2 * count(DISTINCT p_size) FROM part GROUP BY p_brand""",
    "embedding_events": "SELECT count(*) AS vectores, 1024::INT AS ancho, count(*) AS textos, 1024::INT AS dimension, TRUE AS con_tiempo FROM conversations",
    "section_branches": f"""WITH c AS (SELECT conv_id, turn, turn % 3 = 1 AND conv_id % 4 <> 0 AS wk, 'Cuerpo de la conversación, siempre más largo que cuarenta letras: ' || {_SQUEEZED} AS b FROM conversations),
        t AS (SELECT *, CASE WHEN wk THEN 'parte ' || turn || ' del trabajo' WHEN turn % 3 = 0 THEN 'Apartado ' || turn ELSE 'Título ' || turn END AS titulo, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sec_no, max(wk::INT) OVER (PARTITION BY conv_id) AS has FROM c)
        SELECT conv_id, sec_no, titulo, CASE WHEN wk THEN 'Parte ' || turn WHEN sec_no = 0 THEN 'Preámbulo' ELSE titulo END AS clave, wk::INT AS trabajo, turn + 1 AS pagina, md5(b || chr(10) || 'nota ' || turn) AS md5, (wk OR has = 0)::INT AS candidata FROM t""",
    "required_lists": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Resumen|Datos|Método|Límites' ELSE 'Resumen|Datos|Método' END AS secciones, concat_ws('|', 'output/tabla_' || doc_id || '.csv', 'resultados/fig/g' || doc_id || '.png') AS archivos FROM documents",
    "compatibility_forms": r"SELECT doc_id, 1::INT AS cambia, md5(regexp_replace(text || ' x2 1⁄2', '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')) AS md5 FROM documents",
}
