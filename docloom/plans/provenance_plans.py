"""Registered plans for figure extraction, provenance and declarative checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import figures as fg
from docloom.functions.text import without_code
from docloom.operators import check_tables as ct
from docloom.operators import checks as ck
from docloom.operators import provenance as pv
from docloom.session import table


def _measured(spark, sf):
    """Everything a run wrote: prices in thousands and event values."""
    return (
        table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("value"))
        .unionByName(table(spark, sf, "orders").select((F.col("o_totalprice") / 1000).alias("value")))
        .unionByName(table(spark, sf, "events").select("value"))
    )


def _given(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(fg.numbers(F.col("text"))).alias("r")).select("r.value")


def _reports(spark, sf):
    """Documents with two more figures each: a share from the id and a price cited as a percentage."""
    pct = F.format_string("%.2f", (F.col("n_chars") % 9973) / 100.0)
    return table(spark, sf, "documents").select("doc_id", F.concat(
        "text", F.lit(" Medido: "), F.format_string("%.2f", (F.col("doc_id") * 37 % 5000) / 100.0), F.lit(", peso "), pct,
        F.lit(" % y total "), F.format_string("%.3f", (F.col("n_chars") * 7 % 90000) / 10.0)).alias("text"))


def numbers_extracted(spark, sf):
    n = _reports(spark, sf).select("doc_id", F.posexplode(fg.figures(without_code(F.col("text")))).alias("pos", "f"))
    return n.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "f.raw", "f.value", "f.decimals", F.col("f.percent").cast("int").alias("percent"))


def provenance_fraction(spark, sf):
    d = _reports(spark, sf)
    c = pv.check_figures(d, "doc_id", "text", _given(spark, sf), _measured(spark, sf))
    return pv.provenance_summary(d, "doc_id", c).withColumn("fraccion", F.round("fraccion", 6))


def provenance_per_reading(spark, sf):
    d = _reports(spark, sf)
    c = pv.check_figures(d, "doc_id", "text", _given(spark, sf), _measured(spark, sf), per_reading=True)
    return pv.provenance_summary(d, "doc_id", c).select("doc_id", F.round("fraccion", 6).alias("fraccion"), "total")


def unsupported_figures(spark, sf):
    c = pv.check_figures(_reports(spark, sf), "doc_id", "text", _given(spark, sf), _measured(spark, sf))
    return c.where(F.col("ok") == 0).groupBy("raw").agg(F.count("*").alias("veces"), F.countDistinct("doc_id").alias("documentos"))


def figure_suggestions(spark, sf):
    m = _measured(spark, sf)
    c = pv.check_figures(_reports(spark, sf), "doc_id", "text", _given(spark, sf), m).where(F.col("ok") == 0)
    return pv.suggestions(c, m).select("value", "decimals", F.round("medido", 6).alias("medido"), "pista", "exponente")


def marked_reports(spark, sf):
    """Reports with each unsupported figure replaced by the visible mark."""
    d = _reports(spark, sf)
    c = pv.check_figures(d, "doc_id", "text", _given(spark, sf), _measured(spark, sf)).where(F.col("ok") == 0)
    bad = c.groupBy("doc_id").agg(F.collect_set("raw").alias("raws"))
    m = d.join(bad, "doc_id").withColumn("m", fg.mark_unsupported(F.col("text"), F.col("raws")))
    mark = fg.UNSUPPORTED_MARK
    return m.select("doc_id", ((F.length("m") - F.length(F.replace("m", F.lit(mark), F.lit("")))) / len(mark)).cast("bigint").alias("marcas"),
                    F.size("raws").cast("bigint").alias("cifras"))


CHECKS = [
    {"id": "K1", "tipo": "palabras_max", "valor": 300},
    {"id": "K2", "tipo": "contiene", "lista": ["the", "License"]},
    {"id": "K3", "tipo": "secciones", "lista": ["The", "In"], "en_orden": True},
    {"id": "K4", "tipo": "cifra_presente", "verdad": 4.0},
    {"id": "K5", "tipo": "cifra", "etiqueta": "Version", "verdad": 2.0},
    {"id": "K6", "tipo": "paginas_max", "columna": "paginas", "valor": 3},
    {"id": "K7", "tipo": "celdas_mágicas"},
]


def _with_pages(spark, sf):
    return table(spark, sf, "documents").withColumn("paginas", F.ceil(F.col("n_chars") / 1000))


def checks_dispatch(spark, sf):
    return ck.run_checks(_with_pages(spark, sf), "doc_id", "text", CHECKS)


def checks_tally(spark, sf):
    lang = table(spark, sf, "documents").select("doc_id", "lang")
    r = ck.run_checks(_with_pages(spark, sf).withColumn("k", F.struct("doc_id", "lang")), "k", "text", CHECKS)
    return ck.tally(r.select(F.col("k.lang").alias("lang"), "check", "ok"), ["lang", "check"])


def files_present(spark, sf):
    """``archivo`` check over page URLs as the files of each host."""
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url")
    return ck.files_check(p, "host", "url", r"/(en|fr)/\d+", 2)



#: Two tasks with lists and truths of their own; a truth is the name of a query.
TASK_CHECKS = [
    ("A", "A1", "palabras_max", None, None, 250.0, None, None, None, None, None),
    ("A", "A2", "contiene", ["the", "and"], None, None, None, None, None, None, None),
    ("A", "A3", "cifra", None, None, None, "Valor", "calidad_media", None, None, None),
    ("A", "A4", "secciones", ["The", "In"], True, None, None, None, None, None, None),
    ("A", "A5", "archivo", None, None, None, None, None, None, r"\.md$", 2.0),
    ("B", "B1", "contiene", ["de", "en"], None, None, None, None, None, None, None),
    ("B", "B2", "cifra_presente", None, None, None, None, "descuento_maximo", 0.002, None, None),
    ("B", "B3", "palabras_max", None, None, 120.0, None, None, None, None, None),
    ("B", "B4", "paginas_max", None, None, 2.0, None, None, None, None, None),
    ("B", "B5", "celdas_mágicas", None, None, None, None, None, None, None, None),
]


def checks_by_task(spark, sf):
    """Checks, truths and tasks as tables: English texts answer task A, others task B; a report states a value next to the truth."""
    t = ct.truth_table(spark, {
        "calidad_media": lambda: table(spark, sf, "labels").agg(F.avg("quality")),
        "descuento_maximo": lambda: table(spark, sf, "lineitem").agg(F.max("l_discount")),
    })
    mean = t.where("verdad = 'calidad_media'").select(F.col("esperado").alias("m"))
    d = table(spark, sf, "documents").join(F.broadcast(mean)).withColumn("tarea", F.when(F.col("lang") == "en", "A").otherwise("B"))
    said = F.concat("text", F.lit(" Valor "), F.format_string("%.4f", F.col("m") + (F.col("doc_id") % 3) * 0.004), F.lit(" y "), F.format_string("%.2f", (F.col("doc_id") % 4 + 8) / 100.0))
    d = d.select("doc_id", "tarea", F.when(F.col("n_chars") % 17 != 0, said).alias("text"), F.ceil(F.col("n_chars") / 1000).alias("paginas"),
                 F.array(F.lit("a.md"), F.when(F.col("doc_id") % 2 == 0, "b.md").otherwise("b.csv")).alias("archivos"))
    return ct.run_check_table(d, "doc_id", spark.createDataFrame(TASK_CHECKS, ct.CHECK_SCHEMA), t)


NOTEBOOK_CHECKS = [
    {"id": "N1", "tipo": "ipynb_ejecutado", "columna": "celdas"},
    {"id": "N2", "tipo": "celdas_intactas", "columna": "celdas", "contrato": "contrato"},
    {"id": "N3", "tipo": "celdas_completas", "columna": "celdas", "contrato": "contrato"},
    {"id": "N4", "tipo": "archivo", "columna": "archivos", "patron": r"^out/c[0-4]\.md$", "minimo": 2},
    {"id": "N5", "tipo": "procedencia", "columna": "fraccion", "minimo": 1.0},
]


def checks_notebooks(spark, sf):
    """Conversations as notebooks: a turn is a cell, assistants write code; figures must come from the run."""
    n, turn = F.length("text"), F.col("turn").cast("string")
    source = F.when(n % 13 == 0, F.lit("ESCRIBE AQUÍ")).otherwise(F.col("text"))
    cell = F.struct(
        "turn", F.concat(F.lit("c"), turn).alias("id"), F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type"),
        F.when(n % 7 != 0, F.col("turn")).alias("execution_count"), F.array(source).alias("source"),
        F.array(F.struct(F.when(n % 11 == 0, "error").otherwise("stream").alias("output_type"))).alias("outputs"))
    rule = F.struct("turn", F.concat(F.lit("c"), turn).alias("id"), F.when(F.col("turn") % 2 == 0, F.sha2(
        F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 0), F.lit("x")).otherwise(source), 256)).alias("sha256"))
    path = F.struct("turn", F.concat(F.lit("out/c"), turn, F.when(F.col("role") == "assistant", ".md").otherwise(".csv")).alias("p"))
    own = F.concat("text", F.lit(" media "), F.format_string("%.2f", (F.col("conv_id") * 37 % 5000) / 100.0))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(cell)).alias("celdas"), F.array_sort(F.collect_list(rule)).alias("contrato"),
        F.transform(F.array_sort(F.collect_list(path)), lambda x: x["p"]).alias("archivos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", own.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    f = pv.provenance_summary(c, "conv_id", pv.check_figures(c, "conv_id", "text", _given(spark, sf), _measured(spark, sf)))
    return ck.run_checks(c.join(f.select("conv_id", "fraccion"), "conv_id"), "conv_id", "text", NOTEBOOK_CHECKS)


QUERIES = {f.__name__: f for f in (
    numbers_extracted, provenance_fraction, provenance_per_reading, unsupported_figures, figure_suggestions, marked_reports,
    checks_dispatch, checks_tally, checks_by_task, files_present, checks_notebooks)}


def db_figures(text: str) -> str:
    """Figures without lookaround: separators are doubled so both neighbours can consume one."""
    return rf"""list_transform(regexp_extract_all(regexp_replace({text}, '([^\p{{L}}\p{{N}}_.,])', '\1\1', 'g'),
      '(?:^|[^\p{{L}}\p{{N}}_.,])(\d+(?:[.,]\d+)?(?:(?:\s\s)?%%)?)(?:$|[^\p{{L}}\p{{N}}_])', 1), lambda r: replace(regexp_replace(r, '(\s)\s', '\1', 'g'), '%%', '%'))"""


_REP = """rp AS (SELECT doc_id, text || ' Medido: ' || printf('%.2f', (doc_id * 37 % 5000) / 100.0::DOUBLE) || ', peso ' || printf('%.2f', (n_chars % 9973) / 100.0::DOUBLE) || ' % y total ' || printf('%.3f', (n_chars * 7 % 90000) / 10.0::DOUBLE) AS text FROM documents)"""
_FIG = f"""f0 AS (SELECT doc_id, {db_figures("regexp_replace(text, '```.*?```', '', 'gs')")} AS fs FROM rp),
 f1 AS (SELECT doc_id, unnest(fs) AS raw, generate_subscripts(fs, 1) - 1 AS pos FROM f0),
 fg AS (SELECT doc_id, pos::BIGINT AS pos, raw, replace(regexp_extract(raw, '^\\d+([.,]\\d+)?'), ',', '.')::DOUBLE AS value,
   coalesce(length(nullif(regexp_extract(raw, '[.,](\\d+)', 1), '')), 0)::INT AS decimals, (raw LIKE '%\\%' ESCAPE '\\')::INT AS percent FROM f1)"""
_ME = "me AS (SELECT DISTINCT l_extendedprice / 1000 AS a FROM lineitem UNION SELECT o_totalprice / 1000 FROM orders UNION SELECT value FROM events)"
_GIV = f"""g0 AS (SELECT unnest({db_figures('text')}) AS raw FROM benchmark),
 g1 AS (SELECT raw, replace(regexp_extract(raw, '^\\d+([.,]\\d+)?'), ',', '.')::DOUBLE AS v FROM g0), gi AS (SELECT v FROM g1 UNION SELECT v / 100 FROM g1 WHERE raw LIKE '%\\%' ESCAPE '\\')"""
_READ = "rd AS (SELECT doc_id, pos, raw, 1 AS alt, value, decimals FROM fg UNION ALL SELECT doc_id, pos, raw, 0, value / 100, decimals + 2 FROM fg WHERE percent = 1)"
_SUP = """nd AS (SELECT DISTINCT value, decimals FROM rd WHERE decimals >= 2), su AS (SELECT DISTINCT value, decimals FROM nd, me WHERE abs(a - value) <= 0.5 * pow(10.0, -decimals) + 1e-9)"""
_CHK = f"""{_REP}, {_FIG}, {_GIV}, {_READ}, {_ME}, {_SUP},
 c0 AS (SELECT doc_id, pos, raw, max(CASE WHEN rd.value IN (SELECT v FROM gi) THEN 1 ELSE 0 END) AS given, max(CASE WHEN decimals >= 2 THEN 1 ELSE 0 END) AS deep,
   max(CASE WHEN decimals >= 2 AND su.value IS NOT NULL THEN 1 ELSE 0 END) AS ok, arg_max(rd.value, alt) FILTER (WHERE decimals >= 2) AS value, arg_max(decimals, alt) FILTER (WHERE decimals >= 2) AS decimals
   FROM rd LEFT JOIN su USING (value, decimals) GROUP BY doc_id, pos, raw), ch AS (SELECT * FROM c0 WHERE given = 0 AND deep = 1)"""
_HEAD = lambda t, goal: f"""(SELECT min(o) FROM (SELECT length(array_to_string(string_split(text, chr(10))[:i-1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS o, regexp_replace(trim(regexp_replace(lower(strip_accents(regexp_replace(l, '^[# ]+', ''))), '[^a-z0-9]+', ' ', 'g')), '^\\d+ ', '') AS h FROM (SELECT unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i)) WHERE h <> '' AND length(h) <= {len(goal) + 40} AND (h = '{goal}' OR starts_with(h, '{goal} ')))"""
_PLANO = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '```.*?```', '', 'gs'), '[\s\x{A0}\x{2028}\x{202F}\x{3000}]+'), lambda w: w <> ''), ' ')"


def _has(word: str) -> str:
    return rf"regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])')"


def _num_hit(txt: str, truth: float | str, tolerance: float | str = 0.005) -> str:
    v = r"replace(regexp_extract(r, '^\d+([.,]\d+)?'), ',', '.')::DOUBLE"
    return f"(len(list_filter({db_figures(txt)}, lambda r: abs({v} - {truth}) <= {tolerance} + 1e-12 OR (r LIKE '%\\%' ESCAPE '\\' AND abs({v} / 100 - {truth}) <= {tolerance} + 1e-12))) > 0)"


_DISP = f"""d AS (SELECT doc_id, lang, n_chars, text, {_PLANO} AS p, {_HEAD('text', 'the')} AS h1, {_HEAD('text', 'in')} AS h2 FROM documents),
 e AS (SELECT *, array_length(list_filter(string_split(p, ' '), lambda w: w <> '')) AS nw, regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])the($|[^\\p{{L}}\\p{{N}}_])') AS w1, regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])License($|[^\\p{{L}}\\p{{N}}_])') AS w2,
   {_num_hit('p', 4.0)} AS f4,
   len(list_filter(range(2, len(string_split(p, 'Version')) + 1), lambda i: {_num_hit("left(array_to_string(string_split(p, 'Version')[i:], 'Version'), 160)", 2.0)})) > 0 AS f2 FROM d),
 k AS (SELECT doc_id, lang, 'K1' AS "check", 'palabras_max' AS tipo, (coalesce(nw,0) <= 300)::INT AS ok, coalesce(nw,0)::VARCHAR || ' palabras' AS detalle FROM e
  UNION ALL SELECT doc_id, lang, 'K2', 'contiene', (w1 AND w2)::INT, CASE WHEN w1 AND w2 THEN 'todos presentes' WHEN w1 THEN 'faltan License' WHEN w2 THEN 'faltan the' ELSE 'faltan the, License' END FROM e
  UNION ALL SELECT doc_id, lang, 'K3', 'secciones', coalesce(h1 <= h2, false)::INT, CASE WHEN h1 IS NULL AND h2 IS NULL THEN 'faltan: The, In' WHEN h1 IS NULL THEN 'faltan: The' WHEN h2 IS NULL THEN 'faltan: In' WHEN h1 > h2 THEN 'las secciones están fuera de orden' ELSE 'todas, en orden' END FROM e
  UNION ALL SELECT doc_id, lang, 'K4', 'cifra_presente', f4::INT, 'verdad=4.0000 ±0.005; ' || CASE WHEN f4 THEN 'hallada' ELSE 'no hallada' END FROM e
  UNION ALL SELECT doc_id, lang, 'K5', 'cifra', f2::INT, 'verdad=2.0000 ±0.005; ' || CASE WHEN f2 THEN 'hallada' ELSE 'no hallada' END FROM e
  UNION ALL SELECT doc_id, lang, 'K6', 'paginas_max', (ceil(n_chars / 1000.0) <= 3)::INT, ceil(n_chars / 1000.0)::BIGINT::VARCHAR || ' páginas' FROM e
  UNION ALL SELECT doc_id, lang, 'K7', 'celdas_mágicas', 0, 'tipo desconocido: celdas_mágicas' FROM e)"""

ORACLES = {
    "numbers_extracted": f"WITH {_REP}, {_FIG} SELECT * FROM fg",
    "provenance_fraction": f"WITH {_CHK} SELECT d.doc_id, round(coalesce(avg(ok), 1.0), 6)::DOUBLE AS fraccion, count(ok) AS total, coalesce(array_to_string(list_sort(list(DISTINCT raw) FILTER (WHERE ok = 0)), '|'), '') AS sin_origen FROM documents d LEFT JOIN ch USING (doc_id) GROUP BY d.doc_id",
    "provenance_per_reading": f"WITH {_REP}, {_FIG}, {_GIV}, {_READ}, {_ME}, {_SUP}, x AS (SELECT doc_id, (su.value IS NOT NULL)::INT AS ok FROM rd LEFT JOIN su USING (value, decimals) WHERE decimals >= 2 AND rd.value NOT IN (SELECT v FROM gi)) SELECT d.doc_id, round(coalesce(avg(ok), 1.0), 6)::DOUBLE AS fraccion, count(ok) AS total FROM documents d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id",
    "unsupported_figures": f"WITH {_CHK} SELECT raw, count(*) AS veces, count(DISTINCT doc_id) AS documentos FROM ch WHERE ok = 0 GROUP BY raw",
    "figure_suggestions": f"""WITH {_CHK}, u AS (SELECT DISTINCT value, decimals FROM ch WHERE ok = 0),
        nr AS (SELECT value, decimals, arg_min(a, (abs(a - value), a)) AS medido FROM u, me WHERE abs(a - value) <= 1.5 * pow(10.0, -decimals) GROUP BY ALL),
        fr AS (SELECT value, decimals, min(a) AS medido FROM u ANTI JOIN nr USING (value, decimals), me WHERE value > 0 AND a > 0 AND round(log10(a / value)) <> 0 AND abs(a / pow(10.0, round(log10(a / value))) - value) <= 0.5 * pow(10.0, -decimals) + 1e-9 GROUP BY ALL)
        SELECT value, decimals, round(medido, 6) AS medido, 'redondeo' AS pista, 0::INT AS exponente FROM nr UNION ALL SELECT value, decimals, round(medido, 6), 'escala', round(log10(medido / value))::INT FROM fr""",
    "marked_reports": f"WITH {_CHK}, b AS (SELECT DISTINCT doc_id, raw FROM ch WHERE ok = 0) SELECT b.doc_id, count(*) AS marcas, count(DISTINCT b.raw) AS cifras FROM b JOIN fg ON fg.doc_id = b.doc_id AND fg.raw = b.raw GROUP BY b.doc_id",
    "checks_dispatch": f"WITH {_DISP} SELECT doc_id, \"check\", tipo, ok, detalle FROM k",
    "checks_tally": f"WITH {_DISP} SELECT lang, \"check\", sum(ok)::BIGINT AS aprobadas, count(*) AS total FROM k GROUP BY lang, \"check\"",
    "checks_by_task": f"""WITH m AS (SELECT avg(quality) AS q FROM labels), x AS (SELECT max(l_discount) AS q FROM lineitem), dd AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'A' ELSE 'B' END AS tarea, n_chars, n_chars % 17 = 0 AS gone,
          text || ' Valor ' || printf('%.4f', m.q + (doc_id % 3) * 0.004::DOUBLE) || ' y ' || printf('%.2f', (doc_id % 4 + 8) / 100.0::DOUBLE) AS text FROM documents, m),
        d AS (SELECT *, {_PLANO} AS p, {_HEAD('text', 'the')} AS h1, {_HEAD('text', 'in')} AS h2 FROM dd),
        e AS (SELECT *, array_length(list_filter(string_split(p, ' '), lambda w: w <> '')) AS nw, {_has('the')} AS w1, {_has('and')} AS w2, {_has('de')} AS w3, {_has('en')} AS w4,
          len(list_filter(range(2, len(string_split(p, 'Valor')) + 1), lambda i: {_num_hit("left(array_to_string(string_split(p, 'Valor')[i:], 'Valor'), 160)", "m.q")})) > 0 AS fa, {_num_hit('p', 'x.q', '0.002')} AS fb, m.q AS mq, x.q AS xq FROM d, m, x),
        k AS (SELECT doc_id, tarea, 'A1' AS "check", 'palabras_max' AS tipo, (nw <= 250)::INT AS ok, nw::VARCHAR || ' palabras' AS detalle, gone FROM e WHERE tarea = 'A'
        UNION ALL SELECT doc_id, tarea, 'A2', 'contiene', (w1 AND w2)::INT, CASE WHEN w1 AND w2 THEN 'todos presentes' ELSE 'faltan ' || concat_ws(', ', CASE WHEN NOT w1 THEN 'the' END, CASE WHEN NOT w2 THEN 'and' END) END, gone FROM e WHERE tarea = 'A'
        UNION ALL SELECT doc_id, tarea, 'A3', 'cifra', fa::INT, 'verdad=' || printf('%.4f', mq) || ' ±0.005; ' || CASE WHEN fa THEN 'hallada' ELSE 'no hallada' END, gone FROM e WHERE tarea = 'A'
        UNION ALL SELECT doc_id, tarea, 'A4', 'secciones', coalesce(h1 <= h2, false)::INT, CASE WHEN h1 IS NULL AND h2 IS NULL THEN 'faltan: The, In' WHEN h1 IS NULL THEN 'faltan: The' WHEN h2 IS NULL THEN 'faltan: In' WHEN h1 > h2 THEN 'las secciones están fuera de orden' ELSE 'todas, en orden' END, gone FROM e WHERE tarea = 'A'
        UNION ALL SELECT doc_id, tarea, 'A5', 'archivo', (doc_id % 2 = 0)::INT, CASE WHEN doc_id % 2 = 0 THEN '2' ELSE '1' END || ' archivo(s) con \\.md$', false FROM e WHERE tarea = 'A'
        UNION ALL SELECT doc_id, tarea, 'B1', 'contiene', (w3 AND w4)::INT, CASE WHEN w3 AND w4 THEN 'todos presentes' ELSE 'faltan ' || concat_ws(', ', CASE WHEN NOT w3 THEN 'de' END, CASE WHEN NOT w4 THEN 'en' END) END, gone FROM e WHERE tarea = 'B'
        UNION ALL SELECT doc_id, tarea, 'B2', 'cifra_presente', fb::INT, 'verdad=' || printf('%.4f', xq) || ' ±0.002; ' || CASE WHEN fb THEN 'hallada' ELSE 'no hallada' END, gone FROM e WHERE tarea = 'B'
        UNION ALL SELECT doc_id, tarea, 'B3', 'palabras_max', (nw <= 120)::INT, nw::VARCHAR || ' palabras', gone FROM e WHERE tarea = 'B'
        UNION ALL SELECT doc_id, tarea, 'B4', 'paginas_max', (ceil(n_chars / 1000.0) <= 2)::INT, ceil(n_chars / 1000.0)::BIGINT::VARCHAR || ' páginas', gone FROM e WHERE tarea = 'B'
        UNION ALL SELECT doc_id, tarea, 'B5', 'celdas_mágicas', 0, 'tipo desconocido: celdas_mágicas', false FROM e WHERE tarea = 'B')
        SELECT doc_id, tarea, "check", tipo, CASE WHEN gone THEN 0 ELSE ok END AS ok, CASE WHEN gone THEN 'no hay entregable' ELSE detalle END AS detalle FROM k""",
    "checks_notebooks": f"""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN length(text) % 13 = 0 THEN 'ESCRIBE AQUÍ' ELSE text END AS src FROM conversations),
        {_CHK.replace(_REP, "rp AS (SELECT conv_id AS doc_id, string_agg(text || ' media ' || printf('%.2f', (conv_id * 37 % 5000) / 100.0::DOUBLE), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)")},
        g AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS code, count(*) FILTER (WHERE role = 'assistant' AND n % 7 = 0) AS idle, count(*) FILTER (WHERE role = 'assistant' AND n % 11 = 0) AS err,
          count(*) FILTER (WHERE turn = 0 AND conv_id % 4 = 0 AND src <> 'x') AS changed, count(*) FILTER (WHERE turn % 2 <> 0 AND (src LIKE '%ESCRIBE AQU%' OR length(trim(src)) < 10)) AS todo,
          count(*) FILTER (WHERE role = 'assistant' AND turn <= 4) AS files FROM t GROUP BY conv_id),
        p AS (SELECT doc_id AS conv_id, avg(ok) AS f FROM ch GROUP BY 1)
        SELECT conv_id, 'N1' AS "check", 'ipynb_ejecutado' AS tipo, (code > 0 AND idle = 0 AND err = 0)::INT AS ok, code::VARCHAR || ' celdas de código, ' || idle::VARCHAR || ' sin ejecutar, ' || err::VARCHAR || ' con error' AS detalle FROM g
        UNION ALL SELECT conv_id, 'N2', 'celdas_intactas', (changed = 0)::INT, changed::VARCHAR || ' celdas protegidas cambiadas' FROM g
        UNION ALL SELECT conv_id, 'N3', 'celdas_completas', (todo = 0)::INT, todo::VARCHAR || ' celdas por escribir' FROM g
        UNION ALL SELECT conv_id, 'N4', 'archivo', (files >= 2)::INT, files::VARCHAR || ' archivo(s)' FROM g
        UNION ALL SELECT conv_id, 'N5', 'procedencia', (coalesce(f, 1.0) >= 1.0)::INT, 'procedencia ' || printf('%.2f', coalesce(f, 1.0)::DOUBLE) FROM g LEFT JOIN p USING (conv_id)""",
    "files_present": r"WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_matches(url, '/(en|fr)/\d+') AS m FROM pages) SELECT host, (count(*) FILTER (WHERE m) >= 2)::INT AS ok, (count(*) FILTER (WHERE m))::VARCHAR || ' archivo(s)' AS detalle FROM p GROUP BY host",
}
