"""Registered plans over text: counts, masking, fingerprints, names, headings, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import figures as fig
from docloom.functions import limits, names
from docloom.functions import text as tx
from docloom.operators import sections as sec
from docloom.plans.scale import lookup
from docloom.session import table

WANTED = ["the", "of", "and"]
TARGETS = ["The", "De la", "Der", "Le"]
DB_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DB_WORD = r"[\p{L}\p{N}_]"
DB_PLAIN = r"regexp_replace(text, '```.*?```', '', 'gs')"
DB_WORDS = f"list_filter(regexp_split_to_array({DB_PLAIN}, '{DB_SPACE}+'), lambda w: w <> '')"
DB_SQUEEZE = f"array_to_string(list_filter(regexp_split_to_array(text, '{DB_SPACE}+'), lambda w: w <> ''), ' ')"


def word_limit_check(spark, sf):
    n = tx.word_count(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", n.alias("n_words"), (n <= 400).cast("int").alias("ok"))


def contains_all(spark, sf):
    missing = tx.missing_words(F.col("text"), WANTED)
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).cast("int").alias("ok")
    )


def mask_secrets(spark, sf):
    masked = tx.mask_secrets(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(masked).alias("masked_md5"), (masked != F.col("text")).cast("int").alias("changed")
    )


def token_profile(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.explode(tx.token_counts(tx.tokens(F.col("text")))).alias("t"))
    per_term = d.groupBy("lang", F.col("t.term").alias("term")).agg(F.sum("t.tf").alias("tf"), F.count("*").alias("df"))
    return per_term.groupBy("lang").agg(
        F.sum("tf").cast("bigint").alias("tokens"), F.count("*").alias("terms"), F.max("df").alias("max_df")
    )


def _named_parts(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("Las "), F.initcap("p_name"), F.lit("s ("), F.col("p_brand"), F.lit(")")).alias("nombre"),
        "p_type",
    )


def name_keys(spark, sf):
    return _named_parts(spark, sf).select("p_partkey", "nombre", names.name_key(F.col("nombre")).alias("clave"))


def name_forms(spark, sf):
    return _named_parts(spark, sf).select(
        "p_partkey", F.array_join(names.name_forms(F.col("nombre"), F.array("p_type")), "|").alias("formas")
    )


def heading_positions(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", *[tx.heading_offset(F.col("text"), t).cast("bigint").alias(f"at_{i}") for i, t in enumerate(TARGETS)]
    )


def repeat_detector(spark, sf):
    """Each document against the first one with the same fingerprint; copies may be many."""
    d = table(spark, sf, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("huella"))
    first = d.groupBy("huella").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return lookup(d, first, ["huella"], ["doc_id"]).select(
        "doc_id", "huella", "first_doc", "copies", (F.col("doc_id") > F.col("first_doc")).cast("int").alias("is_repeat")
    )


def clip_marker(spark, sf):
    c = tx.clip(F.col("text"), 6000)
    return table(spark, sf, "documents").select("doc_id", F.length(c).cast("bigint").alias("n"), F.md5(c).alias("md5"))


def json_recovery(spark, sf):
    """Event properties wrapped the way a model wraps them, then recovered."""
    reply = F.concat(F.lit("<think>plan "), F.col("event_type"), F.lit("</think>\nAquí está:\n```json\n"), F.col("props"), F.lit("\n```"))
    j = tx.recover_json(tx.without_reasoning(reply))
    return table(spark, sf, "events").select("event_id", F.get_json_object(j, "$.k").cast("bigint").alias("k"))


def missing_links(spark, sf):
    """Link targets of each page that are not the path of any page."""
    pages = table(spark, sf, "pages")
    link = F.explode(tx.link_targets(F.col("html"), r'<a href="([^"?#]+)"'))
    links = pages.select("page_id", link.alias("path")).groupBy("page_id", "path").agg(F.count("*").alias("n"))
    paths = pages.select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path")).distinct().withColumn(
        "known", F.lit(1))
    return (
        lookup(links, paths, ["path"], ["page_id"], "left")
        .groupBy("page_id")
        .agg(F.sum("n").cast("bigint").alias("links"),
             F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).cast("bigint").alias("missing"))
    )


def replace_exactly_once(spark, sf):
    out = tx.replace_once(F.col("text"), "License", "[L]")
    return table(spark, sf, "documents").where(out.isNotNull()).select("doc_id", F.md5(out).alias("md5"))


def rough_figures(spark, sf):
    f = fig.rough_figures(tx.without_code(F.concat(F.col("text"), F.lit(" 0,25 y "), F.lpad((F.col("doc_id") % 90 + 10).cast("string"), 2, "0"), F.lit(".5 %"))))
    return table(spark, sf, "documents").select("doc_id", F.array_join(f, "|").alias("cifras"))


def normalise_text(spark, sf):
    """Ligature and hyphen repair on text that the plan first breaks with a hyphen."""
    broken = F.regexp_replace("text", r"(\p{L}{3})(\p{L}{3})", "$1-\n$2")
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.normalise_text(broken)).alias("md5"))


def page_lines():
    """Page HTML as Markdown-like lines: headings become ``#`` lines, tags go."""
    html = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    for level in range(1, 5):
        html = F.regexp_replace(html, rf"<h{level}[^>]*>", "\n" + "#" * level + " ")
    html = F.regexp_replace(html, r"</?(?:h[1-4]|p|li|br|div|article|nav|footer|ul|tr|td|table|body|head|title)[^>]*>", "\n")
    html = F.regexp_replace(html, r"<[^>]*>", "")
    return F.filter(F.transform(F.split(html, "\n"), lambda l: F.trim(l)), lambda l: l != "")


DB_PAGE_LINES = r"""
  SELECT page_id, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(
     regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'gs'),
      '<h1[^>]*>', chr(10) || '# ', 'g'), '<h2[^>]*>', chr(10) || '## ', 'g'),
      '<h3[^>]*>', chr(10) || '### ', 'g'), '<h4[^>]*>', chr(10) || '#### ', 'g'),
     '</?(?:h[1-4]|p|li|br|div|article|nav|footer|ul|tr|td|table|body|head|title)[^>]*>', chr(10), 'g'),
     '<[^>]*>', '', 'g'), chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '') AS lines
  FROM pages"""


def page_sections(spark, sf):
    d = table(spark, sf, "pages").select("page_id", sec.plain_lines(page_lines()).alias("lines"))
    return sec.sections_table(d, "page_id", "lines").select(
        "page_id", F.col("sec_no").cast("bigint").alias("sec_no"), "titulo", "clave",
        F.length("texto").cast("bigint").alias("n_chars"), F.md5("texto").alias("md5"),
    )


def fence_parity(spark, sf):
    """Lines inside toggled blocks; lines that start with ``The``/``De``/``Le`` act as markers."""
    lines = F.split("text", "\n")
    inside = sec.open_fences(lines, r"^(The|De|Le|Der) ")
    d = table(spark, sf, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), inside.alias("i"))
    return d.select("doc_id", "n_lines", F.size(F.filter("i", lambda x: x)).cast("bigint").alias("inside"))


def chunk_pack(spark, sf):
    """Greedy packing of a document's lines into chunks of at most 2500 characters."""
    lines = F.split("text", "\n")
    d = table(spark, sf, "documents").select("doc_id", lines.alias("l"))
    d = d.withColumn("g", sec.pack(
        F.transform("l", lambda x: F.struct(F.length(x).alias("body"), F.lit(0).alias("title"))),
        F.transform("l", lambda x: F.lit(False)), F.lit(sec.CHUNK_CHARS)))
    rows = d.select("doc_id", F.explode(F.arrays_zip("g", "l")).alias("z"))
    return rows.groupBy("doc_id", (F.col("z.g") + 1).cast("bigint").alias("chunk")).agg(
        F.count("*").alias("blocks"), F.sum(F.length("z.l")).cast("bigint").alias("chars"))


def notes_split(spark, sf):
    """Notes split before each heading; the first line of a piece is its key."""
    note = F.concat(F.lit("intro\n## uno "), F.col("turn").cast("string"), F.lit("\n"), "text", F.lit("\n## dos\n"), "text")
    p = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(tx.split_before(note, "## ")).alias("pos", "piece"))
    return p.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), F.substring_index("piece", "\n", 1).alias("clave"), F.length("piece").cast("bigint").alias("n"))


def fenced_code(spark, sf):
    """The longest fenced block of a reply; the reply itself when there is none."""
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x\n```\na\n```\ny\n```python\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(tx.longest_fenced(reply, "python")).alias("md5"))


def masked_values(spark, sf):
    """Every string inside a nested value is masked."""
    secret = F.concat(F.lit('token = "abcd'), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit('"'))
    v = F.struct("event_id", F.array(F.struct(secret.alias("a"), F.lit("libre").alias("b"))).alias("xs"))
    m = table(spark, sf, "events").select("event_id", tx.mask_value(v).alias("m"))
    return m.select("event_id", F.col("m").contains("abcd0").cast("int").alias("visible"), F.get_json_object("m", "$.xs[0].b").alias("b"))


def document_limits(spark, sf):
    """Word limits of assignments made from turns: for the whole text, for an answer, for a numbered task."""
    n = (100 + F.col("turn")).cast("string")
    head = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit("El informe no supera las "), n, F.lit(" palabras. ")))
            .when(F.col("turn") % 3 == 1, F.lit("Cada respuesta tiene un máximo de diez palabras. Escriba con cuidado. El total es de 1.500 palabras como máximo. "))
            .otherwise(F.lit("Redacte esto. 3. Un resumen de hasta 150 palabras. ")))
    c = table(spark, sf, "conversations").select("conv_id", "turn", limits.limits("palabras")(F.concat(head, "text")).alias("l"))
    return c.select("conv_id", "turn", "l.whole", F.array_join("l.partial", "|").alias("partial"))


def body_size(spark, sf):
    """Median over long lines, line length standing in for the font size."""
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(
        t.alias("texto"), F.length(t).cast("double").alias("tam"), F.lit(False).alias("negrita"), F.lit(1).alias("pagina")))
    return table(spark, sf, "documents").select("doc_id", sec.body_size(lines).alias("cuerpo"))


QUERIES = {f.__name__: f for f in (
    word_limit_check, contains_all, mask_secrets, token_profile, name_keys, name_forms, heading_positions,
    repeat_detector, clip_marker, json_recovery, missing_links, replace_exactly_once, rough_figures, normalise_text,
    page_sections, fence_parity, chunk_pack, body_size, document_limits, notes_split, fenced_code, masked_values)}

_KEY = r"""trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"""
_ARTICLES = "'el','la','los','las','un','una','unos','unas','the','a','an'"


def db_name_key(x: str) -> str:
    flat = _KEY.format(x=x)
    bare = rf"regexp_replace({flat}, '^(?:(?:el|la|los|las|un|una|unos|unas|the|a|an)(?: |$))+', '')"
    one = (
        "CASE WHEN length(w) > 4 AND w LIKE '%es' AND substr(w, length(w)-2, 1) IN ('l','n','r','d','j') THEN left(w, length(w)-2) "
        "WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w)-1) ELSE w END"
    )
    return f"array_to_string(list_transform(list_filter(string_split({bare}, ' '), lambda w: w <> ''), lambda w: {one}), ' ')"


_NOMBRE = """(SELECT p_partkey, p_type, 'Las ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w,1)) || substr(w,2)), ' ') || 's (' || p_brand || ')' AS nombre FROM part)"""


def _heading_sql() -> str:
    cols, key = [], _KEY
    for i, t in enumerate(TARGETS):
        goal = t.lower()
        cols.append(f"min(CASE WHEN h <> '' AND length(h) <= {len(goal) + 40} AND (h = '{goal}' OR starts_with(h, '{goal} ')) THEN off END) AS a{i}")
    out = ", ".join(f"coalesce(a{i}, -1)::BIGINT AS at_{i}" for i in range(len(TARGETS)))
    h = "regexp_replace(" + key.format(x="lower(regexp_replace(l, '^[# ]+', ''))") + r", '^\d+ ', '')"
    return f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
      l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM s),
      o AS (SELECT doc_id, l, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
      k AS (SELECT doc_id, off, {h} AS h FROM o),
      g AS (SELECT doc_id, {", ".join(cols)} FROM k GROUP BY doc_id)
      SELECT doc_id, {out} FROM g"""


ORACLES = {
    "word_limit_check": f"SELECT doc_id, len({DB_WORDS})::INT AS n_words, (len({DB_WORDS}) <= 400)::INT AS ok FROM documents",
    "contains_all": "WITH m AS (SELECT doc_id, list_filter([" + ",".join(
        f"CASE WHEN NOT regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])') THEN '{w}' END" for w in WANTED)
        + "], lambda x: x IS NOT NULL) AS miss FROM documents) SELECT doc_id, array_to_string(miss, ',') AS missing, (len(miss) = 0)::INT AS ok FROM m",
    "mask_secrets": r"""WITH m AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        'sk-ant-[A-Za-z0-9_\-]{10,}', '***', 'g'), 'sk-(?:proj-)?[A-Za-z0-9_\-]{20,}', '***', 'g'),
        '(?i)bearer\s+[A-Za-z0-9._\-]{16,}', '***', 'g'),
        '(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)[''"]?[^\s''",]{8,}', '\1\2***', 'g') AS t FROM documents)
        SELECT doc_id, md5(t) AS masked_md5, (t <> text)::INT AS changed FROM m""",
    "token_profile": r"""WITH t AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
        p AS (SELECT lang, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY ALL)
        SELECT lang, sum(tf)::BIGINT AS tokens, count(*) AS terms, max(df) AS max_df FROM p GROUP BY lang""",
    "name_keys": f"SELECT p_partkey, nombre, {db_name_key('nombre')} AS clave FROM {_NOMBRE}",
    "name_forms": rf"""WITH r AS (SELECT p_partkey, unnest([nombre, regexp_replace(nombre, '\([^)]*\)', '', 'g'),
        regexp_extract(nombre, '\(([^)]{{2,15}})\)', 1), p_type]) AS c, generate_subscripts([1,2,3,4], 1) AS i FROM {_NOMBRE}),
        k AS (SELECT p_partkey, {db_name_key('c')} AS k, min(i) AS i FROM r GROUP BY ALL)
        SELECT p_partkey, string_agg(k, '|' ORDER BY i) AS formas FROM (SELECT p_partkey, k, min(i) AS i FROM k WHERE length(k) >= 2 GROUP BY ALL) GROUP BY p_partkey""",
    "heading_positions": _heading_sql(),
    "repeat_detector": f"""WITH d AS (SELECT doc_id, left(sha256({DB_SQUEEZE}), 16) AS huella FROM documents),
        f AS (SELECT huella, min(doc_id) AS first_doc, count(*) AS copies FROM d GROUP BY huella)
        SELECT doc_id, huella, first_doc, copies, (doc_id > first_doc)::INT AS is_repeat FROM d JOIN f USING (huella)""",
    "clip_marker": """WITH c AS (SELECT doc_id, CASE WHEN length(text) > 6000 THEN left(text, 6000) || '… [' || (length(text) - 6000)::VARCHAR || ' car. omitidos]' ELSE text END AS t FROM documents)
        SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS md5 FROM c""",
    "json_recovery": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "missing_links": r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"?#]+)"', 1)) AS path FROM pages),
        p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
        SELECT page_id, count(*) AS links, count(*) FILTER (WHERE p.path IS NULL) AS missing FROM l LEFT JOIN p USING (path) GROUP BY page_id""",
    "replace_exactly_once": """SELECT doc_id, md5(replace(text, 'License', '[L]')) AS md5 FROM documents
        WHERE length(text) - length(replace(text, 'License', '')) = 7""",
    "rough_figures": r"""WITH t AS (SELECT doc_id, regexp_replace(text || ' 0,25 y ' || (doc_id % 90 + 10)::VARCHAR || '.5 %', '```.*?```', '', 'gs') AS t FROM documents)
        SELECT doc_id, array_to_string(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_.])(0[.,]\d{2,4}|\d{2}[.,]\d{1,2}\s?%)', 1), '|') AS cifras FROM t""",
    "notes_split": """WITH p AS (SELECT conv_id, turn, unnest([0, 1, 2])::BIGINT AS pos, text FROM conversations)
        SELECT conv_id, turn, pos, CASE pos WHEN 0 THEN 'intro' WHEN 1 THEN '## uno ' || turn::VARCHAR ELSE '## dos' END AS clave,
          (CASE pos WHEN 0 THEN 5 WHEN 1 THEN 8 + length(turn::VARCHAR) + length(text) ELSE 7 + length(text) END)::BIGINT AS n FROM p""",
    "fenced_code": "SELECT conv_id, turn, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS md5 FROM conversations",
    "masked_values": "SELECT event_id, 0 AS visible, 'libre' AS b FROM events",
    "document_limits": """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN (100 + turn)::INT WHEN 1 THEN 1500 END AS whole,
        CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'Cada respuesta tiene un máximo de diez palabras.' ELSE 'Un resumen de hasta 150 palabras.' END AS partial FROM conversations""",
    "normalise_text": r"""WITH b AS (SELECT doc_id, regexp_replace(text, '(\p{L}{3})(\p{L}{3})', '\1-' || chr(10) || '\2', 'g') AS t FROM documents)
        SELECT doc_id, md5(regexp_replace(t, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')) AS md5 FROM b""",
    "page_sections": rf"""WITH p AS ({DB_PAGE_LINES}),
        l AS (SELECT page_id, unnest(lines) AS t, generate_subscripts(lines, 1) AS i FROM p),
        h AS (SELECT *, length(t) <= 100 AND (regexp_matches(t, '^#{{1,4}}\s+\S') OR (length(t) < 80 AND regexp_matches(t, '(?i)^(?:#+\s*)?(Parte|Tarea|Pregunta|Ejercicio|Problema)\s+(\d+)($|[^\p{{L}}\p{{N}}_])'))) AS hd FROM l),
        s AS (SELECT *, hd AND NOT coalesce(lag(hd) OVER w, false) AS st FROM h WINDOW w AS (PARTITION BY page_id ORDER BY i)),
        n AS (SELECT *, sum(st::INT) OVER (PARTITION BY page_id ORDER BY i) AS g, min(CASE WHEN st THEN i END) OVER (PARTITION BY page_id) AS f FROM s),
        a AS (SELECT page_id, g, min(i) AS i0, min(f) AS f,
              string_agg(CASE WHEN st THEN trim(regexp_replace(t, '^#+', '')) ELSE t END, ' ' ORDER BY i) FILTER (WHERE hd) AS ti,
              coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE NOT hd), '') AS tx FROM n GROUP BY page_id, g),
        r AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY g) - 1 AS sec_no, CASE WHEN g = 0 THEN 'Preámbulo' ELSE ti END AS titulo, tx FROM a)
        SELECT page_id, sec_no, titulo, CASE WHEN sec_no = 0 THEN 'Preámbulo' ELSE titulo END AS clave, length(tx)::BIGINT AS n_chars, md5(tx) AS md5 FROM r""",
    "fence_parity": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        p AS (SELECT doc_id, sum(regexp_matches(t, '^(The|De|Le|Der) ')::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS o FROM l)
        SELECT doc_id, count(*) AS n_lines, sum(o)::BIGINT AS inside FROM p GROUP BY doc_id""",
    "chunk_pack": f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS n, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        r AS (SELECT doc_id, 1::BIGINT AS i, n::BIGINT AS used, 1::BIGINT AS chunk, n::BIGINT AS n FROM l WHERE i = 1
              UNION ALL SELECT l.doc_id, l.i::BIGINT, (CASE WHEN r.used + l.n > {sec.CHUNK_CHARS} THEN l.n ELSE r.used + l.n END)::BIGINT,
              r.chunk + CASE WHEN r.used + l.n > {sec.CHUNK_CHARS} THEN 1 ELSE 0 END, l.n::BIGINT FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
        SELECT doc_id, chunk, count(*) AS blocks, sum(n)::BIGINT AS chars FROM r GROUP BY ALL""",
    "body_size": """WITH l AS (SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS n FROM documents)
        SELECT d.doc_id, coalesce(median(n) FILTER (WHERE n > 40), 0)::DOUBLE AS cuerpo FROM documents d JOIN l USING (doc_id) GROUP BY d.doc_id""",
}
