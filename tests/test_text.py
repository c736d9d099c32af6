from pyspark.sql import functions as F

from docloom.functions import figures, limits, names, nested, stats, text
from docloom.operators import agreement, checks, sections

STATEMENT = [
    "# Práctica 7 — riego", "**Formato:** un texto (`reporte.md`) con tablas.", "## Parte 1 — Caudales",
    "Suma los litros de cada pozo y ordena los pozos.", "## Parte 2 — Bombas",
    "Con los mismos datos de la Parte 1, estima el gasto por hora y traza una curva.", "## Parte 3 — Lectura",
    "Comenta qué pozo conviene.", "## La memoria",
    "En la memoria van estas secciones, en este orden: Resultados y Discusión. La memoria tiene un máximo de 300 palabras.",
]
NOTE = """# Cuaderno — huerta
## 1. Riego por goteo
### 1.1 Caudal
El caudal se anota cada noche.
```bash
# no abre una sección
## y esto tampoco
```
### 1.2 Bombas solares
Las bombas solares paran con nubes.
## 2. Poda
Se poda en invierno."""


def test_plural_accent_and_article_share_a_key(one):
    assert one("Las Regresiones Logísticas", names.name_key)[0] == one("regresión logística", names.name_key)[0]
    assert one("redes", names.name_key)[0] == one("red", names.name_key)[0]
    assert "lr" in one("Regresión logística (LR)", names.name_forms)[0]


def test_secrets_are_masked(one):
    r = one('k sk-ant-abcdefghijkl x Bearer abcdefghijklmnopqrst token = "abcdef1234" hunter2hunter', lambda c: text.mask_secrets(c, ["hunter2hunter"]))[0]
    for leak in ("sk-ant-abc", "abcdefghijklmnopqrst", "abcdef1234", "hunter2"):
        assert leak not in r
    assert text.env_secrets({"A_TOKEN": "12345678", "HOME": "/long/enough"}) == ["12345678"]


def test_ligatures_and_hyphens(one):
    assert one("clasiﬁcador estratiﬁ-\ncando", text.normalise_text)[0] == "clasificador estratificando"


def test_figures_with_backtracking_and_percent(one):
    got = one("0.9474, 39.53 % 12.5abc, 5.3.2 y 5,25% x3", figures.figures)[0]
    assert [(f["raw"], f["decimals"]) for f in got] == [("0.9474", 4), ("39.53 %", 2), ("12", 0), ("5.3", 1), ("5,25%", 2)]
    assert one("5.0069e-05 y 3", figures.artifact_values)[0] == [5.0069e-05, 3.0]


def test_marking_longest_first(one):
    r = one("0.9415 y 0.94", lambda c: figures.mark_unsupported(c, F.array(F.lit("0.94"), F.lit("0.9415"))))[0]
    assert r == "[cifra sin respaldo] y [cifra sin respaldo]"


def test_json_recovery(one):
    assert one('bla ```json {"a": {"b": 1}} ``` x', text.recover_json)[0] == '{"a": {"b": 1}}'
    assert one("[1, 2]", text.recover_json)[0] is None


def test_heading_offset_ignores_accents_numbers_and_marks(one):
    t = "hola\n## 1. Introducción\nx"
    assert one(t, lambda c: text.heading_offset(c, "Introduccion"))[0] == 5
    assert one(t, lambda c: text.heading_offset(c, "Método"))[0] == -1


def test_sections_of_a_markdown_statement(spark):
    d = spark.createDataFrame([(1, STATEMENT)], "id int, l array<string>").repartition(1)
    s = sections.sections_table(d.select("id", sections.plain_lines(F.col("l")).alias("l")), "id", "l").orderBy("sec_no").collect()
    assert [r["clave"] for r in s] == ["Preámbulo", "Parte 1", "Parte 2", "Parte 3", "La memoria"]
    assert [r["trabajo"] for r in s] == [False, True, True, True, False]


def test_font_headings_and_split_titles(spark):
    rows = [("Título del", 16.0, True, 1), ("documento", 16.0, True, 1), ("x" * 50, 10.0, False, 1), ("Parte 1 — Datos", 10.0, True, 2), ("y" * 50, 10.0, False, 2)]
    d = spark.createDataFrame([(1, rows)], f"id int, l array<{sections.LINE}>").repartition(1)
    s = sections.sections_table(d, "id", "l").orderBy("sec_no").collect()
    assert [(r["titulo"], r["clave"], r["pagina"]) for r in s] == [("Título del documento", "Preámbulo", 1), ("Parte 1 — Datos", "Parte 1", 2)]


def test_note_chunks_ignore_fenced_headings(spark):
    d = spark.createDataFrame([("huerta-2", NOTE.split("\n"))], "f string, l array<string>").repartition(1)
    c = sections.note_chunks(d, "f", "l").orderBy("id").collect()
    assert [r["titulos"] for r in c] == [["1. Riego por goteo", "1.1 Caudal", "1.2 Bombas solares"], ["2. Poda"]]
    assert "# no abre una sección" in c[0]["texto"]
    assert c[0]["cita"] == "huerta-2 § 1. Riego por goteo … 1.2 Bombas solares"


def test_constraints(spark, one):
    plain = " ".join(STATEMENT).replace("*", "")
    r = one(plain, limits.required_sections, lambda c: limits.deliverable(F.lit(""), c), lambda c: limits.limits("palabras")(c))
    assert r[0] == ["Resultados", "Discusión"] and r[1] == "reporte.md" and r[2]["whole"] == 300
    r = one("18. Redacte un resumen que no supera las 150 palabras.", lambda c: limits.limits("palabras")(c))[0]
    assert r["whole"] is None and r["partial"] == ["Redacte un resumen que no supera las 150 palabras."]
    assert one("escribe output/a.parquet y data/b.csv", limits.required_files)[0] == ["output/a.parquet"]


def test_numeric_leaves():
    assert nested.walk_numbers({"a": {"b": [1, True, 2.5]}, "c": "x"}) == [("a.b[0]", 1.0), ("a.b[2]", 2.5)]


def test_student_t():
    assert abs(stats.t_two_sided(1.33639, 15) - 0.20134) < 1e-5
    assert abs(stats.t_quantile(0.975, 15) - 2.13145) < 1e-5


def test_kappa_cases(spark):
    for pairs, want in (([(1, 1), (0, 0)], 1.0), ([(1, 0), (0, 1)], -1.0), ([(1, 1), (1, 0), (0, 0), (0, 0)], 0.5), ([(1, 1)], None)):
        df = spark.createDataFrame(pairs, "g int, j int")
        assert agreement.agreement(df, "g", "j").first()["kappa"] == want


def test_verdict_formats(one):
    for raw, want in (('{"ok": true, "razon": "r"}', (1, "r", "completo")), ("false", (0, "", "sin_razon")), ('"True"', (1, "", "sin_razon")), ('{"ok": 1}', (None, "", "faltante")), ("??", (None, "", "faltante"))):
        assert tuple(one(raw, agreement.verdict)[0]) == want


def test_notebook_checks(spark):
    schema = "c array<struct<id:string,cell_type:string,execution_count:bigint,source:array<string>,outputs:array<struct<output_type:string>>>>, k array<struct<id:string,sha256:string>>"
    cells = [("a", "code", 1, ["x = 1"], [("stream",)]), ("b", "code", None, ["y"], [("error",)])]
    d = spark.createDataFrame([(cells, [("a", "0" * 64), ("b", None)])], schema).repartition(1)
    r = d.select(checks.notebook_executed(F.col("c")).alias("e"), checks.protected_cells(F.col("c"), F.col("k")).alias("p")).first()
    assert r["e"]["ok"] == 0 and "1 sin ejecutar, 1 con error" in r["e"]["detalle"]
    assert r["p"]["ok"] == 0 and r["p"]["detalle"].startswith("1 celdas")


def test_quotes_must_be_literal(one):
    assert one("Con la «semilla 42» y la misma partición.", lambda c: text.is_literal_quote(F.lit("la Semilla 42 y la"), c))[0]
    assert not one("abc", lambda c: text.is_literal_quote(F.lit("abc"), c))[0]
