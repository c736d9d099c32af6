import json

from pyspark.sql import functions as F

from docloom.operators import runlog
from docloom.sources import readers, writers


def test_package_notebook_and_artifacts(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\ncon 0.25\n", encoding="utf-8")
    nb = {"cells": [{"id": "1", "cell_type": "markdown", "source": ["Texto ", "uno"]},
                    {"id": "2", "cell_type": "code", "execution_count": 1, "source": "x = 1", "outputs": [
                        {"output_type": "stream", "text": ["sale 3.25\n"]}, {"output_type": "display_data", "data": {"text/plain": ["7.5"], "image/png": "AA"}}]}]}
    (tmp_path / "n.ipynb").write_text(json.dumps(nb), encoding="utf-8")
    (tmp_path / "r.json").write_text('{"kl": 5.5e-05, "acc": 0.91}', encoding="utf-8")
    (tmp_path / "traza.json").write_text('{"no": 9.99}', encoding="utf-8")
    root = str(tmp_path)
    assert {tuple(r["lines"]) for r in readers.package_lines(spark, root).collect()} == {("# T", "con 0.25", ""), ("Texto uno", "x = 1")}
    n = readers.notebooks(spark, root)
    assert n.select(readers.notebook_text(F.col("cells"))).first()[0] == "Texto uno\nsale 3.25\n\n7.5"
    assert n.select(readers.notebook_text(F.col("cells"), False)).first()[0] == "Texto uno"
    ev = {r[0] for r in readers.artifact_numbers(spark, root).collect()}
    assert {0.91, 3.25, 7.5} <= ev and 9.99 not in ev
    assert 5.5e-05 in {r[0] for r in readers.artifact_numbers(spark, root, evaluator=False).collect()}
    assert readers.data_folder(root) == root


def test_log_round_trip(spark, tmp_path):
    folder = tmp_path / "tarea-A"
    log = writers.EventLog(str(folder / "traza.jsonl"))
    log.write("inicio", agente="orquestador")
    log.write("llamada", agente="programador", modelo="m", tokens_entrada=10, tokens_salida=None, latencia_s=1.5, error=None)
    log.write("fin", agente="orquestador", status="completado", subtareas={"T1": "aprobada"}, motivo='token = "abcdefgh1234"')
    assert "abcdefgh1234" not in (folder / "traza.jsonl").read_text()
    t = readers.traces(spark, str(tmp_path / "tarea-*" / "traza.jsonl"))
    s = runlog.run_summary(t.withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("bigint"))), ["tarea"]).first()
    assert (s["tarea"], s["status"], s["tokens_entrada"], s["tokens_salida"], s["modelo"]) == ("A", "completado", 10, 0, "m")
    writers.masked_log(spark, str(folder / "traza.jsonl"), str(tmp_path / "masked"))
    assert not spark.read.text(str(tmp_path / "masked")).where("value like '%abcdefgh1234%'").count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "i int, s string, x double")
    assert all(writers.verified_parquet(df, str(tmp_path / "p")).values())
    writers.write_csv(df, str(tmp_path / "c"))
    assert readers.typed_csv(spark, str(tmp_path / "c"), "i int, s string, x double").count() == 2
    assert writers.markdown_head(["a", "b"]) == "| a | b |\n|---|---|"
    assert writers.markdown_rows(df.select("i", "x")).first()[0] == "| 1 | 0.5 |"
    assert writers.free_folder(str(tmp_path / "x")).startswith(str(tmp_path / "x-"))


def test_file_listings(spark):
    f = spark.createDataFrame([("/r/reporte.md", ), ("/r/b/reporte.md",), ("/r/subtareas/T1/intento-1/s.py",), ("/r/cache/rechazados/T1/intento-1/s.py",)], "path string")
    assert readers.deliverable_path(f, r"reporte\.md$").first()[0] == "/r/reporte.md"
    assert {(r["subtarea"], r["clase"]) for r in readers.attempt_files(f).collect()} == {("T1", "intento"), ("T1", "RECHAZADO")}
    assert readers.new_files(f.limit(0), f).count() == 4
