"""Nothing is cut: late stream files, long extractions, large plans, texts and queries without known words."""

import glob
import os

from pyspark.sql import functions as F

from docloom.functions import names
from docloom.operators import entities, plan_rules, retrieval
from docloom.streaming import events as ev

SF = "/root/testdata/sf0.001"


def test_files_in_any_order_all_count(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    out = str(tmp_path / "events.parquet")
    src.repartitionByRange(40, "ts").write.parquet(out)
    files = sorted(glob.glob(f"{out}/*.parquet"))
    for k, f in enumerate(reversed(files)):  # the newest rows come first
        os.utime(f, (1_000_000 + k, 1_000_000 + k))
    days = ev.latest(ev.drain(ev.daily_totals(ev.event_stream(spark, str(tmp_path), 4)), "update"), ["day", "event_type"], ["n", "total"])
    assert days.agg(F.sum("n")).first()[0] == src.count()
    spend = ev.latest(ev.drain(ev.spend_by_run(ev.event_stream(spark, str(tmp_path), 4), 500.0), "update"), ["user_id"], ["n", "spent", "over"])
    want = src.groupBy("user_id").agg(F.count("*").alias("n"), (F.sum("value") > 500).cast("int").alias("over"))
    assert {tuple(r) for r in spend.select("user_id", "n", "over").collect()} == {tuple(r) for r in want.collect()}


def test_long_extractions_and_names_stay_whole(spark):
    raw = spark.createDataFrame([("x", i, f"Nombre largo {'z' * 90} {i}", "dato", [f"alias {j}" for j in range(9)]) for i in range(60)],
                                "cita string, pos int, nombre string, tipo string, alias array<string>")
    clean = entities.clean_entities(raw, ["cita"], "pos")
    assert clean.count() == 60 and clean.select("nombre").distinct().count() == 60 and clean.agg(F.min(F.size("alias"))).first()[0] == 9
    assert entities.clean_entities(raw, ["cita"], "pos", limit=20).count() == 20
    label = spark.range(1).select(names.relation_label(F.lit("a" * 70)).alias("a"), names.section_key(F.lit("b" * 70)).alias("b")).first()
    assert (len(label["a"]), len(label["b"])) == (70, 70)


def test_a_large_cyclic_plan_is_reported_for_size_and_cycle(spark):
    n = 13
    tasks = spark.createDataFrame([("p", f"T{i}", "calculo", [f"Parte {i}"], [f"T{(i + 1) % n}"], "medido") for i in range(n)],
                                  "plan string, id string, tipo string, secciones array<string>, depende_de array<string>, criterio string")
    sections = spark.createDataFrame([("p", f"Parte {i}", True) for i in range(n)], "plan string, clave string, trabajo boolean")
    links = spark.createDataFrame([], "plan string, src string, dst string")
    got = {r["problema"] for r in plan_rules.plan_violations(tasks, sections, links, "plan").collect()}
    assert "las dependencias forman un ciclo" in got and any(p.startswith("demasiadas subtareas") for p in got)


def test_every_query_gets_k_rows(spark):
    docs = spark.createDataFrame([(1, "sol y luna"), (2, ""), (3, "mar"), (4, None)], "d long, t string")
    queries = spark.createDataFrame([(1, "luna mar"), (2, "nada conocido"), (3, None)], "q long, t string")
    vectors, qw = retrieval.tfidf_index(docs, "d", "t", queries, "q", "t")
    got = retrieval.sparse_topk(vectors, "d", qw, "q", 3).orderBy("q", "rank").collect()
    assert [(r["q"], r["d"]) for r in got] == [(1, 3), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]
    pairs = spark.createDataFrame([(1, 1), (1, 3), (2, 3)], "q long, d long")
    assert {(r["q"], r["rango"]) for r in retrieval.relevant_ranks(vectors, "d", qw, "q", pairs).collect()} == {(1, 1), (2, 3)}
