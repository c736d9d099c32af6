"""Checks as tables, quotes with spans, nested sizes, splits, draws, regression, embedding events, the state of a run, LSA."""

import json
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import quotes as qt
from docloom.functions.limits import required_sections
from docloom.functions.nested import container_sizes
from docloom.functions.vectors import embedding_with_events
from docloom.operators import check_tables as ct
from docloom.operators import lsa
from docloom.operators import sampling as sp
from docloom.plans import runlog_plans as rp
from docloom.plans import stream_plans as st
from docloom.streaming import events as ev
from docloom.streaming import guard as gd


def test_each_task_has_its_own_checks_and_truths(spark):
    truths = ct.truth_table(spark, {"uno": lambda: spark.range(1).select(F.lit(1.5)), "nada": lambda: spark.range(0).select("id")})
    none = (None,) * 6
    checks = spark.createDataFrame([
        ("A", "a1", "contiene", ["C", "fin"], *(None,) * 7), ("A", "a2", "cifra", None, None, None, "valor", "uno", 0.01, None, None), ("A", "a3", "secciones", ["Uno", "Dos"], True, *none),
        ("B", "b1", "cifra_presente", None, None, None, None, "nada", None, None, None), ("B", "b2", "palabras_max", None, None, 3.0, *(None,) * 5), ("B", "b3", "raro", *(None,) * 8),
    ], ct.CHECK_SCHEMA)
    docs = spark.createDataFrame([(1, "A", "# Uno\nusa C++ y el valor es 1,505\n# Dos\nfin"), (2, "A", "# Dos\n# Uno\nC+ valor 3"), (3, "B", "uno dos tres cuatro"), (4, "B", None), (5, "Z", "x")], "k int, tarea string, text string")
    got = {(r["k"], r["check"]): (r["ok"], r["detalle"]) for r in ct.run_check_table(docs, "k", checks, truths).collect()}
    assert got[1, "a1"] == (1, "todos presentes") and got[2, "a1"] == (0, "faltan fin")
    assert got[1, "a2"] == (1, "verdad=1.5000 ±0.01; hallada") and got[2, "a2"][0] == 0
    assert got[1, "a3"] == (1, "todas, en orden") and got[2, "a3"] == (0, "las secciones están fuera de orden")
    assert got[3, "b1"] == (0, "verdad=? ±0.005; no hallada") and got[3, "b2"] == (0, "4 palabras") and got[4, "b2"] == (0, "no hay entregable")
    assert got[3, "b3"] == (0, "tipo desconocido: raro") and not [k for k in got if k[0] == 5]


def test_quote_spans_map_back_to_the_source(spark):
    text = "Es  *la* ﬁcha «del café» número 12 de la lista"  # ligature, combining accent, markup, wide blanks
    quotes = ["la ficha del café número", "LA FICHA DEL CAFÉ", "número 12", "número 12 de la", "no está en el texto", None]
    r = spark.createDataFrame([(text, quotes), (None, ["una frase larga"]), ("x", None)], "t string, q array<string>").select(qt.quote_spans("t", "q").alias("s")).collect()
    spans = [None if s is None else text[s["ini"] : s["fin"]] for s in r[0]["s"]]
    assert spans == ["la* ﬁcha «del café» número", "la* ﬁcha «del café", None, "número 12 de la", None, None]
    assert r[1]["s"] == [None] and r[2]["s"] == []


@pytest.mark.parametrize("seed", range(3))
def test_normal_form_equals_normalising_the_whole_text(seed):
    rng = np.random.default_rng(seed)
    parts = list("abÀéß ﬁ²½*`_«» \n\t…Ⅷ")
    for _ in range(300):
        text = "".join(rng.choice(parts, rng.integers(0, 30)))
        form, start, end = qt.normal_form(text)
        plain = unicodedata.normalize("NFKC", text).lower()
        assert form == " ".join("".join(c for c in plain if c not in "*`_«»\"'“”").split())
        assert len(form) == len(start) == len(end) and (np.diff(start) >= 0).all() and (end > start).all() and (not len(end) or end[-1] <= len(text))


def test_nested_sizes_of_any_shape(spark):
    values = [{"a": [1, 2, {"b": []}], "c": {}, "d": "x"}, [[], [1], [1, 2]], 5, None]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(9, None)], "k int, j string").select("k", F.parse_json("j").alias("v"))
    got = {(r["k"], r["ruta"], r["tipo"]): r["n"] for r in container_sizes(df, ["k"], "v").collect()}
    assert got == {(0, "$", "mapa"): 3, (0, "$.a", "lista"): 3, (0, "$.a[]", "mapa"): 1, (0, "$.a[].b", "lista"): 0, (0, "$.c", "mapa"): 0, (1, "$", "lista"): 3, (1, "$[]", "lista"): 3}
    assert container_sizes(df.where("false"), ["k"], "v").count() == 0


def test_stratified_split_is_exact_per_class_and_stable(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(1000)] + [(5000 + i, None) for i in range(7)]
    df = spark.createDataFrame(rows, "k long, c string")
    one = {(r["k"], r["c"]): r["prueba"] for r in sp.stratified_split(df, "k", "c", 0.25).collect()}
    two = {(r["k"], r["c"]): r["prueba"] for r in sp.stratified_split(df.repartition(9), "k", "c", 0.25).collect()}
    assert one == two and len(one) == 1007
    sums = {c: sum(v for (_, d), v in one.items() if d == c) for c in ("big", "small", None)}
    assert sums == {"big": 225, "small": 25, None: 2}


def test_draws_follow_the_distribution_and_repeat(spark):
    df = spark.createDataFrame([(k, i, p) for k in (1, 2) for i, p in (("a", 0.5), ("b", 0.3), ("c", 0.2), ("never", 0.0))], "k int, i string, p double")
    got = sp.categorical_draws(df, ["k"], "i", "p", 4000).collect()
    again = sp.categorical_draws(df.repartition(5), ["k"], "i", "p", 4000).collect()
    assert len(got) == 8000 and set(map(tuple, got)) == set(map(tuple, again))
    for k in (1, 2):
        share = {i: sum(r["i"] == i and r["k"] == k for r in got) / 4000 for i in "abc"}
        assert abs(share["a"] - 0.5) < 0.03 and abs(share["b"] - 0.3) < 0.03 and abs(share["c"] - 0.2) < 0.03


def test_newton_steps_find_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, -2.0])))).astype(int)
    rows = [(int(b), float(u), float(v)) for b, (u, v) in zip(y, x, strict=True)] + [(1, None, 0.0), (None, 1.0, 1.0), (0, float("nan"), 1.0)]
    beta = sp.logistic_fit(spark.createDataFrame(rows, "y int, a double, b double"), "y", ["a", "b"], steps=12)
    full = np.column_stack([np.ones(400), x])
    assert np.abs(full.T @ (y - 1 / (1 + np.exp(-full @ beta))) - 0.01 * beta).max() < 1e-8
    assert (sp.logistic_fit(spark.createDataFrame([], "y int, a double"), "y", ["a"]) == 0).all()


def test_vectors_and_events_come_from_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(i, f"texto número {i}") for i in range(1100)], "k long, t string").repartition(2)
    vectors, events = embedding_with_events(df, ["k"], "t", str(tmp_path / "e"))
    assert vectors.count() == 1100 and vectors.select("k").distinct().count() == 1100
    rows = events.collect()
    assert sum(r["textos"] for r in rows) == 1100 and {r["dimension"] for r in rows} == {1024} and all(r["latencia_s"] >= 0 for r in rows) and max(r["textos"] for r in rows) <= 512


@pytest.mark.parametrize("order", ["ab", "ba"])
def test_guard_gives_the_same_rows_for_any_file_order_that_keeps_runs_in_order(spark, tmp_path, order):
    """The first half of every run comes in one batch, the second in the next; runs are dealt over the files in both orders."""
    import time

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    at = tmp_path / "events.parquet"
    at.mkdir()
    side = F.col("event_id") < 500
    for n, part in enumerate([events.where(side), events.where(~side)]):
        runs = [part.where("user_id % 2 = 0"), part.where("user_id % 2 = 1")]
        for m, own in enumerate(runs if order == "ab" else runs[::-1]):
            own.coalesce(1).write.parquet(str(tmp_path / f"tmp{n}{m}"))
            next((tmp_path / f"tmp{n}{m}").glob("*.parquet")).rename(at / f"{n}{m}.parquet")
            time.sleep(1.1)  # files are taken by their time
    with gd.rocks_state(spark):
        s = st.guard_rows(rp.trace_of(ev.event_stream(spark, str(tmp_path), files_per_batch=1)))
        got = ev.drain(gd.guarded(s, rp.RUN, rp.BUDGET, rp.RESERVE), "append")
    assert got.select("epoch").distinct().count() == 4
    want = rp.budget_audit(spark, "/root/testdata/sf0.001")
    calls = {tuple(r) for r in got.where("tipo = 'llamada'").select(*want.columns).collect()}
    assert calls == {tuple(r) for r in want.collect()}
    tries = {tuple(r) for r in got.where("tipo = 'ejecucion'").select(*rp.RUN, "subtarea", "seq", "intento").collect()}
    assert tries == {tuple(r) for r in rp.attempt_numbers(spark, "/root/testdata/sf0.001").select(*rp.RUN, "subtarea", "seq", "intento").collect()}
    seen, again = set(), {}
    for r in sorted(st.guard_rows(rp.trace_of(events)).where("tipo = 'ejecucion'").collect(), key=lambda r: r["seq"]):
        key = (*[r[k] for k in rp.RUN], r["subtarea"], r["huella"])
        again[r["seq"]] = int(key in seen)
        seen.add(key)
    assert {r["seq"]: r["repetida"] for r in got.where("tipo = 'ejecucion'").collect()} == again


def test_lsa_equals_a_dense_decomposition_and_keeps_rows_without_words(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[10 * (i % 4) : 10 * (i % 4) + 14], 25)) for i in range(60)] + ["", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    asked = spark.createDataFrame([(0, "w1 w2 w3"), (1, "w31 w35"), (2, "unknown"), (3, "")], "q long, t string")
    got = {(r["q"], r["d"]): r["score"] for r in lsa.lsa_topk(docs, "d", "t", asked, "q", "t", 3, 62).collect()}
    assert len(got) == 4 * 62
    count = lambda t: np.array([t.split().count(w) for w in words], float)
    c = np.array([count(t) for t in texts])
    idf = np.log(63 / (1 + (c > 0).sum(0))) + 1
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=-1, keepdims=True)) == 0, 1, n)
    a = unit(c * idf)
    basis = np.linalg.svd(a, full_matrices=False)[2][:3].T
    want = unit(unit(np.array([count(t) for t in ("w1 w2 w3", "w31 w35", "unknown", "")]) * idf) @ basis) @ unit(a @ basis).T
    assert max(abs(got[q, d] - want[q, d]) for q in range(4) for d in range(62)) < 1e-4


def test_section_names_are_trimmed(spark):
    t = "Las secciones son: Resumen, 0bjetivos , Límites (sin código) y Método. Fin"
    got = spark.createDataFrame([(t.replace("secciones son:", "secciones:"),)], "t string").select(required_sections(F.col("t")).alias("s")).first()["s"]
    assert got == ["Resumen", "Límites", "Método"]
