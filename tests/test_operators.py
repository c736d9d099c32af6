import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import containment, entities, experiments, graph, provenance, retrieval
from docloom.operators.lsa import lsa_topk
from docloom.plans import scale

# The published corpus, questions and store pairs that the published results are for.
CORPUS = [
    "El mecanismo de atención pondera cada token según su similitud con la consulta; la atención escalada divide por la raíz de la dimensión.",
    "Los transformadores apilan capas de autoatención y redes feed-forward, con conexiones residuales y normalización.",
    "La recuperación aumentada con generación busca fragmentos relevantes y los añade al prompt del modelo.",
    "BM25 es una función de ranking léxica que pondera la frecuencia de términos y la longitud del documento.",
    "Los embeddings densos representan textos como vectores; la similitud coseno compara su orientación.",
    "Un agente con herramientas decide en cada paso qué función llamar y observa el resultado.",
    "ReAct intercala razonamiento y acciones; Reflexion añade una autocrítica verbal entre intentos.",
    "El ajuste fino con LoRA entrena matrices de bajo rango y congela los pesos originales.",
    "La temperatura reescala los logits antes del softmax; valores bajos concentran la probabilidad.",
    "La cuantización reduce la precisión de los pesos a 8 o 4 bits para ahorrar memoria.",
]
QUERIES = [
    ("¿Qué función de ranking léxica pondera la frecuencia de términos?", 4), ("¿Cómo se añaden fragmentos recuperados al prompt?", 3),
    ("¿Qué técnica entrena matrices de bajo rango?", 8), ("¿Cómo se compara la orientación de dos vectores de texto?", 5),
    ("¿Qué hace que el modelo sea más determinista al elegir la siguiente palabra?", 9),
    ("¿Qué arquitectura combina autoatención con capas feed-forward?", 2),
]
STORES = [(12.4, 10.6), (9.8, 9.1), (15.1, 13.9), (11.0, 12.4), (8.7, 7.2), (13.6, 13.9), (10.2, 9.3), (14.9, 12.8),
          (7.5, 9.3), (16.0, 15.0), (9.3, 9.8), (12.8, 11.1), (11.7, 12.9), (8.9, 8.3), (13.2, 11.9), (10.6, 11.5)]


@pytest.fixture(scope="module")
def corpus(spark):
    d = spark.createDataFrame([(i + 1, t) for i, t in enumerate(CORPUS)], "d bigint, text string")
    q = spark.createDataFrame([(i + 1, t, r) for i, (t, r) in enumerate(QUERIES)], "q bigint, text string, rel bigint")
    return d, q


def test_tfidf_reference_quality(corpus):
    d, q = corpus
    v, qw = retrieval.tfidf_index(d, "d", "text", q, "q", "text")
    r = retrieval.relevant_ranks(v, "d", qw, "q", q.select("q", F.col("rel").alias("d")))
    row = retrieval.ranking_quality(r).first()
    assert (row["mrr"], row["hit_3"]) == (0.861111, 0.833333)


def test_lsa_reference_quality(corpus):
    d, q = corpus
    r = lsa_topk(d, "d", "text", q, "q", "text", 4, 10).join(q, "q").where(F.col("d") == F.col("rel"))
    assert abs(r.agg(F.avg(1 / F.col("rank"))).first()[0] - 0.75) < 1e-9


@pytest.fixture(scope="module")
def stores(spark):
    return spark.createDataFrame([(i, round(a - b, 10)) for i, (a, b) in enumerate(STORES)], "i int, d double")


def test_paired_experiment(stores):
    r = experiments.paired_test(stores, "d").first()
    assert round(r["sd"], 4) == 1.2534 and round(r["se"], 4) == 0.3133 and round(r["p"], 4) == 0.2013
    assert (r["favorecen_b"], r["favorecen_a"]) == (10, 6)
    s = experiments.sign_flip_test(stores, "d", "i").first()
    assert (s["configuraciones"], s["extremas"]) == (65536, 13372)


def test_wrong_methods_give_other_answers(stores):
    pop = stores.agg(F.stddev_pop("d")).first()[0]
    assert round(pop, 4) == 1.2136
    with pytest.raises(Exception):
        experiments.sign_flip_test(stores.unionByName(stores), "d", "i").collect()


def test_sampling_distributions(spark):
    d = spark.createDataFrame([("t0", 2.0), ("t1", 1.0), ("t2", 0.5), ("t3", 0.2), ("t4", -1.0), ("t5", -3.0)], "t string, l double")
    for temp, bits in ((0.5, 0.9147), (1.0, 1.7998), (2.0, 2.2888)):
        p = experiments.softmax(d, [], "l", temp)
        assert round(p.agg(-F.sum(F.col("p") * F.log2("p"))).first()[0], 4) == bits
    top = experiments.top_p(experiments.softmax(d, [], "l", 1.0), [], "p", "t").orderBy("t").collect()
    assert [(r["t"], round(r["p_top"], 4)) for r in top] == [("t0", 0.5694), ("t1", 0.2095), ("t2", 0.127), ("t3", 0.0941)]


def test_poisson_bootstrap_is_centred(spark):
    df = spark.range(20000).select("id", (F.col("id") % 100).cast("double").alias("v"))
    r = experiments.poisson_bootstrap(df, "v", "id").first()
    assert r["bajo"] < 49.5 < r["alto"] and r["alto"] - r["bajo"] < 2


def _check(spark, text, given, values):
    d = spark.createDataFrame([(1, text)], "k bigint, t string")
    m = spark.createDataFrame([(v,) for v in values], "value double")
    g = spark.createDataFrame([(v,) for v in given], "value double")
    c = provenance.check_figures(d, "k", "t", g, m)
    return provenance.provenance_summary(d, "k", c).first(), c, m


def test_provenance_case(spark):
    s, _, _ = _check(spark, "NB 0.9474, F1 0.94, inventada 0.9415, del enunciado 0.25, y en código:\n```\n0.5555\n```", [0.25, 25.0], [0.947368421, 0.9428])
    assert (s["sin_origen"], s["total"]) == ("0.9415", 3)


def test_suggestions(spark):
    s, c, m = _check(spark, "KL 5.0069, similitud 0.6140, varianza 39.53 %, bien: 0.6141", [], [5.006898814879229e-05, 0.6140509840251385, 0.3953421709086953])
    assert s["sin_origen"] == "0.6140|5.0069"
    got = {(r["value"]): (r["pista"], r["exponente"]) for r in provenance.suggestions(c.where("ok = 0"), m).collect()}
    assert got == {5.0069: ("escala", -5), 0.614: ("redondeo", 0)}


def test_band_match_against_brute_force(spark):
    rng = random.Random(1)
    values = [round(rng.uniform(0, 3), 6) for _ in range(400)]
    need = [(round(rng.uniform(0, 3), d), d) for d in (2, 3, 4, 5, 9, 10) for _ in range(60)] + [(values[0], 9)]
    n = spark.createDataFrame(need, "value double, decimals int")
    m = spark.createDataFrame([(v,) for v in values], "value double")
    got = {(r[0], r[1]) for r in provenance.supported_values(n, m).collect()}
    want = {(v, d) for v, d in need if any(abs(a - v) <= 0.5 * 10**-d + 1e-9 for a in values)}
    assert got == want


def _fold(rows):
    """The ordered fold itself, kept as the reference for the pointer version."""
    index, merged = {}, {}
    for eid, forms in rows:
        key = next((index[f] for f in forms if f in index), eid)
        merged[eid] = key
        for f in forms:
            index.setdefault(f, key)
    return merged


def test_fusion_equals_the_ordered_fold(spark):
    rng = random.Random(7)
    rows = [(i, list(dict.fromkeys(f"f{rng.randrange(120)}" for _ in range(rng.randint(1, 3))))) for i in range(200)]
    e = spark.createDataFrame(rows, "eid bigint, formas array<string>")
    got = {r["eid"]: r["root"] for r in entities.fusion_roots(e, "eid", "formas").collect()}
    assert got == _fold(rows)


def test_fusion_by_alias(spark):
    e = spark.createDataFrame([(0, "Exactitud", "métrica", ["accuracy"], "a", "s9 § 1.1", "notas"), (1, "accuracy", "concepto", [], "b", "Parte 2", "enunciado"),
                               (2, "Modelo", "concepto", [], "", "Parte 2", "enunciado")],
                              "eid bigint, nombre string, tipo string, alias array<string>, descripcion string, cita string, origen string")
    c = entities.clean_entities(e, ["cita"], "eid")
    f = entities.fused(c, entities.fusion_roots(c, "eid", "formas"), "eid")
    m = entities.merged_entities(f, "eid").collect()
    assert len(m) == 1 and m[0]["nombre"] == "Exactitud" and m[0]["tipo"] == "metrica" and m[0]["origenes"] == 2 and m[0]["citas"] == 2


def test_reference_rules(spark):
    s = spark.createDataFrame([(1, 0, "Preámbulo", False, "x"), (1, 1, "Parte 1", True, "Datos."), (1, 2, "Parte 2", True, "Entrena los dos modelos."),
                               (1, 3, "Parte 3", True, "Con la misma división de la Parte 1 y los mismos datos."), (1, 4, "El reporte", False, "Tabla de la Parte 2; véase la parte anterior.")],
                              "doc bigint, sec_no bigint, clave string, trabajo boolean, texto string")
    e = {(r["src"], r["dst"]): r["regla"] for r in graph.reference_edges(s, "doc").collect()}
    assert e == {("Parte 2", "Parte 1"): "anafora", ("Parte 3", "Parte 1"): "referencia", ("Parte 3", "Parte 2"): "anafora",
                 ("El reporte", "Parte 2"): "referencia", ("El reporte", "Parte 3"): "anterior"}


def test_long_chain_needs_few_rounds(spark):
    n = 3000
    c = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("dep"), (F.col("id") == 5).alias("bad"))
    r = graph.follow(c, ["g"], "bad")
    assert r.where("hit").count() == n - 6 and r.where("dep is not null").count() == 0


def test_failures_spread_over_diamonds(spark):
    tasks = spark.createDataFrame([("p", n, "conceptual" if n == "c" else "calculo", n in ("a", "c")) for n in "abcdefg"], "g string, node string, tipo string, failed boolean")
    deps = spark.createDataFrame([("p", *d) for d in ("ba", "bg", "db", "dc", "ec", "fd", "fe", "fe")], "g string, node string, dep string")
    got = {r["node"]: r["status"] for r in graph.propagate_failures(tasks, deps, ["g"]).collect()}
    assert got == {"a": "fallida", "b": "omitida", "c": "aprobada", "d": "omitida", "e": "aprobada", "f": "omitida", "g": "aprobada"}
    none = graph.propagate_failures(tasks.withColumn("failed", F.lit(False)), deps, ["g"])
    assert none.where("status <> 'aprobada'").count() == 0


def test_nodes_on_cycles(spark):
    edges = [("p", 1, 2), ("p", 2, 3), ("p", 3, 1), ("p", 3, 4), ("p", 4, 5), ("p", 5, 6), ("p", 6, 5), ("p", 0, 1), ("p", 6, 7), ("q", 1, 2), ("q", 2, 3), ("q", 1, 3), ("r", 9, 9)]
    got = graph.cycle_nodes(spark.createDataFrame(edges, "g string, node int, dep int"), ["g"]).collect()
    assert sorted(map(tuple, got)) == [("p", n) for n in (1, 2, 3, 5, 6)] + [("r", 9)]
    assert graph.cycle_nodes(spark.createDataFrame(edges[9:12], "g string, node int, dep int"), ["g"]).count() == 0


def test_lexical_topological_order(spark):
    d = spark.createDataFrame([(["T1", "T10", "T2", "T3"], [["T3"], [], [], ["T2"]])], "i array<string>, d array<array<string>>").repartition(1)
    assert d.select(graph.lexical_order("i", "d")).first()[0] == ["T10", "T2", "T3", "T1"]


def test_planted_communities(spark):
    rows = [(f"{g}{i}", f"{g}{j}", 5) for g in "ab" for i in range(6) for j in range(i + 1, 6)] + [("a0", "b0", 1)]
    e = spark.createDataFrame(rows, "a string, b string, w bigint")
    c = graph.communities(e)
    groups = {}
    for r in c.collect():
        groups.setdefault(r["c"], set()).add(r["node"][0])
    assert sorted(map(tuple, groups.values())) == [("a",), ("b",)]
    assert graph.modularity(e, c) > 0.45


def test_containment_finds_every_pair(spark):
    rng = random.Random(3)
    words = ["uno", "dos", "tres", "cuatro", "cinco", "seis", "siete"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    items = [(i, docs[rng.randrange(40)][1][a : a + n]) for i, (a, n) in enumerate((rng.randrange(120), rng.choice([1, 5, 12, 30, 60, 100])) for _ in range(40))]
    d, q = spark.createDataFrame(docs, "k bigint, t string"), spark.createDataFrame(items, "i bigint, t string")
    want = sorted((i, k) for i, p in items for k, t in docs if p and p in t)
    assert sorted(map(tuple, containment.contained_items(d, "k", "t", q, "i", "t").collect())) == want


def test_query_blocks_do_not_change_the_answer(corpus, monkeypatch):
    d, q = corpus
    v, qw = retrieval.tfidf_index(d, "d", "text", q, "q", "text")
    a = sorted(map(tuple, retrieval.sparse_topk(v, "d", qw, "q", 3).collect()))
    pairs = q.select("q", F.col("rel").alias("d"))
    ranks = sorted(map(tuple, retrieval.relevant_ranks(v, "d", qw, "q", pairs).collect()))
    for name, n in (("QUERY_BLOCK", 2), ("SLOT_BLOCKS", 1), ("STRIPE", 2)):
        monkeypatch.setattr(retrieval, name, n)
    assert sorted(map(tuple, retrieval.sparse_topk(v, "d", qw, "q", 3).collect())) == a
    assert sorted(map(tuple, retrieval.relevant_ranks(v, "d", qw, "q", pairs).collect())) == ranks


def test_dense_topk_over_many_stripes_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(90)] + [(90, None)]  # small integers: many ties
    asked = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(11)] + [(11, None)]
    d, q = spark.createDataFrame(rows, "k bigint, v array<double>"), spark.createDataFrame(asked, "q bigint, v array<double>")
    want = []
    for i, v in asked[:-1]:
        near = sorted((-float(np.dot(v, w)), k) for k, w in rows[:-1])[:7]
        want += [(i, k, -s, r) for r, (s, k) in enumerate(near, 1)]
    for name, n in (("QUERY_BLOCK", 2), ("SLOT_BLOCKS", 2), ("STRIPE", 16)):
        monkeypatch.setattr(retrieval, name, n)
    got = retrieval.dense_topk(d, "k", "v", q, "q", "v", 7).select("q", "k", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[3])) == want
    assert retrieval.dense_topk(d.limit(0), "k", "v", q, "q", "v", 7).count() == 0
    assert retrieval.dense_topk(d, "k", "v", q.limit(0), "q", "v", 7).count() == 0


def test_prefix_scan_with_one_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5).alias("k"), "id", (F.col("id") % 11).alias("v"))
    got = {r["id"]: r["s"] for r in scale.running_sum(df, ["k"], ["id"], F.floor(F.col("id") / 100), {"s": "v"}).collect()}
    acc, want = {}, {}
    for i in range(5000):
        k = 7 if i % 3 == 0 else i % 5
        acc[k] = acc.get(k, 0) + i % 11
        want[i] = acc[k]
    assert got == want


def test_salted_lookup_equals_a_plain_join(spark):
    l = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    r = l.select("key").distinct().withColumn("v", F.length("key"))
    r = r.where(F.col("key") != "k7")
    for how in ("inner", "left"):
        a = scale.lookup(l, r, ["key"], ["id"], how).select("id", "key", "v")
        b = l.join(r, "key", how).select("id", "key", "v")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        hot = scale.hot_keys(l.groupBy("key").agg(F.count("*").alias("n")), ["key"], "n", rows=100)
        assert [tuple(x) for x in hot.collect()] == [("hot", 15)]
        c = scale.salted_lookup(l, r, ["key"], hot, ["id"], how).select("id", "key", "v")
        assert c.exceptAll(b).count() == 0 and b.exceptAll(c).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=2001).round(2)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")
    r = scale.exact_quantiles(df, ["k"], "v", [0.025, 0.5, 0.975], F.floor("v")).first()
    assert np.allclose([r["q0"], r["q1"], r["q2"]], np.percentile(x, [2.5, 50, 97.5]))
