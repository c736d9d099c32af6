"""Search over the stored index, communities with their certificate, and contexts, on small graphs with known answers."""

import itertools

import pytest
from pyspark.sql import functions as F

from docloom.operators import graph as gr
from docloom.operators import search as se
from docloom.plans import graph_plans as gp

PLANTED = [f"g{k}n{i}" for k in range(3) for i in range(6)]


@pytest.fixture(scope="module")
def planted(spark):
    """Three dense groups of six, tied in a ring by single weak edges."""
    rows = [(a, b, 5) for k in range(3) for a, b in itertools.combinations(PLANTED[6 * k : 6 * k + 6], 2)]
    rows += [("g0n0", "g1n0", 1), ("g1n5", "g2n0", 1), ("g0n5", "g2n5", 1)]
    return spark.createDataFrame(rows, "a string, b string, w bigint").cache()


def test_settled_communities_are_the_planted_groups(spark, planted):
    c = se.settled(planted, gr.communities(planted))
    groups = {}
    for r in c.collect():
        groups.setdefault(r["c"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [sorted(PLANTED[6 * k : 6 * k + 6]) for k in range(3)]
    r = se.certificate(planted, c).first()
    assert (r["nodos"], r["aristas"], r["peso"]) == (18, 48, 3 * 15 * 5 + 3) and r["cubiertos"] and r["conexas"] and r["modularidad_coincide"] and r["sin_mejora"]


def test_certificate_sees_what_is_wrong(spark, planted):
    right = se.settled(planted, gr.communities(planted))
    torn = right.withColumn("c", F.when(F.col("node").isin("g0n1", "g2n3"), "torn").otherwise(F.col("c")))
    r = se.certificate(planted, torn).first()
    assert not r["conexas"] and not r["sin_mejora"]
    assert not se.certificate(planted, right.where("node <> 'g1n3'")).first()["cubiertos"]


@pytest.mark.parametrize("start", ["each", "odd"])
def test_settling_ends_from_any_start(spark, planted, start):
    named = {"each": F.col("u"), "odd": F.substring("u", -1, 1)}[start]
    begin = gr.both_ways(planted).select(F.col("u").alias("node"), named.alias("c")).distinct()
    r = se.certificate(planted, se.settled(planted, begin, quick=2)).first()
    assert r["conexas"] and r["sin_mejora"] and r["cubiertos"]


def test_connected_parts_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(60) if i != 30], "a string, b string, w bigint")
    c = gr.both_ways(e).select(F.col("u").alias("node"), F.lit("all").alias("c")).distinct()
    got = {r["node"]: r["c"] for r in se.connected_parts(e, c).collect()}
    assert {got[f"n{i:03d}"] for i in range(31)} == {"n000"} and {got[f"n{i:03d}"] for i in range(31, 61)} == {"n031"}


def test_ranks_count_over_ranges(spark):
    rows = [(k, f"{v:05d}") for k, n in (("a", 3000), ("b", 1), ("c", 7)) for v in range(n)]
    got = se.ranks_of(spark.createDataFrame(rows, "k string, v string").repartition(7), ["k"], "v").collect()
    assert {(r["k"], r["v"], r["pos"]) for r in got} == {(k, v, int(v) + 1) for k, v in rows}


def test_context_lists_members_relations_and_cites_in_order(spark):
    members = spark.createDataFrame([(f"m{i:02d}", "c1") for i in range(30)] + [("x", "c2"), ("y", "c2")], "node string, c string")
    rel = spark.createDataFrame([(f"m{i:02d}", f"m{i + 1:02d}") for i in range(29)] + [("m00", "x"), ("x", "y")], "origen string, destino string")
    cites = spark.createDataFrame([(f"m{i:02d}", f"doc {j % 7}") for i in range(30) for j in range(i)] + [("m29", "late")], "node string, cita string")
    got = {}
    for r in se.community_context(members, rel, cites).collect():
        got.setdefault((r["c"], r["clase"]), []).append((r["pos"], r["texto"]))
    assert {c for c, _ in got} == {"c1"}  # two members are no community
    assert sorted(got["c1", "miembro"]) == [(i + 1, f"m{i:02d}") for i in range(25)]
    assert sorted(got["c1", "relacion"]) == [(i + 1, f"m{i:02d} → m{i + 1:02d}") for i in range(20)]
    assert sorted(got["c1", "cita"]) == [(i + 1, f"doc {i}") for i in range(7)]


def test_local_search_reaches_notes_through_anchors_only(spark):
    unit = lambda *v: [float(x) for x in v]
    q = spark.createDataFrame([(1, unit(1, 0)), (2, unit(0, 1))], "q bigint, v array<double>")
    names = ["anchor", "common", "other", "far"]
    ent = spark.createDataFrame([(i, n, unit(1 - i / 10, i / 10)) for i, n in enumerate(names)], "n bigint, node string, v array<double>")
    rel = spark.createDataFrame([("anchor", "far"), ("other", "far")], "origen string, destino string")
    mentions = spark.createDataFrame([(1, "anchor"), (1, "common")], "q bigint, node string")
    deps = spark.createDataFrame([(2, 1)], "q bigint, dep bigint")
    located = spark.createDataFrame([("anchor", "c1"), ("anchor", "c2"), *[("common", f"c{i}") for i in range(1, 7)]], "node string, chunk string")
    chunks = spark.createDataFrame([(f"c{i}", unit(1, 0) if i == 1 else unit(0.5, 0.5)) for i in range(1, 7)], "chunk string, v array<double>")
    groups = spark.createDataFrame([("g", unit(1, 0))], "c string, v array<double>")
    members = spark.createDataFrame([("anchor", "g")], "node string, c string")
    cites = spark.createDataFrame([("anchor", f"cite {i}") for i in range(5)], "node string, cita string")
    rcites = spark.createDataFrame([("anchor", "far", f"r{i}") for i in range(3)], "origen string, destino string, cita string")
    got = se.local_search(q, ent, rel, mentions, deps, located, chunks, groups, members, cites, rcites).collect()
    of = lambda n, clase: sorted((r["pos"] or 0, r["id"], r["citas"]) for r in got if r["q"] == n and r["clase"] == clase)
    assert of(1, "ancla") == of(2, "ancla") == [(0, "anchor", "cite 0; cite 1; cite 2")]  # 2 depends on 1; "common" is everywhere
    assert of(1, "fragmento") == [(1, "c1", "c1")] and {i for _, i, _ in of(2, "fragmento")} == {"c2"}  # c1 lies beyond the margin
    assert of(1, "comunidad") == [(1, "g", "comunidad g")] and of(1, "relacion")[0] == (1, "anchor→far", "r0; r1")
    assert {i for _, i, _ in of(1, "semilla")} == set(names) and of(1, "vecino") == []


def test_a_form_across_a_chunk_border_is_found(spark, tmp_path):
    """The planted word starts before character 2,500 and ends after it."""
    text = ("ab " * 832) + "planted " + "cd " * 10
    assert text.index("planted") < gp.CHUNK < text.index("planted") + 7
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "planted cd")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r["node"], r["chunk"]) for r in gp.entity_mentions(spark, str(tmp_path)).collect()}
    assert got == {("planted", 0), ("cd", 1)}
