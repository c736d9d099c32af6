"""Findings of round 3: the fixed shape of a plan, and whole results on inputs that the tables do not have."""

import pytest
from pyspark.sql import functions as F


def _tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_lexical_similarity_joins_no_exploded_counts(spark, tmp_path):
    from docloom.plans.retrieval_plans import lexical_similarity

    rows = [(1, 0, "casa azul"), (1, 1, "casa azul"), (1, 2, "xyz"), (1, 3, None), (2, 0, "roja"), (2, 2, "roja"), (3, 0, "uno dos"), (3, 0, "tres"), (3, 1, "uno tres dos")]
    df = lexical_similarity(spark, _tables(spark, tmp_path, conversations=(rows, "conv_id long, turn long, text string")))
    got = sorted((r.conv_id, r.turn, r.sim) for r in df.collect())
    # turns of one number are counted together, and every pair of turns has its row, as in the SQL
    assert got == [(1, 1, 1.0), (1, 2, 0.0), (1, 3, 0.0), (3, 1, 1.0), (3, 1, 1.0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate explode(g" not in plan


@pytest.mark.parametrize("span", [7, 40, 1 << 20])
def test_notes_by_line_give_the_chunks_of_whole_notes(spark, span):
    import random

    from docloom.operators import sections

    kinds = ["## A", "### b", "### c largo", "```", "texto " * 3, "", "  ```py", "#### d", "##", "uno"]
    notes = {f"n{i}": random.Random(i).choices(kinds, k=60 * i) for i in range(4)}
    whole = spark.createDataFrame([(k, v) for k, v in notes.items()], "f string, l array<string>")
    lines = spark.createDataFrame([(k, 3 * i, t) for k, v in notes.items() for i, t in enumerate(v)], "f string, p long, t string")
    got = sorted(map(repr, sections.note_line_chunks(lines, "f", "p", "t", 60, span).collect()))
    want = sorted(map(repr, sections.note_chunks(whole, "f", "l", 60).collect()))
    assert got == want and len(got) > 20


def test_small_ranges_do_not_make_a_task_each(tmp_path):
    from docloom.sources import package as pk

    (tmp_path / "a.md").write_text("línea uno\n" * 5000)
    (tmp_path / "b.md").write_text("x\n" * 5000)
    reader = pk.PackageReader({"path": str(tmp_path), "range": "16"})
    parts = reader.partitions()
    assert len(parts) == 1
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 10_000 and len({(r["path"], r["pos"]) for r in rows}) == 10_000 and {r["texto"] for r in rows} == {"línea uno", "x"}


def test_communities_of_heavy_edges(spark):
    """Squares of community weights pass 64 bits."""
    from docloom.operators import graph as gr
    from docloom.operators import search as se
    from docloom.session import cut_lineage

    heavy = 3_000_000_000
    rows = [(a, b, heavy) for g in ("abc", "xyz") for i, a in enumerate(g) for b in g[i + 1:]] + [("c", "x", 1)]
    e = cut_lineage(spark.createDataFrame(rows, "a string, b string, w long"))
    comm = gr.communities(e)
    sets = {frozenset(r.n) for r in comm.groupBy("c").agg(F.collect_set("node").alias("n")).collect()}
    assert sets == {frozenset("abc"), frozenset("xyz")} and abs(gr.modularity(e, comm) - 0.5) < 1e-6
    row = se.certificate(e, se.settled(e, comm)).first()
    assert row.cubiertos and row.conexas and row.modularidad_coincide and row.sin_mejora


@pytest.mark.parametrize("terms", [4, 9, 4096])
def test_pair_counts_by_brute_force(spark, monkeypatch, terms):
    import itertools
    import random
    from collections import Counter

    import pyarrow as pa

    from docloom.operators import graph as gr

    monkeypatch.setattr(gr, "PAIR_TERMS", terms)
    rng = random.Random(3)
    rows = [rng.sample([*"abcdefghij", "é", "ñu", "𝔸", "ﬁ"], rng.randrange(0, 9)) for _ in range(300)]
    given = [b for b in gr._pair_counts(iter([pa.RecordBatch.from_arrays([pa.array(rows[i : i + 50], pa.list_(pa.string()))], names=["m"]) for i in range(0, 300, 50)]))]
    got = Counter()
    for r in (r for b in given for r in b.to_pylist()):
        got[r["a"], r["b"]] += r["w"]
    assert got == Counter(p for r in rows for p in itertools.combinations(sorted(r), 2))
    if terms == 4096:  # one task gives each pair once, not once per row
        assert sum(b.num_rows for b in given) == len(got)
        df = gr.pair_weights(spark.createDataFrame([(r,) for r in rows], "m array<string>"), "m")
        assert {(r.a, r.b): r.w for r in df.collect()} == got


def test_compatibility_forms_in_parts(spark):
    """A batch is normalised some rows at a time, so only those are Python strings; nulls and order stay."""
    import unicodedata

    import pyarrow as pa

    from docloom.functions.text import nfkc

    texts = [None if i % 7 == 0 else f"ﬁ{i} x² ½ １２" for i in range(300)]
    want = [t and unicodedata.normalize("NFKC", t) for t in texts]
    assert nfkc.func(pa.array(texts, pa.string())).to_pylist() == want and len(nfkc.func(pa.array([], pa.string()))) == 0
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    assert [r.n for r in df.select("i", nfkc("t").alias("n")).orderBy("i").collect()] == want


def test_line_keys_are_shared_by_headings(one):
    from docloom.functions import text as tx

    names = ["Uno", "dós", "nada", "Tres"]
    text = "x\n## 1 Uno y más\ncuerpo\n# DOS\n\n3. tres\nUno"
    each = one(text, *[lambda c, n=n: tx.heading_offset(c, n).alias(n) for n in names])
    assert one(text, lambda c: tx.heading_offsets(c, F.array(*map(F.lit, names))).alias("o"))["o"] == list(each) == [2, 24, -1, 31]


def test_figure_checks_share_the_plain_text(spark):
    from docloom.operators import checks as ck

    specs = [{"id": f"c{i}", "tipo": "cifra_presente", "verdad": float(i)} for i in range(4)]
    df = ck.run_checks(spark.createDataFrame([(1, "hay 2 y ```3```"), (2, None)], "k int, t string"), "k", "t", specs)
    assert [(r["k"], r["check"]) for r in df.where("ok = 1").collect()] == [(1, "c2")]
    assert df._jdf.queryExecution().executedPlan().toString().count("```.*?```") == 1
