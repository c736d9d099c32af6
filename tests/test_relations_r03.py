"""Relation fusion: names as numbers, and ends looked up only where a form has several claves."""

import datetime
import random
from collections import defaultdict

import pytest

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_shipdate timestamp"


def _tables(seed):
    rnd = random.Random(seed)
    parts = [(i, rnd.choice(["ring", "bolt"]), rnd.choice(["x1", "x2", "x3"]), rnd.choice(["big", "tiny"]), rnd.randrange(1, 13)) for i in range(8)]
    suppliers = list(enumerate(["ring x1", "ring x2", "bolt x3", "acme", "bolt x1", None, "ring x3", "bolt x2"]))
    days = [datetime.datetime(y, 3, 1) for y in (1994, 1995, 1996)] + [None]
    lines = [(rnd.choice([1, 2, 3, 4, None]), rnd.choice([*range(9), None]), rnd.choice([*range(9), None]), rnd.choice(["A", "R", None]), rnd.choice(days))
             for _ in range(120)]
    return parts, suppliers, lines


def _by_hand(parts, suppliers, lines):
    """The ordered fold, and every end looked up among the names of its own order; also how many lines have an end of several claves."""
    forms = {e: [f"{n} {b}", f"{b} {t} {z // 5}"] for e, n, b, t, z in parts}
    owner, root = {}, {}
    for e in sorted(forms):
        root[e] = next((root[owner[f]] for f in forms[e] if f in owner), e)
        for f in forms[e]:
            owner.setdefault(f, e)
    names, local = dict(suppliers), defaultdict(set)
    for o, p, s, _, _ in lines:
        if p in forms:
            local[o, forms[p][0]].add(forms[root[p]][0])
            if names.get(s) is not None:
                local[o, names[s]].add(names[s])
    out, several = defaultdict(list), 0
    for o, p, s, flag, day in lines:
        if o is None or p not in forms or names.get(s) is None:
            continue
        ends = local[o, forms[p][0]], local[o, names[s]]
        several += max(map(len, ends)) > 1
        for a in ends[0]:
            for b in ends[1]:
                if a != b:
                    out[a, b, f"flag_{flag.lower()}" if flag else "relacionado_con"].append(day and day.year)
    return sorted((*k, len(set(v) - {None}), len(v)) for k, v in out.items()), several


@pytest.mark.parametrize("seed", [2, 13, 18])
def test_relations_are_resolved_in_their_order_without_shuffling_orders(spark, tmp_path, seed):
    from docloom.plans.graph_plans import relation_fusion

    parts, suppliers, lines = _tables(seed)
    for name, rows, schema in (("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
                               ("supplier", suppliers, "s_suppkey long, s_name string"), ("lineitem", lines, LINES)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = relation_fusion(spark, str(tmp_path))
    want, several = _by_hand(parts, suppliers, lines)
    assert several > 5 and sorted(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" not in plan and "regexp_replace" not in plan


def test_relations_with_and_without_a_known_clave(spark):
    from docloom.operators import entities

    rnd = random.Random(3)
    local = [(o, f, k) for o in range(6) for f in "abcdef" for k in rnd.sample([f, f.upper(), f * 2] if f in "abc" else [f.upper()], rnd.randint(1, 3 if f in "abc" else 1))]
    claves = defaultdict(list)
    for o, f, k in local:
        claves[o, f].append(k)
    rel = [(o, a, b, "r", rnd.randrange(3)) for o in range(6) for a in "abcdef" for b in "abcdef"]
    known = [(*r, rnd.choice(claves[r[0], r[1]]), rnd.choice(claves[r[0], r[2]])) for r in rel]
    schema = "o long, origen string, destino string, relacion string, cita int"
    names = spark.createDataFrame(local * 2, "o long, forma string, clave string")
    got = [sorted(map(tuple, entities.merged_relations(spark.createDataFrame(rows, s), names, ["o"]).collect()))
           for rows, s in ((rel, schema), (known, schema + ", k_origen string, k_destino string"))]
    assert got[0] == got[1] and len(got[0]) > 20
