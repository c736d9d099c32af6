"""Validity rules of plans held as tables of subtasks, sections and section dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage

# Subtask kinds and the size limit of a valid plan.
KINDS = ["calculo", "conceptual"]
MAX_SUBTASKS = 12


def plan_violations(tasks: DataFrame, sections: DataFrame, links: DataFrame, plan: str) -> DataFrame:
    """``plan, problema`` for every broken rule.

    ``tasks``: plan, id, tipo, secciones, depende_de, criterio.  ``sections``: plan,
    clave, trabajo.  ``links``: plan, src, dst (section depends on section).  Every
    rule runs on plans of any size; a plan over the limit is reported for its size as well.
    """
    p = F.col
    say = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts]).alias("problema")
    sizes = tasks.groupBy(plan).agg(F.count("*").alias("n"), F.sum((F.trim("id") == "").cast("int")).alias("anon"))
    out = [
        sizes.where(p("n") > MAX_SUBTASKS).select(plan, say("demasiadas subtareas (", p("n").cast("string"), f" > {MAX_SUBTASKS})")),
        sizes.where(p("anon") > 0).select(plan, say("hay subtareas sin id")),
        sections.select(plan).distinct().join(sizes, plan, "left_anti").select(
            plan, say("el plan no tiene una lista 'subtareas' con al menos una subtarea")),
        tasks.groupBy(plan, "id").agg(F.count("*").alias("n")).where(p("n") > 1).select(plan, say("ids repetidos: ", p("id"))),
        tasks.where(~p("tipo").isin(*KINDS)).select(plan, say(p("id"), ": tipo '", p("tipo"), "' no es 'calculo' ni 'conceptual'")),
        tasks.where(F.trim(F.coalesce("criterio", F.lit(""))) == "").select(plan, say(p("id"), ": falta el criterio")),
    ]
    covers = tasks.select(plan, "id", "tipo", F.explode("secciones").alias("clave"))
    known = sections.select(plan, "clave").distinct()
    out.append(covers.join(known, [plan, "clave"], "left_anti").select(plan, say(p("id"), ": la sección '", p("clave"), "' no existe en el enunciado")))
    needs = tasks.select(plan, "id", F.explode("depende_de").alias("dep"))
    out.append(needs.where(p("dep") == p("id")).select(plan, say(p("id"), " depende de sí misma")))
    ids = tasks.select(plan, F.col("id").alias("dep")).distinct()
    others = needs.where(p("dep") != p("id"))
    out.append(others.join(ids, [plan, "dep"], "left_anti").select(plan, say(p("id"), " depende de ", p("dep"), ", que no existe")))
    edges = others.join(ids, [plan, "dep"], "left_semi").distinct()
    anc = cut_lineage(ancestors(edges, plan))
    cyclic = anc.where(p("id") == p("dep")).select(plan).distinct()
    out.append(cyclic.select(plan, say("las dependencias forman un ciclo")))
    sound = sizes.select(plan).join(cyclic, plan, "left_anti")
    bare = sections.where("trabajo").select(plan, "clave").join(covers.select(plan, "clave").distinct(), [plan, "clave"], "left_anti")
    out.append(bare.join(sound, plan, "left_semi").select(plan, say("sección de trabajo sin subtarea: ", p("clave"))))
    givers = covers.where(p("tipo") == "calculo").select(plan, p("clave").alias("dst"), p("id").alias("giver")).distinct()
    want = covers.select(plan, "id", p("clave").alias("src")).join(links, [plan, "src"]).join(givers, [plan, "dst"]).where(p("giver") != p("id"))
    met = want.join(anc.select(plan, "id", p("dep").alias("giver"), F.lit(1).alias("ok")), [plan, "id", "giver"], "left")
    gap = met.groupBy(plan, "id", "src", "dst").agg(F.max("ok").alias("ok")).where(p("ok").isNull())
    out.append(gap.join(sound, plan, "left_semi").select(
        plan, say(p("id"), " cubre ", p("src"), ", que depende de ", p("dst"), ", pero ", p("id"), " no depende de ella")))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def ancestors(edges: DataFrame, plan: str) -> DataFrame:
    """``plan, id, dep`` for every direct or indirect dependency; paths double each round."""
    cur = cut_lineage(edges.select(plan, "id", "dep").distinct())
    size = cur.count()
    while True:
        far = cur.alias("x").join(cur.select(plan, F.col("id").alias("dep"), F.col("dep").alias("up")), [plan, "dep"]).select(
            plan, "id", F.col("up").alias("dep"))
        nxt = cut_lineage(cur.unionByName(far).distinct())
        n = nxt.count()
        if n == size:
            return nxt
        cur, size = nxt, n
