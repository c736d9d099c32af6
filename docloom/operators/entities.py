"""Entity and relation fusion across extractions, in order, without a sequential pass.

Read in order, an entity joins the entity that first claimed the first of its
forms already seen.  "Who first claimed a form" is a minimum per form, so each
entity has one pointer to an earlier entity (or none), and following pointers to
their root by doubling gives the same result as the ordered fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.names import DEFAULT_TYPE, entity_type, is_specific, name_forms, relation_label
from docloom.plans.scale import lookup, top_k
from docloom.session import cut_lineage


def clean_entities(raw: DataFrame, extraction: list[str], order: str, limit: int | None = None) -> DataFrame:
    """Entities with a usable name; nameless and generic ones drop.  ``limit`` keeps the first ones of each extraction only."""
    first = raw if limit is None else top_k(raw, extraction, [F.col(order)], limit, "_r").drop("_r")
    first = first.where(F.trim(F.coalesce("nombre", F.lit(""))) != "").withColumn("formas", name_forms(F.col("nombre"), F.col("alias")))
    return first.where(is_specific(F.col("formas"))).withColumn("nombre", F.trim("nombre")).withColumn("tipo", entity_type(F.col("tipo")))


def clean_relations(raw: DataFrame, entities: DataFrame, extraction: list[str], order: str, limit: int | None = None) -> DataFrame:
    """Relations whose two ends are forms of the extraction's own entities.  ``limit`` keeps the first ones of each extraction only."""
    r = raw if limit is None else top_k(raw, extraction, [F.col(order)], limit, "_r").drop("_r")
    forms = entities.select(*extraction, F.explode("formas").alias("_f")).distinct()
    for end in ("origen", "destino"):
        r = r.join(forms.withColumnRenamed("_f", end), [*extraction, end], "left_semi")
    return r.where(F.col("origen") != F.col("destino")).withColumn("relacion", relation_label(F.col("relacion")))


def fusion_roots(entities: DataFrame, eid: str, forms: str) -> DataFrame:
    """``eid, root``: the entity each one merges into (itself when it is new)."""
    f = entities.select(F.col(eid).alias("eid"), F.posexplode(forms).alias("fpos", "forma"))
    owner = f.groupBy("forma").agg(F.min("eid").alias("owner"))
    j = lookup(f, owner, ["forma"], ["eid"])
    earlier = F.col("owner") < F.col("eid")
    cur = j.groupBy("eid").agg(
        F.coalesce(F.min_by(F.when(earlier, F.col("owner")), F.when(earlier, F.col("fpos"))), F.first("eid")).alias("root"))
    cur = cut_lineage(cur)
    while True:
        nxt = cur.select(F.col("eid").alias("root"), F.col("root").alias("up"))
        new = cut_lineage(lookup(cur, nxt, ["root"], ["eid"]))
        moved = new.where(F.col("root") != F.col("up")).limit(1).count()
        cur = new.select("eid", F.col("up").alias("root"))
        if not moved:
            return cur


def fused(entities: DataFrame, roots: DataFrame, eid: str) -> DataFrame:
    """Entities with their root and the root's key and name; the base of every merged view."""
    heads = entities.select(F.col(eid).alias("root"), F.get("formas", F.lit(0)).alias("clave"), F.col("nombre").alias("nombre_raiz"),
                            F.col("tipo").alias("tipo_raiz"))
    e = entities.join(roots.withColumnRenamed("eid", eid), eid)
    return lookup(e, heads, ["root"], [eid])


def merged_entities(f: DataFrame, eid: str) -> DataFrame:
    """One row per merged entity; set sizes instead of unbounded lists."""
    typed = F.col("tipo") != DEFAULT_TYPE
    base = f.groupBy("root").agg(
        F.first("clave").alias("clave"), F.first("nombre_raiz").alias("nombre"),
        F.when(F.first("tipo_raiz") != DEFAULT_TYPE, F.first("tipo_raiz")).otherwise(
            F.coalesce(F.min_by(F.when(typed, F.col("tipo")), F.when(typed, F.col(eid))), F.lit(DEFAULT_TYPE))).alias("tipo"),
        F.count("*").alias("menciones"), F.count_distinct("cita").alias("citas"), F.count_distinct("origen").alias("origenes"),
        F.count_distinct(F.when(F.col("descripcion") != "", F.col("descripcion"))).alias("descripciones"))
    al = aliases(f, eid).groupBy("root").agg(F.count("*").alias("n_alias"))
    return base.join(al, "root", "left").na.fill(0, ["n_alias"])


def aliases(f: DataFrame, eid: str) -> DataFrame:
    """``root, alias, pos``: other names of each merged entity with their first position."""
    a = f.select("root", "nombre_raiz", eid, F.posexplode(F.concat(F.array("nombre"), "alias")).alias("k", "alias"))
    return a.where(F.col("alias") != F.col("nombre_raiz")).groupBy("root", "alias").agg(F.min(F.struct(eid, "k")).alias("pos"))


def merged_relations(relations: DataFrame, local: DataFrame, extraction: list[str]) -> DataFrame:
    """Relations between merged entities: ends resolved through the extraction's own forms.

    ``local`` has each extraction's forms with their ``clave``; repeated rows count once.  Where ``relations`` brings
    ``k_origen`` and ``k_destino``, a clave that ``local`` has for each end in that extraction, only ends whose form
    has several claves in the corpus are looked up: any other form has that one clave wherever it stands.
    """
    r, names = relations, local.select(*extraction, "forma", "clave").dropna()
    known = {"k_origen", "k_destino"} <= set(r.columns)
    if known:
        several = cut_lineage(names.groupBy("forma").agg(F.min("clave").alias("lo"), F.max("clave").alias("hi")).where("lo < hi").select("forma"))
        names = cut_lineage(names.join(several, "forma", "left_semi").distinct())
    else:
        names = names.distinct()
    for end in ("origen", "destino"):
        found = names.select(*extraction, F.col("forma").alias(end), F.col("clave").alias("_k"))
        r = r.join(found, [*extraction, end], "left" if known else "inner")
        r = r.withColumn(f"k_{end}", F.coalesce("_k", f"k_{end}") if known else F.col("_k")).drop("_k")
    r = r.where(F.col("k_origen") != F.col("k_destino"))
    return r.groupBy(F.col("k_origen").alias("origen"), F.col("k_destino").alias("destino"), "relacion").agg(
        F.count_distinct("cita").alias("citas"), F.count("*").alias("menciones"))
