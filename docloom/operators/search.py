"""Graph-guided search over a stored index, for any number of subtasks in one plan, and the context of communities.

The index is tables: entities, their relations, the chunks they stand in, and their communities,
each with the vector that similarities are taken from.  Every step is a join on (subtask, key); nothing is looped
over subtasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.vectors import dot
from docloom.operators import retrieval as rt
from docloom.plans.scale import lookup, salted_lookup, top_k
from docloom.session import cut_lineage

MAX_ANCHOR_CHUNKS = 4  # an entity found in more chunks anchors nothing
SEEDS, NEIGHBOURS, FRAGMENTS, RELATIONS, GROUPS = 6, 6, 3, 15, 2
MARGIN = 0.05
ENTITY_CITES, RELATION_CITES = 3, 2


def first_cites(cites: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``*keys, citas``: the k smallest distinct ``cita`` of each key, joined by "; "; a hub's list is never gathered."""
    few = top_k(cites.select(*keys, "cita").distinct(), keys, [F.col("cita")], k)
    return few.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("cita")), "; ").alias("citas"))


def anchors(mentions: DataFrame, deps: DataFrame, located: DataFrame, most: int = MAX_ANCHOR_CHUNKS) -> DataFrame:
    """``q, node`` that tie a subtask to the notes: mentioned by its own section or one it depends on, and found in 1 to ``most`` chunks.

    ``mentions``: ``q, node`` by section; ``deps``: ``q, dep``; ``located``: ``node, chunk``.
    """
    rare = located.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).select("node")
    there = mentions.join(rare, "node", "left_semi")
    from_deps = deps.join(there.withColumnRenamed("q", "dep"), "dep").select("q", "node")
    return there.select("q", "node").unionByName(from_deps).distinct()


def _similar(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """``q, key, s`` of the given pairs."""
    near = lookup(pairs, vectors.select(key, "v"), [key], ["q"])
    both = lookup(near, queries.select("q", F.col("v").alias("_q")), ["q"], [key])
    return both.select("q", key, F.round(dot(F.col("v"), F.col("_q")), rt.DIGITS).alias("s"))


def _best(df: DataFrame, key: str, k: int) -> DataFrame:
    return top_k(df, ["q"], [F.col("s").desc(), F.col(key)], k).drop("rank")


def local_search(queries: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame, deps: DataFrame, located: DataFrame,
                 chunks: DataFrame, groups: DataFrame, members: DataFrame, cites: DataFrame, relation_cites: DataFrame) -> DataFrame:
    """What each subtask is given: ``q, clase, pos, id, valor, citas``.

    ``queries``: ``q, v``; ``entities``: ``n, node, v`` (n a number per entity); ``relations``: ``origen, destino``;
    ``chunks``: ``chunk, v``; ``groups``: ``c, v``; ``members``: ``node, c``; ``cites``: ``node, cita``;
    ``relation_cites``: ``origen, destino, cita``; the rest as in :func:`anchors`.

    Seeds are the most similar of the mentioned entities and the most similar of all; neighbours stand in a
    relation with a seed.  Chunks and communities are only reached through anchors, chunks no further than
    ``MARGIN`` from the best one.  Every row carries its citations.
    """
    queries, entities = cut_lineage(queries), cut_lineage(entities)
    relations, mentions = cut_lineage(relations.select("origen", "destino").distinct()), cut_lineage(mentions.select("q", "node").distinct())
    located = cut_lineage(located.select("node", "chunk").distinct())

    everywhere = rt.dense_topk(entities, "n", "v", queries, "q", "v", SEEDS).select("q", "n", F.col("score").alias("s"))
    everywhere = everywhere.join(entities.select("n", "node"), "n").select("q", "node", "s")
    seeds = cut_lineage(_best(_similar(mentions, queries, entities, "node"), "node", SEEDS).unionByName(everywhere).distinct())

    step = lambda near, far: lookup(seeds.select("q", F.col("node").alias(near)), _adjacent(relations, near, far), [near], ["q"]).select("q", F.explode("_far").alias("node"))
    around = step("origen", "destino").unionByName(step("destino", "origen")).distinct().join(seeds.select("q", "node"), ["q", "node"], "left_anti")
    near = cut_lineage(_best(_similar(around, queries, entities, "node"), "node", NEIGHBOURS))

    chosen = seeds.select("q", "node").unionByName(near.select("q", "node"))
    inside = chosen.join(_adjacent(relations, "origen", "destino").withColumnRenamed("origen", "node"), "node").select("q", F.col("node").alias("origen"), F.explode("_far").alias("destino"))
    inside = inside.join(chosen.withColumnRenamed("node", "destino"), ["q", "destino"], "left_semi")
    inside = top_k(inside, ["q"], [F.col("origen"), F.col("destino")], RELATIONS, "pos")

    tied = cut_lineage(anchors(mentions, deps, located))
    found = tied.join(located, "node").select("q", "chunk").distinct()  # at most MAX_ANCHOR_CHUNKS per anchor
    passages = rt.within_margin(_best(_similar(found, queries, chunks, "chunk"), "chunk", FRAGMENTS).withColumnRenamed("s", "score"), "q", MARGIN).withColumnRenamed("score", "s")
    homes = tied.join(members, "node").select("q", "c").distinct()
    summaries = _best(_similar(homes, queries, groups, "c"), "c", GROUPS)

    of_node, of_pair = first_cites(cites, ["node"], ENTITY_CITES), first_cites(relation_cites, ["origen", "destino"], RELATION_CITES)

    def ranked(df: DataFrame, clase: str, key: str) -> DataFrame:
        placed = top_k(df, ["q"], [F.col("s").desc(), F.col(key)], 2 * SEEDS, "pos")
        return placed.select("q", F.lit(clase).alias("clase"), F.col("pos").cast("bigint").alias("pos"), F.col(key).alias("id"), F.round("s", 6).alias("valor"))

    def cited(df: DataFrame) -> DataFrame:
        return df.join(of_node.withColumnRenamed("node", "id"), "id", "left").withColumn("citas", F.coalesce("citas", F.lit("")))

    columns = ["q", "clase", "pos", "id", "valor", "citas"]
    rows = cited(ranked(seeds, "semilla", "node")).select(*columns)
    rows = rows.unionByName(cited(ranked(near, "vecino", "node")).select(*columns))
    rows = rows.unionByName(inside.join(of_pair, ["origen", "destino"], "left").select(
        "q", F.lit("relacion").alias("clase"), F.col("pos").cast("bigint").alias("pos"), F.concat_ws("→", "origen", "destino").alias("id"), F.lit(None).cast("double").alias("valor"), F.coalesce("citas", F.lit("")).alias("citas")))
    none = F.lit(None).cast("double").alias("valor")
    rows = rows.unionByName(cited(tied.select("q", F.lit("ancla").alias("clase"), F.lit(None).cast("bigint").alias("pos"), F.col("node").alias("id"), none)).select(*columns))
    rows = rows.unionByName(ranked(passages, "fragmento", "chunk").withColumn("citas", F.col("id")))
    return rows.unionByName(ranked(summaries, "comunidad", "c").withColumn("citas", F.concat(F.lit("comunidad "), "id")))


def _adjacent(relations: DataFrame, near: str, far: str, slot: int = 1024) -> DataFrame:
    """``near, _far``: the other ends of an entity's relations; a hub's are kept in rows of about ``slot``."""
    parts = relations.groupBy(near).agg(F.ceil(F.count(F.lit(1)) / slot).alias("_p"))
    r = relations.join(parts, near)
    r = r.groupBy(near, F.pmod(F.xxhash64(far), F.col("_p")).alias("_i")).agg(F.collect_list(far).alias("_far"))
    return r.drop("_i")


# ------------------------------------------------------------------ communities
def community_context(members: DataFrame, relations: DataFrame, cites: DataFrame, entities: int = 25, pairs: int = 20, least: int = 3) -> DataFrame:
    """What a community's summary is written from: ``c, clase, pos, texto``.

    The first ``entities`` members by name, the first ``pairs`` relations whose two ends both belong to it, and the
    sorted distinct citations of those members.  Citation places are running counts over buckets of names, so neither
    the list of a hub nor that of a large community is ever gathered in one row or sorted in one task.
    """
    sizes = members.groupBy("c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("c")
    members = cut_lineage(members.join(sizes, "c", "left_semi"))
    top = cut_lineage(top_k(members, ["c"], [F.col("node")], entities, "pos"))
    rel = lookup(relations.select("origen", "destino").distinct(), members.select(F.col("node").alias("origen"), "c"), ["origen"], ["destino"])
    rel = lookup(rel, members.select(F.col("node").alias("destino"), F.col("c").alias("_d")), ["destino"], ["origen"]).where(F.col("c") == F.col("_d"))
    rel = top_k(rel, ["c"], [F.col("origen"), F.col("destino")], pairs, "pos")
    told = cites.join(top.select("node"), "node", "left_semi").select("node", "cita")
    own = lookup(told, top.select("node", "c"), ["node"], ["cita"]).select("c", "cita").distinct()
    placed = ranks_of(own, ["c"], "cita")
    place = F.col("pos").cast("bigint").alias("pos")
    return (top.select("c", F.lit("miembro").alias("clase"), place, F.col("node").alias("texto"))
            .unionByName(rel.select("c", F.lit("relacion").alias("clase"), place, F.concat_ws(" → ", "origen", "destino").alias("texto")))
            .unionByName(placed.select("c", F.lit("cita").alias("clase"), place, F.col("cita").alias("texto"))))


def ranks_of(df: DataFrame, keys: list[str], value: str, name: str = "pos") -> DataFrame:
    """The place of each distinct ``value`` among its key's, from 1: rows are dealt by ranges of (key, value), counted inside
    each range, and ranges before it are added; no key is sorted in one task."""
    dealt = cut_lineage(df.repartitionByRange(*[F.col(c) for c in (*keys, value)]).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range at most
    offsets = sizes.select(*keys, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(value))
    return dealt.withColumn("_i", inside).join(offsets, [*keys, "_p"]).withColumn(name, F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


# ------------------------------------------------------------------ certificate
def connected_parts(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """``node, c`` with every community cut into its connected parts, each named by its smallest member."""
    inner = edges.join(comm.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(comm.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    inner = inner.where((F.col("ca") == F.col("cb")) & (F.col("a") != F.col("b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    inner = cut_lineage(inner.unionByName(inner.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    at = cut_lineage(comm.select("node", F.col("node").alias("c")))
    while True:
        heard = inner.join(at.select(F.col("node").alias("v"), F.col("c").alias("h")), "v").groupBy("u").agg(F.min("h").alias("h"))
        low = at.join(heard.withColumnRenamed("u", "node"), "node", "left").select("node", F.col("c").alias("old"), F.least("c", F.coalesce("h", "c")).alias("c"))
        # follow the pointer once more: labels are members too
        far = low.select(F.col("node").alias("c"), F.col("c").alias("up"))
        new = cut_lineage(low.join(far, "c", "left").select("node", "old", F.least("c", F.coalesce("up", "c")).alias("c")))
        at = new.select("node", "c")
        if new.where("c <> old").isEmpty():
            return at


class Moves:
    """Best moves in one graph: what does not change from round to round is stored once."""

    def __init__(self, edges: DataFrame):
        from docloom.operators.graph import both_ways
        from docloom.plans.scale import hot_keys

        both = cut_lineage(both_ways(edges))
        self.degree = cut_lineage(both.groupBy("u").agg(F.sum("w").alias("k")))
        self.two_m = int(self.degree.agg(F.sum("k")).first()[0] or 0)
        self.walk = cut_lineage(both.where(F.col("u") != F.col("v")))
        self.hot = cut_lineage(hot_keys(self.walk.groupBy("v").agg(F.count(F.lit(1)).alias("_n")), ["v"], "_n"))

    def best(self, comm: DataFrame) -> DataFrame:
        """``node, own, to, gain``: each node's best move to a neighbour's community that raises the modularity.

        Gains are exact whole numbers, in units of 1 / (2 m^2) of modularity, m the sum of all weights.
        """
        kc = self.degree.join(comm.withColumnRenamed("node", "u"), "u")
        tot = kc.groupBy("c").agg(F.sum("k").alias("t"))
        near = salted_lookup(self.walk, comm.select(F.col("node").alias("v"), "c"), ["v"], self.hot, ["u"]).groupBy("u", "c").agg(F.sum("w").alias("w"))
        # every node may also stay, with no edge into its community
        near = near.unionByName(kc.select("u", "c", F.lit(0).cast("bigint").alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
        near = near.join(tot, "c").join(kc.select("u", F.col("c").alias("own"), "k"), "u")
        whole = lambda c: c.cast("decimal(38,0)")
        worth = whole(F.lit(self.two_m)) * whole(F.col("w")) - whole(F.col("k")) * whole(F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0))
        best = near.withColumn("g", worth).groupBy("u").agg(
            F.max_by(F.struct("c", "g"), F.struct("g", -F.xxhash64("c"))).alias("b"), F.max(F.when(F.col("c") == F.col("own"), F.col("g"))).alias("stay"), F.first("own").alias("own"))
        best = best.withColumn("gain", F.col("b.g") - F.col("stay"))
        return best.where((F.col("b.c") != F.col("own")) & (F.col("gain") > 0)).select(F.col("u").alias("node"), "own", F.col("b.c").alias("to"), "gain")


def settled(edges: DataFrame, comm: DataFrame, quick: int = 60) -> DataFrame:
    """``node, c`` where every community is connected and no single move raises the modularity.

    First half of the nodes (by hash) may move at a time.  After ``quick`` such rounds only moves that are the best one of both
    communities they touch are made: their gains add up, so the modularity rises strictly and the rounds end.
    """
    edges, r = cut_lineage(edges), 0
    graph = Moves(edges)
    comm = connected_parts(edges, comm)
    while True:
        moves = cut_lineage(graph.best(comm))
        if moves.isEmpty():
            parts = connected_parts(edges, comm)
            if parts.select("c").distinct().count() == comm.select("c").distinct().count():
                return comm
            comm = parts  # cutting a community without inner edges between its parts raises the modularity
            continue
        if r < quick:
            taken = moves.where(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0)
        else:
            order = F.struct("gain", -F.xxhash64("node"), "node")
            sides = moves.select(F.col("own").alias("c"), order.alias("o")).unionByName(moves.select(F.col("to").alias("c"), order.alias("o")))
            first = sides.groupBy("c").agg(F.max("o").alias("o")).select("c", F.col("o.node").alias("node"))
            taken = moves.join(first.withColumnRenamed("c", "own"), ["own", "node"], "left_semi").join(first.withColumnRenamed("c", "to"), ["to", "node"], "left_semi")
        comm = cut_lineage(comm.join(taken.select("node", "to"), "node", "left").select("node", F.coalesce("to", "c").alias("c")))
        r += 1


def certificate(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """One row: nodes, edges and weight of the graph; whether every node has one community, each community is connected,
    its modularity from community sums equals that from all edges, and no single move raises it."""
    from docloom.operators.graph import both_ways, modularity

    edges, comm = cut_lineage(edges), cut_lineage(comm)
    nodes = both_ways(edges).select(F.col("u").alias("node")).distinct()
    shape = edges.agg(F.count(F.lit(1)).alias("aristas"), F.sum("w").cast("bigint").alias("peso"))
    covered = nodes.join(comm, "node", "left").agg(
        F.count_distinct("node").alias("nodos"), ((F.count(F.lit(1)) == F.count_distinct("node")) & (F.count("c") == F.count(F.lit(1)))).alias("cubiertos"))
    parts = connected_parts(edges, comm).select("c").distinct().count() == comm.select("c").distinct().count()
    spread = both_ways(edges).join(comm.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(comm.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v")
    sums = spread.groupBy("cu").agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0)).alias("inside"), F.sum("w").alias("t"))
    two_m = F.sum("t").cast("double")
    by_sums = float(sums.agg((F.sum("inside") / two_m - F.sum(F.col("t").cast("double") * F.col("t")) / two_m / two_m).alias("q")).first()["q"] or 0.0)
    same = abs(by_sums - modularity(edges, comm)) < 1e-9
    still = Moves(edges).best(comm).isEmpty()
    flag = lambda b, n: F.lit(bool(b)).alias(n)
    return covered.join(shape).select("nodos", "aristas", "peso", "cubiertos", flag(parts, "conexas"), flag(same, "modularidad_coincide"), flag(still, "sin_mejora"))


def leaders(edges: DataFrame) -> DataFrame:
    """``node, c``: nodes that share their strongest neighbour, smallest name on ties; one pass and the same in any order."""
    from docloom.operators.graph import both_ways

    return both_ways(edges).groupBy("u").agg(F.min_by("v", F.struct(-F.col("w"), F.col("v"))).alias("c")).select(F.col("u").alias("node"), "c")


def hashed(key: Column, n: Column) -> Column:
    """A number from 0 to n - 1 by the key's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), n)
