"""Graphs as edge tables: references, reachability, cycles, weights, neighbours, communities."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docloom.plans.scale import lookup, previous_value
from docloom.session import cut_lineage

# How one section refers to another.
REFERENCE = r"(?i)(?<![\p{L}\p{N}_])(Parte|Tarea|Pregunta|Ejercicio|Problema)\s+(\d+)(?![\p{L}\p{N}_])"
PREVIOUS = r"(?i)(?<![\p{L}\p{N}_])(?:la|el)\s+(?:parte|pregunta|tarea|ejercicio|punto|literal)\s+anterior(?![\p{L}\p{N}_])"
ANAPHORA = (
    r"(?i)(?<![\p{L}\p{N}_])(?:(?:los|las)\s+(?:dos|tres|mismos|mismas)|ambos|ambas)\s+"
    r"(?:modelos?|clasificadores?|m[eé]todos?|algoritmos?|consultas?|datos|juicios|"
    r"distribuci[oó]n(?:es)?|m[eé]tricas?|par[aá]metros|redes|estimadores)(?![\p{L}\p{N}_])"
)
PREAMBLE = "Preámbulo"
RADIUS = 60
MIN_COMMUNITY = 3
SECTION_BUCKET = 4096


def _around(text: Column, at: Column) -> Column:
    """Squeezed text within 60 characters of a position (1-based)."""
    from docloom.functions.text import squeeze

    start = F.greatest(at - RADIUS, F.lit(1))
    return squeeze(F.substring(text, start, at - start + RADIUS))


def reference_edges(sections: DataFrame, doc: str) -> DataFrame:
    """``doc, src, dst, regla, evidencia`` from ``doc, sec_no, clave, trabajo, texto``.

    One edge per pair: explicit references first, "the previous part" overwrites
    them, anaphora only fills a gap.
    """
    s = previous_value(sections, [doc], "sec_no", F.floor(F.col("sec_no") / SECTION_BUCKET),
                       F.when(F.col("trabajo"), F.col("clave")), "previa")
    s = s.where(F.col("clave") != PREAMBLE)
    hits = F.regexp_extract_all("texto", F.lit(REFERENCE), F.lit(0))
    r = s.select(doc, F.col("clave").alias("src"), "texto", F.posexplode(hits).alias("n", "hit"))
    # The n-th match starts after n earlier ones: cut the text at each match by splitting.
    pieces = F.split(F.col("texto"), REFERENCE)
    before = F.aggregate(F.slice(pieces, F.lit(1), F.col("n") + 1), F.lit(0), lambda a, p: (a + F.length(p)).cast("int"))
    taken = F.aggregate(F.slice(F.regexp_extract_all("texto", F.lit(REFERENCE), F.lit(0)), F.lit(1), F.col("n")), F.lit(0),
                        lambda a, p: (a + F.length(p)).cast("int"))
    word = F.regexp_extract("hit", REFERENCE, 1)
    r = r.select(doc, "src", "n",
                 F.concat(F.initcap(word), F.lit(" "), F.regexp_extract("hit", REFERENCE, 2)).alias("dst"),
                 _around(F.col("texto"), before + taken + 1).alias("evidencia"))
    known = sections.select(doc, F.col("clave").alias("dst")).distinct()
    r = r.where(F.col("dst") != F.col("src")).join(known, [doc, "dst"], "left_semi")
    explicit = r.groupBy(doc, "src", "dst").agg(F.max_by("evidencia", "n").alias("evidencia")).withColumn("prio", F.lit(1)).withColumn(
        "regla", F.lit("referencia"))
    linked = s.where(F.col("previa").isNotNull())

    def rule(pattern: str, name: str, prio: int, only: Column) -> DataFrame:
        at = F.regexp_instr("texto", F.lit(pattern))
        first = F.length(F.get(F.split(F.col("texto"), pattern, 2), F.lit(0))) + 1
        return linked.where(only & (at > 0)).select(
            doc, F.col("clave").alias("src"), F.col("previa").alias("dst"), _around(F.col("texto"), first).alias("evidencia"),
            F.lit(prio).alias("prio"), F.lit(name).alias("regla"))

    every = explicit.select(doc, "src", "dst", "evidencia", "prio", "regla").unionByName(
        rule(PREVIOUS, "anterior", 2, F.lit(True))).unionByName(rule(ANAPHORA, "anafora", 0, F.col("trabajo")))
    return every.groupBy(doc, "src", "dst").agg(F.max(F.struct("prio", "regla", "evidencia")).alias("e")).select(
        doc, "src", "dst", "e.regla", "e.evidencia")


def reach(edges: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes reachable from the seeds of each graph, seeds left out: ``*keys, node``.

    A breadth-first frontier: the output is at most one row per node, each round writes only
    the nodes it reaches for the first time, and the number of rounds is the depth of the graph.
    """
    start = cut_lineage(seeds.select(*keys, "node").distinct())
    edges = cut_lineage(edges.select(*keys, "src", "dst"))
    frontier, seen, found = start, start, start.limit(0)
    while True:
        step = edges.join(frontier.withColumnRenamed("node", "src"), [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
        new = cut_lineage(step.join(seen, [*keys, "node"], "left_anti"))
        if new.isEmpty():
            return found
        seen, found, frontier = seen.unionByName(new), found.unionByName(new), new


def follow(chain: DataFrame, keys: list[str], flag: str | None = None, steps: int | None = None) -> DataFrame:
    """Pointer doubling where every node has at most one dependency.

    Input ``*keys, node, dep[, flag]``; output ``*keys, node, dep, hit``: ``hit``
    tells whether any node further along carries the flag, ``dep`` is NULL once a
    path has ended and a node on a cycle when it never does.  Rounds grow with the
    logarithm of the path length, so one very long chain is no obstacle.
    """
    own = F.col(flag) if flag else F.lit(False)
    base = chain.select(*keys, "node", "dep", own.alias("own"))
    d = base.select(*keys, F.col("node").alias("dep"), F.col("own").alias("h"))
    cur = cut_lineage(base.join(d, [*keys, "dep"], "left").select(*keys, "node", "dep", F.coalesce("h", F.lit(False)).alias("hit")))
    limit = steps if steps is not None else max(1, int(chain.count()).bit_length() + 1)
    for _ in range(limit):
        nxt = cur.select(*keys, F.col("node").alias("dep"), F.col("dep").alias("up"), F.col("hit").alias("h"))
        cur = cut_lineage(cur.join(nxt, [*keys, "dep"], "left").select(
            *keys, "node", F.col("up").alias("dep"), (F.col("hit") | F.coalesce("h", F.lit(False))).alias("hit")))
        if not cur.where(F.col("dep").isNotNull()).limit(1).count():
            break
    return cur


def propagate_failures(tasks: DataFrame, deps: DataFrame, keys: list[str]) -> DataFrame:
    """``status`` of each subtask: conceptual ones pass, a failed ancestor omits the rest.

    ``tasks``: ``*keys, node, tipo, failed``; ``deps``: ``*keys, node, dep``, any number per node.
    Failure spreads as a frontier; each round writes only the nodes it reaches for the first time.
    """
    calc = F.col("tipo") == "calculo"
    own = tasks.where(calc).select(*keys, "node")
    edges = cut_lineage(deps.select(*keys, "node", "dep").distinct().join(own, [*keys, "node"], "left_semi"))
    hit = None
    frontier = cut_lineage(tasks.where(calc & F.col("failed")).select(*keys, "node"))
    while not frontier.isEmpty():
        below = edges.join(frontier.withColumnRenamed("node", "dep"), [*keys, "dep"], "left_semi").select(*keys, "node").distinct()
        frontier = cut_lineage(below if hit is None else below.join(hit, [*keys, "node"], "left_anti"))
        hit = frontier if hit is None else hit.unionByName(frontier)
    omitted = own.limit(0) if hit is None else hit
    t = tasks.join(omitted.withColumn("hit", F.lit(True)), [*keys, "node"], "left")
    return t.withColumn("status", F.when(~calc, "aprobada").when(F.col("hit"), "omitida").when(F.col("failed"), "fallida").otherwise("aprobada")).drop("hit")


def cycle_nodes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, node`` of every node that lies on a cycle of ``*keys, node, dep``.

    Nodes without a way in or out are taken off until none is left; what stays lies on cycles or
    between them, and only for that rest are paths followed.
    """
    rest = cut_lineage(edges.select(*keys, "node", "dep").distinct())
    size = rest.count()
    while size:
        kept = rest.join(rest.select(*keys, F.col("node").alias("dep")).distinct(), [*keys, "dep"], "left_semi")
        kept = cut_lineage(kept.join(rest.select(*keys, F.col("dep").alias("node")).distinct(), [*keys, "node"], "left_semi").select(*keys, "node", "dep"))
        left = kept.count()
        rest, size, done = kept, left, left == size
        if done:
            break
    paths, size = rest, size
    while size:
        far = paths.join(paths.select(*keys, F.col("node").alias("dep"), F.col("dep").alias("up")), [*keys, "dep"]).select(*keys, "node", F.col("up").alias("dep"))
        paths = cut_lineage(paths.unionByName(far).distinct())
        now = paths.count()
        if now == size:
            break
        size = now
    return paths.where(F.col("node") == F.col("dep")).select(*keys, "node")


@F.pandas_udf(ArrayType(StringType()))
def lexical_order(ids: pd.Series, deps: pd.Series) -> pd.Series:
    """Topological order of one plan, smallest id (as text) first among the ready ones."""

    def one(names, needs):
        waiting = {n: {d for d in ds if d in set(names)} for n, ds in zip(names, needs)}
        ready = [n for n, ds in waiting.items() if not ds]
        heapq.heapify(ready)
        order = []
        while ready:
            n = heapq.heappop(ready)
            order.append(n)
            for m, ds in waiting.items():
                if n in ds:
                    ds.discard(n)
                    if not ds:
                        heapq.heappush(ready, m)
        return order

    return pd.Series([one(list(a), [list(x) for x in b]) for a, b in zip(ids, deps)])


PAIR_TERMS = 4096  # names that a task counts pairs of at a time, in one square table


def _pair_counts(batches):
    """``a, b, w`` with a < b: in how many rows two names stand together, counted in a square table over the names met so far.

    When the names pass ``PAIR_TERMS`` the table is given out and begun anew; a row of more names is counted by itself, line by line.
    """
    import pyarrow as pa

    place: dict[str, int] = {}
    table = np.zeros((PAIR_TERMS, PAIR_TERMS), np.int32)

    def given(names, low, high, w):
        return pa.RecordBatch.from_arrays([names.take(pa.array(low)), names.take(pa.array(high)), pa.array(w, pa.int64())], names=["a", "b", "w"])

    def counted():
        names, n = list(place), len(place)
        rank = np.argsort(np.argsort(np.array(names, object)))
        held = pa.array(sorted(names), pa.string())
        for at in range(0, n, 64):
            i, j = np.nonzero(np.triu(table[at : min(at + 64, n), :n], at + 1))
            if len(i):
                x, y = rank[i + at], rank[j]
                yield given(held, np.minimum(x, y), np.maximum(x, y), table[i + at, j])
        place.clear()
        table[:n, :n] = 0

    for batch in batches:
        for m in batch.column(0).to_pylist():
            if len(m) < 2:
                continue
            if len(m) > PAIR_TERMS:
                held = pa.array(sorted(m), pa.string())
                for i in range(len(m) - 1):
                    yield given(held, np.full(len(m) - i - 1, i), np.arange(i + 1, len(m)), np.ones(len(m) - i - 1, np.int64))
                continue
            if len(place) + sum(t not in place for t in m) > PAIR_TERMS:
                yield from counted()
            at = np.array([place.setdefault(t, len(place)) for t in m])
            table[at[:, None], at] += 1  # names of a row are distinct
    yield from counted()


def pair_weights(groups: DataFrame, members: str, relations: DataFrame | None = None) -> DataFrame:
    """Undirected weights ``a < b, w``: one per shared group plus two per citation of a relation.

    ``members`` is the array of names found in one chunk.  A task counts the pairs of its chunks in numpy and gives each
    pair out once per table it filled; the sums are Spark's.
    """
    m = groups.select(F.array_compact(F.array_distinct(F.col(members))).alias("m"))
    p = m.mapInArrow(_pair_counts, "a string, b string, w long")
    if relations is not None:
        p = p.unionByName(relations.select(
            F.least("origen", "destino").alias("a"), F.greatest("origen", "destino").alias("b"), (F.col("citas") * 2).cast("bigint").alias("w")))
    return p.groupBy("a", "b").agg(F.sum("w").cast("bigint").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w")
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Non-seed nodes one hop from any seed (``node``), with the summed weight."""
    e = both_ways(edges).join(seeds.select(F.col("node").alias("u")), "u", "left_semi")
    return e.select(F.col("v").alias("node"), "w").join(seeds.select("node"), "node", "left_anti").groupBy("node").agg(F.sum("w").alias("w"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "a"), "a", "left_semi").join(n.withColumnRenamed("node", "b"), "b", "left_semi")


def inherit_community(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Unlabelled nodes take the most frequent label among labelled neighbours; smallest on ties."""
    e = lookup(both_ways(edges), labels.select(F.col("node").alias("v"), "label"), ["v"], ["u"])
    votes = e.groupBy("u", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("u").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.max("n").alias("votos"))
    return best.withColumnRenamed("u", "node").join(labels.select("node"), "node", "left_anti")


def modularity(edges: DataFrame, comm: DataFrame) -> float:
    """Weighted modularity of a partition ``node, c``."""
    e = edges.join(comm.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(
        comm.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    row = e.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w"))).alias("inside")).first()
    deg = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")).join(comm, "node")
    whole = F.col("t").cast("decimal(19,0)")  # squares of weights pass 64 bits
    tot = deg.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(whole * whole).alias("s")).first()
    m = float(row["m"])
    return float(row["inside"] or 0) / m - float(tot["s"]) / (4 * m * m)


def _move(edges: DataFrame, tolerance: float) -> DataFrame:
    """Local moving: each round half of the nodes (by hash) take the neighbour community of best gain.

    Ends when neither half moves, or when eight rounds raise the modularity by less than ``tolerance``.
    """
    e = cut_lineage(both_ways(edges))
    loops = e.where(F.col("u") == F.col("v"))
    k = cut_lineage(e.groupBy("u").agg(F.sum("w").alias("k")))
    two_m = float(k.agg(F.sum("k")).first()[0])
    comm = k.select(F.col("u").alias("node"), F.col("u").alias("c"))
    walk = e.where(F.col("u") != F.col("v")) if loops.limit(1).count() else e
    hubs = walk.groupBy("v").agg(F.count("*").alias("_n"))
    from docloom.plans.scale import hot_keys, salted_lookup

    hot = cut_lineage(hot_keys(hubs, ["v"], "_n"))
    quiet, reached = 0, -1.0
    for r in itertools.count():
        near = salted_lookup(walk, comm.select(F.col("node").alias("v"), "c"), ["v"], hot, ["u"])
        near = near.groupBy("u", "c").agg(F.sum("w").alias("w"))
        kc = k.join(comm.withColumnRenamed("node", "u"), "u")
        tot = kc.groupBy("c").agg(F.sum("k").alias("t"))
        own = kc.select("u", F.col("c").alias("own"), "k")
        cand = near.unionByName(own.select("u", F.col("own").alias("c"), F.lit(0).cast("bigint").alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
        cand = cand.join(tot, "c").join(own, "u")
        rest = F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)
        gain = F.round(F.col("w") - F.col("k").cast("double") * rest / F.lit(two_m), 9)
        best = cand.groupBy("u").agg(
            F.max_by("c", F.struct(gain, F.col("c") == F.col("own"), -F.xxhash64("c"))).alias("to"), F.first("own").alias("own"))
        turn = F.pmod(F.xxhash64("u", F.lit(r)), F.lit(2)) == 0
        new = cut_lineage(best.select(F.col("u").alias("node"), F.when(turn, F.col("to")).otherwise(F.col("own")).alias("c"),
                                      (turn & (F.col("to") != F.col("own"))).alias("moved")))
        comm = new.select("node", "c")
        quiet = 0 if new.where("moved").limit(1).count() else quiet + 1
        if quiet == 2:
            return comm
        if r % 8 == 7:
            now = modularity(edges, comm)
            if now - reached < tolerance:
                return comm
            reached = now


def communities(edges: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Modularity communities ``node, c``: local moving, then moving of the merged graph until that gains nothing."""
    comm = _move(edges, tolerance)
    reached = modularity(edges, comm)
    while True:
        merged = edges.join(comm.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(
            comm.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
        merged = merged.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").cast("bigint").alias("w"))
        up = _move(cut_lineage(merged), tolerance)
        better = cut_lineage(lookup(comm, up.select(F.col("node").alias("c"), F.col("c").alias("c2")), ["c"], ["node"]).select(
            "node", F.col("c2").alias("c")))
        now = modularity(edges, better)
        if now - reached < tolerance:
            return comm
        comm, reached = better, now


def ranked_communities(comm: DataFrame) -> DataFrame:
    """``id, c, size, first``: communities of at least three members, largest first, then by first member."""
    g = comm.groupBy("c").agg(F.count("*").alias("size"), F.min("node").alias("first")).where(F.col("size") >= MIN_COMMUNITY)
    return g.orderBy(F.col("size").desc(), "first")
