"""Registered plans over the stored index: search for many subtasks at once, contexts of communities, and their certificate.

The index is derived from the tables: forms of the benchmark items are entities, the items are subtasks and their sections,
chunks of documents are the notes.  Vectors are rows of ``embeddings``, picked by a hash of what they stand for.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import graph as gr
from docloom.operators import search as se
from docloom.plans import graph_plans as gp
from docloom.session import cut_lineage, table


def _vectors(spark, sf, keys, key, tag):
    """``key, v``: the stored vector of each key."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("_n"))
    return keys.join(n).withColumn("vec_id", se.hashed(F.concat(F.lit(tag), F.col(key).cast("string")), F.col("_n"))).join(e, "vec_id").drop("vec_id", "_n")


def _chunk_id():
    return F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk").cast("string"))


def _cites(mentions, located):
    item = F.concat(F.lit("enunciado § "), F.col("q").cast("string"))
    return mentions.select("node", item.alias("cita")).unionByName(located.select("node", F.col("chunk").alias("cita")))


def _located(found):
    return found.select(F.explode("m").alias("node"), _chunk_id().alias("chunk"))


def _mentioned(spark, sf):
    return gp._forms(spark, sf).select(F.col("item_id").alias("q"), F.explode("m").alias("node"))


def local_search_subtasks(spark, sf):
    """Seeds, neighbours, relations, anchors, chunks and communities of every benchmark item, each row with its citations.

    Every third item also depends on the section before it.
    """
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("q"))
    held = cut_lineage(gp._mentions(spark, sf))
    mentions, located = cut_lineage(_mentioned(spark, sf)), _located(held)
    deps = b.where((F.col("q") % 3 == 0) & (F.col("q") > 0)).select("q", (F.col("q") - 1).alias("dep"))
    nodes = se.ranks_of(mentions.select("node").distinct(), [], "node", "n").withColumn("n", F.col("n").cast("bigint"))
    pairs = gp._forms(spark, sf)
    rest = F.greatest(F.size("m") - 1, F.lit(0))
    steps = F.zip_with(F.slice("m", F.lit(1), rest), F.slice("m", F.lit(2), rest), lambda a, c: F.struct(a.alias("origen"), c.alias("destino")))
    rel = pairs.select(F.concat(F.lit("enunciado § "), F.col("item_id").cast("string")).alias("cita"), F.explode(steps).alias("p")).select("p.*", "cita")
    chunks = gp._pieces(spark, sf).select(_chunk_id().alias("chunk"))
    members = cut_lineage(se.leaders(gp._edges(spark, sf, held)))
    found = se.local_search(
        _vectors(spark, sf, b, "q", "q"), _vectors(spark, sf, nodes, "node", "e"), rel, mentions, deps, located,
        _vectors(spark, sf, chunks, "chunk", "c"), _vectors(spark, sf, members.select("c").distinct(), "c", "g"), members, _cites(mentions, located), rel)
    return found.withColumnRenamed("q", "item_id")


def community_context(spark, sf):
    """Members, inner relations and citations of each community of a stored partition (nodes with one strongest neighbour)."""
    held = cut_lineage(gp._mentions(spark, sf))
    members = cut_lineage(se.leaders(gp._edges(spark, sf, held)))
    mentions, located = _mentioned(spark, sf), _located(held)
    return se.community_context(members, gp._term_relations(spark, sf), _cites(mentions, located))


def community_certificate(spark, sf):
    """The modularity communities after refinement, checked: covered, connected, modularity as reported, no move left that gains."""
    e = cut_lineage(gp._edges(spark, sf))
    return se.certificate(e, se.settled(e, gr.communities(e)))


QUERIES = {f.__name__: f for f in (local_search_subtasks, community_context, community_certificate)}

_VEC = lambda tag, key: f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = ('0x' || substr(md5('{tag}' || {key}::VARCHAR), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings))"
_IDX = f"""{gp._EDG}, men AS (SELECT item_id AS q, t AS node FROM lb), loc AS (SELECT t AS node, doc_id::VARCHAR || '#' || c::VARCHAR AS chunk FROM ld),
 cit AS (SELECT node, 'enunciado § ' || q::VARCHAR AS cita FROM men UNION SELECT node, chunk FROM loc),
 ldr AS (SELECT u AS node, arg_min(v, (-w, v)) AS c FROM bw GROUP BY u)"""
_TOP = lambda part, order, k, frm: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS r FROM {frm}) WHERE r <= {k})"
_NEAR = "s DESC, node"

ORACLES = {
    "local_search_subtasks": f"""WITH RECURSIVE {_IDX}, qs AS (SELECT item_id AS q, {_VEC('q', 'item_id')} AS v FROM benchmark), en AS (SELECT t AS node, {_VEC('e', 't')} AS v FROM (SELECT DISTINCT t FROM lb)),
        si AS (SELECT q, node, round(list_dot_product(en.v, qs.v), 9) AS s FROM en, qs),
        sd AS (SELECT q, node, s FROM {_TOP('q', _NEAR, 6, '(SELECT si.* FROM si JOIN men USING (q, node))')} UNION SELECT q, node, s FROM {_TOP('q', _NEAR, 6, 'si')}),
        ar AS (SELECT sd.q, destino AS node FROM sd JOIN rl ON origen = node UNION SELECT sd.q, origen FROM sd JOIN rl ON destino = node),
        ne AS (SELECT q, node, s FROM {_TOP('q', _NEAR, 6, '(SELECT si.* FROM si JOIN ar USING (q, node) ANTI JOIN sd USING (q, node))')}),
        sl AS (SELECT q, node FROM sd UNION SELECT q, node FROM ne),
        ri AS {_TOP('q', 'origen, destino', 15, '(SELECT a.q, origen, destino FROM rl JOIN sl a ON a.node = origen JOIN sl b ON b.q = a.q AND b.node = destino)')},
        rare AS (SELECT node FROM loc GROUP BY node HAVING count(*) <= 4), mr AS (SELECT q, node FROM men SEMI JOIN rare USING (node)),
        an AS (SELECT q, node FROM mr UNION SELECT b.item_id, node FROM benchmark b JOIN mr ON b.item_id % 3 = 0 AND b.item_id > 0 AND mr.q = b.item_id - 1),
        cv AS (SELECT doc_id::VARCHAR || '#' || c::VARCHAR AS chunk, {_VEC('c', "doc_id::VARCHAR || '#' || c::VARCHAR")} AS v FROM ck),
        cs AS (SELECT DISTINCT an.q, chunk, round(list_dot_product(cv.v, qs.v), 9) AS s FROM an JOIN loc USING (node) JOIN cv USING (chunk) JOIN qs ON qs.q = an.q),
        ct AS (SELECT q, chunk, s, max(s) OVER (PARTITION BY q) AS b FROM {_TOP('q', 's DESC, chunk', 3, 'cs')}),
        gs AS (SELECT DISTINCT an.q, c, round(list_dot_product({_VEC('g', 'c')}, qs.v), 9) AS s FROM an JOIN ldr USING (node) JOIN qs ON qs.q = an.q),
        c3 AS (SELECT node, string_agg(cita, '; ' ORDER BY cita) AS citas FROM {_TOP('node', 'cita', 3, 'cit')} GROUP BY node),
        r2 AS (SELECT origen, destino, string_agg(cita, '; ' ORDER BY cita) AS citas FROM {_TOP('origen, destino', 'cita', 2, "(SELECT DISTINCT x.t AS origen, y.t AS destino, 'enunciado § ' || x.item_id::VARCHAR AS cita FROM lb x JOIN lb y ON x.item_id = y.item_id AND y.r = x.r + 1)")} GROUP BY ALL)
        SELECT q AS item_id, 'semilla' AS clase, row_number() OVER (PARTITION BY q ORDER BY s DESC, node) AS pos, node AS id, round(s, 6) AS valor, coalesce(citas, '') AS citas FROM sd LEFT JOIN c3 USING (node)
        UNION ALL SELECT q, 'vecino', row_number() OVER (PARTITION BY q ORDER BY s DESC, node), node, round(s, 6), coalesce(citas, '') FROM ne LEFT JOIN c3 USING (node)
        UNION ALL SELECT q, 'relacion', r, origen || '→' || destino, NULL, coalesce(citas, '') FROM ri LEFT JOIN r2 USING (origen, destino)
        UNION ALL SELECT q, 'ancla', NULL, node, NULL, coalesce(citas, '') FROM an LEFT JOIN c3 USING (node)
        UNION ALL SELECT q, 'fragmento', row_number() OVER (PARTITION BY q ORDER BY s DESC, chunk), chunk, round(s, 6), chunk FROM ct WHERE s >= round(b - 0.05, 9)
        UNION ALL SELECT q, 'comunidad', r, c, round(s, 6), 'comunidad ' || c FROM {_TOP('q', 's DESC, c', 2, 'gs')}""",
    "community_context": f"""WITH RECURSIVE {_IDX}, sz AS (SELECT c FROM ldr GROUP BY c HAVING count(*) >= 3), mb AS (SELECT node, c FROM ldr SEMI JOIN sz USING (c)), tm AS {_TOP('c', 'node', 25, 'mb')},
        ir AS {_TOP('c', 'origen, destino', 20, '(SELECT a.c, origen, destino FROM rl JOIN mb a ON a.node = origen JOIN mb b ON b.node = destino AND a.c = b.c)')}
        SELECT c, 'miembro' AS clase, r AS pos, node AS texto FROM tm UNION ALL SELECT c, 'relacion', r, origen || ' → ' || destino FROM ir
        UNION ALL SELECT c, 'cita', row_number() OVER (PARTITION BY c ORDER BY cita), cita FROM (SELECT DISTINCT c, cita FROM tm JOIN cit USING (node))""",
    "community_certificate": f"WITH RECURSIVE {gp._EDG} SELECT (SELECT count(DISTINCT u) FROM bw) AS nodos, count(*) AS aristas, sum(w)::BIGINT AS peso, TRUE AS cubiertos, TRUE AS conexas, TRUE AS modularidad_coincide, TRUE AS sin_mejora FROM ed",
}
