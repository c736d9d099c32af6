"""Exact Jaccard join of word shingles with PartEnum signatures, and the components of its links.

Signatures.  Sets are grouped into size bands.  Inside a band, linked sets differ in at most
k elements, so the hashed feature domain is cut into parts.  Small bands: of k + 2 parts at least
two are equal, and a signature is the content of one of all subsets of two.  Larger bands have
k + 1 + spare parts; at least 1 + spare of them are equal, and each set leaves out the ``spare``
poorest ones, by number of elements, content and place.  That order is the same for equal parts in both
sets, so the richest equal part has ``spare`` equal ones before it and neither set leaves it out: linked
sets share at least one signature, and no signature rests on an empty part while there are richer ones.
A set near the upper end of its band signs for the next one too.  No link is lost and no
signature, bucket or partner is capped.

Pairs are never listed.  Equal sets become one node first.  Nodes that share a bucket are held against
each other by a parity sketch, whose distance never exceeds the difference of two sets, and
those that may be linked form families.  First every node meets the smallest node of its buckets, once
for all buckets the two share; where all nodes of a bucket pass they are one family, and only buckets in
which some do not are gathered and looked at node by node (a task returns a forest, not the pairs).  A family is
compared inside tasks, in pairs of blocks of bounded size, by counting common elements exactly;
a task returns one row per node: how many documents it is linked to, and the smallest node it
is connected with.  The components of those rows are the components of all links.

Sets hold 64-bit hashes of shingles; two different shingles of one compared pair fall together
with a chance of about 2^-64 per pair of elements.

Defined cases: a null text, or one without words, has an empty set and no link; fewer words
than a shingle has are one shingle; equal rows are linked with each other; rows without id take part
and are never a component's id unless it has none; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import Scratch, arrow_map

BAND = 1.5
BLOCK_NODES, BLOCK_ELEMENTS = 1024, 2_000_000
WORD_CACHE = 400_000
SMALL_K, SPARE_PERCENT = 3, 35
SKETCH_BITS, MOST_SKETCH_BITS = 128, 1 << 15
BROADCAST_ROWS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text (A-Z in lower case)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, size * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for j in range(size):
        total = _mix(total + h[j : len(h) - size + 1 + j])
    return np.unique(total)


@dataclass(frozen=True)
class Band:
    """Sizes low..high, the differences k inside it, its parts, how many are left out, and the size of a subset."""

    number: int
    low: int
    high: int
    k: int
    parts: int
    spare: int
    subset: int


@lru_cache(maxsize=None)
def band(number: int, percent: int) -> Band:
    low = 1 if number == 0 else band(number - 1, percent).high + 1
    high = int(low * BAND)
    k = 2 * high * (100 - percent) // (100 + percent)
    spare = 0 if k <= SMALL_K else -(-(k + 1) * SPARE_PERCENT // 100)
    return Band(number, low, high, k, k + 2 if k <= SMALL_K else k + 1 + spare, spare, 2 if k <= SMALL_K else 1)


def bands_of(size: int, percent: int) -> list[Band]:
    """The band of a size, and the next one if a linked set can be that large."""
    number = 0
    while band(number, percent).high < size:
        number += 1
    own = band(number, percent)
    return [own, band(number + 1, percent)] if size * 100 // percent > own.high else [own]


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a non-empty set; none where only equal sets can be linked."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(s ^ np.uint64(0xD1B54A32D192ED03)), dtype=np.uint64)))
    out = []
    for b in bands_of(len(s), percent):
        if b.k == 0:
            continue
        cuts = np.array([(i << 64) // b.parts for i in range(1, b.parts)], np.uint64)
        at = np.concatenate(([0], np.searchsorted(s, cuts), [len(s)]))
        content = sums[at[1:]] - sums[at[:-1]]
        if b.subset == 1:
            chosen = np.lexsort((content, at[1:] - at[:-1]))[b.spare :]  # stable: of equals the earlier place comes first
            out.append(_mix((chosen.astype(np.uint64) + np.uint64(b.number << 40)) * np.uint64(0x9E3779B97F4A7C15) + content[chosen]))
        else:
            for i, (u, v) in enumerate(itertools.combinations(range(b.parts), 2)):
                sig = np.array([(b.number << 40) + (i << 32)], np.uint64)
                for part in (u, v):
                    sig = _mix(sig * np.uint64(0x9E3779B97F4A7C15) + content[part])
                out.append(sig)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each hash cell; larger sets have more cells, up to a bound."""
    bits = SKETCH_BITS
    while bits < len(s) and bits < MOST_SKETCH_BITS:
        bits *= 2
    cell = (_mix(s ^ np.uint64(0xA24BAED4963EE407)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(bool)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, the longer ones folded to the shortest length."""
    least = min(map(len, sketches)) // 8
    rows = []
    for raw in sketches:
        x = np.frombuffer(raw, np.uint64)
        while len(x) > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows.append(x)
    return np.stack(rows)


def sign(docs: DataFrame, percent: int, length: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (digest of the set; null if empty), sketch and sigs of every row.

    A task gives the signatures and the sketch of equal sets once.
    """

    def run(pieces):
        import xxhash

        seen: set[int] = set()
        for p in pieces:
            made = {"n_shingles": [], "node": [], "sketch": [], "sigs": []}
            for text in p.pop("text"):
                s = shingles(text, length)
                node = int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None
                new = node is not None and node not in seen
                made["n_shingles"].append(len(s))
                made["node"].append(node)
                made["sketch"].append(sketch(s) if new else None)
                made["sigs"].append(signatures(s, percent) if new else [])
                if len(seen) >= WORD_CACHE:
                    seen.clear()
                if new:
                    seen.add(node)
            yield {**p, **made}
        _WORDS.clear()  # the worker may serve another stage next

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    return arrow_map(rows, run, "doc_id long, text_key binary, n_shingles long, node long, sketch binary, sigs array<long>")


def in_blocks(df: DataFrame, key: str, blocks) -> DataFrame:
    """Rows of a large group split into blocks; block i meets every block j once, as side 0 where i <= j and as side 1 otherwise."""
    placed = df.withColumn("_blocks", blocks.cast("int")).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    both = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rest = [c for c in df.columns if c != key]
    return both.select(key, F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), *rest)


def may_link(na, nb, far, percent: int):
    """Whether sets of these sizes whose difference is at least ``far`` can be linked."""
    return far * (100 + percent) <= (na + nb) * (100 - percent)


def forests(groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of the nodes that may be linked, for each group (bucket, i, j)."""

    def edges(node, n, side, bits):
        cut = int((side == 0).sum())
        left, right = (np.arange(cut), np.arange(cut, len(node))) if cut < len(node) else (np.arange(cut), np.arange(cut))
        hit = np.zeros((len(node), len(node)), bool)
        for begin in range(0, len(left), 16):
            some = left[begin : begin + 16]
            far = np.bitwise_count(bits[some][:, None] ^ bits[right][None]).sum(2, dtype=np.int64)
            hit[np.ix_(some, right)] = may_link(n[some][:, None], n[right][None], far, percent)
        root = roots(hit | hit.T)
        other = np.flatnonzero(node[root] != node)
        return node[root[other]], node[other]

    def rows_of(pieces):
        for p in pieces:
            yield from zip(p["bucket"], p["i"], p["j"], p["node"], p["n"], p["side"], p["sketch"], strict=True)

    def run(pieces):
        a, b = [], []
        for _, group in itertools.groupby(rows_of(pieces), key=lambda r: r[:3]):  # neighbours: the rows are sorted by group
            *_, node, n, side, bits = zip(*group, strict=True)
            u, v = edges(np.array(node), np.array(n), np.array(side), folded(list(bits)))
            a.append(u)
            b.append(v)
            if len(a) >= 5000:
                yield {"a": np.concatenate(a), "b": np.concatenate(b)}
                a, b = [], []
        if a:
            yield {"a": np.concatenate(a), "b": np.concatenate(b)}

    return arrow_map(groups, run, "a long, b long", rows=2_000)


def apart(pairs: DataFrame, percent: int) -> DataFrame:
    """first, node, near: whether the sketches of two nodes (na, nb, sa, sb) leave room for a link."""

    def run(pieces):
        for p in pieces:
            far = np.array([np.bitwise_count(np.bitwise_xor(*folded([a, b]))).sum(dtype=np.int64) for a, b in zip(p["sa"], p["sb"], strict=True)], np.int64)
            near = may_link(np.array(p["na"], np.int64), np.array(p["nb"], np.int64), far, percent)
            yield {"first": p["first"], "node": p["node"], "near": near.astype(bool).tolist()}

    return arrow_map(pairs, run, "first long, node long, near boolean", rows=2_000)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``edges`` (a, b), by label spreading and pointer doubling."""
    both = scratch.store(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = scratch.store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        after = scratch.store(near.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")))
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return labels


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets: dense for frequent elements, by lists for the others."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    (le, lo), (re, ro) = sides
    shared = np.intersect1d(np.unique(le), np.unique(re), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(shared):
        return out

    def keep(e, o):
        at = np.minimum(np.searchsorted(shared, e), len(shared) - 1)
        ok = shared[at] == e
        return at[ok], o[ok]

    (lc, lo), (rc, ro) = keep(le, lo), keep(re, ro)
    ln, rn = np.bincount(lc, minlength=len(shared)), np.bincount(rc, minlength=len(shared))
    heavy = ln.astype(np.int64) * rn > 64
    cols = np.flatnonzero(heavy)
    place = np.full(len(shared), -1)
    for begin in range(0, len(cols), 4096):
        some = cols[begin : begin + 4096]
        place[:] = -1
        place[some] = np.arange(len(some))
        a, b = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
        for m, c, o in ((a, lc, lo), (b, rc, ro)):
            ok = place[c] >= 0
            m[o[ok], place[c[ok]]] = 1
        out += np.rint(a @ b.T).astype(np.int64)
    ok = ~heavy[lc]
    lc, lo = lc[ok], lo[ok]
    order = np.argsort(rc, kind="stable")
    rc, ro = rc[order], ro[order]
    first = np.searchsorted(rc, lc, "left")
    n = np.searchsorted(rc, lc, "right") - first
    if n.sum():
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(lo, n) * len(right) + ro[at], minlength=out.size).reshape(out.shape)
    return out


def roots(link: np.ndarray) -> np.ndarray:
    """For a square symmetric matrix of links, the first member that each one is connected with."""
    root = np.arange(len(link))
    left = np.ones(len(link), bool)
    for i in range(len(link)):
        if left[i]:
            left[i] = False
            queue = [i]
            while queue:
                j = queue.pop()
                root[j] = i
                new = np.flatnonzero(link[j] & left)
                left[new] = False
                queue.extend(new.tolist())
    return root


def compare(table: pa.Table, percent: int) -> pa.Table:
    """One pair of blocks of one family (or one block with itself): node, root, links."""
    side = table["side"].to_numpy()
    node = table["node"].to_numpy()
    copies = table["copies"].to_numpy().astype(np.int64)
    sets = [np.frombuffer(b, "<u8") for b in table["elements"].to_pylist()]
    order = np.lexsort((node, side))
    order = order[np.concatenate(([True], np.diff(node[order]) != 0))[: len(order)]]  # a node that several tasks have read
    node, copies, side, sets = node[order], copies[order], side[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    cut = int((side == 0).sum())
    alone = table["i"][0] == table["j"][0]
    if not alone and cut in (0, len(node)):  # a block without members
        return pa.table({"node": node, "root": node, "links": np.zeros(len(node), np.int64)})
    left, right = (slice(0, cut), slice(0, cut)) if alone else (slice(0, cut), slice(cut, None))
    inter = common(sets[left], sets[right])
    union = size[left][:, None] + size[right][None] - inter
    hit = 100 * inter >= percent * union
    if alone:
        np.fill_diagonal(hit, False)
        links = hit @ copies
        square = hit
    else:
        links = np.concatenate((hit @ copies[right], hit.T @ copies[left]))
        square = np.zeros((len(node), len(node)), bool)
        square[:cut, cut:] = hit
        square[cut:, :cut] = hit.T
    return pa.table({"node": node, "root": node[roots(square)], "links": links.astype(np.int64)})


def jaccard_links(docs: DataFrame, scratch: Scratch, percent: int = 90, length: int = 3) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, n_links, keeper of every row; shingles of ``length`` words.

    ``keeper`` marks the rows whose (doc_id, text) comes first in their component (rows equal in both are all
    marked); documents with an empty set are keepers of their own.
    """
    early = Scratch(docs.sparkSession)  # signatures are most of the volume and go as soon as shared ones are known
    signed = early.store(sign(docs, percent, length))
    rows = scratch.store(signed.drop("sigs"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    nodes = scratch.store(nodes)

    bucket = Window.partitionBy("sig")
    signed = signed.where(F.size("sigs") > 0).select("node", F.explode("sigs").alias("sig"))
    # Buckets with the same nodes need one look: they are told apart by count, ends and sum of node hashes.
    same = F.xxhash64("_m", "_a", "_z", "_s").alias("bucket")
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 40))
    shared = signed.select(
        "node", F.min("node").over(bucket).alias("_a"), F.max("node").over(bucket).alias("_z"),
        F.count(F.lit(1)).over(bucket).alias("_m"), F.sum(spread).over(bucket).alias("_s"),
    )
    shared = scratch.store(shared.where("_a <> _z").select(same, "node", F.col("_a").alias("first"), "_m").distinct())
    early.drop()
    side = lambda name, n, bits: nodes.select(F.col("node").alias(name), F.col("n").alias(n), F.col("sketch").alias(bits))
    stars = shared.where("node <> first").select("first", "node").distinct().join(side("node", "nb", "sb"), "node").join(side("first", "na", "sa"), "first")
    stars = scratch.store(apart(stars, percent))
    doubtful = shared.where("_m > 2").join(stars.where("not near").select("first", "node"), ["first", "node"], "left_semi").select("bucket").distinct()
    rest = shared.join(doubtful, "bucket", "left_semi").join(nodes.select("node", "n", "sketch"), "node")
    met = in_blocks(rest.drop("first"), "bucket", F.ceil(F.col("_m") / BLOCK_NODES)).drop("_m")
    key = ["bucket", "i", "j"]
    met = forests(met.repartition(*key).sortWithinPartitions(*key, "side", "node"), percent)
    chains = scratch.store(met.unionByName(stars.where("near").select(F.col("first").alias("a"), F.col("node").alias("b"))).distinct())
    families = components(chains, scratch)
    members = scratch.store(families.join(nodes, "node").select("node", F.col("root").alias("family"), "copies", "n", F.col("first.text_key").alias("text_key")))

    def elements(pieces):
        seen: set[int] = set()
        for p in pieces:
            text, at = p.pop("text"), [i for i, node in enumerate(p["node"]) if node not in seen and not seen.add(node)]
            if len(seen) > WORD_CACHE:
                seen.clear()
            yield {**{k: [v[i] for i in at] for k, v in p.items()}, "elements": [shingles(text[i], length).tobytes() for i in at]}
        _WORDS.clear()

    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_NODES, F.col("e") / BLOCK_ELEMENTS))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("e"))
    wanted = scratch.store(members.join(sizes, "family").select("text_key", "family", "node", "copies", blocks.alias("blocks")))
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    picked = docs.select(F.unhex(F.md5(text)).alias("text_key"), text.alias("text")).join(wanted, "text_key").drop("text_key")
    sets = arrow_map(picked, elements, "family long, node long, copies long, blocks long, elements binary")
    groups = in_blocks(sets, "family", F.col("blocks")).drop("blocks")
    compared = scratch.store(groups.groupBy("family", "i", "j").applyInArrow(lambda t: compare(t, percent), "node long, root long, links long"))

    linked = components(compared.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")), scratch)
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(linked, "node", "left").join(links, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    known = scratch.store(known)
    tops = known.groupBy("root").agg(F.min("first").alias("top"))
    answer = scratch.store(known.join(tops, "root").select("node", F.col("top.doc_id").alias("component_id"), F.col("top.text_key").alias("top_key"), "n_links"))
    alone = F.col("node").isNull()
    return rows.join(answer, "node", "left").select(
        "doc_id", "text_key", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("top_key")))).alias("keeper"),
    )
