"""Nearest neighbours by largest inner product: multiprobe p-stable hashing, exact reranking.

Inner products become distances by one more coordinate: x -> (x / M, sqrt(1 - |x|^2 / M^2)) with M the
largest norm, q -> (q / |q|, 0); the nearest point is then the one with the largest product.
Each of TABLES tables hashes a point to floor((a.x + b) / WIDTH) for PROJECTIONS random
directions.  A query visits its own bucket and PROBES - 1 perturbed ones per table, in the
order of their estimated chance of holding a near point: perturbations are ranked by the
expected squared distance to the boundary they cross, and each query maps these ranks to its
own boundaries.  The tables' candidates are merged and scored on the original vectors in
double precision.  Where the tables give fewer than k candidates, the block is scored whole.

Equal vectors are searched once: a class keeps its k + 1 smallest ids, which is all that an
answer can hold of it.  Points lie in blocks of BLOCK rows, queries in chunks of CHUNK; a task
gets one block and one chunk, so its memory is bounded, and every point is indexed.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take
no part, nor do rows without id; repeated rows count once; vectors of different lengths never
meet; fewer than k candidates are all returned; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import Scratch

TABLES, PROJECTIONS, WIDTH, PROBES = 24, 10, 1.9, 220
BLOCK, CHUNK = 16_384, 20_000


def probe_order(m: int, count: int) -> np.ndarray:
    """Perturbation sets (rows) over boundary ranks 0 .. 2m-1 (columns), likeliest first; the first is empty.

    Rank j and rank 2m-1-j are the two sides of one projection and never go together.
    """
    near = [(j * (j + 1)) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    far = [1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
    cost = near + far
    sets: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(sets) < count:
        _, s = heapq.heappop(heap)
        if not any(2 * m - 1 - j in s for j in s):
            sets.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            for t in (s[:-1] + (last + 1,), s + (last + 1,)):
                heapq.heappush(heap, (sum(cost[j] for j in t), t))
    out = np.zeros((len(sets), 2 * m), np.int64)
    for i, s in enumerate(sets):
        out[i, list(s)] = 1
    return out


class Index:
    """Hash tables over the points of one block."""

    def __init__(self, points: np.ndarray, largest: float):
        n, d = points.shape
        rng = np.random.default_rng(20)
        self.size, self.points = n, points
        scaled = points / largest
        lifted = np.concatenate((scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1)))[:, None]), 1)
        self.tables = []
        for _ in range(TABLES):
            direction = rng.standard_normal((d + 1, PROJECTIONS))
            shift = rng.random(PROJECTIONS) * WIDTH
            mix = rng.integers(1, 1 << 62, PROJECTIONS) | 1
            keys = (np.floor((lifted @ direction + shift) / WIDTH).astype(np.int64) * mix).sum(1)
            order = np.argsort(keys, kind="stable")
            self.tables.append((direction, shift, mix, keys[order], order))
        self.probes = probe_order(PROJECTIONS, PROBES)

    def candidates(self, queries: np.ndarray) -> list[np.ndarray]:
        """Positions that any probed bucket of any table holds, for each query."""
        unit = queries / np.linalg.norm(queries, axis=1)[:, None]
        seen = np.zeros((len(queries), self.size), bool)
        for direction, shift, mix, keys, order in self.tables:
            at = (unit @ direction[:-1] + shift) / WIDTH
            cell = np.floor(at)
            below = at - cell
            rank = np.argsort(np.concatenate((below, 1.0 - below), 1), 1, kind="stable")
            step = mix[rank % PROJECTIONS] * np.where(rank < PROJECTIONS, -1, 1)
            probe = (cell.astype(np.int64) * mix).sum(1)[:, None] + step @ self.probes.T
            first, last = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
            for i in range(len(queries)):
                n = last[i] - first[i]
                own = np.flatnonzero(n)
                n = n[own]
                runs = np.repeat(first[i][own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(own) else own
                seen[i, order[runs]] = True
        return [np.flatnonzero(row) for row in seen]


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, largest: float, k: int):
    """For each query the k best (positions, scores) that the index finds in one block."""
    index = Index(points, largest)
    for begin in range(0, len(queries), 256):
        part = queries[begin : begin + 256]
        for q, found in zip(part, index.candidates(part), strict=True):
            if len(found) < min(k, len(points)):
                found = np.arange(len(points))
            score = points[found] @ q
            if len(found) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                keep = score >= least
                found, score = found[keep], score[keep]
            best = np.lexsort((ids[found], -score))[:k]
            yield found[best], score[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(vectors: DataFrame, scratch: Scratch, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id ``every`` divides."""
    vec = F.col("embedding").cast("array<double>")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vec, lambda x: x + 0.0).alias("vec"))
        .where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .withColumn("norm", F.sqrt(square))
        .where(F.col("norm") > 0)
        .distinct()
    )
    rows = scratch.store(rows)
    first = Window.partitionBy("vec").orderBy("vec_id")
    ranked = rows.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1)
    classes = scratch.store(ranked.groupBy("vec").agg(F.min("vec_id").alias("cid"), F.max("norm").alias("norm"), F.sort_array(F.collect_list("vec_id")).alias("members")))
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("m")).first()
    blocks = max(1, math.ceil(stats["n"] / BLOCK))
    largest = float(stats["m"] or 1.0) * (1 + 1e-12)

    asked = rows.where(F.col("vec_id") % every == 0)
    query_classes = scratch.store(asked.select("vec").distinct().join(classes.select("vec", "cid"), "vec"))
    chunks = max(1, math.ceil(query_classes.count() / CHUNK))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    points = classes.select("cid", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("block"), every_chunk.alias("chunk"))
    queries = query_classes.select("cid", "vec", F.size("vec").alias("dim"), every_block.alias("block"), F.pmod(F.xxhash64("cid"), F.lit(chunks)).cast("int").alias("chunk"))

    def one_block(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        made: dict[str, list] = {"query": [], "cid": [], "score": []}
        if left.num_rows and right.num_rows:
            ids, asking = left["cid"].to_numpy(), right["cid"].to_numpy()
            for q, (at, score) in zip(asking, search(_matrix(left["vec"]), ids, _matrix(right["vec"]), largest, k + 1), strict=True):
                made["query"].append(np.full(len(at), q))
                made["cid"].append(ids[at])
                made["score"].append(score)
        kinds = {"query": pa.int64(), "cid": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array(np.concatenate(v) if v else [], kinds[n]) for n, v in made.items()})

    key = ["dim", "block", "chunk"]
    found = points.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(one_block, "query long, cid long, score double")
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    best = found.withColumn("i", F.row_number().over(by_class)).where(F.col("i") <= k + 1)
    members = best.join(classes.select("cid", "members"), "cid").select("query", "score", F.explode("members").alias("vec_id"))
    by_member = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    short = members.withColumn("i", F.row_number().over(by_member)).where(F.col("i") <= k + 1).drop("i")
    owners = asked.select(F.col("vec_id").alias("query_id"), "vec").join(query_classes, "vec").select("query_id", F.col("cid").alias("query")).distinct()
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        owners.join(short, "query").where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
