"""Sharding along a Hilbert curve, with DataFrame functions only.

Each metadata dimension is quantised to equal-depth, order-preserving codes (from value
counts and a prefix sum, so no quantile sketch can differ between runs), the codes are
folded into one Hilbert index, rows are ordered along the curve, and the curve is cut into
runs of nearly equal bytes.  Neighbouring rows share ranges in every dimension, so a filter
on any of them skips most files.

Order: curve cell, then text digest, then id; equal texts are neighbours.  No task holds a
cell: a cell is split by digest ranges and a frequent text by row number into buckets of
about ``bucket_rows`` rows, and positions come from bucket totals, cell totals and the
position within the bucket.

Defined cases: a null text has one byte (its end); null metadata counts as the empty string
or zero; an empty table gives no rows; repeated rows get one slot each; ties in every order
are broken by the row's number in the stored table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import Scratch
from docloom.plans.scale import running_sum


def curve_table(dims: int) -> list[int]:
    """Packed steps of the curve: entry ``state * 2^dims + corner`` holds ``rank << 8 | next state``.

    A state is the pair (entry corner, axis) of the sub-cube; the transitions follow from the
    reflected Gray code.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    rank_of = {gray(i): i for i in range(size)}
    entry = [0 if i == 0 else gray(2 * ((i - 1) // 2)) for i in range(size)]

    def axis(i: int) -> int:
        if i == 0:
            return 0
        i = i - 1 if i % 2 == 0 else i
        ones = 0
        while i & 1:
            ones, i = ones + 1, i >> 1
        return ones % dims

    table = []
    for state in range(size * dims):
        corner_in, d = state % size, state // size
        for corner in range(size):
            rank = rank_of[turn(corner ^ corner_in, -(d + 1))]
            nxt = corner_in ^ turn(entry[rank], d + 1)
            table.append(rank << 8 | (((d + axis(rank) + 1) % dims) * size + nxt))
    return table


def hilbert_index(codes: Sequence[Column], bits: int) -> Column:
    """Index on the curve of integer codes of ``bits`` bits each (2 to 4 dimensions)."""
    dims = len(codes)
    table = F.array(*[F.lit(v).cast("long") for v in curve_table(dims)])

    def step(acc, level):
        corner = F.lit(0).cast("long")
        for j, c in enumerate(codes):
            corner = corner + F.call_function("shiftleft", F.call_function("shiftright", c.cast("long"), level).bitwiseAND(F.lit(1).cast("long")), F.lit(j))
        state = acc.bitwiseAND(F.lit(255).cast("long"))
        at = (state * (1 << dims) + corner + 1).cast("int")
        return F.shiftleft(F.shiftright(acc, 8), 8 + dims) + F.element_at(table, at)

    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.shiftright(F.aggregate(levels, F.lit(0).cast("long"), step), 8)


def equal_depth(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """``column`` and its code: the share of rows that sort before the middle of the value, in 2^bits steps."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    if dict(rows.dtypes)[column] == "string":
        bucket = F.ascii(F.col(column)) * 65536 + F.ascii(F.substring(column, 2, 1))
    else:
        bucket = F.floor(F.log2(F.greatest(F.col(column), F.lit(1)).cast("double")) * 64)
    cum = running_sum(counts, [], [column], bucket, {"_cum": "_n"})
    total = counts.agg(F.sum("_n").alias("_all"))
    middle = F.col("_cum") - F.col("_n") / 2
    return cum.join(F.broadcast(total)).select(column, F.least(F.floor(middle * (1 << bits) / F.col("_all")), F.lit((1 << bits) - 1)).cast("int").alias(f"{column}_code"))


def curve_shards(docs: DataFrame, scratch: Scratch, shards: int = 8, bits: int = 5, bucket_rows: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and curve (the Hilbert index) of every row."""
    text = F.col("text").cast("string")
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.xxhash64(text).alias("_digest"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.monotonically_increasing_id().alias("_row"),
    )
    raw = scratch.store(raw)
    coded = raw
    for c in ("lang", "source", "size"):
        coded = coded.join(equal_depth(raw, c, bits), c)
    coded = coded.withColumn("curve", hilbert_index([F.col("lang_code"), F.col("source_code"), F.col("size_code")], bits))
    rows = scratch.store(coded.select("doc_id", "size", "text_crc32", "_digest", "_row", "curve"))

    # At most 2^(3 bits) cells, and at most rows / bucket_rows frequent texts.
    cells = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("_n"))
    often = rows.groupBy("curve", "_digest").agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > bucket_rows)
    parts = F.ceil(F.col("_n") / bucket_rows)
    by_range = F.shiftright((F.shiftright("_digest", 40) + (1 << 23)) * parts, 24)
    by_row = F.pmod(F.col("_row"), F.ceil(F.col("_copies") / bucket_rows))
    placed = (
        rows.join(F.broadcast(cells), "curve")
        .join(often, ["curve", "_digest"], "left")
        .withColumn("_often", F.when(F.col("_copies").isNotNull(), F.col("_digest")))
        .withColumn("_part", F.when(F.col("_copies").isNotNull(), by_row).otherwise(by_range))
        .select(*rows.columns, "_often", "_part")
    )
    key = ["curve", "_often", "_part"]
    inside = Window.partitionBy(*key).orderBy("_digest", "doc_id", "_row")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select(
        *placed.columns, F.row_number().over(inside).alias("_i"), F.sum("size").over(upto).alias("_b"),
    )
    placed = scratch.store(placed)

    buckets = placed.groupBy(*key).agg(F.max("_i").alias("_rows"), F.max("_b").alias("_bytes"))
    before = Window.partitionBy("curve").orderBy(F.col("_often").asc_nulls_first(), "_part").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*key, "_rows", "_bytes", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_rows", "_bytes")])
    totals = buckets.groupBy("curve").agg(F.sum("_rows").alias("_cr"), F.sum("_bytes").alias("_cb"))
    upto_cell = running_sum(totals, [], ["curve"], F.shiftright("curve", 7), {"_cum_r": "_cr", "_cum_b": "_cb"})
    starts = upto_cell.select("curve", (F.col("_cum_r") - F.col("_cr")).alias("_r0"), (F.col("_cum_b") - F.col("_cb")).alias("_b0"))
    offsets = buckets.join(starts, "curve").select(
        F.col("curve").alias("_c"), F.col("_often").alias("_o"), F.col("_part").alias("_p"),
        (F.col("_rows_before") + F.col("_r0")).alias("_r0"), (F.col("_bytes_before") + F.col("_b0")).alias("_b0"),
    )
    everything = totals.agg(F.sum("_cb").alias("_all"))
    same = F.col("curve").eqNullSafe(F.col("_c")) & F.col("_often").eqNullSafe(F.col("_o")) & F.col("_part").eqNullSafe(F.col("_p"))
    at = placed.join(offsets, same).join(F.broadcast(everything)).select(
        "doc_id", "size", "text_crc32", "curve",
        (F.col("_r0") + F.col("_i") - 1).alias("_rank"), "_all",
        (2 * (F.col("_b0") + F.col("_b")) - F.col("size")).alias("_mid2"),
    )
    cut = scratch.store(at.withColumn("shard", F.least(F.floor(F.col("_mid2") * shards / (2 * F.col("_all"))), F.lit(shards - 1)).cast("int")).drop("_mid2", "_all"))
    first = cut.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"), "curve")
