"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every ``window`` consecutive k-grams of words a text keeps the one with the least hash.
Two texts that share ``gram + window - 1`` words in a row share a kept hash, whatever stands
around them, so joining kept hashes misses no span of ten words.  Texts with a hit are then
extended: all their ten-word windows meet the items' windows as strings, so a hash never
decides a result.

Items of fewer than ten words are one window of their own length; those few lengths are
looked for at every position.

Only kept hashes and hits are shuffled, never the texts.  The items' table is broadcast up
to ``BROADCAST_ROWS`` rows (counted first) and joined by shuffle beyond.

Defined cases: null texts have no words; a benchmark row without words has no window; an
item without id makes words hit but is not listed; repeated rows get equal results; an
empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import let
from docloom.llm.base import Scratch, ascii_lower

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
BROADCAST_ROWS = 1_000_000
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and non-ASCII characters of the lower-cased text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN_WORDS), "")


def _positions(n: Column) -> Column:
    """1 to n, or no position at all."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def gram_hashes(h: Column, k: int) -> Column:
    """Hash of every k words in a row, from the words' hashes."""
    return F.transform(_positions(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(k)]))


def fingerprints(h: Column) -> Column:
    """Distinct least hashes of all windows of a text with at least ten words, from the words' hashes."""

    def least(g):
        return F.transform(_positions(F.size(g) - (WINDOW - 1)), lambda i: F.least(*[F.get(g, i + (j - 1)) for j in range(WINDOW)]))

    return let(gram_hashes(h, GRAM), lambda g: F.array_distinct(least(g)))


def grams(w: Column, length: Column | int) -> Column:
    """Every run of ``length`` words as (position, length, text)."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.transform(_positions(F.size(w) - n + 1), lambda i: F.struct(i.alias("at"), n.cast("int").alias("len"), F.array_join(F.slice(w, i, n), " ").alias("gram")))


def small(df: DataFrame) -> DataFrame:
    """Broadcast if a count shows that the table is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key (md5) and n_words of every row; text_key, n_hit, n_items and items (sorted ids, comma-joined) of every distinct text with a hit."""
    items = scratch.store(benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0))
    short = [r["n"] for r in items.where(F.size("w") < SPAN).select(F.size("w").alias("n")).distinct().collect()]  # nine lengths at most
    length = F.least(F.size("w"), F.lit(SPAN))
    windows = scratch.store(items.select("item", F.explode(grams(F.col("w"), length)).alias("g")).select("item", "g.len", "g.gram").distinct())

    def kept(w: Column) -> Column:
        def both(h: Column) -> Column:
            own = F.when(F.size(h) >= SPAN, fingerprints(h)).otherwise(F.array().cast("array<bigint>"))
            return F.array_union(own, F.array_distinct(F.flatten(F.array(*[gram_hashes(h, n) for n in short])))) if short else own

        return let(word_hashes(w), both)

    # The hash of an array is that of its elements in order, as gram_hashes takes them.
    item_kept = let(word_hashes(F.col("w")), lambda h: F.when(F.size(h) >= SPAN, fingerprints(h)).otherwise(F.array(F.xxhash64(h))))
    keys = small(scratch.store(items.select(F.explode(item_kept).alias("hash")).distinct()))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one_pass = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_key"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), kept(w).alias("kept"))).alias("w"),
    )
    rows = scratch.store(one_pass.select("doc_id", "text_key", "w.n_words", "w.kept"))
    marked = rows.select("text_key", F.explode("kept").alias("hash"))
    suspects = scratch.store(marked.join(keys, "hash", "left_semi").select("text_key").distinct())

    keyed = docs.select(text.alias("text"), F.md5(text).alias("text_key"))
    lengths = [SPAN, *short]
    every = let(words(F.col("text")), lambda w: F.flatten(F.array(*[grams(w, n) for n in lengths])))
    runs = keyed.join(suspects, "text_key", "left_semi").select("text_key", F.explode(every).alias("g")).select("text_key", "g.at", "g.len", "g.gram")
    found = small(windows.select("len", "gram").distinct())
    hits = scratch.store(runs.join(found, ["len", "gram"]).distinct())
    span = F.sort_array(F.collect_set(F.struct("at", "len")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc, s):
        end = s["at"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["at"]))).cast("long").alias("n"))

    covered = hits.groupBy("text_key").agg(span.alias("s")).select("text_key", F.aggregate("s", start, cover)["n"].alias("n_hit"))
    listed = (
        hits.select("text_key", "len", "gram").distinct().join(windows.where(F.col("item").isNotNull()), ["len", "gram"])
        .groupBy("text_key").agg(F.sort_array(F.collect_set("item")).alias("i"))
        .select("text_key", F.size("i").cast("long").alias("n_items"), F.array_join("i", ",").alias("items"))
    )
    return rows.drop("kept"), scratch.store(covered.join(listed, "text_key", "left"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated of every row."""
    rows, found = contamination(docs, benchmark, scratch)
    zero = F.lit(0).cast("long")
    return rows.join(found, "text_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


WINNOW_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS l
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)
), dg AS (
  SELECT rid, p, l, array_to_string(w[p : p + l - 1], ' ') AS g
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)
), h AS (
  SELECT DISTINCT rid, p, dg.l, item_id FROM dg JOIN iw ON dg.g = iw.g AND dg.l = iw.l
), hit AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + l)) AS q FROM h) GROUP BY rid
), it AS (
  SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
