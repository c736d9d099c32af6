"""Which items occur verbatim in which texts, without comparing every pair.

An item is found by a hash of its first inner words (all but its first and last word, which a
longer word of the text may surround), joined with the texts' word runs of the same length.
Items without an inner word are found by a hash of all their characters.  Candidates are
verified, so a hash never decides; the number of passes is the number of distinct lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import NOT_WORD, let

ANCHOR = 6


def _words(c: Column) -> Column:
    return F.array_remove(F.split(c, f"{NOT_WORD}+"), "")


def _hashed(words: Column) -> Column:
    """Words by their hashes, so that a run of words is hashed without being joined."""
    return F.transform(words, lambda x: F.xxhash64(x))


def contained_items(docs: DataFrame, key: str, text: str, items: DataFrame, ikey: str, itext: str) -> DataFrame:
    """Pairs ``ikey, key`` where the document contains the item's whole text."""
    word = _words(F.col(itext))
    own = items.where(F.length(itext) > 0).select(ikey, F.col(itext).alias("_item"), F.slice(word, F.lit(2), F.greatest(F.size(word) - 2, F.lit(0))).alias("w"))
    run = F.slice("w", F.lit(1), F.least(F.size("w"), F.lit(ANCHOR)))
    own = own.select(ikey, "_item", F.when(F.size("w") == 0, -F.length("_item")).otherwise(F.size(run)).alias("n"), _hashed(run).alias("w"))
    own = own.select(ikey, "_item", "n", F.when(F.col("n") < 0, F.xxhash64("n", "_item")).otherwise(F.xxhash64("n", *[F.get("w", F.lit(i)) for i in range(ANCHOR)])).alias("h"))
    lengths = [r["n"] for r in own.select("n").distinct().collect()]  # six word lengths, and the lengths of items of one or two words
    if not lengths:
        return docs.sparkSession.createDataFrame([], docs.select(key).schema).join(items.select(ikey), F.lit(False)).select(ikey, key)
    none = F.array().cast("array<bigint>")

    def hashes(w, n: int):
        if n > 0:
            return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)]))).otherwise(none)
        m = -n
        return F.when(F.length(text) >= m, F.transform(F.sequence(F.lit(1), F.length(text) - m + 1), lambda i: F.xxhash64(F.lit(n), F.substring(F.col(text), i, F.lit(m))))).otherwise(none)

    grams = let(_hashed(_words(F.col(text))), lambda w: F.flatten(F.array(*[F.array_distinct(hashes(w, n)) for n in lengths])))
    found = docs.where(F.col(text).isNotNull()).select(key, F.explode(grams).alias("h"))
    cand = found.join(own.select(ikey, "h"), "h").select(key, ikey).distinct()
    cand = cand.join(own.select(ikey, "_item"), ikey).join(docs.select(key, F.col(text).alias("_doc")), key)
    return cand.where(F.contains("_doc", "_item")).select(ikey, key).distinct()
