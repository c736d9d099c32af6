"""Vector expressions and the hashed character n-gram embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

DIMENSIONS = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def unit(a: Column) -> Column:
    """L2-normalise; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.transform(a, lambda v: v.cast("double") / safe)


def char_grams(low: int = 3, high: int = 4):
    """Word-bounded character n-grams of a folded text column, as an array column."""

    def build(c: Column) -> Column:
        from docloom.functions.text import strip_accents, words

        padded = F.transform(words(strip_accents(F.lower(c))), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

        def grams(w: Column) -> Column:
            def runs(n: int) -> Column:
                return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))

            parts = []
            for n in range(low, high + 1):
                full = runs(n)
                parts.append(F.when(F.length(w) >= n, full).otherwise(
                    F.array(w) if n == low else F.array().cast("array<string>")))
            return F.concat(*parts)

        return F.flatten(F.transform(padded, grams))

    return build


def hash_grams(cells: pd.Series) -> pd.Series:
    """Unit-norm counts of the cells that n-grams were hashed to."""
    sizes = np.array([len(g) for g in cells], dtype=np.int64)
    out = np.zeros((len(cells), DIMENSIONS), dtype=np.float64)
    if sizes.sum():
        np.add.at(out, (np.repeat(np.arange(len(cells)), sizes), np.concatenate(cells.to_list())), 1.0)
    norm = np.sqrt((out**2).sum(axis=1))
    out /= np.where(norm == 0, 1.0, norm)[:, None]
    return pd.Series(list(out.astype(np.float32)))


def embedding_with_events(df: DataFrame, keys: list[str], text: str, path: str) -> tuple[DataFrame, DataFrame]:
    """``(vectors, events)`` of one pass: ``*keys, embedding``, and a row per batch with its texts, width and seconds.

    Both kinds of rows leave the same task and are stored together under ``path``, told apart by a partition folder, so the
    events describe exactly the vectors that are there and nothing runs twice.
    """
    import time

    def embed(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                part, began = b.iloc[at : at + 512], time.perf_counter()
                made = part[keys].assign(embedding=hash_grams(part["_g"]).to_numpy(), clase="vector", textos=None, dimension=None, latencia_s=None)
                yield made
                none = {k: [None] for k in (*keys, "embedding")}
                yield pd.DataFrame({**none, "clase": ["evento"], "textos": [len(part)], "dimension": [DIMENSIONS], "latencia_s": [time.perf_counter() - began]})

    kept = df.select(*keys, F.transform(char_grams()(F.col(text)), lambda g: F.pmod(F.hash(g), F.lit(DIMENSIONS))).alias("_g"))
    fields = StructType([StructField(f.name, f.dataType) for f in kept.schema.fields if f.name in keys])
    schema = fields.add("embedding", ArrayType(FloatType())).add("clase", StringType()).add("textos", LongType()).add("dimension", IntegerType()).add("latencia_s", DoubleType())
    kept.mapInPandas(embed, schema).write.partitionBy("clase").parquet(path)
    both = df.sparkSession.read.schema(schema).parquet(path)
    return both.where("clase = 'vector'").select(*keys, "embedding"), both.where("clase = 'evento'").select("textos", "dimension", "latencia_s")


def lexical_embedding(df: DataFrame, keys: list[str], text: str, out: str = "embedding") -> DataFrame:
    """Offline embedder: character 3–4-grams hashed to 1024 dimensions, L2 norm.

    N-grams are built on the JVM side; batches of 512 texts bound the dense block.
    """

    def embed(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                yield part[keys].assign(**{out: hash_grams(part["_g"]).to_numpy()})

    kept = df.select(*keys, F.transform(char_grams()(F.col(text)), lambda g: F.pmod(F.hash(g), F.lit(DIMENSIONS))).alias("_g"))
    fields = [f for f in kept.schema.fields if f.name in keys]
    return kept.mapInPandas(embed, StructType(fields).add(out, ArrayType(FloatType())))
