"""Agreement between two binary raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.stats import kappa


def agreement(df: DataFrame, truth: str, judge: str, keys: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy and Cohen's kappa; rows without a verdict are only counted."""

    def cell(a: int, b: int) -> Column:
        return F.sum(F.when((F.col(truth) == a) & (F.col(judge) == b), 1).otherwise(0)).cast("bigint")

    g = df.groupBy(*(keys or [])).agg(
        cell(1, 1).alias("vp"), cell(1, 0).alias("fn"), cell(0, 1).alias("fp"), cell(0, 0).alias("vn"),
        F.sum(F.when(F.col(judge).isNull(), 1).otherwise(0)).cast("bigint").alias("sin_veredicto"),
    )
    n = F.col("vp") + F.col("fn") + F.col("fp") + F.col("vn")
    return g.withColumn("juzgadas", n).withColumn(
        "acuerdo", F.round((F.col("vp") + F.col("vn")) / F.greatest(n, F.lit(1)), 6)
    ).withColumn("kappa", F.round(kappa(F.col("vp"), F.col("vn"), F.col("fp"), F.col("fn")), 6))


def verdict(raw: Column) -> Column:
    """``struct<ok, razon, formato>`` from a JSON reply: object, bare boolean, quoted boolean or junk."""
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    inner = F.schema_of_variant(F.try_variant_get(v, "$.ok", "variant"))
    word = F.lower(F.trim(F.try_variant_get(v, "$", "string")))
    full = kind.startswith("OBJECT") & (inner == "BOOLEAN")
    bare = (kind == "BOOLEAN") | ((kind == "STRING") & word.isin("true", "false"))
    return F.struct(
        F.when(full, F.try_variant_get(v, "$.ok", "boolean")).when(bare, word == "true").cast("int").alias("ok"),
        F.when(full, F.coalesce(F.try_variant_get(v, "$.razon", "string"), F.lit(""))).otherwise("").alias("razon"),
        F.when(full, "completo").when(bare, "sin_razon").otherwise("faltante").alias("formato"),
    )
