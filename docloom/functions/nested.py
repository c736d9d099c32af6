"""Recursive views of nested JSON held in a column."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

_LEAF = ArrayType(StructType().add("path", StringType()).add("value", DoubleType()))


def walk_numbers(value):
    """(path, number) for every numeric leaf, depth first; booleans are not numbers."""
    todo, found = [("", value)], []
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else str(k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{path}[{i}]", v[i]) for i in range(len(v) - 1, -1, -1)]
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            found.append((path, float(v)))
    return found


@F.pandas_udf(_LEAF)
def numeric_leaves(docs: pd.Series) -> pd.Series:
    """Numeric leaves of each JSON text; depth is unbounded, so this runs in Python batches."""

    def one(text):
        try:
            return [{"path": p, "value": v} for p, v in walk_numbers(json.loads(text))]
        except (TypeError, ValueError):
            return []

    return docs.map(one)


def container_sizes(df, keys: list[str], value: str):
    """``*keys, ruta, tipo, n``: how many members the arrays and objects at each path of a VARIANT column hold, of any shape.

    Elements of an array share one path; each round explodes one level, so the number of rounds is the depth.
    """
    from docloom.session import cut_lineage

    spark = df.sparkSession
    shape = F.schema_of_variant("v")
    level = df.select(*keys, F.lit("$").alias("ruta"), F.col(value).alias("v")).where(F.col("v").isNotNull())
    out = None
    while True:
        level = cut_lineage(level.withColumn("tipo", F.when(shape.startswith("ARRAY"), "lista").when(shape.startswith("OBJECT"), "mapa")).where(F.col("tipo").isNotNull()))
        if level.isEmpty():
            break
        members = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).alias("m"))
        n = members.groupBy(*keys, "ruta", "tipo").agg(F.count("m.pos").alias("n"))
        out = n if out is None else out.unionByName(n)
        step = F.when(F.col("tipo") == "lista", F.concat("ruta", F.lit("[]"))).otherwise(F.concat("ruta", F.lit("."), F.col("m.key")))
        level = members.where(F.col("m.pos").isNotNull()).select(*keys, step.alias("ruta"), F.col("m.value").alias("v"))
    empty = level.select(*keys, "ruta", "tipo", F.lit(0).cast("bigint").alias("n"))
    return empty if out is None else out
