"""Entity extraction around an injectable text-to-reply function, and parsing of its replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from docloom.functions.names import name_key
from docloom.functions.text import recover_json

REPLY = (
    "entidades ARRAY<STRUCT<nombre: STRING, tipo: STRING, alias: ARRAY<STRING>, descripcion: STRING>>, "
    "relaciones ARRAY<STRUCT<origen: STRING, destino: STRING, relacion: STRING>>"
)
PIECE_CHARS = 6000


def ask(pieces: DataFrame, keys: list[str], text: str, model: Callable[[str], str]) -> DataFrame:
    """``*keys, parte, respuesta, error``: one reply per piece of each text, all of it; a piece has at most PIECE_CHARS characters and ends
    before white space, unless one word is longer than that.  A failing part is kept with its error, not raised."""
    fields = [f for f in pieces.schema.fields if f.name in keys]
    schema = StructType(fields).add("parte", LongType()).add("respuesta", StringType()).add("error", StringType())

    def run(batches):
        for b in batches:
            out = []
            for t in b["_t"]:
                try:
                    out.append((model(t), None))
                except Exception as e:  # a failed piece becomes a row, like any other outcome
                    out.append((None, f"{type(e).__name__}: {e}"[:300]))
            yield b[[*keys, "parte"]].assign(respuesta=[r for r, _ in out], error=[e for _, e in out])

    piece = F.lit(rf"(?s).{{1,{PIECE_CHARS}}}(?!\S)|.{{1,{PIECE_CHARS}}}")
    cut = F.when(F.length(text) > 0, F.regexp_extract_all(F.col(text), piece, F.lit(0))).otherwise(F.array(F.col(text)))
    parts = pieces.where(F.col(text).isNotNull()).select(*keys, F.posexplode(cut).alias("parte", "_t"))
    return parts.select(*keys, F.col("parte").cast("long").alias("parte"), "_t").mapInPandas(run, schema)


def parse(replies: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Raw entities and relations of each reply, numbered in order (part, then place); unreadable replies yield none."""
    pos = (F.col("parte") * (1 << 20) + F.col("pos")).alias("pos")
    r = replies.select(*keys, "parte", F.from_json(recover_json(F.col("respuesta")), REPLY).alias("r"))
    ents = r.select(*keys, "parte", F.posexplode("r.entidades").alias("pos", "e")).select(
        *keys, pos, "e.nombre", "e.tipo", F.coalesce("e.alias", F.array().cast("array<string>")).alias("alias"),
        F.trim(F.coalesce("e.descripcion", F.lit(""))).alias("descripcion"))
    rels = r.select(*keys, "parte", F.posexplode("r.relaciones").alias("pos", "e")).select(
        *keys, pos, name_key(F.coalesce("e.origen", F.lit(""))).alias("origen"), name_key(F.coalesce("e.destino", F.lit(""))).alias("destino"), "e.relacion")
    return ents, rels
