"""Lines to sections, fences, chunks: all computed inside the document's own row, no shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from docloom.functions.names import WORK_SECTION, is_work_title, section_key
from docloom.functions.text import let, positions, strip
from docloom.plans.scale import running_sum
from docloom.session import cut_lineage

PREAMBLE = "Preámbulo"
CHUNK_CHARS = 2500
LINE = "struct<texto:string,tam:double,negrita:boolean,pagina:int>"


def plain_lines(lines: Column) -> Column:
    """Lines without font information, as a line table row."""
    return F.transform(
        lines,
        lambda t: F.struct(
            t.alias("texto"), F.lit(None).cast("double").alias("tam"),
            F.lit(None).cast("boolean").alias("negrita"), F.lit(None).cast("int").alias("pagina"),
        ),
    )


def body_size(lines: Column) -> Column:
    """Median font size of the lines longer than 40 characters; 0 when there is none."""
    sizes = F.sort_array(
        F.transform(
            F.filter(lines, lambda l: (F.coalesce(l["tam"], F.lit(0.0)) != 0) & (F.length(l["texto"]) > 40)),
            lambda l: l["tam"],
        )
    )
    n = F.size(sizes)
    low = F.get(sizes, ((n - 1) / 2).cast("int"))
    high = F.get(sizes, (n / 2).cast("int"))
    return F.coalesce((low + high) / 2, F.lit(0.0))


def is_heading(line: Column, body: Column) -> Column:
    """Heading by Markdown mark, by font, or by the work-section pattern."""
    text, size, bold = line["texto"], line["tam"], F.coalesce(line["negrita"], F.lit(False))
    worded = text.rlike(WORK_SECTION) & (F.length(text) < 80)
    sized = size.isNotNull() & (body != 0)
    return (
        F.when(text.isNull() | (text == "") | (F.length(text) > 100), False)
        .when(size.isNull() & text.rlike(r"^#{1,4}\s+\S"), True)
        .when(sized & ((size >= body * 1.3) | ((size >= body * 1.1) & bold)), True)
        .when(sized & (size < body * 1.1), bold & worded)
        .otherwise(worded)
    )


def segment(lines: Column) -> Column:
    """``array<struct<id, titulo, clave, trabajo, pagina, texto>>`` of one document.

    Section starts are array positions; each body is the slice up to the next
    start, so the work is linear in the number of lines.
    """

    def with_lines(ls: Column) -> Column:
        marked = let(body_size(ls), lambda b: F.transform(ls, lambda l: is_heading(l, b)))
        return let(marked, lambda flags: _segment(ls, flags))

    return let(lines, with_lines)


def _segment(lines: Column, flags: Column) -> Column:
    n = F.size(lines)
    heads = F.filter(positions(n), lambda i: F.get(flags, i))

    def merges(i: Column) -> Column:
        """Adjacent heading lines of one size are one title."""
        before = F.greatest(i - 1, F.lit(0))
        return (i > 0) & F.get(flags, before) & F.get(lines, i)["tam"].eqNullSafe(F.get(lines, before)["tam"])

    starts = F.filter(heads, lambda i: ~merges(i))
    opens = F.concat(
        F.when((F.size(starts) == 0) | (F.get(starts, F.lit(0)) > 0), F.array(F.lit(-1))).otherwise(
            F.array().cast("array<int>")
        ),
        starts,
    )
    stops = F.concat(F.slice(opens, F.lit(2), F.greatest(F.size(opens) - 1, F.lit(0))), F.array(n))

    def section(a: Column, b: Column) -> Column:
        first = F.greatest(a, F.lit(0))
        block = F.slice(lines, first + 1, F.greatest(b - first, F.lit(0)))
        marks = F.slice(flags, first + 1, F.greatest(b - first, F.lit(0)))
        title_len = F.when(a < 0, 0).otherwise(
            F.when(F.array_position(marks, False) > 0, F.array_position(marks, False) - 1).otherwise(F.size(marks))
        ).cast("int")
        titles = F.transform(F.slice(block, F.lit(1), title_len), lambda l: l["texto"])
        head = strip(F.regexp_replace(F.get(titles, F.lit(0)), "^#+", ""))
        rest = F.slice(titles, F.lit(2), F.greatest(title_len - 1, F.lit(0)))
        title = F.when(a < 0, F.lit(PREAMBLE)).otherwise(F.array_join(F.concat(F.array(head), rest), " "))
        text = F.transform(
            F.slice(block, title_len + 1, F.greatest(F.size(block) - title_len, F.lit(0))), lambda l: l["texto"]
        )
        page = F.when(a < 0, 1).otherwise(F.coalesce(F.get(lines, first)["pagina"], F.lit(1)))
        return F.struct(
            title.alias("titulo"), page.cast("int").alias("pagina"), strip(F.array_join(text, "\n")).alias("texto")
        )

    raw = F.zip_with(opens, stops, section)
    return F.transform(
        raw,
        lambda s, i: F.struct(
            F.concat(F.lit("S"), i.cast("string")).alias("id"),
            s["titulo"].alias("titulo"),
            F.when((i == 0) & ~is_work_title(s["titulo"]), F.lit(PREAMBLE)).otherwise(
                section_key(s["titulo"])).alias("clave"),
            is_work_title(s["titulo"]).alias("trabajo"),
            s["pagina"].alias("pagina"),
            s["texto"].alias("texto"),
        ),
    )


def sections_table(df: DataFrame, key: str, lines: str) -> DataFrame:
    """One row per section: ``key, sec_no`` plus the section fields."""
    return (
        df.select(key, segment(F.col(lines)).alias("_s"))
        .select(key, F.posexplode("_s").alias("sec_no", "_s"))
        .select(key, "sec_no", "_s.*")
    )


def open_fences(lines: Column, marker: str = r"^\s*```") -> Column:
    """For each line, whether a block is open after it: parity of markers so far."""
    n = F.size(lines)
    hits = F.transform(lines, lambda l, i: F.when(l.rlike(marker), i))
    marks = F.filter(hits, lambda i: i.isNotNull())
    stops = F.concat(marks, F.array(n))
    starts = F.concat(F.array(F.lit(0)), marks)
    spans = F.zip_with(starts, stops, lambda a, b: b - a)
    return F.flatten(F.transform(spans, lambda len_, i: F.array_repeat((i % 2) == 1, len_.cast("int"))))


@F.pandas_udf(ArrayType(IntegerType()))
def pack(lengths: pd.Series, breaks: pd.Series, limits: pd.Series) -> pd.Series:
    """Greedy group number of each block: a new group at a break or when the text would not fit."""

    def one(sizes, forced, limit):
        groups, group, used, filled = [], 0, 0, False
        for size, cut in zip(sizes, forced):
            body, title = size
            if filled and (cut or used + body > limit):
                group, used = group + 1, 0
            used, filled = used + body + title, True
            groups.append(group)
        return groups

    return pd.Series([
        one([(int(x["body"]), int(x["title"])) for x in a], b, int(m)) for a, b, m in zip(lengths, breaks, limits)
    ])


def note_blocks(lines: Column) -> Column:
    """Second- and third-level Markdown blocks outside fences: ``struct<titulo, nivel, texto, body>``."""
    return let(lines, lambda ls: let(open_fences(ls), lambda fenced: _note_blocks(ls, fenced)))


def _note_blocks(lines: Column, fenced: Column) -> Column:
    n = F.size(lines)
    pos = positions(n)
    shape = r"^(#{2,3})\s+(.+?)\s*$"
    starts = F.filter(pos, lambda i: ~F.get(fenced, i) & F.get(lines, i).rlike(shape) & ~F.get(lines, i).rlike(r"^\s*```"))
    stops = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))

    def block(a: Column, b: Column) -> Column:
        head = F.get(lines, a)
        text = F.array_join(F.slice(lines, a + 2, F.greatest(b - a - 1, F.lit(0))), "\n")
        return F.struct(
            F.regexp_extract(head, shape, 2).alias("titulo"),
            F.length(F.regexp_extract(head, shape, 1)).alias("nivel"),
            strip(text).alias("texto"),
            F.length(text).alias("body"),
        )

    return F.when(F.size(starts) > 0, F.zip_with(starts, stops, block)).otherwise(
        F.array().cast("array<struct<titulo:string,nivel:int,texto:string,body:int>>")
    )


def note_chunks(df: DataFrame, source: str, lines: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """Notes packed into chunks: ``id, fuente, titulos, cita, texto``.

    Second-level headings always open a chunk; smaller blocks join while they fit.
    """
    return _cited_chunks(_packed(df.select(F.col(source).alias("fuente"), F.lit(0).cast("bigint").alias("_o"), F.col(lines).alias("_l")), limit))


def note_line_chunks(df: DataFrame, source: str, at: str, text: str, limit: int = CHUNK_CHARS, span: int = 1 << 20) -> DataFrame:
    """:func:`note_chunks` of notes given line by line, in the order of the number ``at``.

    A second-level heading outside fences opens a chunk, so only the lines from one to the next meet in a row.  Fences and
    headings are counted inside stretches of ``span`` of ``at``; the totals of stretches before are added.
    """
    flag = lambda regex: F.coalesce(F.col("t").rlike(regex), F.lit(False))
    d = df.select(F.col(source).alias("fuente"), F.col(at).cast("bigint").alias("p"), F.col(text).alias("t"))
    d = d.withColumn("_b", F.floor(F.col("p") / span)).withColumn("_m", flag(r"^\s*```").cast("bigint"))
    inside = Window.partitionBy("fuente", "_b").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    opens = flag(r"^##\s+(.+?)\s*$") & (F.col("_m") == 0)
    d = d.withColumn("_f", F.sum("_m").over(inside)).withColumn("_even", (opens & (F.col("_f") % 2 == 0)).cast("bigint")).withColumn("_odd", (opens & (F.col("_f") % 2 == 1)).cast("bigint"))
    d = cut_lineage(d.select("fuente", "p", "t", "_b", "_m", "_even", "_odd", F.sum("_even").over(inside).alias("_he"), F.sum("_odd").over(inside).alias("_ho")))
    totals = d.groupBy("fuente", "_b").agg(*[F.sum(c).alias(c) for c in ("_m", "_even", "_odd")])
    before = Window.partitionBy("fuente").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    totals = totals.withColumn("_in", F.coalesce(F.sum("_m").over(before), F.lit(0)) % 2 == 1)
    own = F.when(F.col("_in"), F.col("_odd")).otherwise(F.col("_even"))
    totals = totals.withColumn("_own", own).select("fuente", "_b", "_in", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_o"))
    placed = d.join(totals, ["fuente", "_b"]).select("fuente", "p", "t", (F.col("_o") + F.when(F.col("_in"), F.col("_ho")).otherwise(F.col("_he"))).alias("_s"))
    g = placed.groupBy("fuente", "_s").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]).alias("_l"))
    b = cut_lineage(_packed(g, limit).withColumn("_n", (F.array_max("_g") + 1).cast("bigint")))
    known = running_sum(b.select("fuente", "_s", "_n"), ["fuente"], ["_s"], F.floor(F.col("_s") / 4096), {"_e": "_n"}).select("fuente", "_s", (F.col("_e") - F.col("_n")).alias("_o"))
    return _cited_chunks(b.join(known, ["fuente", "_s"]))


def _packed(df: DataFrame, limit: int) -> DataFrame:
    """Blocks ``_b`` of the lines ``_l`` with the group ``_g`` of each; rows without blocks go."""
    b = df.select(*[c for c in df.columns if c != "_l"], note_blocks(F.col("_l")).alias("_b"))
    return b.withColumn(
        "_g",
        pack(
            F.transform("_b", lambda x: F.struct(x["body"].alias("body"), F.length(x["titulo"]).alias("title"))),
            F.transform("_b", lambda x: x["nivel"] == 2),
            F.lit(limit),
        ),
    ).where(F.size("_b") > 0)


def _cited_chunks(b: DataFrame) -> DataFrame:
    """A row per group of ``fuente, _o, _b, _g``; ``_o`` chunks of the note come before."""
    chunk_nos = F.sequence(F.lit(0), F.array_max("_g"))
    b = b.select("fuente", "_o", "_b", "_g", F.explode(chunk_nos).alias("_k"))
    mine = F.filter(F.arrays_zip(F.col("_b").alias("b"), F.col("_g").alias("g")), lambda z: z["g"] == F.col("_k"))
    b = b.select("fuente", (F.col("_o") + F.col("_k") + 1).alias("_no"), F.transform(mine, lambda z: z["b"]).alias("m"))
    titles = F.transform("m", lambda x: x["titulo"])
    text = F.array_join(
        F.transform(
            "m", lambda x: F.concat(F.repeat(F.lit("#"), x["nivel"]), F.lit(" "), x["titulo"], F.lit("\n"), x["texto"])
        ),
        "\n\n",
    )
    return b.select(
        F.concat("fuente", F.lit("#"), F.col("_no").cast("string")).alias("id"),
        "fuente",
        titles.alias("titulos"),
        F.concat(
            F.col("fuente"), F.lit(" § "), F.get(titles, F.lit(0)),
            F.when(F.size(titles) > 1, F.concat(F.lit(" … "), F.element_at(titles, -1))).otherwise(F.lit("")),
        ).alias("cita"),
        strip(text).alias("texto"),
    )
