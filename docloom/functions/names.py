"""Entity names: merge keys, alternative forms, relation labels, cleaning rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import strip, strip_accents

# Leading articles, names too generic to be entities, entity types.
ARTICLES = ["el", "la", "los", "las", "un", "una", "unos", "unas", "the", "a", "an"]
GENERIC = [
    "modelo", "dato", "resultado", "tarea", "parte", "pregunta", "figura", "tabla",
    "seccion", "enunciado", "codigo", "script", "archivo", "ejemplo", "valor", "metodo",
]
ENTITY_TYPES = ["dataset", "metodo", "metrica", "concepto", "restriccion"]
DEFAULT_TYPE = "concepto"


def _singular(w: Column) -> Column:
    n = F.length(w)
    es = (n > 4) & w.endswith("es") & F.substring(w, -3, 1).isin("l", "n", "r", "d", "j")
    s = (n > 3) & w.endswith("s") & ~w.endswith("ss")
    return F.when(es, F.left(w, n - 2)).when(s, F.left(w, n - 1)).otherwise(w)


def name_key(c: Column) -> Column:
    """Merge key: ASCII words, leading articles dropped, plurals folded."""
    flat = F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))
    article = "|".join(ARTICLES)
    bare = F.regexp_replace(flat, rf"^(?:(?:{article})(?: |$))+", "")
    parts = F.filter(F.split(bare, " "), lambda w: w != "")
    return F.array_join(F.transform(parts, _singular), " ")


def name_forms(name: Column, aliases: Column | None = None) -> Column:
    """All merge keys of an entity: name, name without parentheses, acronyms, aliases."""
    name = F.coalesce(name, F.lit(""))
    raw = F.concat(
        F.array(name, F.regexp_replace(name, r"\([^)]*\)", "")),
        F.regexp_extract_all(name, F.lit(r"\(([^)]{2,15})\)"), F.lit(1)),
    )
    if aliases is not None:
        raw = F.concat(raw, F.coalesce(aliases, F.array().cast("array<string>")))
    keys = F.transform(F.filter(raw, lambda x: x.isNotNull()), name_key)
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 2))


def relation_label(c: Column, limit: int | None = None) -> Column:
    """Lower-case words joined by ``_``; ``limit`` cuts the label, so that longer names may fall together."""
    slug = F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("relacionado_con")))), "[^a-z0-9]+", "_")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    slug = slug if limit is None else F.left(slug, F.lit(limit))
    return F.when(slug == "", F.lit("relacionado_con")).otherwise(slug)


def entity_type(c: Column) -> Column:
    t = strip(F.lower(strip_accents(F.coalesce(c, F.lit(DEFAULT_TYPE)))))
    return F.when(t.isin(*ENTITY_TYPES), t).otherwise(F.lit(DEFAULT_TYPE))


def is_specific(forms: Column) -> Column:
    """True when the entity has a usable, non-generic main key."""
    return (F.size(forms) > 0) & ~F.get(forms, F.lit(0)).isin(*GENERIC)


def section_key(title: Column, limit: int | None = None) -> Column:
    """``Parte 3 — …`` becomes ``Parte 3``; other titles stay whole unless ``limit`` cuts them."""
    t = strip(title)
    word = F.regexp_extract(t, WORK_SECTION, 1)
    return F.when(
        t.rlike(WORK_SECTION),
        F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1000)), F.lit(" "),
                 F.regexp_extract(t, WORK_SECTION, 2)),
    ).otherwise(t if limit is None else F.left(t, F.lit(limit)))


# Headings of work sections.
WORK_SECTION = r"(?i)^(?:#+\s*)?(Parte|Tarea|Pregunta|Ejercicio|Problema)\s+(\d+)(?![\p{L}\p{N}_])"


def is_work_title(title: Column) -> Column:
    return title.rlike(WORK_SECTION)
