"""Text expressions: normalisation, masking, fences, tokens, headings, JSON recovery."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = "[^" + WORD[1:]  # the complement of a character class
SPACE = r"[\s\h\v\x1C-\x1F]"

# Shapes of secrets that are masked before text is stored.
SECRET_SHAPES = [
    r"sk-ant-[A-Za-z0-9_\-]{10,}",
    r"sk-(?:proj-)?[A-Za-z0-9_\-]{20,}",
    r"(?i)bearer\s+[A-Za-z0-9._\-]{16,}",
]
SECRET_ASSIGNMENT = r"(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)['\"]?[^\s'\",]{8,}"
SECRET_ASSIGNMENT_JSON = r"(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)(?:\\?['\"])?[^\s'\",\\]{8,}"
MASK = "***"

# Environment names whose values count as secrets.
SECRET_ENV_WORDS = ("KEY", "TOKEN", "SECRET", "PASSWORD")


def _latin_folding() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one base character plus marks."""
    src, dst = [], []
    for cp in (*range(0xA0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000)):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _latin_folding()


def strip_accents(c: Column) -> Column:
    """Drop accents by table (the whole basic plane) and remove loose combining marks."""
    return F.regexp_replace(F.translate(c, _FOLD_FROM, _FOLD_TO), r"\p{Mn}", "")


@F.arrow_udf(StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """Unicode NFKC; Spark has no built-in for it.  Of a batch only some rows at a time are Python strings."""
    made = lambda part: pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string())
    return pa.concat_arrays([made(s.slice(at, 64)) for at in range(0, len(s), 64)] or [made(s)])


def join_hyphenated(c: Column) -> Column:
    """Re-join words cut by a hyphen at a line end."""
    return F.regexp_replace(c, rf"({WORD})-\n({WORD})", "$1$2")


def normalise_text(c: Column) -> Column:
    return join_hyphenated(nfkc(c))


def without_code(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)```.*?```", "")


def without_reasoning(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Whitespace-separated words outside fenced code."""
    return F.size(words(without_code(c)))


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    return F.array_join(words(c), " ")


def tokens(c: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.filter(F.split(F.lower(c), rf"{NOT_WORD}+"), lambda w: F.length(w) >= 2)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside ``body``.

    An expression used inside a lambda is otherwise recomputed for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(n: Column) -> Column:
    """``0 … n-1``; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def token_counts(toks: Column) -> Column:
    """``array<struct<term, tf>>`` computed inside the row: sort, then run lengths."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(positions(n), lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))

        def spans(at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(n))
            return F.zip_with(
                at, ends, lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).cast("int").alias("tf"))
            )

        return F.when(n > 0, let(starts, spans)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))

    return let(F.sort_array(toks), runs)


def shared_counts(a: Column, b: Column) -> Column:
    """Sum over common terms of the product of their counts; two :func:`token_counts` arrays merged by one sort."""
    none = F.lit(0)
    left = F.transform(a, lambda x: F.struct(x["term"].alias("term"), none.alias("l"), x["tf"].alias("r")))
    right = F.transform(b, lambda x: F.struct(x["term"].alias("term"), x["tf"].alias("l"), none.alias("r")))

    def met(s: Column) -> Column:  # of a common term the row of b sorts right after that of a
        nxt = F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))
        products = F.zip_with(s, nxt, lambda x, y: F.when(x["term"] == y["term"], x["r"].cast("bigint") * y["l"]).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(products, F.lit(0).cast("bigint"), lambda t, v: t + v)

    return let(F.sort_array(F.concat(left, right)), met)


def regex_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)


def contains_word(c: Column, word: str) -> Column:
    """Whole-word containment, word boundaries as in a Unicode regex."""
    left = rf"(?<!{WORD})" if word[:1].isalnum() or word[:1] == "_" else rf"(?<={WORD})"
    right = rf"(?!{WORD})" if word[-1:].isalnum() or word[-1:] == "_" else rf"(?={WORD})"
    return c.rlike(left + regex_escape(word) + right)


def word_pattern(word: Column) -> Column:
    """The pattern of :func:`contains_word` for words in a column."""
    escaped = F.regexp_replace(word, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    left = F.when(word.rlike(f"^{WORD}"), f"(?<!{WORD})").otherwise(f"(?<={WORD})")
    right = F.when(word.rlike(f"{WORD}$"), f"(?!{WORD})").otherwise(f"(?={WORD})")
    return F.concat(left, escaped, right)


def missing_words(c: Column, wanted: list[str]) -> Column:
    """The wanted words that do not occur, in the given order."""
    return F.filter(
        F.array(*[F.when(~contains_word(c, w), F.lit(w)) for w in wanted]), lambda x: x.isNotNull()
    )


def env_secrets(environ: dict[str, str]) -> list[str]:
    return [v for k, v in environ.items() if any(w in k.upper() for w in SECRET_ENV_WORDS) and len(v) >= 8]


def mask_secrets(c: Column, known: list[str] = (), in_json: bool = False) -> Column:
    """Replace known values, then every secret shape, by ``***``.

    ``in_json`` reads serialised text, where quotes inside strings carry a backslash.
    """
    for v in known:
        c = F.replace(c, F.lit(v), F.lit(MASK))
    for shape in SECRET_SHAPES:
        c = F.regexp_replace(c, shape, MASK)
    return F.regexp_replace(c, SECRET_ASSIGNMENT_JSON if in_json else SECRET_ASSIGNMENT, "$1$2" + MASK)


def mask_line(line: str, known: list[str] = ()) -> str:
    """:func:`mask_secrets` for one serialised line on the driver."""
    for v in known:
        line = line.replace(v, MASK)
    for shape in SECRET_SHAPES:
        line = regex.sub(shape, MASK, line)
    return regex.sub(SECRET_ASSIGNMENT_JSON, lambda m: f"{m[1]}{m[2]}{MASK}", line)


def mask_value(c: Column, known: list[str] = ()) -> Column:
    """Mask every string inside a nested value by masking its JSON form."""
    return mask_secrets(F.to_json(c), known, in_json=True)


def fingerprint(c: Column, length: int = 16) -> Column:
    """sha256 of the whitespace-normalised text."""
    return F.left(F.sha2(squeeze(c), 256), F.lit(length))


def clip(c: Column, n: int, tail: str = "… [{n} car. omitidos]") -> Column:
    """First n characters plus a note of how many were left out."""
    before, after = tail.split("{n}")
    return F.when(
        F.length(c) > n,
        F.concat(F.left(c, F.lit(n)), F.lit(before), (F.length(c) - n).cast("string"), F.lit(after)),
    ).otherwise(c)


def heading_key(c: Column) -> Column:
    """Lower-case ASCII words of a heading."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(c)), "[^a-z0-9]+", " "))


def py_lines(c: Column) -> Column:
    return F.split(c, r"\R|[\x1C-\x1E]")


def heading_offset(text: Column, heading: str | Column) -> Column:
    """Character offset of the first line that is the heading, or -1.

    A line counts when its key equals the target or starts with it as a whole
    word, after an optional leading number, and is at most 40 characters longer.
    Lines are split on single-character terminators so offsets stay exact.
    """
    return F.get(heading_offsets(text, F.array(heading if isinstance(heading, Column) else F.lit(heading))), F.lit(0))


def heading_offsets(text: Column, headings: Column) -> Column:
    """:func:`heading_offset` of an array of headings; their keys and those of the lines are made once."""
    key = lambda line: F.regexp_replace(heading_key(F.regexp_replace(line, "^[# ]+", "")), r"^\d+ ", "")

    def offset(lines: Column, keys: Column, goal: Column) -> Column:
        is_it = lambda k: (k != "") & (F.length(k) <= F.length(goal) + 40) & ((k == goal) | F.startswith(k, F.concat(goal, F.lit(" "))))

        def chars(n: Column) -> Column:
            upto = F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0)).cast("int"))
            return F.when(n > 0, F.aggregate(upto, F.lit(0), lambda a, l: (a + F.length(l) + 1).cast("int"))).otherwise(F.lit(-1))

        return let(F.array_position(F.transform(keys, is_it), True), chars)

    every = lambda lines, goals: let(F.transform(lines, key), lambda keys: F.transform(goals, lambda g: offset(lines, keys, g)))
    return let(F.transform(headings, heading_key), lambda goals: let(F.split(text, "\n"), lambda lines: every(lines, goals)))


def longest_fenced(c: Column, lang: str) -> Column:
    """Body of the longest fenced block of ``lang``; the text itself when there is none."""
    blocks = F.regexp_extract_all(c, F.lit(rf"(?s)```(?:{lang})?[ \t]*\n(.*?)```"), F.lit(1))
    longest = F.array_max(F.transform(blocks, lambda b: F.struct(F.length(b).alias("n"), b.alias("b"))))
    return F.coalesce(strip(longest["b"]), strip(c))


def recover_json(c: Column) -> Column:
    """A JSON object from a reply: fences stripped, else first ``{`` to last ``}``; NULL if none."""
    t = F.regexp_replace(strip(c), r"^```(?:json)?\s*|\s*```$", "")
    start = F.instr(t, "{")
    stop = F.length(t) - F.instr(F.reverse(t), "}") + 1
    window = F.when((start > 0) & (stop > start), F.substring(t, start, stop - start + 1))

    def obj(s: Column) -> Column:
        v = F.try_parse_json(s)
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), s)

    whole = F.try_parse_json(t)
    return F.when(whole.isNotNull(), obj(t)).otherwise(obj(window))


def replace_once(c: Column, old: str, new: str) -> Column:
    """Replacement that must match exactly once; NULL otherwise."""
    hits = (F.length(c) - F.length(F.replace(c, F.lit(old), F.lit("")))) / len(old)
    return F.when(hits == 1, F.replace(c, F.lit(old), F.lit(new)))


def link_targets(c: Column, pattern: str = r"!\[[^\]]*\]\(([^)\s]+)\)") -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def split_before(c: Column, heading: str) -> Column:
    """Split at line starts that match ``heading``; the marker stays with its piece."""
    return F.split(c, rf"\n(?={heading})")


def quote_key(c: Column) -> Column:
    """Quote normaliser: NFKC, lower case, markup and quotation marks dropped."""
    return squeeze(F.regexp_replace(F.lower(nfkc(c)), "[*`_«»\"'“”]", ""))


def is_literal_quote(quote: Column, source: Column) -> Column:
    q = quote_key(quote)
    return (F.length(q) >= 12) & F.contains(quote_key(source), q)


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
