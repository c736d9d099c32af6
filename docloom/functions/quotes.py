"""Literal quotes with the place they stand at: normalised forms, mapped back by the lengths of their pieces."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

LEAST = 12  # characters of a normalised quote
_DROPPED = np.array(sorted(map(ord, "*`_«»\"'“”")), np.uint32)  # fixed values: markup and quotation marks
_SPAN = ArrayType(StructType().add("ini", IntegerType()).add("fin", IntegerType()))
_CLUSTER = re.compile(r"[^̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯][̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]*|.", re.DOTALL)
_BLANKS: np.ndarray | None = None


def _blank(points: np.ndarray) -> np.ndarray:
    global _BLANKS
    if _BLANKS is None:
        _BLANKS = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)
    return np.isin(points, _BLANKS)


def normal_form(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """NFKC in lower case without marks, runs of white space as one blank; and, for each of its characters, where in ``text``
    its source starts and ends.

    A base character and its combining marks are normalised together; prefix sums of the pieces' lengths give the map.
    """
    low = text.lower()
    if len(low) == len(text) and unicodedata.is_normalized("NFKC", low):
        start = np.arange(len(text))
        end = start + 1
    else:
        parts = [m.group() for m in _CLUSTER.finditer(text)]
        made = [unicodedata.normalize("NFKC", p).lower() for p in parts]
        size = np.array([len(p) for p in parts], int)
        place = np.repeat(np.arange(len(parts)), [len(m) for m in made])
        end = np.cumsum(size)
        start, end = (end - size)[place], end[place]
        low = "".join(made)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = ~np.isin(points, _DROPPED)
    points, start, end = points[keep], start[keep], end[keep]
    blank = _blank(points)
    keep = ~blank | np.r_[False, ~blank[:-1]] if len(points) else blank
    points, start, end = np.where(blank, 32, points)[keep], start[keep], end[keep]
    if len(points) and points[-1] == 32:
        points, start, end = points[:-1], start[:-1], end[:-1]
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), start, end


@F.pandas_udf(_SPAN)
def quote_spans(texts: pd.Series, quotes: pd.Series) -> pd.Series:
    """For each quote of a row the span of its first occurrence (code points, end exclusive), or null.

    A quote counts from ``LEAST`` normalised characters on; a null text or quote is found nowhere.
    """

    def one(text, wanted):
        form, start, end = normal_form(text or "")
        found = []
        for q in wanted if wanted is not None else ():
            q = normal_form(q)[0] if q else ""
            at = form.find(q) if len(q) >= LEAST else -1
            found.append(None if at < 0 else {"ini": int(start[at]), "fin": int(end[at + len(q) - 1])})
        return found

    return pd.Series([one(t, q) for t, q in zip(texts, quotes, strict=True)])
