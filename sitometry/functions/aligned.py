"""Normalised text with a map of its places back to the text as it was written."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .text import _searchable

BREAK = StructType([StructField("at", IntegerType()), StructField("written", IntegerType())])
SHAPE = StructType([StructField("norm", StringType()), StructField("breaks", ArrayType(BREAK))])


@lru_cache(1 << 16)
def _form(char: str) -> str:
    return _searchable(f"x{char}x")[1:-1]


def placed(text: str | None) -> tuple[str, list[int]]:
    """The text as ``text.normalized`` has it, and for each of its characters the place of the written one.

    Normalisation works on single characters (marks are dropped wherever they stand); a sign that becomes a
    blank and a mark ends a word like any blank, and runs of blanks are one.
    """
    norm, places = [], []
    for at, char in enumerate(text or ""):
        for c in _form(char):
            if c != " " or (norm and norm[-1] != " "):
                norm.append(c)
                places.append(at)
    if norm and norm[-1] == " ":
        norm.pop()
        places.pop()
    return "".join(norm), places


def aligned(text: str | None) -> tuple[str, list[tuple[int, int]]]:
    """The normalised text and breakpoints ``(at, written)``: from ``at`` up to the next one, a place lies
    as far behind ``written`` in the text as it lies behind ``at``."""
    norm, places = placed(text)
    return norm, [(k, p) for k, p in enumerate(places) if k == 0 or p != places[k - 1] + 1]


@F.pandas_udf(SHAPE)
def normalized_with_map(s: pd.Series) -> pd.DataFrame:
    found = [aligned(x) for x in s]
    return pd.DataFrame({"norm": [n for n, _ in found], "breaks": [[{"at": a, "written": w} for a, w in b] for _, b in found]})


def written_place(breaks: Column, place: Column) -> Column:
    """Where a character of the normalised text stands in the written one: beyond the last breakpoint at or before it."""
    last = F.element_at(F.filter(breaks, lambda b: b["at"] <= place), -1)
    return last["written"] + place - last["at"]


@F.pandas_udf(ArrayType(StringType()))
def written_tokens(s: pd.Series) -> pd.Series:
    """For each token of the normalised text what is written there: as many tokens, whatever normalisation
    joins or parts."""

    def cut(text: str | None) -> list[str]:
        norm, places = placed(text)
        starts = [0, *(k + 1 for k, c in enumerate(norm) if c == " ")] if norm else []
        edges = [*(places[k] for k in starts), len(text or "")]
        return [text[a:z].strip() for a, z in zip(edges, edges[1:])] or [""]

    return s.map(cut)
