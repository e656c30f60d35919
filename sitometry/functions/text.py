"""Text functions: normalisation, match positions, tokens, windows, canonical names, JSON repair."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..vocab import Profile
from .numbers import bound, first_true


#: Signs that normalisation takes for blanks, so no normalised text holds them.
OUTER, INNER = "\x1c", "\x1d"


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Without combining marks; NULL becomes the empty text."""
    return s.map(lambda x: "" if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def _searchable(text: str | None) -> str:
    if not text:
        return ""
    plain = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)) if not unicodedata.combining(c))
    return " ".join(plain.casefold().split())


@F.pandas_udf(StringType())
def normalized(s: pd.Series) -> pd.Series:
    """Compatibility form, no marks, case folded, single spaces; NULL becomes the empty text."""
    return s.map(_searchable)


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cleaned(c: Column, most: int = 500) -> Column:
    """Unified line ends, runs of blanks as one, at most ``most`` characters."""
    lines = F.regexp_replace(c.cast("string"), "\r\n?", "\n")
    return F.left(F.trim(F.regexp_replace(lines, r"[ \t]+", " ")), F.lit(most))


def matches(text: Column, pattern: str, groups: int = 0) -> Column:
    """Every match in normalised text as ``struct(found, start, g1 ... gn)``, in text order, by built-in functions.

    One search marks the matches and their groups, and the text is split at the marks; a match starts after all earlier
    pieces.
    """
    marks = "".join(f"$%d{INNER}" % k for k in range(groups + 1))
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(OUTER + marks)), OUTER, -1)
    named = "array<struct<found:string,start:int" + "".join(f",g{k}:string" for k in range(1, groups + 1)) + ">>"

    def all_of(p: Column) -> Column:
        # what is found, its groups, and the text up to the next match
        return bound(F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: F.split(x, INNER, -1)), lambda parts: placed(F.length(p[0]), parts))

    def placed(before: Column, parts: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["end"] + F.length(x[0]) + F.length(x[groups + 1])).alias("end"), F.concat(acc["starts"], F.array(acc["end"])).alias("starts"))

        starts = F.aggregate(parts, F.struct(before.alias("end"), F.array().cast("array<int>").alias("starts")), step, lambda acc: acc["starts"])
        return F.zip_with(parts, starts, lambda x, start: F.struct(x[0].alias("found"), start.alias("start"), *[x[k].alias(f"g{k}") for k in range(1, groups + 1)]))

    return bound(pieces, lambda p: F.when(F.size(p) > 1, all_of(p)).otherwise(F.array().cast(named)))


def blanks(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def events_at(text: Column, pattern: str, shape: str, made: Callable[[Column, Column, Column, Column], Column], groups: int = 0) -> Column:
    """``made(parts, tok, start, k)`` of every match in normalised text, in text order, as an array of ``shape``.

    ``parts`` holds what is found and its groups, ``tok`` is the number of blanks before it, which is its token's index where no
    match begins with a blank, ``start`` its first character's place, and ``k`` counts from 0. As ``matches``, but the tokens are counted while the pieces are gone through.
    """
    marks = "".join(f"$%d{INNER}" % k for k in range(groups + 1))
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(OUTER + marks)), OUTER, -1)
    none = F.array().cast(f"array<{shape}>")

    def step(acc: Column, x: Column) -> Column:
        tok, end = acc["tok"] + blanks(x[0]) + blanks(x[groups + 1]), acc["end"] + F.length(x[0]) + F.length(x[groups + 1])
        return F.struct(tok.alias("tok"), end.alias("end"), F.array_append(acc["all"], made(x, acc["tok"], acc["end"], F.size(acc["all"]))).alias("all"))

    def all_of(p: Column) -> Column:
        parts = F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: F.split(x, INNER, -1))
        return F.aggregate(parts, F.struct(blanks(p[0]).alias("tok"), F.length(p[0]).alias("end"), none.alias("all")), step, lambda acc: acc["all"])

    return bound(pieces, lambda p: F.when(F.size(p) > 1, all_of(p)).otherwise(none))


def token_at(text: Column, start: Column) -> Column:
    """Index of the space-separated token that holds a character."""
    return bound(F.left(text, start + 1), blanks)


def token_window(tokens: Column, low: Column, high: Column) -> Column:
    """Tokens low to high (inclusive, clipped), line marks as line ends."""
    first = F.greatest(low, F.lit(0))
    part = F.array_join(F.slice(tokens, first + 1, F.greatest(F.least(high, F.size(tokens) - 1) - first + 1, F.lit(0))), " ")
    return F.trim(F.when(part.contains("__"), F.regexp_replace(part, r"(?i)\s*__(LB|CB|PB)__\s*", "\n")).otherwise(part))


def by_prefix(name: Column, known: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first prefix that a normalised name has; otherwise the name."""
    return first_true([(name.startswith(p), F.lit(v)) for p, v in known], name)


def place(name: Column, profile: Profile) -> Column:
    """The label of the first pattern found; "Unknown" without a name or a pattern."""
    return first_true([(name.rlike(f"(?i){p}"), F.lit(v)) for p, v in profile.places], F.lit("Unknown"))


def json_object(c: Column) -> Column:
    """The text from the first brace to the last, without code fences; NULL if there is none."""
    bare = F.regexp_replace(c, r"(?i)```(?:json)?\s*|\s*```", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
