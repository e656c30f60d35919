"""Numbers, years, conversions and scores as columns. Missing is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import DRACHMA, LITRE


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it (also for each element
    of an array, where a plain expression would be computed again)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def passing(df: DataFrame, test: Column) -> DataFrame:
    """The rows of ``df`` for which ``test`` is true, by a generator: a filter would be pushed below the columns
    that it names, and these would be computed twice, with all that they name inlined."""
    return df.withColumn("_passed", F.explode(F.when(test, F.array(F.lit(True))))).drop("_passed")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, each computed once a row: a generator, since a projection would be merged into later
    ones and computed at each place that names it, within a lambda even for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def to_num(c: Column) -> Column:
    """A double, or NULL where the text is not a number."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def to_float(c: Column) -> Column:
    """Like ``to_num``, and ``a/b`` of whole numbers as their quotient (NULL for b = 0)."""
    s = F.trim(c.cast("string"))
    part = lambda k: F.try_element_at(F.split(s, "/"), F.lit(k)).try_cast("double")
    return F.when(s.rlike(r"^[0-9]+/[0-9]+$"), F.try_divide(part(1), part(2))).otherwise(to_num(s))


def shown(v: Column) -> Column:
    """A value with at most six decimals and no trailing zeros."""
    return bound(v, lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")))


def int_and_fractions(whole: Column, fractions: Column) -> Column:
    """The sum of a whole number and of every ``n/d`` in a text."""
    each = F.transform(F.regexp_extract_all(fractions, F.lit(r"([0-9]+\s*/\s*[0-9]+)"), 1), lambda f: F.regexp_replace(f, r"\s", ""))
    value = F.transform(each, lambda f: F.coalesce(F.try_divide(F.split(f, "/")[0].cast("double"), F.split(f, "/")[1].cast("double")), F.lit(0.0)))
    parts = F.when(fractions.contains("/"), F.aggregate(value, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))
    return F.coalesce(F.nullif(whole, F.lit("")).try_cast("double"), F.lit(0.0)) + parts


def iso_year(c: Column) -> Column:
    """The signed leading year of an ISO-like date, as a double."""
    s = F.trim(c.cast("string"))
    digits = F.nullif(F.regexp_extract(s, r"^([+-]?)\s*([0-9]{1,4})", 2), F.lit("")).try_cast("double")
    return F.when(F.regexp_extract(s, r"^([+-]?)\s*([0-9]{1,4})", 1) == "-", -digits).otherwise(digits)


def inferred_year(when: Column, not_before: Column, not_after: Column) -> Column:
    a, b = iso_year(not_before), iso_year(not_after)
    return F.coalesce(iso_year(when), (a + b) / 2, a, b)


def binned(year: Column, width: int) -> Column:
    return (F.floor(year / width) * width).cast("int")


def unit_price(price: Column, quantity: Column) -> Column:
    return F.when(quantity > 0, price / quantity)


def converted(amount: Column, unit: Column, factors: dict[str, float]) -> Column:
    """Amount times the factor of its unit; NULL for an unknown unit."""
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    return amount * F.try_element_at(table, unit)


def in_drachmas(amount: Column, currency: Column) -> Column:
    return converted(amount, currency, DRACHMA)


def in_litres(amount: Column, unit: Column) -> Column:
    return converted(amount, unit, LITRE)


def log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def prox(distance: Column, scale: float) -> Column:
    return F.when(distance >= 1e9, F.lit(0.0)).otherwise(F.exp(-distance / F.lit(float(scale))))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def score_bin(score: Column, most: int = 80) -> Column:
    """Labels like ``11-20``; 0 to 10 is ``00-10``. Scores over ``most`` have none.

    A score between 10 and 11 falls to ``01-10``, which is not among ``bin_labels``.
    """
    low = F.floor((score.cast("int") - 1) / 10) * 10 + 1
    return F.when(score.isNull() | (score < 0) | (score > most), F.lit(None)).when(score <= 10, F.lit("00-10")).otherwise(F.format_string("%02d-%02d", low, low + 9))


def bin_labels(most: int = 80) -> list[str]:
    return ["00-10", *(f"{k + 1:02d}-{k + 10:02d}" for k in range(10, most, 10))]


def ambiguous_group(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)) == "yes", F.lit("ambiguous_yes")).otherwise(F.lit("ambiguous_no"))


def truthy(c: Column, words: tuple[str, ...] = ("true", "1", "yes")) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*words), F.lit(False))


def first_true(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), otherwise)
