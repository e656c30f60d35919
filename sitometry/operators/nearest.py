"""Nearest events: joins of two event tables by position, dealt in buckets of the window's size.

Positions are whole numbers within a key, such as tokens of a block. What is near a row lies in its own bucket or in one
of the two beside it, so the join is an equi join on key and bucket: a giant key is spread over tasks
and no row holds the events of a key. Rows with a null key or position are near nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(at: str, window: int) -> Column:
    return F.floor(F.col(at) / F.lit(window + 1)).cast("long")


def _packed(events: DataFrame, keys: list[str], name: str) -> list[Column]:
    return [*[F.col(k) for k in keys], F.struct(*[F.col(c) for c in events.columns if c not in keys]).alias(name)]


def within(left: DataFrame, right: DataFrame, keys: list[str], window: int, at: str = "tok", name: str = "event") -> DataFrame:
    """Each row of ``left`` with every row of ``right`` of its key at most ``window`` from it.

    ``name`` holds the other row (without the keys) as a struct and ``distance`` how far it is.
    """
    spread = left.withColumn("_b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: _bucket(at, window) + d)))
    met = spread.join(right.select(*_packed(right, keys, name), _bucket(at, window).alias("_b")), [*keys, "_b"])
    return met.withColumn("distance", F.abs(F.col(at) - F.col(f"{name}.{at}"))).filter(F.col("distance") <= window).select(*left.columns, name, "distance")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], window: int, at: str = "tok", seq: str = "seq", name: str = "event") -> DataFrame:
    """Each row of ``left`` with the nearest row of ``right`` of its key, at most ``window`` from it.

    Of equally near rows the first by ``seq`` counts. Rows without one near them have NULL in ``name`` and
    ``distance``. Nothing is paired: running windows within a key's bucket give the last event before
    a row and the first after it; where its bucket has none, the ends of the buckets beside it do.
    """
    # of the events at one place only the first can be nearest
    first = right.dropna(subset=[*keys, at]).groupBy(*keys, at).agg(F.min_by(F.struct(*[c for c in right.columns if c not in keys]), seq).alias(name))
    events = first.withColumn("_b", _bucket(at, window))
    span = lambda f: f(name, at)
    ends = events.groupBy(*keys, "_b").agg(span(F.min_by).alias("_first"), span(F.max_by).alias("_last"))
    rows = left.withColumn("_b", _bucket(at, window))
    kept = [c for c in left.columns if c not in (*keys, at)]
    both = rows.select(*keys, at, "_b", F.struct(F.lit(1).alias("_own"), *kept).alias("_row"), F.lit(None).cast(dict(events.dtypes)[name]).alias(name)).unionByName(events.withColumn("_row", F.lit(None)))
    cell = Window.partitionBy(*keys, "_b")
    running = lambda order: F.last(name, True).over(cell.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    before, after = running(F.asc(at)), running(F.desc(at))
    found = both.withColumns({"_before": before, "_after": after}).filter("_row is not null")
    beside = lambda end, step: ends.select(*keys, (F.col("_b") + step).alias("_b"), F.col(end).alias(f"{end}_beside"))
    found = found.join(beside("_last", 1), [*keys, "_b"], "left").join(beside("_first", -1), [*keys, "_b"], "left")
    far = lambda e: F.abs(e[at] - F.col(at))
    ends_of = F.array(F.coalesce("_before", "_last_beside"), F.coalesce("_after", "_first_beside"))
    near = F.filter(ends_of, lambda e: e.isNotNull() & (far(e) <= window))
    best = F.array_min(F.transform(near, lambda e: F.struct(far(e).alias("distance"), e[seq].alias("seq"), e.alias("event"))))
    out = found.withColumn("_best", best)
    own = [F.col(c) if c in (*keys, at) else F.col(f"_row.{c}").alias(c) for c in left.columns]
    return out.select(*own, F.col("_best.event").alias(name), F.col("_best.distance").alias("distance"))
