"""Cleaning and statistics: primary rows, tiers, robust outliers, trends, index, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantile
from .quantile import quantiles


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def primary_rows(df: DataFrame, keys: list[str], score: str, tie: list[str], flag: str | None = None, rank: str | None = None) -> DataFrame:
    """Rows flagged "yes", else rows of rank 1, else the best of each key.

    Which of these holds depends on whether any row of the table qualifies.
    """
    tests = []
    if flag:
        tests.append(F.lower(F.trim(F.col(flag))) == "yes")
    if rank:
        tests.append(F.col(rank) == 1)
    if tests:
        found = df.agg(*[F.count_if(t).alias(f"t{k}") for k, t in enumerate(tests)]).first()
        for k, t in enumerate(tests):
            if found[k]:
                return df.filter(t)
    return best_per_key(df, keys, [F.desc_nulls_last(score), *tie])


def tiered(df: DataFrame, score: str, least: float, ambiguous: Column | None = None) -> DataFrame:
    clear = ~ambiguous if ambiguous is not None else F.lit(True)
    sure = F.coalesce((F.col(score) >= least + 5) & clear, F.lit(False))
    return df.withColumn("tier", F.when(sure, "A").when(F.coalesce(F.col(score) >= least, F.lit(False)), "B").otherwise("C"))


def main_dataset(df: DataFrame, score: str, least: float, context: str | None = None, ambiguous: Column | None = None) -> DataFrame:
    df = df.filter(F.col(score) >= least)
    if ambiguous is not None:
        df = df.filter(~ambiguous)
    return df.filter(F.upper(context) == "PRICE") if context else df


def only(df: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose columns have the given values, such as one commodity in one unit and currency."""
    for column, v in wanted.items():
        df = df.filter(F.col(column) == v)
    return df


def year_range(df: DataFrame, year: str, first: float | None = None, last: float | None = None) -> DataFrame:
    """Rows without a year go only where a bound is given."""
    if first is not None:
        df = df.filter(F.col(year) >= first)
    return df.filter(F.col(year) <= last) if last is not None else df


def robust_outliers(df: DataFrame, keys: list[str], value: str, limit: float = 4.0) -> DataFrame:
    """``robust_z = 0.6745 (x - median) / MAD`` within groups (NULL where MAD is 0), and the flag."""
    x, names = quantile.values(df, keys, value)
    rows = quantile.matched(df, quantile.medians(x, names), keys, names, "left")
    out = rows.withColumn("robust_z", quantile.z_score(F.col(value)))
    return out.withColumn("outlier", F.coalesce(F.abs("robust_z") >= limit, F.lit(False))).drop("_med", "_mad")


def rolling_median(df: DataFrame, value: str, order: str, width: int, keys: list[str] = []) -> Column:  # noqa: B006
    """Centred, over the rows present, at least one of them."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return F.percentile(value, F.lit(0.5)).over(frame)


def trend(df: DataFrame, value: str, bin_col: str, keys: list[str] = [], width: int = 3) -> DataFrame:  # noqa: B006
    """Count, quartiles and smoothed median of each bin, by group. The windows run over bins."""
    good = df.filter(F.col(value).isNotNull() & F.col(bin_col).isNotNull())
    out = quantiles(good, [*keys, bin_col], value, [0.25, 0.5, 0.75])
    out = out.select(*keys, bin_col, "n", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"))
    return out.withColumn("smooth", rolling_median(out, "median", bin_col, width, keys))


def price_index(trended: DataFrame, bin_col: str, first: int, last: int) -> DataFrame:
    """100 times median over the median of the base bins' medians; NULL without a base."""
    base = trended.filter(F.col(bin_col).between(first, last)).agg(F.percentile("median", F.lit(0.5)).alias("base"))
    # one row joined to the bins
    out = trended.join(F.broadcast(base))
    base_or_null = F.nullif(F.col("base"), F.lit(0.0))
    return out.withColumns({"price_index": 100.0 * F.col("median") / base_or_null, "price_index_smooth": 100.0 * F.col("smooth") / base_or_null}).drop("base")


def robust_summary(df: DataFrame, keys: list[str], value: str, mad_z: float = 3.5, winsor: float = 0.0, least: int = 1) -> DataFrame:
    """Quartiles of log10 values after trimming by MAD and clipping at quantiles, as plain values.

    Bins with fewer than ``least`` values after the trim are left out.
    """
    x, names = quantile.values(df.filter(F.col(value) > 0).withColumn("_v", F.log10(value)), keys, "_v")
    spread = quantile.matched(x, quantile.medians(x, names), names, names)
    kept = spread.filter(F.coalesce(F.abs(quantile.z_score(F.col("_x"))) <= mad_z, F.lit(True))).select(*names, "_x")
    if winsor > 0:
        edge = quantile.sized(quantile.of_values(kept, names, [winsor, 1 - winsor]).select(*names, F.col("_q").alias("_e")), "edges")
        clipped = F.least(F.greatest(F.col("_x"), F.col("_e")[0]), F.col("_e")[1])
        kept = quantile.matched(kept, edge, names, names).select(*names, clipped.alias("_x"))
    q = quantile.of_values(kept, names, [0.25, 0.5, 0.75]).filter(F.col("n") >= least)
    ten = lambda k: F.pow(F.lit(10.0), F.col("_q")[k])
    return q.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n", ten(1).alias("median"), ten(0).alias("q25"), ten(2).alias("q75"))


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the ``n`` most frequent keys; ties by name."""
    top = df.groupBy(key).count().orderBy(F.desc("count"), key).limit(n).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def value_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("(blank)")).alias("value")
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def histogram(df: DataFrame, column: str, bins: int, logarithmic: bool = False, quantile: float = 0.995) -> DataFrame:
    """``bin`` from 0, its lower edge and count; the last bin is closed. Values over a quantile are
    clipped to it in a logarithmic histogram, which leaves out what is not positive."""
    v = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    if logarithmic:
        v = v.filter("v > 0")
        cut = quantiles(v, [], "v", [quantile]).select(F.col("_q")[0].alias("cut"))
        v = v.join(F.broadcast(cut)).select(F.log10(F.least("v", "cut")).alias("v"))
    ends = v.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    placed = v.join(F.broadcast(ends)).withColumn("bin", F.when(F.col("high") == F.col("low"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1))).cast("int"))
    return placed.groupBy("bin", "low", "high").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / bins).alias("edge"), "n")


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).try_cast("double").alias("x"), F.col(y).try_cast("double").alias("y")).filter("x is not null and y > 0")


def extremes(df: DataFrame, value: str, n: int, tie: list[str]) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).orderBy(F.desc(value), *tie).limit(n)


def review_queue(df: DataFrame, n: int, tie: list[str], low_score: float = 25.0) -> DataFrame:
    """Rows with a reason for review, the weightiest first.

    Columns: ambiguous, score, qty, span, dist, priceword, outlier_raw, outlier_std, strength,
    neg_signals, price. A missing strength is no reason but counts as 0 in the weight, and a missing price word is neither; being among
    the dearest hundredth is a reason without weight.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    c = F.col
    cut = quantiles(df, [], "price", [0.99]).select(F.col("_q")[0].alias("_cut"))
    # one row, or none where there is no price
    rows = df.join(F.broadcast(cut), how="left")
    bad_qty = c("qty").isNull() | (c("qty") <= 0)
    neg = F.coalesce(c("neg_signals"), F.lit("")) != ""
    # The reasons as they are shown, in their order, and their weights
    listed = [
        ("ambiguous", no(c("ambiguous")), 3.0),
        ("low_score(<25)", no(c("score") < low_score), 2.5),
        ("missing_or_bad_qty", bad_qty, 2.0),
        ("wide_span(>=60)", no(c("span") >= 60), 1.5),
        ("far_grain_price(>=35)", no(c("dist") >= 35), 1.2),
        ("no_priceword_near", no(~c("priceword")), 1.0),
        ("weak_signal(<0.5)", no(c("strength") < 0.5), 0.0),
        ("has_negative_signals", neg, 1.5),
        ("group_outlier_raw_unitprice", no(c("outlier_raw")), 2.0),
        ("group_outlier_std_price_per_liter", no(c("outlier_std")), 2.0),
        ("unitprice_top1pct", no(c("price") >= c("_cut")), 0.0),
    ]
    weight = sum((F.when(t, w).otherwise(0.0) for _, t, w in listed), F.when(F.coalesce(c("strength"), F.lit(0.0)) < 0.5, 1.5).otherwise(0.0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t, _ in listed])), "; ")
    out = rows.withColumns({"reasons": reasons, "priority": weight}).filter("reasons <> ''").drop("_cut")
    return out.orderBy(F.desc("priority"), F.asc_nulls_last("score"), *tie).limit(n)
