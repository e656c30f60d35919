import pytest
from pyspark.sql import functions as F

from sitometry import catalog
from sitometry.operators import analysis, quantile

DATA = "/root/testdata/sf0.001"


def frame(spark, n):
    g = F.when(F.col("id") % 3 > 0, F.lit("a")).when(F.col("id") % 9 > 0, F.lit(None))
    v = F.when(F.col("id") % 10 < 4, F.lit(7.0)).when(F.col("id") % 10 < 9, F.pmod(F.col("id") * 7919, F.lit(10007)) / 3.0)
    return spark.range(n).select(g.alias("g"), (F.col("id") % 2).alias("h"), v.alias("v"))


@pytest.mark.parametrize(("bracket", "cells", "small"), [(1_000_000, 4096, 10_000), (3, 7, 10_000), (1, 2, 0)])
def test_any_bracket_and_any_table_of_groups(spark, monkeypatch, bracket, cells, small):
    """Brackets cut into cells until one task may sort them; groups too many to broadcast are joined."""
    for name, value in (("BRACKET", bracket), ("CELLS", cells), ("SMALL", small)):
        monkeypatch.setattr(quantile, name, value)
    df, probs = frame(spark, 5003), [0.0, 0.01, 0.5, 0.995, 1.0]
    want = {(r["g"], r["h"]): (r["n"], r["q"]) for r in df.filter("v is not null").groupBy("g", "h").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()}
    assert {(r["g"], r["h"]): (r["n"], r["_q"]) for r in quantile.quantiles(df, ["g", "h"], "v", probs).collect()} == want


def test_spread_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(quantile, "BRACKET", 20)
    df = frame(spark, 20_011)
    x, names = quantile.values(df, ["g"], "v")
    got = {r["_k0"]: (r["_med"], r["_mad"]) for r in quantile.medians(x, names).collect()}
    rows = df.filter("v is not null").toPandas()
    rows["g"] = rows["g"].fillna("-")
    for g, part in rows.groupby("g")["v"]:
        assert got[None if g == "-" else g] == (part.median(), (part - part.median()).abs().median())


@pytest.mark.parametrize("winsor", [0.0, 0.1])
def test_summary_of_trimmed_and_clipped_logs(spark, winsor):
    import numpy as np

    rows = [(k % 2, float(1 + (k * 37) % 101)) for k in range(400)] + [(0, 1e9), (1, 0.0), (1, -5.0), (0, None)]
    got = {r["b"]: r for r in analysis.robust_summary(spark.createDataFrame(rows, "b int, v double"), ["b"], "v", 3.5, winsor, 3).collect()}
    for b in (0, 1):
        x = np.log10([v for k, v in rows if k == b and v is not None and v > 0])
        med = np.median(x)
        x = x[0.6745 * abs(x - med) / np.median(abs(x - med)) <= 3.5]
        if winsor:
            x = np.clip(x, *np.quantile(x, [winsor, 1 - winsor]))
        assert got[b]["n"] == len(x)
        assert [got[b][c] for c in ("q25", "median", "q75")] == pytest.approx(list(10 ** np.quantile(x, [0.25, 0.5, 0.75])))


@pytest.mark.parametrize(("name", "most"), [("robust_trend", 1), ("group_outliers", 2), ("trend_by_place", 1), ("review_queue", 2), ("top_group_trend", 2)])
def test_rows_are_read_once_and_never_gathered_by_group(spark, name, most):
    """In the plan as first made: scans of the rows, and no exchange above them."""
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= most
    if name == "group_outliers":
        assert "hashpartitioning(p_type" not in plan and "SortMergeJoin" not in plan.replace("SortMergeJoin [l_partkey", "")
