import hashlib

import pytest
from pyspark.sql import functions as F

from sitometry.operators import sampling


@pytest.mark.parametrize(("spare", "more"), [(2, 50), (0, 1), (0.5, 0)])
def test_the_first_of_each_stratum_by_hash(spark, monkeypatch, spare, more):
    """Also where the first bound is too narrow and must be widened."""
    monkeypatch.setattr(sampling, "SPARE", spare)
    monkeypatch.setattr(sampling, "MORE", more)
    rows = [(k, None if k % 3 == 0 else "a" if k % 3 == 1 else "b", k % 7 == 0) for k in range(500)]
    quota = F.when(F.col("s").isNull(), 12).when(F.col("t"), 100).otherwise(5)
    got = sampling.drawn(spark.createDataFrame(rows, "k int, s string, t boolean"), ["s", "t"], quota, "k", 7)
    place = lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest()
    want = set()
    for s in (None, "a", "b"):
        for t in (False, True):
            own = sorted((k for k, *x in rows if x == [s, t]), key=place)
            want |= set(own[: 12 if s is None else 100 if t else 5])
    assert {r["k"] for r in got.collect()} == want and got.columns == ["k", "s", "t"]


def test_nothing_to_draw(spark):
    empty = spark.createDataFrame([], "k int, s string")
    assert sampling.drawn(empty, ["s"], 5, "k").count() == 0
    assert sampling.drawn(spark.createDataFrame([(1, "a")], "k int, s string"), ["s"], 0, "k").count() == 0


def sample_of(spark, n=30):
    windows = [(f"d{k % 40}", f"w{k}", "πυρου" if k % 2 else "κριθησ", f"text {k}", k % 3 == 0 if k % 5 else None, k % 4 == 0, True) for k in range(400)]
    w = spark.createDataFrame(windows, "ddb_id string, key string, grain_form string, window_text string, has_money boolean, has_unit boolean, has_number boolean")
    found = spark.createDataFrame([(f"d{k}",) for k in range(0, 40, 4)], "ddb_id string")
    return sampling.gold_sample(w, found, n, "key")


def test_gold_quotas(spark):
    counts = {(r["stratum"], r["m"]): r["count"] for r in sample_of(spark).groupBy("stratum", F.coalesce("has_money", F.lit(False)).alias("m")).count().collect()}
    assert counts == sampling.quotas(30) == {("A", True): 12, ("A", False): 6, ("B", True): 8, ("B", False): 4}
    # strata with fewer rows than their quota are taken whole
    assert sample_of(spark, 10_000).count() == 400


def test_gold_sheet_is_filled_from_labels_and_rules(spark):
    values = {"Grain_Form": "f", "Qty_Value": "2", "Qty_Unit": "u", "Price_Value": "40", "Price_Cur": "c", "Score": 33.5, "Priceword_Near": "yes", "Context_Type": "PRICE", "Signal_Type": "s", "Signal_Strength": 0.7, "Neg_Signals": ""}
    rows = [("d0", "no", 1, values | {"Price_Value": "1"}), ("d0", "yes", 3, values | {"Price_Value": "3"}), ("d0", " yes", 0, values), ("d0", "Yes", 2, values)]
    linked = spark.createDataFrame([(d, p, i, *(str(x) for x in v.values())) for d, p, i, v in rows], "DDB_ID string, Is_Primary string, i int, " + ", ".join(f"{c} string" for c in sampling.BY_RULES))
    labels = spark.createDataFrame([("d0", "πυρων", "TP", 2), ("d0", "κρι", "FP", 1), ("d1", "πυρ", "ME", 1)], "ddb_id string, label_form string, label string, priority int")
    sheet = sampling.gold_sheet(sample_of(spark), linked, labels, "key", ["i"])
    assert len(sheet.columns) == 38
    got = sheet.orderBy("Sample_ID").collect()
    assert [r["Sample_ID"] for r in got] == list(range(1, 31)) and [r["Sample_Stratum"] for r in got] == ["A"] * 18 + ["B"] * 12
    for r in got:
        assert r["RB_Price_Value"] == ("40" if r["DDB_ID"] == "d0" else "") and r["RB_Score"] == ("33.5" if r["DDB_ID"] == "d0" else "")
        assert r["Human_Label"] == {("d0", "πυρου"): "TP", ("d0", "κριθησ"): "FP", ("d1", "πυρου"): "ME"}.get((r["DDB_ID"], r["Grain_Form"]), "")
        assert r["LLM_Reasoning"] == r["Human_Notes"] == r["Title"] == ""
