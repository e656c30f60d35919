"""Plans as first made: what a window or a block is searched for stands there once, not again in filters pushed below it."""

import pytest

from pyspark.sql import functions as F

from sitometry import catalog
from sitometry.functions import text
from sitometry.operators import linking, windows
from sitometry.vocab import GREEK

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["linked_mentions", "rejected_statements", "rejected_mentions"])
def test_windows_are_searched_once_for_each_class(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lyed(") + plan.count("(lyed)") <= 2
    assert not [line for line in plan.splitlines() if "Filter " in line and "lyed" in line]


def test_amounts_are_searched_once(spark):
    """Six patterns find quantities: four with fractions, two without; prices and lists of what was seen read what they found."""
    rows = [("d", 0, "τιμης πυρου αρταβαι 3 δραχμαι 8", "τιμης πυρου αρταβαι 3 δραχμαι 8")]
    found = linking.events(spark.createDataFrame(rows, "ddb_id string, block_no int, raw string, value_text string"), GREEK, every_block=True)
    found = linking.distinct_values(linking.distinct_values(found, "qtys"), "amounts")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(GREEK.unit_core) == 6 and plan.count(GREEK.money_core) == 6
    assert plan.count(GREEK.near_admin) == 1
    assert [(e["value"], e["unit"]) for e in found.first()["prices"]] == [("8", "δραχμαι")]


def test_windows_are_shuffled_without_their_texts(spark):
    docs = spark.createDataFrame([("d", "πυρου 1 πυρου 2 " + "α " * 30 + "σιτου 3"), ("d", "α κριθησ 4")], "ddb_id string, text string")
    found = windows.windows(docs, GREEK)
    plan, sorted_columns = found._jdf.queryExecution().optimizedPlan(), []
    while plan.children().size():
        plan = plan.children().apply(0)
        if plan.nodeName() == "Window":
            sorted_columns.append({c.split("#")[0] for c in plan.children().apply(0).output().mkString(" ").split()})
    assert sorted_columns and not any(c & {"text", "_norm"} for c in sorted_columns)
    assert sorted((r["grain_form"], r["char_offset"]) for r in found.collect()) == [("πυρου", 0), ("σιτου", 76)]


def test_events_at_count_blanks_as_token_at_does(spark):
    """Tokens and places of a search are those of ``matches``, also with groups, at the text's ends and without a match."""
    words = spark.createDataFrame([("πυρου a  3 δραχμαι\tb δραχμαι 4",), ("",), ("a b",), ("3 δραχμαι",), ("δραχμαι 3 δραχμαι 3",)], "s string")
    c, pattern = F.col("s"), r"([0-9]+) (δραχμ\S*)"
    shape = "struct<found:string,tok:int,start:int,k:int,unit:string>"
    got = words.select(text.events_at(c, pattern, shape, lambda m, tok, start, k: F.struct(m[0].alias("found"), tok.alias("tok"), start.alias("start"), k.alias("k"), m[2].alias("unit")), 2))
    want = words.select(F.transform(text.matches(c, pattern, 2), lambda m, k: F.struct(m["found"], text.token_at(c, m["start"]), m["start"], k, m["g2"])))
    assert [[tuple(x) for x in r[0]] for r in got.collect()] == [[tuple(x) for x in r[0]] for r in want.collect()]


@pytest.mark.parametrize("name", ["linked_table", "rejected_table"])
def test_classes_are_compiled_and_amounts_kept_for_refused_mentions(spark, name):
    """The class patterns stand outside of lambdas; the refused table joins no metadata and looks for amounts above the mentions."""
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "lyed" in line and "lambda" in line]
    if name == "rejected_table":
        assert "Join" not in plan and plan.index("(?:andr|thes)") < plan.index("lyed")
