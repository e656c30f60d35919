import re

import pytest
from pyspark.sql import functions as F

from sitometry.functions import numbers, text
from sitometry.vocab import GREEK


def values(spark, rows, column, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_to_float(spark):
    assert values(spark, ["3/4", "1/0", "2.5", "x", "", None, "nan"], numbers.to_float(F.col("s"))) == [0.75, None, 2.5, None, None, None, None]


def test_shown_and_fractions(spark):
    got = values(spark, ["3", "", None], numbers.shown(numbers.int_and_fractions(F.col("s"), F.lit(" 1/2 1/4"))))
    assert got == ["3.75", "0.75", "0.75"]
    assert values(spark, [1 / 3, 4.0], numbers.shown(F.col("s")), "s double") == ["0.333333", "4"]


def test_years(spark):
    assert values(spark, ["-0258-10-27", "0101", "x", None], numbers.iso_year(F.col("s"))) == [-258.0, 101.0, None, None]
    assert values(spark, [-257.0, 101.0], numbers.binned(F.col("s"), 25), "s double") == [-275, 100]
    row = numbers.inferred_year(F.lit(None).cast("string"), F.lit("-0030"), F.lit("0014"))
    assert values(spark, ["a"], row) == [-8.0]


def test_conversions(spark):
    assert values(spark, ["mina", "as", None], numbers.in_drachmas(F.lit(2.0), F.col("s"))) == [200.0, None, None]


def test_score_bin_quirk(spark):
    assert values(spark, [0.0, 10.0, 10.5, 11.0, 80.0, 81.0], numbers.score_bin(F.col("s")), "s double") == ["00-10", "00-10", "01-10", "11-20", "71-80", None]
    assert "01-10" not in numbers.bin_labels()


def test_normalized(spark):
    assert values(spark, ["  Πυροῦ  ΤΙΜΆΣ ", None, "½"], text.normalized("s")) == ["πυρου τιμασ", "", "1⁄2"]


@pytest.mark.parametrize("pattern", [GREEK.grain, GREEK.unit, GREEK.money])
def test_patterns_match_like_python(spark, pattern):
    import regex

    words = ["πυρου αρταβαι 2", "σιτικης δραχμων 40", "κριθην, πυρ", "απυρος", "𐅵 χοινικες μνα", ""]
    got = values(spark, words, text.matches(F.col("s"), pattern))
    for w, found in zip(words, got):
        assert [(m.group(), m.start()) for m in regex.finditer(pattern, w)] == [(f["found"], f["start"]) for f in found]


def test_json_object(spark):
    assert values(spark, ['```json\n{"a": 1}\n```', "no", 'x {"a": {"b": 2}} y'], text.json_object(F.col("s"))) == ['{"a": 1}', None, '{"a": {"b": 2}}']


def test_place_first_pattern_wins(spark):
    assert values(spark, ["oxyrhynchos", "", "memphis theb", "x"], text.place(F.col("s"), GREEK)) == ["Oxyrhynchite", "Unknown", "Memphite", "Unknown"]


def test_word_class_spells_out_python():
    assert re.fullmatch(r"\w", "½") and not re.fullmatch(r"\w", "́")
