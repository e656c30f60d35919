import random

import pytest
from pyspark.sql import functions as F

from sitometry.functions import aligned, text
from sitometry.operators import linking, windows
from sitometry.plans import flows
from sitometry.vocab import GREEK

SIGNS = ["a", "B", "é", "é", "ﬁ", "ß", "´", "ͺ", "½", " ", "\n", "İ", "Σ", "ς", "ᾳ", "한", "하", "　", "ﷺ", "́", "῁", "​"]


def test_map_follows_normalisation():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 12)))
        norm, places = aligned.placed(t)
        assert norm == text._searchable(t) and len(norm) == len(places) and places == sorted(places)
        for c, p in zip(norm, places):
            assert c == " " or c in text._searchable(f"x{t[p]}x")
        breaks = aligned.aligned(t)[1]
        for k, p in enumerate(places):
            at, written = [b for b in breaks if b[0] <= k][-1]
            assert written + k - at == p


def test_every_character_is_normalised_alike():
    for code in [*range(1, 0x3000), *range(0xA000, 0xABFF), *range(0xF900, 0x10000), *range(0x1D000, 0x1F200)]:
        t = f"a{chr(code)}b"
        assert aligned.placed(t)[0] == text._searchable(t)


@pytest.mark.parametrize("filler", ["ἄ" * 40 + " ", "ΐ" * 300 + " ", "ﬃ ß " * 40, "´ " * 120, ""])
def test_fixed_windows_hold_the_word(spark, filler):
    import unicodedata

    body = unicodedata.normalize("NFD", filler) + "τιμῆς πυροῦ δραχμαὶ 8" + " ὃ" * 80
    docs = spark.createDataFrame([("d", body), ("e", None), ("f", "")], "ddb_id string, text string")
    fixed = windows.windows(docs, GREEK, fixed=True).collect()
    assert [r["grain_form"] for r in fixed] == ["πυρου"] and "πυροῦ δραχμαὶ 8" in fixed[0]["window_text"]
    plain = windows.windows(docs, GREEK, need_number=False).collect()
    assert [(r["grain_form"], r["char_offset"]) for r in plain] == [(r["grain_form"], r["char_offset"]) for r in fixed]
    if len(unicodedata.normalize("NFD", filler)) > 500:
        assert "πυροῦ" not in plain[0]["window_text"]  # parity: cut at the place in normalised text


def test_fixed_tokens_show_what_is_written(spark):
    value = "´ὃ ´ὃ ´ὃ ´ὃ ´ὃ ´ὃ τιμῆς πυροῦ ἀρτάβας 1 δραχμὰς 8"
    rows = spark.createDataFrame([("d", 0, value, value, ["8"])], "ddb_id string, block_no int, raw string, value_text string, num_values array<string>")
    found = linking.events(flows.gated(rows, GREEK), GREEK, fixed=True)
    row = found.first()
    assert len(row["tokens"]) == len(row["value_tokens"]) and row["value_tokens"][row["grains"][0]["tok"]] == "πυροῦ"
    m = linking.mentions(found, GREEK)
    assert linking.linked(m, GREEK, least=0.0).first()["context_window"].endswith("τιμῆς πυροῦ ἀρτάβας 1 δραχμὰς 8")
    assert spark.range(1).select(aligned.written_tokens(F.lit("")).alias("t")).first()["t"] == [""]
