import pytest
from pyspark.sql import functions as F

from sitometry.operators.candidates import Choice
from sitometry.plans import statements
from sitometry.sources import epidoc
from sitometry.vocab import GREEK

XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><publicationStmt><idno type="ddb-hybrid">{id}</idno></publicationStmt></teiHeader><text><body><div type="edition">{blocks}</div></body></text></TEI>"""
GOOD = "<ab>τιμῆς πυροῦ ἀρταβῶν <num value='2'>β</num> δραχμὰς <num value='40'>μ</num></ab>"
TAX = "<ab>δημοσίων πυροῦ ἀρτάβας <num value='3'>γ</num> δραχμὰς <num value='8'>η</num></ab>"
NO_PRICE = "<p>δημοσίων σίτου ἀρτάβας <num value='5'/> δραχμή</p>"
NO_NUMBER = "<p>πυροῦ δραχμαὶ</p>"


@pytest.fixture()
def blocks(spark, tmp_path):
    for name, ident, parts in (("a", "o.x;1;36", [NO_NUMBER, GOOD, NO_PRICE, TAX]), ("b", "o.x;1;36", [GOOD]), ("c", "bgu;1;14", [NO_NUMBER])):
        (tmp_path / f"{name}.xml").write_text(XML.format(id=ident, blocks="".join(parts)), encoding="utf-8")
    return epidoc.blocks_of(epidoc.parsed(epidoc.read_xml(spark, str(tmp_path))))


def names(shape):
    return [f.rsplit(" ", 1)[0] for f in shape.split(", ")]


def test_columns():
    assert [len(names(s)) for s in (statements.LINKED, statements.MENTIONS, statements.REJECTED)] == [34, 21, 8]


@pytest.mark.parametrize("several", [False, True])
def test_tables(spark, blocks, several):
    meta = spark.createDataFrame([("o.x;1;36", "A text", "Memphis", None, "0101", "", "")], "ddb_id string, title string, place string, date_text string, date_when string, date_notbefore string, date_notafter string")
    t = statements.statements(blocks, GREEK, meta, several=several)
    assert [x.columns for x in t] == [names(s) for s in (statements.LINKED, statements.MENTIONS, statements.REJECTED)]
    # blocks that pass the gate are numbered in their own file; one without a number has none
    mentions = sorted(tuple(r) for r in t.mentions.select("Mention_ID", "Block_Tag", "Grain_Hits", "Unit_Hits", "Priceword_Hit", "Number_Hit", "Num_Tag_Values", "Num_Tag_Texts", "Quantities", "Prices", "Title", "Date_Text").collect())
    good = ("ab", "πυρου", "αρταβων", "yes", "num:2", "2;40", "β;μ", "2 αρταβων", "2 δραχμασ;40 δραχμασ", "A text", "")
    assert mentions == [(1, *good), (1, *good), (2, "p", "σιτου", "αρταβασ", "no", "num:5", "5", "", "5 αρταβασ", "5 δραχμη", "A text", ""), (3, "ab", "πυρου", "αρταβασ", "no", "num:3", "3;8", "γ;η", "3 αρταβασ", "3 δραχμασ;8 δραχμασ", "A text", "")]
    linked = t.linked.orderBy("Mention_ID").collect()
    assert {(r["DDB_ID"], r["Mention_ID"], r["Grain_Form"], r["Price_Value"], r["Qty_Value"], r["Candidate_Rank"], r["Is_Primary"], r["Context_Type"]) for r in linked} == {("o.x;1;36", 1, "πυρου", "40", "2", 1, "yes", "PRICE")}
    assert len(linked) == 2 and linked[0]["Place"] == "Memphis" and linked[0]["Context_Window"] == "τιμῆς πυροῦ ἀρταβῶν 2 δραχμὰς 40"
    # a refused mention is told where its block has a price
    rejected = [(r["Mention_ID"], r["Context_Type"], r["Rejection_Reason"]) for r in t.rejected.collect()]
    assert rejected == [(3, "TAX", "no_positive+negative(TAX)")]


def test_debug_amounts_keep_what_links_drop(spark):
    """A price that repeats a quantity is no candidate, but is listed."""
    rows = [("d", 0, "πυρου δραχμαι 3 αρταβαι", "πυρου δραχμαι 3 αρταβαι", ["3"], [])]
    t = statements.statements(spark.createDataFrame(rows, "ddb_id string, block_no int, raw string, value_text string, num_values array<string>, num_texts array<string>"), GREEK, least=0.0)
    assert [(r["Quantities"], r["Prices"], r["Block_Tag"]) for r in t.mentions.collect()] == [("3 αρταβαι", "3 δραχμαι", "")]
    assert t.linked.count() == t.rejected.count() == 0


def test_nothing_passes_the_gate(spark, blocks):
    t = statements.statements(blocks.filter(F.lit(False)), GREEK, several=True, choice=Choice())
    assert [x.count() for x in t] == [0, 0, 0]


def test_one_table_without_a_store(spark, blocks, monkeypatch):
    """The same rows, and nothing is written for them."""
    want = statements.statements(blocks, GREEK)
    monkeypatch.setattr(statements, "stored", lambda *_: pytest.fail("written"))
    got = statements.statements(blocks, GREEK, store=False)
    for a, b in zip(got, want):
        assert a.dtypes == b.dtypes and sorted(a.collect(), key=str) == sorted(b.collect(), key=str) and b.count() > 0
