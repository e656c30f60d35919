import pytest

from sitometry.operators import harvest
from sitometry.sources import corpus, epidoc
from sitometry.streaming import ingest
from sitometry.vocab import GREEK

XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><publicationStmt><idno type="ddb-hybrid">{id}</idno></publicationStmt></teiHeader><text><body><div type="edition"><ab>πυροῦ δραχμαὶ <num value="{n}">x</num></ab></div></body></text></TEI>"""


def put(folder, name, n, ident=None):
    (folder / f"{name}.xml").write_text(XML.format(id=ident or f"bgu;1;{name}", n=n), encoding="utf-8")


def told(docs):
    return sorted(((r["path"].rsplit("/")[-1], r["ok"], r["ddb_id"], repr(r["blocks"])) for r in docs.collect()), key=repr)


def same_as_fresh(spark, folder, store):
    want = epidoc.parsed(epidoc.read_xml(spark, str(folder)))
    assert told(corpus.documents(spark, store)) == told(want)
    blocks = epidoc.blocks_of(corpus.documents(spark, store))
    assert sorted(map(repr, harvest.candidates(blocks, GREEK).collect())) == sorted(map(repr, harvest.candidates(epidoc.blocks_of(want), GREEK).collect()))


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "texts" / "a").mkdir(parents=True)
    for k in range(4):
        put(tmp_path / "texts" / "a", str(k), k)
    (tmp_path / "texts" / "bad.xml").write_text("<TEI", encoding="utf-8")
    return tmp_path / "texts"


def test_the_store_follows_the_folder(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    assert corpus.documents(spark, store).count() == 0
    assert corpus.refresh(spark, str(folder), store) == {"same": 0, "new": 5, "changed": 0, "removed": 0}
    same_as_fresh(spark, folder, store)
    assert corpus.refresh(spark, str(folder), store) == {"same": 5, "new": 0, "changed": 0, "removed": 0} and corpus.version(spark, store) == 1
    put(folder / "a", "1", 17)
    put(folder / "a", "new", 5)
    (folder / "a" / "3.xml").unlink()
    assert corpus.refresh(spark, str(folder), store) == {"same": 3, "new": 1, "changed": 1, "removed": 1}
    same_as_fresh(spark, folder, store)
    # only what was new or changed was parsed again
    assert spark.read.parquet(f"{store}/documents-2").count() == 2
    (folder / "bad.xml").write_text(XML.format(id="bgu;1;bad", n=1), encoding="utf-8")
    assert corpus.refresh(spark, str(folder), store)["changed"] == 1
    assert epidoc.errors_of(corpus.documents(spark, store)).count() == 0
    corpus.compact(spark, store)
    same_as_fresh(spark, folder, store)
    for f in folder.rglob("*.xml"):
        f.unlink()
    put(folder, "last", 3)
    assert corpus.refresh(spark, str(folder), store) == {"same": 0, "new": 1, "changed": 0, "removed": 5}
    same_as_fresh(spark, folder, store)


def test_a_refresh_that_failed_is_run_again(spark, folder, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    corpus.refresh(spark, str(folder), store)
    put(folder / "a", "0", 99)
    with monkeypatch.context() as m:
        m.setattr(corpus.F, "max", lambda *_: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            corpus.refresh(spark, str(folder), store)
    spark.createDataFrame([("junk", "x", True, "y", 2)], corpus.MANIFEST).write.parquet(f"{store}/manifest-2")
    assert corpus.version(spark, store) == 1 and corpus.refresh(spark, str(folder), store)["changed"] == 1
    same_as_fresh(spark, folder, store)


def test_stream_takes_the_last_of_a_changed_file(spark, folder, tmp_path):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    ingest.harvest_new(spark, str(folder), out, marks).awaitTermination()
    put(folder, "again", 77, "bgu;1;2")
    ingest.harvest_new(spark, str(folder), out, marks).awaitTermination()
    rows = ingest.latest(spark, out).collect()
    assert sorted(r["ddb_id"] for r in rows) == [f"bgu;1;{k}" for k in range(4)]
    assert {r["ddb_id"]: r["num_tag_values"] for r in rows}["bgu;1;2"] == ["77"]
