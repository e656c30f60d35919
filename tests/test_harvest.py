from pyspark.sql import functions as F

from sitometry.operators import harvest
from sitometry.vocab import PROSE


def test_the_sieve_drops_no_candidate(spark):
    """Accented, full-width and ligature forms of an ASCII stem are found with the sieve as without it."""
    texts = ["érina andrōs 3", "Ｅｒｉｎａ andros 3", "ERINA andros 3", "erina andros 3", "xerina andros 3", "tíona thehe 7", "none 3", "ünd 3", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ids = lambda df: sorted(r["ddb_id"] for r in harvest.candidates(harvest.text_blocks(df, "id", "text"), PROSE).collect())
    assert ids(harvest.sieved(docs, "text", PROSE)) == ids(docs) == [0, 1, 2, 3, 5]
    assert harvest.sieved(docs, "text", PROSE).filter(F.col("id").isin(4, 6)).count() == 0
