"""Ranked lexical search: term-bucketed postings, joined with the items' terms and summed by document.

Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased. A
posting is one term of one document with its count; postings are stored sorted by the bucket of their
term, so that a search reads the pages of its terms' buckets. All arithmetic after the weights is in
64-bit integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, stored

#: Buckets of terms, and the bucket of the rows that tell a document's length.
BUCKETS, LENGTHS = 64, -1
#: Postings in one Arrow batch, and pairs of item and document that one task sums, about.
BATCH, PAIRS = 200_000, 2_000_000
#: What the score's whole numbers mean: a smoothed share of the document, longer ones counting less.
SHARE, STEEP, FLOOR, SLOPE = 1_000_000_000, 1000, 12, 25

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_POSTING = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.binary()), ("tf", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8: in UTF-8 all bytes beyond ASCII belong to terms."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's length (the row without a term) and its distinct terms with their counts."""
    for batch in batches:
        columns = [[] for _ in _POSTING]
        for doc, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found = terms(text)
            counts = Counter(found)
            for column, more in zip(columns, ([doc] * (len(counts) + 1), [doc_id] * (len(counts) + 1), [len(found)] * (len(counts) + 1), [None, *counts], [0, *counts.values()])):
                column += more
            if len(columns[0]) >= BATCH:
                yield pa.record_batch(columns, _POSTING)
                columns = [[] for _ in _POSTING]
        if columns[0]:
            yield pa.record_batch(columns, _POSTING)


def _bucket(term: Column) -> Column:
    return F.when(term.isNull(), F.lit(LENGTHS)).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def postings(docs: DataFrame) -> DataFrame:
    """``bucket, term, doc, doc_id, n, tf`` of ``docs(doc_id, text)``, written to the shared folder.

    Every row of ``docs`` is a document of its own, also where ids repeat or are null: ``doc`` numbers
    the rows. ``n`` is its length in terms. A null or termless text has only the row of its length, in
    bucket -1. Rows keep the place of their document, sorted by bucket within a file, so nothing is
    shuffled and a frequent term lies in every file. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_posted, "doc long, doc_id long, n long, term binary, tf long")
    keyed = out.withColumn("bucket", _bucket(F.col("term")))
    return stored(keyed.select("bucket", "term", "doc", "doc_id", "n", "tf").sortWithinPartitions("bucket"), "postings")


def item_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``item, item_id`` and ``item, term, times`` of ``items(item_id, text)``.

    Rows that repeat in full are one item; others are items of their own, also where ids repeat.
    """
    rows = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).distinct()
    named = stored(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    shape = pa.schema([("item", pa.int64()), ("term", pa.binary()), ("times", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, t, c) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t, c in Counter(terms(text)).items()]
            yield pa.record_batch([list(x) for x in zip(*found)] if found else [[], [], []], shape)

    return named.select("item", "item_id"), named.select("item", "text").mapInArrow(split, "item long, term binary, times long")


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0.

    ``index`` comes from ``postings``. Equal scores stand by ascending id, null ids last, then by the
    rows' order. An item without terms (null, empty, signs only) or whose terms no document holds has
    no rows; nor has anything where no document holds a term. Items are joined with the postings by
    bucket and term; what matches goes to its document's partition, and each match is scored there
    and summed for each item and document. How many partitions there are follows from the pairs of
    item and document that one task can sum. Sums beyond 64 bits raise.
    """
    names, asked = item_terms(items)
    asked = stored(asked, "item_terms")
    total = index.filter(F.col("bucket") == LENGTHS).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 0
    wanted = asked.select("term").distinct().withColumn("bucket", _bucket(F.col("term")))
    # the items' terms are joined as Spark sees fit: broadcast while they are few, else by a shuffle
    held = index.filter(F.col("bucket") != LENGTHS).join(wanted, ["bucket", "term"])
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    known = stored(df.select("term", weight.alias("w"), F.monotonically_increasing_id().alias("term_no")).filter("w > 0"), "terms")
    length = F.expr(f"{100 - SLOPE}L + ({SLOPE}L * n * {n_docs}L) div {max(n_terms, 1)}L")
    share = F.expr(f"({SHARE}L * tf) div ({STEEP}L * tf + {FLOOR}L * m)")
    count = items.count()
    parts = max(buckets(index.sparkSession), -(-n_docs * count // PAIRS))
    found = index.filter(F.col("bucket") != LENGTHS).join(known.select("term", "term_no"), "term").withColumn("m", length)
    found = found.select("doc", "doc_id", "term_no", share.alias("share")).repartition(parts, "doc")
    weighted = asked.join(known, "term").select("item", "term_no", (F.col("times") * F.col("w")).alias("w"))
    sums = found.join(weighted, "term_no").groupBy("item", "doc", "doc_id").agg(F.sum(F.col("w") * F.col("share")).alias("score")).filter("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc")
    best = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


_LOW = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
_TERMS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def sql(k: int = 20) -> str:
    """The same over ``documents`` and ``benchmark`` in DuckDB, where no id repeats."""
    return f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), p AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
t AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM p), c AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM c, t GROUP BY term),
i AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * (({SHARE} * tf) // ({STEEP} * tf + {FLOOR} * ({100 - SLOPE} + ({SLOPE} * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN c USING (term), t GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {k}"""
