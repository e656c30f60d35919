"""I-Match fingerprints over randomised lexicons, and their likeness, in DataFrame functions alone.

The lexicon holds the terms whose document frequency lies within a band of inverse document
frequency, counted over distinct texts, so copies of a text do not push its terms out of the band;
texts with the same set of terms count as one. A text's distinct lexicon terms, sorted, are hashed once
for each of several random subsets of the lexicon; subsets of several sizes serve short and long
texts alike. Since a term of the band is in a fixed share of the distinct texts, the lexicon has
at most (distinct terms a text) / (least share) terms, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, stored

#: A lexicon term is in at least one of 100 distinct texts and at most one of 20.
LEAST, MOST = 0.01, 0.05
#: Independent draws of subsets, and the share of the lexicon in each size of subset: one of these.
DRAWS, SHARES = 4, (8, 32, 128, 512)


def terms(text: Column) -> Column:
    """The distinct terms (runs of letters and digits, lower case) as 64-bit hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """``term`` hashes within the band."""
    own = docs.select(F.sort_array(terms(F.col("text"))).alias("own")).select(F.xxhash64("own").alias("key"), "own")
    # map-side aggregation leaves one row of a text in each task
    own = own.groupBy("key").agg(F.first("own").alias("own"))
    # each distinct text also counts once under null, so the null row has their number
    seen = own.select(F.explode(F.concat("own", F.array(F.lit(None).cast("long")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = seen.agg(F.max(F.when(F.col("term").isNull(), F.col("df"))).alias("docs"))
    # one row against the terms
    return seen.join(F.broadcast(n)).filter(F.col("term").isNotNull() & (F.col("df") >= least * F.col("docs")) & (F.col("df") <= F.greatest(F.lit(1.0), most * F.col("docs")))).select("term")


def kept(text: Column, words: Column) -> Column:
    """The lexicon terms of a text, sorted. ``words``: the whole lexicon, one array."""
    return F.sort_array(F.array_intersect(terms(text), words))


def signature(own: Column) -> Column:
    """An int for each subset, null where the text has none of its terms."""

    def chosen(d: int, share: int) -> Callable[[Column], Column]:
        return lambda h: F.xxhash64(h, F.lit(d)).bitwiseAND(F.lit(share - 1)) == 0

    def draws(own: Column) -> Column:
        out = []
        for d in range(DRAWS):
            part = own
            for share in SHARES:
                part = F.filter(part, chosen(d, share))
                out.append(F.when(F.size(part) > 0, F.hash(part)))
        return F.array(*out)

    # a transform over one element, so that the terms are found once for all subsets
    return F.get(F.transform(F.array(own), draws), F.lit(0))


def shown(sig: Column, text: Column) -> Column:
    """The fingerprint as text; that of a text without lexicon terms is a hash of the whole text."""
    parts = F.transform(sig, lambda s: F.coalesce(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit("")))
    return F.when(F.exists(sig, lambda s: s.isNotNull()), F.array_join(parts, ".")).otherwise(F.concat(F.lit("t"), F.hex(F.xxhash64(text))))


def likeness(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """The share of subsets on which two signatures agree, of those that either text reaches."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    reached = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: F.coalesce(p["a"] == p["b"], F.lit(False))))
    return F.when(reached > 0, same.cast("double") / reached).otherwise((fa == fb).cast("double"))


def _following(docs: DataFrame, spare: int) -> DataFrame:
    """``doc_id, text, sig`` with ``next_text, next_sig``: those of the next row by falling doc_id.

    Rows are dealt by ranges of the id, at quantiles; each range also gets a copy of the first row
    of the next one, so every row finds its follower within its own range.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    docs = docs.withColumn("key", key)
    count = max(2, min(4096, 4 * spare))
    cuts = docs.agg(F.percentile_approx("key", [k / count for k in range(1, count)], 20 * count)).collect()[0][0]
    cuts = sorted(set(cuts or []))
    at = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c < F.col("key"))) if cuts else F.lit(0)
    docs = docs.withColumn("range", at)
    tops = sorted((r["range"], r["top"]) for r in docs.groupBy("range").agg(F.max("key").alias("top")).collect())
    if not tops:
        return docs.withColumns({"next_text": F.col("text"), "next_sig": F.col("sig")})
    # at most 4096 ids: the first row of each range goes to the range above, the topmost to the lowest
    to = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
    goes = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
    heads = docs.filter(F.col("key").isin(list(to))).withColumn("range", F.element_at(goes, F.col("key"))).withColumn("copy", F.lit(1))
    order = Window.partitionBy("range").orderBy("copy", F.desc("key"), F.desc("text"))
    rows = docs.withColumn("copy", F.lit(0)).unionByName(heads)
    return rows.withColumns({"next_text": F.lead("text").over(order), "next_sig": F.lead("sig").over(order)}).filter("copy = 0")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, with likeness to that and to the next one.

    A null text counts as empty. Rows with equal ids follow one another by falling text; null ids
    come last. A single row is its own follower. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = stored(lexicon(docs).agg(F.array_sort(F.collect_list("term")).alias("words")), "lexicon").scalar()
    signed = docs.withColumn("kept", kept(F.col("text"), words)).withColumn("sig", signature(F.col("kept"))).drop("kept")
    rows = _following(signed, buckets(spark))
    n = F.length("text")
    rows = rows.select("doc_id", "text", "sig", "next_text", "next_sig", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - F.floor(n / 3).cast("int")), F.left("next_text", F.floor(n / 3).cast("int"))).alias("edited"))
    rows = rows.withColumn("kept", kept(F.col("edited"), words)).withColumn("edited_sig", signature(F.col("kept")))
    rows = rows.select("doc_id", "n_chars", "sig", "next_sig", "edited_sig", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("sig"), F.col("text")).alias("fingerprint"), shown(F.col("edited_sig"), F.col("edited")).alias("edited_fingerprint"), shown(F.col("next_sig"), F.col("next_text")).alias("next_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("sig"), F.col("edited_sig"), F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig"), F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
