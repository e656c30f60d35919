"""Harvest: blocks that speak of a priced commodity, gathered into scored candidate documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, normalized
from ..vocab import Profile


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Plain text as blocks: its lines, numbered from 0. Empty lines are no blocks."""
    lines = docs.select(F.col(id_col).alias("ddb_id"), F.posexplode(F.split(text_col, "\n")).alias("block_no", "raw"))
    return lines.filter("trim(raw) <> ''").withColumns({"value_text": F.col("raw"), "num_values": F.array().cast("array<string>"), "num_texts": F.array().cast("array<string>"), "num_tags": F.lit(0)})


def sieved(docs: DataFrame, text_col: str, profile: Profile) -> DataFrame:
    """Only texts that could hold a commodity, by patterns on raw text, before any Python runs.

    Plain ASCII text is normalised by letter case and blanks alone, so the stems are looked for as they stand; text with
    any other character passes, since normalisation may make a stem of it.
    """
    return docs.filter(F.col(text_col).rlike("(?i)" + profile.grain) | F.col(text_col).rlike(r"[^\x00-\x7F]"))


def number_kind(raw: Column, norm: Column, num_tags: Column, profile: Profile) -> Column:
    """num_tag, else digit, else numeral, else NULL."""
    return F.when(num_tags > 0, "num_tag").when(raw.rlike("[0-9]"), "digit").when(norm.rlike(profile.numeral), "greek_numeral")


def gated_blocks(blocks: DataFrame, profile: Profile, need_number: bool = True, need_unit: bool = False) -> DataFrame:
    """Blocks with a commodity word that is no false one, money or the price word, and as asked.

    Cheap patterns stand first; everything after normalisation is a native expression.
    """
    b = blocks.withColumn("raw", collapsed(F.col("raw"))).withColumn("norm", normalized("raw"))
    hits = F.regexp_extract_all("norm", F.lit(profile.grain), 0)
    true_hit = F.exists(hits, lambda h: ~h.rlike("^" + profile.false_grain))
    b = b.filter(F.col("norm").rlike(profile.grain)).filter(true_hit)
    b = b.withColumns({"number": number_kind(F.col("raw"), F.col("norm"), F.col("num_tags"), profile), "has_unit": F.col("norm").rlike(profile.unit), "has_money": F.col("norm").rlike(profile.money), "has_priceword": F.col("norm").rlike(profile.priceword)})
    b = b.filter("has_money or has_priceword")
    if need_number:
        b = b.filter("number is not null")
    return b.filter("has_unit") if need_unit else b


def candidates(blocks: DataFrame, profile: Profile, snippets: int = 3, width: int = 300, **flags: bool) -> DataFrame:
    """One row per document: evidence sets, a score from 0 to 4 and its first snippets.

    Stems are collected, not words. The aggregate combines before its shuffle.
    """
    return gathered(gated_blocks(blocks, profile, **flags), profile, snippets, width)


def gathered(g: DataFrame, profile: Profile, snippets: int = 3, width: int = 300) -> DataFrame:
    """The candidate documents of gated blocks."""
    stem = lambda p: F.array_distinct(F.regexp_extract_all("norm", F.lit(p), 1))
    g = g.withColumns({"grain": stem(profile.grain), "unit": stem(profile.unit), "money": stem(profile.money), "snip": F.left("raw", F.lit(width))})
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    out = g.groupBy("ddb_id").agg(
        F.count(F.lit(1)).cast("int").alias("block_match_count"),
        union("grain").alias("grain_hits"),
        union("unit").alias("unit_hits"),
        union("money").alias("money_hits"),
        F.bool_or("has_priceword").alias("priceword_hit"),
        F.array_sort(F.array_compact(F.collect_set("number"))).alias("number_types"),
        union("num_values").alias("num_tag_values"),
        union("num_texts").alias("num_tag_texts"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("block_no", "snip"))), 1, snippets), lambda s: s["snip"]).alias("snippets"),
    )
    score = (F.size("unit_hits") > 0).cast("int") + (F.size("money_hits") > 0).cast("int") + F.col("priceword_hit").cast("int") + F.array_contains("number_types", "num_tag").cast("int")
    return out.withColumn("score", score)


def with_metadata(found: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join on the document id; missing fields are empty."""
    out = found.join(metadata, "ddb_id", "left")
    return out.fillna("", subset=[c for c in metadata.columns if c != "ddb_id"])


def ranked(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("score"), "ddb_id")
