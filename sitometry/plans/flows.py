"""The flows from files to analysable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import binned, in_drachmas, in_litres, inferred_year, log10, passing, to_float, unit_price
from ..functions.text import by_prefix, cleaned, normalized, place
from ..operators import analysis, candidates, harvest, linking
from ..operators.candidates import Choice
from ..sources import epidoc
from ..vocab import GREEK, Profile


def harvested(spark: SparkSession, texts: str, headers: str, profile: Profile = GREEK) -> DataFrame:
    """Candidate documents of a folder of texts with a folder of metadata."""
    blocks = epidoc.blocks_of(epidoc.parsed(epidoc.read_xml(spark, texts)))
    return harvest.ranked(harvest.with_metadata(harvest.candidates(blocks, profile), epidoc.metadata(epidoc.read_xml(spark, headers))))


#: The commodity, unit and currency of the main price series.
MAIN_SERIES = {"grain": "wheat (pyros)", "unit": "artaba", "currency": "drachma"}


def main_series(cleaned: DataFrame) -> DataFrame:
    return analysis.only(cleaned, **MAIN_SERIES)


def gated(blocks: DataFrame, profile: Profile, need_unit: bool = False) -> DataFrame:
    """Blocks with a valued number whose raw text speaks of a commodity and of money or the price word, and
    if asked of a unit; ``raw_norm`` keeps that text normalised."""
    good = blocks.filter(F.size("num_values") > 0).withColumn("raw_norm", normalized("raw"))
    norm = F.col("raw_norm")
    speaks = norm.rlike(profile.grain) & (norm.rlike(profile.money) | norm.rlike(profile.priceword))
    return passing(good, speaks & norm.rlike(profile.unit) if need_unit else speaks)


def doc_key(blocks: DataFrame) -> Column:
    """What tells a block's document: its path where it has one, since two files may carry one id."""
    return (F.col("path") if "path" in blocks.columns else F.col("ddb_id")).cast("string")


def extracted(blocks: DataFrame, profile: Profile = GREEK, need_unit: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Linked and rejected mentions of the gated blocks."""
    m = linking.mentions(linking.events(gated(blocks, profile, need_unit), profile), profile)
    return linking.linked(m, profile, **options), linking.rejected(m)


def candidate_links(blocks: DataFrame, profile: Profile = GREEK, need_unit: bool = False, window: int = 80, least: float = 25.0, choice: Choice = Choice(), top: int = 1, primary: str = "also", keep: list[str] | None = None) -> DataFrame:
    """The candidates of each mention, with one of them primary: prices are shared out within a block.

    The blocks are dealt once; all that follows reads a block's own lists and stays where the block is.
    ``keep``: the candidates' columns wanted beside those that the choice reads; all of them where it is None.
    """
    # were the number the same constant in every row, it would fall out of the later keys, which would then not match the dealt ones
    number = F.coalesce(F.when(F.col("doc").isNotNull(), F.col("block_no")), F.col("block_no"))
    texts = linking.normed(gated(blocks, profile, need_unit), profile).withColumn("doc", doc_key(blocks)).withColumn("block_no", number)
    # dealt where Python has normalised them: Spark does not know how rows lie that come from Python. In a stated number of parts: a block's
    # candidates are many times its text, by whose size alone Spark would join parts
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = linking.events(texts.repartition(parts, *candidates.KEYS), profile)
    mentions = candidates.accepted(linking.mentions(found, profile), profile, window, listed=True)
    ranked = candidates.ranked(mentions, None, None, window, least, choice)
    if keep is not None:
        ranked = ranked.select(*dict.fromkeys([*candidates.CHOICE, *keep]))
    return candidates.emitted(candidates.assigned(ranked, choice), top, primary)


def cleaned_rows(rows: DataFrame, profile: Profile = GREEK, width: int = 25) -> DataFrame:
    """Canonical names, numbers, years, bins and standard prices of linked rows.

    Reads grain_form, qty_value, qty_unit, price_value, price_cur, place, date_when, date_notbefore,
    date_notafter and context_window.
    """
    c = F.col
    out = rows.withColumns(
        {
            "grain": by_prefix(normalized("grain_form"), profile.grains),
            "unit": by_prefix(normalized("qty_unit"), profile.units),
            "currency": by_prefix(normalized("price_cur"), profile.currencies),
            "place_canon": place(normalized("place"), profile),
            "qty": to_float(c("qty_value")),
            "price": to_float(c("price_value")),
            "year": inferred_year(c("date_when"), c("date_notbefore"), c("date_notafter")),
            "context_window": cleaned(c("context_window")),
        }
    )
    out = out.withColumns({"year_bin": binned(c("year"), width), "unit_price_raw": unit_price(c("price"), c("qty")), "price_drachma": in_drachmas(c("price"), c("currency")), "qty_litres": in_litres(c("qty"), c("unit"))})
    out = out.withColumn("price_per_litre", F.when(c("qty_litres") > 0, c("price_drachma") / c("qty_litres")))
    return out.withColumns({"price_per_artaba": c("price_per_litre") * 38.8, "log10_price_per_litre": log10(c("price_per_litre"))})
