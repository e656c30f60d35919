"""The tables of the extraction: linked rows, block mentions and refused mentions, from one stored parse."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import passing
from ..functions.text import token_window
from ..operators import candidates, linking
from ..operators.candidates import KEYS, Choice
from ..sources.scratch import stored
from ..vocab import GREEK, Profile
from .flows import doc_key, gated

# The tables' columns in their order.
METADATA = {"Title": "title", "Place": "place", "Date_Text": "date_text", "Date_When": "date_when", "Date_NotBefore": "date_notbefore", "Date_NotAfter": "date_notafter"}
_ABOUT = ", ".join(f"{c} string" for c in METADATA)
MENTIONS = f"DDB_ID string, Mention_ID int, Block_Tag string, {_ABOUT}, Grain_Hits string, Unit_Hits string, Money_Hits string, Priceword_Hit string, Number_Hit string, Number_Type string, Num_Tag_Values string, Num_Tag_Texts string, Quantities string, Prices string, Raw_Block string, Value_Block string"
LINKED = (
    f"DDB_ID string, Mention_ID int, Grain_Index int, Candidate_Rank int, Is_Primary string, Block_Tag string, {_ABOUT}, Grain_Form string, Qty_Value string, Qty_Unit string, Price_Value string, Price_Cur string, "
    "Score double, Dist_GP int, Dist_GQ int, Span_Toks int, Lines_Crossed int, Priceword_Near string, Pos_Signal_Near string, Ambiguous string, AltScore string, Alt_Qty string, Alt_Price string, "
    "Context_Window string, Context_Type string, Signal_Type string, Signal_Strength double, Neg_Signals string, Rejection_Reason string"
)
REJECTED = "DDB_ID string, Mention_ID int, Grain_Form string, Context_Type string, Signal_Strength double, Neg_Signals string, Rejection_Reason string, Context_Window string"


class Tables(NamedTuple):
    linked: DataFrame
    mentions: DataFrame
    rejected: DataFrame


def statements(blocks: DataFrame, profile: Profile = GREEK, metadata: DataFrame | None = None, need_unit: bool = False, window: int = 80, least: float = 25.0, several: bool = False, choice: Choice = Choice(), top: int = 1, primary: str = "also", keep: int = 2000, store: bool = True) -> Tables:
    """``linked`` (34 columns), ``mentions`` (21) and ``rejected`` (8) of ``blocks``.

    Gated blocks are numbered through their document; a block without events keeps its number and its row in ``mentions``. Links
    and refusals come from blocks with a commodity and a price. ``several``: each mention with its candidates, one of them
    primary; else one row a mention. ``metadata`` has a row for each ``ddb_id``; what is missing is the empty text.
    The blocks are normalised and searched once: what was found is stored, and the three tables read it. Without
    ``store`` each table searches the blocks itself, for what it needs, and nothing is written: for callers of one table.
    """
    parse = _parsed(blocks, profile, metadata, need_unit)
    if store or several:
        # the tokens are cut again from their texts, which is quicker than to store them
        parse = stored(parse.drop("tokens", "value_tokens"), "statements").withColumns(linking.tokens_of(fixed=False))
    with_price = passing(parse, (F.size("grains") > 0) & (F.size("prices") > 0))
    m = linking.mentions(with_price, profile)
    index = F.array_position("grains", F.col("grain")).cast("int")
    if several:
        sides = [candidates.long_events(with_price, c, profile) for c in ("prices", "qtys")]
        ranked = stored(candidates.ranked(candidates.accepted(m, profile), *sides, window, least, choice), "candidates")
        rows = candidates.emitted(candidates.assigned(ranked, choice), top, primary).withColumn("grain_form", F.col("form"))
        # a row's words are cut from its block
        rows = rows.join(with_price.select(*KEYS, "mention_id", "tag", "value_tokens", *METADATA), KEYS)
        rows = rows.withColumn("context_window", token_window(F.col("value_tokens"), F.col("low_tok") - 8, F.col("high_tok") + 8))
    else:
        rows = linking.linked(m.withColumn("grain_index", index), profile, window, least).withColumns({"grain_form": F.col("grain.form"), **{c: F.lit("") for c in ("alt_score", "alt_qty", "alt_price")}})
    gone = m if store or several else _refused(_numbered(blocks, profile, need_unit), profile)
    return Tables(_linked(rows, keep), _mentions(parse, keep), _rejected(linking.rejected(gone)))


def _refused(numbered: DataFrame, profile: Profile) -> DataFrame:
    """The refused mentions of blocks with a price: amounts are looked for only where a mention is refused."""
    gone = passing(linking.mentions(linking.commodities(numbered, profile, every_block=True), profile), linking.refused())
    return passing(linking.with_amounts(gone, profile), F.size("prices") > 0)


def _numbered(blocks: DataFrame, profile: Profile, need_unit: bool) -> DataFrame:
    """The gated blocks, numbered through their document."""
    g = gated(blocks, profile, need_unit).withColumn("doc", doc_key(blocks))
    place = [c for c in ("div_no", "block_no") if c in g.columns]
    return g.withColumn("mention_id", F.row_number().over(Window.partitionBy("doc").orderBy(*place)))


def _parsed(blocks: DataFrame, profile: Profile, metadata: DataFrame | None, need_unit: bool) -> DataFrame:
    """Each gated block with its number in the document, its hits and its events."""
    g = _numbered(blocks, profile, need_unit)
    about = {c: F.lit("") for c in METADATA}
    if metadata is not None:
        # joined before the events are found: a shuffle of the blocks carries their texts alone
        known = metadata.select(F.col("ddb_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in METADATA.values()])
        g = g.join(known, F.col("ddb_id") == F.col("_id"), "left")
        about = {name: F.coalesce(F.col(f"_{c}"), F.lit("")) for name, c in METADATA.items()}
    found = linking.events(linking.block_hits(g, profile), profile, every_block=True)
    for c in ("qtys", "amounts"):
        found = linking.distinct_values(found, c)
    kept = ["ddb_id", "mention_id", "raw", "value_text", "num_values", "num_texts", "priceword_hit", "grain_hits", "unit_hits", "money_hits", "qtys_seen", "amounts_seen", "norm", "tokens", "value_tokens", "has_unit", "grains", "stops", "qtys", "prices", "pricewords"]
    tag = F.col("tag") if "tag" in found.columns else F.lit("")
    return found.withColumns({**about, "tag": tag}).select(*KEYS, "tag", *METADATA, *kept)


def _yes(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def _row(df: DataFrame, shape: str, **values: Column) -> DataFrame:
    """The columns of a shape, by name: given ones, else the table's own column of that name."""
    fields = [f.rsplit(" ", 1) for f in shape.split(", ")]
    return df.select(*[values.get(name, F.col(name.lower() if name.lower() in df.columns else name)).cast(kind).alias(name) for name, kind in fields])


def _mentions(parse: DataFrame, keep: int) -> DataFrame:
    joined = {name: F.array_join(c, ";") for name, c in {"Grain_Hits": "grain_hits", "Unit_Hits": "unit_hits", "Money_Hits": "money_hits", "Num_Tag_Values": "num_values", "Num_Tag_Texts": "num_texts", "Quantities": "qtys_seen", "Prices": "amounts_seen"}.items()}
    shown = {"Raw_Block": F.left(linking.collapsed(F.col("raw")), F.lit(keep)), "Value_Block": F.left(linking.collapsed(F.col("value_text")), F.lit(keep))}
    return _row(parse, MENTIONS, Block_Tag=F.col("tag"), Priceword_Hit=_yes(F.col("priceword_hit")), Number_Hit=F.concat(F.lit("num:"), F.get("num_values", F.lit(0))), Number_Type=F.lit("num_tag"), **joined, **shown)


def _linked(rows: DataFrame, keep: int) -> DataFrame:
    c = F.col
    event = {"Qty_Value": "qty.value", "Qty_Unit": "qty.unit", "Price_Value": "price.value", "Price_Cur": "price.unit"}
    return _row(
        rows, LINKED, Block_Tag=c("tag"), **{name: F.coalesce(c(e), F.lit("")) for name, e in event.items()}, Score=F.round("score", 2), Lines_Crossed=F.lit(0), Priceword_Near=_yes(c("priceword_near")),
        Pos_Signal_Near=_yes(c("class.strength") > 0), AltScore=c("alt_score"), Context_Window=F.left(c("context_window"), F.lit(keep)), **_classes(c("class.reason")),
    )


def _rejected(rows: DataFrame) -> DataFrame:
    reason = F.when(F.col("class.reason") != "", F.col("class.reason")).otherwise(F.concat(F.lit("context="), F.col("class.context")))
    return _row(rows, REJECTED, Grain_Form=F.col("grain.form"), **{k: v for k, v in _classes(reason).items() if k != "Signal_Type"})


def _classes(reason: Column) -> dict[str, Column]:
    c = F.col
    return {"Context_Type": c("class.context"), "Signal_Type": F.array_join("class.positive", ","), "Signal_Strength": F.round("class.strength", 2), "Neg_Signals": F.array_join("class.negative", ","), "Rejection_Reason": reason}
