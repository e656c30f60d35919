"""Events with token positions, context classes, and links from commodities to prices.

All events of a block are arrays in its row, so nearest-event links, competing prices and boundary
checks are array expressions: no join and no shuffle, however many mentions a document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aligned import written_tokens
from ..functions.numbers import bound, clamp, held, int_and_fractions, passing, prox, shown
from ..functions.text import blanks, collapsed, events_at, normalized, token_window
from ..vocab import Profile

NOT_W = r"[^\p{L}\p{N}_]"
WHOLE = rf"([0-9]+)((?:{NOT_W}+(?:[0-9]+/[0-9]+))*)"
PART = r"([0-9]+/[0-9]+)"


def _whole(digits: Column) -> Column:
    """What ``shown`` makes of a whole number; up to 15 digits are exact without a double."""
    return F.when(F.length(digits) <= 15, digits.try_cast("long").cast("string")).otherwise(shown(int_and_fractions(digits, F.lit(""))))


def _amounts(text: Column, unit: str) -> Column:
    """Number-unit pairs in four orders, as ``struct(tok, seq, value, unit)`` in pattern order."""

    def made(k: int, pattern: str, groups: int, number: int, fraction: int | None, name: int) -> Column:
        def event(m: Column, tok: Column, start: Column, i: Column) -> Column:
            if fraction is None:
                value = _whole(m[number])
            else:
                value = shown(int_and_fractions(m[number] if number != fraction else F.lit(""), m[fraction]))
            return F.struct(tok.alias("tok"), (F.lit(k * 1_000_000) + i).alias("seq"), value.alias("value"), m[name].alias("unit"))

        return events_at(text, pattern, "struct<tok:int,seq:int,value:string,unit:string>", event, groups)

    with_parts = F.concat(
        made(0, rf"{WHOLE}{NOT_W}+({unit})", 3, 1, 2, 3),
        made(1, rf"({unit}){NOT_W}+{WHOLE}", 3, 2, 3, 1),
        made(2, rf"{PART}{NOT_W}+({unit})", 2, 1, 1, 2),
        made(3, rf"({unit}){NOT_W}+{PART}", 2, 2, 2, 1),
    )
    # a fraction needs its stroke: a text without one is spared the search for fractions
    whole = F.concat(made(0, rf"([0-9]++){NOT_W}+({unit})", 2, 1, None, 2), made(1, rf"({unit}){NOT_W}+([0-9]+)", 2, 2, None, 1))
    return F.when(text.contains("/"), with_parts).otherwise(whole)


def _raw_norm(blocks: DataFrame) -> Column:
    """The raw text normalised: the gate's own column where the blocks have passed it."""
    return F.col("raw_norm") if "raw_norm" in blocks.columns else normalized("raw")


def _value_norm(blocks: DataFrame) -> Column:
    """The value text normalised: the raw one's form where both texts are the same."""
    if "raw_norm" not in blocks.columns:
        return normalized("value_text")
    same = F.col("value_text") == F.col("raw")
    return F.when(same, F.col("raw_norm")).otherwise(normalized(F.when(same, F.lit(None)).otherwise(F.col("value_text"))))


def normed(blocks: DataFrame, profile: Profile) -> DataFrame:
    """The blocks with ``norm``, their normalised value text, and ``has_unit``; ``events`` then takes both from there."""
    # the gate's unit word is looked for in the raw text
    return blocks.withColumns({"norm": _value_norm(blocks), "has_unit": _raw_norm(blocks).rlike(profile.unit)})


def tokens_of(fixed: bool) -> dict[str, Column]:
    """The tokens of ``norm`` and those written in ``value_text``; see ``events``."""
    return {"tokens": F.split("norm", " "), "value_tokens": written_tokens("value_text") if fixed else F.split(collapsed(F.col("value_text")), " ")}


def events(blocks: DataFrame, profile: Profile, every_block: bool = False, fixed: bool = False) -> DataFrame:
    """``grains, qtys, prices, pricewords`` of each block, with token positions.

    Commodity words within compounds, false stems, verb forms and near an office word are dropped;
    so is a price that repeats a quantity's value within three tokens. Blocks without a commodity are left out, unless
    ``every_block``; ``amounts`` then also holds the prices dropped. Windows for readers count written tokens, which
    drift where normalisation joins or parts words; ``fixed``: they show what is written at the normalised ones.
    """
    b = commodities(blocks, profile, every_block, fixed)
    b = with_amounts(b, profile, pricewords=events_at(F.col("norm"), profile.priceword, "int", lambda m, tok, *_: tok))
    return b if every_block else b.drop("amounts")


def commodities(blocks: DataFrame, profile: Profile, every_block: bool = False, fixed: bool = False) -> DataFrame:
    """``grains`` of each block, its normalised text and tokens, and ``stops``, the places of the boundary words."""
    known = {"norm", "has_unit"} <= set(blocks.columns)
    b = blocks if known else blocks.withColumn("norm", _value_norm(blocks))
    b = b if every_block else passing(b, F.col("norm").rlike(profile.grain))
    # windows for readers show the text as it was written; the gate's unit word is looked for in the raw text
    b = b.withColumns({**tokens_of(fixed), "has_unit": F.col("has_unit") if known else _raw_norm(blocks).rlike(profile.unit)})
    norm, place = F.col("norm"), lambda m, tok, *_: tok
    grain = lambda m, tok, start, _: F.struct(tok.alias("tok"), m[0].alias("form"), start.alias("start"))
    b = held(
        b, _near=events_at(norm, profile.near_admin, "int", place), stops=events_at(norm, rf"(?<![^ ])(?:{profile.boundary})", "int", place),
        _grains=events_at(norm, profile.grain, "struct<tok:int,form:string,start:int>", grain),
    )
    other = rf"(?:{profile.blocked_form})|^(?:{profile.admin_compound})|^(?:{profile.false_grain})"
    keep = lambda g: ~g["form"].rlike(other) & ~F.exists("_near", lambda t: F.abs(g["tok"] - t) <= 10)
    b = b.withColumn("grains", F.filter("_grains", keep)).drop("_near", "_grains")
    return b if every_block else passing(b, F.size("grains") > 0)


def with_amounts(found: DataFrame, profile: Profile, **more: Column) -> DataFrame:
    """``qtys, prices``, and ``amounts`` with the prices dropped; further columns are found in the same pass."""
    b = held(found, qtys=_amounts(F.col("norm"), profile.unit_core), amounts=_amounts(F.col("norm"), profile.money_core), **more)
    same = lambda p: F.exists("qtys", lambda q: (q["value"] == p["value"]) & (F.abs(q["tok"] - p["tok"]) <= 3))
    return b.withColumn("prices", F.filter("amounts", lambda p: ~same(p)))


def _met(window: Column, profile: Profile) -> Column:
    return F.struct(*[window.rlike(p).alias(f"-{k}") for k, p in profile.negative.items()], *[window.rlike(p).alias(f"+{k}") for k, (p, _) in profile.positive.items()])


def _weighed(met: Column, profile: Profile) -> tuple[Column, Column, Column]:
    """The classes met on either side, and the strength of the best positive one."""
    named = lambda sign, known: F.flatten(F.array(*[F.when(met[f"{sign}{k}"], F.array(F.lit(k))).otherwise(F.array().cast("array<string>")) for k in known]))
    raw = F.greatest(F.lit(0.0), *[F.when(met[f"+{k}"], F.lit(float(s))).otherwise(F.lit(0.0)) for k, (_, s) in profile.positive.items()])
    return named("-", profile.negative), named("+", profile.positive), raw


def _weakened(raw: Column, window: Column, profile: Profile) -> Column:
    return F.when((raw > 0) & window.rlike(profile.weakener), F.greatest(F.lit(0.1), raw - F.lit(0.4))).otherwise(raw)


def _told(neg: Column, pos: Column, strength: Column) -> Column:
    has_pos, has_neg = F.size(pos) > 0, F.size(neg) > 0
    price = has_pos & (~has_neg | (strength >= F.lit(0.6)))
    context = F.when(price, "PRICE").when(has_neg, F.get(neg, F.lit(0))).otherwise("OTHER")
    listed = F.concat(F.lit("negative("), F.array_join(neg, ","), F.lit(")"))
    reason = F.when(price | ~has_neg, "").when(has_pos, F.concat(F.lit("weak_positive("), F.format_string("%.1f", strength), F.lit(")+"), listed)).otherwise(F.concat(F.lit("no_positive+"), listed))
    return F.struct(context.alias("context"), pos.alias("positive"), neg.alias("negative"), F.when(price | has_pos, strength).otherwise(0.0).alias("strength"), reason.alias("reason"))


def classified(window: Column, profile: Profile) -> Column:
    """``struct(context, positive, negative, strength, reason)`` of a text window."""

    def weighed(met: Column) -> Column:
        neg, pos, raw = _weighed(met, profile)
        return bound(F.struct(neg.alias("neg"), pos.alias("pos"), raw.alias("raw")), lambda e: bound(_weakened(e["raw"], window, profile), lambda s: _told(e["neg"], e["pos"], s)))

    return bound(_met(window, profile), weighed)


def with_class(rows: DataFrame, window: str, profile: Profile) -> DataFrame:
    """``class``, as ``classified`` has it, of the text in a column: step by step, so that each step is compiled."""
    rows = held(rows, _met=_met(F.col(window), profile))
    neg, pos, raw = _weighed(F.col("_met"), profile)
    rows = held(rows, _neg=neg, _pos=pos, _raw=raw)
    rows = held(rows, _strength=_weakened(F.col("_raw"), F.col(window), profile))
    return rows.withColumn("class", _told(F.col("_neg"), F.col("_pos"), F.col("_strength"))).drop("_met", "_neg", "_pos", "_raw", "_strength")


def mentions(found: DataFrame, profile: Profile, around: int = 20) -> DataFrame:
    """One row per commodity mention with its context class, from a window of tokens around it."""
    m = found.withColumn("_last", blanks(F.col("norm"))).withColumn("grain", F.explode(F.when(F.size("grains") > 0, F.col("grains"))))
    start, form = F.col("grain.start"), F.col("grain.form")
    low, high = F.greatest(F.col("grain.tok") - around, F.lit(0)), F.least(F.col("grain.tok") + around, F.col("_last"))
    # the tokens are the pieces of the normalised text between blanks
    low_char = F.length(F.call_function("substring_index", F.col("norm"), F.lit(" "), low)) + F.when(low > 0, 1).otherwise(0)
    high_char = F.length(F.call_function("substring_index", F.col("norm"), F.lit(" "), high + 1))
    radius = F.greatest(high_char - start, start - low_char, F.lit(100))
    left = F.greatest(start - radius, F.lit(0))
    m = m.withColumn("_window", F.substring("norm", left + 1, start + F.length(form) + radius - left))
    return with_class(m, "_window", profile).drop("_window", "_last")


def distances(events: str, tok: Column) -> Column:
    """How many tokens each of a list of events is away."""
    return F.transform(F.col(f"{events}.tok"), lambda t: F.abs(t - tok))


def nearest_of(events: Column, away: Column, window: int) -> Column:
    """The event nearest in tokens within the window, by the events' distances; the earliest by sequence, as they are listed,
    among equals."""
    least = F.array_min(away)
    return F.when(least <= window, F.get(events, F.array_position(away, least).cast("int") - 1))


def score(strength: Column, d_price: Column, d_qty: Column, has_unit: Column, boundary: Column, competing: Column, lines: Column | None = None) -> Column:
    """Explainable link score from 0 to 100."""
    raw = 30.0 * prox(d_price, 12.0) + 10.0 * F.when(d_qty.isNull(), F.lit(0.3)).otherwise(prox(d_qty, 20.0)) + 30.0 * strength
    crossed = F.least(lines if lines is not None else F.lit(0), F.lit(5))
    quality = F.greatest(F.lit(0.5), 1.0 - F.when(has_unit, 0.0).otherwise(0.15) - 0.05 * crossed - F.when(boundary, 0.2).otherwise(0.0))
    doubt = F.greatest(F.lit(0.7), 1.0 - 0.05 * F.greatest(F.lit(0), competing - 1))
    value = raw * quality * doubt
    return clamp(F.when(strength < F.lit(0.1), F.least(value, F.lit(40.0))).otherwise(value), 0.0, 100.0)


def rejected(m: DataFrame) -> DataFrame:
    """Mentions with negative evidence and hardly any positive one, with wider context."""
    gone = passing(m, refused())
    return gone.withColumn("context_window", F.left(token_window(F.col("value_tokens"), F.col("grain.tok") - 8, F.col("grain.tok") + 8), F.lit(500)))


def refused() -> Column:
    """Negative evidence and hardly any positive one."""
    return ~F.col("class.context").isin("PRICE", "OTHER") & (F.col("class.strength") < F.lit(0.3))


def linked(m: DataFrame, profile: Profile, window: int = 80, least: float = 25.0) -> DataFrame:
    """Each accepted mention with its nearest price and quantity, distances and score."""
    tok = F.col("grain.tok")
    k = held(passing(m, ~refused()), _prices=distances("prices", tok), _qtys=distances("qtys", tok))
    k = passing(k.withColumn("price", nearest_of(F.col("prices"), F.col("_prices"), window)), F.col("price").isNotNull())

    def boundary(a: Column, b: Column) -> Column:
        return F.exists("stops", lambda s: (s > F.least(a, b)) & (s < F.greatest(a, b)))

    k = k.withColumn("_qty", nearest_of(F.col("qtys"), F.col("_qtys"), window))
    k = k.withColumn("qty", F.when(F.col("_qty").isNotNull() & ~boundary(tok, F.col("_qty.tok")), F.col("_qty"))).drop("_qty")
    d_price, d_qty = F.abs(F.col("price.tok") - tok), F.abs(F.col("qty.tok") - tok)
    k = k.withColumns(
        {
            "dist_gp": d_price,
            "dist_gq": F.coalesce(d_qty, F.lit(-1)),
            "competing": F.size(F.filter("_prices", lambda d: d <= 20)),
            "boundary": boundary(tok, F.col("price.tok")),
            "span_toks": F.greatest(tok, F.col("price.tok"), F.coalesce(F.col("qty.tok"), tok)) - F.least(tok, F.col("price.tok"), F.coalesce(F.col("qty.tok"), tok)),
            "priceword_near": F.exists("pricewords", lambda t: F.abs(t - F.col("price.tok")) <= 8),
        }
    )
    has_unit = F.col("has_unit") | F.col("qty").isNotNull()
    k = k.withColumn("score", score(F.col("class.strength"), d_price, d_qty, has_unit, F.col("boundary"), F.col("competing")))
    low, high = F.least(tok, F.col("price.tok"), F.coalesce(F.col("qty.tok"), tok)), F.greatest(tok, F.col("price.tok"), F.coalesce(F.col("qty.tok"), tok))
    k = passing(k, F.col("score") >= least).withColumn("context_window", F.left(token_window(F.col("value_tokens"), low - 8, high + 8), F.lit(2000)))
    return k.drop("_prices", "_qtys").withColumns({"candidate_rank": F.lit(1), "is_primary": F.lit("yes"), "ambiguous": F.lit("no")})


def block_hits(blocks: DataFrame, profile: Profile) -> DataFrame:
    """The distinct matches in each block's raw text, sorted: ``grain_hits, unit_hits, money_hits``; and ``priceword_hit``."""
    norm = F.col("_norm")
    hits = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(norm, F.lit(p), 0)))
    found = blocks.withColumn("_norm", _raw_norm(blocks))
    return found.withColumns({"grain_hits": hits(profile.grain), "unit_hits": hits(profile.unit), "money_hits": hits(profile.money), "priceword_hit": norm.rlike(profile.priceword)}).drop("_norm")


def distinct_values(blocks: DataFrame, column: str) -> DataFrame:
    """The distinct amounts of a block in the order first seen."""
    return blocks.withColumn(f"{column}_seen", F.array_distinct(F.transform(column, lambda e: F.concat_ws(" ", e["value"], e["unit"]))))


