"""Several candidates a mention: ranking, doubt, and a choice that does not give one price to many mentions.

A mention's candidates are the prices near it, each with the mention's nearest quantity. Both come from joins of long event
tables or from the lists in the mention's block. Prices are shared out in a block from the best
candidate down; only mentions that reach a common stretch of prices contend, and each such segment is
folded by itself, its candidates a list in one row. Where the rows are dealt by block, nothing here is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import held, passing
from ..vocab import Profile
from .linking import distances, nearest_of, refused, score
from .nearest import nearest, within

#: A block: the document, by its path where it has one, and the block's number in it.
KEYS = ["doc", "block_no"]
MENTION = [*KEYS, "grain_index"]
#: What ``assigned`` reads.
CHOICE = [*MENTION, "candidate_rank", "score", "span_toks", "dist_gp", "price", "qty"]
#: The block's arrays from which a mention's prices are taken.
LISTS = ("prices", "pricewords", "stops")


@dataclass(frozen=True)
class Choice:
    """When a price may serve a second mention, when a mention left over takes its first candidate all the
    same, and how close a next candidate makes one ambiguous. Fixed values."""

    reuse_score: float = 50.0
    reuse_distance: int = 12
    reuse_span: int = 18
    fallback_score: float = 40.0
    doubt: float = 8.0


def stops(profile: Profile) -> Column:
    """Places of the boundary words among a block's tokens."""
    return F.array_compact(F.transform("tokens", lambda t, i: F.when(t.rlike(f"^{profile.boundary}"), i)))


def _stops_of(df: DataFrame, profile: Profile) -> Column:
    """The column ``stops`` where the blocks have it, else looked for."""
    return F.col("stops") if "stops" in df.columns else stops(profile)


def _counts(tok: Column) -> dict[str, Column]:
    """How many boundary words stand before a token, and up to it: their difference between two tokens
    tells what lies strictly between them."""
    return {"stops_before": F.size(F.filter("stops", lambda s: s < tok)), "stops_upto": F.size(F.filter("stops", lambda s: s <= tok))}


def _between(a: str, b: str) -> Column:
    """Whether a boundary word lies strictly between two events."""
    low_first = F.col(f"{a}tok") <= F.col(f"{b}tok")
    return F.when(low_first, F.col(f"{b}stops_before") > F.col(f"{a}stops_upto")).otherwise(F.col(f"{a}stops_before") > F.col(f"{b}stops_upto"))


def long_events(found: DataFrame, column: str, profile: Profile) -> DataFrame:
    """``tok, seq, value, unit`` of each event in a column of ``linking.events``, with the boundary words
    before it and, within eight tokens, the price word."""
    rows = found.select(*KEYS, _stops_of(found, profile).alias("stops"), "pricewords", F.explode(column).alias("e"))
    near = F.exists("pricewords", lambda t: F.abs(t - F.col("e.tok")) <= 8)
    return rows.withColumns(_counts(F.col("e.tok"))).select(*KEYS, "e.*", "stops_before", "stops_upto", near.alias("priceword_near"))


def accepted(m: DataFrame, profile: Profile, window: int | None = None, listed: bool = False) -> DataFrame:
    """The mentions that are not refused, numbered from 1 within their block as found, without the block's arrays.

    ``window``: each with its nearest quantity from the block's list, NULL behind a boundary word; ``ranked`` then joins none.
    ``listed``: each with the block's prices, for ``ranked`` to take them from there.
    """
    rows = passing(m, ~refused()).withColumns({"stops": _stops_of(m, profile), "grain_index": F.array_position("grains", F.col("grain")).cast("int"), "tok": F.col("grain.tok")})
    rows, qty = rows.withColumns(_counts(F.col("tok"))), []
    if window is not None:
        rows = held(rows, _away=distances("qtys", F.col("tok")))
        rows = rows.withColumn("_qty", nearest_of(F.col("qtys"), F.col("_away"), window))
        low, high = F.least("tok", "_qty.tok"), F.greatest("tok", "_qty.tok")
        qty = [F.when(~F.exists("stops", lambda s: (s > low) & (s < high)), F.col("_qty")).alias("qty")]
    return rows.select(*MENTION, "ddb_id", "tok", *qty, *(LISTS if listed else ()), F.col("grain.form").alias("form"), F.col("grain.start").alias("start"), "class", "has_unit", "stops_before", "stops_upto")


def _listed(mentions: DataFrame, window: int) -> DataFrame:
    """Each mention with every price of its block's list within the window, as ``within`` pairs them, and how many are ``competing``."""
    away = distances("prices", F.col("tok"))
    m = mentions.withColumns({"competing": F.size(F.filter(away, lambda d: d <= 20)), "_e": F.explode(F.filter("prices", lambda p: F.abs(p["tok"] - F.col("tok")) <= window))})
    near = F.exists("pricewords", lambda t: F.abs(t - F.col("_e.tok")) <= 8)
    price = F.struct("_e.*", *[v.alias(k) for k, v in _counts(F.col("_e.tok")).items()], near.alias("priceword_near"))
    return m.withColumns({"price": price, "distance": F.abs(F.col("tok") - F.col("_e.tok"))}).drop("_e", *LISTS)


def ranked(mentions: DataFrame, prices: DataFrame | None, qtys: DataFrame | None, window: int = 80, least: float = 25.0, choice: Choice = Choice()) -> DataFrame:
    """Each mention's candidates of at least ``least``: ``candidate_rank`` from 1, ``price``, ``qty``, distances and ``score``.

    The better score comes first, then a candidate with a quantity, the shorter span, the nearer price
    and the earlier one. A candidate is ``ambiguous`` when the next one's score comes closer than
    ``choice.doubt``, which ``alt_score, alt_qty, alt_price`` then tell.
    """
    m = mentions
    if "qty" not in mentions.columns:
        m = nearest(mentions, qtys, KEYS, window, name="qty").drop("distance")
        m = m.withColumn("qty", F.when(~_between("", "qty."), F.col("qty")))
    each = Window.partitionBy(*MENTION)
    if prices is None:
        pairs = _listed(m, window)
    else:
        pairs = within(m, prices, KEYS, max(window, 20), name="price")
        pairs = pairs.withColumn("competing", F.count_if(F.col("distance") <= 20).over(each).cast("int")).filter(F.col("distance") <= window)
    tok, q_tok = F.col("tok"), F.coalesce(F.col("qty.tok"), F.col("tok"))
    d_qty = F.abs(F.col("qty.tok") - tok)
    pairs = pairs.withColumns({"dist_gp": F.col("distance"), "dist_gq": F.coalesce(d_qty, F.lit(-1)), "boundary": _between("", "price."), "low_tok": F.least(tok, F.col("price.tok"), q_tok), "high_tok": F.greatest(tok, F.col("price.tok"), q_tok)})
    pairs = pairs.withColumns({"span_toks": F.col("high_tok") - F.col("low_tok"), "priceword_near": F.col("price.priceword_near")})
    value = score(F.col("class.strength"), F.col("dist_gp"), d_qty, F.col("has_unit") | F.col("qty").isNotNull(), F.col("boundary"), F.col("competing"))
    pairs = passing(pairs.withColumn("score", value), F.col("score") >= least)
    best = each.orderBy(F.desc("score"), F.desc(F.col("qty").isNotNull()), "span_toks", "dist_gp", "price.tok", "price.seq")
    following = lambda c: F.lead(c).over(best)
    out = pairs.withColumns({"candidate_rank": F.row_number().over(best), "_score": following("score"), "_price": following(_shown("price")), "_qty": following(_shown("qty"))})
    doubt = F.coalesce(F.col("score") - F.col("_score") < choice.doubt, F.lit(False))
    alt = {"alt_score": F.format_string("%.2f", "_score"), "alt_qty": F.coalesce("_qty", F.lit("")), "alt_price": F.col("_price")}
    out = out.withColumns({"ambiguous": F.when(doubt, "yes").otherwise("no"), **{k: F.when(doubt, v).otherwise("") for k, v in alt.items()}})
    return out.drop("_score", "_price", "_qty", "distance", "stops_before", "stops_upto")


def _shown(event: str) -> Column:
    return F.when(F.col(event).isNotNull(), F.concat_ws(" ", f"{event}.value", f"{event}.unit"))


def assigned(candidates: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """The candidates with ``is_primary`` and, on the primary one, ``assignment``.

    All candidates of a block are gone through from the best down. A mention without a primary one takes a
    candidate whose price is free (``taken``), or one that is good, near and short enough although it is not
    (``reused``). A mention left over takes its first candidate: as ``fallback`` where its score is high enough, else
    as ``default``.
    """
    price, strong = F.col("price.tok"), (F.col("score") >= choice.reuse_score) & (F.col("dist_gp") <= choice.reuse_distance) & (F.col("span_toks") <= choice.reuse_span)
    each, along = Window.partitionBy(*MENTION), Window.partitionBy(*KEYS).orderBy("_low", "grain_index")
    reach = candidates.withColumns({"_low": F.min("price.tok").over(each), "_high": F.max("price.tok").over(each)})
    # a mention's first row may open a segment: to the next ones its own reach is known
    so_far = F.max("_high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = reach.withColumn("_new", F.coalesce(F.col("_low") > so_far, F.lit(False)).cast("int")).withColumn("_segment", F.sum("_new").over(along))
    row = F.struct(*candidates.columns).alias("row")
    one = F.struct((-F.col("score")).alias("a"), F.col("qty").isNull().alias("b"), F.col("span_toks").alias("c"), F.col("dist_gp").alias("d"), price.alias("price"), F.col("grain_index").alias("mention"), F.col("candidate_rank").alias("rank"), strong.alias("strong"), row)
    lists = parts.groupBy(*KEYS, "_segment").agg(F.array_sort(F.collect_list(one)).alias("all"))
    none = F.struct(F.array().cast("array<struct<grain_index:int,candidate_rank:int,assignment:string>>").alias("got"), F.array().cast("array<int>").alias("used"))

    def step(state: Column, x: Column) -> Column:
        free = ~F.array_contains(state["used"], x["price"])
        takes = ~F.exists(state["got"], lambda g: g["grain_index"] == x["mention"]) & (free | x["strong"])
        row = F.struct(x["mention"].alias("grain_index"), x["rank"].alias("candidate_rank"), F.when(free, "taken").otherwise("reused").alias("assignment"))
        got = F.when(takes, F.array_append(state["got"], row)).otherwise(state["got"])
        return F.struct(got.alias("got"), F.when(takes & free, F.array_append(state["used"], x["price"])).otherwise(state["used"]).alias("used"))

    got = held(lists, got=F.aggregate("all", none, step, lambda s: s["got"]))
    mine = lambda x: F.get(F.filter("got", lambda g: g["grain_index"] == x["mention"]), F.lit(0))
    out = got.select("got", F.explode("all").alias("x")).withColumn("_mine", mine(F.col("x")))
    left_over = F.when(F.col("_mine").isNull() & (F.col("x.rank") == 1), F.when(F.col("x.row.score") >= choice.fallback_score, "fallback").otherwise("default"))
    own = F.when(F.col("_mine.candidate_rank") == F.col("x.rank"), F.col("_mine.assignment"))
    out = out.select("x.row.*", F.coalesce(own, left_over).alias("assignment"))
    return out.withColumn("is_primary", F.when(F.col("assignment").isNotNull(), "yes").otherwise("no"))


def emitted(candidates: DataFrame, top: int = 1, primary: str = "also") -> DataFrame:
    """The rows to report: the first ``top`` of each mention, and the primary one ``also``, ``only`` it, or it as
    any other (``ranked``)."""
    first, chosen = F.col("candidate_rank") <= max(1, top), F.col("is_primary") == "yes"
    return candidates.filter({"also": first | chosen, "only": chosen, "ranked": first}[primary])
