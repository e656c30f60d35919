import random

import pytest
from pyspark.sql import functions as F

from sitometry.operators import candidates, linking
from sitometry.plans import flows
from sitometry.vocab import GREEK

SHAPE = "doc string, block_no int, grain_index int, candidate_rank int, score double, span_toks int, dist_gp int, price struct<tok:int,value:string,unit:string>, qty struct<tok:int,value:string,unit:string>"


def order(c):
    return (-c["score"], c["qty"] is None, c["span_toks"], c["dist_gp"], c["price"][0], c["grain_index"], c["candidate_rank"])


def greedy(rows, choice):
    """One pass over a block's candidates from the best down, in plain Python."""
    got, used = {}, set()
    for c in sorted(rows, key=order):
        if c["grain_index"] in got:
            continue
        if c["price"][0] not in used:
            got[c["grain_index"]] = (c["candidate_rank"], "taken")
            used.add(c["price"][0])
        elif c["score"] >= choice.reuse_score and c["dist_gp"] <= choice.reuse_distance and c["span_toks"] <= choice.reuse_span:
            got[c["grain_index"]] = (c["candidate_rank"], "reused")
    for c in rows:
        if c["candidate_rank"] == 1 and c["grain_index"] not in got:
            got[c["grain_index"]] = (1, "fallback" if c["score"] >= choice.fallback_score else "default")
    return got


def random_block(rng, doc, block, mentions, width):
    rows = []
    for g in range(1, mentions + 1):
        prices = rng.sample(range(g * width, g * width + 12), rng.randint(1, 4))
        cands = [{"doc": doc, "block_no": block, "grain_index": g, "score": float(rng.choice([20, 38, 42, 50, 55, 60])), "span_toks": rng.choice([3, 18, 19, 40]), "dist_gp": rng.choice([1, 12, 13]), "price": (p, str(p), "x"), "qty": rng.choice([None, (1, "1", "y")])} for p in prices]
        for rank, c in enumerate(sorted(cands, key=lambda c: order({**c, "candidate_rank": 0})), 1):
            rows.append({**c, "candidate_rank": rank})
    return rows


@pytest.mark.parametrize("choice", [candidates.Choice(), candidates.Choice(reuse_score=30.0, reuse_distance=13, reuse_span=40, fallback_score=0.0), candidates.Choice(reuse_score=1e9, fallback_score=1e9)])
def test_choice_equals_a_plain_greedy_pass(spark, choice):
    rng = random.Random(3)
    rows = [r for k in range(40) for r in random_block(rng, f"d{k % 4}", k, rng.randint(1, 9), rng.choice([1, 3, 30]))]
    names = [x.split()[0] for x in SHAPE.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SHAPE)
    out = candidates.assigned(df, choice)
    got = {(r["block_no"], r["grain_index"]): (r["candidate_rank"], r["assignment"]) for r in out.filter("is_primary = 'yes'").collect()}
    want = {(k, g): v for k in range(40) for g, v in greedy([r for r in rows if r["block_no"] == k], choice).items()}
    assert got == want and out.count() == len(rows)
    assert candidates.emitted(out, primary="only").count() == len(want)
    assert candidates.emitted(out, 2, "ranked").count() == sum(r["candidate_rank"] <= 2 for r in rows)
    assert candidates.emitted(out, 2).count() == sum(r["candidate_rank"] <= 2 or want[r["block_no"], r["grain_index"]][0] == r["candidate_rank"] for r in rows)


def blocks(spark, *texts, doc="d"):
    rows = [(doc, i, t, t, ["1"]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ddb_id string, block_no int, raw string, value_text string, num_values array<string>")


def test_two_mentions_do_not_share_a_price(spark):
    text = "τιμης πυρου αρταβων 2 κριθησ δραχμαι 40 και δραχμαι 70"
    never = candidates.Choice(reuse_score=1e9)
    got = flows.candidate_links(blocks(spark, text), GREEK, least=0.0, choice=never, top=9).orderBy("grain_index", "candidate_rank").collect()
    assert {(r["grain_index"], r["form"]) for r in got} == {(1, "πυρου"), (2, "κριθησ")}
    assert sorted(r["price"]["value"] for r in got if r["is_primary"] == "yes") == ["40", "70"]
    assert [r["candidate_rank"] for r in got if r["grain_index"] == 1] == [1, 2]
    first = next(r for r in got if r["grain_index"] == 2 and r["candidate_rank"] == 1)
    assert first["ambiguous"] == "yes" and first["alt_price"] == "70 δραχμαι" and first["alt_qty"] == "2 αρταβων"


def test_boundary_words_between_events(spark):
    found = blocks(spark, "πυρου λοιπον αρταβαι 3 δραχμαι 8 γινονται δραχμαι 9")
    rows = flows.candidate_links(found, GREEK, least=0.0, top=9).collect()
    assert {(r["price"]["value"], r["boundary"], r["qty"]) for r in rows} == {("8", True, None), ("9", True, None)}


def test_a_block_without_candidates(spark):
    assert flows.candidate_links(blocks(spark, "πυρου αρταβαι 3 δραχμαι"), GREEK).count() == 0
    assert flows.candidate_links(blocks(spark, "πυρου δραχμαι 3").filter(F.lit(False)), GREEK).count() == 0


def test_the_last_boundary_and_the_same_id_in_two_files(spark):
    a = blocks(spark, "πυρου δραχμαι 3").withColumn("path", F.lit("a"))
    b = blocks(spark, "κριθησ δραχμαι 5").withColumn("path", F.lit("b"))
    got = flows.candidate_links(a.unionByName(b), GREEK, least=0.0, top=9).collect()
    assert sorted((r["doc"], r["form"], r["price"]["value"]) for r in got) == [("a", "πυρου", "3"), ("b", "κριθησ", "5")]


def test_quantities_of_the_block_equal_joined_ones(spark):
    """Near and far ones, ties, and boundary words between."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["πυρου", "κριθησ", "αρταβαι 3", "4 αρταβων", "δραχμαι 8", "δραχμαι 9", "λοιπον", "α", "β"]) for _ in range(60)) for _ in range(6)]
    found = linking.events(flows.gated(blocks(spark, *texts), GREEK), GREEK).withColumn("doc", F.col("ddb_id"))
    m, qtys = linking.mentions(found, GREEK), candidates.long_events(found, "qtys", GREEK)
    prices = candidates.long_events(found, "prices", GREEK)
    told = lambda df: sorted((r["block_no"], r["grain_index"], r["candidate_rank"], r["price"]["tok"], r["qty"] and (r["qty"]["tok"], r["qty"]["value"]), round(r["score"], 9), r["alt_qty"]) for r in df.collect())
    for window in (3, 80):
        joined = told(candidates.ranked(candidates.accepted(m, GREEK), prices, qtys, window, 0.0))
        assert joined == told(candidates.ranked(candidates.accepted(m, GREEK, window), prices, None, window, 0.0)) and any(r[4] for r in joined)


def test_a_block_is_dealt_once_and_nothing_else_is_shuffled(spark):
    """Neither candidates nor mentions are moved, and nothing is stored; blocks of one constant number are no exception."""
    for found in (blocks(spark, "πυρου αρταβαι 3 δραχμαι 40"), blocks(spark, "πυρου αρταβαι 3 δραχμαι 40").withColumn("block_no", F.lit(0))):
        out = flows.candidate_links(found, GREEK, least=0.0, top=9)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Scan parquet" not in plan
        assert out.count() == 1


def test_listed_prices_give_the_joined_candidates(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["πυρου", "κριθης", "αρταβαι 3", "δραχμαι 40", "δραχμαι 7", "τιμη", "και"]) for _ in range(60)) for _ in range(12)]
    found = linking.events(flows.gated(blocks(spark, *texts), GREEK), GREEK).withColumn("doc", F.col("ddb_id"))
    m, prices = linking.mentions(found, GREEK), candidates.long_events(found, "prices", GREEK)
    for window in (7, 30):
        joined = candidates.ranked(candidates.accepted(m, GREEK, window), prices, None, window, 0.0)
        listed = candidates.ranked(candidates.accepted(m, GREEK, window, listed=True), None, None, window, 0.0)
        told = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
        assert told(joined) == told(listed) and joined.count() > 100


def test_kept_columns_and_stated_parts(spark):
    """Columns that nobody wants are not carried through the choice, and the blocks' parts are not joined by their size."""
    found = blocks(spark, "πυρου αρταβαι 3 δραχμαι 40 κριθης δραχμαι 7", "πυρου δραχμαι 3")
    whole, kept = flows.candidate_links(found, GREEK, least=0.0, top=9), flows.candidate_links(found, GREEK, least=0.0, top=9, keep=["ambiguous"])
    assert set(kept.columns) == {*candidates.CHOICE, "ambiguous", "assignment", "is_primary"} < set(whole.columns)
    told = lambda df: sorted(map(str, df.select(kept.columns).collect()))
    assert told(whole) == told(kept) and kept.count() > 2
    assert "REPARTITION_BY_NUM" in kept._jdf.queryExecution().executedPlan().toString()
