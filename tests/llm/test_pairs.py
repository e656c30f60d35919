import random
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitometry.llm import ann, common, jaccard
from sitometry.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts, ids, percent=75):
    sets = [shingles(t) for t in texts]
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if sets[i] and sets[j] and (both := len(sets[i] & sets[j])) and 100 * both >= percent * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    low = {}
    for i, d in enumerate(ids):
        low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, len(sets[i]), low[top(i)]) for i, d in enumerate(ids))


def corpus(seed):
    """Copies, a large family of near copies of differing closeness, shared passages, odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randint(0, 60))
    base = [word() for _ in range(60)]
    passage = [word() for _ in range(20)]
    out = [None, "", "  \n", "one", "One", "a b c d", "A B C D", "é b c d e f", "É b c d e f"]
    for _ in range(90):
        x = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            x[rng.randrange(len(x))] = word()
        out.append(" ".join(x))
    for _ in range(30):
        out.append(" ".join([word() for _ in range(rng.randint(5, 60))] + passage))
    for x in rng.sample(out[9:], 25):
        w = x.split()
        del w[rng.randrange(len(w))]
        out += [x, " ".join(w)]
    return out


@pytest.mark.parametrize(("seed", "run"), [(1, 32), (2, 4), (3, 2)])
def test_jaccard_against_brute_force(spark, monkeypatch, seed, run):
    monkeypatch.setattr(jaccard, "RUN", run)
    monkeypatch.setattr(jaccard, "HUB_RUN", run if run > 2 else jaccard.HUB_RUN)
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id long, text string, node string")
    assert sorted(tuple(r) for r in jaccard.similar(docs).collect()) == brute(texts, ids)


def test_three_orders_meet_before_texts_are_fetched(spark, monkeypatch):
    """Pairs that fail the second or third order never reach the texts; linked ones always do."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, 80).astype(np.uint64))
        b = np.unique(np.concatenate((rng.choice(a, 72, replace=False), rng.integers(0, 1 << 63, rng.integers(1, 12)).astype(np.uint64))))
        if jaccard.linked(a, b)[0]:
            assert jaccard.candidate(jaccard.ends(a), jaccard.ends(b))
    far = [np.unique(rng.integers(0, 1 << 63, 80).astype(np.uint64)) for _ in range(2)]
    assert not jaccard.candidate(*map(jaccard.ends, far))
    monkeypatch.setattr(jaccard, "candidate", lambda a, b: False)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k l")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.similar(docs).collect()} == {1, 2}


def test_linked_nodes_are_not_paired_under_a_hub():
    n = 20_000
    cols = [np.full(n, 7), np.arange(n), np.full(n, 60), np.full(n, 5), np.full(n, -3), np.full(n, 99)]
    row = lambda k, least: [np.array([x]) for x in (7, k, 60, 5, least, 99)]
    batches = [[np.concatenate(c) for c in zip(row(n, 3), row(n + 1, 3), [c[:9000] for c in cols])], [c[9000:] for c in cols]]
    made = [b for b in jaccard._runs(32, 75, 32)(iter([jaccard._batch(jaccard._POSTING, *b) for b in batches]))]
    assert sum(b.num_rows for b in made) == 2 * n + 1 and not any(b["hot"].to_pylist()[0] for b in made)
    only = [jaccard._batch(jaccard._POSTING, *cols)]
    assert list(jaccard._runs(32, 75, 32)(iter(only))) == []


def test_copies_found_by_many_tasks_make_no_long_run():
    """A node that 40 tasks found and another of the same token are one pair, however the rows of a token come."""
    nodes = [5] * 20 + [9] + [5] * 20 + [9]
    n = len(nodes)
    cols = [np.array([7] * n + [8, 8]), np.array([*nodes, 1, 2]), np.full(n + 2, 60), np.full(n + 2, 5), np.zeros(n + 2, int), np.zeros(n + 2, int)]
    batches = [jaccard._batch(jaccard._POSTING, *[c[a:z] for c in cols]) for a, z in ((0, 10), (10, 30), (30, n + 2))]
    made = [r for b in jaccard._runs(32, 75, 32, False)(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["hot"], r["a"], r["b"], r["shared"]) for r in made) == [(False, 1, 2, 1), (False, 5, 9, 1)]


@pytest.mark.parametrize("percent", [60, 85])
def test_other_thresholds(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard, "RUN", 8)
    texts = corpus(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.similar(docs, percent).collect()) == brute(texts, range(len(texts)), percent)


def test_very_long_and_empty_texts(spark):
    long = " ".join(f"w{k % 5000}x{k // 5000}" for k in range(120_000))
    rows = [(3, long, 1), (1, long + " end", 2), (2, "", 3), (None, "a b", 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs).collect()}
    assert got == {(3, 119_996, 1), (1, 119_997, 1), (2, 0, 2), (None, 1, None), (None, 0, None)}


def test_jaccard_empty(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = jaccard.similar(spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (7, None)], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in rows) == [(5, 1, 5), (5, 1, 5), (7, 0, 7)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(10, 40)] + [(100, 99), (99, 98), (7, 7), (50, 51)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10, 41), 10), 98: 98, 99: 98, 100: 98, 50: 50, 51: 50}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24)) * 2
    v = [(centres[i % 12] + rng.standard_normal(24)).tolist() for i in range(1500)]
    v[700:900] = [v[0]] * 200
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] * 24, 0), (2003, [None] * 24, 0), (None, v[1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x, ids, hits = np.array(v), np.arange(1500), 0
    assert sorted(got) == list(range(0, 1500, 50))
    for q, found in got.items():
        s = ann.exact(x[q], x)
        s[q] = -9
        want = np.lexsort((ids, -s))[:5]
        hits += len({i for _, i, _ in found} & set(want.tolist()))
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(score == pytest.approx(s[i], abs=1e-12) for _, i, score in found)
    assert hits >= 0.9 * 5 * len(got)
    assert [i for _, i, _ in sorted(got[0])] == [700, 701, 702, 703, 704]


def test_the_bound_falls_and_abandons():
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    index = ann.fit(x)
    ids, asks = np.arange(2000), np.arange(5000, 5020)
    all_rows, tally, late = [], [], []
    sure = ann.SURE
    try:
        ann.SURE = 1e9  # the test never abandons: only whole distances count
        whole = ann.scan(index, ids, x, asks, q, 5, tally=all_rows)
    finally:
        ann.SURE = sure
    got = ann.scan(index, ids, x, asks, q, 5, tally=tally)
    assert len(set(got) & set(whole)) >= 0.9 * len(whole)
    bounds = np.array([2 - 2 * min(s for j, _, s in whole if j == i) for i in asks])
    again = ann.scan(index, ids, x, asks, q, 5, bounds, tally=late)
    assert set(again) <= set(whole) and sum(late) < sum(tally) < 20 * 2000 / 10
    assert tally[0] > 4 * tally[-1]


def test_probes_until_enough_are_found_and_lengths(spark):
    v = [[1.0, 0.001 * i, 0.0] for i in range(40)] + [[0.0, 0.0, 1.0 + i] for i in range(3)]
    rows = [(i, x) for i, x in enumerate(v)] + [(99, [1.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id").isin(41, 99), probes=1).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5] and {r["query_id"] for r in got} == {41}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])][:2] == [40, 42]


def test_few_or_no_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(two, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert ann.search(two.filter("vec_id > 9"), F.lit(True)).count() == 0


def test_among_lets_every_key_pass_and_few_others(spark):
    rows, keys = spark.range(50_000).withColumn("text", F.lit("x")), spark.range(0, 50_000, 50)
    got = {r["id"] for r in common.among(rows, "id", keys).select("id").collect()}
    assert set(range(0, 50_000, 50)) <= got and len(got) < 8_000
    assert common.among(rows, "id", keys.filter("id < 0")).count() == 0


def test_texts_of_no_pair_are_not_shuffled(spark):
    """Whatever the size of the pairs' table: without broadcast joins, most of the texts stay where they are read."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.substring(F.sha2(F.concat_ws("-", F.when(F.col("id") < 8, F.lit(0)).otherwise(F.col("id")), k).cast("binary"), 256), 1, 12)), " ")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(words, F.when(F.col("id") < 8, F.concat(F.lit(" e"), "id")).otherwise(F.lit(""))).alias("text"))
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        x = store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() for s in map(x.apply, range(x.size()))}

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = {r["doc_id"]: r["component_id"] for r in jaccard.similar(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert out == {k: 0 if k < 8 else k for k in range(400)}
    # the table of counts and the postings are shuffled in any case: no stage but theirs writes a fifth of the texts' bytes
    sizes = sorted((b for k, b in written().items() if k not in before), reverse=True)
    assert sum(b > 400 * 400 * 13 // 5 for b in sizes) <= 1, sizes[:6]


def test_stored_leaves_no_shuffle_files(spark):
    """They go when the table is written, not when the driver next collects its garbage; the session's setting stays."""
    blocks = [Path(str(f)) for f in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for b in blocks for f in b.rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(common.SHUFFLES_GO, "false")
    got = common.stored(spark.range(2000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "left")
    assert not files() - before and spark.conf.get(common.SHUFFLES_GO, "false") == setting
    assert got.count() == 7
    common.removed(got)
    assert not Path(got.inputFiles()[0].removeprefix("file://")).exists()


def test_only_repeated_prefix_tokens_are_shuffled(spark):
    """Tokens that one node alone has in its prefix make no pair; every one that two nodes have is posted."""
    rng = random.Random(5)
    texts = [" ".join(f"u{rng.randint(0, 10**9)}" for _ in range(80)) for _ in range(200)]
    texts += [texts[0].replace(texts[0].split()[40], "other"), " ".join(texts[1].split()[:78])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.sparkContext.broadcast(np.ones(1 << 10, np.uint32).tobytes())
    prefixes = common.stored(docs.select("text").mapInArrow(jaccard._prefixes(table, 75), "node long, n int, common int, tokens binary"), "prefixes")
    all_ = [(t, r["node"]) for r in prefixes.collect() for t in np.frombuffer(bytes(r["tokens"]), np.int64).tolist()]
    times = Counter(t for t, _ in all_)
    posted = {(r["token"], r["node"]) for r in prefixes.mapInArrow(jaccard._postings(jaccard._repeated(prefixes, len(all_))), "token long, node long, n int, common int").collect()}
    assert {x for x in all_ if times[x[0]] > 1} <= posted <= set(all_)
    assert max(times.values()) == 2 and len(posted) < 0.1 * len(all_)
