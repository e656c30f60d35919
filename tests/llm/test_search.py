import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitometry.llm import lexical


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def ranked(docs, items, k):
    """Plain Python: every item against every document."""
    counts = [(d, Counter(w), len(w)) for d, w in ((d, words(t)) for d, t in docs)]
    n_docs, n_terms = sum(n > 0 for *_, n in counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for at, (d, c, n) in enumerate(counts):
            m = 75 + 25 * n * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, at, d))
        out += [(item, r, x[4], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def run(spark, docs, items, k=3):
    d = spark.createDataFrame([(*x, "y", 1, 2) for x in docs], "doc_id long, text string, term string, item long, n int")
    i = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc string")
    return [tuple(r) for r in lexical.search(lexical.postings(d), i, k).collect()]


def test_terms():
    text = "A-b c_D\x001é×É½ ŒUVRE x\x7fyZ"
    assert [t.decode() for t in lexical.terms(text)] == words(text) == ["a", "b", "c", "d", "1é×É½", "Œuvre x", "yz"]
    assert lexical.terms(None) == lexical.terms(" .,") == []


@pytest.mark.parametrize("pairs", [2_000_000, 10])
def test_against_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "BATCH", 50)
    rng = random.Random(pairs)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "ß", "the", "the", "the", "The"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40])))) for k in range(120)]
    docs += [(200, None), (201, "..."), (202, "long " * 30_000 + "w1"), (203, "the w1 w2"), (204, "the w1 w2")]
    items = [(k, " ".join(rng.choices(vocabulary, k=6))) for k in range(12)] + [(50, None), (51, "?"), (52, "unknown"), (53, "w1 w1 w2")]
    assert sorted(run(spark, docs, items, 7)) == sorted(ranked(docs, items, 7))


def test_repeated_and_null_ids(spark):
    docs = [(5, "red fox"), (5, "red fox"), (None, "red fox"), (7, "blue"), (8, None), (9, "green hen")]
    got = run(spark, docs, [(1, "red"), (1, "red"), (None, "red"), (1, "blue")], 4)
    assert Counter(got) == Counter(ranked(docs, [(1, "red"), (None, "red"), (1, "blue")], 4))
    assert [d for i, _, d, _ in got if i is None] == [5, 5, None]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == run(spark, [(1, None), (2, "!")], [(1, "a")]) == []


def test_postings_are_sorted_by_bucket(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.col("id")), lambda k: k.cast("string"))).alias("text")).coalesce(2)
    index = lexical.postings(docs)
    buckets = index.select(F.input_file_name().alias("f"), "bucket").collect()
    for f in {r["f"] for r in buckets}:
        own = [r["bucket"] for r in buckets if r["f"] == f]
        assert own == sorted(own) and own[0] == lexical.LENGTHS
    assert index.filter("term is null").count() == 40
