import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitometry.llm import mining


def brute(rows, asks, positives=5, negatives=10, low=30, high=90):
    """Plain Python over all pairs; each row counts for itself."""
    good = [(at, i, l, [math.floor(256 * x) for x in v]) for at, (i, l, v) in enumerate(rows) if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, i, l, v in good:
        if not asks(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, bt, m) for bt, j, m, w in good if bt != at and len(w) == len(v))
        for p in [s for s in scored if s[3] == l][:positives]:
            inside = [s for s in scored if s[3] != l and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(i, p[1], r, s[1], -p[0], -s[0]) for r, s in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    frame = spark.createDataFrame([(i, l, v, "a", 1) for i, l, v in rows], "vec_id long, label int, embedding array<double>, list string, row int")
    return sorted(tuple(r) for r in mining.mine(frame, F.col("vec_id") % every == 0, **options).collect())


@pytest.mark.parametrize(("seed", "first", "cell"), [(1, 200, 4000), (2, 2, 7), (3, 0, 40)])
def test_against_brute_force(spark, monkeypatch, seed, first, cell):
    monkeypatch.setattr(mining, "FIRST_ROWS", first)
    monkeypatch.setattr(mining, "CELL_ROWS", cell)
    monkeypatch.setattr(mining, "CELL_QUERIES", 3)
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 8))
    rows = [(int(k), int(rng.integers(0, 4)), list(map(float, middle[k % 6] + rng.normal(size=8) * 0.5))) for k in rng.permutation(300)]
    rows += [(1000 + k, k % 3, [0.25, 0.5] * 4) for k in range(20)]  # ties
    rows += [(2000 + k, 1, list(rows[0][2])) for k in range(0, 40, 4)] + [rows[5], rows[5]]  # copies, rows that repeat in full
    rows += [(None, 1, [1.0] * 8), (3000, None, [1.0] * 8), (3010, 1, None), (3020, 1, [1.0] * 7 + [float("nan")]), (3030, 1, [1.0] * 7 + [None]), (3040, 2, [float("inf")] * 8)]
    rows += [(4000 + k, k % 2, [float(k), 1.0, 2.0]) for k in range(15)] + [(5000, 1, []), (5010, 2, [])]  # other lengths
    rows += [(6000, 9, [1.0] * 8), (6001, 9, [2.0] * 8)]  # fewer positives than asked for
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_few_rows_and_none(spark):
    assert mined(spark, []) == mined(spark, [(10, None, [1.0])]) == mined(spark, [(10, 1, [1.0])]) == mined(spark, [(11, 1, [1.0]), (12, 2, [1.0])]) == []


def test_large_components(spark):
    rows = [(k, k % 2, [float(k) * 2**14, 2.0**13 + k]) for k in range(30)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_bounds_hold(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-200, 200, (500, 6)).astype(float)
    c = mining.fit(x, 500)
    own = mining.nearest(x, c)
    radii = np.array([max([np.sqrt(((v - c[k]) ** 2).sum()) for v in x[own == k]], default=0) for k in range(len(c))])
    lists = mining.Lists({6: (np.arange(len(c)), c, radii, np.bincount(own, minlength=len(c)))})
    for q in x[:50]:
        number, least, most, _ = lists.bounds(q)
        score = x @ q
        assert (score <= most[own]).all() and (score >= least[own]).all()


def test_lists_that_cannot_count_are_not_visited(spark, monkeypatch):
    """Far clusters: the k-th score of the first lists ends the visits."""
    seen = spark.sparkContext.accumulator(0)
    plain = mining.products

    def counted(q, x):
        seen.add(len(q) * len(x))
        return plain(q, x)

    monkeypatch.setattr(mining, "products", counted)
    rng = random.Random(5)
    rows = [(k, k % 2, [10.0 * (k % 8 == j) + rng.random() for j in range(8)]) for k in range(800)]
    rows = [(k, l, [x + 5.0 * (j == (k // 2) % 2) for j, x in enumerate(v)]) for k, l, v in rows]
    monkeypatch.setattr(mining, "FIRST_ROWS", 10)
    assert mined(spark, rows, 100, positives=3, negatives=4) == brute(rows, lambda i: i % 100 == 0, 3, 4)
    assert 0 < seen.value < 2 * 8 * 800
