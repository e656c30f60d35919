"""Hard negatives by exact inner products over inverted lists of k-means with their radii.

Vectors are made whole numbers and dealt to the list of their nearest centroid; each list keeps its
radius, the largest distance of a member from the centroid. By Cauchy and Schwarz no member scores above
``q.c + |q| radius`` or below ``q.c - |q| radius`` with a query ``q``. A query visits the lists by their
upper bound: the first ones give a k-th score, and of the others only those are visited whose bound does
not fall strictly below it and, for negatives, that reach into the window of scores asked for. So the
results are those of a full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The centroids are fitted on about so many vectors at most, each list on so many; every vector is listed.
TRAIN_ROWS, TRAIN_A_LIST, ROUNDS, SEED = 32_768, 8, 6, 29
#: A query first visits lists, by their bound, until they hold so many rows for each result wanted.
FIRST_ROWS = 200
#: Rows and queries that meet in one task, about.
CELL_ROWS, CELL_QUERIES = 4_000, 500
#: Whole numbers up to this are exact in doubles.
EXACT = float(1 << 53)
FOUND = "anchor long, place long, vec_id long, row long, score long"


@dataclass
class Lists:
    """For each length of vectors: list numbers, centroids, radii and sizes."""

    of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the lists of the query's length, what their members score at least and at most, and
        sizes; a margin covers what the bounds lose in rounding."""
        number, centroids, radii, sizes = self.of[len(q)]
        size = np.sqrt((q * q).sum())
        near, reach = centroids @ q, size * radii
        margin = 1e-9 * (size * np.sqrt((centroids * centroids).sum(1)) + reach) + 1e-6
        return number, near - reach - margin, near + reach + margin, sizes


def sound(vectors: Column) -> Column:
    """Not null and without a null or non-finite component."""
    return F.coalesce(F.forall(vectors, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def fit(sample: np.ndarray, rows: int, seed: int = SEED) -> np.ndarray:
    """Centroids by k-means: about the root of ``rows`` of them, as far as the sample can place them."""
    x = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    k = int(max(1, min(np.sqrt(rows), len(x) / TRAIN_A_LIST)))
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = nearest(x, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        held = np.bincount(own, minlength=k)
        centroids = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1) - 2 * x @ centroids.T).argmin(1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles where they hold them, else in Python's integers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= EXACT:
        return np.array(q.astype(object) @ x.T.astype(object)).astype(np.int64)
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64)


def _first(who: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each ``who``: by score, then smaller id, then row."""
    order = np.lexsort((rows, ids, -score, who))
    w = who[order]
    return order[np.arange(len(w)) - np.searchsorted(w, w) < k]


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors(vec_id, label, embedding)``.

    Components become ``floor(scale * x)``. An anchor's positives are the ``positives`` best other rows
    of its label, by inner product and then smaller id; of each of them the ``negatives`` best rows of
    another label are returned whose score is from ``low`` to ``high`` per cent of the positive's.

    Rows with a null id, label or vector or an unsound component take no part. Each row counts for
    itself, also where ids repeat: a copy of an anchor is another row of its label. Vectors score only with
    vectors of their own length. Fewer positives or negatives than asked for give fewer rows, and an empty
    table none. Scores that, times ``high``, pass 64 bits raise. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    made = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(sound(F.col("embedding").cast("array<double>")), made).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    good = good.filter("vec_id is not null and label is not null and v is not null").withColumn("row", F.monotonically_increasing_id())
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    lengths = {r["dim"]: r["count"] for r in good.groupBy(F.size("v").alias("dim")).count().collect()}
    if not lengths:
        return spark.createDataFrame([], shape)
    # lists are fitted for the commonest length; each other length is a list of its own
    dim = min(lengths, key=lambda d: (-lengths[d], d))
    of_dim = good.filter(F.size("v") == dim)
    unit_hash = F.pmod(F.xxhash64("row", "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = of_dim.filter(unit_hash < min(1.0, TRAIN_ROWS / lengths[dim])).select("v").limit(2 * TRAIN_ROWS).collect() or of_dim.select("v").limit(1).collect()
    centroids = fit(np.array([r["v"] for r in picked], float).reshape(len(picked), dim), lengths[dim])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lists are numbered from 0; a list of another length has its length below 0 as its number."""
        for b in batches:
            number, far = np.zeros(len(b), int), np.zeros(len(b))
            size = b["v"].map(len).to_numpy()
            for d in np.unique(size):
                here = np.flatnonzero(size == d)
                x = np.stack(b["v"].to_numpy()[here]).astype(float).reshape(len(here), d)
                if d == dim:
                    number[here] = nearest(x, centroids)
                    far[here] = np.sqrt(((x - centroids[number[here]]) ** 2).sum(1))
                else:
                    number[here], far[here] = -1 - d, np.sqrt((x * x).sum(1))
            b["list"], b["far"] = number, far
            yield b

    placed = stored(good.mapInPandas(place, "vec_id long, label string, v array<long>, asks boolean, row long, list int, far double"), "listed")
    # one row for each list and length
    told = placed.groupBy("list").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("size")).orderBy("list").collect()
    of = {}
    for r in told:
        d = dim if r["list"] >= 0 else -1 - r["list"]
        of.setdefault(d, []).append((r["list"], centroids[r["list"]] if r["list"] >= 0 else np.zeros(d), r["radius"], r["size"]))
    lists = spark.sparkContext.broadcast(Lists({d: tuple(map(np.array, zip(*x))) for d, x in of.items()}))  # as many centroids as fitted, at most

    def visits(asks: DataFrame, wanted: int, later: bool) -> DataFrame:
        """``asks`` with each list to visit: those that reach into a window and, by their upper bound, stand
        first; or later, of the others, those whose bound is not strictly below a window's k-th score."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                chosen = []
                for q, low, high, kth in zip(b["q"], b["low"], b["high"], b["kth"]):
                    number, least, most, sizes = lists.value.bounds(np.asarray(q, float))
                    reaches = lambda floor: ((most[:, None] >= floor) & (least[:, None] <= high)).any(1)  # noqa: B023, E731
                    inside = reaches(low)
                    order = np.argsort(-most, kind="stable")
                    held = np.where(inside, sizes, 0)[order]
                    start = np.zeros(len(most), bool)
                    start[order] = (np.cumsum(held) - held < FIRST_ROWS * wanted) & inside[order]
                    chosen.append(number[reaches(kth) & ~start if later else start])
                b["list"] = chosen
                yield b

        kinds = "anchor long, label string, q array<long>, low array<long>, high array<long>, kth array<long>"
        return stored(asks.mapInPandas(run, f"{kinds}, list array<int>").withColumn("list", F.explode("list")), "visits")

    def met(wishes: DataFrame, same: bool, k: int) -> DataFrame:
        """The best of each visited list in each window; long lists and many queries are cut into cells."""
        asked = wishes.groupBy("list").agg(F.count(F.lit(1)).alias("queries"))
        held = placed.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
        # one row for each list
        cells = F.broadcast(held.join(asked, "list").select("list", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("across"), F.ceil(F.col("queries") / CELL_QUERIES).cast("int").alias("down")))
        part = lambda n, key: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = placed.select("row", "vec_id", "label", "v", "list").join(cells, "list").withColumn("x", part("across", "row")).withColumn("y", spread("down")).drop("across", "down")
        here = wishes.join(cells, "list").withColumn("y", part("down", "anchor")).withColumn("x", spread("across")).drop("across", "down")
        names = [c.split()[0] for c in FOUND.split(", ")]

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = [[np.empty(0, np.int64)] * len(names)]
            if len(left) and len(right):
                d = len(right["v"].iloc[0])
                score = products(np.stack(left["q"]).reshape(len(left), d), np.stack(right["v"]).reshape(len(right), d))
                ids, rows, anchor = (x.to_numpy() for x in (right["vec_id"], right["row"], left["anchor"]))
                fits = (left["label"].to_numpy()[:, None] == right["label"].to_numpy()) == same
                fits &= anchor[:, None] != rows
                for place in range(left["low"].map(len).max()):
                    # a query with fewer windows takes nothing in this one
                    floor, top = (np.array([x[place] if place < len(x) else none for x in left[c]])[:, None] for c, none in (("kth", 1), ("high", 0)))
                    who, what = np.nonzero(fits & (score >= floor) & (score <= top) & (floor <= top))
                    first = _first(who, score[who, what], ids[what], rows[what], k)
                    who, what = who[first], what[first]
                    found.append([anchor[who], np.full(len(who), place), ids[what], rows[what], score[who, what]])
            return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*found))})

        keys = ["list", "x", "y"]
        return stored(here.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(meet, FOUND), "met")

    def best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def within(asks: DataFrame, same: bool, k: int) -> DataFrame:
        """The ``k`` best rows in each window ``low`` to ``high`` of each query, of its label or of others."""
        first = met(visits(asks.withColumn("kth", F.col("low")), k, False), same, k)
        kth = best(first, k).filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("reached"))
        risen = F.transform("low", lambda x, place: F.coalesce(F.try_element_at("reached", place.cast("long")), x))
        rest = visits(asks.join(kth, "anchor", "left").withColumn("kth", risen).drop("reached"), k, True)
        return stored(best(first.unionByName(met(rest, same, k)), k), "best")

    anchors = placed.filter("asks").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", F.col("v").alias("q"))
    any_score = [F.array(F.lit(x)).alias(n) for n, x in (("low", -(1 << 62)), ("high", 1 << 62))]
    near = within(anchors.select("anchor", "label", "q", *any_score), True, positives).select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hundredth = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")  # noqa: E731  rounded down, in whole numbers
    windows = near.withColumns({"low": hundredth(f"({low} * positive_score + 99)"), "high": hundredth(f"({high} * positive_score)")})
    listed = F.array_sort(F.collect_list(F.struct("place", "low", "high")))
    windows = windows.groupBy("anchor").agg(listed.alias("w")).select("anchor", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    far = within(anchors.drop("anchor_id").join(windows, "anchor"), False, negatives)
    named = near.join(anchors.select("anchor", "anchor_id"), "anchor")
    out = far.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql() -> str:
    """The mining of ``op12`` over ``embeddings`` in DuckDB, where no id repeats."""
    return """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
