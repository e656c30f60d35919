"""Nearest neighbours by cosine: probed lists scanned in column blocks with adaptive abandoning.

Vectors are scaled to length one, rotated at random and dealt to lists by their nearest centroid.
Each query first scans its nearest list and then, with the bound that it brings from there, the other
lists it probes. Within a list rows come in chunks and stand in blocks of columns. After each block a
hypothesis test on the rotated vectors' partial distances abandons every candidate that is unlikely to
come nearer than the query's worst neighbour so far; survivors are scored exactly on the original
vectors, and after each chunk the bound falls to the new worst neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The centroids are fitted on about so many vectors at most; every vector is indexed.
TRAIN_ROWS, ROUNDS, SEED = 20_000, 6, 17
#: Vectors for each list, and lists at most: as many as the sample can place.
ROWS_A_LIST, MOST_LISTS = 200, 1024
#: A query probes as many lists as so many sample queries needed for that recall of so many nearest.
TRIALS, RECALL, NEAREST = 256, 0.96, 5
#: Columns scanned between tests, how sure a test must be (larger abandons less), and rows between bounds.
BLOCK, SURE, CHUNK = 16, 2.1, 128
#: Vectors and queries that meet in one task, about.
CELL_ROWS, CELL_QUERIES = 1_000, 1_000


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def usable(vectors: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    sound = F.forall(vectors, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(sound & F.exists(vectors, lambda v: v != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(sample: np.ndarray, rows: int | None = None, seed: int = SEED) -> Index:
    """Spherical k-means on rotated unit vectors; copies of a vector count once.

    There are more lists for more ``rows`` in the table, up to a tenth of the sample.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    x = np.unique(unit(sample.astype(float)), axis=0) @ rotation
    k = int(min(MOST_LISTS, max(1, len(x) // 10), max(1, (rows or len(x)) // ROWS_A_LIST)))
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = (x @ centroids.T).argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centroids = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centroids)
    return Index(rotation, centroids, probes_needed(x, centroids, rng))


def probes_needed(x: np.ndarray, centroids: np.ndarray, rng: np.random.Generator) -> int:
    """The fewest lists, nearest first, that hold the share RECALL of sample queries' true neighbours.

    The sample is sparser than the corpus, so its neighbours are farther: the number errs upwards.
    """
    if len(x) <= NEAREST:
        return len(centroids)
    own = (x @ centroids.T).argmax(1)
    trial = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    near = x[trial] @ x.T
    near[np.arange(len(trial)), trial] = -np.inf
    true = np.argpartition(-near, NEAREST - 1, 1)[:, :NEAREST]
    place = np.argsort(np.argsort(-(x[trial] @ centroids.T), 1), 1)
    return int(np.quantile(np.take_along_axis(place, own[true], 1), RECALL, method="higher")) + 1


def scan(index: Index, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None, tally: list[int] | None = None) -> list[tuple[int, int, float]]:
    """The ``k`` best of one list's vectors for each query, by the exact cosine of the originals.

    ``bounds``: squared distances on the unit sphere that a query's neighbours must not exceed, as
    known from other lists; rows beyond them are not returned. ``tally`` takes how many candidates
    were scored exactly.
    """
    x = unit(vectors) @ index.rotation
    q = unit(queries) @ index.rotation
    dim = x.shape[1]
    edges = [*range(0, dim, BLOCK), dim]
    worst = np.full(len(q), np.inf) if bounds is None else bounds.astype(float).copy()
    top_q, top_id, top_score = np.empty(0, int), np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(x), CHUNK):
        rows = np.arange(at, min(at + CHUNK, len(x)))
        a = edges[1]
        partial = (q[:, :a] ** 2).sum(1)[:, None] + (x[rows, :a] ** 2).sum(1) - 2 * q[:, :a] @ x[rows, :a].T
        who, what = np.nonzero((partial <= _allowed(worst, a, dim)[:, None]) & (ids[rows] != query_ids[:, None]))
        partial, what = partial[who, what], rows[what]
        for a, b in zip(edges[1:], edges[2:]):
            if not len(who):
                break
            partial = partial + ((x[what, a:b] - q[who, a:b]) ** 2).sum(1)
            keep = partial <= _allowed(worst, b, dim)[who]
            who, what, partial = who[keep], what[keep], partial[keep]
        if not len(who):
            continue
        if tally is not None:
            tally.append(len(who))
        score = exact(queries[who], vectors[what])
        top_q, top_id, top_score = np.concatenate((top_q, who)), np.concatenate((top_id, ids[what])), np.concatenate((top_score, score))
        order = np.lexsort((top_id, -top_score, top_q))
        top_q, top_id, top_score = top_q[order], top_id[order], top_score[order]
        # a repeated id counts once towards the k best
        again = np.concatenate(([False], (top_q[1:] == top_q[:-1]) & (top_id[1:] == top_id[:-1])))
        top_q, top_id, top_score = top_q[~again], top_id[~again], top_score[~again]
        place = np.arange(len(top_q)) - np.searchsorted(top_q, top_q)
        keep = place < k
        top_q, top_id, top_score, place = top_q[keep], top_id[keep], top_score[keep], place[keep]
        full = place == k - 1
        worst[top_q[full]] = np.minimum(worst[top_q[full]], 2 - 2 * top_score[full])
    return [(int(query_ids[i]), int(j), float(v)) for i, j, v in zip(top_q, top_id, top_score)]


def _allowed(worst: np.ndarray, seen: int, dim: int) -> np.ndarray:
    """The largest partial distance over ``seen`` of ``dim`` columns that may yet fall within ``worst``."""
    return (worst * (seen / dim) * (1 + SURE / np.sqrt(seen)) ** 2 if seen < dim else worst) + 1e-9


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row summed alike whatever stands beside it."""
    dots = (vectors * query).sum(1)
    return dots / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum(-1)))


def search(vectors: DataFrame, is_query: Column, k: int = 5, probes: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors(vec_id, embedding)`` that ask.

    Null, zero and unsound vectors take no part, nor rows with a null id; nor, where lengths differ,
    vectors of any but the commonest length (the shorter among equals). All others are indexed. Ties
    go to the smaller id; a repeated id keeps its best place. A query probes on until its lists hold ``k``
    rows besides its own. A list with many vectors, or asked by many queries, is cut into cells, by
    hashes of the ids; each cell's best are merged. An empty table gives no rows; other columns of the
    input are not read, whatever their names.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = good.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    shape = "query_id long, rank int, vec_id long, score double"
    lengths = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], shape)
    dim, n = lengths[0]
    good = good.filter(F.size("v") == dim)
    # identical rows have one hash: the limit holds whatever the table
    unit_hash = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / float(1 << 30)
    picked = good.filter(unit_hash < min(1.0, TRAIN_ROWS / n)).select("v").limit(2 * TRAIN_ROWS).collect() or good.select("v").limit(1).collect()
    index = fit(np.array([r["v"] for r in picked]), n)
    shared = spark.sparkContext.broadcast(index)  # at most MOST_LISTS centroids

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for b in batches:
            if len(b):
                b["list"] = (unit(np.stack(b["v"])) @ ix.rotation @ ix.centroids.T).argmax(1)
                yield b

    placed = stored(good.mapInPandas(assign, "vec_id long, v array<double>, asks boolean, list int"), "placed")
    # one number for each list
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in placed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    wanted = probes or index.probes

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for b in batches:
            order = np.argsort(-(unit(np.stack(b["query"])) @ ix.rotation @ ix.centroids.T), 1, kind="stable") if len(b) else np.zeros((0, 1), int)
            enough = (np.cumsum(sizes[order], 1) <= k).sum(1) + 1
            b["lists"] = [row[: max(wanted, m)] for row, m in zip(order, enough)]
            yield b

    asks = placed.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query")).mapInPandas(probe, "query_id long, query array<double>, lists array<int>")
    asks = stored(asks, "asks")
    part = lambda salt, n, key: F.pmod(F.xxhash64(key, F.lit(salt)), F.col(n)).cast("int")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        found = scan(shared.value, right["vec_id"].to_numpy(), np.stack(right["v"]), left["query_id"].to_numpy(), np.stack(left["query"]), k, left["bound"].to_numpy())
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def scanned(wishes: DataFrame) -> DataFrame:
        """``wishes(query_id, query, list, bound)`` met with the lists' vectors."""
        asked = wishes.groupBy("list").agg(F.count(F.lit(1)).alias("queries"))
        held = placed.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
        # one row for each list, at most MOST_LISTS
        cells = F.broadcast(held.join(asked, "list").select("list", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("across"), F.ceil(F.col("queries") / CELL_QUERIES).cast("int").alias("down")))
        rows = placed.select("vec_id", "v", "list").join(cells, "list").withColumn("x", part(1, "across", "vec_id")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
        here = wishes.join(cells, "list").withColumn("y", part(2, "down", "query_id")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
        keys = ["list", "x", "y"]
        return here.select(*keys, "query_id", "query", "bound").groupBy(*keys).cogroup(rows.select(*keys, "vec_id", "v").groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")

    first = stored(scanned(asks.select("query_id", "query", F.get("lists", F.lit(0)).alias("list"), F.lit(float("inf")).alias("bound"))), "first")
    best = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    known = best.withColumn("place", F.row_number().over(top)).filter(F.col("place") == k).select("query_id", (F.lit(2.0) - 2 * F.col("score")).alias("bound"))
    more = asks.join(known, "query_id", "left").select("query_id", "query", F.explode(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0)))).alias("list"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = first.unionByName(scanned(more)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
