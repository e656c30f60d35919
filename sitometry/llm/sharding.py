"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows lie in a fixed number of parts. How many rows of each part go to each cell of each shard
is drawn exactly, from the multivariate hypergeometric law that a uniform permutation has. Each
part is permuted locally and dealt by those counts, the rows are exchanged, and each cell is
permuted again; a row's slot is its cell's first slot plus its place there. Parts, cells and
matrix are of fixed size; no row leaves the DataFrame.
"""

from __future__ import annotations

import json
import random
from math import exp, lgamma

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS, PARTS, CELLS = 16, 128, 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls from an urn are good: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = (draws + 1) * (good + 1) // (good + bad + 2)

    def ln(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    at = exp(ln(good, mode) + ln(bad, draws - mode) - ln(good + bad, draws))
    u = rng.random() - at
    below, above, p, q = mode, mode, at, at
    while u > 0 and (below > low or above < high):
        if above < high:
            q *= (good - above) * (draws - above) / ((above + 1) * (bad - draws + above + 1))
            above += 1
            u -= q
            if u <= 0:
                return above
        if below > low:
            p *= below * (bad - draws + below) / ((good - below + 1) * (draws - below + 1))
            below -= 1
            u -= p
            if u <= 0:
                return below
    return mode


def matrix(rows: list[int], room: list[int], seed: int) -> list[list[int]]:
    """Counts with the given row sums and column sums, as a uniform permutation would have them."""
    rng, room, total = random.Random(seed), list(room), sum(room)
    out = []
    for n in rows:
        rest, line = total, []
        for k, c in enumerate(room):
            x = hypergeometric(rng, c, rest - c, n) if n and c else 0
            line.append(x)
            rest -= c
            n -= x
            room[k] = c - x
        total = sum(room)
        out.append(line)
    return out


def parted(n: int, k: int) -> list[int]:
    return [n // k + (i < n % k) for i in range(k)]


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """``docs(doc_id, text)`` as ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: shard sizes are at most one apart, so equal texts are spread like any
    others. Size is the UTF-8 length plus one; a null text has size 1 and the checksum of nothing,
    0. Repeated rows are separate rows; null ids are dealt like others; an empty table gives none.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(PARTS)).cast("int"))
    found = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    counts = [found.get(k, 0) for k in range(PARTS)]
    sizes = [n for s in parted(sum(counts), shards) for n in parted(s, CELLS)]
    drawn = matrix(counts, sizes, seed)
    first = [sum(sizes[c // CELLS * CELLS : c]) for c in range(len(sizes))]
    ends = [[sum(line[: c + 1]) for c in range(len(line))] for line in drawn]
    # PARTS rows of shards * CELLS numbers, whatever the corpus
    text = spark.range(1).select(F.from_json(F.lit(json.dumps(ends)), "array<array<long>>").alias("ends"), F.from_json(F.lit(json.dumps(first)), "array<long>").alias("first"))
    deal = stored(text.select("first", F.posexplode("ends").alias("part", "ends")), "deal")
    here = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32"), "doc_id", "size", "text_crc32")
    dealt = rows.withColumn("at", F.row_number().over(here) - 1).join(F.broadcast(deal), "part")
    dealt = dealt.withColumn("cell", F.size(F.filter("ends", lambda e: e <= F.col("at")))).withColumn("start", F.get("first", F.col("cell")))
    there = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "text_crc32"), "doc_id", "size", "text_crc32")
    out = dealt.select("doc_id", "size", "text_crc32", "cell", "start").withColumn("slot", F.row_number().over(there) - 1 + F.col("start"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.floor(F.col("cell") / CELLS).cast("int").alias("shard"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
