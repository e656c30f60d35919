"""Packing token sequences: non-negative least squares over length combinations, then greedy.

Documents are cut only where they exceed the window, so every piece is a full window or the rest
of a document. The piece lengths form a histogram of at most ``window`` cells, whatever the number
of documents; shallow combinations of (rounded) lengths that fill a window are its columns, and
non-negative least squares says how often to repeat each. Repeat counts are rounded down to what
the exact lengths allow and the residual lengths are packed largest first. All of that runs on the
histogram; the pieces then find their place by their rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import stored

WINDOW = 4096
END_ID = 2
GRAIN = 8
#: Ranks within one length are counted in parts of about so many pieces, so no length gathers in one task.
PART_ROWS = 100_000


def combinations(cells: int) -> list[dict[int, int]]:
    """Multisets of cell widths that fill ``cells``: up to three parts, or one width repeated and its rest."""
    found = {((cells, 1),): {cells: 1}}
    for a in range(1, cells):
        for b in range(a, (cells - a) // 2 + 1):
            c: dict[int, int] = {}
            for w in (a, b, cells - a - b):
                c[w] = c.get(w, 0) + 1
            found[tuple(sorted(c.items()))] = c
        for times in {1, cells // a, max(1, cells // a - 1)}:
            rest = cells - times * a
            if rest >= 0:
                c = {a: times}
                if rest:
                    c[rest] = c.get(rest, 0) + 1
                found[tuple(sorted(c.items()))] = c
    return list(found.values())


def least_squares(columns: list[dict[int, int]], target: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x with A x near ``target`` by multiplicative updates, A in coordinate form."""
    col = np.fromiter((k for k, c in enumerate(columns) for _ in c), int)
    row = np.fromiter((w for c in columns for w in c), int)
    val = np.fromiter((v for c in columns for v in c.values()), float)
    n = len(columns)
    wanted = np.bincount(col, val * target[row], n)
    x = np.where(wanted > 0, wanted / max(1.0, wanted.sum()) * target.sum(), 0.0)
    for _ in range(steps):
        made = np.bincount(row, val * x[col], len(target))
        x *= wanted / np.maximum(np.bincount(col, val * made[row], n), 1e-12)
    return x


def plan(counts: dict[int, int], window: int = WINDOW, grain: int = GRAIN) -> pd.DataFrame:
    """Where the pieces of each length go: rows ``length, lo, hi, first, times, at``.

    Piece number r of its length, lo <= r < hi, is part ``(r - lo) % times`` of sequence
    ``first + (r - lo) // times`` and starts at ``at`` plus that part's number times the length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, ...]] = []
    sequences = 0

    def place(parts: list[tuple[int, int]], repeats: int) -> None:
        nonlocal sequences
        at = 0
        for n, times in parts:
            rows.append((n, used[n], used[n] + repeats * times, sequences, times, at))
            used[n] += repeats * times
            left[n] -= repeats * times
            at += n * times
            if not left[n]:
                del left[n]
        sequences += repeats

    cells = window // grain
    by_cell: dict[int, list[int]] = {}
    for n in sorted(left):
        by_cell.setdefault(-(-n // grain), []).append(n)
    target = np.zeros(cells + 1)
    for w, lengths in by_cell.items():
        target[w] = sum(left[n] for n in lengths)
    columns = [c for c in combinations(cells) if all(target[w] for w in c)]
    if columns:
        x = least_squares(columns, target)
        for k in np.argsort(-x, kind="stable"):
            repeats = int(x[k])
            while repeats > 0:
                parts: dict[int, int] = {}
                for w, times in columns[k].items():
                    for n in reversed(by_cell[w]):
                        take = min(times, left.get(n, 0))
                        if take:
                            parts[n] = parts.get(n, 0) + take
                            times -= take
                        if not times:
                            break
                    if times:
                        break
                else:
                    m = min(repeats, min(left[n] // t for n, t in parts.items()))
                    place(list(parts.items()), m)
                    repeats -= m
                    continue
                break
    lengths = sorted(left)
    while lengths:
        parts, room = {}, window
        spare = dict(left)
        at = len(lengths)
        while room and at:
            at = bisect_right(lengths, room, 0, at)
            if at:
                n = lengths[at - 1]
                take = min(spare[n], room // n)
                parts[n] = take
                room -= take * n
                at -= 1
        place(list(parts.items()), min(left[n] // t for n, t in parts.items()))
        lengths = [n for n in lengths if n in left]
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "first", "times", "at"], dtype="int64").sort_values(["length", "lo"], ignore_index=True)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, cache_words: int = bpe.CACHE_WORDS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: each document's ids cut at the window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = bpe.transducer(path, cache_words, True)
        for b in batches:
            rows = []
            for d, text in zip(b["doc_id"], b["text"]):
                data = bpe.id_bytes(t, text, end_id)
                n = len(data) // 4
                rows += [(d, s, min(window, n - s), zlib.crc32(data[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, cache_words: int = bpe.CACHE_WORDS) -> DataFrame:
    """One row per piece with its sequence and its place there.

    Null and empty texts are documents of the end id alone. Repeated rows are separate documents;
    rows that agree in all columns may change places. Null ids are packed too. An empty table gives
    no rows. A very long text is read in blocks and its pieces are rows like any others. Other columns
    of the input are not read, whatever their names. Only the histogram (at most ``window`` cells) and
    the plan, whose rows do not grow with the corpus, pass through the driver. ``cache_words`` bounds
    the encoder's caches: memory for time only.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, path or bpe.default_path(), window, end_id, cache_words), "pieces")
    hist = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    steps = plan(hist, window)
    split = [-(-hist.get(n, 1) // PART_ROWS) for n in range(window + 1)]
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.get(F.lit(split).cast("array<int>"), F.col("length").cast("int"))).cast("int"))
    counts = cut.groupBy("length", "salt").count()
    offsets = counts.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    part = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("k", F.row_number().over(part) - 1)
    # a row for each length and each PART_ROWS pieces: beyond a million the join shuffles instead
    small = window + sum(hist.values()) / PART_ROWS < 1_000_000
    ranked = ranked.join(F.broadcast(offsets) if small else offsets, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("k") + F.col("base")).alias("rank"))
    key = steps["length"].to_numpy() * (1 << 40) + steps["lo"].to_numpy()
    table = {c: steps[c].to_numpy() for c in ("lo", "first", "times", "at")}
    shared = spark.sparkContext.broadcast((key, table))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, t = shared.value
        for b in batches:
            k = np.searchsorted(keys, b["length"].to_numpy() * (1 << 40) + b["rank"].to_numpy(), "right") - 1
            ahead = b["rank"].to_numpy() - t["lo"][k]
            b["sequence_id"] = t["first"][k] + ahead // t["times"][k]
            b["offset"] = t["at"][k] + ahead % t["times"][k] * b["length"].to_numpy()
            yield b.drop(columns="rank")

    return ranked.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
