"""Repeated passages removed: super-k-mers are dealt to buckets by their minimiser and counted there.

A window is ``width`` consecutive words of one text. Its minimiser is the run of ``MER`` words in it with
the least hash, the leftmost among equals. Consecutive windows with one minimiser travel as one string, a
super-k-mer, to the minimiser's bucket; equal windows have equal minimisers, so they meet there. In a
bucket the windows are sorted by hash, and windows of one hash are compared byte by byte: the counts are
exact. Strings of a bucket travel together, compressed.

A bucket with far more super-k-mers than others (a passage that many texts share) is split: in each part
a window that repeats is known at once, and of each window one string goes on to be counted over the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, stored
from .shingles import _BASE, _UNBASE, Shingler, _mixed, _numbers, _powers

#: Words of a minimiser, and how many of its bits order it (the others tell its place).
MER, PLACE_BITS = 5, 28
#: Bytes hashed at a time.
SLICE = 1 << 20
#: Bytes of text cut at a time, of strings in a bucket, about, and of a text's key.
CHUNK_BYTES, BUCKET_BYTES, KEY = 8 << 20, 16 << 20, 12
#: Counts are kept for so many classes of minimisers; a bucket is split when it has so many times the mean.
CELLS, HOT = 1 << 14, 3
#: Buckets in a task, about, and how many texts may have more copies than their share of a join allows.
BUCKETS_A_TASK, COPIED = 4, 10_000
#: Texts that a task remembers, to send no text more than twice.
REMEMBERED = 200_000
#: How hard the strings are compressed.
LEVEL = 6

_PLACE = np.uint64((1 << PLACE_BITS) - 1)
_MERS = _numbers(77, 64)


def _shingler() -> Shingler:
    return Shingler(_numbers(11, 256))


def _hashed(shingler: Shingler, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, about a megabyte of words at a time."""
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) + 1 or len(data)
        h, start = shingler.words(data[at:end])
        hashes.append(h)
        starts.append(start + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


class Cut:
    """The super-k-mers of a few texts: the text of each, its first window, how many, and its minimiser."""

    def __init__(self, texts: list[str], width: int, shingler: Shingler) -> None:
        parts = [b" ".join(t.encode("utf-8", "surrogatepass").split()) for t in texts]
        self.data = b" ".join(parts) + b" "
        words, self.start = _hashed(shingler, self.data)
        self.end = np.append(self.start[1:], len(self.data)) - 1
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.first_word = np.searchsorted(self.start, bounds)
        full = np.flatnonzero(np.diff(self.first_word))  # a text's last word ends with it, whatever empty texts follow
        self.end[self.first_word[full + 1] - 1] = bounds[full + 1] - 1
        none = np.empty(0, np.int64)
        self.text = self.first = self.count = none
        self.mini = none.astype(np.uint64)
        mer = min(MER, width)
        if len(words) < width:
            return
        hashes = np.zeros(len(words) - mer + 1, np.uint64)
        for k in range(mer):
            hashes += words[k : len(words) - mer + 1 + k] * _MERS[k]
        hashes = _mixed(hashes)
        least, span, want = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), 1, width - mer + 1
        while span * 2 <= want:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < want:
            least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
        own = np.repeat(np.arange(len(texts)), np.diff(self.first_word))
        at = np.flatnonzero(own[: len(words) - width + 1] == own[width - 1 :])
        if not len(at):
            return
        place = (least[at] & _PLACE).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (own[at[1:]] != own[at[:-1]]))))
        self.count = np.diff(np.append(edge, len(at)))
        self.text = own[at[edge]]
        self.first = at[edge]
        self.mini = hashes[place[edge]]

    def strings(self, chosen: np.ndarray, width: int) -> bytes:
        first = self.first[chosen]
        low, high = self.start[first], self.end[first + self.count[chosen] + width - 2]
        return b"\n".join([self.data[a:z] for a, z in zip(low.tolist(), high.tolist())])


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Keys and texts, some megabytes at a time; of equal texts that meet here two go on."""
    seen: dict[bytes, int] = {}
    keys, texts, size = [], [], 0
    for b in batches:
        for key, text in zip(b["key"], b["text"]):
            if text is None or seen.get(key, 0) > 1:
                continue
            if len(seen) > REMEMBERED:
                seen.clear()
            seen[key] = seen.get(key, 0) + 1
            keys.append(bytes(key))
            texts.append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _same(data: bytes, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` and ``b`` are equal, eight at a time."""
    eight = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
    out, left = np.ones(len(a), bool), np.arange(len(a))
    for k in range(0, int(size.max(initial=0)), 8):
        left = left[size[left] > k]
        at = np.maximum(np.minimum(k, size[left] - 8), 0)
        x, y = eight[a[left] + at], eight[b[left] + at]
        short = size[left] < 8
        if short.any():
            keep = (np.uint64(1) << (8 * np.minimum(size[left], 7)).astype(np.uint64)) - np.uint64(1)
            x, y = np.where(short, x & keep, x), np.where(short, y & keep, y)
        out[left] &= x == y
    return out


def counted(strings: bytes, count: np.ndarray, width: int, shingler: Shingler) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """For each window of super-k-mers (one a line): how many equal it and the first of these, and the
    bytes it covers in the returned text."""
    data = strings + b"\n" + bytes(8)
    words, start = _hashed(shingler, data[:-8])
    end = np.append(start[1:], len(data) - 8) - 1
    heads = np.concatenate(([0], np.cumsum(count + width - 1)[:-1]))
    first = np.repeat(heads - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    low, size = start[first], end[first + width - 1] - start[first]
    up, down = _powers(_BASE, len(words)), _powers(_UNBASE, len(words))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up)))
    whole = _mixed((sums[first + width] - sums[first]) * down[first])
    order = np.argsort(whole, kind="stable")
    new = np.concatenate(([True], whole[order][1:] != whole[order][:-1]))
    group = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][group]
    many, same = np.bincount(group)[group], np.empty(len(order), np.int64)
    again = np.flatnonzero((many > 1) & (order != head))
    a, b = order[again], head[again]
    equal = size[a] == size[b]
    equal[equal] = _same(data, low[a[equal]], low[b[equal]], size[a[equal]])
    number = np.empty(len(order), np.int64)
    number[order], same[order] = many, head
    for g in np.unique(group[again[~equal]]):
        # one hash for several windows: these few are told apart by their bytes
        known: dict[bytes, list[int]] = {}
        for w in order[group == g]:
            known.setdefault(data[low[w] : low[w] + size[w]], []).append(w)
        for members in known.values():
            number[members], same[members] = len(members), members[0]
    return number, same, low, size, data


FOUND = "key binary, low int, high int, window binary, n int"


def _counter(width: int):
    """Counts one bucket, or one part of a split one."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        strings, heads = [], []
        for text, length, head, held in zip(group["strings"], group["length"], group["heads"], group["held"]):
            strings.append(pa.decompress(text, length, "zstd", asbytes=True))
            heads.append(np.frombuffer(pa.decompress(head, held * (KEY + 8), "zstd", asbytes=True), np.uint8).reshape(KEY + 8, held))
        columns = np.concatenate(heads, 1)
        key = np.ascontiguousarray(columns[:KEY].T)
        word = np.ascontiguousarray(columns[KEY : KEY + 4].T).view("<u4").ravel().astype(np.int64)
        count = np.ascontiguousarray(columns[KEY + 4 :].T).view("<u4").ravel().astype(np.int64)
        number, same, low, size, data = counted(b"\n".join(strings), count, width, _shingler())
        owner = np.repeat(np.arange(len(count)), count)
        place = word[owner] + np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
        hit = number > 1
        begins = hit & ~(np.concatenate(([False], hit[:-1])) & np.concatenate(([False], owner[1:] == owner[:-1])))
        ends = hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((owner[1:] == owner[:-1], [False])))
        a, z = np.flatnonzero(begins), np.flatnonzero(ends)
        out = pd.DataFrame({"key": [key[i].tobytes() for i in owner[a]], "low": place[a].astype(np.int32), "high": (place[z] + width - 1).astype(np.int32), "window": None, "n": np.int32(2)})
        if group["parts"].iloc[0] == 1:
            return out
        one = np.flatnonzero(same == np.arange(len(same)))
        rest = pd.DataFrame({"key": [key[i].tobytes() for i in owner[one]], "low": place[one].astype(np.int32), "high": (place[one] + width - 1).astype(np.int32), "window": [data[p : p + s] for p, s in zip(low[one].tolist(), size[one].tolist())], "n": np.minimum(number[one], 2).astype(np.int32)})
        return pd.concat([out, rest])

    return run


def repeated(texts: DataFrame, width: int = 35) -> DataFrame:
    """``key, low, high``: runs of words of ``texts(key, text)`` that windows cover which also start elsewhere.

    ``key`` tells a text (equal texts share it), ``low`` and ``high`` are its first and last word.
    """

    def tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, size, shingler = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64), _shingler()
        for _, found in _chunks(batches):
            c = Cut(found, width, shingler)
            cell = (c.mini % np.uint64(CELLS)).astype(np.int64)
            cells += np.bincount(cell, minlength=CELLS)
            size += np.bincount(cell, c.end[c.first + c.count + width - 2] - c.start[c.first], CELLS).astype(np.int64)
        some = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": some, "held": cells[some], "size": size[some]})

    told = texts.mapInPandas(tallied, "cell long, held long, size long").groupBy("cell").agg(F.sum("held").alias("held"), F.sum("size").alias("size")).collect()  # at most CELLS rows
    cells, size = np.zeros(CELLS, np.int64), sum(r["size"] for r in told)
    for r in told:
        cells[r["cell"]] = r["held"]
    n = 1 << int(max(2 * buckets(texts.sparkSession), size / BUCKET_BYTES, 1) - 1).bit_length()
    # classes of a bucket, or buckets of a class: both numbers are powers of two
    held = cells.reshape(-1, n).sum(0) if n <= CELLS else cells
    mean = max(1.0, cells.sum() / len(held))
    parts = np.where(held > HOT * mean, np.ceil(held / mean), 1).astype(np.int64)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, codec, sent = _shingler(), pa.Codec("zstd", compression_level=LEVEL), 0
        for keys, found in _chunks(batches):
            c = Cut(found, width, shingler)
            bucket = (c.mini % np.uint64(n)).astype(np.int64)
            split = parts[bucket % len(parts)]
            part = (np.arange(len(bucket)) + sent) % split
            sent += len(bucket)
            key = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), KEY)
            head = np.concatenate((key[c.text], (c.first - c.first_word[c.text]).astype("<u4")[:, None].view(np.uint8), c.count.astype("<u4")[:, None].view(np.uint8)), 1)
            order = np.lexsort((part, bucket))
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(bucket[order]) != 0) | (np.diff(part[order]) != 0)))) if len(order) else []
            rows = []
            for chosen in np.split(order, edge[1:]) if len(order) else []:
                strings = c.strings(chosen, width)
                i = chosen[0]
                rows.append((int(bucket[i]), int(part[i]), int(split[i]), codec.compress(strings, asbytes=True), len(strings), codec.compress(head[chosen].T.tobytes(), asbytes=True), len(chosen)))
            yield pd.DataFrame(rows, columns=["bucket", "part", "parts", "strings", "length", "heads", "held"])

    packed = texts.mapInPandas(dealt, "bucket long, part long, parts long, strings binary, length long, heads binary, held long")
    # as many tasks as the buckets ask for: what one reads does not grow with the input
    spread = packed.repartition(max(buckets(texts.sparkSession), n // BUCKETS_A_TASK), "bucket", "part")
    found = stored(spread.groupBy("bucket", "part").applyInPandas(_counter(width), FOUND), "counted")
    # windows of split buckets: one string of each from each part
    open_ = found.filter("window is not null")
    all_parts = open_.groupBy("window").agg(F.sum("n").alias("total")).filter("total > 1")
    late = open_.filter("n = 1").join(all_parts, "window", "left_semi")
    return found.filter("window is null").select("key", "low", "high").unionByName(late.select("key", "low", "high"))


def deduplicated(docs: DataFrame, width: int = 35) -> DataFrame:
    """``doc_id, text, n_words, n_removed`` of ``docs(doc_id, text)``, one row for each of its rows.

    Words are runs of what is not ASCII white space, unchanged. Each word is removed that lies in a
    window of ``width`` words which also starts elsewhere, in the same text or another; windows are judged
    on the texts as they came. What is left is joined by one space. A null or empty text has no words
    and becomes empty; rows that repeat, with or without their id, are texts that repeat. An empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.substring(F.unhex(F.md5("text")), 1, KEY))
    runs = repeated(rows.select("key", "text"), width).groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    # every window of a copied text repeats: texts with very many copies (at most COPIED of them) and null ones are spread and meet no runs
    many = rows.filter("key is not null").groupBy("key").count().filter(F.col("count") > max(1000, rows.count() // COPIED))
    rows = rows.join(F.broadcast(many.select("key", F.lit(True).alias("whole"))), "key", "left")
    alone = F.concat(F.coalesce("key", F.lit(b"")), F.monotonically_increasing_id().cast("string").cast("binary"))
    rows = rows.withColumn("key", F.when(F.col("whole") | F.col("key").isNull(), alone).otherwise(F.col("key")))
    met = rows.join(runs, "key", "left").select("doc_id", "text", "whole", F.col("runs.low").alias("low"), F.col("runs.high").alias("high"))

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, sizes, gone = [], [], []
            for text, whole, low, high in zip(b["text"], b["whole"], b["low"], b["high"]):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                steps = np.zeros(len(words) + 1, np.int64)
                if whole is True and len(words) >= width:
                    steps[0] = 1
                elif low is not None:
                    np.add.at(steps, np.asarray(low, np.int64), 1)
                    np.add.at(steps, np.asarray(high, np.int64) + 1, -1)
                kept = np.cumsum(steps[:-1]) == 0
                texts.append(b" ".join([w for w, k in zip(words, kept.tolist()) if k]).decode("utf-8", "surrogatepass"))
                sizes.append(len(words))
                gone.append(len(words) - int(kept.sum()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "n_words": sizes, "n_removed": gone})

    return met.mapInPandas(removed, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, n_words long, n_removed long")


def sql(width: int = 35) -> str:
    """The digest of ``op11`` over ``documents`` in DuckDB, where no id repeats."""
    return rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {width - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY win) > 1 AS again FROM s),
k AS (SELECT p.doc_id, p.i, word, coalesce(bool_or(again) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i),
c AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""
