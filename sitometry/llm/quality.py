"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network.

Every word, and the shape of every word (which letters are capitals, digits or signs), has a
sparse random index vector; its word vector is the sum of the index vectors seen beside it. A
document is the mean of its words' vectors and of its shapes' vectors, with how often words repeat
the one before or one seen earlier. A hidden layer and one logit follow; a temperature fitted on
labelled texts kept aside makes the logit a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shingles import _BYTE, Shingler, _numbers

#: Word and shape vectors are kept for hashed words, so the model's size is fixed.
BUCKETS, DIM, ONES, REACH = 1 << 15, 48, 4, 2
#: Fitted on at most so many labelled texts, read whole by so many tasks.
TRAIN_ROWS, TRAIN_TASKS = 6000, 8
HIDDEN, EPOCHS, BATCH, RATE, SEED = 32, 30, 64, 0.004, 9
CUT = 0.3
BLOCK = 1 << 18

_WHITE = re.compile(rb"[\x09-\x0d ]")
_EXACT = _BYTE.copy()
_EXACT[65:91] = _numbers(51, 26)
_SHAPE = _BYTE.copy()
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = _BYTE[97], _EXACT[65], _BYTE[48], _BYTE[97]


def index_vectors(seed: int = SEED) -> np.ndarray:
    """One sparse ternary vector for each bucket: ONES entries of +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    at = rng.integers(0, DIM, (BUCKETS, ONES))
    np.put_along_axis(out, at, rng.choice(np.float32([-1, 1]), (BUCKETS, ONES)), 1)
    return out


class Reader:
    """A text as bucket numbers of its words and of their shapes, block by block."""

    def __init__(self) -> None:
        self.exact, self.shape = Shingler(_EXACT), Shingler(_SHAPE)

    def blocks(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        raw = text.encode("utf-8", "surrogatepass")
        at = 0
        while at < len(raw):
            end = min(len(raw), at + BLOCK)
            if end < len(raw):
                # a block ends at white space: no word is cut, however long
                stop = _WHITE.search(raw, end)
                end = stop.start() if stop else len(raw)
            part = raw[at:end]
            at = end
            full, _ = self.exact.words(part)
            if len(full):
                shape, _ = self.shape.words(part)
                yield full, (full % BUCKETS).astype(np.int64), (shape % BUCKETS).astype(np.int64)


@dataclass
class Model:
    word: np.ndarray
    shape: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.spread @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def pooled(reader: Reader, word: np.ndarray, shape: np.ndarray, text: str | None) -> np.ndarray:
    """The document vector; zeros without words."""
    out, n = np.zeros(2 * DIM + 4, np.float64), 0
    again, seen, last = 0, [], None
    for full, w, s in reader.blocks(text or ""):
        n += len(full)
        out[:DIM] += word[w].sum(0)
        out[DIM : 2 * DIM] += shape[s].sum(0)
        again += int((full[1:] == full[:-1]).sum()) + int(last == full[0])
        seen, last = [np.unique(np.concatenate([*seen, full]))], full[-1]
    if not n:
        return out.astype(np.float32)
    out /= n
    pairs = len(seen[0]) / n
    out[2 * DIM :] = again / n, pairs, np.log1p(n), np.log1p(n) * pairs
    return out.astype(np.float32)


def beside(reader: Reader, texts: Iterable[str]) -> np.ndarray:
    """For words, then for shapes, the sums of the index vectors beside them: whole numbers."""
    index, other = index_vectors(SEED), index_vectors(SEED + 1)
    sums = np.zeros((2, BUCKETS, DIM), np.float32)
    for t in texts:
        for _, w, s in reader.blocks(t):
            near = index[w] + other[s]
            total = np.zeros_like(near)
            for k in range(1, REACH + 1):
                total[k:] += near[:-k]
                total[:-k] += near[k:]
            np.add.at(sums[0], w, total)
            np.add.at(sums[1], s, total)
    return sums


def word_vectors(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the neighbours' index vectors, scaled to unit length; unseen buckets stay zero."""
    word, shape = sums
    for m in (word, shape):
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-6)
    return word + 0.5 * index_vectors(SEED), shape + 0.5 * index_vectors(SEED + 1)


def fit(texts: list[str], labels: list[int], prior: float | None = None, seed: int = SEED) -> Model:
    """A model of texts at hand; see ``fit_pooled``."""
    reader = Reader()
    word, shape = word_vectors(beside(reader, texts))
    x = np.stack([pooled(reader, word, shape, t) for t in texts]) if texts else np.zeros((0, 2 * DIM + 4), np.float32)
    return fit_pooled(word, shape, x, labels, prior, seed)


def fit_pooled(word: np.ndarray, shape: np.ndarray, x: np.ndarray, labels: list[int], prior: float | None = None, seed: int = SEED) -> Model:
    """``x``: document vectors. ``prior``: the share of label 1 where the scores will be used; by default that of ``labels``.

    The sample may be balanced; each text is weighted so that the classes have the prior's shares.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    model = Model(word, shape, x.mean(0) if len(x) else np.zeros(2 * DIM + 4), (x.std(0) if len(x) else 1.0) + 1e-3, [(rng.standard_normal((2 * DIM + 4, HIDDEN)) / 10).astype(np.float32), np.zeros(HIDDEN, np.float32), (rng.standard_normal(HIDDEN) / 6).astype(np.float32), np.zeros(1, np.float32)])
    if len(x) < 10 or y.min() == y.max():
        model.layers[2][:] = 0
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        model.layers[3][:] = np.log(p / (1 - p))
        return model
    own = float(y.mean())
    prior = own if prior is None else min(max(prior, 0.01), 0.99)
    weight = np.where(y == 1, prior / own, (1 - prior) / (1 - own)).astype(np.float32)
    order = rng.permutation(len(x))
    aside, train = order[: len(x) // 5], order[len(x) // 5 :]
    z = ((x - model.mean) / model.spread).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.layers]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for lo in range(0, len(train), BATCH):
            rows = train[lo : lo + BATCH]
            w1, b1, w2, b2 = model.layers
            h = np.tanh(z[rows] @ w1 + b1)
            g = (1 / (1 + np.exp(-(h @ w2 + b2[0]))) - y[rows]) * weight[rows] / len(rows)
            gh = np.outer(g, w2) * (1 - h * h)
            grads = [z[rows].T @ gh + 1e-4 * w1, gh.sum(0), h.T @ g + 1e-4 * w2, np.array([g.sum()], np.float32)]
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, d, (m, v) in zip(model.layers, grads, moments):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    raw, ya, wa = model.logit(x[aside]), y[aside], weight[aside]
    tries = np.exp(np.linspace(np.log(0.1), np.log(8), 60))
    losses = [float((wa * (np.logaddexp(0, raw / t) - ya * raw / t)).mean()) for t in tries]
    model.temperature = float(tries[int(np.argmin(losses))])
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, quality)``: about ``rows`` texts at most.

    A hash of the id picks them among the labels, at a rate from the labels' counts; the picked ids
    (their number bounded by ``rows``) are broadcast to the documents. Their texts are read whole in
    executors; the driver gets tables of fixed size and one vector a text. Ids whose labels disagree,
    and null labels, are not used.
    """
    agreed = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most").drop("_most")
    share = {r["quality"]: r["count"] for r in agreed.groupBy("quality").count().collect()}
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    each = rows // max(1, len(share))
    rate = F.coalesce(*[F.when(F.col("quality") == k, F.lit(min(1.0, each / n))) for k, n in share.items()], F.lit(0.0))
    picked = agreed.filter(unit < rate)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").filter("trim(text) != ''")
    found = stored(found.select("doc_id", "text", "quality").repartition(TRAIN_TASKS), "labelled")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = beside(Reader(), (t for b in batches for t in b["text"])).reshape(TRAIN_TASKS, -1)
        yield pd.DataFrame({"part": range(TRAIN_TASKS), "sums": [x.tobytes() for x in sums]})

    def added(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "sums": [np.sum([np.frombuffer(x, np.float32) for x in part["sums"]], 0).astype(np.float32).tobytes()]})

    sums = found.repartition(TRAIN_TASKS).mapInPandas(partial, "part int, sums binary").groupBy("part").applyInPandas(added, "part int, sums binary")
    parts = {r["part"]: bytes(r["sums"]) for r in sums.collect()}
    total = np.frombuffer(b"".join(parts[k] for k in sorted(parts)), np.float32) if parts else np.zeros(2 * BUCKETS * DIM, np.float32)
    word, shape = word_vectors(total.reshape(2, BUCKETS, DIM).copy())
    shared = docs.sparkSession.sparkContext.broadcast((word, shape))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "x": [pooled(reader, *shared.value, t).tobytes() for t in b["text"]]})

    kind = dict(found.dtypes)
    made = found.mapInPandas(vectors, f"doc_id {kind['doc_id']}, quality {kind['quality']}, x binary").collect()
    made.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in made]) if made else np.zeros((0, 2 * DIM + 4), np.float32)
    prior = share.get(1, 0) / max(1, sum(share.values()))
    return fit_pooled(word, shape, x, [int(r["quality"] == 1) for r in made], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; whole texts, however long, one pass, no shuffle.

    Null, empty and wordless texts get the score of a document without words. Each row stands alone:
    repeated rows give repeated rows, an empty table an empty one. Columns of these two names are
    replaced; all others pass through.
    """
    src = docs.drop("score", "predicted")
    out = src.withColumn("score", scorer(docs, model))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def scorer(docs: DataFrame, model: Model) -> Column:
    """The score of the column ``text``, for use under any name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader, m = Reader(), shared.value
        for t in text:
            x = np.stack([pooled(reader, m.word, m.shape, v if isinstance(v, str) else None) for v in t]) if len(t) else np.zeros((0, 2 * DIM + 4))
            yield pd.Series(m.score(x).astype(float) if len(x) else [], dtype="float64")

    return rate(F.col("text").cast("string"))
