"""Language identification by a byte convolutional network trained in numpy.

Byte embeddings, filters of several widths, rectification, maximum over a fixed-length window and
softmax. A text is read whole, in windows that overlap by the widest filter less one; its windows'
log probabilities, weighted by their share of the text, are added up. Filters stand at every second
byte of a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, spare, stored

WINDOW, STEP, DEPTH, FILTERS = 256, 2, 8, 24
WIDTHS = (3, 5, 7)
#: The network is fitted on about so many labelled texts, and so many windows of them, spread over whole texts.
TRAIN_ROWS, TRAIN_WINDOWS = 3000, 40_000
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.004, 5
UNDECIDED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def hidden(self, x: np.ndarray, back: bool = False):
        """Window bytes (n, WINDOW) to pooled features (n, len(WIDTHS) * FILTERS)."""
        e = self.embed[x].reshape(len(x), -1)
        pooled, kept = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            k = (WINDOW - w) // STEP + 1
            view = np.lib.stride_tricks.as_strided(e, (len(x), k, w * DEPTH), (e.strides[0], e.itemsize * DEPTH * STEP, e.itemsize), writeable=False)
            made = np.ascontiguousarray(view).reshape(-1, w * DEPTH) @ f
            made = made.reshape(len(x), k, FILTERS)
            if back:
                at = made.argmax(1)
                kept.append(at)
                top = np.take_along_axis(made, at[:, None], 1)[:, 0]
            else:
                top = made.max(1)
            pooled.append(np.maximum(top + b, 0))
        return np.concatenate(pooled, 1), kept

    def log_proba(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x)[0] @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a whole text, zero-filled at its end, and the bytes that each adds."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    stride = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(raw) - WINDOW) // stride) + 1)
    full = np.zeros((n - 1) * stride + WINDOW, np.uint8)
    full[: len(raw)] = raw
    own = np.full(n, stride, np.float32)
    own[-1] = max(1, min(len(raw) - (n - 1) * stride, WINDOW))
    return np.lib.stride_tricks.as_strided(full, (n, WINDOW), (stride, 1), writeable=False), own


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit on all windows of whole texts."""
    langs = sorted(set(labels))
    made = [(windows(t)[0], langs.index(y)) for t, y in zip(texts, labels)]
    x = np.concatenate([w for w, _ in made]) if made else np.zeros((0, WINDOW), np.uint8)
    return fit_windows(langs, x, np.concatenate([np.full(len(w), k) for w, k in made]) if made else np.zeros(0, int), epochs, seed)


def fit_windows(langs: list[str], x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on cross entropy, classes weighted alike."""
    rng = np.random.default_rng(seed)
    put = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)
    net = Network(langs, put(256, DEPTH) * 4, [put(w * DEPTH, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], put(len(WIDTHS) * FILTERS, len(langs)), np.zeros(len(langs), np.float32))
    if not len(x):
        return net
    share = np.bincount(y, minlength=len(langs))
    weight = (len(y) / len(langs) / np.maximum(share, 1)).astype(np.float32)
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            rows = order[lo : lo + BATCH]
            xb, yb = x[rows], y[rows]
            h, kept = net.hidden(xb, True)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), yb] -= 1
            p *= (weight[yb] / len(rows))[:, None]
            gh = (p @ net.out.T) * (h > 0)
            g_out, g_bias = h.T @ p, p.sum(0)
            g_embed, g_filters, g_fbias = np.zeros_like(net.embed), [], []
            for k, w in enumerate(WIDTHS):
                g = gh[:, k * FILTERS : (k + 1) * FILTERS]
                at = kept[k] * STEP
                seen = xb[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(w)]
                g_filters.append(np.einsum("nf,nfd->df", g, net.embed[seen].reshape(len(rows), FILTERS, -1)))
                g_fbias.append(g.sum(0))
                np.add.at(g_embed, seen, (g[:, :, None] * net.filters[k].T[None]).reshape(len(rows), FILTERS, w, DEPTH))
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p_, g, m, v in zip(net.parts(), [g_embed, *g_filters, *g_fbias, g_out, g_bias], first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_WINDOWS) -> Network:
    """Fit on labelled ``docs(doc_id, text, lang)``.

    About ``rows`` texts, shared out among languages, are cut to windows in the executors, whole; where
    that makes more than ``most`` windows, a hash of each window keeps about as many of them, wherever
    they stand. So the driver holds at most about ``most`` windows of fixed size.
    """
    found = stored(bounded_sample(docs, "lang", rows), "language_sample")
    stride = WINDOW - max(WIDTHS) + 1
    total = found.agg(F.sum(F.ceil(F.octet_length("text") / stride))).collect()[0][0] or 0
    rate = min(1.0, most / max(1, total))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            labels, kept = [], []
            for text, label in zip(b["text"], b["label"]):
                for w in windows(text)[0]:
                    raw = w.tobytes()
                    if rate == 1 or zlib.crc32(raw) < rate * (1 << 32):
                        kept.append(raw)
                        labels.append(label)
            yield pd.DataFrame({"label": labels, "raw": kept})

    got = sorted((r["label"], bytes(r["raw"])) for r in found.mapInPandas(cut, f"label {dict(found.dtypes)['label']}, raw binary").collect())
    langs = sorted({k for k, _ in got})
    x = np.frombuffer(b"".join(raw for _, raw in got), np.uint8).reshape(-1, WINDOW)
    return fit_windows(langs, x, np.array([langs.index(k) for k, _ in got], int))


def _predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
    if not net.langs:
        return langs, scores
    at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    total = np.zeros((len(at), len(net.langs)))
    size = np.zeros(len(at))
    held: list[tuple[np.ndarray, np.ndarray, int]] = []

    def flush() -> None:
        if held:
            logp = np.maximum(net.log_proba(np.concatenate([x for x, _, _ in held])), -8)
            w = np.concatenate([o for _, o, _ in held])
            who = np.concatenate([np.full(len(o), k) for _, o, k in held])
            np.add.at(total, who, logp * w[:, None])
            np.add.at(size, who, w)
            held.clear()

    count = 0
    for k, i in enumerate(at):
        x, own = windows(texts[i])
        for lo in range(0, len(x), 256):
            held.append((x[lo : lo + 256], own[lo : lo + 256], k))
            count += len(held[-1][0])
            if count >= 128:
                flush()
                count = 0
    flush()
    if at:
        p = np.exp(total / size[:, None])
        p /= p.sum(1, keepdims=True)
        for k, i in enumerate(at):
            j = int(p[k].argmax())
            langs[i], scores[i] = net.langs[j], float(p[k, j])
    return langs, scores


def predictor(docs: DataFrame, net: Network) -> Column:
    """``struct(lang_pred, score)`` of the column ``text``, for use under any name."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in text:
            langs, scores = _predict(shared.value, [x if isinstance(x, str) else None for x in t])
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict(F.col("text").cast("string"))


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, in one pass over whole texts, however long.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned; of languages
    alike in probability the first by name. Each row stands alone: repeated rows give repeated rows, an
    empty table an empty one. Other columns pass through, whatever their names, except these two, which
    are replaced.
    """
    src = docs.drop("lang_pred", "score")
    p = spare(src, "_p")
    return src.withColumn(p, predictor(docs, net)).select(*[F.col(f"`{c}`") for c in src.columns], F.col(f"{p}.lang_pred").alias("lang_pred"), F.col(f"{p}.score").alias("score"))


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    """Whether the crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))
