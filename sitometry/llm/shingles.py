"""Distinct word shingles of whole texts as 64-bit hashes, vectorised over blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(seed: int, n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = _numbers(11, 256)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _numbers(23, WIDTH)
_SIZE = _numbers(37, WIDTH)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Hashes words by a rolling polynomial over their bytes, A-Z as a-z, and mixes five of them.

    ``table``: another number for each byte, where other bytes are to count as equal.
    """

    def __init__(self, table: np.ndarray = _BYTE) -> None:
        self.table = table
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_UNBASE, n)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        b = np.frombuffer(data, np.uint8)
        self._grow(len(b) + 1)
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.up[: len(b)], out=sums[1:])
        return _mixed((sums[end] - sums[start]) * self.down[start] + _numbers(41, 1)), start

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text; empty without words."""
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < BLOCK_BYTES):
                part.append((texts[at] or "").encode("utf-8", "surrogatepass"))
                size += len(part[-1]) + 1
                at += 1
            yield from self._block(part)

    def _block(self, part: list[bytes]) -> Iterator[np.ndarray]:
        words, start = self.words(b" ".join(part) + b" ")
        bounds = np.cumsum([0, *(len(p) + 1 for p in part)])
        cut = np.searchsorted(start, bounds)
        n = len(words)
        if n >= WIDTH:
            long = np.zeros(n - WIDTH + 1, np.uint64)
            for k in range(WIDTH):
                long += words[k : n - WIDTH + 1 + k] * _PLACE[k]
            long = _mixed(long)
        for a, z in zip(cut, cut[1:]):
            if z - a >= WIDTH:
                # sorted and thinned by hand: np.unique hashes first, which takes several times as long
                h = np.sort(long[a : z - WIDTH + 1])
                yield h[np.concatenate(([True], h[1:] != h[:-1]))]
            elif z > a:
                yield _mixed((words[a:z] * _PLACE[: z - a]).sum(dtype=np.uint64, keepdims=True) + _SIZE[z - a])
            else:
                yield np.empty(0, np.uint64)
