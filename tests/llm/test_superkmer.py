import random
from collections import Counter

import numpy as np
import pytest

from sitometry.llm import superkmer
from sitometry.llm.shingles import Shingler


def brute(rows, width):
    texts = [(t or "").encode().split() for _, t in rows]
    starts = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = {i + j for i in range(len(w) - width + 1) if starts[tuple(w[i : i + width])] > 1 for j in range(width)}
        out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(w), len(gone)))
    return sorted(out, key=repr)


def kept(spark, rows, width):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, low int, key string, n int")
    return sorted((tuple(r) for r in superkmer.deduplicated(df, width).collect()), key=repr)


def corpus(seed, width):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", "the", "\x1cx", "W", "w", "\0"]) * rng.randint(1, 3)
    free = lambda n: [f"{word()}{rng.randint(0, 99)}" for _ in range(n)]
    passage, other = free(2 * width), free(width)
    texts = [None, "", " \n\t ", "one", " ".join(free(width - 1)), " ".join(passage[:width]), " ".join(passage[: width - 1])]
    for _ in range(60):
        texts.append(" ".join([*free(rng.randint(0, 30)), *passage[rng.randint(0, width) :], *free(rng.randint(0, 30))]))
    for _ in range(30):
        texts.append(rng.choice([" ", "\n", " \t "]).join(free(rng.randint(0, 60))))
    texts += ["x y " * 3 * width, "z " * 3 * width, " ".join(other + free(3) + other), " ".join(free(3000) + passage)]
    texts += [texts[12]] * 5 + [texts[70]] * 3
    return [(k, t) for k, t in enumerate(texts)] + [(3, "one"), (None, texts[20]), (12, texts[12])]


@pytest.mark.parametrize(("seed", "width", "hot", "chunk"), [(1, 35, 3, 8 << 20), (2, 35, 0.01, 4000), (3, 6, 0.01, 700), (4, 3, 3, 8 << 20)])
def test_against_brute_force(spark, monkeypatch, seed, width, hot, chunk):
    """Also with every bucket split, and with texts cut in small chunks."""
    monkeypatch.setattr(superkmer, "HOT", hot)
    monkeypatch.setattr(superkmer, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(superkmer, "SLICE", chunk // 8)
    rows = corpus(seed, width)
    assert kept(spark, rows, width) == brute(rows, width)


def test_texts_with_very_many_copies(spark, monkeypatch):
    rows = [(k, "a b c d e") for k in range(1100)] + [(2000 + k, "a b") for k in range(1100)] + [(5000, "x a b c"), (5001, "b c x d")] + [(6000 + k, None) for k in range(9)]
    assert kept(spark, rows, 3) == brute(rows, 3)


def test_empty_tables(spark):
    assert kept(spark, [], 35) == []
    assert kept(spark, [(1, None), (None, "")], 35) == brute([(1, None), (None, "")], 35)


def test_super_k_mers_hold_each_window_once():
    rng = random.Random(7)
    texts = ["", " ".join(rng.choice("abcdefgh") for _ in range(400)), "a b", " ".join(rng.choice("ab") for _ in range(90)), ""]
    c = superkmer.Cut(texts, 12, Shingler(superkmer._numbers(11, 256)))
    got, minis = [], {}
    for k in range(len(c.count)):
        words = c.strings(np.array([k]), 12).split()
        assert len(words) == c.count[k] + 11
        for i in range(c.count[k]):
            window = tuple(words[i : i + 12])
            got.append((int(c.text[k]), int(c.first[k] - c.first_word[c.text[k]]) + i, window))
            assert minis.setdefault(window, c.mini[k]) == c.mini[k]
    want = [(t, i, tuple(w[i : i + 12])) for t, w in enumerate(x.encode().split() for x in texts) for i in range(len(w) - 11)]
    assert sorted(got) == sorted(want) and len(c.count) < len(want) / 2


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(superkmer, "_mixed", lambda x: x & np.uint64(1))
    number, same, *_ = superkmer.counted(b"a b c d\na b c\nx b c\nx b c e", np.array([2, 1, 1, 2]), 3, Shingler())
    assert number.tolist() == [2, 1, 2, 2, 2, 1] and same.tolist() == [0, 1, 0, 3, 3, 5]
