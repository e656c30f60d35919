import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitometry.llm import bpe, packing

TEXTS = [None, "", " \n", "Hello, WORLD's 12 İstanbul Σς", "<|endoftext|> a<|startoftext|>b <|", "x" * 5000, "thth" * 900 + " é́ ﬁ ½ \x1c\x85 end", "a b " * 40_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_like_the_library(library):
    t = bpe.transducer(bpe.default_path())
    for x in TEXTS:
        want = library.encode(x or "", add_special_tokens=False).ids
        assert t.ids(x) == want
        n, ids, text = bpe.digests(t, x)
        assert n == len(want) and ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert text == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="abeinortAÉß'!1 \n", max_size=400))
def test_any_text(library, text):
    assert bpe.transducer(bpe.default_path()).ids(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abth'Éß!1. \n\u0301\u00e9\u1100\u1161\u4e2d<|>", max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", "th", "'s", "é", "\u0301", " ", "!!", "ing"]), max_size=30).map("".join), st.integers(3, 20))
def test_blocks_that_end_within_words(library, text, size):
    t, whole = bpe.transducer(bpe.default_path()), bpe.BLOCK_CHARS
    bpe.BLOCK_CHARS = size
    try:
        assert t.ids(text) == library.encode(text, add_special_tokens=False).ids
        assert "".join(b for b, _ in t.blocks(text)) == text
    finally:
        bpe.BLOCK_CHARS = whole


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["th", "in", "an", "er", "ing", "s", "zq", "ation"]), min_size=700, max_size=1500))
def test_tokens_are_emitted_while_a_word_is_open(library, parts):
    model, word, out = bpe.transducer(bpe.default_path()).model, "".join(parts), []
    s, most = bpe.Stream(model), 0
    for k in range(0, len(word), 50):
        out += s.feed(word[k : k + 50])
        most = max(most, len(s.last))
    early = len(out)
    out += s.close()
    assert out == library.encode(word, add_special_tokens=False).ids
    assert early > 0.8 * len(out) and most <= model.window


def test_spaceless_text_is_read_in_blocks(library):
    t = bpe.transducer(bpe.default_path())
    for text in ("thheingble" * 30_000, "中文" * 80_000, "<|endoftext|>" + "a" * 200_000 + "<|endoftext|>"):
        assert max(len(b) for b, _ in t.blocks(text)) < bpe.BLOCK_CHARS + 100
        assert t.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_library_splits_alike():
    t, u = bpe.Transducer(bpe.default_path(), 50), bpe.Transducer(bpe.default_path(), 50, True)
    for x in TEXTS:
        assert t.ids(x) == u.ids(x)


def test_lookahead_of_a_small_list():
    vocab = {c: i for i, c in enumerate(["a", "b", "c", "a</w>", "b</w>", "c</w>", "bc", "ab"])}
    m = bpe.MergeList(vocab, [("b", "c"), ("a", "b")], "</w>")
    # "bc" merges first, which needs the second letter after "a"; the last letter carries the mark
    assert m.lookahead == 2 and m.word("abca") == [vocab[x] for x in ("a", "bc", "a</w>")]
    with pytest.raises(ValueError):
        bpe.MergeList({**vocab, "abc": 8}, [("b", "c"), ("a", "b"), ("ab", "c"), ("a", "bc")], "</w>")


def test_raw_decoding_by_parts_of_letters(library):
    t = bpe.transducer(bpe.default_path())
    ids = t.ids("中文 é ñandú 😀")
    d = bpe.Decoder(t, raw=True)
    parts, held = [], 0
    for i in ids:
        parts.append(d.feed([i]))
        held = max(held, len(d.machine.tail))
    assert "".join(parts) + d.finish() == "中文 é ñandú 😀 " and held > 0


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 7))
def test_bytes_to_text(data, size):
    m = bpe.ByteText()
    got = "".join(m.feed(data[k : k + size]) for k in range(0, len(data), size)) + m.finish()
    assert got == data.decode("utf-8", "replace")


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for counts in ({}, {4096: 3}, {1: 10_000}, dict(zip(*map(lambda a: a.tolist(), np.unique(rng.integers(1, 4097, 5000), return_counts=True))))):
        p = packing.plan(counts)
        spans: dict[int, list[int]] = {}
        for r in p.itertuples():
            for k in range(r.lo, r.hi):
                spans.setdefault(r.first + (k - r.lo) // r.times, []).append((r.at + (k - r.lo) % r.times * r.length, r.length))
        assert sum(map(len, spans.values())) == sum(counts.values()) and sorted(spans) == list(range(len(spans)))
        for parts in spans.values():
            at = 0
            for start, size in sorted(parts):
                assert start == at
                at += size
            assert at <= 4096
        if sum(counts.values()) == 5000:
            assert sum(k * v for k, v in counts.items()) / (4096 * len(spans)) > 0.97


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, length string")


def test_queries(spark, library):
    d = docs(spark, TEXTS)
    got = bpe.round_trip(d).toPandas().set_index("doc_id")
    assert got.n_tokens.to_dict() == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert bpe.decode_ids(bpe.encode_documents(d)).count() == len(TEXTS)
    p = packing.pack(d).toPandas()
    for i, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = p[p.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    s = p.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all()


def test_empty(spark):
    assert bpe.round_trip(docs(spark, [])).count() == 0 and packing.pack(docs(spark, [])).count() == 0
    assert isinstance(packing.plan({}), pd.DataFrame)
