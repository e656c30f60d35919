"""Byte pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Every prefix of a word has one last token, and a sequence of tokens is the one that BPE makes just
when all its neighbours fit together. So the transducer reads letters, finds the last token of each
prefix from those of shorter ones, and emits a token as soon as the encodings of all prefixes that a
later token could begin at agree on it, or the pre-tokenizer has closed the word.

A merge can change how the letters left of it are split only through a chain of merges, each ranked
before the one that it disturbs and each starting in the right part of that one. The longest such
chain, in letters, is the merge list's *sufficient lookahead*: encodings agree on every token that
ends so far from the end of what has been read. It bounds what the transducer holds, whatever the
length of a word. Texts are read in blocks, which may end within a word.

Words repeat, so the ids of short ones are remembered in a cache of bounded size; that only saves time.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below, texts are in composed form, and lower case and letter classes are the same in every Unicode version in use.
PLAIN_LIMIT = "\u0230"
BLOCK_CHARS = 1 << 16
CACHE_WORDS = 500_000
#: Longer words are not remembered.
SHORT = 64
#: Stands for the word end within the automaton's keys.
END = "\0"
_NEVER = 1 << 60
_OF = {k: "".join(re.escape(chr(c)) for c in range(ord(PLAIN_LIMIT)) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"[^\S\x1c-\x1f]")}
PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_OF[r'\p{L}']}]+|[{_OF[r'\p{N}']}]|[^{''.join(_OF.values())}]+")
#: White space to the tokenizer: not the four separators U+001C to U+001F.
SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it prints, else the next free letter from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class MergeList:
    """Vocabulary and ranked merges of a word-end BPE, with the lookahead that they need.

    A list in which two merges make one token, or a merge comes before one of its parts', is refused:
    a token's history would not be unique.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.vocab, self.word_end = vocab, word_end
        self.span = max(vocab.values()) + 2
        self.first = self.span - 1
        #: By token: the rank of its merge (-1 for letters) and its two parts.
        self.made, self.left, self.right = [-1] * self.span, [-1] * self.span, [-1] * self.span
        self.rank: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if self.made[t] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[x * self.span + y] = k
            self.made[t], self.left[t], self.right[t] = k, x, y
        if any(max(self.made[self.left[t]], self.made[self.right[t]]) > self.made[t] for t in vocab.values() if self.made[t] >= 0):
            raise ValueError("a merge comes before one of its parts'")
        #: Places that a token takes in its word; the mark at the word's end takes one.
        self.size = {i: self._width(t) + (bool(word_end) and t.endswith(word_end)) for t, i in vocab.items()}
        self.lookahead, self.longest = self._measure(merges)
        #: What a word's transducer holds at most, in letters.
        self.window = self.lookahead + 5 * self.longest
        self.fits: dict[int, bool] = {}
        self.most_known = CACHE_WORDS
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if self.made[i] < 0 or self._apart(self.left[i], self.right[i], self.made[i]):
                key = text.removesuffix(word_end) + END if word_end and text.endswith(word_end) else text
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()

    def _width(self, token: str) -> int:
        return len(token) - len(self.word_end) * token.endswith(self.word_end)

    def _measure(self, merges: list[tuple[str, str]]) -> tuple[int, int]:
        """One pass in rank order. ``reach[t]``: how far right of an edge at the start of token
        ``t`` a chain of merges that begins with ``t`` as left part can draw on the text."""
        right_part = {}
        reach: dict[str, int] = {}
        most, longest = 1, 1
        for a, b in merges:
            far, spine = 0, b
            while spine is not None:
                far = max(far, reach.get(spine, 0))
                spine = right_part.get(spine)
            need = self._width(b) + far
            right_part.setdefault(a + b, b)
            longest = max(longest, self._width(a + b))
            if need > reach.get(a, 0):
                reach[a] = need
                most = max(most, need)
        return most, longest

    def _apart(self, x: int, y: int, until: int = _NEVER) -> bool:
        """Whether nothing merges across the edge between two tokens before rank ``until``.

        Goes back in time: undoes the later made of the two tokens at the edge and asks whether
        the pair that then stood there would have merged sooner. Of equal merges the left goes first.
        """
        rank, made, span = self.rank, self.made, self.span
        while True:
            if rank.get(x * span + y, _NEVER) < until:
                return False
            if made[x] > made[y]:
                until, x = made[x], self.right[x]
            elif made[y] >= 0:
                until, y = made[y] + 1, self.left[y]
            else:
                return True

    def fit(self, key: int) -> bool:
        """Whether BPE leaves two neighbours as they are; ``key`` is the first times span, plus the second."""
        x, y = divmod(key, self.span)
        ok = x == self.first or self._apart(x, y)
        if len(self.fits) >= self.most_known:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def word(self, letters: str) -> list[int]:
        """Ids of a whole word."""
        s = Stream(self)
        out = s.feed(letters)
        return out + s.close() if out else s.close()


class Stream:
    """The transducer of one word: letters in, ids out once they are stable."""

    def __init__(self, model: MergeList):
        self.model = model
        #: The last token of each held prefix, after the token that ends where holding begins.
        self.last = [model.first]
        self.shift, self.read, self.search = 0, 0, None
        self.check = 4 * model.longest

    def feed(self, letters: str) -> list[int]:
        out: list[int] = []
        step = 2 * self.model.longest
        if len(letters) <= step and len(self.last) <= self.check - step:
            if letters:
                self._advance(letters)
            return out
        for at in range(0, len(letters), step):
            self._advance(letters[at : at + step])
            if len(self.last) > self.check:
                out += self._stable()
        return out

    def close(self) -> list[int]:
        """The word ends here: the tokens not yet emitted."""
        if not self.read:
            return []
        if self.model.word_end:
            self._advance(END)
        return self._traced(len(self.last) - 1)

    def _advance(self, part: str) -> None:
        if self.search is None:
            self.search = self.model.automaton.iter(part)
        else:
            self.search.set(part, False)
        self.read += len(part)
        last, fits, fit, span, shift = self.last, self.model.fits, self.model.fit, self.model.span, self.shift - 1
        known = len(last)
        for end, (token, size) in self.search:
            at = end - shift
            if at < known or size > at:
                continue
            key = last[at - size] * span + token
            ok = fits.get(key)
            if fit(key) if ok is None else ok:
                last.append(token)
                known += 1

    def _stable(self) -> list[int]:
        """Tokens on which all prefixes agree that a later token could begin at; they are let go."""
        last, size = self.last, self.model.size
        n = len(last) - 1
        heads = set(range(max(0, n - self.model.longest + 1), n + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.discard(top)
            heads.add(top - size[last[top]])
        edge = heads.pop()
        out = self._traced(edge)
        if edge:
            del last[:edge]
            self.shift += edge
        self.check = len(last) + 2 * self.model.longest
        return out

    def _traced(self, at: int) -> list[int]:
        """Ids from where holding begins to prefix ``at``."""
        out, last, size = [], self.last, self.model.size
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return out[::-1]


class Transducer:
    """Text blocks in, token ids out; equal to the tokenizer file's own encoding."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, by_library: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.model = MergeList(self.vocab, merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.special_width = max(map(len, self.special), default=0)
        self.mark = "<|"
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        #: Where only the ids matter, the library may split new words.
        bpe = library.model
        self.split = (lambda letters: [t.id for t in bpe.tokenize(letters)]) if by_library else self.model.word
        self.normalise, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = text
        self.id_text = [str(i) for i in range(size)]
        self.token_bytes = [t.encode() for t in self.token]
        self.code = "H" if size <= 1 << 16 else "I"
        self.limit = self.model.most_known = cache_words
        #: Ids of words as packed bytes; the older half goes when full.
        self.young: dict[str, bytes] = _Cache(self)
        self.old: dict[str, bytes] = {}

    def missed(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array(self.code, self.split(self.spelt(word))).tobytes()
        if len(word) <= SHORT:
            if len(self.young) >= self.limit:
                self.old = dict(self.young)
                self.young.clear()
            self.young[word] = ids
        return ids

    def spelt(self, word: str) -> str:
        """A letter for each of the word's bytes."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if text.isascii() or max(text) < PLAIN_LIMIT:
            return PLAIN_WORDS.findall(text.lower())
        out = []
        for piece in SPACES.split(text):
            if piece and max(piece) < PLAIN_LIMIT:
                out += PLAIN_WORDS.findall(piece.lower())
            elif piece:
                plain = self.normalise(piece)
                out += [plain[s:e] for _, (s, e) in self.pre_tokenize(plain)]
        return out

    def items(self, text: str) -> list[str | int]:
        """The words of a text, and its special tokens' ids."""
        out: list[str | int] = []
        at = 0
        if self.mark in text:
            for m in self.special_split.finditer(text):
                out += [*self.words(text[at : m.start()]), self.special[m.group()]]
                at = m.end()
        return [*out, *self.words(text[at:])] if at < len(text) else out

    def packed(self, items: Iterable[str | int]) -> bytes:
        return b"".join([self.young[x] if isinstance(x, str) else array(self.code, [x]).tobytes() for x in items])

    def inside(self, text: str, at: int) -> int:
        """The first place from ``at`` on where a block may end within a run without white space.

        What stands on either side there is normalised alone and belongs to one kind of word; no
        special token and no contraction spans it. A run without such a place is held whole.
        """
        for p in range(max(at, 1), len(text)):
            a, b = text[p - 1], text[p]
            if SPACES.match(a + b, 1) or SPACES.match(a):
                return p
            if a.isascii() and b.isascii():
                kind = (a.isalpha(), a.isdigit()) == (b.isalpha(), b.isdigit())
            else:
                tail = a
                for q in range(p - 2, max(p - 34, -1), -1):
                    if not unicodedata.combining(tail[0]):
                        break
                    tail = text[q] + tail
                kind = _kind(self.normalise(tail)[-1:]) == _kind(self.normalise(b)[:1]) and not unicodedata.combining(b) and self.normalise(tail + b) == self.normalise(tail) + self.normalise(b)
            if not kind or "'" in text[max(0, p - 3) : p + 1]:
                continue
            low = max(0, p - self.special_width)
            if any(m.start() <= p <= m.end() for m in self.special_split.finditer(text, low, p + self.special_width)):
                continue
            return p
        return len(text)

    def blocks(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in blocks, and whether the word at a block's end goes on in the next one."""
        at, n = 0, len(text)
        while at < n:
            end, goes_on = min(n, at + BLOCK_CHARS), False
            if end < n:
                m = SPACES.search(text, end, min(n, end + BLOCK_CHARS))
                end = m.start() if m else self.inside(text, end)
                goes_on = not m and end < n and not SPACES.search(text, end - 1, end + 1) and _kind(self.normalise(text[end])[:1]) != "N"
            yield text[at:end], goes_on
            at = end

    def encode(self, text: str | None) -> Iterator[array]:
        """Arrays of ids, block by block."""
        word: Stream | None = None
        for block, goes_on in self.blocks(text) if text else ():
            if word is None and not goes_on and self.mark not in block:
                yield array(self.code, b"".join(map(self.young.__getitem__, self.words(block))))
                continue
            items, out = self.items(block), array(self.code)
            if word is not None:
                if items:
                    out.extend(word.feed(self.spelt(items.pop(0))))
                if items or not goes_on:
                    out.extend(word.close())
                    word = None
            last = items.pop() if goes_on and items else None
            out.frombytes(self.packed(items))
            if last is not None:
                word = Stream(self.model)
                out.extend(word.feed(self.spelt(last)))
            yield out

    def ids(self, text: str | None) -> list[int]:
        return [i for block in self.encode(text) for i in block]


def _kind(c: str) -> str:
    return "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "S" if c.isspace() else "P"


class _Cache(dict):
    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        return self.owner.missed(piece)


@lru_cache(maxsize=1)
def transducer(path: str, cache_words: int = CACHE_WORDS, by_library: bool = False) -> Transducer:
    """One for each Python worker."""
    return Transducer(path, cache_words, by_library)


class ByteText:
    """Bytes in, text out: the state is the at most three bytes of an unfinished character.

    Bytes that no UTF-8 text holds come out as U+FFFD, as in ``bytes.decode(errors="replace")``.
    """

    def __init__(self) -> None:
        self.tail = b""

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                needs = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                if needs > back and self._may_go_on(data[-back:]):
                    keep = back
                break
            if b < 0x80:
                break
        self.tail = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def _may_go_on(part: bytes) -> bool:
        lead, second = part[0], part[1] if len(part) > 1 else None
        if lead < 0xC2 or lead > 0xF4:
            return False
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
        return second is None or low <= second <= high

    def finish(self) -> str:
        tail, self.tail = self.tail, b""
        return tail.decode("utf-8", "replace")


class Decoder:
    """Ids in, text out, block by block. This vocabulary's file names no decoder, so its library
    joins the tokens' own strings with one space; ``raw`` yields the bytes they stand for instead."""

    def __init__(self, t: Transducer, raw: bool = False):
        self.machine, self.first, self.raw = ByteText(), True, raw
        self.parts = t.token_bytes
        if raw:
            back = {c: b for b, c in t.letters.items()}
            end = t.model.word_end
            self.parts = [x.encode() if i in t.special.values() else bytes(back[c] for c in x.removesuffix(end)) + b" " * x.endswith(end) for i, x in enumerate(t.token)]

    def feed(self, ids: Sequence[int]) -> str:
        if not ids:
            return ""
        glue = b"" if self.raw else b" "
        data = glue.join(map(self.parts.__getitem__, ids))
        if not self.first:
            data = glue + data
        self.first = False
        return self.machine.feed(data)

    def finish(self) -> str:
        return self.machine.finish()


def digests(t: Transducer, text: str | None) -> tuple[int, str, str]:
    n, ids_sha, text_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(t)
    for ids in t.encode(text):
        if ids:
            ids_sha.update(((" " if n else "") + " ".join(map(t.id_text.__getitem__, ids))).encode())
            text_sha.update(decoder.feed(ids).encode())
            n += len(ids)
    text_sha.update(decoder.finish().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)``: the token ids of each whole text.

    Null and empty texts have no ids. Each row stands alone: repeated rows give repeated rows and
    an empty table an empty one. Other columns of the input are not read.
    """
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [t.ids(x) for x in b["text"]]})

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return src.mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str | None = None, raw: bool = False, id_col: str = "doc_id") -> DataFrame:
    """``(id, text)``: the text of each id list; null lists decode to the empty text."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for b in batches:
            out = []
            for ids in b["ids"]:
                d = Decoder(t, raw)
                out.append("" if ids is None else d.feed([int(i) for i in ids]) + d.finish())
            yield pd.DataFrame({"id": b["id"], "text": out})

    kind = dict(encoded.select(F.col(id_col).alias("id")).dtypes)["id"]
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids and of the decoded text.

    Encodes and decodes block by block in one pass over the rows, with no shuffle, so a very long
    text costs no more memory than itself. A null text counts as empty; repeated rows give repeated
    rows, an empty table none. Other columns of the input are not read, whatever their names.
    """
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for b in batches:
            found = [digests(t, x) for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [x[0] for x in found], "ids_sha256": [x[1] for x in found], "decoded_sha256": [x[2] for x in found]})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def id_bytes(t: Transducer, text: str | None, end_id: int) -> bytes:
    """Little-endian unsigned 32-bit ids, closed with ``end_id``."""
    parts = [np.frombuffer(ids, t.code) for ids in t.encode(text)]
    return np.concatenate([*parts, np.array([end_id], t.code)]).astype("<u4").tobytes()
