"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

The field labels the words near digits and at signs. Neighbouring words share transition
potentials; distant words that repeat one another (same digits, same address) or are similar (same
last seven digits) share skip potentials, so what is clear at one place carries to a place where it
is not. Loopy belief propagation sums over all labellings of the document.

The weights are learned from generated documents, in which some numbers are mentioned again in a form
that alone could be anything: the chain by maximum likelihood, then the skip potentials piecewise, by
the likelihood of each linked pair's labels given what the chain believes of either word.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
#: Matches are looked for over maximal runs, so a long run costs time in proportion to its length.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_SIGN, _DIGIT, _NOT_DIGIT = re.compile(r"[0-9@]|[(\[]at[)\]]"), re.compile("[0-9]"), re.compile("[^0-9]")
_TOKEN = re.compile(r"\S+")
#: Hashed feature weights, words of context on either side, rounds and damping of the messages.
FEATURES, AROUND, ROUNDS, DAMPING = 1 << 12, 2, 12, 0.3
#: A word is added to a span where its label is at least this sure.
SURE = 0.95
DOCUMENTS, STEPS, SEED = 900, 120, 3
#: Kinds of skip links, and how many last digits make numbers similar.
REPEATED, SIMILAR, TAIL = 0, 1, 7
CUES = {
    "phone": ("phone", "tel", "call", "fax", "mobile", "telephone"),
    "email": ("email", "mail", "mailto", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "amex"),
    "other": ("version", "v", "isbn", "order", "invoice", "page", "year", "id", "ref", "token", "password", "key"),
}
_CUE = {w: k for k, words in CUES.items() for w in words}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    if kind == "ip":
        return all(len(q) <= 3 and int(q or "0") <= 255 for q in (p.lstrip("0") for p in text.split(".")))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, from each at sign outwards: the runs between at signs are read once."""
    done, edge, at = 0, 0, text.find("@")
    while at >= 0:
        if at >= done:
            low = max(done, edge)
            start = at - _LOCAL.match(text[low:at][::-1]).end()
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                done = domain.end()
                yield start, done
        edge, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' valid matches, by kind and start, in code points."""
    out = [("email", s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for kind in KINDS[1:]:
            if kind != "phone" or "+" in text:
                out += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if valid(kind, m.group())]
    return out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def features(before: str, word: str, after: str) -> list[int]:
    digits = _NOT_DIGIT.sub("", word)
    core = word.strip(".,;:!?\"'")
    shape = re.sub("0+", "0", re.sub("[A-Za-z]+", "a", _DIGIT.sub("0", core)))[:12]
    parts = core.split(".")
    own = [
        "bias",
        f"digits={min(len(digits), 20)}",
        f"shape={shape}",
        f"at={'@' in word}",
        f"obscured={'(at)' in word or '[at]' in word}{'.' in word}",
        f"plus={word.startswith('+')}",
        f"paren={word.startswith('(')}{core.endswith(')')}",
        f"dash={core.count('-')}",
        f"dots={min(core.count('.'), 4)}",
        f"mixed={bool(digits) and any(c.isalpha() for c in word)}",
        f"octets={len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) < 256 for p in parts)}",
        f"luhn={len(digits) >= 13 and luhn(digits)}",
        f"domain={'@' in word and '.' in word.rpartition('@')[2]}",
    ]
    for side, near in (("before", before), ("after", after)):
        cue = _CUE.get(near.strip(".,;:!?()=").lower(), "")
        n = len(_NOT_DIGIT.sub("", near))
        own += [f"{side}={cue}", f"{side}digits={min(n, 12)}", f"{side}cue={cue}/{shape}"]
    return [_slot(x) for x in own]


def _sentence(rng: random.Random) -> tuple[list[str], list[int], str]:
    """A made-up sentence around one number or address, the label of each word, and another way to
    write the number: one that by itself does not tell what it is."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    kind = rng.choice(["email", "ip", "card", "phone", "phone", "other", "other", "other"])
    if kind == "email":
        shown = f"{word()}{rng.choice(['.', '_', ''])}{rng.choice([word(), n(2)])}@{word()}{rng.choice(['.', '.', '.' + word() + '.'])}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
    elif kind == "ip":
        shown = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        first = rng.choice("3456") + n(14)
        last = next(c for c in "0123456789" if luhn(first + c))
        full = first + last
        glue = rng.choice(["", " ", "-"])
        shown = glue.join(full[k : k + 4] for k in range(0, 16, 4))
    elif kind == "phone":
        shown = rng.choice(["+{c} ({a}) {b}-{d}", "({a}) {b}-{d}", "{a}-{b}-{d}", "+{c} {a} {b} {d}", "+{c}{a}{b}{d}"]).format(c=rng.randint(1, 99), a=n(3), b=n(3), d=n(4))
    else:
        mixed = "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(rng.randint(8, 32)))
        shown = rng.choice([n(rng.randint(1, 12)), n(4), f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(256, 999)}", n(10), n(10), n(11), f"{word()}(at){word()}", f"{n(4)}.{n(4)}.{n(4)}.{n(4)}", f"{n(4)}-{n(2)}-{n(2)}", mixed, f"password={mixed}", f'"{mixed}"', f"{n(3)},{n(3)}", n(20), "$" + n(3), f"{n(2)}:{n(2)}", f"@{word()}", f"{n(1)}-{n(3)}-{n(5)}-{n(1)}", f"AKIA{mixed.upper()}"])
    digits = _NOT_DIGIT.sub("", shown)
    again = shown.replace("@", "(at)") if kind == "email" else shown if kind == "ip" or len(digits) < 8 else ".".join(digits[k : k + 4] for k in range(0, 16, 4)) if len(digits) == 16 else digits[-10:]
    shown = shown.split()
    label = LABELS.index(kind) if kind in KINDS else 0
    before, after = [word() for _ in range(rng.randint(1, 3))], [word() for _ in range(rng.randint(1, 3))]
    if rng.random() < 0.4:
        before[-1] = rng.choice(CUES[kind]) + rng.choice(["", ":", ""])
    if rng.random() < 0.3:
        shown[-1] += rng.choice(".,;")
    return [*before, *shown, *after], [*[0] * len(before), *[label] * len(shown), *[0] * len(after)], again


def _document(rng: random.Random) -> tuple[list[str], list[int]]:
    """Some sentences; after them some of their numbers stand again, without a cue."""
    words: list[str] = []
    labels: list[int] = []
    later = []
    for _ in range(rng.randint(1, 3)):
        w, y, again = _sentence(rng)
        words += w
        labels += y
        if rng.random() < 0.6 and " " not in again:
            later.append((again, max(y)))
    for again, label in later:
        filler = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(2, 4))]
        words += [*filler[:-1], again, filler[-1]]
        labels += [*[0] * (len(filler) - 1), label, 0]
    return words, labels


@dataclass
class Field:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def train(documents: int = DOCUMENTS, steps: int = STEPS, seed: int = SEED) -> Field:
    """The chain by forward-backward over padded documents with Adagrad steps, then the skip links."""
    rng = random.Random(seed)
    data = [_document(rng) for _ in range(documents)]
    most, count = max(len(w) for w, _ in data), len(LABELS)
    x = np.zeros((documents, most, len(features("", "", ""))), np.int64)
    y = np.zeros((documents, most), np.int64)
    mask = np.zeros((documents, most), bool)
    for i, (words, labels) in enumerate(data):
        x[i, : len(words)] = word_features(words)
        y[i, : len(words)] = labels
        mask[i, : len(words)] = True
    unary, chain = np.zeros((FEATURES, count)), np.zeros((count, count))
    past_u, past_c = np.full_like(unary, 1e-6), np.full_like(chain, 1e-6)
    gold = np.zeros((documents, most, count))
    gold[mask] = np.eye(count)[y[mask]]
    pairs = mask[:, 1:]
    gold_pairs = np.zeros((count, count))
    np.add.at(gold_pairs, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    flat = x[mask].ravel()
    for _ in range(steps):
        p, joint = _forward_backward(unary[x].sum(2), chain, mask)
        d = (gold - p)[mask]
        g = np.stack([np.bincount(flat, np.repeat(d[:, k], x.shape[2]), FEATURES) for k in range(count)], 1) - 0.05 * unary
        gc = gold_pairs - joint - 0.05 * chain
        past_u += g * g
        past_c += gc * gc
        unary += 0.4 * g / np.sqrt(past_u)
        chain += 0.4 * gc / np.sqrt(past_c)
    p, _ = _forward_backward(unary[x].sum(2), chain, mask)
    linked = [(i, a, b, kind) for i, (words, _) in enumerate(data) for a, b, kind in links(words)]
    skip = np.zeros((2, count, count))
    for kind in (REPEATED, SIMILAR):
        at = np.array([(i, a, b) for i, a, b, k in linked if k == kind]).reshape(-1, 3)
        skip[kind] = _pairwise(p[at[:, 0], at[:, 1]], p[at[:, 0], at[:, 2]], y[at[:, 0], at[:, 1]], y[at[:, 0], at[:, 2]])
    return Field(unary, chain, skip)


def _forward_backward(score: np.ndarray, chain: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, and expected label pairs, of padded documents."""
    count, most, rows = score.shape[2], score.shape[1], np.arange(len(score))
    psi = np.exp(np.clip(score, -30, 30))
    psi[~mask] = 1.0
    tr = np.exp(chain)
    alpha, beta = np.zeros_like(psi), np.ones_like(psi)
    alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
    for t in range(1, most):
        a = alpha[:, t - 1] @ tr * psi[:, t]
        alpha[:, t] = np.where(mask[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
    for t in range(most - 2, -1, -1):
        b = (beta[:, t + 1] * psi[:, t + 1]) @ tr.T
        beta[:, t] = np.where(mask[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    p[~mask] = 0
    joint = np.zeros((count, count))
    for t in range(1, most):
        live = rows[mask[:, t]]
        j = alpha[live, t - 1][:, :, None] * tr * (beta[live, t] * psi[live, t])[:, None, :]
        joint += (j / j.sum((1, 2), keepdims=True)).sum(0)
    return p, joint


def _pairwise(a: np.ndarray, b: np.ndarray, ya: np.ndarray, yb: np.ndarray, steps: int = 300) -> np.ndarray:
    """Symmetric potentials that make the linked words' labels likeliest, given beliefs in either."""
    count = a.shape[1]
    out, past = np.zeros((count, count)), np.full((count, count), 1e-6)
    local = np.log(a + 1e-6)[:, :, None] + np.log(b + 1e-6)[:, None, :]
    gold = np.zeros((count, count))
    np.add.at(gold, (ya, yb), 1)
    for _ in range(steps):
        e = np.exp(local + out)
        g = gold - (e / e.sum((1, 2), keepdims=True)).sum(0)
        g = (g + g.T) / 2 - 0.5 * out
        past += g * g
        out += 0.2 * g / np.sqrt(past)
    return out


def word_features(words: list[str]) -> np.ndarray:
    return np.array([features(words[k - 1] if k else "", w, words[k + 1] if k + 1 < len(words) else "") for k, w in enumerate(words)])


def _keys(word: str) -> tuple[str | None, str | None]:
    """What a word repeats exactly, and what a similar word has too."""
    bare = word.replace("(at)", "@").replace("[at]", "@")
    if "@" in bare:
        return bare.strip(".,;:!?\"'<>()").lower(), None
    digits = _NOT_DIGIT.sub("", word)
    return (digits if len(digits) >= 4 else None), (digits[-TAIL:] if len(digits) >= TAIL else None)


def links(words: list[str]) -> list[tuple[int, int, int]]:
    """(earlier word, later word, kind) of words that are not neighbours: each with the last that it
    repeats, or else with the last that it is similar to."""
    out, last = [], ({}, {})
    for k, w in enumerate(words):
        keys = _keys(w)
        for kind in (REPEATED, SIMILAR):
            if keys[kind] and last[kind].get(keys[kind], k) < k - 1:
                out.append((last[kind][keys[kind]], k, kind))
                break
        for kind in (REPEATED, SIMILAR):
            if keys[kind]:
                last[kind][keys[kind]] = k
    return out


def beliefs(field: Field, words: list[str], joined: list[bool]) -> np.ndarray:
    """Label probabilities by loopy propagation; ``joined[k]``: word k follows word k-1 directly."""
    n, count = len(words), len(LABELS)
    score = field.unary[word_features(words)].sum(1)
    skips = links(words)
    chained = [k - 1 for k in range(1, n) if joined[k]]
    a = chained + [x for x, _, _ in skips]
    b = [k + 1 for k in chained] + [y for _, y, _ in skips]
    kinds = [0] * len(chained) + [1 + kind for _, _, kind in skips]
    if not a:
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    a_, b_, m = np.array(a), np.array(b), len(a)
    pot = np.concatenate([field.chain[None], field.skip])[kinds]
    source, target = np.concatenate([a_, b_]), np.concatenate([b_, a_])
    pots = np.exp(np.concatenate([pot, pot.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    msg = np.zeros((2 * m, count))
    total = score.copy()
    for _ in range(ROUNDS):
        out = total[source] - msg[back]
        out -= out.max(1, keepdims=True)
        new = np.log(np.einsum("ei,eij->ej", np.exp(out), pots) + 1e-300)
        new -= new.max(1, keepdims=True)
        moved = np.abs(new - msg).max()
        msg = DAMPING * msg + (1 - DAMPING) * new
        total = score.copy()
        np.add.at(total, target, msg)
        if moved < 1e-3:
            break
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(field: Field, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the field is sure of outside the base spans; only what could be of its kind."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    hits = [k for k, (s, e) in enumerate(tokens) if _SIGN.search(text, s, e)]
    near = sorted({j for k in hits for j in range(max(0, k - AROUND), min(len(tokens), k + AROUND + 1))})
    if not near:
        return []
    words = [text[slice(*tokens[k])] for k in near]
    p = beliefs(field, words, [i > 0 and near[i - 1] == k - 1 for i, k in enumerate(near)])
    best = p.argmax(1)
    best[p.max(1) < SURE] = 0
    taken = sorted((s, e) for _, s, e in base)
    out: list[tuple[str, int, int]] = []
    i = 0
    while i < len(near):
        j = i + 1
        while j < len(near) and best[j] == best[i] and near[j] == near[j - 1] + 1:
            j += 1
        if best[i]:
            s, e = tokens[near[i]][0], tokens[near[j - 1]][1]
            while s < e and text[s] in ".,;:!?\"'<>[]{}=":
                s += 1
            while s < e and text[e - 1] in ".,;:!?\"'<>[]{}=":
                e -= 1
            kind, part = LABELS[best[i]], text[s:e]
            whole = "@" in _keys(part)[0] if kind == "email" and _keys(part)[0] else bool(PATTERNS["ip"].fullmatch(part)) and valid("ip", part) if kind == "ip" else valid(kind, part)
            if whole and s < e and not any(x < e and s < y for x, y in taken):
                out.append((kind, s, e))
        i = j
    return out


def find(field: Field, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    if not text or not _SIGN.search(text):
        return [], []
    base = base_spans(text)
    more = added_spans(field, text, base)
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPANS = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, masked string"


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with ``pii``: base spans, all spans, and the text with each span masked.

    One pass over whole texts, no shuffle; a very long text takes time and memory in proportion to its
    length. A null text has no spans and stays null; every row is treated alone, so repeated rows give
    repeated results, an empty table an empty one. A column named ``pii`` is replaced; ``spans_of`` gives the
    column itself, for use under any name.
    """
    return docs.withColumn("pii", spans_of(docs, field))


def spans_of(docs: DataFrame, field: Field | None = None) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(field or train())

    @F.pandas_udf(SPANS)
    def run(text: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in text:
            rows = []
            for v in t:
                v = v if isinstance(v, str) else None
                base, spans = find(shared.value, v)
                rows.append(([_named(x) for x in base], [_named(x) for x in spans], masked(v, spans)))
            yield pd.DataFrame(rows, columns=["base", "spans", "masked"])

    return run(F.col("text").cast("string"))


def _named(span: tuple[str, int, int]) -> dict:
    return dict(zip(("kind", "start", "end"), span))


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Each span replaced by its kind in angle brackets; overlapping spans by the first one's."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
