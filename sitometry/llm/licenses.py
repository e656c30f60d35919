"""Licence scan: passages compared with licence templates by Dice over word bigrams.

A text is normalised to lower-case words; a template and a passage agree by
``2 |A & B| / (|A| + |B|)`` over their distinct word bigrams. Since the shared part is at most the
smaller set, only templates whose size lies within [d / (2 - d), (2 - d) / d] of the passage's can
reach Dice d; the others are not compared. Passages are the lines, and besides them every window of
consecutive words of the whole text, so a notice may be wrapped over lines or stand among other
words. Windows that begin and end with a bigram of the template suffice: cutting other words off the
ends raises Dice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICE = 0.8
#: Notices by which a work names its licence, as published with each licence.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}


_WORD = re.compile("[a-z0-9]+")


def bigrams(text: str) -> set[str]:
    """Distinct word pairs; a single word counts as a pair with nothing."""
    w = _WORD.findall(text.lower())
    return {f"{a} {b}" for a, b in zip(w, w[1:])} if len(w) != 1 else {f"{w[0]} "}


def templates() -> list[tuple[str, str, list[str]]]:
    """(licence, template id, distinct bigrams)."""
    return [(name, f"{name}#{k}", sorted(bigrams(t))) for name, texts in TEMPLATES.items() for k, t in enumerate(texts)]


class Matcher:
    def __init__(self, least: float = DICE):
        self.least, self.known = least, templates()
        self.having: dict[str, list[int]] = {}
        for k, (_, _, pairs) in enumerate(self.known):
            for p in pairs:
                self.having.setdefault(p, []).append(k)
        low, high = least / (2 - least), (2 - least) / least
        self.bounds = [(len(p) * low, len(p) * high) for _, _, p in self.known]
        self.low, self.high = min(b for b, _ in self.bounds), max(b for _, b in self.bounds)
        self.pairs = {tuple(p.split(" ")): ks for p, ks in self.having.items()}

    def best(self, line: str) -> tuple[str, str, float] | None:
        own = bigrams(line)
        n = len(own)
        if not self.low <= n <= self.high:
            return None
        shared: dict[int, int] = {}
        for p in own:
            for k in self.having.get(p, ()):
                if self.bounds[k][0] <= n <= self.bounds[k][1]:
                    shared[k] = shared.get(k, 0) + 1
        found = [(-2.0 * c / (n + len(self.known[k][2])), self.known[k][1], self.known[k][0]) for k, c in shared.items()]
        if not found or -min(found)[0] < self.least:
            return None
        d, key, name = min(found)
        return name, key, -d

    def windows(self, pairs: list[tuple[str, str]], hits: list[int], reach: set[int]) -> Iterator[tuple[int, int, int, float]]:
        """(first pair, last pair, template, Dice) of the windows that match, by first pair.

        A window whose first or last pair is in it twice says no more than the shorter one. So at
        any place each template has at most one window growing for each of its pairs.
        """
        for s in hits:
            for k in self.pairs[pairs[s]]:
                if k not in reach:
                    continue
                m, own, shared = len(self.known[k][2]), set(), 0
                for e in range(s, len(pairs)):
                    p = pairs[e]
                    if p in own:
                        if p == pairs[s]:
                            break
                        continue
                    own.add(p)
                    if 2.0 * m / (m + len(own)) < self.least:
                        break
                    if k in self.pairs.get(p, ()):
                        shared += 1
                        dice = 2.0 * shared / (m + len(own))
                        if dice >= self.least:
                            yield s, e, k, dice

    def found(self, text: str) -> list[tuple[str, str, int, float]]:
        """(licence, template, line, Dice) of the lines that match, and of the windows beside them."""
        lines, words, starts = text.split("\n"), [], []
        for line in lines:
            starts.append(len(words))
            words += _WORD.findall(line.lower())
        pairs = list(zip(words, words[1:]))
        hits = [i for i, p in enumerate(pairs) if p in self.pairs]
        counts = Counter(k for p in {pairs[i] for i in hits} for k in self.pairs[p])
        reach = {k for k, c in counts.items() if 2.0 * c / (c + len(self.known[k][2])) >= self.least}
        if not reach:
            return []
        out, whole = [], []
        starts.append(len(words))
        at = {key: k for k, (_, key, _) in enumerate(self.known)}
        for n in sorted({bisect_right(starts, i) - 1 for i in hits}):
            best = self.best(lines[n])
            if best:
                out.append((best[0], best[1], n + 1, best[2]))
                inside = [i for i in range(starts[n], starts[n + 1] - 1) if at[best[1]] in self.pairs.get(pairs[i], ())]
                whole.append((inside[0], inside[-1] + 1))
        group, end, done = [], -1, 0

        def choose() -> None:
            # words that a matching line shares with its template are taken; both lists are in order
            nonlocal done
            while done < len(whole) and whole[done][1] < group[0][0]:
                done += 1
            first, n = group[0][0], done
            taken = bytearray(end - first + 1)
            while n < len(whole) and whole[n][0] <= end:
                a, b = max(whole[n][0], first) - first, min(whole[n][1], end) - first + 1
                taken[a:b] = b"\1" * (b - a)
                n += 1
            for s, e, k, dice in sorted(group, key=lambda g: (-g[3] * len(self.known[g[2]][2]), g[1] - g[0], g[0], self.known[g[2]][1])):
                a, b = s - first, e + 2 - first
                if 1 not in taken[a:b]:
                    taken[a:b] = b"\1" * (b - a)
                    out.append((self.known[k][0], self.known[k][1], bisect_right(starts, s), dice))

        for w in self.windows(pairs, hits, reach):
            if group and w[0] > end:  # windows that share no word with the earlier ones
                choose()
                group = []
            group.append(w)
            end = max(end, w[1] + 1)
        if group:
            choose()
        return out


def scan(docs: DataFrame, least: float = DICE) -> DataFrame:
    """``doc_id, license, template, line, dice``: the passages of each text that match a template.

    Each line gives its best template (the first by id among equals). Of the windows that share no
    word with what such a line has of its template, those with the largest Dice times template size
    are taken one after another, none sharing a word with one taken before; ``line`` is where it
    begins. Lines are numbered from 1, empty ones included. Null and empty texts match nothing;
    repeated rows give repeated rows. One pass over whole texts, no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(least)
        for b in batches:
            rows = []
            for d, text in zip(b["doc_id"], b["text"]):
                rows += [(d, *found) for found in matcher.found(text or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "template", "line", "dice"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, "doc_id long, license string, template string, line int, dice double")


def sql(least: float = DICE) -> str:
    """DuckDB's equivalent of ``scan`` over the documents table, where notices are whole lines."""
    rows = ", ".join("('%s', '%s', [%s])" % (n, k, ", ".join(f"'{p}'" for p in b)) for n, k, b in templates())
    return f"""
WITH template(license, template, pairs) AS (VALUES {rows}),
line AS (
  SELECT doc_id, CAST(i AS INTEGER) AS line, string_split(text, chr(10))[i] AS passage
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), worded AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(lower(passage), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM line
), own AS (
  SELECT doc_id, line, CASE WHEN len(w) = 1 THEN [w[1] || ' '] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS own
  FROM worded WHERE len(w) >= 1
), scored AS (
  SELECT o.doc_id, o.line, t.license, t.template,
         2.0::DOUBLE * len(list_intersect(o.own, t.pairs)) / (len(o.own) + len(t.pairs)) AS dice
  FROM own o JOIN template t ON len(o.own) BETWEEN len(t.pairs) * {least / (2 - least)!r} AND len(t.pairs) * {(2 - least) / least!r}
)
SELECT doc_id, license, template, line, dice FROM scored WHERE dice >= {least}
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, template) = 1
"""
