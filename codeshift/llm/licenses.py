r"""Licence scans with a generalised suffix automaton.

Texts are read as words: A-Z lower-cased, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.

Base: the places where a fixed phrase stands word for word.

Method: a suffix automaton over the words of all licence templates knows every
word sequence that occurs in any of them, and where.  A text is streamed
through it once; the length of the longest match that ends at each word (the
matching statistics) falls where a match cannot go on, which gives the maximal
matches.  Matches of at least ``LEAST`` words are chained per template, in the
order of both text and template, across bounded gaps.  A chain that covers a
share of at least ``COVER`` of its template is a span and adds its label.  The
score is the largest share covered.

Words of no template put the automaton back to its start, so only runs of
template words are streamed at all, which leaves the result as it is.  The
automaton depends on the templates alone and is a few hundred kB.

Defined cases: null text counts as empty (no words, no labels, score 0);
repeated rows and null ids are scanned row by row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import freed, small_batches, whole_text

LEAST, COVER, GAP = 4, 0.8, 12

# Phrases of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices of public licences.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache", "Licensed under the Apache License, Version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
            "later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This work is licensed under the GNU General Public License, version 2"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
]

# Bytes that end a word become blanks; bytes of other characters are part of words.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = [(label, words_of(text)) for label, text in templates]
        self.code: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, (_, words) in enumerate(self.templates):
            last = 0
            for end, w in enumerate(words):
                last = self._extend(last, self.code.setdefault(w, len(self.code)))
                self.ends[last].add((k, end + 1))
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.ends[self.link[v]] |= self.ends[v]

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.len.append(length), self.next.append(nxt), self.link.append(link), self.ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the shorter contexts of ``q`` that ``p`` reaches by ``c``."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        cur, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, self.next[p][c], c)
        return cur

    def statistics(self, codes: list[int]) -> list[tuple[int, int]]:
        """Per word: length of the longest match that ends there, and its state."""
        state = length = 0
        out = []
        for c in codes:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            to = self.next[state].get(c)
            state, length = (to, length + 1) if to is not None else (0, 0)
            out.append((length, state))
        return out

    def matches(self, words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
        """Maximal matches of at least ``least`` words: first word, length, state."""
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False]))))
        found = []
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s < least:
                continue
            ms = self.statistics(codes[s:e].tolist()) + [(0, 0)]
            found += [(s + k + 1 - n, n, v) for k, (n, v) in enumerate(ms[:-1]) if n >= least and ms[k + 1][0] != n + 1]
        return found

    def spans(self, words: list[bytes], least: int = LEAST, gap: int = GAP) -> list[tuple[int, int, int, float]]:
        """Best chains: template, first word, word after the last, share of the template covered."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for first, n, state in self.matches(words, least):
            for k, end in self.ends[state]:
                by_template.setdefault(k, []).append((first, end - n, n))
        out = []
        for k, found in by_template.items():
            found.sort()
            best, back = [n for _, _, n in found], [-1] * len(found)
            for j, (x, y, n) in enumerate(found):
                for i in range(j - 1, -1, -1):
                    u, v, m = found[i]
                    if x - u > len(self.templates[k][1]) + gap:
                        break
                    lap = max(0, u + m - x, v + m - y)
                    if u < x and v < y and lap < n and x - (u + m) <= gap and y - (v + m) <= gap and best[i] + n - lap > best[j]:
                        best[j], back[j] = best[i] + n - lap, i
            used = [False] * len(found)
            for j in sorted(range(len(found)), key=lambda j: (-best[j], j)):
                chain, i = [], j
                while i >= 0 and not used[i]:
                    chain.append(i)
                    used[i] = True
                    i = back[i]
                if chain and i < 0:
                    x, _, n = found[j]
                    out.append((k, found[chain[-1]][0], x + n, best[j] / len(self.templates[k][1])))
        return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Start word and label of every phrase, in one pass: blanks are counted
    from one place to the next."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in PHRASES.items():
        wanted = f" {phrase} ".encode()
        at, seen, word = line.find(wanted), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            out.append((word, label))
            seen, at = at, line.find(wanted, at + 1)
    return sorted(out)


_SPAN = "array<struct<label:string,template:int,first:long,after:long,covered:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
         cover: float = COVER) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score
    and ``spans``: the template spans that made the labels."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = T.StructType([rows.schema["id"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")),
                        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
                        T.StructField("score", T.DoubleType()), T.StructField("spans", T._parse_datatype_string(_SPAN))])
    automaton = Automaton(templates)

    def one(text: str) -> tuple:
        words = words_of(text)
        base = base_places(words)
        chains = automaton.spans(words)
        spans = [{"label": automaton.templates[k][0], "template": k, "first": a, "after": b, "covered": c}
                 for k, a, b, c in sorted(chains, key=lambda s: (s[1], s[0])) if c >= cover]
        base_labels = {label for _, label in base}
        labels = base_labels | {s["label"] for s in spans}
        at = [p for p, _ in base]
        return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)),
                ",".join(sorted(labels)), min(1.0, max((c for *_, c in chains), default=0.0)), spans)

    def run(batches):
        kinds = [f.type for f in to_arrow_schema(out)][1:]
        for b in batches:
            cols = list(zip(*map(one, b.column(1).to_pylist()))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=out.names)

    return rows.mapInArrow(freed(run), out).withColumnRenamed("id", id_col)
