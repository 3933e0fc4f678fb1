"""License scans: set-similarity join of text blocks with license templates.

The blocks of a text are ``BLOCK`` of its words, across line breaks, and overlap by half. A block
holds a template when at least ``threshold`` of the template's different words are in it (containment)
within a span of one and a half times the template's words; a span is never longer than half a block,
so each lies in one block as a whole. The words that tell a license from others (``KEYS``) must be in the
span, and a span ends at words that make it another license (``OTHERS``). Short templates consist of
words that must all be there.

Of a block only its words that some template has matter: its set. All sets are ordered alike, by how many documents
hold a word, counted over all documents, rarest first, then by name. Where a block's set B holds a template's set T to
the threshold, ``need = ceil(threshold |T|)``, the two share a word among the first ``|T| - need + 1`` of T and the first
``|B| - need + 1`` of B (prefix filter); B has ``need`` words or more (length filter); and with c words shared up to place
i of T and j of B no more than ``c + min(|T| - i, |B| - j) - 1`` can be shared, places counted from 0 (positional
filter). What passes is verified exactly, span by span.

The templates are a fixed list, so their index is small whatever the corpus.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT, per_document, quoted, with_text

BLOCK, THRESHOLD = 256, 0.8

#: Phrases whose places count as base findings, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Opening passages of public licenses and common notices, with labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("proprietary", "All rights reserved. No part may be reproduced without written permission"),
    ("proprietary", "All rights reserved"),
)

#: Words of a label's templates that each must stand in the span, where a template has them.
KEYS = {"mit": ("mit",), "apache": ("apache",), "gpl": ("gnu", "program"), "mpl": ("mozilla",), "cc-by": ("creative", "commons")}

#: Words that make a notice one of another license.
OTHERS = {
    "gpl": ("lesser", "library", "affero"),
    "cc-by": ("sharealike", "noncommercial", "noderivatives", "noderivs"),
}

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters."""
    return text.encode().translate(_WORD).split()


def blocks_of(text: str, size: int = BLOCK):
    found = words_of(text)
    for at in range(0, max(len(found) - size // 2, min(len(found), 1)), size // 2):
        yield found[at : at + size]


def frequencies(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of the (fixed, small) vocabulary occurs."""
    wanted = {w.encode(): i for i, w in enumerate(vocabulary)}

    def run(batches):
        counts = [0] * len(wanted)
        for batch in batches:
            for (text,) in zip(batch.column(0).to_pylist()):
                for w in wanted.keys() & words_of(text):
                    counts[wanted[w]] += 1
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts, pa.int64())], ["i", "n"])

    rows = with_text(docs, [], text_col).select(TEXT).mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    found = {r.i: r.n for r in rows}
    return {w: found.get(i, 0) for i, w in enumerate(vocabulary)}


class Index:
    """The templates' prefixes as an inverted index from word to (template, place)."""

    def __init__(self, templates, counts: dict[str, int], threshold: float):
        self.need, self.size, self.labels, self.spans, self.keys, self.others, self.sets = [], [], [], [], [], [], []
        vocabulary = sorted({w.decode() for _, text in templates for w in words_of(text)}, key=lambda w: (counts.get(w, 0), w))
        #: The global order: each word's rank.
        self.rank = {w.encode(): r for r, w in enumerate(vocabulary)}
        self.words = frozenset(self.rank)
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        self.met = self.too_short = self.out_of_place = self.verified = 0
        for t, (label, text) in enumerate(templates):
            ranks = sorted({self.rank[w] for w in words_of(text)})
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.sets.append(frozenset(words_of(text)))
            self.need.append(need)
            self.size.append(len(ranks))
            self.labels.append(label)
            self.keys.append(self.sets[-1] & {w.encode() for w in KEYS.get(label, ())})
            self.others.append(frozenset(w.encode() for w in OTHERS.get(label, ())))
            self.spans.append(math.ceil(1.5 * len(words_of(text))))
            if self.spans[-1] > BLOCK // 2:
                raise ValueError(f"a template may have at most {BLOCK // 3} words")
            for place, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefix.setdefault(r, []).append((t, place))
        self.least = min(self.need, default=0)

    def candidates(self, block: list[bytes]) -> list[int]:
        """The templates that the prefix, length and positional filters leave."""
        held = sorted(self.rank[w] for w in self.words.intersection(block))
        shared: dict[int, int] = {}
        out_of_place = set()
        for j, r in enumerate(held[: max(0, len(held) - self.least + 1)]):
            for t, i in self.prefix.get(r, ()):
                if t not in shared:
                    self.met += 1
                    self.too_short += len(held) < self.need[t]
                shared[t] = shared.get(t, 0) + 1
                if len(held) >= self.need[t] and shared[t] + min(self.size[t] - i, len(held) - j) - 1 < self.need[t]:
                    out_of_place.add(t)
        self.out_of_place += len(out_of_place)
        return [t for t in shared if len(held) >= self.need[t] and t not in out_of_place]

    def best(self, block: list[bytes], contained: set[str] | None = None) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block holds.

        ``contained`` gets the labels of all templates whose words reach the threshold anywhere in the block.
        """
        out, words = [], frozenset(block)
        for t in self.candidates(block):
            self.verified += 1
            if contained is not None and len(self.sets[t] & words) >= self.need[t]:
                contained.add(self.labels[t])
            if (n := self.within(t, block)) >= self.need[t]:
                out.append((self.labels[t], n / self.size[t]))
        return out

    def within(self, t: int, block: list[bytes]) -> int:
        """The most different words of a template in any of its spans of the block that holds all its keys."""
        wanted, span, keys, others = self.sets[t], self.spans[t], self.keys[t], self.others[t]
        held, most = deque(), 0
        counts: dict[bytes, int] = {}
        for at, w in enumerate(block):
            if w in others:
                held.clear()
                counts.clear()
            if w not in wanted:
                continue
            held.append((at, w))
            counts[w] = counts.get(w, 0) + 1
            while held[0][0] <= at - span:
                _, gone = held.popleft()
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
            if len(counts) > most and keys <= counts.keys():
                most = len(counts)
        return most


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, keep: Sequence[str] | None = None) -> DataFrame:
    """One row a document with its base phrases and the templates its blocks hold.

    ``labels`` has all of ``base_labels`` and those of the templates; ``contained`` the labels of templates whose words reach the
    threshold within a block, wherever they stand there. ``score`` is the largest containment of a template that a block reaches, 1 where a base phrase stands,
    else 0. Null and empty texts have no words and no labels (empty strings, null places).
    Repeated rows stay repeated; other columns of the input are left out unless in ``keep``.
    """
    vocabulary = sorted({w.decode() for _, t in templates for w in words_of(t)})
    index = Index(templates, frequencies(docs, vocabulary, text_col), threshold)
    sought = [(tuple(w.encode() for w in p.split()), label) for p, label in phrases]
    lasts = {}
    for p, label in sought:
        lasts.setdefault(p[-1], []).append((p, label))

    def make():
        def work(texts):
            out = [[] for _ in range(9)]
            for text in texts:
                found = words_of(text)
                places, base, n = [], set(), 0
                for last, options in lasts.items():
                    at = -1
                    for _ in range(found.count(last)):
                        at = found.index(last, at + 1)
                        for p, label in options:
                            start = at - len(p) + 1
                            if start >= 0 and tuple(found[start : at + 1]) == p:
                                places.append(start)
                                base.add(label)
                                n += 1
                held, contained = {}, set()
                if not index.words.isdisjoint(found):
                    for block in blocks_of(text):
                        for label, part in index.best(block, contained):
                            held[label] = max(part, held.get(label, 0.0))
                labels = base | held.keys()
                row = (len(found), n, min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else max(held.values(), default=0.0), len(held), ",".join(sorted(contained)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long, contained string"
    return per_document(docs.select(*[F.col(quoted(c)) for c in dict.fromkeys([*(keep or [id_col]), text_col])]), keep or [id_col], fields, make, text_col)
