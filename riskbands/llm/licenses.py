"""Operator 2: license scans by an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text, long lines in windows of BLOCK_WORDS words (more if the templates are long, see
``block_words``) that overlap by half, and, for notices
that are wrapped over lines, such windows of the words of a text of several lines. A block matches a template when
it holds at least ``threshold`` of the template's distinct words (containment). The join is exact and goes through
filters first:

* tokens have one global order, rarest first, by the number of documents that hold them (counted over the
  whole corpus in a first pass; only the templates' words matter, so the table is bounded by the templates);
* prefix: with ``need`` = ceil(threshold * |T|), a match holds one of the template's |T| - need + 1 rarest words;
* length: it has at least ``need`` distinct words;
* positions: from the first common word in the global order on, both sides must have enough words left;
* the survivors are verified by their intersection within the best stretch of the block, of hardly more words than
  the template has, so that words scattered over a long text are no match;
* templates of different licenses that share most of their words (siblings: versions, "NonCommercial" and the like)
  are told apart by the few words in which they differ: the stretch must hold its own and none of the other's.

Besides, phrases (``PHRASES``) are found wherever their words stand consecutively. Scanning is map-side, the
templates are a parameter of fixed size, and nothing else is broadcast.

Words are runs of ASCII letters and digits and all code points from U+0080, A-Z lowered. Defined cases: null
text is the empty text, with no words and no places; long lines and texts are scanned whole; repeated rows
give repeated results; an empty table gives an empty result; the columns in ``keep`` pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskbands.llm.bpe import in_chunks

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Well-known notices of public licenses; the label, then the words.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                         "the License, or (at your option) any later version."),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation; either version 2 of "
                         "the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                        "International License."),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                        "International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
THRESHOLD = 0.9
SIBLINGS = 0.5  # Jaccard of two templates' words from which on the words in which they differ decide
TELLING = 3  # at most so many words on a side, else the threshold tells them apart
SLACK_WORDS = 6  # a stretch is a quarter or so many words longer than the template
BLOCK_WORDS = 256  # at least; windows hold twice the words of the longest template

_NO_WORD = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_WORDS = bytes.maketrans(_NO_WORD, b" " * len(_NO_WORD))


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_TO_WORDS).split()


def places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        target, counted, start = b" " + phrase + b" ", 0, 0
        at = joined.find(target)
        while at >= 0:
            counted += joined.count(b" ", start, at)
            start = at
            out.append((counted, label))
            at = joined.find(target, at + 1)
    return sorted(out)


def block_words(templates: list[tuple[str, str]]) -> int:
    """Words of a window, so that a copy of the longest template and a quarter more words fit into one."""
    longest = max((len(words_of(text.encode())) for _, text in templates), default=0)
    return max(BLOCK_WORDS, 2 * math.ceil(1.25 * longest))


def windows(ws: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    half = size // 2
    for k in range(0, max(len(ws) - half, min(len(ws), 1)), half):
        yield k, ws[k:k + size]


def blocks(data: bytes, size: int = BLOCK_WORDS) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first word, words) of the text's blocks: its lines, then windows across them."""
    lines = [ws for line in data.split(b"\n") if (ws := words_of(line))]
    at = 0
    for ws in lines:
        for k, block in windows(ws, size):
            yield at + k, block
        at += len(ws)
    if len(lines) > 1:
        yield from windows([w for ws in lines for w in ws], size)


class Join:
    """The templates in the global order, indexed by the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        written = [(label, words_of(text.encode())) for label, text in templates]
        ordered = sorted({w for _, ws in written for w in ws}, key=lambda w: (counts.get(w, 0), w))
        self.order = {w: k for k, w in enumerate(ordered)}
        self.templates = []
        self.prefixes: dict[int, list[int]] = {}
        for label, ws in written:
            own = set(ws)
            tokens = sorted(self.order[w] for w in own)
            need = math.ceil(threshold * len(tokens) - 1e-9)
            for token in tokens[:len(tokens) - need + 1]:
                self.prefixes.setdefault(token, []).append(len(self.templates))
            required, excluded = set(), set()
            for other_label, other in written:
                other = set(other)
                if other_label != label and len(own & other) >= SIBLINGS * len(own | other):
                    required |= own - other if len(own - other) <= TELLING else set()
                    excluded |= other - own if len(other - own) <= TELLING else set()
            room = len(ws) + max(SLACK_WORDS, len(ws) // 4)
            self.templates.append((label, tokens, own, need, required, excluded, room))
        self.triggers = frozenset(w for w, k in self.order.items() if k in self.prefixes)

    def matches(self, block: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(label, containment, start, end) of every template that a stretch of the block holds enough of."""
        held = set(block)
        if self.triggers.isdisjoint(held):
            return []
        tokens = sorted(self.order[w] for w in held & self.order.keys())
        tried: set[int] = set()
        out = []
        for at, token in enumerate(tokens):
            for t in self.prefixes.get(token, ()):
                if t in tried:
                    continue
                tried.add(t)
                label, own, own_set, need, required, excluded, room = self.templates[t]
                left = 1 + min(len(own) - own.index(token) - 1, len(tokens) - at - 1)
                if len(held) < need or left < need or not required <= held:
                    continue
                if len(own_set & held) >= need:
                    out += [(label, n / len(own), lo, hi)
                            for n, lo, hi in stretches(block, own_set, need, room, required, excluded)]
        return out


def stretches(block: list[bytes], words: set[bytes], need: int, room: int, required: set[bytes] = frozenset(),
              excluded: set[bytes] = frozenset()) -> list[tuple[int, int, int]]:
    """(distinct words of the set, start, end) of the block's parts that match.

    A part begins and ends with a word of the set, is at most ``room`` words long, holds ``need`` distinct words of the
    set, among them the required ones, and no excluded word. Of parts that overlap the one with the most words of the
    set counts, then the shortest, then the first.
    """
    held: dict[bytes, int] = {}
    at: list[int] = []
    first, best, out = 0, None, []
    for k, w in enumerate(block):
        if w in excluded:
            held, first = {}, len(at)
        elif w in words:
            at.append(k)
            held[w] = held.get(w, 0) + 1
            while k - at[first] >= room or held[block[at[first]]] > 1:
                gone = block[at[first]]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                first += 1
            if len(held) >= need and required <= held.keys():
                lo, hi = at[first], k + 1
                if best is not None and lo >= best[2]:
                    out.append(best)
                    best = None
                if best is None or (len(held), lo - hi) > (best[0], best[1] - best[2]):
                    best = (len(held), lo, hi)
    return out if best is None else [*out, best]


def corpus_counts(docs: DataFrame, templates: list[tuple[str, str]], text: str) -> dict[bytes, int]:
    """Number of documents that hold each word of the templates."""
    vocabulary = frozenset(w for _, t in templates for w in words_of(t.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for part in in_chunks(batch, "__text"):
                for t in part.column("__text").to_pylist():
                    for w in vocabulary.intersection(words_of((t or "").encode())):
                        total[w] = total.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counts = docs.select(docs[text].alias("__text")).mapInArrow(run, "word binary, n long")
    return {bytes(r.word): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD,
         text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_words, ``phrases`` (start, label) and ``matches`` (label, start, end, containment), in words."""
    templates = TEMPLATES if templates is None else templates
    size = block_words(templates)
    join = Join(templates, corpus_counts(docs, templates, text), threshold)
    phrases = {p.encode(): label for p, label in PHRASES.items()}
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())])
    match = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
                          T.StructField("end", T.LongType()), T.StructField("containment", T.DoubleType())])
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != "__text"],
                           T.StructField("n_words", T.LongType()), T.StructField("phrases", T.ArrayType(place)),
                           T.StructField("matches", T.ArrayType(match))])
    place_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    match_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                     ("containment", pa.float64())]))

    def one(data: bytes) -> tuple[int, list, list]:
        ws = words_of(data)
        found = []
        if not join.triggers.isdisjoint(ws):
            # overlapping blocks find the same stretch
            found = sorted({(at + lo, at + hi, label, c) for at, block in blocks(data, size)
                            for label, c, lo, hi in join.matches(block)})
            found = [{"label": label, "start": lo, "end": hi, "containment": c} for lo, hi, label, c in found]
        return len(ws), [{"start": s, "label": label} for s, label in places(ws, phrases)], found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch, "__text"):
                rows = [one((t or "").encode()) for t in part.column("__text").to_pylist()]
                n, base, found = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(base, place_type),
                     pa.array(found, match_type)], [*keep, "n_words", "phrases", "matches"])

    return kept.mapInArrow(run, schema)
