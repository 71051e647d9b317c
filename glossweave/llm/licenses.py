"""Operator 3: license scan by an exact set-similarity join of text blocks with license templates.

A block is a line of a document, or a run of lines over which a notice is wrapped. It matches a template when it holds at least ``threshold`` of the template's distinct
words. With tokens in one global order, rarest first, over the documents of the whole corpus (Chaudhuri et al. 2006; PPJoin,
Xiao et al. 2008), a template of t tokens that needs an overlap of a = ceil(threshold * t) can only match a block that
has one of its first t - a + 1 tokens (prefix filter), that has a tokens of the templates' vocabulary at all (length
filter), and in which, from the first common token on, both have enough tokens left (positional filter). What passes is
verified. Words that no template has can add to no overlap; they are dropped from the blocks first, which
changes no result and makes the filters as sharp as they can be.

The templates are a parameter of a few hundred words, whatever the corpus, that go to every task. No text is shuffled:
words are hashed, looked up, probed and verified where the documents are read, and verification compares the words
themselves. Only the counts of the templates' own words are gathered.

Lines are joined and verified so. For wrapped notices, documents of several lines that hold the threshold of a template
as a whole are searched for the shortest runs of words that do, of which the template's length has to be the threshold's share at least; a
run over several lines counts unless a line or a shorter run of lines within it matches by itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPLIT, distinct, lean, pieces, table, text_buffers, words

THRESHOLD = 0.8
#: Opening or usual notices of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights": "Copyright. All rights reserved. No part of this publication may be reproduced without permission",
}


def tokens(text: str) -> list[str]:
    """Distinct words of a template, as in the blocks."""
    return sorted({w for w in re.split(SPLIT, text.lower()) if w})


def required(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def _hashes(vocabulary: list[str]) -> np.ndarray:
    raw = np.frombuffer("\n".join(vocabulary).encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), "ink")[0]


class Held:
    """The words of a vocabulary in a batch of lower-cased texts: their ids, rows, lines (counted through the batch) and places."""

    def __init__(self, texts: pa.Array, hashes: np.ndarray):
        self.text, self.offsets = text_buffers(texts)
        found, begin, end, row = words(self.text, self.offsets, "alnum")
        order = np.argsort(hashes)
        seen = np.zeros(1 << 16, bool)
        seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(found & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(hashes[order], found[maybe]), len(hashes) - 1)
        hit = hashes[order][at] == found[maybe]
        maybe = maybe[hit]
        self.word, self.row, self.place = order[at[hit]], row[maybe], maybe
        feeds = np.flatnonzero(self.text == 10)
        # the first line of a row is numbered beyond the last of the row before
        self.first_line = np.searchsorted(feeds, self.offsets[:-1]) + np.arange(len(texts))
        self.line = np.searchsorted(feeds, begin[maybe]) + self.row

    def distinct_in(self, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(unit, word), each pair once, in order."""
        keys = distinct(unit.astype(np.int64) * n + self.word)
        return keys // n, keys % n


def vocabulary_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many lines of the corpus each template word occurs."""
    hashes = _hashes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes), np.int64)
        for batch in (piece for whole in batches for piece in pieces(whole, 0)):
            held = Held(batch.column(0), hashes)
            total += np.bincount(held.distinct_in(held.line, len(hashes))[1], minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hashes))), pa.array(total)], names=["word", "n"])

    counted = docs.where("text is not null").select(F.lower("text").alias("text")).mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {vocabulary[r.word]: r.n for r in counted.collect()}  # a row for each template word


def wrapped(text: str, known: dict[str, tuple[frozenset[str], int, int]]) -> list[tuple[int, str, int, float]]:
    """(block, template, overlap, containment) of the runs of lines of a lower-cased text that match, without single lines."""
    lines = [[w for w in re.split(SPLIT, line) if w] for line in text.split("\n")]
    placed = [(at, w) for at, line in enumerate(lines) for w in line]
    out = []
    for name, (words, need, most) in known.items():
        held = [(i, at, w) for i, (at, w) in enumerate(placed) if w in words]
        alone: dict[int, set[str]] = {}
        for _, at, w in held:
            alone.setdefault(at, set()).add(w)
        ranges = {(at, at) for at, own in alone.items() if len(own) >= need}
        count: Counter[str] = Counter()
        left = 0
        for i, at, w in held:
            count[w] += 1
            while len(count) >= need:
                if i - held[left][0] < most:
                    ranges.add((held[left][1], at))
                _less(count, held[left][2])
                left += 1
        end = len(lines)
        for a, b in sorted(ranges, key=lambda r: (-r[0], r[1])):
            if b < end:  # no other range lies within it
                end = b
                if a < b:
                    overlap = _densest([x for x in held if a <= x[1] <= b], most)
                    out.append((a, name, overlap, overlap / len(words)))
    return out


def _less(count: Counter[str], word: str) -> None:
    count[word] -= 1
    if not count[word]:
        del count[word]


def _densest(held: list[tuple[int, int, str]], most: int) -> int:
    """The greatest number of different words in a run of ``most`` words."""
    count: Counter[str] = Counter()
    best = left = 0
    for i, _, w in held:
        count[w] += 1
        while i - held[left][0] >= most:
            _less(count, held[left][2])
            left += 1
        best = max(best, len(count))
    return best


def _matcher(known: dict[str, str], threshold: float, counts: dict[str, int]):
    """The join of batches (doc_id, lower-cased text) with the templates."""
    order = sorted({w for text in known.values() for w in tokens(text)}, key=lambda w: (counts.get(w, 0), w))
    hashes, rank = _hashes(order), {w: i for i, w in enumerate(order)}
    ranked = {name: sorted(rank[w] for w in tokens(text)) for name, text in known.items()}
    need = {name: required(len(t), threshold) for name, t in ranked.items()}
    sets = {name: frozenset(t) for name, t in ranked.items()}
    exact = {name: (frozenset(tokens(text)), need[name], math.ceil(sum(1 for w in re.split(SPLIT, text.lower()) if w) / threshold)) for name, text in known.items()}
    index: dict[int, list[tuple[str, int]]] = {}
    for name, t in ranked.items():
        for i in range(len(t) - need[name] + 1):
            index.setdefault(t[i], []).append((name, i))
    is_prefix = np.zeros(len(order), bool)
    is_prefix[list(index)] = True

    # words before a first common one aren't in common, as a template's words before its index are prefix words too
    def probe(units: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, str]]:
        """(unit, template) of the sets of words that pass the prefix, length and positional filters and hold enough in common."""
        border = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1], [True]))) if len(units) else np.zeros(1, int)
        first = np.flatnonzero(is_prefix[word])
        for u in np.unique(np.searchsorted(border, first, "right") - 1):
            own = word[border[u] : border[u + 1]].tolist()
            tried: set[str] = set()
            for j, w in enumerate(own):
                for name, i in index.get(w, ()):
                    if name in tried:
                        continue  # an earlier word in common has decided on it
                    tried.add(name)
                    t, least = ranked[name], need[name]
                    if len(own) >= least and min(len(t) - i, len(own) - j) >= least and len(sets[name].intersection(own)) >= least:
                        yield int(units[border[u]]), name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, 1)):
            held, found = Held(batch.column(1), hashes), []
            for line, name in probe(*held.distinct_in(held.line, len(order))):
                row = int(np.searchsorted(held.first_line, line, "right")) - 1
                block = line - int(held.first_line[row])
                own = {w for w in re.split(SPLIT, batch.column(1)[row].as_py().split("\n")[block]) if w}
                overlap = len(exact[name][0] & own)
                if overlap >= need[name]:
                    found.append((row, block, name, overlap, overlap / len(sets[name])))
            for row, name in probe(*held.distinct_in(held.row, len(order))):
                text = batch.column(1)[row].as_py()
                if "\n" in text:
                    found += [(row, *x) for x in wrapped(text, {name: exact[name]})]
            columns = list(zip(*found)) or [()] * 5
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns[1:], (pa.int32(), pa.string(), pa.int32(), pa.float64())))], names=["doc_id", "block", "template", "overlap", "containment"])

    return run


def license_blocks(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every (doc_id, block, template, overlap, containment) of a block that holds ``threshold`` of a template's words.

    Blocks are the lines of a document, counted from 0, and the runs of lines that a notice is wrapped over, which have the
    number of their first line and count the words of the run of words that has most of the template. Words are runs of letters and digits, in lower case, each counted
    once. A block may match several templates and has a row for each. Words of equal frequency are ordered by their
    letters, which has no effect on the result. Null and empty texts have no match, nor do templates without a word; an
    empty table gives an empty result. Very long texts are read whole. Repeated rows match as often as they stand there. Other columns, whatever their names, have no effect.
    """
    known = {name: text for name, text in (TEMPLATES if templates is None else templates).items() if tokens(text)}
    schema = "doc_id long, block int, template string, overlap int, containment double"
    if not known:
        return docs.sparkSession.createDataFrame([], schema)
    counts = vocabulary_counts(docs, sorted({w for text in known.values() for w in tokens(text)}))
    # lower-cased by Spark, so that every letter fares as in SQL
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return texts.mapInArrow(lean(_matcher(known, threshold, counts)), schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_blocks(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"('{name}', {tokens(text)!r}, {required(len(tokens(text)), THRESHOLD)})" for name, text in TEMPLATES.items())
_LEAST = min(required(len(tokens(text)), THRESHOLD) for text in TEMPLATES.values())
OP3_SQL = f"""
WITH templates(template, words, need) AS (VALUES {_VALUES}),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT doc_id, unnest(range(len(l)))::INT AS block, unnest(l) AS line FROM lines),
held AS (SELECT doc_id, block, list_distinct(regexp_split_to_array(lower(line), '{SPLIT}')) AS w FROM blocks WHERE length(line) >= {2 * _LEAST - 1})
SELECT doc_id, block, template, len(list_intersect(words, w))::INT AS overlap, len(list_intersect(words, w)) / len(words) AS containment
FROM held, templates WHERE len(w) >= need AND len(list_intersect(words, w)) >= need
"""
