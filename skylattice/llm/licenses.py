"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a run of `2 * step` words starting at every `step` words, step being the words of the longest
template, so any passage as long as a template lies in one block. A template is found in a block that
holds at least `threshold` of its different words; an ordered template (a phrase) needs all of
them, and its words one after the other. All words of the templates are put in one order, rarest
in the corpus first. A block that reaches a template shares a word with its prefix, so only blocks with
a prefix word leave the scan; they are joined with the prefixes under the length and positional
filters, and every pair left is verified on its whole sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.llm.buffers import chunks, flat, lower, spans, word_hashes
from skylattice.session import materialize

THRESHOLD = 0.8
#: Most words of all templates together; they are sent to every task.
MAX_WORDS = 100_000

_GAP = np.zeros(256, bool)
_GAP[:0x80] = True
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Template(NamedTuple):
    label: str
    text: str
    ordered: bool = False
    base: bool = False


#: Phrases of the contract.
PHRASES = [
    Template("gpl", "gnu general public license", ordered=True, base=True),
    Template("apache", "apache license", ordered=True, base=True),
    Template("cc-by", "cc by", ordered=True, base=True),
    Template("mit", "mit license", ordered=True, base=True),
]
#: Names and notices of public licenses.
NOTICES = [
    Template("agpl", "gnu affero general public license", ordered=True),
    Template("bsd", "bsd license", ordered=True),
    Template("cc-by-nc", "cc by nc", ordered=True),
    Template("cc-by-nd", "cc by nd", ordered=True),
    Template("cc-by-sa", "cc by sa", ordered=True),
    Template("cc0", "cc0", ordered=True),
    Template("lgpl", "gnu lesser general public license", ordered=True),
    Template("mpl", "mozilla public license", ordered=True),
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in "
                       "compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
                    "permitted provided that the following conditions are met"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms "
                    "of the GNU General Public License as published by the Free Software Foundation"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
                    "or without fee is hereby granted"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
                    "software and associated documentation files, to deal in the Software without restriction"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: str) -> list[str]:
    """Words with A-Z in lower case, as the scan takes them."""
    return [w.decode() for w in _WORD.findall(text.encode().lower())]


class _Vocabulary:
    """Numbers of the templates' words; the hash finds them, the bytes decide."""

    def __init__(self, ordered: list[str]):
        self.number = {w.encode(): i for i, w in enumerate(ordered)}
        raw = " ".join(ordered).encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = spans(data, np.array([0, len(raw)]), _GAP)
        hashes = word_hashes(data, starts, ends)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word by its hash alone, -1 if it is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.by_hash[at], -1)


def _scanned(texts: pa.Array):
    """(first row, end row, bytes, word starts, word ends, row of each word, word hashes) by chunk."""
    data, offsets = flat(texts)
    for a, b, part, ends in chunks(data, offsets):
        low = lower(part)
        starts, stops, rows = spans(low, ends, _GAP)
        yield a, b, low, starts, stops, rows, word_hashes(low, starts, stops)


def word_counts(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """How often each of the given words occurs in all texts; added up in every task first."""
    vocabulary = list(vocabulary)

    def counted(batches):
        known, total = _Vocabulary(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for *_, hashes in _scanned(batch.column(0)):
                at = known.find(hashes)
                total += np.bincount(at[at >= 0], minlength=len(vocabulary))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])],
                                         names=["word", "n"])

    sums = (docs.select(F.col(text_col).cast("binary")).mapInArrow(counted, "word int, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))
    return {vocabulary[r["word"]]: r["n"] for r in sums.collect()}


def needed(size: int, threshold: float) -> int:
    """Least number of common words for a template of `size` different words."""
    return max(1, math.ceil(round(size * threshold, 9)))


def text_blocks(docs: DataFrame, vocabulary: Sequence[str], prefix: Sequence[bool], step: int, *,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, blocks) of every document: the blocks that hold a prefix word, with their
    number and the vocabulary numbers of their words in order, -1 for other words."""
    ordered, first = list(vocabulary), np.array([*prefix, False])
    kind = docs.schema[id_col].dataType.simpleString()

    def computed(batches):
        known = _Vocabulary(ordered)
        for batch in batches:
            for a, b, low, starts, stops, rows, hashes in _scanned(batch.column(2)):
                bounds = np.searchsorted(rows, np.arange(b - a + 1))
                hits = np.flatnonzero(first[known.find(hashes)])
                row, block = rows[hits], (hits - bounds[rows[hits]]) // step
                found = np.unique(np.concatenate([
                    np.stack([row, block], 1), np.stack([row, block - 1], 1)[block > 0]]), axis=0)
                numbers, terms, sizes = [], [], [0]
                for i, k in found.tolist():
                    s = bounds[i] + k * step
                    e = min(s + 2 * step, bounds[i + 1])
                    terms.extend(known.number.get(low[x:y].tobytes(), -1)
                                 for x, y in zip(starts[s:e].tolist(), stops[s:e].tolist()))
                    numbers.append(k)
                    sizes.append(len(terms))
                struct = pa.StructArray.from_arrays(
                    [pa.array(numbers, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(terms, pa.int32()))],
                    names=["block", "terms"])
                of = np.searchsorted(found[:, 0], np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(of), struct)],
                    names=["row", "id", "n_words", "blocks"])

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                         F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(computed, f"row long, id {kind}, n_words long, "
                                       "blocks array<struct<block: int, terms: array<int>>>")


def _prefixes(docs: DataFrame, templates: list[tuple], order: dict[str, int]) -> DataFrame:
    """(term, at, template, label, base, phrase, terms, need): a row for each word of each prefix."""
    rows = []
    for k, (t, listed, need) in enumerate(templates):
        terms = sorted({order[w] for w in listed})
        phrase = [order[w] for w in listed] if t.ordered else None
        rows += [(term, at, k, t.label, t.base, phrase, terms, need)
                 for at, term in enumerate(terms[:len(terms) - need + 1])]
    return docs.sparkSession.createDataFrame(
        rows, "term int, at int, template int, label string, base boolean, phrase array<int>, "
        "terms array<int>, need int")


def similar_blocks(blocks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, block, words, template, label, base, phrase, share): the set-similarity join, each pair
    once, under the first word that both have."""
    sets = blocks.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select(
        "row", "b.block", F.col("b.terms").alias("words"),
        F.array_sort(F.array_distinct(F.filter("b.terms", lambda x: x >= 0))).alias("held"))
    probes = sets.select("*", F.size("held").alias("n"), F.posexplode("held").alias("place", "term"))
    enough = ((F.col("n") >= F.col("need")) & (F.col("place") <= F.col("n") - F.col("need"))
              & (F.least(F.size("terms") - F.col("at"), F.col("n") - F.col("place")) >= F.col("need")))
    met = probes.join(F.broadcast(prefixes), "term").where(enough)
    both = met.withColumn("both", F.array_intersect("held", "terms"))
    found = both.where((F.array_min("both") == F.col("term")) & (F.size("both") >= F.col("need")))
    return found.select("row", "block", "words", "template", "label", "base", "phrase",
                        (F.size("both") / F.size("terms")).alias("share"))


def _places(step: int) -> Column:
    """Places in the block's first half where the phrase's words stand one after the other."""
    last = F.least(F.lit(step), F.size("words") - F.size("phrase") + 1) - 1
    each = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(each, lambda i: F.slice("words", i + 1, F.size("phrase")) == F.col("phrase"))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), *,
                  threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    n_base counts all places of base phrases, first_word and last_word are the least and the greatest
    of them (null without any); score is the largest share of a found template, 1 for a phrase, 0 without
    any. A null or wordless text has no words and no labels; rows are numbered, so ids may be null or
    repeated; other columns are not read; an empty table gives no rows. Templates without words are
    never found. A text is scanned whole, in some 40 bytes of memory a byte."""
    listed = [(t, words(t.text)) for t in templates]
    listed = [(t, w, needed(len(set(w)), 1.0 if t.ordered else threshold)) for t, w in listed if w]
    if sum(len(w) for _, w, _ in listed) > MAX_WORDS:
        raise ValueError(f"templates hold more than {MAX_WORDS} words; scan them in parts")
    step = max((len(w) for _, w, _ in listed), default=1)
    vocabulary = sorted({x for _, w, _ in listed for x in w})
    counts = word_counts(docs, vocabulary, text_col)
    vocabulary.sort(key=lambda w: (counts.get(w, 0), w))
    order = {w: i for i, w in enumerate(vocabulary)}
    prefix = [False] * len(vocabulary)
    for _, w, need in listed:
        terms = sorted({order[x] for x in w})
        for term in terms[:len(terms) - need + 1]:
            prefix[term] = True
    blocks = materialize(text_blocks(docs, vocabulary, prefix, step, id_col=id_col, text_col=text_col))
    found = similar_blocks(blocks, _prefixes(docs, listed, order))
    placed = found.withColumn("places", F.when(F.col("phrase").isNotNull(), _places(step)))
    hits = placed.where(F.col("phrase").isNull() | (F.size("places") > 0))
    base = F.when(F.col("base"), F.size("places"))
    ahead = F.col("block").cast("long") * step
    joined = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    judged = hits.groupBy("row").agg(
        F.sum(base).alias("n_base"),
        F.min(F.when(F.col("base"), ahead + F.array_min("places"))).alias("first_word"),
        F.max(F.when(F.col("base"), ahead + F.array_max("places"))).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"), F.max("share").alias("score"))
    none = lambda c, value: F.coalesce(c, F.lit(value)).alias(c)
    return blocks.select("row", "id", "n_words").join(judged, "row", "left").select(
        F.col("id").alias(id_col), "n_words", none("n_base", 0), "first_word", "last_word",
        none("base_labels", ""), none("labels", ""), none("score", 0.0))
