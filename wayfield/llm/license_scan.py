"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words, over line breaks too, as long as the template's own words divided by
``threshold``. It meets a template if it holds at least ``threshold`` of the template's distinct words.
Words are ordered by their frequency over all documents, rarest first: a block that meets the template
must hold one of its first |T| - ceil(threshold * |T|) + 1 words (prefix
filter), so only windows around those are looked at; it must have at least ceil(threshold * |T|) of its words
(length filter), from its own first one on and before its end (positional filter).
What passes is verified by the full overlap, so the join is exact; windows that overlap are one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import buffers, id_text, slices

# Phrases of the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Usual notices, by the label they add.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright all rights reserved"),
]

THRESHOLD = 0.9
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "blocks array<struct<label:string,template:int,first:long,last:long,containment:double>>"
)


class Vocabulary:
    """The templates' and phrases' words: number by hash, through a bit table and a sorted array."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        names = sorted({w for p in phrases for w in p.split()} | {w for _, t in templates for w in t.split()})
        pairs = sorted((words.hash_word(w), w) for w in names)
        self.names = [w for _, w in pairs]
        self.hashes = np.array([h for h, _ in pairs], np.uint64)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.number = {w: i for i, w in enumerate(self.names)}
        spelt = [w.encode() for w in self.names]
        self.size = np.array([len(w) for w in spelt])
        self.letters = np.array([list(w.ljust(max(self.size), b"\0")) for w in spelt], np.uint8)

    def find(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of vocabulary words, and their numbers; the bytes are compared too."""
        at = np.flatnonzero(self.table[(w.hash >> np.uint64(48)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.hashes, w.hash[at]), len(self.hashes) - 1)
        good = (self.hashes[which] == w.hash[at]) & (self.size[which] == w.end[at] - w.start[at])
        at, which = at[good], which[good]
        for k in range(self.letters.shape[1]):
            same = (self.size[which] <= k) | (w.data[np.minimum(w.start[at] + k, len(w.data) - 1)] == self.letters[which, k])
            if not same.all():
                at, which = at[same], which[same]
        return at, which


def _split(text: pa.Array) -> words.Words:
    return words.split(*buffers(text), words.ALNUM, lower=True)


def _frequencies(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each vocabulary word stands in all documents; one row per word and task comes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.names), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                total += np.bincount(vocabulary.find(_split(batch.column(1)))[1], minlength=len(total))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(total[hit])], names=["word", "n"])

    out = np.zeros(len(vocabulary.names), np.int64)
    for r in docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


class Templates:
    """Which vocabulary words stand in each template, which of those are in its prefix, and the filters' bounds."""

    def __init__(self, vocabulary: Vocabulary, templates: list[tuple[str, str]], frequency: np.ndarray, threshold: float):
        rank = np.empty(len(frequency), np.int64)
        rank[np.lexsort((np.arange(len(frequency)), frequency))] = np.arange(len(frequency))
        self.labels = [label for label, _ in templates]
        self.member, self.prefix = (np.zeros((len(templates), len(frequency)), bool) for _ in range(2))
        self.size, self.need, self.span = [], [], []
        for k, (_, t) in enumerate(templates):
            own = sorted((vocabulary.number[w] for w in set(t.split())), key=rank.__getitem__)
            self.size.append(len(own))
            self.need.append(math.ceil(threshold * len(own) - 1e-9))
            self.span.append(math.ceil(len(t.split()) / threshold - 1e-9))
            self.member[k, own] = True
            self.prefix[k, own[: len(own) - self.need[k] + 1]] = True

    def blocks(self, k: int, at: np.ndarray, which: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first start, last start, containment) of each block of template ``k``, by word places; ``stop``: where each place's document ends."""
        own = np.flatnonzero(self.member[k][which])
        at, which, stop = at[own], which[own], stop[own]
        need, span = self.need[k], self.span[k]
        rare = np.flatnonzero(self.prefix[k][which])
        near = np.zeros(len(at) + 1, np.int64)
        np.add.at(near, np.searchsorted(at, at[rare] - span + 1), 1)
        np.add.at(near, rare + 1, -1)
        begin = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        end = np.searchsorted(at, np.minimum(at[begin] + span, stop[begin]))
        enough = end - begin >= need
        run: tuple[int, int, int, int] | None = None
        for b, e in zip(begin[enough].tolist(), end[enough].tolist(), strict=True):
            common = len(set(which[b:e].tolist()))
            if common < need:
                continue
            place, over = int(at[b]), int(stop[b])
            if run and run[3] == over and place - run[1] < span:
                run = (run[0], place, max(run[2], common), over)
                continue
            if run:
                yield run[0], run[1], run[2] / self.size[k]
            run = (place, place, common, over)
        if run:
            yield run[0], run[1], run[2] / self.size[k]


def scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", phrases=None, templates=None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    ``score``: the greatest containment of a matched block, 1 where a base
    phrase stands, else 0. Null text is empty. ``first_word`` and
    ``last_word``: least and greatest start of a base phrase, else null.
    ``blocks``: first and last start of each run of overlapping windows that meet a template, in order of first start and
    template. Repeated rows are scanned alike, very long texts whole; an empty table gives no rows.
    Only the named columns are read, so extra ones can't clash.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    rows = id_text(docs, id_col, text_col)
    vocabulary = Vocabulary(phrases, templates)
    known = Templates(vocabulary, templates, _frequencies(rows, vocabulary), threshold)
    coded = [([vocabulary.number[w] for w in p.split()], label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield chunk(batch)

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _split(batch.column(1))
        n = len(w.first) - 1
        at, which = vocabulary.find(w)
        doc = np.searchsorted(w.first, at, "right") - 1
        n_base, labels, first, last = np.zeros(n, np.int64), [set() for _ in range(n)], [None] * n, [None] * n
        number = np.full(len(w) + 8, -1, np.int32)
        number[at] = which
        for code, label in coded:
            hit = at[which == code[0]]
            for k, c in enumerate(code[1:], 1):
                hit = hit[number[hit + k] == c]
            d = np.searchsorted(w.first, hit, "right") - 1
            good = hit + len(code) <= w.first[d + 1]
            for h, x in zip((hit - w.first[d])[good].tolist(), d[good].tolist(), strict=True):
                n_base[x] += 1
                labels[x].add(label)
                first[x] = h if first[x] is None else min(first[x], h)
                last[x] = h if last[x] is None else max(last[x], h)
        blocks: list[list] = [[] for _ in range(n)]
        stop = w.first[doc + 1]
        for k, label in enumerate(known.labels):
            for first_at, last_at, share in known.blocks(k, at, which, stop):
                d = int(np.searchsorted(w.first, first_at, "right")) - 1
                low = int(w.first[d])
                blocks[d].append({"label": label, "template": k, "first": first_at - low, "last": last_at - low, "containment": share})
        for x in blocks:
            x.sort(key=lambda m: (m["first"], m["template"]))
        score = [1.0 if n_base[d] else max((m["containment"] for m in blocks[d]), default=0.0) for d in range(n)]
        join = lambda s: ",".join(sorted(s))
        kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(np.diff(w.first)), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                pa.array([join(s) for s in labels], pa.string()),
                pa.array([join(s | {m["label"] for m in b}) for s, b in zip(labels, blocks, strict=True)], pa.string()),
                pa.array(score, pa.float64()), pa.array(blocks, kind),
            ],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
        )

    return rows.mapInArrow(run, RESULT)
