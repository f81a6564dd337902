"""Licence scan with a positional rare-token index.

The index holds, for each licence template, its words of highest inverse document frequency in
the scanned corpus and their positions. A file's occurrences of such words look up postings
``(template, position)``; those that agree on file position minus template position (within
``SLACK`` words) align a template. An alignment with enough of the template's rare words is
verified: a mandatory key phrase must stand inside it, and the share of template words in place
is its score."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import WORD
from .frames import map_text, pick, text_slices
from .words import ALNUM, Words, span_hash

# --- fixed values: phrases and templates ----------------------------------------------------
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction", ["permission is hereby granted"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
                 "with the License.", ["apache license version"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ["apache license version"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation", ["gnu general public license"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
     ["creative commons attribution noncommercial"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
     ["creative commons attribution 4", "creative commons attribution international"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["released into the public domain"]),
]
# --------------------------------------------------------------------------------------------

RARE, SLACK, LEAST_VOTES, LEAST_SCORE = 6, 2, 0.5, 0.6


def _words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


@dataclass
class Vocabulary:
    """Distinct words of templates and phrases: sorted hashes; ``id`` is the place."""

    words: list[bytes]
    hashes: np.ndarray

    def ids(self, text: str) -> list[int]:
        return [self.words.index(w) for w in _words(text)]

    def coded(self, words: Words) -> np.ndarray:
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def vocabulary(templates=TEMPLATES, base=BASE) -> Vocabulary:
    words = sorted({w for _, text, keys in templates for part in [text, *keys] for w in _words(part)} | {w for p, _ in base for w in _words(p)})
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    h = span_hash(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)
    order = np.argsort(h)
    return Vocabulary([words[i] for i in order], h[order])


def frequencies(docs: DataFrame, text: str, vocab: Vocabulary) -> tuple[list[int], int]:
    """Documents that hold each word of the vocabulary, and documents, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0):
                words = Words(part.column(0), ALNUM, lower=True)
                code = vocab.coded(words)
                pairs = np.unique(words.doc[code >= 0] * len(vocab.words) + code[code >= 0])
                n = np.append(np.bincount(pairs % len(vocab.words), minlength=len(vocab.words)), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    rows = pick(docs, text=text).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return [found.get(i, 0) for i in range(len(vocab.words))], found.get(len(vocab.words), 0)


def phrase_starts(code: np.ndarray, doc: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Word indexes at which the phrase's words stand consecutively in one text."""
    n = len(code) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = doc[:n] == doc[len(phrase) - 1:]
    for j, w in enumerate(phrase):
        hit &= code[j:n + j] == w
    return np.flatnonzero(hit)


class Index:
    """Postings of the rare words of all templates."""

    def __init__(self, vocab: Vocabulary, df: list[int], docs: int, templates, rare: int):
        idf = [math.log((docs + 1) / (n + 0.5)) for n in df]
        self.labels = [label for label, _, _ in templates]
        self.texts = [np.array(vocab.ids(text)) for _, text, _ in templates]
        self.keys = [[vocab.ids(k) for k in keys] for _, _, keys in templates]
        self.needed, self.postings = [], {}
        for t, words in enumerate(self.texts):
            top = sorted(set(words.tolist()), key=lambda w: (-idf[w], vocab.words[w]))[:rare]
            self.needed.append(max(1, math.ceil(LEAST_VOTES * len(top))))
            for w in top:
                self.postings.setdefault(w, []).extend((t, int(p)) for p in np.flatnonzero(words == w))
        self.rare = np.zeros(len(vocab.words) + 1, bool)
        self.rare[list(self.postings)] = True

    def alignments(self, code: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """``(template, place of its first word)`` backed by enough rare words; ``at``: word
        indexes of one text's rare words."""
        votes: dict[int, dict[int, set[int]]] = {}
        for i in at.tolist():
            for t, p in self.postings[int(code[i])]:
                votes.setdefault(t, {}).setdefault(i - p, set()).add(int(code[i]))
        out = []
        for t, places in votes.items():
            for d in places:
                near = set().union(*[places[e] for e in range(d - SLACK, d + SLACK + 1) if e in places])
                if len(near) >= self.needed[t]:
                    out.append((t, d))
        return out

    def score(self, t: int, d: int, code: np.ndarray, lo: int, hi: int) -> float:
        """Share of the template's words within ``SLACK`` of their place in ``code[lo:hi]``."""
        place = d + np.arange(len(self.texts[t]))
        there = np.zeros(len(place), bool)
        for s in range(-SLACK, SLACK + 1):
            q = place + s
            fits = (q >= lo) & (q < hi)
            there[fits] |= code[q[fits]] == self.texts[t][fits]
        return float(there.mean())


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("base_starts", T.ArrayType(T.LongType())),
          T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("found_labels", T.ArrayType(T.StringType())),
          T.StructField("score", T.DoubleType())]


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates=TEMPLATES, base=BASE, rare: int = RARE) -> DataFrame:
    """The ``keep`` columns and, for each row, ``n_words``, ``base_starts`` (ascending places of
    base phrases; two phrases may start at one word), ``base_labels`` and ``found_labels``
    (distinct, sorted; by phrase, by template) and ``score``: 1 with a base phrase, else that of
    the best verified alignment, else 0. Null texts are empty; repeated rows are scanned alike."""
    vocab = vocabulary(templates, base)
    df, n_docs = frequencies(docs, text, vocab)
    index = Index(vocab, df, n_docs, templates, rare)
    phrases = [(vocab.ids(p), label) for p, label in base]

    def start():
        def make(column: pa.Array) -> list:
            words = Words(column, ALNUM, lower=True)
            code, n = vocab.coded(words), len(words.counts)
            starts: list[list[int]] = [[] for _ in range(n)]
            labels: list[set[str]] = [set() for _ in range(n)]
            found: list[set[str]] = [set() for _ in range(n)]
            score = np.zeros(n)
            for phrase, label in phrases:
                for i in phrase_starts(code, words.doc, phrase).tolist():
                    d = int(words.doc[i])
                    starts[d].append(i - int(words.first[d]))
                    labels[d].add(label)
                    score[d] = 1.0
            at = np.flatnonzero(index.rare[code])
            keys = [np.concatenate([phrase_starts(code, words.doc, k) for k in own]) if own else None for own in index.keys]
            for part in np.split(at, np.flatnonzero(np.diff(words.doc[at])) + 1) if len(at) else []:
                d = int(words.doc[part[0]])
                lo, hi = int(words.first[d]), int(words.first[d + 1])
                for t, place in index.alignments(code, part):
                    end = place + len(index.texts[t]) + SLACK
                    if keys[t] is None or ((keys[t] >= max(lo, place - SLACK)) & (keys[t] < min(hi, end))).any():
                        s = index.score(t, place, code, lo, hi)
                        if s >= LEAST_SCORE:
                            found[d].add(index.labels[t])
                            score[d] = max(score[d], s)
            return [words.counts, [sorted(s) for s in starts], [sorted(s) for s in labels], [sorted(s) for s in found], score]

        return make

    return map_text(docs, text, keep, FIELDS, start)
