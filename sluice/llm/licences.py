"""Licence scans with a positional rare-token index.

Every template (a phrase or a notice) is posted under its ``RARE`` words of
highest inverse document frequency, measured over all documents, each posting
with its position in the template. A file's words are looked up in the index;
a word at position p posted at position r votes for the template's start at
p - r. Starts on which at least two postings agree (one, for a template with a
single rare word) are candidates; there the mandatory key phrases are
verified, and the share of template words in their places is the score.

``exact`` templates are phrases that must stand as they are: every place is
found, since each holds all the phrase's rare words. Others may differ in
some words (``least``), with their key phrases near where the template has
them (``slack``).

The document frequencies of the templates' words, some hundred numbers, are
all that reaches the driver; the index goes to the tasks in their closure.
Texts are scanned whole, without a shuffle.

Edge cases: a null or empty text has no words, no labels and score 0; repeated
rows are judged alike; ties between rare words go to the smaller word, so the
index is the same for the same corpus; a word that no document has is as rare
as can be; only the named columns are read; an empty table gives no rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh, without

RARE = 3
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...] = ()
    exact: bool = False
    least: float = 0.6
    slack: int = 8


#: Phrases of the base labels: they must stand consecutively.
BASE = (Template("mit", "under the mit license", exact=True), Template("apache-2", "apache license version 2", exact=True), Template("cc-by-nc", "cc by nc", exact=True))
#: Notices in common use, as their licences give them.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Index:
    """Postings of rare words: word -> [(template, position)], and what verification needs."""

    def __init__(self, templates: Sequence[Template], idf: Mapping[bytes, float]):
        self.templates = list(templates)
        self.words = [words_of(t.text.encode()) for t in templates]
        self.phrases = [[words_of(p.encode()) for p in t.phrases] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed = []
        for i, words in enumerate(self.words):
            best = sorted(range(len(words)), key=lambda j: (-idf.get(words[j], math.inf), words[j], j))[:RARE]
            self.needed.append(len(best) if self.templates[i].exact else min(2, len(best)))
            for j in best:
                self.postings.setdefault(words[j], []).append((i, j))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, score) for every place that passes."""
        votes: dict[tuple[int, int], int] = {}
        postings = self.postings
        for p, w in enumerate(words):
            if w in postings:
                for t, r in postings[w]:
                    votes[t, p - r] = votes.get((t, p - r), 0) + 1
        out = []
        for (t, s), n in votes.items():
            if n < self.needed[t]:
                continue
            mine, tpl = self.words[t], self.templates[t]
            if tpl.exact:
                if s >= 0 and words[s:s + len(mine)] == mine:
                    out.append((t, s, 1.0))
                continue
            same = sum(0 <= s + j < len(words) and words[s + j] == w for j, w in enumerate(mine)) / len(mine)
            near = words[max(0, s - tpl.slack): max(0, s + len(mine) + tpl.slack)]
            if same >= tpl.least and all(_holds(near, p) for p in self.phrases[t]):
                out.append((t, s, same))
        return out


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i:i + len(phrase)] == phrase for i, w in enumerate(words) if w == phrase[0])


def word_idf(docs: DataFrame, vocabulary: Sequence[bytes], text: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of the vocabulary's words over all documents."""
    vocab = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, dict.fromkeys(vocab, 0)
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                for w in vocab.intersection(words_of((t or "").encode())):
                    found[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *found], pa.binary()), pa.array([n, *found.values()], pa.int64())], names=["word", "n"])

    got = {bytes(r["word"]): r["n"] for r in docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = got.get(b"", 0)
    return {w: math.log((total + 1) / (got.get(w, 0) + 1)) for w in vocab}


def scan_licences(docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES, text: str = "text") -> DataFrame:
    """All columns, and n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels are those of the phrases in ``base``; labels adds those of the
    notices. Places count every start of a base phrase, words from 0. A column
    named like an added one is replaced."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = without(docs, names, keep=[text])
    templates = [*base, *notices]
    index = Index(templates, word_idf(docs, sorted({w for t in templates for w in words_of(t.text.encode())}), text))
    (copy,) = fresh(docs, "text")
    n_cols, n_base = len(docs.columns), len(base)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def one(t: str | None) -> tuple:
        words = words_of((t or "").encode())
        found = index.scan(words)
        starts = [s for i, s, _ in found if i < n_base]
        label = lambda keep: ",".join(sorted({templates[i].label for i, _, _ in found if keep(i)}))
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), label(lambda i: i < n_base), label(lambda i: True), max((x for *_, x in found), default=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(t) for t in b.column(n_cols).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([*b.columns[:n_cols], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*b.schema.names[:n_cols], *names])

    null = F.lit(None)
    schema = docs.select("*", *[null.cast("long").alias(n) for n in names[:4]], *[null.cast("string").alias(n) for n in names[4:6]], null.cast("double").alias("score")).schema
    return docs.withColumn(copy, F.col(text)).mapInArrow(run, schema)
