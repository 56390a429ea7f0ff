"""License scans by a positional index of licence words.

Templates are notices split into lower-case words. The index maps a licence word to its
postings (template, position). Document frequencies over the whole corpus give the words'
IDF, FLOOR at least, so that no word is without weight, however common a notice is. A notice
holds only with one of its key phrases, so the places of these in the file say where it can
begin; there every place of a licence word votes, with the word's IDF, for (template, place
- position): postings of one notice agree on that difference. The difference with the most
weight (places up to SLACK words apart count together) counts if it gathers enough of the
template's weight and has the key phrase around it.

Base phrases are found wherever their words stand consecutively, with or without a notice.

Defined results: null and empty texts have no words, no labels and score 0; each row stands
for itself; other columns are ignored; with an empty table the index is not used.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, functions as F

from lantern.llm.batches import map_rows
from lantern.session import table

# Phrases of the base and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices by label, and phrases of which a notice must hold one.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
        ("permission is hereby granted free of charge",),
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache license version 2 0",),
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "general public license")),
    "gpl-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        ("free software foundation",),
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution",)),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    "reserved": ("Copyright (c). All rights reserved.", ("all rights reserved",)),
    "public-domain": ("This is free and unencumbered software released into the public domain.", ("released into the public domain",)),
}

#: Words of difference within which votes for one notice count together.
SLACK = 3
#: Share of a template's weight that a candidate must gather.
SHARE = 0.6
#: Weight that the most common words have.
FLOOR = 1.0
#: Differences whose votes are held at once.
RUN = 4096
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def notices() -> dict[str, tuple[list[bytes], list[list[bytes]]]]:
    return {label: (words(text), [words(k) for k in keys]) for label, (text, keys) in TEMPLATES.items()}


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase stands in the space-joined, space-framed words."""
    out, at, seen, n = [], joined.find(phrase), 0, 0
    while at >= 0:
        n += joined.count(b" ", seen, at)
        seen = at
        out.append(n)
        at = joined.find(phrase, at + 1)
    return out


def frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Rows of docs, and rows with each licence word. The driver gets a row per licence
    word at most: the templates bound them."""
    vocabulary = frozenset(chain.from_iterable(w for w, _ in notices().values()))
    def count(b):
        n: Counter[bytes] = Counter()
        for t in b["text"]:
            n.update(vocabulary.intersection(words(t)))
        return [("", len(b["text"])), *((w.decode(), c) for w, c in n.items())]
    got = {r["word"]: r["n"] for r in map_rows(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop("", 0), {w.encode(): n for w, n in got.items()}


class Index:
    """Postings by template, weights of licence words, and each template's whole weight."""

    def __init__(self, n_docs: int, df: dict[bytes, int]):
        self.notices = notices()
        self.idf = {w: max(FLOOR, math.log((n_docs + 1) / (df.get(w, 0) + 0.5))) for w in set(chain.from_iterable(w for w, _ in self.notices.values()))}
        self.postings: dict[str, dict[bytes, list[int]]] = {label: defaultdict(list) for label in self.notices}
        for label, (ws, _) in self.notices.items():
            for i, w in enumerate(ws):
                self.postings[label][w].append(i)
        self.weight = {label: sum(self.idf[w] for w in ws) for label, (ws, _) in self.notices.items()}

    def match(self, ws: list[bytes], joined: bytes) -> dict[str, float]:
        """Labels of the notices in a file, with the share of their weight found there."""
        out: dict[str, float] = {}
        for label, (tws, keys) in self.notices.items():
            share = max((self.share(ws, label, a, b) for a, b in runs(joined, len(tws), keys)), default=0.0)
            if share >= SHARE:
                out[label] = min(1.0, share)
        return out

    def share(self, ws: list[bytes], label: str, first: int, last: int) -> float:
        """The largest share of a template's weight at a difference from first to last."""
        postings, n = self.postings[label], len(self.notices[label][0])
        votes: dict[int, dict[int, float]] = defaultdict(dict)
        begin = max(0, first - SLACK)
        for at, w in enumerate(ws[begin : max(0, last + n + SLACK)], begin):
            for i in postings.get(w, ()):
                # One vote for each template position and place of the notice.
                for d in range(max(first, at - i - SLACK), min(last, at - i + SLACK) + 1):
                    votes[d][i] = self.idf[w]
        return max((sum(got.values()) for got in votes.values()), default=0.0) / self.weight[label]


def runs(joined: bytes, n: int, keys: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """First and last differences, in runs of up to RUN, at which a notice of n words has one
    of its key phrases within SLACK words around it."""
    near = sorted((p + len(k) - n - SLACK, p + SLACK) for k in keys for p in places(joined, b" %s " % b" ".join(k)))
    done = -(1 << 62)
    for first, last in near:
        for a in range(max(first, done + 1), last + 1, RUN):
            yield a, min(last, a + RUN - 1)
        done = max(done, last)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base array<struct<label, place>>, notices map<label, share>."""
    n, df = frequencies(docs)
    def rows(b):
        index = Index(n, df)
        for i, t in zip(b["doc_id"], b["text"]):
            ws = words(t)
            joined = b" %s " % b" ".join(ws)
            base = [(p, label) for phrase, label in BASE.items() for p in places(joined, b" %s " % phrase.encode())]
            yield i, len(ws), [{"label": x, "place": p} for p, x in sorted(base)], list(index.match(ws, joined).items())
    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, n_words long, base array<struct<label: string, place: long>>, notices map<string, double>")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("base.label")
    joined = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(x)))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.place").alias("first_word"), F.array_max("base.place").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.map_keys("notices"))).alias("labels"),
        # A base phrase without its notice is half a find.
        F.greatest(F.coalesce(F.array_max(F.map_values("notices")), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
