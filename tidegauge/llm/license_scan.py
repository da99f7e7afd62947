"""License scans: an exact set-similarity join of text blocks with license templates, beside exact phrase counts.

Blocks are lines, and all windows of words that are as long as the template and as many words more as it may lack, so that wrapped notices are found too.
The join keeps every block that holds at least threshold of a template's distinct words. Words are put in one global order, rarest in the whole corpus first.
With o = ceil(threshold * |template|) words needed, a template and a block that meet it share a word among the first |template| - o + 1 of one and
the first |block| - o + 1 of the other (prefix filter); a block of fewer than o template words can't meet it (length filter); and what is left behind the first
shared words bounds the overlap (positional filter). Pairs that pass are counted exactly. A whole text is put to these filters before any of its windows is looked at.

The corpus is counted and searched in Spark; the templates are a parameter and go to every worker, at most max_template_words words in all.

Null and empty texts have no word, no place and no label. Repeated rows are scanned each; very long texts whole. Words that tie in frequency go by themselves; of places that tie the first
counts. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import text_slices

# Phrases whose places are counted, by label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License statements by label; each is matched by containment.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "Copyright, all rights reserved"),
]

# Words are runs of 0-9, a-z (after A-Z are lowered) and bytes from 0x80 on.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD).split()


def word_frequencies(documents: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands, over all documents; at most a count for each word reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(vocabulary.intersection(words_of(raw or b"")))
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = documents.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


class TemplateIndex:
    """Templates in the global word order, indexed by the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float) -> None:
        sets = [(label, set(words_of(text.encode()))) for label, text in templates]
        every = sorted(set().union(*(s for _, s in sets)), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(every)}
        self.labels = [label for label, _ in sets]
        self.members = [frozenset(self.rank[w] for w in s) for _, s in sets]
        self.ordered = [sorted(self.rank[w] for w in s) for _, s in sets]
        # Less a hair, so that 0.8 of 5 words is 4 and not 5.
        self.needed = [max(1, math.ceil(threshold * len(t) - 1e-9)) for t in self.ordered]
        self.widths = [len(words_of(text.encode())) + len(t) - need for (_, text), t, need in zip(templates, self.ordered, self.needed, strict=True)]
        self.prefixes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (order, need) in enumerate(zip(self.ordered, self.needed, strict=True)):
            for j, r in enumerate(order[: len(order) - need + 1]):
                self.prefixes[r].append((t, j))
        self.first_words = frozenset(every[r] for r in self.prefixes)

    def matches(self, block: list[bytes]) -> Iterator[tuple[int, float]]:
        """(template, containment) of every template that the block meets."""
        own = sorted({self.rank[w] for w in block if w in self.rank})
        tried: set[int] = set()
        for i, r in enumerate(own):
            for t, j in self.prefixes.get(r, ()):
                need, size = self.needed[t], len(self.ordered[t])
                if t in tried or len(own) < need or i > len(own) - need:
                    continue
                tried.add(t)
                if min(len(own) - i, size - j) < need:
                    continue
                shared = len(set(own).intersection(self.ordered[t]))
                if shared >= need:
                    yield t, shared / size


    def windows(self, words: list[bytes]) -> Iterator[tuple[int, float, int, int]]:
        """(template, containment, first, last) of the places of words, as short as they can be, whose window meets a template; containment is that of the whole window."""
        for t, _ in list(self.matches(words)):
            members, need, width = self.members[t], self.needed[t], self.widths[t]
            places = [(k, r) for k, w in enumerate(words) if (r := self.rank.get(w)) in members]
            inside: Counter[int] = Counter()
            left = 0
            for right, (k, r) in enumerate(places):
                inside[r] += 1
                while places[left][0] <= k - width:
                    gone = places[left][1]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    left += 1
                if len(inside) < need:
                    continue
                seen: set[int] = set()
                first = right
                while len(seen) < need:
                    seen.add(places[first][1])
                    first -= 1
                # A place whose last word stands in it before, too, is longer than it must be.
                if all(x != r for _, x in places[first + 1 : right]):
                    yield t, len(inside) / len(self.ordered[t]), places[first + 1][0], k


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> tuple[list[int], set[str]]:
    """Starts, in words, of all places of all phrases, and the labels found."""
    line = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in phrases.items():
        find = b" " + phrase.encode() + b" "
        at, counted, place = line.find(find), 0, 0
        while at >= 0:
            place, counted = place + line.count(b" ", counted, at), at
            starts.append(place)
            labels.add(label)
            at = line.find(find, at + 1)
    return starts, labels


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<int>"


def license_scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.9, max_template_words: int = 1_000_000) -> DataFrame:
    """One row per document: phrase places and labels, template labels, the highest containment (a phrase found counts as 1), and the numbers of the lines that matched or hold a place of a window that did."""
    vocabulary = frozenset(w for _, text in templates for w in words_of(text.encode()))
    if len(vocabulary) > max_template_words:
        raise ValueError(f"templates of more than {max_template_words} words are not sent to every worker")
    index = TemplateIndex(templates, word_frequencies(documents, vocabulary), threshold)
    ints = [pa.int64()] * 4

    def row(raw: bytes) -> tuple:
        words = words_of(raw)
        starts, base = phrase_places(words, phrases)
        labels, score, blocks = set(base), float(bool(starts)), set()
        if not index.first_words.isdisjoint(words):
            line_of: list[int] = []
            for b, line in enumerate(raw.split(b"\n")):
                own = words_of(line)
                line_of += [b] * len(own)
                for t, c in index.matches(own):
                    blocks.add(b)
                    labels.add(index.labels[t])
                    score = max(score, c)
            for t, c, first, last in index.windows(words):
                blocks.update(range(line_of[first], line_of[last] + 1))
                labels.add(index.labels[t])
                score = max(score, c)
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(blocks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = [row(raw or b"") for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            kinds = [*ints, pa.string(), pa.string(), pa.float64(), pa.list_(pa.int32())]
            yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
