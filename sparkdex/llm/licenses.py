"""License scans: base phrases, and an exact containment join of text blocks with license templates."""

from __future__ import annotations

from collections import defaultdict
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, ascii_words, documents, texts_of

#: The base phrases and their labels.
BASE = (
    (b"gnu general public license", "gpl"),
    (b"apache license", "apache"),
    (b"cc by", "cc-by"),
    (b"mit license", "mit"),
)

#: Notices of public licenses, the label that each stands for, and the words that tell it from others.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "permission granted charge software"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2.0 you may not use this file except in compliance with the license", "apache license"),
    ("apache", "licensed under the apache license version 2.0", "apache license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution source binary permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4.0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4.0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4.0", "cc by nd"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "dedicated public domain"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, blocks array<struct<label:string,start:long,words:long,containment:double>>"
)
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("blocks", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))),
    ]
)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """All places (first word, label) where a base phrase's words stand consecutively."""
    found = []
    for phrase, label in BASE:
        parts = phrase.split()
        i = -1
        try:
            while True:
                i = words.index(parts[0], i + 1)
                if words[i : i + len(parts)] == parts:
                    found.append((i, label))
        except ValueError:
            pass
    return found


def block_size(n: int) -> tuple[int, int]:
    """Words of the blocks that a template of n words is held against, and the words between their starts. A run of n
    words lies in a block as a whole, and no block is much longer, so words that are far apart don't add up."""
    step = -(-n // 4)
    return n + 2 * step, step


class TemplateIndex:
    """Prefix index of the templates of one block size, under one global order of tokens, rarest first."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        vocabulary = sorted({w for _, t, _ in templates for w in ascii_words(t.encode())}, key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: k for k, w in enumerate(vocabulary)}
        self.templates, self.prefix = [], defaultdict(list)
        for label, text, must in templates:
            tokens = sorted(set(ascii_words(text.encode())), key=self.order.__getitem__)
            need = ceil(threshold * len(tokens) - 1e-9)
            for j in range(len(tokens) - need + 1):
                self.prefix[tokens[j]].append((len(self.templates), j))
            self.templates.append((label, tokens, need, frozenset(ascii_words(must.encode()))))
        self.rare = frozenset(self.prefix)

    def join(self, block: frozenset[bytes]):
        """(label, containment) of every template whose tokens the block holds to the threshold, with all that tell it
        from others."""
        known = sorted(block & self.order.keys(), key=self.order.__getitem__)
        shared: dict[int, int] = defaultdict(int)
        for i, w in enumerate(known):
            for t, j in self.prefix.get(w, ()):
                _, tokens, need, _ = self.templates[t]
                if len(known) < need or shared[t] < 0:  # length filter, or given up
                    continue
                # positional filter: tokens of the rest of both lists can match at most
                if shared[t] + 1 + min(len(known) - i, len(tokens) - j) - 1 < need:
                    shared[t] = -1
                else:
                    shared[t] += 1
        for t, n in shared.items():
            label, tokens, need, must = self.templates[t]
            if n > 0 and must <= block and (overlap := sum(w in block for w in tokens)) >= need:
                yield label, overlap / len(tokens)


class Indexes:
    """The templates by block size."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        by: dict[tuple[int, int], list] = defaultdict(list)
        for t in templates:
            by[block_size(len(ascii_words(t[1].encode())))].append(t)
        self.sizes = [(size, step, TemplateIndex(ts, frequency, threshold)) for (size, step), ts in sorted(by.items())]
        self.rare = frozenset().union(*(i.rare for _, _, i in self.sizes))

    def matches(self, words: list[bytes]):
        """(label, first word, words, containment) of every block that meets a template. Only blocks with a prefix
        token are looked at."""
        places = [(i, w) for i, w in enumerate(words) if w in self.rare]
        for size, step, index in self.sizes:
            last = None
            for i, w in places:
                if w not in index.rare:
                    continue
                low = max(0, -(-(i - size + 1) // step))
                for k in range(low if last is None else max(low, last + 1), i // step + 1):
                    last = k
                    block = words[k * step : k * step + size]
                    for label, c in index.join(frozenset(block)):
                        yield label, k * step, len(block), c


def token_frequencies(docs: DataFrame, templates) -> dict[bytes, int]:
    """Over all documents, how many hold each word of the templates: one row per template word comes back."""
    vocabulary = frozenset(w for _, t, _ in templates for w in ascii_words(t.encode()))

    def count(batches):
        seen: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in texts_of(batch):
                for w in vocabulary.intersection(ascii_words(text)):
                    seen[w] += 1
        yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Base phrases and matching license templates of every document.

    A document's blocks are runs of words a little longer than a template, at even distances (``block_size``). A
    block matches a template if it holds at least ``threshold`` of the template's distinct words and all words that
    tell it from others: prefix, length and positional filters under the corpus-wide order of word frequencies
    choose candidates, and a full count decides. Columns: doc_id, n_words, n_base, first_word,
    last_word (null without base places), base_labels, labels (base and template labels; both distinct,
    sorted, comma-joined), score (1 with a base place, else the largest containment of a match, else 0),
    blocks (every match: label, first word, words, containment). Null and empty texts: no words, empty labels, score 0. Each row of ``docs``,
    repeated or not, gives a row; other columns are ignored.
    """
    texts = documents(docs)
    frequency = token_frequencies(texts, templates)

    def scan(batches):
        index = Indexes(templates, frequency, threshold)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                words = text.translate(WORD_BYTES).split() if text else []
                base = phrase_places(words)
                blocks = []
                if not index.rare.isdisjoint(words):
                    blocks = [{"label": x, "start": i, "words": n, "containment": c} for x, i, n, c in index.matches(words)]
                places = [i for i, _ in base]
                base_labels = {x for _, x in base}
                out.append(
                    {
                        "doc_id": doc,
                        "n_words": len(words),
                        "n_base": len(base),
                        "first_word": min(places, default=None),
                        "last_word": max(places, default=None),
                        "base_labels": ",".join(sorted(base_labels)),
                        "labels": ",".join(sorted(base_labels | {b["label"] for b in blocks})),
                        "score": 1.0 if base else max((b["containment"] for b in blocks), default=0.0),
                        "blocks": blocks,
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return texts.mapInArrow(scan, SCHEMA)
