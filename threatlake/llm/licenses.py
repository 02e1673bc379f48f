"""Licence scan by a positional index of rare licence words.

1. Document frequencies of all template words are counted over the whole corpus.
2. A match of a template of m words needs t of them in place, so it holds at least one of any m - t + 1.
   Those of highest IDF are the template's anchors; a file is looked up for anchor words only.
3. An anchor found at a place proposes a start; the positions of the other template words are
   intersected relative to it, and the match stands if enough are in place and every mandatory key
   phrase stands word for word inside.

Base phrases are templates of which every word is needed. Templates are a fixed list; all that reaches the
driver is a count per template word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threatlake.llm.common import arrow_map, plain_words, steps, texts


@dataclass(frozen=True)
class Template:
    """label, words, mandatory phrases, share of words needed in place, and whether it is a base phrase."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    needed: float = 1.0
    base: bool = False


#: Phrases whose places are counted, and their labels.
BASE = (
    Template("cc-by", "cc by", ("cc by",), 1.0, True),
    Template("gpl", "general public license", ("general public license",), 1.0, True),
    Template("reserved", "all rights reserved", ("all rights reserved",), 1.0, True),
)
#: Opening sentences of public licences and notices, as plain words.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",), 0.85),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",), 0.8),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",), 0.8),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",), 0.8),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3"), 0.8),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("general public license", "free software"), 0.8),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "obtaining a copy"), 0.8),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 0.8),
)


@dataclass(frozen=True)
class Match:
    label: str
    start: int
    end: int
    coverage: float
    base: bool


class Index:
    """Anchors: word -> (template number, position of the word in it)."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float]) -> None:
        self.templates = templates
        self.words = [plain_words(t.text) for t in templates]
        self.keys = [[plain_words(k) for k in t.keys] for t in templates]
        self.weights = [[idf.get(w, 1.0) for w in words] for words in self.words]
        self.least = [max(1, math.ceil(t.needed * len(w) - 1e-9)) for t, w in zip(templates, self.words, strict=True)]
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            rarest = sorted(range(len(words)), key=lambda i: (-self.weights[k][i], i))
            for i in rarest[: len(words) - self.least[k] + 1]:
                self.anchors[words[i]].append((k, i))
        self.vocabulary = {w for words in self.words for w in words}

    def scan(self, words: list[bytes]) -> list[Match]:
        anchors = self.anchors
        found = [(i, w) for i, w in enumerate(words) if w in anchors]
        if not found:
            return []
        starts = sorted({(k, i - at) for i, w in found for k, at in anchors[w]})
        wanted = {w for k, _ in starts for w in self.words[k]}
        places: dict[bytes, set[int]] = defaultdict(set)
        for i, w in enumerate(words):
            if w in wanted:
                places[w].add(i)
        out = []
        for k, start in starts:
            template, m = self.words[k], len(self.words[k])
            if start < 0 or start + m > len(words):
                continue
            aligned = [start + j in places[w] for j, w in enumerate(template)]
            if sum(aligned) < self.least[k] or not all(_inside(key, words, start, start + m) for key in self.keys[k]):
                continue
            weights = self.weights[k]
            coverage = sum(x for x, ok in zip(weights, aligned, strict=True) if ok) / sum(weights)
            out.append(Match(self.templates[k].label, start, start + m, coverage, self.templates[k].base))
        return out


def _inside(key: list[bytes], words: list[bytes], start: int, end: int) -> bool:
    return any(words[i : i + len(key)] == key for i in range(start, end - len(key) + 1))


def idf(docs: DataFrame, templates: tuple[Template, ...], id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, float]:
    """Inverse document frequency over all documents of each word of the templates."""
    vocabulary = sorted({w for t in templates for w in plain_words(t.text)})

    def count(batches):
        seen, n = Counter(), 0
        wanted = set(vocabulary)
        for step in steps(batches, 1):
            for text in step.column(1).to_pylist():
                seen.update(wanted.intersection(plain_words(text)))
                n += 1
        words = [*seen, b""]  # no word: the documents
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words]), pa.array([*seen.values(), n], pa.int64())], ["word", "n"])

    parts = texts(docs, id_col, text_col).mapInArrow(count, "word string, n bigint")
    found = {r["word"].encode(): r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per template word
    total = found.get(b"", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1e-3 for w in vocabulary}


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES,
    base: tuple[Template, ...] = BASE,
) -> DataFrame:
    """id, n_words, matches (label, start, end, coverage, base; in words, sorted by start and label); a row per row.

    A null text is an empty one; texts without a match have an empty list; matches may overlap and each
    place counts; repeated rows have equal results; an empty table gives no rows.
    """
    every = (*base, *templates)
    rarity = idf(docs, every, id_col, text_col)
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64()), ("base", pa.bool_())]))
    held: list[Index] = []

    def make(step: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Index(every, rarity))
        lists = [plain_words(t) for t in step.column("text").to_pylist()]
        found = [sorted(held[0].scan(words), key=lambda m: (m.start, m.label)) for words in lists]
        return pa.RecordBatch.from_arrays(
            [step.column("id"), pa.array([len(w) for w in lists], pa.int64()), pa.array([[vars(m) for m in f] for f in found], kind)],
            ["id", "n_words", "matches"],
        )

    rows = texts(docs, id_col, text_col)
    struct = "array<struct<label:string,start:bigint,end:bigint,coverage:double,base:boolean>>"
    return arrow_map(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, matches {struct}")


def summary(found: DataFrame) -> DataFrame:
    """Per row of ``scan``: places of base phrases, their first and last start, labels, best coverage."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda m: m["label"]))), ",")
    return found.select(
        "id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("score"), "matches",
    )
