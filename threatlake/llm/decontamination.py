"""Benchmark decontamination: an FM-index per training shard is searched for every benchmark window.

Tasks index their share of the corpus shard by shard (about a quarter of a million words each) and search the test
phrases in it: backward search through wavelet ranks, occurrences by sampled suffix positions, spans
merged per document. The corpus is read once and never shuffled. The test set is a query set: it goes to
the tasks in blocks of bounded size, one pass over the corpus per block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from threatlake.llm.common import PLAIN, plain_words, steps, texts
from threatlake.llm.fm_index import FMIndex
from threatlake.session import Scratch

WINDOW = 10
#: Words indexed together, and bytes of benchmark text per block.
SHARD_WORDS, BLOCK_BYTES = 1 << 18, 1 << 20


@dataclass
class Windows:
    """Distinct windows of a block of items as word numbers, right-aligned, and the items each is from."""

    words: list[bytes]
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[tuple[str, ...]]

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], width: int) -> Windows:
        number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [number.setdefault(w, len(number)) for w in words]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + width]), set()).add(item)
        lengths = np.array([len(w) for w in owners], np.int64)
        patterns = np.full((len(owners), width), -1, np.int64)
        for row, window in zip(patterns, owners, strict=True):
            row[width - len(window) :] = window
        return cls(list(number), patterns, lengths, [tuple(sorted(v)) for v in owners.values()])


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _shards(documents: Iterator[list[bytes]], overlap: int, size: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Lists of (document, first word, words) of at most ``size`` words, terminators included; a longer
    document comes in segments that share ``overlap`` words."""
    shard, held = [], 0
    for d, words in enumerate(documents):
        at = 0
        while at < len(words):
            part = words[at : at + size - 1] if at or len(words) >= size else words
            if held and held + len(part) + 1 > size:
                yield shard
                shard, held = [], 0
            shard.append((d, at, part))
            held += len(part) + 1
            if at + len(part) == len(words):
                break
            at += len(part) - overlap
    if shard:
        yield shard


def search(documents: list[str | None], windows: Windows, size: int = SHARD_WORDS) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: its words, the merged spans [start, end) of words inside occurrences, the items hit."""
    n_words, spans, items = [0] * len(documents), [[] for _ in documents], [[] for _ in documents]

    def counted() -> Iterator[list[bytes]]:
        for d, text in enumerate(documents):
            words = plain_words(text)
            n_words[d] = len(words)
            yield words

    width = windows.patterns.shape[1]
    for shard in _shards(counted(), width - 1, size):
        if not len(windows.lengths):
            continue
        ids = _Ids()
        number = ids.__getitem__
        ends = np.cumsum([len(w) + 1 for _, _, w in shard])
        starts = np.r_[0, ends[:-1]]
        s = np.zeros(ends[-1], np.int64)
        for start, (_, _, words) in zip(starts.tolist(), shard, strict=True):
            s[start : start + len(words)] = np.fromiter(map(number, words), np.int64, len(words))
        index = FMIndex(s, np.arange(len(s)) - np.repeat(starts, ends - starts))
        local = np.array([ids.get(w, 0) for w in windows.words] + [0], np.int64)  # the last for the -1 of short windows
        lo, hi = index.find(local[windows.patterns], windows.lengths)
        found = np.flatnonzero(lo < hi)
        if not len(found):
            continue
        counts = hi[found] - lo[found]
        window = np.repeat(found, counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[found], counts)
        places = index.locate(rows)
        part = np.searchsorted(ends, places, "right")
        for w, p, k in zip(window.tolist(), places.tolist(), part.tolist(), strict=True):
            d, first, _ = shard[k]
            start = first + p - int(starts[k])
            spans[d].append((start, start + int(windows.lengths[w])))
            items[d].append(w)
    return [
        (n, _merged(found), sorted({i for w in set(hit) for i in windows.items[w]}))
        for n, found, hit in zip(n_words, spans, items, strict=True)
    ]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(PLAIN))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at : words[start][0]])
        at = words[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Windows]:
    """The windows of the benchmark's items, a bounded number of items at a time; at least one block."""
    held: list[tuple[str, list[bytes]]] = []
    size, first = 0, True
    for row in texts(benchmark, id_col, text_col).where("text IS NOT NULL").toLocalIterator():
        if held and size + len(row["text"]) > block_bytes:
            yield Windows.of(held, width)
            held, size, first = [], 0, False
        held.append(("" if row["id"] is None else str(row["id"]), plain_words(row["text"])))
        size += len(row["text"])
    if held or first:
        yield Windows.of(held, width)


_FOUND = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def _hits(rows: DataFrame, windows: Windows, only_hit: bool) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for step in steps(batches, 1):
            found = search(step.column(1).to_pylist(), windows)
            rows = [i for i, f in enumerate(found) if f[1] or not only_hit]
            found = [found[i] for i in rows]
            spans = pa.array([[{"start": a, "end": b} for a, b in f[1]] for f in found], span)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [step.column(0).take(take), step.column(2).take(take), pa.array([f[0] for f in found], pa.int64()), spans,
                 pa.array([f[2] for f in found], pa.list_(pa.string()))],
                ["id", "th", "n_words", "spans", "items"],
            )

    return rows.mapInArrow(run, f"id {kind}, th bigint, {_FOUND}")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
) -> DataFrame:
    """id, n_words, n_hit, spans (merged, in words), items (ids as strings, sorted, distinct); a row per row.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one
    window. A null or empty text has no words and no hits; a null item text is no item; a null item id
    is the empty string; equal ids are one item. Empty tables give no rows or no hits.
    """
    rows = texts(docs, id_col, text_col, F.xxhash64(docs[text_col]).alias("th"))
    with Scratch(docs.sparkSession) as work:
        windows = blocks(benchmark, item_col, item_text_col, width)
        found = _hits(rows, next(windows), False)
        more = [work.keep(_hits(rows, w, True), "hits") for w in windows]
    if more:
        every = more[0]
        for table in more[1:]:
            every = every.union(table)
        every = every.distinct().groupBy(F.col("id").alias("id2"), F.col("th").alias("th2")).agg(
            F.flatten(F.collect_list("spans")).alias("spans2"), F.flatten(F.collect_list("items")).alias("items2")
        )
        same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))
        # spans of several blocks may overlap: merged in order, by folding
        spans = F.array_sort(F.concat("spans", F.coalesce("spans2", F.array().cast("array<struct<start:int,end:int>>"))))
        empty = F.array().cast("array<struct<start:int,end:int>>")
        last = lambda a: F.element_at(a, -1)
        merged = F.aggregate(spans, empty, lambda a, x: F.when(
            (F.size(a) > 0) & (x["start"] <= F.get(a, F.size(a) - 1)["end"]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(
                last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(x))))
        items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("items2", F.array().cast("array<string>")))))
        found = found.join(every, same, "left").select("id", "n_words", merged.alias("spans"), items.alias("items"))
    n_hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("bigint")
    return found.select("id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
) -> DataFrame:
    """``docs`` with the spans that benchmark windows cover cut from the texts; rows and columns stay.

    Rows pass through the tasks as they are, so nothing is shuffled. A text without a hit is unchanged.
    Every block is searched in the text as it was given: the spans found so far travel in a last column,
    and the last block cuts.
    """
    at, schema, out = docs.columns.index(text_col), docs.schema, docs
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    name = "__spans" + "_" * max((len(c) for c in docs.columns), default=0)
    carried = T.StructType([*schema.fields, T.StructField(name, T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))])

    def run(batches, windows, first, last):
        for step in steps(batches, at):
            documents = step.column(at).to_pylist()
            spans = [f[1] for f in search(documents, windows)]
            if not first:
                earlier = step.column(step.num_columns - 1).to_pylist()
                spans = [_merged([*((x["start"], x["end"]) for x in a), *b]) for a, b in zip(earlier, spans, strict=True)]
                step = step.select(range(step.num_columns - 1))
            if not last:
                column = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], span)
                step = pa.RecordBatch.from_arrays([*step.columns, column], [*step.schema.names, name])
            elif any(spans):
                cut = [without_spans(t, x) if x else t for t, x in zip(documents, spans, strict=True)]
                step = step.set_column(at, step.schema.field(at), pa.array(cut, step.schema.field(at).type))
            yield step

    every = blocks(benchmark, item_col, item_text_col, width)
    windows, first = next(every), True
    while windows is not None:
        more = next(every, None)
        task = partial(run, windows=windows, first=first, last=more is None)
        out = out.mapInArrow(task, schema if more is None else carried)
        windows, first = more, False
    return out
