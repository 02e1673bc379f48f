"""Periodic runs of words: maximal pairs from a bottom-up LCP-interval tree.

A run is a stretch of at least six words that repeats its smallest period four times or more and can't be
extended. Tasks take their documents in steps of a few megabytes. The suffixes of a step are sorted by prefix
doubling (every document has symbols of its own, so none meets another's), neighbours' common prefixes give the
LCP-interval tree, and it is walked from the deepest interval up. An interval of depth l keeps the places of its
suffixes in order, all together and by the word to their left. Two places of different children differ in the
word after l words; if the words to their left differ too, they are a maximal pair, and one of distance q makes
the stretch of q + l words from the first place a run of period q when l >= 3q. No step extends a run.

Places of one interval within l / 3 of each other are a progression whose members, but for the first, share
their left word. So one look-up in the list of a place's own left word and one in that of all find its only
partner to the left, and those to the right are all partners or none: work grows with the pairs reported, and
lists merge small into large.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threatlake.llm.common import arrow_map, texts

#: A run holds its period this many times, and has this many words.
POWER, LEAST_WORDS = 4, 6
#: Least common prefix of a pair: its length without one period.
_LEAST_LCP = LEAST_WORDS - 1


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, and per k the rank of each by its first 2^k symbols (equal symbols: equal ranks).

    No two suffixes may be equal up to the end: the last symbol of each document is one of its own.
    """
    n = len(symbols)
    order = np.argsort(symbols)
    ordered = symbols[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, h = [rank.astype(np.int32)], 1
    tied = ~head
    tied[:-1] |= ~head[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        both = rank[at] << 32 | rank[at + h]
        turn = np.argsort(both)
        at, both = at[turn], both[turn]
        order[slots] = at
        head = np.ones(len(slots), bool)
        head[1:] = both[1:] != both[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        levels.append(rank.astype(np.int32))
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots, h = slots[tied], 2 * h
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Per place in ``order`` the common prefix with the suffix before it; 0 where it is below four symbols."""
    lcp = np.zeros(len(order), np.int64)
    if len(levels) < 3:
        return lcp
    four = levels[2][order]
    slots = np.flatnonzero(four[1:] == four[:-1]) + 1
    a, b, length = order[slots - 1], order[slots], np.zeros(len(slots), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a + length] == levels[k][b + length]
        length[same] += 1 << k
    lcp[slots] = length
    return lcp


def _promising(order: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches [s, e) of ``order`` under one interval of depth 5 that have two places near enough for a run:
    the least distance of two places is at most a third of the greatest depth."""
    inside = np.flatnonzero(lcp >= _LEAST_LCP)
    if not len(inside):
        return
    cut = np.r_[True, np.diff(inside) > 1]
    starts, ends = inside[cut] - 1, inside[np.r_[cut[1:], True]] + 1
    sizes = ends - starts
    group = np.repeat(np.arange(len(starts)), sizes)
    slots = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[group]
    placed = np.sort(group << 32 | order[slots])
    gaps = np.diff(placed, prepend=placed[0] - (1 << 40))
    gaps[np.cumsum(sizes) - sizes] = 1 << 40
    nearest = np.minimum.reduceat(gaps, np.cumsum(sizes) - sizes)
    deep = lcp[slots]
    deep[np.cumsum(sizes) - sizes] = 0
    deepest = np.maximum.reduceat(deep, np.cumsum(sizes) - sizes)
    for g in np.flatnonzero(nearest * (POWER - 1) <= deepest):
        yield int(starts[g]), int(ends[g])


class _Interval:
    """The places below an interval: all in order, and in order by left word."""

    __slots__ = ("places", "by_left")

    def __init__(self, place: int, left: int) -> None:
        self.places, self.by_left = [place], {left: [place]}

    def add(self, place: int, left: int) -> None:
        insort(self.places, place)
        mine = self.by_left.get(left)
        if mine is None:
            self.by_left[left] = [place]
        else:
            insort(mine, place)


def _join(a: _Interval, b: _Interval, depth: int, left: list[int], found: list[tuple[int, int, int]]) -> _Interval:
    """Both as children of one interval; the maximal pairs between them are added to ``found`` as start, length, period."""
    if len(a.places) < len(b.places):
        a, b = b, a
    places, reach = a.places, depth // (POWER - 1)
    for p in b.places:
        i, mine = bisect_left(places, p), left[p]
        if i and p - places[i - 1] <= reach:
            same, k = a.by_left.get(mine), i
            if same is not None:
                at = bisect_left(same, p - reach)
                if at < len(same) and same[at] < p:
                    k = bisect_left(places, same[at])
            if k and p - places[k - 1] <= reach:
                found.append((places[k - 1], p - places[k - 1] + depth, p - places[k - 1]))
        if i < len(places) and places[i] - p <= reach and left[places[i]] != mine:
            while i < len(places) and places[i] - p <= reach:
                found.append((p, places[i] - p + depth, places[i] - p))
                i += 1
    for p in b.places:
        a.add(p, left[p])
    return a


def _walk(places: list[int], lcp: list[int], left: list[int], found: list[tuple[int, int, int]]) -> None:
    """The interval tree over suffixes ``places`` in order, ``lcp[j]`` between j - 1 and j, from the deepest up."""
    stack: list[tuple[int, _Interval]] = []
    current = _Interval(places[0], left[places[0]])
    for j in range(1, len(places)):
        depth = lcp[j]
        while stack and stack[-1][0] > depth:
            below, node = stack.pop()
            current = _join(node, current, below, left, found)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, _join(stack[-1][1], current, depth, left, found))
        else:
            stack.append((depth, current))
        current = _Interval(places[j], left[places[j]])
    while stack:
        below, node = stack.pop()
        current = _join(node, current, below, left, found)


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per document (its words) the runs as (start, length, period), by start, then period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    result: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not sizes.sum():
        return result
    words = [w for d in documents for w in d]
    codes = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    del words
    doc = np.repeat(np.arange(len(documents)), sizes)
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.arange(len(documents)).repeat(sizes + 1) << 32 | 0xFFFFFFFF  # an end of its own per document
    symbols[np.arange(len(codes)) + doc] = doc << 32 | codes
    order, levels = suffixes(symbols)
    lcp = common_prefixes(order, levels)
    del levels
    pairs: list[tuple[int, int, int]] = []
    near = list(_promising(order, lcp))
    if near:
        left = np.r_[-1, symbols[:-1]].tolist()
        for s, e in near:
            _walk(order[s:e].tolist(), lcp[s:e].tolist(), left, pairs)
    smallest: dict[tuple[int, int], int] = {}
    for start, length, period in pairs:  # multiples of the period give the same stretch
        known = smallest.get((start, length))
        if known is None or period < known:
            smallest[start, length] = period
    if smallest:
        starts = np.array([s for s, _ in smallest], np.int64)
        for (start, length), period, d in zip(smallest, smallest.values(), np.searchsorted(begins, starts, "right") - 1, strict=True):
            result[d].append((int(start - begins[d]), int(length), int(period)))
        for r in result:
            r.sort(key=lambda x: (x[0], x[2]))
    return result


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (array of start, length, period in words from 0, by start, then period), text: the words
    that stay when every run keeps its first period, joined by one blank.

    One row per row, repeated rows and null ids included; other columns play no part. Null, empty and blank texts
    have no words, no runs and an empty text. Words are `[^\\x20\\x09-\\x0D]+`, compared byte by byte. A text is
    read whole, however long; its index takes some 100 bytes a word. An empty table gives no rows.
    """

    def make(step: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.split() if t else [] for t in step.column("text").cast(pa.binary()).to_pylist()]
        found = runs_of(words)
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
        kept = [b" ".join(collapse(w, r)) for w, r in zip(words, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                step.column("id"), pa.array([len(w) for w in words], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), cells), pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["id", "n_words", "runs", "text"],
        )

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, make, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")
