"""FM-index over word ids: suffix array, wavelet-matrix ranks, backward search, sampled positions.

An index covers one shard: documents (or overlapping segments of long ones) as word ids from 1, each
closed by a terminator 0. Terminators count as different symbols in order of place, so a suffix ends at
its own document's end. All operations work on many patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 32


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` (word ids, 0 ends a document, last symbol 0) by prefix doubling.

    The first sort takes as many symbols as fit a 63-bit key; then only suffixes still tied are sorted.
    """
    n, bits = len(s), max(1, int(s.max()).bit_length())
    h = max(1, min(8, 63 // bits, n))
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(h):
        symbol = np.zeros(n, np.int64)
        symbol[: n - k] = s[k:]
        symbol[~alive] = 0
        key = key << bits | symbol
        alive &= symbol > 0
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    head |= ~alive[sa]  # its end is in the key: told apart by place
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    del key, sorted_key
    tied = ~head
    tied[:-1] |= ~head[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        at = sa[slots]
        both = rank[at] << 32 | rank[at + h]
        order = np.argsort(both, kind="stable")
        at, both = at[order], both[order]
        sa[slots] = at
        head = np.ones(len(slots), bool)
        head[1:] = both[1:] != both[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots, h = slots[tied], 2 * h
    return sa


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class WaveletMatrix:
    def __init__(self, s: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            zeros = s[~bit]
            self.levels.append((level, Bits(bit), len(zeros)))
            s = np.concatenate([zeros, s[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before position i, element by element."""
        start = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = (c >> level & 1).astype(bool)
            i1, s1 = bits.ones(i), bits.ones(start)
            i, start = np.where(one, zeros + i1, i - i1), np.where(one, zeros + s1, start - s1)
        return i - start

    def get_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at position i and its rank there."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = bits.get(i)
            i1, s1 = bits.ones(i), bits.ones(start)
            i, start = np.where(one, zeros + i1, i - i1), np.where(one, zeros + s1, start - s1)
            c |= one << level
        return c, i - start


class FMIndex:
    def __init__(self, s: np.ndarray, offset: np.ndarray, sample: int = SAMPLE) -> None:
        """``s``: the shard's symbols; ``offset``: each symbol's place in its document or segment."""
        sa = suffix_array(s)
        self.size, self.sigma = len(s), int(s.max()) + 1
        self.smaller = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(s, minlength=self.sigma))])
        self.bwt = WaveletMatrix(s[sa - 1], self.sigma)  # before place 0 stands the last symbol, a terminator
        taken = offset[sa] % sample == 0
        self.sampled, self.places = Bits(taken), sa[taken]

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the row ranges [lo, hi) of each pattern. Rows of ``patterns`` hold ids at their
        end (right-aligned); id 0 is a word the shard doesn't have."""
        n, width = patterns.shape
        lo, hi = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        live = np.arange(n)
        for k in range(1, width + 1):
            live = live[(lengths[live] >= k) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, width - k]
            known = c > 0
            hi[live[~known]] = lo[live[~known]]
            rows, c = live[known], c[known]
            both = self.bwt.rank(np.r_[c, c], np.r_[lo[rows], hi[rows]])
            lo[rows], hi[rows] = self.smaller[c] + both[: len(rows)], self.smaller[c] + both[len(rows) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows: step back through the text to the nearest sampled suffix. A segment's first
        place is sampled, so no step leaves a segment."""
        place, steps, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            done = self.sampled.get(rows[live]) == 1
            hit = live[done]
            place[hit] = self.places[self.sampled.ones(rows[hit])] + steps
            live = live[~done]
            if len(live):
                c, r = self.bwt.get_rank(rows[live])
                rows[live] = self.smaller[c] + r
            steps += 1
        return place
