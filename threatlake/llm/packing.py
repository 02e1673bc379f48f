"""Best-fit packing of documents into sequences, planned on the histogram of piece lengths.

1. Tasks encode the texts, cut long documents into pieces, and number the pieces of equal length
   within their slice (the task's share of the input). The table is written: numbers stay.
2. The histogram (at most ``capacity`` rows, whatever the corpus) is planned on the driver:
   patterns of few pieces that nearly fill a sequence, on a coarse grid of lengths, get repeat counts
   by non-negative least squares; the counts are rounded down and served from the exact lengths.
   Residual pieces, longest first, go where they leave the least room, all pieces of a length at once.
3. The plan says, for each length, which run of its pieces goes to which run of sequences. A piece finds
   its run by its number: numbers in the slice plus the pieces of that length in earlier slices.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from threatlake.llm.common import steps, texts
from threatlake.llm.tokens import encoder
from threatlake.session import Scratch

CAPACITY, END_ID = 2048, 0
#: Grid cells of a sequence, and most pieces of a pattern.
CELLS, PARTS = 128, 3
#: A pattern may leave one in so many tokens free.
SLACK_SHARE = 1024


def patterns(cells: int = CELLS, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most ``parts`` grid sizes that sum to ``cells`` exactly."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, made: tuple[int, ...]) -> None:
        if left == 0:
            out.append(made)
        elif len(made) < parts:
            for size in range(min(left, top), 0, -1):
                grow(left - size, size, (*made, size))

    grow(cells, cells, ())
    return out


def nonnegative_fit(a: np.ndarray, b: np.ndarray, weight: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |weight * (a x - b)| small, by accelerated projected gradient."""
    aw, bw = a * weight[:, None], b * weight
    gram, target = aw.T @ aw, aw.T @ bw
    step = 1.0 / max(np.linalg.norm(gram, 2), 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (gram @ y - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class Plan:
    """Runs (length, first number, first sequence, count, offset): equal pieces in consecutive sequences."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, {k: n for k, n in counts.items() if n}
        self.slack = capacity // SLACK_SHARE
        self.used: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        #: room -> runs of sequences (first, count) that have so much room
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(self, length: int, first: int, count: int, offset: int) -> None:
        self.runs.append((length, self.used[length], first, count, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def close(self, first: int, count: int, filled: int) -> None:
        self.open[self.capacity - filled].append((first, count))

    def serve(self, pattern: tuple[tuple[int, int], ...], repeats: int) -> None:
        """``repeats`` sequences of one piece from each range (low, high] of lengths, the longest first.

        The last piece is the longest that still fits. The pattern ends when its ranges are used up or
        more than ``slack`` tokens would stay free; the rest is better off as residual.
        """
        while repeats:
            chosen: dict[int, int] = defaultdict(int)
            picks = []
            for i, (low, high) in enumerate(pattern, 1):
                high = self.capacity - sum(picks) if i == len(pattern) else high
                length = next((k for k in range(high, low, -1) if self.left.get(k, 0) > chosen.get(k, 0)), 0)
                if length:
                    chosen[length] += 1
                    picks.append(length)
            if len(picks) < len(pattern) or sum(picks) < self.capacity - self.slack:
                return
            times = min([repeats, *(self.left[k] // c for k, c in chosen.items())])
            offset, first = 0, self.sequences
            for length in picks:
                self.put(length, first, times, offset)
                offset += length
            self.sequences += times
            self.close(first, times, offset)
            repeats -= times

    def residual(self) -> None:
        """What is left, longest first, each into the least room that takes it, else into new sequences."""
        for length in sorted(self.left, reverse=True):
            for room in range(length, self.capacity + 1):
                while self.open.get(room) and self.left.get(length):
                    first, count = self.open[room].pop()
                    # several pieces of this length fit, but a shorter room may come up first: one each
                    times = min(count, self.left[length])
                    self.put(length, first, times, self.capacity - room)
                    self.open[room - length].append((first, times))
                    if count > times:
                        self.open[room].append((first + times, count - times))
                if length not in self.left:
                    break
            while (n := self.left.get(length)):
                each = self.capacity // length
                full, rest = divmod(n, each)
                for times, depth in ((full, each), (1 if rest else 0, rest)):
                    if times:
                        for i in range(depth):
                            self.put(length, self.sequences, times, i * length)
                        self.close(self.sequences, times, depth * length)
                        self.sequences += times


def plan(counts: dict[int, int], capacity: int = CAPACITY, cells: int = CELLS, parts: int = PARTS) -> list[tuple[int, int, int, int, int]]:
    """Runs for a histogram of lengths 1..capacity."""
    made = Plan(counts, capacity)
    edges = [capacity * i // cells for i in range(cells + 1)]
    grid = np.array([sum(counts.get(k, 0) for k in range(lo + 1, hi + 1)) for lo, hi in zip(edges, edges[1:], strict=False)], float)
    kinds = patterns(cells, parts)
    a = np.zeros((cells, len(kinds)))
    for j, kind in enumerate(kinds):
        for size in kind:
            a[size - 1, j] += 1
    # short pieces find room anywhere, so a miss counts by the tokens it holds
    repeats = nonnegative_fit(a, grid, np.arange(1, cells + 1) / cells)
    for j in np.argsort([-max(k) for k in kinds], kind="stable"):
        if repeats[j] >= 1:
            made.serve(tuple((edges[s - 1], edges[s]) for s in kinds[j]), int(repeats[j]))
    made.residual()
    return made.runs


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """id, piece, start, length, ids_crc32, slice, number (of the slice's pieces of that length), [ids]."""

    def run(batches):
        end, slice_no, seen = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), defaultdict(int)
        ids_of = encoder(tokenizer).ids
        for step in steps(batches, 1):
            out: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "ids_crc32", "number", "ids")}
            for row, text in enumerate(step.column(1).to_pylist()):
                ids = ids_of(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) >> 2
                    for c, v in zip(out, (row, piece, at >> 2, n, zlib.crc32(part), seen[n], part if keep_ids else b""), strict=True):
                        out[c].append(v)
                    seen[n] += 1
            rows = len(out["row"])
            columns = {
                "id": step.column(0).take(pa.array(out["row"], pa.int64())), "piece": pa.array(out["piece"], pa.int32()),
                **{c: pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")},
                "slice": pa.array([slice_no] * rows, pa.int32()), "number": pa.array(out["number"], pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(out["ids"], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, slice int, number bigint"
    return rows.mapInArrow(run, schema + (", ids binary" if keep_ids else ""))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """Every piece with its place: id, piece, start, length, ids_crc32, sequence_id, offset, [ids].

    Only documents longer than ``capacity`` tokens (end id included) are cut. Sequences are filled
    from offset 0 without gaps. A null or empty text is the end id alone. Every row is packed,
    repeated ids and rows too; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    with Scratch(spark) as work:
        rows = work.keep(pieces(docs, id_col, text_col, capacity, end_id, tokenizer, keep_ids), "pieces")
        sliced = work.keep(rows.groupBy("length", "slice").agg((F.max("number") + 1).alias("n")), "slices")
        counts = {r["length"]: r["n"] for r in sliced.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
        runs = defaultdict(list)
        for length, number, sequence, _, offset in plan(counts, capacity):
            runs[length].append((number, sequence, offset))
        before = W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        placed = sliced.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        numbered = rows.join(placed, ["length", "slice"]).withColumn("number", F.col("number") + F.col("before")).drop("before", "slice")

    starts = {k: (np.array([r[0] for r in v]), np.array([r[1] for r in v]), np.array([r[2] for r in v])) for k, v in runs.items()}

    def place(batches):
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros_like(number), np.zeros_like(number)
            for k in np.unique(length):
                at = length == k
                first, sequences, offsets = starts[int(k)]
                i = np.searchsorted(first, number[at], "right") - 1
                sequence[at], offset[at] = sequences[i] + number[at] - first[i], offsets[i]
            keep = [c for c in batch.schema.names if c != "number"]
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_pydict({**columns, "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    kept = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = dict(numbered.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id bigint, offset bigint"
    return numbered.select(*kept, "number").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, spans of ``pack(..., keep_ids=True)``: one row per finished sequence."""
    part = F.struct("offset", "id", "piece", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda made, p: F.concat(made, p["ids"]))
    spans = F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["id"].alias("id"), p["piece"].alias("piece"), p["length"].alias("length")))
    return rows.select("sequence_id", joined.alias("ids"), spans.alias("spans"))
