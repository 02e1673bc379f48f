"""SimHash near-duplicates: 64-bit fingerprints, block joins, exact Hamming check, components.

* ``fingerprints``: one pass over the texts in Arrow steps; no shuffle of text.
* ``near_links``: a fingerprint is cut into blocks; two that differ in at most ``distance`` bits agree
  on all but ``distance`` blocks (pigeonhole), so each combination of the other blocks is a key. The
  number of blocks follows the number of fingerprints so that a key of random fingerprints stays
  small; any number finds every pair. Fingerprints of a key are compared in numpy where Spark has
  put them side by side, and only the links of a spanning forest leave the task. A crowded key is
  dealt to pairs of chunks, so no task holds it whole and every pair still meets.
* ``near_duplicates``: documents of equal fingerprints are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threatlake.llm.common import arrow_map, own, texts
from threatlake.llm.components import components
from threatlake.session import Scratch

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of one key that are compared in one task; more are dealt to pairs of such chunks.
CHUNK = 1024
_PIECE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of the blank-separated words, A-Z lower-cased; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))  # one past the blank after each word
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1]]
    stops = ends[shingle - 1 :] or ends[-1:]
    hash64 = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        part = zip(starts[at : at + _PIECE], stops[at : at + _PIECE], strict=True)
        h = np.array([hash64(joined[s : e - 1], seed) for s, e in part], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """id, th (hash of the text: with the id, what tells documents apart), fp (bigint bits), one row per row."""

    def make(step: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle, seed) for t in step.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays(
            [step.column("id"), step.column("th"), pa.array(fps.view(np.int64))], ["id", "th", "fp"]
        )

    rows = texts(docs, id_col, text_col, F.xxhash64(docs[text_col]).alias("th"))
    return arrow_map(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, th bigint, fp bigint")


def blocks_for(n: int, distance: int) -> int:
    """Least number of blocks at which a key has at least log2(n) bits."""
    blocks = distance + 1
    while blocks < 16 and 64 // blocks * (blocks - distance) < math.log2(max(n, 2)):
        blocks += 1
    return blocks


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks (signed 64-bit) of every combination of blocks - distance blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fps: np.ndarray, distance: int, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (positions) that connect what pairs within the distance connect.

    ``own``: the chunk of each fingerprint; if given, only pairs of different chunks are compared.
    """
    label, links = np.arange(len(fps)), []
    for i in range(1, len(fps)):
        near = np.bitwise_count(fps[:i] ^ fps[i]) <= distance
        if own is not None:
            near &= own[:i] != own[i]
        roots, first = np.unique(label[:i][near], return_index=True)
        if len(roots):
            where = np.flatnonzero(near)[first]
            links.extend((int(j), i) for j in where)
            label[i] = roots[0]
            for r in roots[1:]:
                label[: i + 1][label[: i + 1] == r] = roots[0]
    return links


def _compare(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (fp, mask_no, key, low, high, chunk), sorted by all but fp: links within each group."""

    def groups() -> Iterator[np.ndarray]:
        held: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            cut = np.flatnonzero((rows[1:, 1:5] != rows[:-1, 1:5]).any(axis=1)) + 1
            if len(cut):
                yield rows[: cut[-1]]
                held = rows[cut[-1] :]
            else:
                held = rows
        if held is not None:
            yield held

    for rows in groups():
        starts = np.flatnonzero(np.r_[True, (rows[1:, 1:5] != rows[:-1, 1:5]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        fps, a, b = rows[:, 0].view(np.uint64), [], []
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
        near = near[(rows[near, 3] == rows[near, 4]) | (rows[near, 5] != rows[near + 1, 5])]
        a.append(rows[near, 0])
        b.append(rows[near + 1, 0])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            same = rows[s, 3] == rows[s, 4]
            found = forest(fps[s : s + n], distance, None if same else rows[s : s + n, 5])
            if found:
                i, j = np.array(found).T
                a.append(rows[s + i, 0])
                b.append(rows[s + j, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def near_links(nodes: DataFrame, work: Scratch, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """``nodes`` (fp, distinct and stored) -> links (a, b) whose components are those of all pairs within the distance."""
    masks = block_masks(blocks_for(nodes.count(), distance), distance)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
    keyed = nodes.select("fp", F.posexplode(keys).alias("mask_no", "key"))
    crowded = work.table(keyed.groupBy("mask_no", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "crowded")
    chunks = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
    dealt = keyed.join(crowded, ["mask_no", "key"], "left").select(
        "fp", "mask_no", "key", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    paired = dealt.select("fp", "mask_no", "key", "chunk", other.alias("other"))
    placed = paired.select(
        "fp", "mask_no", "key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk"
    )
    side = ["mask_no", "key", "low", "high"]
    together = placed.repartition(*side).sortWithinPartitions(*side)
    return together.mapInArrow(lambda batches: _compare(batches, distance), "a bigint, b bigint")


def _classes(prints: DataFrame, work: Scratch, distance: int) -> DataFrame:
    """fp, component, head: the smallest id of the component, and the document that stands for it."""
    head = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    nodes = work.table(prints.groupBy("fp").agg(F.min(head).alias("head")), "nodes")
    links = work.table(near_links(nodes.select("fp"), work, distance), "near")
    roots = components(links, work)
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "head", F.coalesce("root", "fp").alias("root")
    )
    firsts = placed.groupBy("root").agg(F.min("head").alias("first"))
    return placed.join(firsts, "root").select("fp", F.col("first")["id"].alias("component"), F.col("first").alias("head"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
    shingle: int = SHINGLE, seed: int = SEED,
) -> DataFrame:
    """id, th, fp, component, stays for every row of ``docs``.

    component: smallest id reached over links of at most ``distance`` bits. stays: the row is the one
    that stands for its component (the smallest id; of rows without id, which come last, the smallest
    text hash). A null text is an empty one; repeated rows have equal results; an empty table gives
    no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    with Scratch(spark) as work:
        prints = work.keep(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
        classes = work.keep(_classes(prints, work, distance), "classes")
    stays = F.struct(F.col("id").isNull().alias("no_id"), "id", "th").eqNullSafe(F.col("head"))
    return prints.join(classes, "fp").select("id", "th", "fp", "component", stays.alias("stays"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of every near-duplicate component; its columns are unchanged.

    Rows that repeat both id and text of the document that stays are repeats of it and go as well.
    """
    name = own(docs, "__key")
    key = lambda id, th: F.concat_ws(":", id.isNull(), F.coalesce(id.cast("string"), F.lit("")), th).alias(name)
    classes = near_duplicates(docs, id_col, text_col, distance)
    kept = classes.where("stays").select(key(F.col("id"), F.col("th"))).distinct()
    marked = docs.withColumn(name, key(docs[id_col], F.xxhash64(docs[text_col])))
    return marked.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
