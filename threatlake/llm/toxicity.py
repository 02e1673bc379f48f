"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its blanks become single ones, and its distinct n-grams of three to five characters are
hashed into 2^18 features. Per feature, the documents of each class that hold it are counted over the training
rows; the log ratio of the two smoothed shares is the feature's value wherever it occurs. Logistic regression
(Spark ML) is fitted on the features whose dependence on the label is beyond chance (log-likelihood ratio), the
best 2^13 at most, so that a long text doesn't gather the weights of thousands of n-grams that chance made
one-sided. Training rows are labelled rows, at most ``TRAIN_ROWS`` of them, the first by a hash of the id: their
ids are few enough to be sent to all tasks, so no text is shuffled. Scoring reads all whole texts in one narrow
pass with 2^18 weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F

from threatlake.llm.common import arrow_map, give_back, steps, texts
from threatlake.session import Scratch

GRAMS = (3, 4, 5)
BITS = 18
#: Features the regression sees at most, their least log-likelihood ratio (one feature in 2,000 reaches 6 by chance),
#: penalty of the weights, smoothing of the counts.
FEATURES, EVIDENCE, PENALTY, SMOOTHING = 1 << 13, 6.0, 1e-4, 1.0
TOXIC_FROM, HELD_OUT_MOD = 0.5, 5
#: Labelled rows the classifier learns from, at most.
TRAIN_ROWS = 20_000
_MIX = np.uint32(0x9E3779B1)


def plain(text: str | None) -> str:
    """Lower case, single blanks, one at each end; empty for a text without a word."""
    words = (text or "").lower().split()
    return f" {' '.join(words)} " if words else ""


def grams(texts: list[str | None], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n the hash of every n-gram of all texts, and the text each is from. Repeats are not removed."""
    chars = [plain(t) for t in texts]
    sizes = np.array([len(c) for c in chars], np.int64)
    codes = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(chars), dtype=np.int32), sizes)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = (h[:m] ^ codes[n - 1 :]) * _MIX
        h ^= h >> np.uint32(15)
        if n in GRAMS:
            whole = owner[:m] == owner[n - 1 :]
            mixed = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(32 - bits))[whole], owner[:m][whole]


def _held(found: list[tuple[np.ndarray, np.ndarray]], rows: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of every distinct pair, in order; ``found`` holds features and texts with repeats."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.uint32 if rows <= 1 << (32 - bits) else np.uint64
    keys = np.concatenate([doc.astype(kind) << kind(bits) | h.astype(kind) for h, doc in found])
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    return (keys >> kind(bits)).astype(np.int64), (keys & kind((1 << bits) - 1)).astype(np.int64)


def held_out(id_col: str = "id"):
    """crc32 of the id as text is divisible by five. A row without id has no label and is not held out."""
    return F.col(id_col).isNotNull() & (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % HELD_OUT_MOD == 0)


def document_counts(labelled: DataFrame, bits: int = BITS) -> DataFrame:
    """``labelled`` (text, label 0 or 1) -> feature, n0, n1: rows of each label that hold it. Feature -1 counts the rows."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for step in steps(batches, 0):
            label = step.column(1).to_numpy(zero_copy_only=False)
            rows += np.bincount(label, minlength=2)
            doc, feature = _held(list(grams(step.column(0).to_pylist(), bits)), step.num_rows, bits)
            for k in (0, 1):
                counts[k] += np.bincount(feature[label[doc] == k], minlength=size)
        there = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, there].astype(np.int32)), *(pa.array(np.r_[rows[k], counts[k][there]]) for k in (0, 1))], ["feature", "n0", "n1"]
        )
        give_back()

    parts = labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "feature int, n0 bigint, n1 bigint")
    return parts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_count_ratios(n0: np.ndarray, n1: np.ndarray, rows0: int, rows1: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of the smoothed share of label-1 rows with the feature over that of label-0 rows."""
    share = lambda n, rows: (n + smoothing) / (rows + 2 * smoothing)
    return np.log(share(n1, rows1)) - np.log(share(n0, rows0))


def _evidence(n0: np.ndarray, n1: np.ndarray, rows0: int, rows1: int) -> np.ndarray:
    """Log-likelihood ratio of feature and label being dependent."""
    total, total1 = rows0 + rows1, rows1
    n = n0 + n1

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    p1 = total1 / total
    return part(n1, n * p1) + part(n0, n * (1 - p1)) + part(rows1 - n1, (total - n) * p1) + part(rows0 - n0, (total - n) * (1 - p1))


@dataclass(frozen=True)
class Toxicity:
    """weights: per hashed feature, log-count ratio times regression weight, 0 where not selected."""

    weights: np.ndarray
    intercept: float
    bits: int

    def score(self, texts: list[str | None]) -> np.ndarray:
        level = np.full(len(texts), self.intercept)
        counts = self.weights != 0
        found = [(h[hit], doc[hit]) for h, doc in grams(texts, self.bits) for hit in [counts[h]]]
        doc, feature = _held(found, len(texts), self.bits)
        level += np.bincount(doc, self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(level, -700, 700)))


def fit(labelled: DataFrame, features: int = FEATURES, penalty: float = PENALTY, least: float = EVIDENCE, bits: int = BITS) -> Toxicity:
    """``labelled`` (text, label 0 or 1) -> the classifier.

    Without rows the score is 0.5 throughout; with rows of one class, or no telling feature, it is the smoothed
    share of label 1. The driver holds one count per class and feature (2^18) and the weights, whatever the
    table's size.
    """
    size = 1 << bits
    n0, n1, rows = np.zeros(size), np.zeros(size), np.zeros(2)
    counts = document_counts(labelled, bits).toArrow()  # at most 2^18 + 1 rows
    feature, c0, c1 = (counts.column(c).to_numpy() for c in ("feature", "n0", "n1"))
    whole = feature < 0
    rows[:] = c0[whole].sum(), c1[whole].sum()
    n0[feature[~whole]], n1[feature[~whole]] = c0[~whole], c1[~whole]
    evidence = _evidence(n0, n1, *rows) if rows.all() else n0
    chosen = np.sort(np.argsort(-evidence, kind="stable")[: min(features, int((evidence >= least).sum()))])
    if not rows.all() or not len(chosen):
        share = (rows[1] + SMOOTHING) / (rows.sum() + 2 * SMOOTHING)
        return Toxicity(np.zeros(size), float(np.log(share / (1 - share))), bits)
    ratio = log_count_ratios(n0, n1, *rows)
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)

    def select(step: pa.RecordBatch) -> pa.RecordBatch:
        hits = [(at[known], doc[known]) for h, doc in grams(step.column("text").to_pylist(), bits) for at in [place[h]] for known in [at >= 0]]
        doc, chosen_at = _held(hits, step.num_rows, bits)
        offsets = np.searchsorted(doc, np.arange(step.num_rows + 1)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(chosen_at.astype(np.int32)))
        return pa.RecordBatch.from_arrays([found, step.column("label")], ["found", "label"])

    scale = ratio[chosen]
    vector = F.udf(lambda found: Vectors.sparse(len(scale), found, scale[found]), VectorUDT())
    with Scratch(labelled.sparkSession) as work:
        rows = labelled.select("text", F.col("label").cast("double").alias("label"))
        train = work.table(arrow_map(rows, select, "found array<int>, label double"), "toxic_train")
        model = LogisticRegression(regParam=penalty, maxIter=60, standardization=False).fit(train.select(vector("found").alias("features"), "label"))
    weights = np.zeros(size)
    weights[chosen] = model.coefficients.toArray() * scale
    return Toxicity(weights, float(model.intercept), bits)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label_col: str = "toxic", features: int = FEATURES, penalty: float = PENALTY, toxic_from: float = TOXIC_FROM, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """id, held_out, score, predicted; one row per row of ``docs``.

    Learns from the labelled rows that are not held out, ``train_rows`` labels at most. Labels other than 0 and 1,
    null labels and null ids are none; a repeated row counts each time. A null text is an empty one; it has no n-gram and gets the score of
    none. Equal texts get equal scores. An empty table gives no rows, and without labels every score is 0.5.
    """
    rows = texts(docs, id_col, text_col).withColumn("held_out", held_out())
    known = labels.select(labels[label_id].alias("id"), labels[label_col].cast("int").alias("label")).where("label IN (0, 1)")
    drawn = known.where(~held_out()).orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    model = fit(rows.join(F.broadcast(drawn), "id"), features, penalty)

    def make(step: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(step.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [step.column("id"), step.column("held_out"), pa.array(s), pa.array((s >= toxic_from).astype(np.int32))],
            ["id", "held_out", "score", "predicted"],
        )

    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, make, f"id {kind}, held_out boolean, score double, predicted int")
