"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian with its own shrunk covariance. A score is the logistic of the difference of the
two log densities, from Mahalanobis distances by Cholesky factors that are computed once, plus the log
ratio of the class shares. Fitting needs counts, sums and products per class, which Spark sums over all
labelled training rows; the driver gets one row per class and entry of a 14 x 14 matrix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threatlake.llm.common import arrow_map, texts
from threatlake.session import Scratch

#: Byte classes that are counted by deleting them.
_UPPER, _LOWER, _DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_SYMBOLS, _MARKS, _SHOUTS = b"#*$%&|<>{}[]\\^~_=+@/", b".,;:'\"()-", b"!?"
_HIGH = bytes(range(128, 256))
NAMES = (
    "log_words", "word_length", "upper", "digits", "symbols", "marks", "shouts", "high", "stutter", "variety",
    "repeated_runs", "repeated_lines", "line_words", "capital_starts",
)
SHRINKAGE, KEEP_FROM, HELD_OUT = 0.02, 0.7, 2


#: Added to the whole of a share, so that one odd word of a short text says little.
_WORDS, _BYTES, _LINES = 20, 120, 5


def _share(part: float, whole: float, extra: float) -> float:
    """Square root of the damped share, which spreads out small ones."""
    return math.sqrt(part / (whole + extra))


def features(text: str | None) -> list[float]:
    """One finite number per name in ``NAMES``; language and origin play no part."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = lambda kinds: len(raw) - len(raw.translate(None, kinds))
    words = raw.split()
    n, size = len(words), sum(map(len, words))
    upper, lower = count(_UPPER), count(_LOWER)
    runs = list(zip(words, words[1:], words[2:], strict=False))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    distinct = len(set(words))
    byte_share = lambda kinds: _share(count(kinds), size, _BYTES)
    return [
        math.log1p(n), math.log1p((size + 5 * _WORDS) / (n + _WORDS)), _share(upper, upper + lower, _BYTES), byte_share(_DIGITS),
        byte_share(_SYMBOLS), byte_share(_MARKS), byte_share(_SHOUTS), byte_share(_HIGH),
        _share(sum(map(eq, words, words[1:])), n, _WORDS), math.log(distinct + _WORDS) / math.log(n + _WORDS),
        _share(len(runs) - len(set(runs)), len(runs), _WORDS), _share(len(lines) - len(set(lines)), len(lines), _LINES),
        math.log1p(n / len(lines)) if lines else 0.0, _share(sum(w[:1].isupper() for w in words), n, _WORDS),
    ]


@dataclass(frozen=True)
class Discriminant:
    """center, scale: of the labelled rows; per class 0, 1: mean, inverse Cholesky factor, log share less half log determinant."""

    center: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
        """From per-class counts (2), sums (2, d) and products (2, d, d); both classes need a row."""
        total, d = counts.sum(), sums.shape[1]
        center = sums.sum(axis=0) / total
        spread = np.sqrt(np.maximum(np.diagonal(products.sum(axis=0)) / total - center**2, 0))
        scale = np.where(spread > 1e-9, spread, 1.0)
        mean, inverse, constant = [], [], []
        for k in (0, 1):
            m = sums[k] / counts[k]
            cov = (products[k] / counts[k] - np.outer(m, m)) / np.outer(scale, scale)
            shrunk = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / d, 0.05) * np.eye(d)
            factor = np.linalg.cholesky(shrunk)
            mean.append((m - center) / scale)
            inverse.append(np.linalg.inv(factor))
            constant.append(math.log(counts[k] / total) - np.log(np.diagonal(factor)).sum())
        return cls(center, scale, np.array(mean), np.array(inverse), np.array(constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        level = [self.constant[k] - 0.5 * np.square((z - self.mean[k]) @ self.inverse[k].T).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(level[1] - level[0], -700, 700)))


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x (array<double>), one row per row."""

    def make(step: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t) for t in step.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([step.column("id"), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    rows = texts(docs, id_col, text_col)
    return arrow_map(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


def held_out(id_col: str = "id"):
    """crc32 of the id as text, mod 4, is 2. A row without id has no label and is not held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == HELD_OUT


def fit(rows: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant | float:
    """``rows`` (x, label 0 or 1) -> the discriminant, or a constant score if a class has no row: the
    share of label 1, or 0.5 without labelled rows."""
    d = len(NAMES)

    def moments(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                part = x[y == k]
                total[k] += np.r_[len(part), part.sum(axis=0), (part.T @ part).ravel()]
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total.ravel())], ["label", "entry", "value"]
        )

    parts = rows.select("x", F.col("label").cast("int").alias("label")).mapInArrow(moments, "label int, entry int, value double")
    total = np.zeros((2, 1 + d + d * d))
    for r in parts.groupBy("label", "entry").agg(F.sum("value").alias("value")).collect():  # 2 x (1 + d + d²) rows
        total[r["label"], r["entry"]] = r["value"]
    counts = total[:, 0]
    if not counts.all():
        return float(counts[1] / counts.sum()) if counts.sum() else 0.5
    return Discriminant.fit(counts, total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), shrinkage)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label_col: str = "quality", shrinkage: float = SHRINKAGE, keep_from: float = KEEP_FROM,
) -> DataFrame:
    """id, held_out, score, predicted, x; one row per row of ``docs``.

    Learns from all labelled rows that are not held out; labels other than 0 and 1, null labels and null
    ids are no labels, and of repeated rows each counts. A null text is an empty one and is scored; equal
    texts get equal scores. An empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as work:
        rows = work.keep(feature_table(docs, id_col, text_col).withColumn("held_out", held_out()), "features")
    known = labels.select(labels[label_id].alias("id"), labels[label_col].alias("label")).where("label IN (0, 1)")
    model = fit(rows.where("NOT held_out").join(known, "id"), shrinkage)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(2).flatten()).reshape(-1, len(NAMES))
            s = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= keep_from).astype(np.int32)), batch.column(2)],
                ["id", "held_out", "score", "predicted", "x"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held_out", "x").mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, x array<double>")
