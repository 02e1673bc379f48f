"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is the element-wise
product (binding) of its letters' vectors, rotated (permuted) by their places; a text is the sum (bundle)
of its trigrams. A language's prototype is the sum of its training texts' unit vectors, and a text gets
the language of the nearest prototype by cosine. Text vectors are made once and stored as 16-bit floats.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threatlake.llm.common import arrow_map, texts
from threatlake.session import Scratch

DIMENSIONS, SEED, UNKNOWN = 512, 20, "und"
#: Trigram vectors a task keeps at a time.
KEPT = 40_000
_CODE_BITS = 21


@cache
def _letters() -> np.ndarray:
    """Code point -> whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of lower-cased letters and their counts; everything else is one gap, 0, between words."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate([[0], points, [0]]).astype(np.int64)
    points = points[np.r_[True, (points[1:] > 0) | (points[:-1] > 0)]]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(points[:-2] << 2 * _CODE_BITS | points[1:-1] << _CODE_BITS | points[2:], return_counts=True)


class Space:
    """Vectors of letters and trigrams; those of trigrams are kept in a table that starts anew when full."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.table = np.empty((1024, dimensions), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            bits = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions)
            self.letters[point] = (2 * bits - 1).astype(np.int8)
        return self.letters[point]

    def trigram(self, code: int) -> np.ndarray:
        mask = (1 << _CODE_BITS) - 1
        first, second, third = code >> 2 * _CODE_BITS, code >> _CODE_BITS & mask, code & mask
        return np.roll(self.letter(first), 2) * np.roll(self.letter(second), 1) * self.letter(third)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(codes), KEPT):
            total += self._bundle(codes[at : at + KEPT], counts[at : at + KEPT])
        return total

    def _bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        wanted = codes.tolist()
        fresh = [c for c in wanted if c not in self.row]
        if len(self.row) + len(fresh) > KEPT:
            self.row, fresh = {}, wanted
        while len(self.row) + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        for c in fresh:
            self.row[c] = n = len(self.row)
            self.table[n] = self.trigram(c)
        rows = self.table[[self.row[c] for c in wanted]]
        return counts.astype(np.float32) @ rows

    def unit(self, text: str | None) -> np.ndarray | None:
        """The text's vector at length 1; None without a letter."""
        codes, counts = trigrams(text)
        if not len(codes):
            return None
        v = self.bundle(codes, counts)
        return v / max(float(np.linalg.norm(v)), 1e-12)


@cache
def space(dimensions: int, seed: int) -> Space:
    return Space(dimensions, seed)


def profile_table(docs: DataFrame, id_col: str, text_col: str, lang_col: str, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """id, lang, v (binary, 16-bit floats; null without a letter), one row per row."""

    def make(step: pa.RecordBatch) -> pa.RecordBatch:
        unit = space(dimensions, seed).unit
        vectors = [None if (v := unit(t)) is None else v.astype("<f2").tobytes() for t in step.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([step.column("id"), step.column("lang"), pa.array(vectors, pa.binary())], ["id", "lang", "v"])

    rows = texts(docs, id_col, text_col, docs[lang_col].cast("string").alias("lang"))
    return arrow_map(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, lang string, v binary")


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(-1, dimensions).astype(np.float32)


def prototypes(rows: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototype per language from ``rows`` (lang, v, both there). One row per language and dimension
    reaches the driver: languages are a label set, not data that grows."""

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, v = np.array(batch.column(0).to_pylist(), object), _vectors(batch.column(1), dimensions)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + v[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, s in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(s)], ["lang", "entry", "value"]
            )

    parts = rows.select("lang", "v").mapInArrow(sums, "lang string, entry int, value double")
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "entry").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["lang"], np.zeros(dimensions))[r["entry"]] = r["value"]
    return {k: v / max(float(np.linalg.norm(v)), 1e-12) for k, v in sorted(found.items())}


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    dimensions: int = DIMENSIONS, seed: int = SEED,
) -> DataFrame:
    """id, held_out, lang_pred, score (cosine, 0 to 1); one row per row of ``docs``.

    Learns from rows with a language whose id's crc32 (as text; a null id as the empty text) mod 5 is not
    0. A null text or one without a letter is ``und`` with score 0, and so is every text if nothing was
    learned. Equal texts get equal answers; of repeated rows each counts; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as work:
        made = profile_table(docs, id_col, text_col, lang_col, dimensions, seed)
        held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 5 == 0
        rows = work.keep(made.withColumn("held_out", held_out), "profiles")
    known = prototypes(rows.where("NOT held_out AND lang IS NOT NULL AND v IS NOT NULL"), dimensions)
    names, matrix = np.array([*known, UNKNOWN], object), np.array([*known.values()]).reshape(-1, dimensions).astype(np.float32).T

    def run(batches):
        for batch in batches:
            v = batch.column(2)
            there = np.array(v.is_valid())
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if there.any() and len(names) > 1:
                cosines = _vectors(v.filter(v.is_valid()), dimensions) @ matrix
                best[there] = cosines.argmax(axis=1)
                score[there] = np.clip(cosines.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held_out", "v").mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
