"""Line deduplication: equal lines, and lines one word edit apart, by a deletion-neighbourhood join.

Lines are compared as words (blank-separated, A-Z lower-cased). Two lines are within one edit (one word
inserted, deleted or replaced) exactly if

* deleting the same position from both leaves the same words (a replacement), or
* deleting one position from the longer leaves the shorter (an insertion or deletion).

So a line emits hashed keys of its words without each position, and of all its words; equal keys meet.
In a group of one key and position all lines are within one edit of each other, so the earliest is
each one's partner and no pairs are listed. Every partnership is checked on the words.

Before that, lines that can't have a partner are set aside without loss: one edit touches the first or the
second half of a line, not both, so a line of which neither half's key occurs in a different line
emits nothing. Hashes are shuffled, and the documents twice: to find the texts of lines that have a partner in
sight, and to be cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from threatlake.llm.common import give_back, own, steps, texts
from threatlake.session import Scratch

#: Lines of fewer words are only compared for equality: one word of few changes what they say.
MIN_WORDS = 8
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def line_words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").lower().split()


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Word edit distance of at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def half_keys(words: list[bytes], min_words: int = 0) -> list[int]:
    """Keys of which two lines within one edit share at least one, as signed 64-bit numbers.

    They are hashes of the first and of the last q words, q the largest power of two up to half the line
    (0 for one word). A line whose shorter partner has a smaller q has that one's keys too.
    """
    n = len(words)
    keys = []
    for q in {1 << (m.bit_length() - 2) if m > 1 else 0 for m in (n, n - 1) if m >= max(min_words, 0) or m == n}:
        keys.append(xxhash.xxh64_intdigest(b" ".join(words[:q]), 2 * q))
        keys.append(xxhash.xxh64_intdigest(b" ".join(words[n - q :]), 2 * q + 1))
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def deletion_keys(words: list[bytes]) -> np.ndarray:
    """Key of the words without position i, for each i, and last the key of all words (unsigned 64-bit).

    Polynomial hash of word hashes, so a line of n words takes time in proportion to n.
    """
    n = len(words)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    power = np.ones(n, np.uint64)
    power[1:] = np.uint64(_BASE)
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
    keys = np.empty(n + 1, np.uint64)
    keys[:n] = sums[:n] + (sums[n] - sums[1:]) * np.uint64(_BACK)
    keys[n] = sums[n]
    keys ^= np.concatenate([np.full(n, n - 1, np.uint64), np.full(1, n, np.uint64)]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return keys


def _signed(values: Iterator[int]) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, th, line (from 0), h1, h2 (128-bit hash of the words), keys; one row per line that has a word."""

    def run(batches):
        for step in steps(batches, 1):
            at, line_no, h1, h2, keys = [], [], [], [], []
            for row, text in enumerate(step.column(1).to_pylist()):
                if not text:
                    continue
                for i, line in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n")):
                    words = line.split()
                    if words:
                        h = xxhash.xxh3_128_intdigest(b" ".join(words))
                        at.append(row)
                        line_no.append(i)
                        h1.append(h >> 64)
                        h2.append(h & _MASK)
                        keys.append(half_keys(words, min_words) if len(words) >= min_words else None)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [step.column(0).take(rows), step.column(2).take(rows), pa.array(line_no, pa.int32()),
                 _signed(iter(h1)), _signed(iter(h2)), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "th", "line", "h1", "h2", "keys"],
            )

    rows = texts(docs, id_col, text_col, F.xxhash64(docs[text_col]).alias("th"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, th bigint, line int, h1 bigint, h2 bigint, keys array<bigint>")


def _place() -> Column:
    """What orders lines: by id (null last), text hash, line number."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "line").alias("place")


def _key(id: Column, th: Column) -> Column:
    return F.concat_ws(":", id.isNull(), F.coalesce(id.cast("string"), F.lit("")), th).alias("__key")


def _candidates(firsts: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """place, h1, h2, text: the first of each distinct line that shares a half key with a different line."""
    keyed = firsts.select("h1", "h2", "place", F.explode("keys").alias("key"))
    busy = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    found = keyed.join(busy, "key").groupBy("place").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    wanted = found.groupBy(_key(F.col("place.id"), F.col("place.th"))).agg(
        F.collect_list(F.struct("place", "h1", "h2")).alias("wanted")
    )
    rows = docs.select(_key(docs[id_col], F.xxhash64(docs[text_col])), docs[text_col].cast("string").alias("text"))
    joined = rows.join(wanted, "__key").select("wanted", "text")

    def run(batches):
        for step in steps(batches, 1):
            lines, flat = [], step.column(0).flatten()
            for wants, text in zip(step.column(0).to_pylist(), step.column(1).to_pylist(), strict=True):
                parts = text.split("\n")
                lines += [parts[w["place"]["line"]] for w in wants]
            place, h1, h2 = flat.flatten()
            yield pa.RecordBatch.from_arrays([place, h1, h2, pa.array(lines, pa.string())], ["place", "h1", "h2", "text"])

    place = firsts.schema["place"].dataType.simpleString()
    return joined.mapInArrow(run, f"place {place}, h1 bigint, h2 bigint, text string")


def _variants(lines: DataFrame) -> DataFrame:
    """place, key, at: keys of the line without position ``at``; at = -1: of the whole line."""

    def run(batches):
        for step in steps(batches, 1):
            rows, keys, ats, held = [], [], [], 0
            for row, text in enumerate(step.column(1).to_pylist()):
                found = deletion_keys(line_words(text))
                keys.append(found.view(np.int64))
                ats.append(np.r_[np.arange(len(found) - 1), -1].astype(np.int32))
                rows.append(np.full(len(found), row))
                held += len(found)
                if held > 1 << 17:
                    yield made(step, rows, keys, ats)
                    rows, keys, ats, held = [], [], [], 0
            if rows:
                yield made(step, rows, keys, ats)

    def made(step, rows, keys, ats):
        return pa.RecordBatch.from_arrays(
            [step.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(ats))],
            ["place", "key", "at"],
        )

    place = lines.schema["place"].dataType.simpleString()
    return lines.select("place", "text").mapInArrow(run, f"place {place}, key bigint, at int")


#: Rows a column function turns into Python objects at a time.
_PART = 512


def _by_parts(make, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``make`` on the rows of the columns, a part at a time."""
    made = [pa.array([make(*row) for row in zip(*(c.slice(at, _PART).to_pylist() for c in columns), strict=True)], kind)
            for at in range(0, len(columns[0]), _PART)]
    give_back()
    return pa.concat_arrays(made) if made else pa.array([], kind)


def _close(a: pa.Array, b: pa.Array) -> pa.Array:
    return _by_parts(lambda x, y: within_one_edit(line_words(x), line_words(y)), pa.bool_(), a, b)


def _near(lines: DataFrame, work: Scratch) -> DataFrame:
    """h1, h2 of the ``lines`` that have an earlier line within one edit."""
    variants = work.table(_variants(lines), "variants")
    cut, whole = variants.where("at >= 0"), variants.where("at = -1")
    groups = cut.groupBy("key", "at").agg(F.min("place").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    replaced = cut.join(groups, ["key", "at"]).where("best < place").select("place", "best")
    longer = cut.select("key", "place").join(whole.select("key", F.col("place").alias("short")), "key")
    resized = longer.select(F.greatest("place", "short").alias("place"), F.least("place", "short").alias("best"))
    best = replaced.union(resized).distinct()
    one, two = lines.select("place", "h1", "h2", "text"), lines.select(F.col("place").alias("best"), F.col("text").alias("earlier"))
    close = F.arrow_udf(_close, "boolean")
    checked = best.join(one, "place").join(two, "best").where(close("text", "earlier"))
    return checked.select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, th, line, near: the lines to drop, of documents told apart by id and text hash.

    A line goes if an equal line comes earlier, or (lines of ``min_words`` or more) a line within one
    word edit does; earlier is by id (null last), text hash, line number, as each distinct line first
    occurs. near: no equal line comes earlier. A line without a word stays.
    """
    with Scratch(docs.sparkSession) as work:
        lines = work.keep(line_table(docs, id_col, text_col, min_words), "lines")
        first = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("place"), F.first("keys").alias("keys"), F.count("*").alias("n"))
        firsts = work.table(first, "firsts")
        near = work.table(_near(work.table(_candidates(firsts.where("keys IS NOT NULL"), docs, id_col, text_col), "candidates"), work), "losers")
        marked = firsts.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
        repeated = work.keep(
            marked.where("n > 1 OR near").select("h1", "h2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near")),
            "repeated",
        )
    found = lines.join(repeated, ["h1", "h2"]).withColumn("earliest", _place().eqNullSafe(F.col("first")))
    return found.where("near OR NOT earliest").select("id", "th", "line", F.expr("near AND earliest").alias("near"))


def _cut(text: str | None, drop: list[int] | None) -> str | None:
    if text is None or drop is None:
        return text
    gone = set(drop)
    return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in gone])


def _without(text: pa.Array, drop: pa.Array) -> pa.Array:
    return _by_parts(_cut, pa.string(), text, drop)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the dropped lines cut from the texts, and ``__exact`` and ``__near``, the lines cut of either kind.

    Rows and other columns stay as they are; a null text stays null; rows that repeat id and text are
    one document and lose the same lines. A table that has a column ``__exact`` or ``__near`` keeps it, and gets no
    count of that kind.
    """
    gone = dropped_lines(docs, id_col, text_col, min_words).distinct()
    key, drop, near, exact = (own(docs, n) for n in ("__key", "__drop", "__near", "__exact"))
    per_doc = gone.groupBy(_key(F.col("id"), F.col("th")).alias(key)).agg(
        F.collect_list("line").alias(drop), F.count_if("near").alias(near), F.count_if(~F.col("near")).alias(exact),
    )
    marked = docs.withColumn(key, _key(docs[id_col], F.xxhash64(docs[text_col])))
    joined = marked.join(per_doc, key, "left")
    hit = F.col(drop).isNotNull()
    cut = F.arrow_udf(_without, "string")(F.when(hit, F.col(text_col)), F.col(drop))
    out = joined.withColumn(text_col, F.when(hit, cut).otherwise(F.col(text_col)))
    for name, count in (("__near", near), ("__exact", exact)):
        if name not in docs.columns:
            out = out.withColumn(name, F.coalesce(count, F.lit(0)))
    return out.drop(key, drop, near, exact)
