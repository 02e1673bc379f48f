"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The bytes of `[^\x20\x09-\x0D]+` words are separated by these.
BLANKS = " \t\n\x0b\x0c\r"
#: Lower-cases A-Z and blanks every byte that is not a letter, a digit or part of a non-ASCII character.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Texts per Arrow step; a step also ends at this many bytes.
STEP_ROWS, STEP_BYTES = 1024, 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The two columns an operator works on under names of its own, so other columns can't clash."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *more)


def own(docs: DataFrame, name: str) -> str:
    """A column name that no column of ``docs`` has, in any spelling: longer than all of them."""
    return name + "_" * max((len(c) for c in docs.columns), default=0)


def plain_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Frames written inside reach Python in Arrow batches of at most ``rows`` rows; the session's own setting follows again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their task, and idle ones should be small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a step holds few megabytes of text, or one long text. ``text``: its column."""
    for batch in batches:
        column, start, n, size = batch.column(text), 0, batch.num_rows, 0
        if column.nbytes <= STEP_BYTES and n <= STEP_ROWS:
            yield batch
            continue
        for i, length in enumerate(pc.binary_length(column).to_pylist()):
            size += length or 0
            if size > STEP_BYTES or i + 1 - start >= STEP_ROWS:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < n:
            yield batch.slice(start)
        column = None
    batch = column = None
    give_back()


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``make`` on every step of ``df``, whose column ``text`` holds the texts."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, at):
            yield make(step)

    return df.mapInArrow(run, schema)
