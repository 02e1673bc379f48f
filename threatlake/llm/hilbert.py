"""Sharding along a Hilbert curve, so that files prune on several metadata columns at once.

Each dimension is quantised into 2**bits cells of about equal rows (order-preserving, so minima and maxima of
a file are close), the cells of a row give its index on the curve, and the rows sorted by index are cut into
runs whose counts differ by one at most. Built-in functions throughout; positions come from range-partitioned
slices, so neither a hot cell nor a group of equal rows is one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.operators.ranking import ranked, running_total
from threatlake.session import materialise

SHARDS, BITS = 40, 5


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """digit and next state, by state * 2**dims + label, of the walk from the coarsest bit to the finest.

    A state is an entry corner and a direction; the rules are those of reflected Gray codes.
    """
    size = 1 << dims
    gray = lambda i: i ^ (i >> 1)
    turn = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & (size - 1)
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing 1 bits
    ungray = {gray(i): i for i in range(size)}
    entry = [0 if i == 0 else gray(2 * ((i - 1) // 2)) for i in range(size)]
    axis = [0 if i == 0 else ones(i - 1 if i % 2 == 0 else i) % dims for i in range(size)]
    digits, after = [], []
    for state in range(size * dims):
        e, d = divmod(state, dims)
        for label in range(size):
            digit = ungray[turn(label ^ e, dims - (d + 1) % dims)]
            digits.append(digit)
            after.append((e ^ turn(entry[digit], d + 1)) * dims + (d + axis[digit] + 1) % dims)
    return digits, after


def curve_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the curve of a point with coordinates below 2**bits."""
    dims = len(cells)
    digits, after = (F.lit(t) for t in curve_tables(dims))
    state, index = F.lit(0), F.lit(0).cast("bigint")
    for bit in range(bits - 1, -1, -1):
        label = F.lit(0)
        for i, cell in enumerate(cells):
            label = label + F.shiftright(cell, bit).bitwiseAND(F.lit(1)) * (1 << i)
        at = state * (1 << dims) + label
        index = index * (1 << dims) + F.get(digits, at)
        state = F.get(after, at)
    return index


def _by_text(df: DataFrame, name: str, cell: str, bits: int) -> DataFrame:
    """``df`` plus the cell of a text column, cut by the rank of the whole value among all rows."""
    counted = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__value")).agg(F.count("*").alias("__n"))
    counted = materialise(counted, "values")
    total = counted.agg(F.sum("__n")).first()[0] or 1
    ranks = running_total(counted, [], ["__value"], "__n", "__from")
    side = ranks.select("__value", F.expr(f"(__from * {1 << bits}) div {total}").cast("int").alias(cell))
    return df.join(side, df[name] == side["__value"], "left").drop("__value").fillna(0, [cell])


def quantised(df: DataFrame, dims: Sequence[str], bits: int = BITS) -> tuple[DataFrame, list[str]]:
    """``df`` plus a cell number per dimension, and their names; a cell holds about equal rows.

    Texts are placed by their rank, numbers by quantiles over all rows (2**bits - 1 bounds). Nulls are in cell
    0. Equal values share a cell, so a hot value makes some cells empty, not large ones.
    """
    kinds = dict(df.dtypes)
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cells = [f"__cell{i}" for i in range(len(dims))]
    numbers = {n: F.col(c).cast("double") for n, c in zip(cells, dims, strict=True) if kinds[c] not in ("string", "binary")}
    row = df.agg(F.count("*"), *[F.percentile_approx(x, shares, 10000).alias(n) for n, x in numbers.items()]).first()
    for n, c in zip(cells, dims, strict=True):
        if n in numbers:
            cell = F.lit(0)
            for bound in row[n] or []:
                cell = cell + F.coalesce(numbers[n] > bound, F.lit(False)).cast("int")
            df = df.withColumn(n, cell)
        else:
            df = _by_text(df, c, n, bits)
    return df, cells


def shard(df: DataFrame, dims: Sequence[str], ties: Sequence[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` plus curve (index), shard and slot (from 0, without gaps, in curve order).

    Counts of shards differ by one at most. ``ties`` order rows of one index; rows that repeat in all of
    them are ordered anyhow and may be parted by a cut. An empty table gives no rows.
    """
    celled, cells = quantised(df, dims, bits)
    placed = celled.withColumn("curve", curve_index([F.col(c) for c in cells], bits)).drop(*cells).withColumn("__tie", F.monotonically_increasing_id())
    rows = ranked(placed, [], ["curve", *ties, "__tie"], "__place").drop("__tie")
    total = max(rows.count(), 1)
    number = F.expr(f"((__place - 1) * {shards}) div {total}")
    first = F.expr(f"(__shard * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("__shard", number).withColumn("slot", F.col("__place") - 1 - first).withColumn(
        "shard", F.col("__shard").cast("int")
    ).drop("__place", "__shard")


def manifest(sharded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Per shard its rows and the least and greatest value of each dimension: what a reader prunes files by."""
    bounds = [f(c).alias(f"{name}_{c}") for c in dims for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *bounds)


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: Sequence[str] = ("source", "lang"),
    shards: int = SHARDS, bits: int = BITS,
) -> DataFrame:
    """id, the ``meta`` columns, size, text_crc32, curve, shard, slot: documents by metadata and size.

    size is the UTF-8 bytes of the text plus 16. A null text is an empty one, null metadata sorts first,
    ties go by text_crc32 (equal texts of equal metadata stay together) and id; repeated rows each get a slot.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    only = docs.select(
        docs[id_col].alias("id"), *[docs[c].alias(f"meta_{c}") for c in meta],
        (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    return shard(only, [*[f"meta_{c}" for c in meta], "size"], ["text_crc32", "id"], shards, bits)
