"""Positions and running totals inside groups of any size.

A plain window puts a whole group into one task, so a source owning a third of the rows would
become one task. Here rows are range-partitioned on (group, order), which cuts large groups into
slices wherever the rows are; each slice is numbered on its own and the totals of earlier slices
of the group (at most one row per slice) are added.

The slice totals are written out before they are joined, so Spark knows their size when it plans:
it broadcasts them while small and otherwise sort-merges with skew splitting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from threatlake.session import materialise

_SLICE, _ROW, _BEFORE = "__slice", "__row", "__before"
_ROW_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def _join_slices(rows: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, _SLICE]
    side = slices.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)], _BEFORE, *(
        [_ROW + "0"] if _ROW + "0" in slices.columns else []
    ))
    match = None
    for i, k in enumerate(names):
        same = rows[k].eqNullSafe(side[f"__k{i}"])
        match = same if match is None else match & same
    return rows.join(side, match, "left").drop(*[f"__k{i}" for i in range(len(names))])


def _earlier(slices: DataFrame, keys: list[str], amount: str) -> DataFrame:
    before = W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    return slices.withColumn(_BEFORE, F.coalesce(F.sum(amount).over(before), F.lit(0)))


def _sliced(df: DataFrame, keys: list[str], order: list[str], table: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    placed = df.repartitionByRange(*[F.col(k) for k in [*keys, *order]]).sortWithinPartitions(*keys, *order)
    numbered = placed.withColumns({
        _SLICE: F.spark_partition_id(),
        _ROW: F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK)),
    })
    return table(numbered, "sliced")


def ranked(
    df: DataFrame, keys: list[str], order: list[str], name: str = "position", table: Callable[[DataFrame, str], DataFrame] = materialise,
) -> DataFrame:
    """1-based position of each row in its group. ``order`` must tell rows of a group apart.

    ``table`` writes what is read twice: ``Scratch.table`` where the result is written before its block ends.
    """
    rows = _sliced(df, keys, order, table)
    runs = rows.groupBy(*keys, _SLICE).agg(F.min(_ROW).alias(_ROW + "0"), F.count("*").alias("__n"))
    out = _join_slices(rows, table(_earlier(runs, keys, "__n"), "slices"), keys)
    place = F.col(_BEFORE) + F.col(_ROW) - F.col(_ROW + "0") + 1
    return out.withColumn(name, place).drop(_SLICE, _ROW, _ROW + "0", _BEFORE)


def with_previous(df: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str = "previous") -> DataFrame:
    """Each row with the struct ``fields`` of the row before it in its group, NULL for the first.

    ``keys`` are not null and ``order`` tells rows of a group apart. Inside a slice it is the row before; the first row of a
    slice looks at the last one of the slice before, so what crosses slices is one row per slice.
    """
    rows = _sliced(df, keys, order)
    ends = rows.groupBy(_SLICE).agg(F.max_by(F.struct(*keys, F.struct(*fields).alias("__row")), _ROW).alias("__end"))
    edges = ends.select(F.col(_SLICE).alias("__at"), F.lag("__end").over(W.orderBy(_SLICE)).alias("__end"))
    inside = F.lag(F.struct(*fields)).over(W.partitionBy(*keys, _SLICE).orderBy(_ROW))
    near = rows.withColumn(name, inside)
    joined = near.join(materialise(edges, "edges"), F.col(_SLICE) == F.col("__at"), "left")
    same = F.struct(*keys) == F.struct(*[F.col(f"__end.{k}") for k in keys])
    return joined.withColumn(name, F.coalesce(name, F.when(same, F.col("__end.__row")))).drop(_SLICE, _ROW, "__at", "__end")


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str = "before") -> DataFrame:
    """Sum of ``amount`` over the earlier rows of the group (0 for the first)."""
    rows = _sliced(df, keys, order).drop(_ROW)
    slices = rows.groupBy(*keys, _SLICE).agg(F.sum(amount).alias("__n"))
    inside = W.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    out = _join_slices(local, materialise(_earlier(slices, keys, "__n"), "slices"), keys)
    return out.withColumn(name, F.col("__inside") + F.col(_BEFORE)).drop(_SLICE, "__inside", _BEFORE)


def percentiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Exact linear-interpolation percentiles per group, one row per (group, probability) with its ``place`` in the list.

    Equal values are counted first, so neither a hot group nor a hot value reaches one task whole.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    whole = F.lit(0).alias("__whole")  # without keys, all rows are one group with a key
    by = [*keys, "__whole"]
    counted = clean.groupBy(*keys, whole, value).agg(F.count("*").alias("__n"))
    placed = running_total(counted, by, [value], "__n", "__from")
    totals = counted.groupBy(*by).agg(F.sum("__n").alias("__total"))
    side = totals.select(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(by)], "__total")
    match = None
    for i, k in enumerate(by):
        same = placed[k].eqNullSafe(side[f"__t{i}"])
        match = same if match is None else match & same
    rows = placed.join(side, match).drop("__whole", *[f"__t{i}" for i in range(len(by))])

    def at(index: Column) -> Column:
        inside = (F.col("__from") <= index) & (index < F.col("__from") + F.col("__n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    aggs = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("__total") - 1)
        aggs += [at(F.floor(place)).alias(f"__lo{i}"), at(F.ceil(place)).alias(f"__hi{i}")]
    found = rows.groupBy(*keys).agg(F.max("__total").alias("n"), *aggs)
    cells = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        # equal ends need no step between them, which infinite ones could not take
        level = F.when(low == high, low).otherwise(low + (place - F.floor(place)) * (high - low))
        cells.append(F.struct(F.lit(i).alias("place"), F.lit(float(p)).alias("probability"), level.alias("value")))
    return found.select(*keys, "n", F.inline(F.array(*cells)))


def percentile_summary(
    df: DataFrame, keys: list[str], value: str, ts: str, probabilities: tuple[float, ...] = (0.5, 0.95, 0.99)
) -> DataFrame:
    """One row per group: n, ``p50``-style columns (``p99_5`` for 0.995) and rows per day between its first and last time."""
    found = percentiles(df, keys, value, list(probabilities))
    names = [f"p{p * 100:.10g}".replace(".", "_") for p in probabilities]
    wide = found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("place") == i, F.col("value"))).alias(c) for i, c in enumerate(names)])
    span = df.groupBy(*keys).agg(
        F.count("*").alias("__rows"),
        F.timestamp_diff("SECOND", F.min(ts), F.max(ts)).alias("__seconds"),
    )
    rate = F.when(F.col("__seconds") > 0, F.col("__rows") * 86400.0 / F.col("__seconds"))
    side = span.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)], rate.alias("per_day"))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & wide[k].eqNullSafe(side[f"__s{i}"])
    return wide.join(side, match).drop(*[f"__s{i}" for i in range(len(keys))])
