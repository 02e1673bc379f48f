"""Header cleaning, contract validation, coercion, imputation and profiling of flow tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from threatlake.contracts import (
    FLOW_EXTRAS, LABEL_TAXONOMY, ROLE_FEATURE, ROLE_METADATA, ROLE_TARGET, flow_contract, snake,
)
from threatlake.functions.lists import listed
from threatlake.operators.ranking import percentiles, ranked
from threatlake.session import materialise


def clean_headers(df: DataFrame, to_snake: bool = True) -> DataFrame:
    """Trim every column name; ``to_snake`` also makes it safe to use unquoted."""
    return df.toDF(*[snake(c) if to_snake else c.strip() for c in df.columns])


def select_features(df: DataFrame, features: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Contract columns in contract order, after any ``keep`` columns."""
    features = list(features)
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} contract columns missing: {missing}")
    return df.select(*keep, *[F.col(f"`{f}`") for f in features])


def as_number(value: Column) -> Column:
    """DOUBLE reading of any column; text that is no number, NULL and NaN give 0.0."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: as_number(F.col(c)) for c in columns})


def _fault(name: str, dtype: T.DataType) -> Column:
    """``bad_type``, ``nan``, ``inf`` or NULL for one feature value."""
    raw = F.col(f"`{name}`")
    if isinstance(dtype, (T.NumericType, T.StringType)):
        number = raw.try_cast("double")
        return (
            F.when(raw.isNull() | F.isnan(number), F.lit("nan"))
            .when(F.abs(number) == float("inf"), F.lit("inf"))
            .when(number.isNull(), F.lit("bad_type"))
        )
    return F.when(raw.isNull(), F.lit("nan")).otherwise(F.lit("bad_type"))


def validate_flows(df: DataFrame, features: Iterable[str] | None = None, extras: Iterable[str] = FLOW_EXTRAS) -> DataFrame:
    """Add ``is_valid`` and a ``report`` struct: five name lists and the two counts, per row."""
    features = list(features if features is not None else flow_contract().columns)
    present = [f for f in features if f in df.columns]
    missing = [f for f in features if f not in df.columns]
    allowed = set(extras) | {e.lower() for e in extras}
    extra = [c for c in df.columns if c not in features and c not in allowed]
    faults = {f: _fault(f, df.schema[f].dataType) for f in present}

    def named(kind: str) -> Column:
        return listed(*[(F.col(f"__fault_{i}") == kind, f) for i, f in enumerate(present)])

    def constant(names: list[str]) -> Column:
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    report = F.struct(
        constant(missing).alias("missing_features"),
        named("bad_type").alias("invalid_type_features"),
        named("nan").alias("nan_features"),
        named("inf").alias("inf_features"),
        constant(extra).alias("extra_features"),
        F.lit(len(features)).alias("expected_feature_count"),
        F.lit(len(df.columns)).alias("provided_feature_count"),
    )
    faulty = F.size("report.missing_features")
    for part in ("invalid_type_features", "nan_features", "inf_features"):
        faulty = faulty + F.size(f"report.{part}")
    checked = df.withColumns({f"__fault_{i}": faults[f] for i, f in enumerate(present)})
    return checked.withColumn("report", report).withColumn("is_valid", faulty == 0).drop(
        *[f"__fault_{i}" for i in range(len(present))]
    )


def validate_flow_documents(
    df: DataFrame, body: str, features: Iterable[str] | None = None, extras: Iterable[str] = FLOW_EXTRAS
) -> DataFrame:
    """The same report for flows arriving as JSON objects, where each row has its own fields.

    ``features`` are contract spellings; names in the document are trimmed first.
    """
    features = list(features if features is not None else flow_contract().names)
    fields = F.transform_keys(F.from_json(F.col(body), "map<string, string>"), lambda k, _: F.trim(k))
    wanted = F.array(*[F.lit(f) for f in features])
    known = F.array(*[F.lit(f) for f in (*features, *extras)])
    out = df.withColumn("__fields", fields)
    value = lambda f: F.try_element_at(F.col("__fields"), f)
    number = lambda f: value(f).try_cast("double")
    present = F.array_intersect(wanted, F.map_keys("__fields"))
    out = out.withColumn("__present", present)

    def named(test) -> Column:
        return F.filter("__present", lambda f: F.coalesce(test(f), F.lit(False)))

    report = F.struct(
        F.array_except(wanted, F.col("__present")).alias("missing_features"),
        named(lambda f: value(f).isNotNull() & number(f).isNull()).alias("invalid_type_features"),
        named(lambda f: value(f).isNull() | F.isnan(number(f))).alias("nan_features"),
        named(lambda f: F.abs(number(f)) == float("inf")).alias("inf_features"),
        F.array_except(F.map_keys("__fields"), known).alias("extra_features"),
        F.lit(len(features)).alias("expected_feature_count"),
        F.size("__fields").alias("provided_feature_count"),
    )
    out = out.withColumn("report", F.when(F.col("__fields").isNotNull(), report))
    faulty = None
    for part in ("missing_features", "invalid_type_features", "nan_features", "inf_features"):
        n = F.size(f"report.{part}")
        faulty = n if faulty is None else faulty + n
    return out.withColumn("is_valid", F.coalesce(faulty == 0, F.lit(False))).drop("__fields", "__present")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the report, quarantined rows with it)."""
    good = checked.where("is_valid").drop("report", "is_valid")
    bad = checked.where("NOT is_valid").drop("is_valid").withColumn("error_type", F.lit("FEATURE_SCHEMA_MISMATCH"))
    return good, bad


def target_class(label: Column) -> Column:
    """Raw capture label -> class; unlisted labels are upper-cased with underscores."""
    out = F.upper(F.regexp_replace(F.trim(label), "[^0-9A-Za-z]+", "_"))
    for raw, name in LABEL_TAXONOMY.items():
        out = F.when(F.trim(label) == raw, F.lit(name)).otherwise(out)
    return out


def label_taxonomy(df: DataFrame, label: str = "label", target: str = "target") -> DataFrame:
    return df.withColumn(target, target_class(F.col(label)))


def column_role(name: str) -> str:
    key = snake(name)
    if key in {"label", "target"}:
        return ROLE_TARGET
    if key in {"flow_id", "source_ip", "destination_ip", "src_ip", "dst_ip", "source_port", "src_port",
               "protocol", "timestamp", "ts", "row_key"}:
        return ROLE_METADATA
    return ROLE_FEATURE


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _finite(c: str) -> Column:
    value = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: role, rows, nulls, NaN, inf, finite min and max. One aggregate pass."""
    aggs, cells = [F.count("*").alias("rows")], []
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"nulls{i}"))
        if isinstance(field.dataType, T.NumericType):
            number = c.cast("double")
            aggs += [
                F.count_if(F.isnan(number)).alias(f"nans{i}"),
                F.count_if(F.abs(number) == float("inf")).alias(f"infs{i}"),
                F.min(_finite(field.name)).alias(f"low{i}"),
                F.max(_finite(field.name)).alias(f"high{i}"),
            ]
            nans, infs, low, high = (F.col(f"{p}{i}") for p in ("nans", "infs", "low", "high"))
        else:
            nans = infs = F.lit(0).cast("long")
            low = high = F.lit(None).cast("double")
        cells.append(F.struct(
            F.lit(field.name).alias("column_name"), F.lit(column_role(field.name)).alias("role"),
            F.col("rows"), F.col(f"nulls{i}").alias("null_count"), nans.alias("nan_count"),
            infs.alias("inf_count"), low.alias("min_value"), high.alias("max_value"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Names of columns holding one value (nulls aside); one aggregate pass."""
    scalar = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    aggs = [F.min(f"`{c}`").eqNullSafe(F.max(f"`{c}`")).alias(f"same{i}") for i, c in enumerate(scalar)]
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"same{i}").alias("same")) for i, c in enumerate(scalar)]
    return df.agg(*aggs).select(F.inline(F.array(*cells))).where("same").select("column_name")


def _unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column_name"), _finite(c).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def fit_medians(df: DataFrame, columns: Iterable[str] | None = None, accuracy: int | None = None) -> dict[str, float]:
    """Median of the finite values of each column; one number per column comes to the driver.

    Exact unless ``accuracy`` asks for the one-pass sketch.
    """
    columns = list(columns or _numeric(df))
    if accuracy:
        row = df.agg(*[F.percentile_approx(_finite(c), 0.5, accuracy).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    rows = percentiles(_unpivot(df, columns), ["column_name"], "value", [0.5]).collect()
    return {r["column_name"]: r["value"] for r in rows}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """NULL, NaN and infinite values replaced; ``imputed`` counts the replacements in the row."""
    hits = None
    for c in medians:
        hit = _finite(c).isNull().cast("int")
        hits = hit if hits is None else hits + hit
    filled = {c: F.coalesce(_finite(c), F.lit(float(m))) for c, m in medians.items()}
    return df.withColumn("imputed", hits).withColumns(filled)


def infinite_count(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row: infinities per column that imputation turns into missing values."""
    return df.agg(*[
        F.count_if(F.abs(F.col(f"`{c}`").cast("double")) == float("inf")).alias(c) for c in (columns or _numeric(df))
    ])


def deduplicate(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed; ``copies`` keeps how many there were.

    A group-by on all columns: copies collapse before the shuffle, so a hot row costs one entry per task.
    """
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies"))


#: Hashes that share their upper bits are counted together, so the cuts are looked for among one bucket's rows.
_BUCKET_SHIFT = 48


def _cut_places(
    rows: DataFrame, label: str, key: str, edges: list[float], table: Callable[[DataFrame, str], DataFrame],
) -> tuple[DataFrame, list[Column]]:
    """``rows`` and, per edge, whether a row's place in its class, by (``__h``, key), is in the share below the edge.

    Counting finds the hash and key at each cut, one row per class; telling the rows apart needs no sort. Only the
    rows of one key that a cut goes through are numbered.
    """
    bucket = F.shiftright("__h", _BUCKET_SHIFT)
    counted = table(rows.groupBy(F.col(label).alias("__c"), bucket.alias("__b")).agg(F.count("*").alias("__m")), "buckets")
    before = W.partitionBy("__c").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    summed = counted.withColumns({
        "__from": F.coalesce(F.sum("__m").over(before), F.lit(0)), "__n": F.sum("__m").over(W.partitionBy("__c"))})

    def last(edge: float) -> Column:
        """The greatest place p of 1..n with (p - 1) / n < edge, in doubles; 0 if there is none."""
        near, n = F.ceil(F.col("__n") * edge), F.col("__n")
        found = F.when(near / n < edge, near + 1).when((near - 1) / n < edge, near).otherwise(near - 1)
        return F.greatest(F.least(found, n), F.lit(0))

    asked = F.array(*[F.struct(F.lit(i).alias("__i"), last(e).alias("__k")) for i, e in enumerate(edges)])
    wanted = summed.select("__c", "__b", "__m", "__from", F.inline(asked)).where("__k > __from AND __k <= __from + __m")
    wanted = table(wanted.select("__c", "__b", "__i", (F.col("__k") - F.col("__from")).alias("__k")), "wanted")
    near = rows.select(F.col(label).alias("__l"), F.col(key).alias("__key"), "__h", bucket.alias("__hb"))
    near = near.join(wanted, F.col("__l").eqNullSafe(F.col("__c")) & (F.col("__hb") == F.col("__b")))
    groups = near.groupBy("__c", "__i", "__k", "__h", "__key").agg(F.count("*").alias("__m"))
    inside = W.partitionBy("__c", "__i").orderBy("__h", "__key").rowsBetween(W.unboundedPreceding, -1)
    placed = groups.withColumn("__from", F.coalesce(F.sum("__m").over(inside), F.lit(0)))
    at = placed.where("__k > __from AND __k <= __from + __m").withColumn("__take", F.col("__k") - F.col("__from"))
    one = lambda i: F.max(F.when(F.col("__i") == i, F.struct("__h", "__key", "__take", "__m"))).alias(f"e{i}")
    wide = at.groupBy("__c").agg(*[one(i) for i in range(len(edges))])
    cuts = table(wide.select("__c", F.struct(*[f"e{i}" for i in range(len(edges))]).alias("__cuts")), "cuts")

    out = rows.join(cuts, rows[label].eqNullSafe(cuts["__c"]), "left").drop("__c")
    cut = lambda i, name: F.col(f"__cuts.e{i}.{name}")
    same = lambda i: (F.col("__h") == cut(i, "__h")) & F.col(key).eqNullSafe(cut(i, "__key"))
    through = [F.coalesce((cut(i, "__take") < cut(i, "__m")) & same(i), F.lit(False)) for i in range(len(edges))]
    tied = reduce(Column.__or__, through)
    passes = reduce(Column.__or__, [F.coalesce(cut(i, "__take") < cut(i, "__m"), F.lit(False)) for i in range(len(edges))])
    if cuts.where(passes).isEmpty():
        out = out.withColumn("__tie", F.lit(0).cast("bigint"))
    else:
        numbered = ranked(out.where(tied), [label, "__h", key], [], "__tie", table)
        out = out.where(~tied).withColumn("__tie", F.lit(0).cast("bigint")).unionByName(numbered)

    def under(i: int) -> Column:
        first = F.coalesce(F.col(key) < cut(i, "__key"), F.col(key).isNull() & cut(i, "__key").isNotNull())  # nulls come first
        tie = F.col(key).eqNullSafe(cut(i, "__key")) & (F.col("__tie") <= cut(i, "__take"))
        return F.coalesce((F.col("__h") < cut(i, "__h")) | ((F.col("__h") == cut(i, "__h")) & (first | tie)), F.lit(False))

    return out, [under(i) for i in range(len(edges))]


def stratified_split(
    df: DataFrame, label: str, key: str, fractions: dict[str, float], seed: int = 42, exact: bool = False,
    table: Callable[[DataFrame, str], DataFrame] = materialise,
) -> DataFrame:
    """Add ``split``. Default: seeded hash of the key, no shuffle, same expected share in every class.

    ``exact`` cuts each class at the exact row count instead, in the order of hash and key (``_cut_places``): the rows
    stay where they are. Rows without a label are a class of their own. ``table`` writes what is read twice, as in
    ``ranking.ranked``; ``exact`` reads ``df`` three times.
    """
    shuffled = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    names = list(fractions)
    edges = list(accumulate(fractions[name] for name in names[:-1]))
    if exact and edges:
        shuffled, below = _cut_places(shuffled, label, key, edges, table)
    else:
        share = F.pmod(F.col("__h"), F.lit(1_000_000)) / 1_000_000
        below = [share < edge for edge in edges]
    split = None
    for name, under in zip(names, below, strict=False):
        split = F.when(under, name) if split is None else split.when(under, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return shuffled.withColumn("split", split).drop("__h", "__cuts", "__tie")
