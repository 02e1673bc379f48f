"""Alert tables: JSON documents in, Parquet tables with one row per id, and their stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from threatlake.contracts import ALERT_SCHEMA
from threatlake.functions.documents import object_keys
from threatlake.operators.alerts import new_alerts
from threatlake.session import materialise


def read_json(spark: SparkSession, path: str, schema: T.StructType = ALERT_SCHEMA) -> DataFrame:
    """Alert documents, one JSON object per line; broken lines and other values are skipped."""
    probe = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    df = (
        spark.read.schema(probe).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    )
    kept = None
    for f in schema.fields:
        some = F.col(f.name).isNotNull()
        kept = some if kept is None else kept | some
    return df.where(F.col("_corrupt").isNull() & kept).drop("_corrupt")


def read_json_list(spark: SparkSession, path: str, schema: T.StructType = ALERT_SCHEMA) -> DataFrame:
    """Alert files that each hold one JSON array; elements that are no objects are skipped.

    A file is one cell and one task, so at most 2 GB; JSON lines (``read_json``) are the form for
    large tables. A file that is no array gives no rows. The place in the array fills a missing ``arrival_seq``.
    """
    texts = spark.read.text(path, wholetext=True)
    items = texts.select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "item"))
    parsed = items.where(object_keys(F.col("item")).isNotNull()).select("place", F.from_json("item", schema).alias("a"))
    columns = {f: F.col(f"a.{f}") for f in schema.fieldNames()}
    if "arrival_seq" in columns:
        columns["arrival_seq"] = F.coalesce(columns["arrival_seq"], F.col("place").cast("long"))
    return parsed.select(*[c.alias(f) for f, c in columns.items()])


def append_table(incoming: DataFrame, path: str) -> DataFrame:
    """Add incoming alerts whose id is new; returns what was added."""
    spark = incoming.sparkSession
    stored = spark.read.parquet(path)
    fresh = materialise(new_alerts(stored, incoming).select(*stored.columns), "fresh")
    fresh.write.mode("append").parquet(path)
    return fresh


def reset_table(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("overwrite").parquet(path)


def seed_if_empty(alerts: DataFrame, path: str) -> bool:
    """Write ``alerts`` only when the table holds no row yet."""
    if not alerts.sparkSession.read.schema(alerts.schema).parquet(path).isEmpty():
        return False
    reset_table(alerts, path)
    return True


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
