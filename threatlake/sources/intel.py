"""Reputation tables from JSON documents keyed by indicator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.contracts import INTEL_SCHEMA
from threatlake.functions.network import ip_kind
from threatlake.operators.enrichment import unique_intel

_ENTRY = (
    "struct<reputation: string, confidence: double, source: string, categories: array<string>, "
    "threat_actor: string, type: string>"
)


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents (a document is one cell, so at most 2 GB); an absent path gives none."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder or "/")
        .select(F.col("content").cast("string").alias("text"))
    )


def _entries(docs: DataFrame, schema: str) -> DataFrame:
    return docs.select(F.explode(F.from_json("text", schema)).alias("key", "entry"))


def _rows(entries: DataFrame, kind) -> DataFrame:
    return entries.select(
        kind.alias("ioc_type"), F.col("key").alias("value"),
        F.coalesce("entry.reputation", F.lit("UNKNOWN")).alias("reputation"),
        F.coalesce("entry.confidence", F.lit(0.0)).alias("confidence"),
        "entry.source", "entry.categories", "entry.threat_actor", F.col("entry.type").alias("hash_type"),
    )


def read_intel(spark: SparkSession, ips: str | None = None, domains: str | None = None, hashes: str | None = None) -> DataFrame:
    """One reputation table from up to three documents; missing or unreadable ones add no rows."""
    parts = []
    if ips:
        parts.append(_rows(_entries(_documents(spark, ips), f"map<string, {_ENTRY}>"),
                           F.coalesce(ip_kind(F.col("key")), F.lit("IPv4"))))
    if domains:
        parts.append(_rows(_entries(_documents(spark, domains), f"map<string, {_ENTRY}>"), F.lit("Domain")))
    if hashes:
        nested = _documents(spark, hashes).select(
            F.explode(F.from_json("text", f"struct<known_hashes: map<string, {_ENTRY}>>")["known_hashes"]).alias("key", "entry")
        )
        parts.append(_rows(nested, F.lit("Hash")))
    if not parts:
        return spark.createDataFrame([], INTEL_SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return unique_intel(out).select(*INTEL_SCHEMA.fieldNames())


def conform(df: DataFrame) -> DataFrame:
    """Any provider's table as a reputation table, one row per indicator: missing optional columns become NULL."""
    columns = []
    for f in INTEL_SCHEMA.fields:
        have = f.name in df.columns
        columns.append((F.col(f.name) if have else F.lit(None)).cast(f.dataType).alias(f.name))
    return unique_intel(df.select(*columns)).select(*INTEL_SCHEMA.fieldNames())
