"""Providers as a data source: rows, partitions, filters, broken documents, and lookups over them."""

import json

import pytest
from pyspark.sql import functions as F

from threatlake.contracts import INTEL_SCHEMA
from threatlake.operators import enrichment
from threatlake.sources import providers
from threatlake.sources.intel import conform

DOCS = [
    ("ip", json.dumps({"10.0.0.1": {"reputation": "MALICIOUS", "confidence": 0.9, "source": "a", "categories": ["c2", "scan"]},
                       "2001:db8::1": {"reputation": "BENIGN", "confidence": 1}, "no address": {}})),
    ("domain", json.dumps({"evil.example": {"reputation": "SUSPICIOUS", "confidence": True, "threat_actor": "x"}, "odd": "text"})),
    ("hash", json.dumps({"known_hashes": {"ABC": {"reputation": "MALICIOUS", "confidence": 0.5, "type": "MD5"}}})),
    ("domain", '{"cut'), ("domain", None), ("domain", "[1]"), ("domain", ""), ("url", '{"u": {}}'), (None, '{"n": {}}'),
]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("provider") / "docs")
    spark.createDataFrame(DOCS, "kind string, document string").repartition(3).write.parquet(path)
    providers.register(spark)
    return path


def read(spark, path):
    return spark.read.format("threat_intel").load(path)


def test_rows(spark, source):
    rows = read(spark, source)
    assert rows.schema == INTEL_SCHEMA and rows.rdd.getNumPartitions() == 3
    got = {r["value"]: tuple(r) for r in rows.collect()}
    assert got == {
        "10.0.0.1": ("IPv4", "10.0.0.1", "MALICIOUS", 0.9, "a", ["c2", "scan"], None, None),
        "2001:db8::1": ("IPv6", "2001:db8::1", "BENIGN", 1.0, None, None, None, None),
        "no address": ("IPv4", "no address", "UNKNOWN", 0.0, None, None, None, None),
        "evil.example": ("Domain", "evil.example", "SUSPICIOUS", 0.0, None, None, "x", None),
        "odd": ("Domain", "odd", "UNKNOWN", 0.0, None, None, None, None),
        "ABC": ("Hash", "ABC", "MALICIOUS", 0.5, None, None, None, "MD5"),
    }


@pytest.mark.parametrize("where,want", [
    ("ioc_type = 'Domain'", {"evil.example", "odd"}), ("value IN ('ABC', 'odd', 'none')", {"ABC", "odd"}),
    ("ioc_type IN ('IPv4', 'IPv6') AND confidence > 0.5", {"10.0.0.1", "2001:db8::1"}), ("ioc_type = 'Domain' AND value = 'ABC'", set()),
    ("value = 'ABC' OR confidence = 1", {"ABC", "2001:db8::1"}),
])
def test_filters(spark, source, where, want):
    assert {r["value"] for r in read(spark, source).where(where).collect()} == want


@pytest.mark.parametrize("types,want", [("Domain", {"evil.example", "odd"}), ("IPv6,Hash", {"2001:db8::1", "ABC"}), ("Other", set())])
def test_types(spark, source, types, want):
    rows = spark.read.format("threat_intel").option("types", types).load(source)
    assert {r["value"] for r in rows.collect()} == want


def test_one_frame_filtered_in_two_ways(spark, source):
    rows = read(spark, source)
    both = rows.where("ioc_type = 'Hash'").select("value").union(rows.where("ioc_type = 'Domain'").select("value"))
    assert sorted(r["value"] for r in both.collect()) == ["ABC", "evil.example", "odd"]


def test_no_documents(spark, tmp_path):
    providers.register(spark)
    assert read(spark, str(tmp_path / "absent")).collect() == []


def test_lookup(spark, source):
    values = spark.createDataFrame([("10.0.0.1",), (" Evil.example",), ("nobody",)], "value string")
    found = {r["value"]: r["reputation"] for r in enrichment.lookup(values, conform(read(spark, source))).collect()}
    assert found == {"10.0.0.1": "MALICIOUS", " Evil.example": "SUSPICIOUS", "nobody": "UNKNOWN"}
    assert conform(read(spark, source).union(read(spark, source))).agg(F.count("*")).first()[0] == 6
