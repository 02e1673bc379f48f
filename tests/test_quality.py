"""Contracts, cleaning, imputation, profiling."""

import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake.contracts import CONSTANT_FEATURES, flow_contract, parse_contract, snake
from threatlake.operators import quality, ranking
from threatlake.sources import flows as source

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (8443, 12.5, 7, -3.0, "10.8.0.4", "PortScan"), (25, NAN, 3, INF, "10.8.0.9", "BENIGN"), (8443, 12.5, 7, -3.0, "10.8.0.4", "PortScan"),
        (25, INF, 9, NAN, None, "DDoS"), (993, 40.0, 2, 8.0, "10.8.0.7", "BENIGN"), (25, 16.0, 1, 2.0, "10.8.0.2", "DDoS"),
    ]
    return spark.createDataFrame(rows, "` Destination Port ` long, `Flow Duration` double, `Total Fwd Packets` long, `Flow Bytes/s` double, `Source IP` string, Label string")


def test_contract():
    c = flow_contract()
    assert len(c.names) == len(set(c.columns)) == 66 and len(CONSTANT_FEATURES) == 12
    assert not set(CONSTANT_FEATURES) & set(c.names)
    assert c.types.count("double") == 24 and snake("Fwd Header Length.1") == "fwd_header_length_1"
    doc = {"ml_feature_names": ["A b", "C"], "total_ml_features": 2, "feature_types": {"A b": "int64", "C": "float64"}}
    assert parse_contract(json.dumps(doc)).schema.simpleString() == "struct<a_b:bigint,c:double>"
    with pytest.raises(ValueError):
        parse_contract(json.dumps({**doc, "total_ml_features": 3}))


def test_headers_and_select(raw):
    assert quality.clean_headers(raw, to_snake=False).columns[0] == "Destination Port"
    clean = quality.clean_headers(raw)
    assert clean.columns == ["destination_port", "flow_duration", "total_fwd_packets", "flow_bytes_s", "source_ip", "label"]
    assert quality.select_features(clean, ["total_fwd_packets", "flow_duration"]).columns == ["total_fwd_packets", "flow_duration"]
    with pytest.raises(ValueError, match="missing"):
        quality.select_features(clean, ["nope"])


def test_coercion(spark):
    df = spark.createDataFrame([("5",), ("bad",), (None,), ("NaN",), (" 7.5 ",)], "c string")
    assert [r["c"] for r in quality.coerce_numeric(df, ["c"]).collect()] == [5.0, 0.0, 0.0, 0.0, 7.5]


def test_taxonomy_duplicates_roles_constants(raw):
    clean = quality.clean_headers(raw)
    got = [r["target"] for r in quality.label_taxonomy(clean).collect()]
    assert got == ["PORT_SCAN", "BENIGN", "PORT_SCAN", "DDOS", "BENIGN", "DDOS"]
    copies = sorted(r["copies"] for r in quality.deduplicate(clean).collect())
    assert copies == [1, 1, 1, 1, 2]
    roles = {r["column_name"]: r for r in quality.profile(clean).collect()}
    assert roles["source_ip"]["role"] == "METADATA / IDENTIFIER" and roles["label"]["role"] == "TARGET"
    assert roles["flow_duration"]["role"] == "ML_FEATURE"
    assert (roles["flow_duration"]["nan_count"], roles["flow_duration"]["inf_count"]) == (1, 1)
    assert (roles["flow_bytes_s"]["min_value"], roles["flow_bytes_s"]["max_value"]) == (-3.0, 8.0)
    assert [r[0] for r in quality.constant_columns(clean.withColumn("k", F.lit(3))).collect()] == ["k"]


def test_imputation(raw):
    clean = quality.clean_headers(raw)
    medians = quality.fit_medians(clean, ["flow_duration", "flow_bytes_s"])
    assert medians == {"flow_duration": statistics.median([12.5, 12.5, 40, 16]), "flow_bytes_s": statistics.median([-3, -3, 8, 2])}
    assert quality.fit_medians(clean, ["flow_duration"], accuracy=1000) == {"flow_duration": 12.5}
    rows = quality.impute(clean, medians).collect()
    assert sum(r["imputed"] for r in rows) == 4 and all(np.isfinite(r["flow_duration"]) for r in rows)
    assert quality.infinite_count(clean, ["flow_duration", "flow_bytes_s"]).first().asDict() == {"flow_duration": 1, "flow_bytes_s": 1}


def full_rows(spark, *changes):
    c = flow_contract()
    rows = []
    for change in changes:
        row = dict.fromkeys(c.columns, "10.0")
        row.update(change)
        rows.append(tuple(row[k] for k in c.columns))
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in c.columns))


def test_validation_of_each_row(spark):
    df = full_rows(spark, {}, {"flow_duration": "nan"}, {"flow_bytes_s": "Infinity"}, {"total_fwd_packets": "INVALID"}, {"idle_min": None})
    rows = quality.validate_flows(df.withColumn("src_ip", F.lit("x")).withColumn("odd", F.lit(1))).collect()
    assert [r["is_valid"] for r in rows] == [True, False, False, False, False]
    assert rows[1]["report"]["nan_features"] == ["flow_duration"] and rows[4]["report"]["nan_features"] == ["idle_min"]
    assert rows[2]["report"]["inf_features"] == ["flow_bytes_s"]
    assert rows[3]["report"]["invalid_type_features"] == ["total_fwd_packets"]
    assert rows[0]["report"]["extra_features"] == ["odd"] and rows[0]["report"]["expected_feature_count"] == 66
    short = quality.validate_flows(full_rows(spark, {}).drop("destination_port")).first()
    assert not short["is_valid"] and short["report"]["missing_features"] == ["destination_port"]
    good, bad = quality.split_valid(quality.validate_flows(df))
    assert good.count() == 1 and bad.select("error_type").distinct().first()[0] == "FEATURE_SCHEMA_MISMATCH"


def test_validation_of_documents(spark):
    base = dict.fromkeys(flow_contract().names, 10.0)
    docs = [
        base, {**base, " Extra ": 1, "src_ip": "1.1.1.1"}, {k: v for k, v in base.items() if k != "Destination Port"},
        {**base, "Flow Duration": None}, {**base, "Flow Bytes/s": "inf"}, {**base, "Total Fwd Packets": "INVALID"},
    ]
    bodies = [json.dumps(d) for d in docs] + ["[1]", "nope"]
    rows = quality.validate_flow_documents(spark.createDataFrame([(b,) for b in bodies], "body string"), "body").collect()
    assert [r["is_valid"] for r in rows] == [True, True, False, False, False, False, False, False]
    assert rows[1]["report"]["extra_features"] == ["Extra"] and rows[1]["report"]["provided_feature_count"] == 68
    assert rows[2]["report"]["missing_features"] == ["Destination Port"]
    assert rows[3]["report"]["nan_features"] == ["Flow Duration"]
    assert rows[4]["report"]["inf_features"] == ["Flow Bytes/s"]
    assert rows[5]["report"]["invalid_type_features"] == ["Total Fwd Packets"]


def test_csv_splits_and_guard(spark, tmp_path):
    rows = spark.range(1000).selectExpr("cast(id as string) AS k", "CASE WHEN id < 20 THEN 'rare' ELSE 'common' END AS label", "id * 0.5 AS x")
    source.write_csv(rows, str(tmp_path / "csv"))
    assert source.read_csv(spark, str(tmp_path / "csv"), rows.schema, rows=7).count() == 7
    parts = {"train": 0.7, "validation": 0.15, "test": 0.15}
    exact = quality.stratified_split(rows, "label", "k", parts, exact=True)
    counts = {(r["label"], r["split"]): r["count"] for r in exact.groupBy("label", "split").count().collect()}
    assert counts[("rare", "train")] == 14 and counts[("rare", "test")] == 3 and counts[("common", "train")] == 686
    hashed = quality.stratified_split(rows, "label", "k", parts)
    share = hashed.where("split = 'train'").count() / 1000
    assert 0.6 < share < 0.8
    source.write_splits(hashed, str(tmp_path / "parts"))
    with pytest.raises(PermissionError):
        source.read_split(spark, str(tmp_path / "parts"), "test")
    total = sum(source.read_split(spark, str(tmp_path / "parts"), s, allow_test_access=True).count() for s in parts)
    assert total == 1000
    plan = source.read_split(spark, str(tmp_path / "parts"), "train")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_percentiles_with_hot_group_and_hot_value(spark):
    rng = np.random.default_rng(1)
    data = [("hot", 0.0)] * 3000 + [("hot", float(v)) for v in rng.normal(size=2000)] + [("cold", float(v)) for v in range(7)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    got = {(r["g"], r["probability"]): (r["value"], r["n"]) for r in ranking.percentiles(df, ["g"], "v", [0.0, 0.5, 0.95, 0.99, 1.0]).collect()}
    for g in ("hot", "cold"):
        values = [v for k, v in data if k == g]
        for p in (0.0, 0.5, 0.95, 0.99, 1.0):
            assert got[(g, p)][0] == pytest.approx(np.percentile(values, p * 100)) and got[(g, p)][1] == len(values)


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_ranked_matches_counting(spark, threshold):
    """With slice totals broadcast, and merged when they are too large for that."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        check_ranked(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def check_ranked(spark):
    rng = np.random.default_rng(2)
    data = [("hot" if i % 3 == 0 else f"k{rng.integers(40)}", int(rng.integers(10)), i) for i in range(4000)]
    df = spark.createDataFrame(data, "k string, a int, s long").repartition(5)
    got = {r["s"]: r["position"] for r in ranking.ranked(df, ["k"], ["a", "s"]).collect()}
    seen, want = {}, {}
    for k, a, s in sorted(data):
        seen[k] = seen.get(k, 0) + 1
        want[s] = seen[k]
    assert got == want
    total = {r["s"]: r["before"] for r in ranking.running_total(df, ["k"], ["a", "s"], "a").collect()}
    acc, exp = {}, {}
    for k, a, s in sorted(data):
        exp[s] = acc.get(k, 0)
        acc[k] = exp[s] + a
    assert total == exp


def test_rows_without_label_or_group_stay(spark):
    rows = [(f"k{i}", None if i % 3 == 0 else "a", float(i)) for i in range(15)]
    df = spark.createDataFrame(rows, "k string, label string, v double").withColumn("ts", F.current_timestamp())
    assert quality.stratified_split(df, "label", "k", {"train": 0.7, "test": 0.3}, exact=True).count() == 15
    found = {r["label"]: r for r in ranking.percentile_summary(df, ["label"], "v", "ts", (0.5, 0.125, 0.995, 0.999)).collect()}
    assert set(found) == {None, "a"} and found[None]["n"] == 5
    none = [v for _, k, v in rows if k is None]
    for p, name in ((0.5, "p50"), (0.125, "p12_5"), (0.995, "p99_5"), (0.999, "p99_9")):
        assert found[None][name] == pytest.approx(np.percentile(none, p * 100))


def test_percentiles_of_infinite_values_and_of_everything(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (INF,), (INF,), (INF,)], "v double")
    got = {r["probability"]: r["value"] for r in ranking.percentiles(df, [], "v", [0.0, 0.25, 0.5, 0.9]).collect()}
    assert got == {0.0: 1.0, 0.25: 2.0, 0.5: INF, 0.9: INF}


def test_names_with_commas_are_refused():
    from threatlake.functions.lists import listed
    with pytest.raises(ValueError, match="comma"):
        listed((F.lit(True), "a,b"))
