"""Rule scores against worked values."""

import pytest
from pyspark.sql import functions as F

from threatlake.functions import flow, network, scoring, text
from threatlake.operators import attack, behaviour, detection


def one(df, *cols):
    return df.select(*cols).first()


@pytest.mark.parametrize("cls,conf,anom,want", [
    ("BENIGN", 0.95, 0.2, "BENIGN"),
    ("DDOS", 0.95, 0.3, "MALICIOUS"),
    ("DDOS", 0.95, 0.9, "MALICIOUS"),
    ("BENIGN", 0.95, 0.85, "ANOMALOUS"),
    ("PORT_SCAN", 0.60, 0.2, "SUSPICIOUS"),
    ("PORT_SCAN", 0.60, 0.70, "ANOMALOUS"),
    ("BENIGN", 0.5, 0.2, "SUSPICIOUS"),
    (None, None, None, "BENIGN"),
])
def test_decision(spark, cls, conf, anom, want):
    df = spark.createDataFrame([(cls, conf, anom)], "threat_class string, confidence double, anomaly_score double")
    assert detection.decide(df).first()["decision"] == want


@pytest.mark.parametrize("decision,cls,want", [
    ("BENIGN", "BENIGN", "INFO"), ("SUSPICIOUS", "X", "LOW"), ("ANOMALOUS", "X", "MEDIUM"),
    ("MALICIOUS", "DDOS", "CRITICAL"), ("MALICIOUS", "PORT_SCAN", "HIGH"), ("OTHER", "X", "MEDIUM"),
])
def test_severity(spark, decision, cls, want):
    row = detection.raise_alerts(spark.createDataFrame([(decision, cls)], "decision string, threat_class string")).first()
    assert row["severity"] == want and row["status"] == "NEW"


@pytest.mark.parametrize("conf,anom,sev,intel,n,score,level", [
    (0.74, 0.3534, "LOW", "MALICIOUS", 1, 51.82, "MEDIUM"),
    (0.80, 0.101, "INFO", "SUSPICIOUS", 1, 37.27, "MEDIUM"),
    (0.89, 0.009, "INFO", "UNKNOWN", 1, 31.68, "MEDIUM"),
    (0.86, 0.4199, "INFO", "MALICIOUS", 2, 54.90, "MEDIUM"),
    (0.96, 0.81, "HIGH", "MALICIOUS", 3, 86.45, "CRITICAL"),
])
def test_risk(spark, conf, anom, sev, intel, n, score, level):
    parts = scoring.risk_components(F.lit(conf), F.lit(anom), F.lit(sev), F.lit(intel), F.lit(n))
    row = spark.range(1).select(scoring.risk_score(parts).alias("s")).withColumn("l", scoring.risk_level(F.col("s"))).first()
    assert row["s"] == pytest.approx(score, abs=0.005) and row["l"] == level


def test_risk_defaults(spark):
    none = F.lit(None)
    parts = scoring.risk_components(none.cast("double"), none.cast("double"), none.cast("string"), none.cast("string"), F.lit(9))
    row = spark.range(1).select(*[c.alias(k) for k, c in parts.items()]).first()
    assert (row["confidence"], row["anomaly"], row["severity"], row["intel"], row["correlation"]) == (80.0, 0.0, 10.0, 20.0, 100.0)


@pytest.mark.parametrize("cls,decision,port,want", [
    ("port_scan", "MALICIOUS", 22, "T1046"), ("BRUTE_FORCE", "SUSPICIOUS", 22, "T1110"), ("WEB_ATTACK", "MALICIOUS", 80, "T1190"),
    ("DOS", "MALICIOUS", 80, "T1498"), ("BOTNET", "MALICIOUS", 6667, "T1071"), ("BOTNET", "MALICIOUS", 9999, scoring.NO_MAPPING),
    ("BOTNET", "MALICIOUS", None, scoring.NO_MAPPING), ("INFILTRATION", "ANOMALOUS", 1, scoring.NO_MAPPING),
    ("DDOS", "BENIGN", 80, None), ("BENIGN", "ANOMALOUS", 80, None),
])
def test_technique(spark, cls, decision, port, want):
    schema = "threat_class string, decision string, dst_port int, confidence double"
    events = spark.createDataFrame([(cls, decision, port, 0.9)], schema)
    for store in (None, attack.technique_dim(spark)):
        row = attack.map_techniques(events, store).first()
        assert row["technique_id"] == want
        if want == "T1071":
            assert row["technique_confidence"] == 0.765 and row["tactic"] == "Command and Control"
        elif want == scoring.NO_MAPPING:
            assert row["technique_confidence"] == (0.4 if cls == "BOTNET" else 0.3)
        elif want:
            assert row["technique_confidence"] == 0.855


def test_technique_store_without_row(spark):
    events = spark.createDataFrame([("DDOS", "MALICIOUS", 1, 0.9)], "threat_class string, decision string, dst_port int, confidence double")
    row = attack.map_techniques(events, attack.technique_dim(spark).where("technique_id <> 'T1498'")).first()
    assert row["technique_id"] is None and row["technique_confidence"] is None


def flows(spark, **values):
    cols = ", ".join(f"{k} {'int' if k == 'dst_port' else 'boolean' if k == 'repeated' else 'double'}" for k in values)
    return spark.createDataFrame([tuple(values.values())], cols)


@pytest.mark.parametrize("values,score,cls", [
    (dict(dst_port=6667, total_fwd_packets=10.0, fwd_packet_length_mean=32.0, flow_iat_mean=1000.0, flow_duration=5000.0), 0.85, "LIKELY_C2"),
    (dict(dst_port=80, total_fwd_packets=2.0, fwd_packet_length_mean=512.0), 0.0, "NO_C2_EVIDENCE"),
    (dict(dst_port=4444, total_fwd_packets=10.0, fwd_pkt_len_mean=64.0, flow_iat_mean=1.0, flow_duration=1.0, repeated=True), 1.0, "LIKELY_C2"),
])
def test_c2(spark, values, score, cls):
    row = detection.c2_scores(flows(spark, **values)).first()
    assert (row["c2_score"], row["c2_classification"]) == (score, cls)


@pytest.mark.parametrize("values,score,cls", [
    (dict(dst_port=443, total_length_of_fwd_packets=150000.0, total_length_of_bwd_packets=1000.0, fwd_packet_length_max=1460.0), 0.55, "SUSPICIOUS_EXFILTRATION"),
    (dict(dst_port=53, total_fwd_bytes=8000.0, total_bwd_bytes=200.0), 0.70, "LIKELY_EXFILTRATION"),
    (dict(dst_port=443, total_fwd_bytes=60000.0, total_bwd_bytes=0.0), 0.40, "SUSPICIOUS_EXFILTRATION"),
    (dict(dst_port=443, total_fwd_bytes=6000.0, total_bwd_bytes=1500.0), 0.20, "NORMAL"),
])
def test_exfiltration(spark, values, score, cls):
    row = detection.exfil_scores(flows(spark, **values)).first()
    assert (row["exfil_score"], row["exfil_classification"]) == (score, cls)


def test_text_port_and_absent_measures(spark):
    df = spark.createDataFrame([("6667",), ("6667.0",)], "dst_port string")
    assert [r["c2_score"] for r in detection.c2_scores(df).collect()] == [0.35, 0.0]


def test_dga(spark):
    names = spark.createDataFrame([("google.com",), ("A8f9x11z99q12p33w.ru ",), ("v189zkqa.biz",), ("",), (None,)], "domain string")
    got = {r["domain"]: r for r in detection.dga_scores(names).collect()}
    assert got["google.com"]["dga_score"] == 0.0 and got["google.com"]["classification"] == "NORMAL"
    assert got["a8f9x11z99q12p33w.ru"]["dga_score"] == 0.8 and got["a8f9x11z99q12p33w.ru"]["classification"] == "LIKELY_DGA"
    assert got["v189zkqa.biz"]["dga_score"] == 0.35
    assert got[""]["dga_score"] == 0.0 and got[None]["dga_score"] == 0.0


def test_entropy_and_ngrams(spark):
    df = spark.createDataFrame([("",), ("a",), ("aaaaa",), ("abababab",), ("zx918qka741mzn",), (None,)], "t string")
    got = [r[0] for r in df.select(text.entropy(F.col("t"))).collect()]
    assert got[:3] == [0.0, 0.0, 0.0] and got[3] == pytest.approx(1.0) and got[4] > 3 and got[5] == 0.0
    stats = text.ngram_stats(F.col("t"))
    row = spark.createDataFrame([("example",)], "t string").select(*[c.alias(n) for n, c in stats.items()]).first()
    assert [row[f"ngram_{n}_total_count"] for n in (2, 3, 4)] == [6, 5, 4] and row["ngram_2_unique_count"] == 6
    empty = df.where("t = ''").select(*[c.alias(n) for n, c in stats.items()]).first()
    assert set(empty) == {0}
    grams = spark.createDataFrame([("test",)], "t string").select(text.ngrams(F.col("t"), 2).alias("a"), text.ngrams(F.col("t"), 3).alias("b")).first()
    assert grams["a"] == ["te", "es", "st"] and grams["b"] == ["tes", "est"]


def test_domain_features(spark):
    df = spark.createDataFrame([("v189zkqa.biz",), ("",)], "d string")
    a, b = df.select(*[c.alias(n) for n, c in text.domain_features(F.col("d")).items()]).collect()
    assert (a["domain_length"], a["main_label_length"], a["num_digits"]) == (12, 8, 3) and a["domain_entropy"] > 3.0
    assert b["domain_length"] == 0 and b["domain_entropy"] == 0.0


def test_flow_behaviour(spark):
    schema = "packets_out int, packets_in int, bytes_out long, bytes_in long, packet_lengths array<double>, inter_arrival_times array<double>"
    df = spark.createDataFrame([
        (50, 10, 500000, 10000, [1000.0] * 5, [2.0] * 5), (None, None, None, None, None, None), (1, 1, 5, 0, [], [1.0, 3.0]),
    ], schema)
    a, b, c = behaviour.from_arrays(df).collect()
    assert (a["total_packets"], a["upload_download_ratio"], a["periodicity_cov"], a["packet_length_mean"]) == (60, 50.0, 0.0, 1000.0)
    assert b["total_packets"] == 0 and b["periodicity_cov"] == flow.NO_PERIODICITY
    assert c["periodicity_cov"] == 0.5


def test_addresses(spark):
    ips = {
        "10.0.0.5": "IPv4", " 10.0.0.5 ": "IPv4", "010.0.0.1": None, "256.1.1.1": None, "1.2.3": None, "::1": "IPv6", "::": "IPv6",
        "2001:db8::8a2e:370:7334": "IPv6", "1:2:3:4:5:6:7:8": "IPv6", "1:2:3:4:5:6:7::": "IPv6", "1:2:3:4:5:6:7:8::": None,
        "1::2::3": None, "::ffff:10.0.0.1": "IPv6", "fe80::1%eth0": "IPv6", "12345::": None, "host": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in ips], "ip string")
    got = {r["ip"]: r["k"] for r in df.select("ip", network.ip_kind(F.col("ip")).alias("k")).collect()}
    assert got == ips
    subs = {"10.0.1.9": "10.0.1.0/24", "8.8.8.8": "8.8.8.0/24", "100.64.0.1": None, "100.127.1.1": None, "100.128.1.1": "100.128.1.0/24",
            "100.63.0.1": "100.63.0.0/24", "::1": None, "127.0.0.1": "127.0.0.0/24"}
    df = spark.createDataFrame([(k,) for k in subs], "ip string")
    assert {r["ip"]: r["s"] for r in df.select("ip", network.subnet24(F.col("ip")).alias("s")).collect()} == subs


def test_endpoints(spark):
    df = spark.createDataFrame(
        [("", "10.0.0.1", 0, "443"), (None, None, None, "80.0"), ("1.1.1.1", "x", 53, "1"), ("", "", 0, "0")],
        "src_ip string, `Source IP` string, dst_port int, `Destination Port` string")
    got = detection.endpoints(df, {"s": ["src_ip", "Source IP"], "a_port": ["dst_port", "Destination Port"]}).select("s", "a_port").collect()
    assert [tuple(r) for r in got] == [("10.0.0.1", 443), (None, None), ("1.1.1.1", 53), (None, 0)]


def test_fusion(spark):
    rows = [("DDOS", 0.7, "BENIGN", 0.9, "DDOS"), ("DDOS", 0.69, "BENIGN", 0.9, "BENIGN"), ("DDOS", 0.9, "BOTNET", 0.5, "BOTNET"),
            ("BENIGN", 0.9, "BENIGN", 0.8, "BENIGN"), (None, None, "BENIGN", 0.8, "BENIGN")]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "m3_class string, m3_confidence double, m4_class string, m4_confidence double, want string, m4_anomaly double")
    for r in detection.fuse(df).collect():
        assert r["threat_class"] == r["want"]
        assert r["confidence"] == (r["m3_confidence"] if r["want"] == "DDOS" else r["m4_confidence"])


def test_anomaly_level(spark):
    df = spark.createDataFrame([(-0.9,), (-0.4,), (-0.65,), (-2.0,), (0.0,)], "raw double")
    got = [r[0] for r in df.select(flow.anomaly_level(F.col("raw"), -0.9, -0.4)).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.5, 1.0, 0.0])
    assert spark.range(1).select(flow.anomaly_level(F.lit(3.0), 3.0, 3.0)).first()[0] == 0.0
