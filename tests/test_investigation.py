"""Indicators, reputation, correlation and incidents against plain-Python counts."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threatlake.contracts import EVENT_SCHEMA
from threatlake.operators import correlate, enrichment, incidents as inc
from threatlake.plans.investigate import investigate
from threatlake.sources import intel as intel_source

T0 = datetime(2024, 5, 1)
INTEL = [
    ("IPv4", "10.0.0.5", "MALICIOUS", 0.87), ("IPv4", "172.22.3.8", "SUSPICIOUS", 0.66), ("IPv4", "9.9.9.9", "BENIGN", 0.9),
    ("Domain", "bad.example.com", "MALICIOUS", 0.98), ("Domain", "tie.example.com", "SUSPICIOUS", 0.87), ("Hash", "abc", "MALICIOUS", 1.0),
    ("IPv4", "6.6.6.6", "MALICIOUS", 0.0),
]


@pytest.fixture(scope="module")
def intel(spark):
    return spark.createDataFrame(INTEL, "ioc_type string, value string, reputation string, confidence double")


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def event(i, seconds, src, dst="10.9.9.9", port=80, cls="PORT_SCAN", conf=0.9, anom=0.1):
    return (f"e{i}", i, T0 + timedelta(seconds=seconds), src, dst, port, cls, conf, anom)


@pytest.fixture(scope="module")
def mixed(spark):
    """One source owns half of the rows; times run against arrival now and then."""
    rows = []
    for i in range(600):
        src = "10.0.0.5" if i % 2 else f"10.0.{i % 5}.{i % 7}"
        rows.append(event(i, (i * 97) % 20000, src, f"10.9.9.{i % 3}", (80, 22, 6667)[i % 3],
                          ("BENIGN", "DDOS", "BOTNET", "WEB_ATTACK")[i % 4], 0.5 + (i % 50) / 100, (i % 100) / 100))
    rows += [event(600, 5, None), event(601, 6, "")]
    return rows


def test_indicators(spark):
    base = events(spark, [event(1, 0, "10.0.0.5", "10.0.0.5", 443)])
    more = base.withColumn("domain", F.lit(" Evil.Example.COM ")).withColumn("file_hash", F.lit("ABC"))
    got = [(r["slot"], r["ioc_type"], r["value"]) for r in enrichment.extract_iocs(more).orderBy("slot").collect()]
    assert got == [(0, "IPv4", "10.0.0.5"), (1, "Port", "443"), (2, "Domain", "evil.example.com"), (3, "Hash", "abc")]
    odd = events(spark, [event(1, 0, "not-an-ip", "fe80::1", None)]).withColumn("domain", F.lit("fe80::1"))
    assert [(r["ioc_type"], r["value"]) for r in enrichment.extract_iocs(odd).collect()] == [("IPv6", "fe80::1")]


@pytest.mark.parametrize("src,dst,domain,digest,want,conf", [
    ("10.0.0.5", "172.22.3.8", None, None, "MALICIOUS", 0.87), ("172.22.3.8", "1.1.1.1", None, None, "SUSPICIOUS", 0.66),
    ("172.22.3.8", "10.0.0.5", None, None, "MALICIOUS", 0.87), ("9.9.9.9", "1.1.1.1", None, None, "BENIGN", 0.0),
    ("1.1.1.1", "1.1.1.2", None, None, "UNKNOWN", 0.0), ("6.6.6.6", "9.9.9.9", None, None, "BENIGN", 0.0),
    ("6.6.6.6", "1.1.1.1", None, None, "UNKNOWN", 0.0), ("10.0.0.5", "1.1.1.1", "tie.example.com", None, "MALICIOUS", 0.87),
    ("1.1.1.1", "1.1.1.2", "BAD.example.com", "ABC", "MALICIOUS", 1.0), ("1.1.1.1", "1.1.1.2", "tie.example.com", None, "SUSPICIOUS", 0.87),
])
def test_reputation(spark, intel, src, dst, domain, digest, want, conf):
    df = events(spark, [event(1, 0, src, dst)]).withColumn("domain", F.lit(domain).cast("string")).withColumn("file_hash", F.lit(digest).cast("string"))
    row = enrichment.with_reputation(df, intel).first()
    assert (row["reputation"], row["intel_confidence"]) == (want, conf)
    iocs = enrichment.enrich_iocs(enrichment.extract_iocs(df), intel)
    assert row["ioc_count"] == iocs.count()
    assert {r["intel_status"] for r in iocs.where("ioc_type = 'Port'").collect()} == {"not_applicable"}


def test_reputation_without_broadcast(spark, intel, mixed):
    """The same answer when the reputation table is too large to broadcast."""
    df = events(spark, mixed)
    small = {r["event_id"]: r["reputation"] for r in enrichment.with_reputation(df, intel).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = {r["event_id"]: r["reputation"] for r in enrichment.with_reputation(df, intel).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert small == big and len(small) == len(mixed)


def test_lookup(spark, intel):
    df = spark.createDataFrame([(" 10.0.0.5",), ("BAD.example.com",), ("1.1.1.1",)], "value string")
    got = {r["value"].strip(): (r["matched_as"], r["reputation"]) for r in enrichment.lookup(df, intel).collect()}
    assert got == {"10.0.0.5": ("ip", "MALICIOUS"), "BAD.example.com": ("domain", "MALICIOUS"), "1.1.1.1": ("none", "UNKNOWN")}


def test_intel_documents(spark, tmp_path):
    (tmp_path / "ips.json").write_text(json.dumps({"10.0.0.5": {"ip": "10.0.0.5", "reputation": "MALICIOUS", "confidence": 0.87,
                                       "source": "demo", "categories": ["Botnet"], "threat_actor": "x"}, "::1": {"reputation": "BENIGN"}}))
    (tmp_path / "domains.json").write_text("{broken")
    (tmp_path / "hashes.json").write_text(json.dumps({"known_hashes": {"abc": {"type": "SHA256", "reputation": "MALICIOUS", "confidence": 1.0}}}))
    table = intel_source.read_intel(spark, *[str(tmp_path / f"{n}.json") for n in ("ips", "domains", "hashes")])
    got = {r["value"]: r for r in table.collect()}
    assert set(got) == {"10.0.0.5", "::1", "abc"} and got["10.0.0.5"]["categories"] == ["Botnet"]
    assert got["::1"]["ioc_type"] == "IPv6" and got["abc"]["hash_type"] == "SHA256" and got["::1"]["confidence"] == 0.0
    missing = intel_source.read_intel(spark, str(tmp_path / "nothing.json"))
    assert missing.isEmpty()
    other = intel_source.conform(spark.createDataFrame([("IPv4", "1.1.1.1", "BENIGN", 0.5)], "ioc_type string, value string, reputation string, confidence double"))
    assert other.columns == table.columns


def test_groups_and_rollup(spark, mixed):
    df = events(spark, mixed)
    got = {r["group_id"]: r for r in correlate.correlation_groups(df).collect()}
    by = {}
    for r in mixed:
        by.setdefault(r[3] or "unknown-entity", []).append(r)
    assert {k[4:] for k in got} == set(by)
    for key, rows in by.items():
        row, classes = got[f"grp-{key}"], []
        for r in rows:
            if r[6] not in classes:
                classes.append(r[6])
        assert row["event_count"] == len(rows) and row["threat_classes"] == classes
        assert (row["first_seen"], row["last_seen"]) == (rows[0][2], rows[-1][2])
    tracked = {r["entity_key"]: r for r in correlate.entity_rollup(df).collect()}
    assert set(tracked) == set(by) - {"unknown-entity"}
    assert correlate.group_events(df).count() == len(mixed)
    assert correlate.entity_events(df).count() == len(mixed) - len(by["unknown-entity"])


def test_chain_running_and_incident(spark, intel, mixed):
    done = investigate(events(spark, mixed), intel)
    by = {}
    for r in mixed:
        by.setdefault(r[3] or "unknown-entity", []).append(r)
    chain = {}
    for r in done.chain.collect():
        chain.setdefault(r["entity_key"], {})[r["stage_id"]] = (r["event_id"], r["stage_status"], r["technique_id"])
    running = {r["event_id"]: (r["events_so_far"], r["risk_score"]) for r in done.running.collect()}
    latest = {r["source_entity"]: r for r in done.incidents.collect()}
    lines = {}
    for r in done.timeline.collect():
        lines.setdefault(r["entity_key"], {})[r["position"]] = (r["event_id"], r["risk_score"])
    for key, rows in by.items():
        ordered = sorted(rows, key=lambda r: (r[2], r[1]))
        assert [chain[key][i + 1][0] for i in range(len(rows))] == [r[0] for r in ordered]
        assert [chain[key][i + 1][1] for i in range(len(rows))] == ["OBSERVED"] + ["CORRELATED"] * (len(rows) - 1)
        for n, r in enumerate(rows):
            assert running[r[0]][0] == n + 1
        row = latest[key]
        assert row["risk_score"] == running[rows[-1][0]][1] and row["event_count"] == len(rows)
        assert row["primary_class"] == rows[0][6] and row["target_entity"] == rows[0][4]
        assert row["incident_id"] == "inc-" + key.replace(".", "-")
        assert [lines[key][i + 1] for i in range(len(rows))] == [(r[0], row["risk_score"]) for r in ordered]
    empty = inc.chain_with_techniques(done.events, intel, attach=False)
    assert empty.where("technique_id IS NOT NULL").isEmpty()
    one = inc.lookup_incident(done.incidents, "inc-10-0-0-5").collect()
    assert len(one) == 1 and inc.explain(done.scored).count() == len(by) and inc.explain_events(done.events).count() == len(mixed)


def test_unreadable_times_come_first(spark):
    rows = [event(1, 50, "10.0.0.1"), event(2, 10, "10.0.0.1"), (*event(3, 0, "10.0.0.1")[:2], None, *event(3, 0, "10.0.0.1")[3:])]
    chain = correlate.attack_chain(events(spark, rows)).orderBy("stage_id").collect()
    assert [r["event_id"] for r in chain] == ["e3", "e2", "e1"]


def test_time_links(spark, mixed):
    df = events(spark, mixed)
    by, near = {}, {}
    for r in mixed:
        if r[3]:
            by.setdefault(r[3], []).append(r)
    want_pairs, want_counts, want_sessions = set(), {}, {}
    for key, rows in by.items():
        ordered = sorted(rows, key=lambda r: (r[2], r[1]))
        sessions = 1
        for a, b in zip(ordered, ordered[1:]):
            if b[2] - a[2] <= timedelta(seconds=300):
                want_pairs.add((a[0], b[0]))
            else:
                sessions += 1
        want_sessions[key] = sessions
        for r in rows:
            want_counts[r[0]] = sum(1 for o in rows if timedelta(0) <= r[2] - o[2] <= timedelta(seconds=300))
    known = df.where("src_ip <> ''")
    pairs = correlate.window_pairs(known)
    assert {(r["previous"]["event_id"], r["event"]["event_id"]) for r in pairs.collect()} == want_pairs
    assert {r["event_id"]: r["recent_count"] for r in correlate.sliding_count(known).collect()} == want_counts
    for block in (300, 4000):
        counts = correlate.recent_counts(known, 300, block)
        assert counts.agg(F.sum("n")).first()[0] == sum(map(len, by.values()))
        assert counts.agg(F.max("recent_count")).first()[0] == max(want_counts.values())
    sessions = correlate.session_groups(known).groupBy("src_ip").agg(F.max("session_no").alias("n"), F.sum("event_count").alias("m")).collect()
    assert {r["src_ip"]: r["n"] for r in sessions} == want_sessions
    assert {r["src_ip"]: r["m"] for r in sessions} == {k: len(v) for k, v in by.items()}


@pytest.mark.parametrize("a,b,want", [
    (("10.0.0.1", "1.1.1.1", 80), ("10.0.0.1", "1.1.1.1", 22), "STRONG"), (("10.0.0.1", "1.1.1.1", 80), ("10.0.0.1", "1.1.1.2", 80), "MODERATE"),
    (("10.0.0.1", "1.1.1.1", 80), ("10.0.0.1", "1.1.1.2", 22), "EXACT_ENTITY"), (("10.0.0.1", "1.1.1.1", 80), ("10.0.0.2", "1.1.1.1", 80), "WEAK"),
    (("10.0.0.1", "1.1.1.1", 80), ("10.0.1.1", "1.1.1.1", 80), "NONE"), ((None, "1.1.1.1", 80), (None, "1.1.1.1", 80), "NONE"),
    (("host", None, None), ("host", None, None), "EXACT_ENTITY"), (("100.64.0.1", "x", 1), ("100.64.0.2", "x", 1), "NONE"),
    (("10.0.0.1", "", 0), ("10.0.0.1", "", 0), "EXACT_ENTITY"),
])
def test_strength(spark, a, b, want):
    part = "struct<src_ip: string, dst_ip: string, dst_port: int>"
    df = spark.createDataFrame([(a, b)], f"l {part}, r {part}")
    assert df.select(correlate.entity_strength("l", "r")).first()[0] == want


def test_timeline_filter(spark, intel, mixed):
    line = investigate(events(spark, mixed), intel).timeline
    assert inc.filter_timeline(line).count() == len(mixed)
    assert inc.filter_timeline(line, threat_class="ddos").count() == sum(r[6] == "DDOS" for r in mixed)
    assert inc.filter_timeline(line, src_ip="10.0.0.5").count() == sum(r[3] == "10.0.0.5" for r in mixed)
    assert {r[0] for r in inc.filter_timeline(line, min_severity="HIGH").select("severity").distinct().collect()} <= {"HIGH", "CRITICAL"}


def test_repeated_intel_rows_multiply_nothing(spark):
    rows = [("IPv4", "10.0.0.5", "BENIGN", 0.4, "a"), ("IPv4", "10.0.0.5", "MALICIOUS", 0.9, "b"), ("IPv6", "10.0.0.5", "SUSPICIOUS", 0.1, "a"), ("IPv4", "10.0.0.5", "SUSPICIOUS", 0.2, "b")]
    table = spark.createDataFrame(rows, "ioc_type string, value string, reputation string, confidence double, source string")
    seen = events(spark, [event(i, i, "10.0.0.5") for i in range(4)])
    assert enrichment.with_reputation(seen, table).count() == 4
    assert {r["event_count"] for r in inc.incidents(inc.investigated(seen, table)).collect()} == {4}
    found = enrichment.enrich_iocs(enrichment.extract_iocs(seen), table).where("value = '10.0.0.5'").collect()
    assert len(found) == 4 and {(r["reputation"], r["intel_confidence"], r["intel"]["source"]) for r in found} == {("SUSPICIOUS", 0.2, "b")}
    assert enrichment.lookup(seen.select(F.col("src_ip").alias("value")), table).count() == 4
    one = enrichment.unique_intel(table.where("ioc_type = 'IPv4'")).first()
    assert (one["reputation"], one["confidence"]) == ("SUSPICIOUS", 0.2)


def test_entity_pairs_climb_the_ladder(spark):
    """Two sources of one /24 take turns, each repeating its own target."""
    seen = events(spark, [event(i, i, f"10.0.0.{5 + i % 2}", dst=f"10.9.9.{i % 2}") for i in range(6)])
    got = {r["event"]["event_id"]: (r["previous"]["event_id"], r["strength"]) for r in correlate.entity_pairs(seen).collect()}
    assert got == {"e1": ("e0", "WEAK"), **{f"e{i}": (f"e{i - 2}", "STRONG") for i in range(2, 6)}}


def test_entity_pairs_against_all_pairs(spark, mixed):
    seen = events(spark, mixed)
    rows = seen.collect()
    order = {"STRONG": 0, "MODERATE": 1, "EXACT_ENTITY": 2, "WEAK": 3}
    net = lambda ip: ip.rsplit(".", 1)[0]
    want = {}
    for b in rows:
        for a in rows:
            if a["ts"] is None or b["ts"] is None or not a["src_ip"] or not b["src_ip"] or (a["ts"], a["arrival_seq"]) >= (b["ts"], b["arrival_seq"]):
                continue
            if (b["ts"] - a["ts"]).total_seconds() > 300:
                continue
            same = a["src_ip"] == b["src_ip"]
            step = ("STRONG" if same and a["dst_ip"] == b["dst_ip"] else "MODERATE" if same and a["dst_port"] == b["dst_port"] and a["dst_port"] else
                    "EXACT_ENTITY" if same else "WEAK" if net(a["src_ip"]) == net(b["src_ip"]) else None)
            if step and (b["event_id"] not in want or order[step] < order[want[b["event_id"]]]):
                want[b["event_id"]] = step
    got = [(r["event"]["event_id"], r["strength"]) for r in correlate.entity_pairs(seen).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_events_without_time_are_in_no_session(spark):
    seen = events(spark, [("a", 1, T0, "10.0.0.1", "x", 1, "DDOS", 0.9, 0.1), *[(f"n{i}", i, None, "10.0.0.1", "x", 1, "DDOS", 0.9, 0.1) for i in (2, 3)]])
    assert [r["event_count"] for r in correlate.session_groups(seen).collect()] == [1]
