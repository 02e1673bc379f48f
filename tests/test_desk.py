"""Alert desk, answers, prompts."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from threatlake.contracts import ALERT_SCHEMA, ANALYSIS_FIELDS, CORRELATION_FIELDS
from threatlake.operators import alerts as desk, answers
from threatlake.plans.desk import accept
from threatlake.sources import alerts as source

VALID = {
    "alert_id": "ALT-40", "timestamp": "2031-02-11T07:45:30Z", "threat": "Brute Force", "severity": "MEDIUM", "confidence": 0.61,
    "source_ip": "10.4.7.33", "destination_ip": "172.20.0.9", "source_port": 50112, "destination_port": 3389, "protocol": "OTHER",
    "mitre": {"tactic": "Credential Access", "technique": "T1110.003", "technique_name": "Password Spraying"}, "evidence": {"attempts": 48, "note": "y"},
}


def changed(**kw):
    out = copy.deepcopy(VALID)
    for k, v in kw.items():
        if v is ...:
            del out[k]
        else:
            out[k] = v
    return out


CASES = [
    (VALID, []), (changed(threat=...), ["missing:threat"]), (changed(threat=..., alert_id="x"), ["missing:threat"]),
    (changed(severity="EXTREME"), ["severity"]), (changed(severity="high"), ["severity"]), (changed(confidence=1.5), ["confidence"]),
    (changed(confidence="0.5"), ["confidence"]), (changed(confidence=True), ["confidence"]), (changed(confidence=1), []),
    (changed(alert_id="INVALID-ID"), ["alert_id"]), (changed(alert_id=5), ["alert_id"]), (changed(timestamp="soon"), ["timestamp"]),
    (changed(timestamp="2031-02-11T14:00:00+00:00"), []), (changed(timestamp="2031-02-11"), []), (changed(timestamp="2031-13-02T14:00:00Z"), ["timestamp"]),
    (changed(timestamp=None), ["timestamp"]), (changed(threat="  "), ["threat"]), (changed(source_ip=7), ["source_ip"]), (changed(destination_ip=""), ["destination_ip"]),
    (changed(source_port=70000), ["source_port"]), (changed(source_port="80"), ["source_port"]), (changed(destination_port=80.5), ["destination_port"]),
    (changed(destination_port=-1), ["destination_port"]), (changed(protocol="ARP"), ["protocol"]), (changed(mitre="T1046"), ["mitre"]),
    (changed(mitre={"tactic": "x", "technique": "T1046.001"}), ["missing:mitre.technique_name"]),
    (changed(mitre={**VALID["mitre"], "technique": "X1"}), ["mitre.technique"]), (changed(evidence=[]), ["evidence"]), (changed(evidence={}), []),
    (changed(severity="LOWER", protocol=None, evidence=3), ["severity", "protocol", "evidence"]),
]


def bodies(spark, docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "arrival_seq long, body string")


def test_contract(spark):
    rows = desk.validate_bodies(bodies(spark, [c[0] for c in CASES])).orderBy("arrival_seq").collect()
    for row, (doc, want) in zip(rows, CASES):
        assert row["errors"] == want, doc
    odd = desk.validate_bodies(bodies(spark, ["not json", "[1, 2]", "null", "", json.dumps(VALID) + " tail", json.dumps(VALID) + json.dumps(VALID), json.dumps(VALID) + "," + json.dumps(VALID)])).collect()
    assert {tuple(r["errors"]) for r in odd} == {("not_object",)}


def test_accept(spark):
    good, bad = accept(bodies(spark, [VALID, changed(threat=...), changed(alert_id="ALT-1", severity="LOW")]))
    assert {r["alert_id"]: r["evidence"]["attempts"] for r in good.collect()} == {"ALT-40": "48", "ALT-1": "48"}
    assert bad.count() == 1


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(f"ALT-{i}", i, ("HIGH", "LOW", "CRITICAL")[i % 3], ("Port Scan", "DDoS", None)[i % 3]) for i in range(9)]
    return spark.createDataFrame(rows, "alert_id string, arrival_seq long, severity string, threat string")


def test_reads_and_stats(spark, stored):
    assert [r["arrival_seq"] for r in desk.newest(stored).collect()] == list(range(8, -1, -1))
    assert desk.by_severity(stored, "high").count() == 3 and desk.by_severity(stored, "MEDIUM").isEmpty()
    assert desk.by_id(stored, "ALT-4").first()["arrival_seq"] == 4 and desk.by_id(stored, "ALT-99").isEmpty()
    assert desk.by_threat(stored, "DDOS").count() == 3
    assert desk.stats(stored).first().asDict() == {"total_alerts": 9, "critical": 3, "high": 3, "medium": 0, "low": 3}
    assert desk.stats(stored.where("false")).first()["total_alerts"] == 0
    histogram = desk.threat_histogram(stored)
    assert {r["threat"]: r["n"] for r in histogram.collect()} == {"Port Scan": 3, "DDoS": 3, "Unknown": 3}
    assert {r["threat"]: r["n"] for r in histogram.collect()}["DDoS"] == 3
    assert [r["alert_id"] for r in desk.first_rows(stored, "arrival_seq", 2).collect()] == ["ALT-0", "ALT-1"]


def test_append(spark, stored):
    incoming = spark.createDataFrame(
        [("ALT-3", 20, "LOW", "a"), ("ALT-50", 22, "LOW", "second"), ("ALT-50", 21, "HIGH", "first"), ("ALT-51", 23, "LOW", "b")], stored.schema)
    fresh = {r["alert_id"]: r["threat"] for r in desk.new_alerts(stored, incoming).collect()}
    assert fresh == {"ALT-50": "first", "ALT-51": "b"}
    assert desk.append(stored, incoming).count() == 11


def test_table_life(spark, stored, tmp_path):
    path = str(tmp_path / "alerts")
    source.reset_table(stored.where("false"), path)
    assert source.seed_if_empty(stored, path) and not source.seed_if_empty(stored, path)
    more = stored.withColumn("alert_id", F.concat("alert_id", F.lit("0"))).withColumn("arrival_seq", F.col("arrival_seq") + 100)
    assert source.append_table(more, path).count() == 9
    again = spark.read.parquet(path)
    assert again.count() == again.select("alert_id").distinct().count() == 18
    assert source.append_table(more, path).isEmpty() and spark.read.parquet(path).count() == 18


def test_json_table(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([VALID, 5, changed(alert_id="ALT-2")]))
    (tmp_path / "lines.json").write_text(json.dumps(VALID) + "\n{broken\n" + json.dumps(changed(alert_id="ALT-3")) + "\n")
    lines = source.read_json(spark, str(tmp_path / "lines.json"))
    assert sorted(r["alert_id"] for r in lines.collect()) == ["ALT-3", "ALT-40"]
    objects = source.read_json_list(spark, str(tmp_path / "list.json"))
    assert [("ALT-40", 0), ("ALT-2", 2)] == [(r["alert_id"], r["arrival_seq"]) for r in objects.collect()]
    assert source.read_json_list(spark, str(tmp_path / "lines.json")).isEmpty()
    assert lines.schema == ALERT_SCHEMA


def test_worklist_and_requests(spark, stored):
    analyses = stored.where("arrival_seq < 4").select("alert_id")
    assert desk.worklist(stored, analyses).count() == 5 and desk.worklist(stored, analyses, refresh=True).count() == 9
    requests = spark.createDataFrame([("r1", "ALT-1"), ("r1", "ALT-77"), ("r2", "ALT-2")], "request_id string, alert_id string")
    got = {(r["request_id"], r["alert_id"]): (r["found"], r["too_few"]) for r in desk.resolve_ids(requests, stored).collect()}
    assert got == {("r1", "ALT-1"): (True, False), ("r1", "ALT-77"): (False, False), ("r2", "ALT-2"): (True, True)}


def test_prompts(spark):
    good, _ = accept(bodies(spark, [VALID, changed(alert_id="ALT-1")]))
    rows = good.withColumn("technique", F.col("mitre.technique"))
    one = desk.prompts(rows, ANALYSIS_FIELDS).where("alert_id = 'ALT-40'").first()["prompt"]
    for part in ("ALT-40", "Brute Force", "10.4.7.33:50112", "T1110.003", '"attempts":"48"', "investigation_priority"):
        assert part in one
    many = desk.correlation_prompt_lines(rows.withColumn("request_id", F.lit("r")), CORRELATION_FIELDS).orderBy("part", "arrival_seq").collect()
    assert len(many) == 3 and "possible_attack_chain" in many[0]["line"] and "ALT-1" in many[2]["line"]


ANALYSIS = {
    "ai_summary": "s", "threat_assessment": "t", "risk_level": "HIGH", "confidence": 0.91, "why_suspicious": ["a"], "attack_stage": "x",
    "mitre_context": {"tactic": "d"}, "recommended_actions": [], "investigation_priority": "IMMEDIATE",
}
RELATED = {"related": True, "confidence": 0.85, "summary": "s", "common_indicators": [], "possible_attack_chain": [], "recommended_actions": []}


def test_answers(spark):
    doc = json.dumps(ANALYSIS)
    texts = {
        doc: [], f"  {doc}\n": [], f"thinking...\n```json\n{{\"draft\": 1}}\n```\nso\n```JSON\n{doc}\n```\nend": [], f"```\n{doc}\n```": [],
        f"```json\n{doc}\n```\n```\nno json\n```": [], "prose": ["not_object"], "": ["not_object"], "[1]": ["not_object"],
        json.dumps({**ANALYSIS, "risk_level": "SEVERE"}): ["risk_level"], json.dumps({**ANALYSIS, "confidence": 2}): ["confidence"],
        json.dumps({**ANALYSIS, "why_suspicious": "a", "mitre_context": []}): ["why_suspicious", "mitre_context"],
        json.dumps({k: v for k, v in ANALYSIS.items() if k != "attack_stage"}): ["missing:attack_stage"],
        json.dumps({**ANALYSIS, "investigation_priority": "CRITICAL"}): ["investigation_priority"],
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in answers.validate_analyses(df).collect():
        assert row["errors"] == texts[row["text"]], row["text"]
    pairs = {json.dumps(RELATED): [], json.dumps({**RELATED, "related": "yes"}): ["related"], json.dumps({"related": True}): [
        f"missing:{f}" for f in CORRELATION_FIELDS[1:]], json.dumps({**RELATED, "confidence": -1}): ["confidence"]}
    for row in answers.validate_correlations(spark.createDataFrame([(t,) for t in pairs], "text string")).collect():
        assert row["errors"] == pairs[row["text"]]


def test_answer_documents_wraps_whole_texts(spark, sf, monkeypatch):
    from threatlake.catalog import queries as q

    seen, judge = [], answers.validate_analyses
    monkeypatch.setattr(q.answers, "validate_analyses", lambda rows: seen.append(rows) or judge(rows))
    q.answer_documents(spark, sf)
    given = {(r.conv_id, r.turn): r.text for r in q.table(spark, sf, "conversations").where("role = 'assistant'").collect()}
    wrapped = [r for r in seen[0].collect() if (r.conv_id + r.turn) % 3 == 0]
    assert wrapped and max(len(given[r.conv_id, r.turn]) for r in wrapped) > 40
    for r in wrapped:
        assert json.loads(r.text.split("```json\n")[1].rsplit("\n```", 1)[0])["ai_summary"] == given[r.conv_id, r.turn]
