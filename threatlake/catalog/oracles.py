"""SQL twins of the registered queries, over the same tables registered under their own names."""

from __future__ import annotations

from threatlake.adapters import sql_text
from threatlake.catalog.queries import ADDRESSES, ENDPOINT_VARIANTS, LOG_GAP, LOG_LATENESS
from threatlake.contracts import ANALYSIS_FIELDS, CORE_FEATURES, CORRELATION_FIELDS
from threatlake.operators.alerts import ASK_MANY, ASK_ONE

EVENTS, FLOWS, DIRTY, FULL = sql_text("threat_events"), sql_text("flows"), sql_text("flows_dirty"), sql_text("full_flows")
DESK, DOMAINS, INTEL, PREDICTED = (sql_text(n) for n in ("desk_alerts", "domains", "intel", "predicted_flows"))


def _decision(cls: str, conf: str, anom: str) -> str:
    return f"""CASE WHEN {anom} >= 0.7 THEN CASE WHEN {cls} <> 'BENIGN' AND {conf} >= 0.8 THEN 'MALICIOUS' ELSE 'ANOMALOUS' END
  WHEN {cls} <> 'BENIGN' AND {conf} >= 0.8 THEN 'MALICIOUS'
  WHEN {cls} <> 'BENIGN' AND {conf} < 0.8 THEN 'SUSPICIOUS'
  WHEN {cls} = 'BENIGN' AND {conf} >= 0.8 AND {anom} < 0.7 THEN 'BENIGN' ELSE 'SUSPICIOUS' END"""


SEVERITY = """CASE decision WHEN 'BENIGN' THEN 'INFO' WHEN 'SUSPICIOUS' THEN 'LOW' WHEN 'ANOMALOUS' THEN 'MEDIUM'
  ELSE CASE WHEN threat_class IN ('DDOS','DOS','BOTNET','BRUTE_FORCE','INFILTRATION') THEN 'CRITICAL' ELSE 'HIGH' END END"""

DECIDED = f"""e AS ({EVENTS}),
d AS (SELECT *, {_decision('threat_class', 'confidence', 'anomaly_score')} AS decision FROM e),
s AS (SELECT *, {SEVERITY} AS severity FROM d)"""

FUSED = f"""p AS ({PREDICTED}),
f AS (SELECT *, m3_class IN ('DDOS','PORT_SCAN') AND coalesce(m3_confidence, 0) >= 0.7 AND m4_class = 'BENIGN' AS m3_wins FROM p),
u AS (SELECT *, CASE WHEN m3_wins THEN m3_class ELSE m4_class END AS threat_class,
  CASE WHEN m3_wins THEN m3_confidence ELSE m4_confidence END AS confidence, m4_anomaly AS anomaly_score FROM f),
ud AS (SELECT *, {_decision('threat_class', 'confidence', 'anomaly_score')} AS decision FROM u),
us AS (SELECT *, {SEVERITY} AS severity FROM ud)"""

# indicator rows per event; the addresses of the adapter are all valid
IOCS = f"""i0 AS (SELECT event_id, ts, confidence, 0 AS ord, 'IPv4' AS ioc_type, src_ip AS value FROM e
  UNION ALL SELECT event_id, ts, confidence, 1, 'IPv4', dst_ip FROM e WHERE dst_ip <> src_ip
  UNION ALL SELECT event_id, ts, confidence, 2, 'Port', CAST(dst_port AS VARCHAR) FROM e
  UNION ALL SELECT event_id, ts, confidence, 3, 'Domain', lower(trim(domain)) FROM e
    WHERE trim(domain) <> '' AND lower(trim(domain)) NOT IN (src_ip, dst_ip)
  UNION ALL SELECT event_id, ts, confidence, 4, 'Hash', lower(trim(file_hash)) FROM e WHERE trim(file_hash) <> ''),
ioc AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ord) - 1 AS slot FROM i0),
intel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ioc_type, value ORDER BY source DESC NULLS LAST) AS pick FROM ({INTEL}) i) x WHERE pick = 1),
ien AS (SELECT ioc.event_id, ioc.slot, ioc.ord, ioc.ioc_type, ioc.value,
  CASE WHEN intel.value IS NOT NULL THEN 'found' WHEN ioc.ioc_type = 'Port' THEN 'not_applicable' ELSE 'not_found' END AS intel_status,
  coalesce(intel.reputation, 'UNKNOWN') AS reputation, coalesce(intel.confidence, 0.0) AS intel_confidence,
  coalesce(intel.source, 'none') AS intel_source, coalesce(intel.threat_actor, 'none') AS threat_actor
  FROM ioc LEFT JOIN intel ON ioc.ioc_type = intel.ioc_type AND ioc.value = intel.value),
top AS (SELECT event_id, count(*) AS ioc_count,
  max(CASE WHEN reputation IN ('MALICIOUS','SUSPICIOUS') THEN intel_confidence ELSE 0.0 END) AS top_conf,
  max(CASE WHEN reputation = 'BENIGN' THEN 1 ELSE 0 END) AS any_benign FROM ien GROUP BY event_id),
win AS (SELECT event_id, reputation FROM (SELECT ien.event_id, ien.reputation,
  row_number() OVER (PARTITION BY ien.event_id ORDER BY ien.slot) AS rn
  FROM ien JOIN top ON ien.event_id = top.event_id
  WHERE ien.reputation IN ('MALICIOUS','SUSPICIOUS') AND top.top_conf > 0 AND ien.intel_confidence = top.top_conf) w WHERE rn = 1),
rep AS (SELECT top.event_id, ioc_count, top_conf AS intel_confidence,
  coalesce(win.reputation, CASE WHEN any_benign = 1 THEN 'BENIGN' ELSE 'UNKNOWN' END) AS reputation
  FROM top LEFT JOIN win ON top.event_id = win.event_id)"""

TECHNIQUE = """CASE WHEN decision = 'BENIGN' THEN NULL WHEN threat_class LIKE '%PORT\\_SCAN%' ESCAPE '\\' THEN 'T1046'
  WHEN threat_class LIKE '%BRUTE%' THEN 'T1110' WHEN threat_class LIKE '%WEB%' THEN 'T1190' WHEN threat_class LIKE '%DOS%' THEN 'T1498'
  WHEN threat_class LIKE '%BOTNET%' THEN CASE WHEN dst_port IN (80, 443, 8080, 6667) THEN 'T1071' ELSE 'NO_CONFIDENT_MAPPING' END
  WHEN threat_class LIKE '%INFILTRATION%' THEN 'NO_CONFIDENT_MAPPING' END"""
TECH_NAME = """CASE technique_id WHEN 'T1046' THEN 'Network Service Scanning' WHEN 'T1110' THEN 'Brute Force'
  WHEN 'T1190' THEN 'Exploitation of Public-Facing Application' WHEN 'T1498' THEN 'Network Denial of Service'
  WHEN 'T1071' THEN 'Application Layer Protocol' WHEN 'NO_CONFIDENT_MAPPING' THEN
  CASE threat_class WHEN 'BOTNET' THEN 'Unspecified Botnet Activity' ELSE 'Unspecified Network Infiltration' END END"""
TACTIC = """CASE technique_id WHEN 'T1046' THEN 'Discovery' WHEN 'T1110' THEN 'Credential Access' WHEN 'T1190' THEN 'Initial Access'
  WHEN 'T1498' THEN 'Impact' WHEN 'T1071' THEN 'Command and Control' WHEN 'NO_CONFIDENT_MAPPING' THEN
  CASE threat_class WHEN 'BOTNET' THEN 'Command and Control' ELSE 'Lateral Movement' END END"""

SCORED = f"""{DECIDED}, {IOCS},
t AS (SELECT s.*, {TECHNIQUE} AS technique_id, rep.reputation, rep.intel_confidence, rep.ioc_count
  FROM s JOIN rep ON s.event_id = rep.event_id),
sc AS (SELECT *, {TECH_NAME} AS technique_name, {TACTIC} AS tactic FROM t)"""


def _risk(n: str) -> str:
    return f"""round(least(greatest(0.25::DOUBLE * least(greatest(confidence * 100, 0), 100) + 0.20::DOUBLE * least(greatest(anomaly_score * 100, 0), 100)
  + 0.25::DOUBLE * CASE severity WHEN 'INFO' THEN 10::DOUBLE WHEN 'LOW' THEN 30::DOUBLE WHEN 'MEDIUM' THEN 50::DOUBLE WHEN 'HIGH' THEN 80::DOUBLE ELSE 100::DOUBLE END
  + 0.15::DOUBLE * CASE reputation WHEN 'BENIGN' THEN 0::DOUBLE WHEN 'SUSPICIOUS' THEN 60::DOUBLE WHEN 'MALICIOUS' THEN 100::DOUBLE ELSE 20::DOUBLE END
  + 0.15::DOUBLE * least({n} * 25::DOUBLE, 100), 0), 100), 2)"""


LEVEL = "CASE WHEN risk_score >= 85 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END"

RUNNING = f"""{SCORED},
r0 AS (SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING) AS events_so_far,
  count(*) OVER (PARTITION BY src_ip) AS event_count,
  row_number() OVER (PARTITION BY src_ip ORDER BY arrival_seq) AS up, row_number() OVER (PARTITION BY src_ip ORDER BY arrival_seq DESC) AS down,
  row_number() OVER (PARTITION BY src_ip ORDER BY ts, arrival_seq) AS position FROM sc),
r AS (SELECT *, {_risk('events_so_far')} AS risk_score FROM r0),
cur AS (SELECT src_ip, risk_score, event_count, ts AS updated_at, technique_id, reputation, ioc_count FROM r WHERE down = 1),
fst AS (SELECT src_ip, threat_class AS first_class, ts AS created_at, dst_ip AS target_entity FROM r WHERE up = 1),
inc AS (SELECT concat('inc-', replace(cur.src_ip, '.', '-')) AS incident_id, concat(first_class, ' from ', cur.src_ip) AS title, created_at, updated_at,
  'NEW' AS status, risk_score, {LEVEL} AS risk_level, cur.src_ip AS source_entity, target_entity, event_count,
  coalesce(technique_id, 'none') AS technique_id, reputation, ioc_count FROM cur JOIN fst ON cur.src_ip = fst.src_ip)"""

APPEND = f"""a AS ({DESK}),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY arrival_seq) AS rn FROM a WHERE protocol = 'UDP') x WHERE rn = 1),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY arrival_seq) AS rn FROM a WHERE protocol <> 'UDP') x
  WHERE rn = 1 AND alert_id NOT IN (SELECT alert_id FROM st))"""

ALERT_FAULTS = """concat_ws(',', CASE WHEN alert_id LIKE 'BAD%' THEN 'alert_id' END, CASE WHEN event_time = 'not-a-date' THEN 'timestamp' END,
  CASE WHEN severity = 'EXTREME' THEN 'severity' END, CASE WHEN confidence > 1 THEN 'confidence' END,
  CASE WHEN source_port > 65535 THEN 'source_port' END, CASE WHEN technique = 'X1' THEN 'mitre.technique' END)"""


def _n_faults(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0 ELSE length({text}) - length(replace({text}, ',', '')) + 1 END"


def _c2() -> str:
    return f"""WITH f AS ({FLOWS}),
h AS (SELECT *, count(*) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM f),
g AS (SELECT *, dst_port IN (6667,6697,4444,8443,1337,31337,5555,9001,9090) AS a, total_fwd_packets >= 5 AND fwd_pkt_len_mean > 0 AND fwd_pkt_len_mean <= 64 AS b,
  flow_iat_mean > 0 AND flow_duration > 0 AS c, earlier >= 3 AS d FROM h),
k AS (SELECT *, round(least(CASE WHEN a THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN b THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN c THEN 0.20::DOUBLE ELSE 0 END
  + CASE WHEN d THEN 0.25::DOUBLE ELSE 0 END, 1), 4) AS c2_score FROM g)
SELECT flow_id, c2_score, CASE WHEN c2_score >= 0.65 THEN 'LIKELY_C2' WHEN c2_score >= 0.35 THEN 'SUSPICIOUS_C2' ELSE 'NO_C2_EVIDENCE' END AS c2_classification,
  CASE WHEN a OR b OR c OR d THEN concat_ws(',', CASE WHEN a THEN 'c2_port' END, CASE WHEN b THEN 'small_frequent_packets' END,
  CASE WHEN c THEN 'inter_arrival' END, CASE WHEN d THEN 'repeated_connection' END) ELSE 'normal_transport' END AS c2_evidence FROM k"""


def _exfil() -> str:
    return f"""WITH f AS ({FLOWS}),
g AS (SELECT *, total_fwd_bytes > 5000 AND total_bwd_bytes > 0 AS two_way FROM f),
h AS (SELECT *, two_way AND total_fwd_bytes / nullif(total_bwd_bytes, 0) >= 10 AS a,
  two_way AND total_fwd_bytes / nullif(total_bwd_bytes, 0) >= 4 AND total_fwd_bytes / nullif(total_bwd_bytes, 0) < 10 AS b,
  NOT two_way AND total_fwd_bytes > 50000 AND total_bwd_bytes = 0 AS c, fwd_pkt_len_max >= 1400 AS d, total_fwd_bytes >= 1000000 AS x,
  dst_port = 53 AND total_fwd_bytes > 2000 AS y FROM g),
k AS (SELECT *, round(least(CASE WHEN a THEN 0.35::DOUBLE WHEN b THEN 0.20::DOUBLE WHEN c THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN d THEN 0.20::DOUBLE ELSE 0 END
  + CASE WHEN x THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN y THEN 0.35::DOUBLE ELSE 0 END, 1), 4) AS exfil_score FROM h)
SELECT flow_id, exfil_score, CASE WHEN exfil_score >= 0.65 THEN 'LIKELY_EXFILTRATION' WHEN exfil_score >= 0.35 THEN 'SUSPICIOUS_EXFILTRATION' ELSE 'NORMAL' END AS exfil_classification,
  CASE WHEN a OR b OR c OR d OR x OR y THEN concat_ws(',', CASE WHEN a THEN 'high_byte_ratio' END, CASE WHEN b THEN 'elevated_byte_ratio' END,
  CASE WHEN c THEN 'one_way_transfer' END, CASE WHEN d THEN 'large_payload' END, CASE WHEN x THEN 'high_volume' END, CASE WHEN y THEN 'dns_volume' END)
  ELSE 'normal_transfer' END AS exfil_evidence FROM k"""


NAMES = f"""n AS (SELECT lower(trim(domain)) AS domain, count(*) AS sightings FROM ({DOMAINS}) x GROUP BY 1),
ch AS (SELECT domain, unnest(string_split(domain, '')) AS c FROM n),
cc AS (SELECT domain, c, count(*) AS k, sum(count(*)) OVER (PARTITION BY domain) AS len FROM ch WHERE c <> '' GROUP BY domain, c),
en AS (SELECT domain, count(*) AS distinct_chars, -sum((k * 1.0::DOUBLE / len) * log2(k * 1.0::DOUBLE / len)) AS bits FROM cc GROUP BY domain),
df AS (SELECT n.domain, sightings, length(n.domain) AS domain_length, length(split_part(n.domain, '.', 1)) AS main_label_length,
  length(regexp_replace(n.domain, '[^0-9]', '', 'g')) AS num_digits, length(regexp_replace(n.domain, '[^aeiou]', '', 'g')) AS vowels,
  length(regexp_replace(n.domain, '[^a-z]', '', 'g')) AS letters, distinct_chars, bits FROM n JOIN en ON n.domain = en.domain),
ds AS (SELECT *, round(num_digits * 1.0::DOUBLE / domain_length, 4) AS digit_ratio, distinct_chars * 1.0::DOUBLE / domain_length AS unique_char_ratio,
  vowels * 1.0::DOUBLE / greatest(letters - vowels, 1) AS vowel_consonant_ratio FROM df)"""


def _dga() -> str:
    return f"""WITH {NAMES},
g AS (SELECT *, bits >= 4.2 AS a, bits >= 3.7 AND bits < 4.2 AS b, unique_char_ratio >= 0.75 AND main_label_length >= 10 AS c, digit_ratio >= 0.2 AS d,
  vowel_consonant_ratio < 0.25 AND main_label_length >= 8 AS x, regexp_matches(domain, '\\.(ru|xyz|top|tk|biz|info|cn|work|click)$') AS y FROM ds),
k AS (SELECT *, round(least(CASE WHEN a THEN 0.40::DOUBLE WHEN b THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN c THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN d THEN 0.20::DOUBLE ELSE 0 END
  + CASE WHEN x THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN y THEN 0.15::DOUBLE ELSE 0 END, 1), 4) AS dga_score FROM g)
SELECT domain, sightings, dga_score, CASE WHEN dga_score >= 0.65 THEN 'LIKELY_DGA' WHEN dga_score >= 0.35 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS classification,
  CASE WHEN a OR b OR c OR d OR x OR y THEN concat_ws(',', CASE WHEN a THEN 'high_entropy' END, CASE WHEN b THEN 'elevated_entropy' END,
  CASE WHEN c THEN 'unique_characters' END, CASE WHEN d THEN 'digits' END, CASE WHEN x THEN 'few_vowels' END, CASE WHEN y THEN 'suspicious_tld' END)
  ELSE 'normal_name' END AS evidence FROM k"""


def _profile() -> str:
    numeric = {"row_key": "METADATA / IDENTIFIER", "total_fwd_packets": "ML_FEATURE", "flow_duration": "ML_FEATURE",
               "fwd_pkt_len_mean": "ML_FEATURE", "urg_flag": "ML_FEATURE"}
    other = {"total_bwd_packets_text": "ML_FEATURE", "ts": "METADATA / IDENTIFIER"}
    parts = []
    for c, role in numeric.items():
        v = f"{c}::DOUBLE"
        ok = f"CASE WHEN NOT isnan({v}) AND NOT isinf({v}) THEN {v} END"
        parts.append(f"""SELECT '{c}' AS column_name, '{role}' AS role, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  count(*) FILTER (WHERE isnan({v})) AS nan_count, count(*) FILTER (WHERE isinf({v})) AS inf_count, min({ok}) AS min_value, max({ok}) AS max_value FROM x""")
    for c, role in other.items():
        parts.append(f"""SELECT '{c}', '{role}', count(*), count(*) FILTER (WHERE {c} IS NULL), 0::BIGINT, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM x""")
    return f"WITH x AS ({DIRTY}) " + " UNION ALL ".join(parts)


def _constant() -> str:
    cols = ("row_key", "total_fwd_packets", "flow_duration", "fwd_pkt_len_mean", "total_bwd_packets_text", "urg_flag", "ts")
    return f"WITH x AS ({DIRTY}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name FROM x HAVING count(DISTINCT {c}) <= 1" for c in cols)


def _impute() -> str:
    cols = ("total_fwd_packets", "flow_duration", "fwd_pkt_len_mean")
    ok = {c: f"(CASE WHEN NOT isnan({c}) AND NOT isinf({c}) THEN {c} END)" for c in cols}
    meds = ", ".join(f"median({ok[c]}) AS m_{c}" for c in cols)
    hits = " + ".join(f"CASE WHEN {ok[c]} IS NULL THEN 1 ELSE 0 END" for c in cols)
    return f"""WITH x AS ({DIRTY}), m AS (SELECT {meds} FROM x)
SELECT row_key, {hits} AS imputed, {', '.join(f'coalesce({ok[c]}, m_{c}) AS {c}' for c in cols)} FROM x, m"""


def _ngrams() -> str:
    cols = []
    for n in (2, 3, 4):
        grams = f"list_transform(range(1, length(domain) - {n} + 2), lambda i: substr(domain, i, {n}))"
        cols += [f"greatest(length(domain) - {n} + 1, 0) AS ngram_{n}_total_count", f"len(list_distinct({grams})) AS ngram_{n}_unique_count"]
    return f"SELECT domain, {', '.join(cols)} FROM (SELECT DISTINCT domain FROM ({DOMAINS}) x) y"


def _successor(key: str) -> str:
    return f"""WITH e AS ({EVENTS}), k AS (SELECT *, {key} AS entity_key FROM e),
w AS (SELECT *, lag(event_id) OVER o AS previous_id, lag(ts) OVER o AS p_ts, lag(src_ip) OVER o AS p_src, lag(dst_ip) OVER o AS p_dst, lag(dst_port) OVER o AS p_port
  FROM k WINDOW o AS (PARTITION BY entity_key ORDER BY ts, arrival_seq)),
g AS (SELECT *, epoch_us(ts) - epoch_us(p_ts) AS gap_micros FROM w WHERE previous_id IS NOT NULL)"""


def _alert_line(proof: str) -> str:
    return f"""concat(alert_id, ': ', threat, ' | ', source_ip, ':', source_port, ' -> ', destination_ip, ':', destination_port, ' | ', protocol, ' | ',
  severity, ' | ', confidence, ' | ', technique, ' | ', {proof})"""


ANSWER_FAULTS = """concat_ws(',', CASE WHEN severity = 'EXTREME' THEN 'risk_level' END, CASE WHEN confidence > 1 THEN 'confidence' END,
  CASE WHEN severity = 'EXTREME' THEN 'investigation_priority' END)"""

_TARGET = "CASE label WHEN 'DDoS' THEN 'DDOS' WHEN 'PortScan' THEN 'PORT_SCAN' WHEN 'BENIGN' THEN 'BENIGN' END"
_SPLIT = f"""t AS (SELECT {_TARGET} AS target FROM ({FLOWS}) x),
q AS (SELECT target, row_number() OVER (PARTITION BY target) - 1 AS p, count(*) OVER (PARTITION BY target) AS c FROM t),
s AS (SELECT target, CASE WHEN p * 1.0::DOUBLE / c < 0.7::DOUBLE THEN 'train' ELSE 'test' END AS split FROM q)"""

ORACLES: dict[str, str] = {
    "scan_flows": FLOWS,
    "scan_capture": f"SELECT *, (SELECT count(*) FROM ({FLOWS}) b WHERE dst_port = 22 AND total_bwd_packets = 3) AS broken FROM ({FLOWS}) f",
    "scan_alerts": DESK,
    "alert_append": f"WITH {APPEND} SELECT alert_id, arrival_seq, threat, severity FROM st UNION ALL SELECT alert_id, arrival_seq, threat, severity FROM fresh",
    "clean_headers": FLOWS,
    "select_features": f"""SELECT flow_id, flow_duration, total_fwd_packets, total_bwd_packets, total_fwd_bytes, total_bwd_bytes, fwd_pkt_len_max,
  fwd_pkt_len_mean, flow_iat_mean FROM ({FLOWS}) f""",
    "coerce_numeric": f"""SELECT row_key, coalesce(try_cast(total_bwd_packets_text AS DOUBLE), 0) AS total_bwd_packets_text,
  CASE WHEN isnan(total_fwd_packets) THEN 0 ELSE total_fwd_packets END AS total_fwd_packets, coalesce(fwd_pkt_len_mean, 0) AS fwd_pkt_len_mean FROM ({DIRTY}) x""",
    "endpoint_coalesce": f"""WITH v AS ({ENDPOINT_VARIANTS.format(flows='(' + FLOWS + ') f')}),
p AS (SELECT *, coalesce(CAST(nullif(meta_dst_port, 0) AS VARCHAR), nullif(row_dst_port, '')) AS port_text FROM v)
SELECT flow_id, coalesce(nullif(meta_src_ip, ''), nullif(row_src_ip, ''), source_ip_2) AS src_ip,
  coalesce(CASE WHEN regexp_full_match(port_text, '[0-9]+') THEN CAST(port_text AS INT) END, -1) AS dst_port FROM p""",
    "alerts_by_severity": f"SELECT arrival_seq, alert_id, severity FROM ({DESK}) a WHERE severity = 'HIGH'",
    "alert_by_id": f"SELECT arrival_seq, alert_id, severity FROM ({DESK}) a WHERE alert_id = 'ALT-8' ORDER BY arrival_seq LIMIT 1",
    "alerts_by_threat": f"SELECT arrival_seq, alert_id, threat FROM ({DESK}) a WHERE lower(threat) = 'ddos'",
    "timeline_filter": f"""WITH {DECIDED} SELECT event_id, ts, src_ip, threat_class, severity FROM s
  WHERE upper(threat_class) = 'PORT_SCAN' AND src_ip = '10.0.0.9' AND severity <> 'INFO'""",
    "validate_flows": f"""WITH x AS ({DIRTY}),
y AS (SELECT row_key, CASE WHEN total_bwd_packets_text = 'bad' THEN 'total_bwd_packets_text' ELSE '' END AS invalid_type_features,
  concat_ws(',', CASE WHEN isnan(total_fwd_packets) THEN 'total_fwd_packets' END, CASE WHEN fwd_pkt_len_mean IS NULL THEN 'fwd_pkt_len_mean' END) AS nan_features,
  CASE WHEN isinf(flow_duration) THEN 'flow_duration' ELSE '' END AS inf_features FROM x)
SELECT row_key, invalid_type_features = '' AND nan_features = '' AND inf_features = '' AS is_valid, invalid_type_features, nan_features, inf_features,
  'row_key,urg_flag,ts' AS extra_features, '' AS missing_features, 4 AS expected_feature_count, 7 AS provided_feature_count FROM y""",
    "validate_flow_documents": f"""WITH x AS ({DIRTY}),
y AS (SELECT row_key, CASE WHEN fwd_pkt_len_mean IS NULL THEN 'fwd_pkt_len_mean' ELSE '' END AS missing_features,
  CASE WHEN total_bwd_packets_text = 'bad' THEN 'total_bwd_packets_text' ELSE '' END AS invalid_type_features,
  CASE WHEN isnan(total_fwd_packets) THEN 'total_fwd_packets' ELSE '' END AS nan_features, CASE WHEN isinf(flow_duration) THEN 'flow_duration' ELSE '' END AS inf_features FROM x)
SELECT *, concat(missing_features, invalid_type_features, nan_features, inf_features) = '' AS is_valid, 'row_key,urg_flag,ts' AS extra_features,
  4 AS expected_feature_count, CASE WHEN missing_features = '' THEN 7 ELSE 6 END AS provided_feature_count FROM y""",
    "validate_alerts": f"""SELECT arrival_seq, errors, {_n_faults('errors')} AS n_errors FROM (SELECT arrival_seq, {ALERT_FAULTS} AS errors FROM ({DESK}) a) x""",
    "validate_ai_answers": f"""WITH a AS ({DESK}),
b AS (SELECT *, destination_ip LIKE '%2' AS prose, protocol = 'TCP' AS cut, {ANSWER_FAULTS} AS faults FROM a)
SELECT arrival_seq, NOT prose AS has_document,
  CASE WHEN prose THEN 'not_object' WHEN cut THEN 'missing:investigation_priority' ELSE faults END AS errors FROM b""",
    "validate_ai_correlations": f"""SELECT arrival_seq, concat_ws(',', CASE WHEN protocol = 'UDP' THEN 'related' END, CASE WHEN confidence > 1 THEN 'confidence' END) AS errors
  FROM ({DESK}) a""",
    "answer_documents": """SELECT conv_id, turn, (conv_id + turn) % 3 = 0 AS has_document,
  CASE WHEN (conv_id + turn) % 3 <> 0 THEN 'not_object' WHEN conv_id % 2 <> 0 THEN 'missing:investigation_priority' ELSE '' END AS errors
  FROM conversations WHERE role = 'assistant'""",
    "assemble_event": f"""WITH {FUSED} SELECT sha256(flow_id) AS event_id, ts AS "timestamp", threat_class, decision, confidence, anomaly_score, src_ip, dst_ip, dst_port,
  m3_class, m4_class, severity, 'NEW' AS alert_status, 'success' AS status, decision AS alert_decision, ts AS alert_time,
  CASE WHEN m4_class < 'only_m4' THEN concat(m4_class, ',only_m4') ELSE concat('only_m4,', m4_class) END AS map_classes, coalesce(m4_confidence, 0.5::DOUBLE) AS map_m4,
  CASE WHEN threat_class <> 'BENIGN' AND coalesce(confidence, 1) >= 0.8 THEN 'attack_confidence' WHEN anomaly_score >= 0.7 THEN 'anomaly'
    WHEN threat_class = 'BENIGN' AND coalesce(confidence, 1) >= 0.8 THEN 'benign_confidence' WHEN threat_class <> 'BENIGN' THEN 'attack_below_threshold'
    ELSE 'benign_below_threshold' END AS decision_reason FROM us""",
    "route_events": f"""WITH {DECIDED}, {FUSED} SELECT event_id AS id, threat_class, confidence, decision, severity FROM s
  UNION ALL SELECT flow_id, threat_class, confidence, decision, severity FROM us""",
    "incident_timeline": f"""WITH {RUNNING} SELECT concat('inc-', replace(r.src_ip, '.', '-')) AS incident_id, r.position, event_id, ts, threat_class, decision, severity,
  cur.risk_score, concat(threat_class, ' ', decision, ' port=', dst_port) AS evidence FROM r JOIN cur ON r.src_ip = cur.src_ip""",
    "incident_techniques": f"""WITH {SCORED} SELECT concat('inc-', replace(src_ip, '.', '-')) AS incident_id, technique_id, tactic, count(*) AS n
  FROM sc WHERE technique_id IS NOT NULL GROUP BY 1, 2, 3""",
    "extract_iocs": f"WITH e AS ({EVENTS}), {IOCS} SELECT event_id AS source_event_id, slot, ioc_type, value, ts AS first_seen, confidence FROM ioc",
    "ioc_enrich": f"WITH e AS ({EVENTS}), {IOCS} SELECT event_id AS source_event_id, slot, ioc_type, value, intel_status, reputation, intel_confidence, intel_source, threat_actor FROM ien",
    "ioc_lookup": f"""WITH e AS ({EVENTS}),
intel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ioc_type, value ORDER BY source DESC NULLS LAST) AS pick FROM ({INTEL}) i) x WHERE pick = 1),
v AS (SELECT src_ip AS value FROM e UNION SELECT dst_ip FROM e UNION SELECT domain FROM e WHERE domain IS NOT NULL)
SELECT v.value, CASE WHEN a.value IS NOT NULL THEN 'ip' WHEN b.value IS NOT NULL THEN 'domain' ELSE 'none' END AS matched_as,
  coalesce(a.reputation, b.reputation, 'UNKNOWN') AS reputation, coalesce(a.confidence, b.confidence, 0.0) AS intel_confidence
FROM v LEFT JOIN intel a ON a.ioc_type IN ('IPv4','IPv6') AND trim(v.value) = a.value LEFT JOIN intel b ON b.ioc_type = 'Domain' AND lower(trim(v.value)) = b.value""",
    "event_reputation": f"WITH e AS ({EVENTS}), {IOCS} SELECT event_id, reputation, intel_confidence, ioc_count FROM rep",
    "mitre_map": f"""WITH {DECIDED}, t AS (SELECT *, {TECHNIQUE} AS technique_id FROM s)
SELECT event_id, technique_id, {TECH_NAME} AS technique_name, {TACTIC} AS tactic,
  CASE WHEN technique_id = 'NO_CONFIDENT_MAPPING' THEN CASE threat_class WHEN 'BOTNET' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END
  WHEN technique_id = 'T1071' THEN round(confidence * 0.85::DOUBLE, 4) ELSE round(confidence * 0.95::DOUBLE, 4) END AS technique_confidence,
  CASE technique_id WHEN 'NO_CONFIDENT_MAPPING' THEN 'class_without_technique' WHEN 'T1071' THEN 'class_and_port' ELSE 'class' END AS mapping_basis,
  concat('class=', threat_class, CASE technique_id WHEN 'T1071' THEN concat(',dst_port=', dst_port) ELSE '' END) AS mapping_evidence
FROM t WHERE technique_id IS NOT NULL""",
    "chain_with_mitre": f"""WITH {RUNNING} SELECT src_ip AS entity_key, position AS stage_id, event_id, coalesce(technique_id, 'none') AS technique_id,
  coalesce(technique_name, 'none') AS technique_name FROM r""",
    "entity_pairs": f"""WITH e AS ({EVENTS}), k AS (SELECT *, concat(regexp_replace(src_ip, '[0-9]+$', ''), '0/24') AS entity_key FROM e),
l AS (SELECT *, lag(event_id) OVER a AS i1, lag(ts) OVER a AS t1, lag(event_id) OVER b AS i2, lag(ts) OVER b AS t2,
  lag(event_id) OVER c AS i3, lag(ts) OVER c AS t3, lag(event_id) OVER d AS i4, lag(ts) OVER d AS t4 FROM k
  WINDOW a AS (PARTITION BY src_ip, dst_ip ORDER BY ts, arrival_seq), b AS (PARTITION BY src_ip, dst_port ORDER BY ts, arrival_seq),
    c AS (PARTITION BY src_ip ORDER BY ts, arrival_seq), d AS (PARTITION BY entity_key ORDER BY ts, arrival_seq)),
g AS (SELECT *, CASE WHEN ts - t1 <= INTERVAL '300 seconds' THEN 1 WHEN ts - t2 <= INTERVAL '300 seconds' THEN 2
  WHEN ts - t3 <= INTERVAL '300 seconds' THEN 3 WHEN ts - t4 <= INTERVAL '300 seconds' THEN 4 END AS step FROM l)
SELECT entity_key, CASE step WHEN 1 THEN i1 WHEN 2 THEN i2 WHEN 3 THEN i3 ELSE i4 END AS previous_id, event_id,
  CASE step WHEN 1 THEN 'STRONG' WHEN 2 THEN 'MODERATE' WHEN 3 THEN 'EXACT_ENTITY' ELSE 'WEAK' END AS strength FROM g WHERE step IS NOT NULL""",
    "window_pairs": f"{_successor('src_ip')} SELECT entity_key, previous_id, event_id, gap_micros FROM g WHERE gap_micros <= 300000000",
    "analysis_worklist": f"WITH {APPEND} SELECT arrival_seq, alert_id FROM a WHERE protocol <> 'UDP' AND alert_id NOT IN (SELECT alert_id FROM st)",
    "resolve_ids": f"""WITH {APPEND}, q AS (SELECT DISTINCT source_ip AS request_id, alert_id FROM a WHERE protocol <> 'UDP')
SELECT request_id, alert_id, alert_id IN (SELECT alert_id FROM st) AS found, count(*) OVER (PARTITION BY request_id) < 2 AS too_few FROM q""",
    "alert_stats": f"""SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low FROM ({DESK}) a""",
    "threat_histogram": f"SELECT threat, count(*) AS n FROM ({DESK}) a GROUP BY threat",
    "entity_rollup": f"""WITH e AS ({EVENTS}) SELECT src_ip AS entity_key, 'IP' AS entity_type, count(*) AS event_count,
  string_agg(DISTINCT threat_class, ',' ORDER BY threat_class) AS threat_classes, arg_min(ts, arrival_seq) AS first_seen, arg_max(ts, arrival_seq) AS last_seen FROM e GROUP BY src_ip""",
    "entity_events": f"WITH e AS ({EVENTS}) SELECT src_ip AS entity_key, row_number() OVER (PARTITION BY src_ip ORDER BY arrival_seq) AS position, event_id FROM e",
    "correlation_groups": f"""WITH e AS ({EVENTS}),
c AS (SELECT src_ip, threat_class, min(arrival_seq) AS lo FROM e GROUP BY 1, 2),
l AS (SELECT src_ip, string_agg(threat_class, ',' ORDER BY lo) AS threat_classes FROM c GROUP BY 1),
g AS (SELECT src_ip, count(*) AS event_count, arg_min(ts, arrival_seq) AS first_seen, arg_max(ts, arrival_seq) AS last_seen FROM e GROUP BY 1)
SELECT concat('grp-', g.src_ip) AS group_id, 'EXACT_ENTITY' AS correlation_strength, event_count, threat_classes, first_seen, last_seen FROM g JOIN l ON g.src_ip = l.src_ip""",
    "decision_distribution": f"WITH {DECIDED} SELECT decision, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM s GROUP BY decision",
    "severity_distribution": f"WITH {DECIDED} SELECT severity, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM s GROUP BY severity",
    "latency_percentiles": f"""WITH f0 AS ({FLOWS}), f AS (SELECT label, ts, CASE WHEN fwd_pkt_len_max = 1599 THEN 'Infinity'::DOUBLE ELSE total_fwd_bytes END AS total_fwd_bytes FROM f0)
SELECT label, count(*) AS n, round(quantile_cont(total_fwd_bytes, 0.5), 4) AS p50, round(quantile_cont(total_fwd_bytes, 0.95), 4) AS p95,
  round(quantile_cont(total_fwd_bytes, 0.99), 4) AS p99, round(count(*) * 86400.0::DOUBLE / date_diff('second', min(ts), max(ts)), 4) AS per_day FROM f GROUP BY label""",
    "batch_quality": f"""WITH {FUSED} SELECT count(*) AS total, count(*) FILTER (WHERE m3_confidence IS NOT NULL) AS ok, count(*) FILTER (WHERE m3_confidence IS NULL) AS failed,
  count(*) FILTER (WHERE m3_confidence IS NOT NULL AND decision <> 'BENIGN') AS alerts FROM us""",
    "profile_dataset": _profile(),
    "label_distribution": f"SELECT label, count(*) AS n FROM ({FLOWS}) f GROUP BY label",
    "impute_median": _impute(),
    "dedup_exact": f"""SELECT row_key, total_bwd_packets_text, ts, count(*) AS copies FROM ({DIRTY}) x
  GROUP BY row_key, total_fwd_packets, flow_duration, fwd_pkt_len_mean, total_bwd_packets_text, urg_flag, ts""",
    "constant_columns": _constant(),
    "incidents": f"WITH {RUNNING} SELECT * FROM inc",
    "attack_chain": f"""WITH {DECIDED}, c AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts, arrival_seq) AS stage_id FROM s)
SELECT src_ip AS entity_key, stage_id, CASE WHEN stage_id = 1 THEN 'OBSERVED' ELSE 'CORRELATED' END AS stage_status, event_id, ts, threat_class, decision, severity, confidence FROM c""",
    **{q: f"WITH {RUNNING} SELECT event_id, src_ip AS entity_key, events_so_far, risk_score, {LEVEL} AS risk_level FROM r" for q in ("running_risk", "stream_running_risk")},
    "stream_late_rows": f"""WITH e AS (SELECT event_id, ts, arrival_seq % 4 AS batch FROM ({EVENTS}) x),
m AS (SELECT b AS batch, (SELECT max(ts) FROM e WHERE e.batch < b) - INTERVAL '10 minutes' AS watermark FROM range(4) t(b))
SELECT event_id, batch, CASE WHEN time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' <= watermark
  THEN strftime(watermark, '%Y-%m-%d %H:%M:%S') ELSE '' END AS missed FROM e JOIN m USING (batch)""",
    "sliding_count": f"""WITH e AS (SELECT *, epoch_us(date_trunc('second', ts)) // 1000000 AS sec FROM ({EVENTS}) x)
SELECT event_id, src_ip, count(*) OVER (PARTITION BY src_ip ORDER BY sec RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS recent_count FROM e""",
    "session_groups": f"""WITH e AS (SELECT * FROM ({EVENTS}) y WHERE arrival_seq % 37 <> 0),
b AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY src_ip ORDER BY ts)) > 300000000 THEN 1 ELSE 0 END AS brk FROM e),
n AS (SELECT *, 1 + sum(brk) OVER (PARTITION BY src_ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM b)
SELECT src_ip, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count FROM n GROUP BY 1, 2""",
    "alerts_newest": f"SELECT arrival_seq, alert_id FROM ({DESK}) a ORDER BY arrival_seq DESC",
    "head_n": f"SELECT arrival_seq, event_id FROM ({EVENTS}) e ORDER BY arrival_seq LIMIT 250",
    "decide": f"WITH {DECIDED} SELECT event_id, threat_class, decision FROM s",
    "generate_alerts": f"""WITH {DECIDED} SELECT event_id, decision, severity, CASE decision WHEN 'BENIGN' THEN 'Benign flow' WHEN 'SUSPICIOUS' THEN concat('Suspicious activity: ', threat_class)
  WHEN 'ANOMALOUS' THEN 'Traffic anomaly' ELSE concat(replace(threat_class, '_', ' '), ' attack') END AS title, 'NEW' AS status FROM s""",
    "risk_score": f"""WITH {SCORED}, r AS (SELECT *, {_risk('1')} AS risk_score FROM sc)
SELECT event_id, round(confidence * 100, 2) AS confidence_component, round(anomaly_score * 100, 2) AS anomaly_component,
  CASE severity WHEN 'INFO' THEN 10::DOUBLE WHEN 'LOW' THEN 30::DOUBLE WHEN 'MEDIUM' THEN 50::DOUBLE WHEN 'HIGH' THEN 80::DOUBLE ELSE 100::DOUBLE END AS severity_component,
  CASE reputation WHEN 'BENIGN' THEN 0::DOUBLE WHEN 'SUSPICIOUS' THEN 60::DOUBLE WHEN 'MALICIOUS' THEN 100::DOUBLE ELSE 20::DOUBLE END AS intel_component,
  25::DOUBLE AS correlation_component, risk_score, {LEVEL} AS risk_level FROM r""",
    "c2_score": _c2(),
    "exfil_score": _exfil(),
    "dga_score": _dga(),
    "fuse_predictions": f"WITH {FUSED} SELECT flow_id, threat_class, confidence, anomaly_score FROM us",
    "entropy": f"WITH {NAMES} SELECT domain, round(bits, 6) AS entropy FROM en",
    "ngram_stats": _ngrams(),
    "domain_features": f"""WITH {NAMES} SELECT domain, domain_length, main_label_length, num_digits, digit_ratio, round(unique_char_ratio, 6) AS unique_char_ratio,
  round(vowel_consonant_ratio, 6) AS vowel_consonant_ratio, round(bits, 6) AS domain_entropy FROM ds""",
    "flow_behaviour": """WITH p AS (SELECT l_orderkey AS flow_id, l_linenumber % 2 = 1 AS o, CAST(floor(l_extendedprice) AS BIGINT) AS b, l_tax * 1000 AS iat FROM lineitem),
g AS (SELECT flow_id, count(*) AS total_packets, coalesce(sum(b) FILTER (WHERE o), 0) AS bytes_out, coalesce(sum(b) FILTER (WHERE NOT o), 0) AS bytes_in,
  avg(b) AS mean_len, avg(iat) AS m, stddev_pop(iat) AS sd FROM p GROUP BY flow_id)
SELECT flow_id, total_packets, CAST(bytes_out AS BIGINT) AS bytes_out, CAST(bytes_in AS BIGINT) AS bytes_in,
  round(bytes_out::DOUBLE / greatest(bytes_in, 1), 4) AS upload_download_ratio, round(mean_len, 4) AS packet_length_mean,
  round(CASE WHEN m = 0 THEN 0 ELSE sd / m END, 4) AS periodicity_cov FROM g""",
    "subnet24": f"""WITH a AS ({ADDRESSES.format(events='events')}),
o AS (SELECT ip, CAST(split_part(ip, '.', 1) AS INT) AS a1, CAST(split_part(ip, '.', 2) AS INT) AS a2, CAST(split_part(ip, '.', 4) AS INT) AS a4 FROM a)
SELECT ip, CASE WHEN a4 <= 255 THEN 'IPv4' ELSE 'none' END AS kind,
  CASE WHEN a4 > 255 OR (a1 = 100 AND a2 BETWEEN 64 AND 127) THEN 'none' ELSE concat(regexp_replace(ip, '[0-9]+$', ''), '0/24') END AS subnet FROM o""",
    "label_taxonomy": f"""SELECT flow_id, label, CASE label WHEN 'DDoS' THEN 'DDOS' WHEN 'PortScan' THEN 'PORT_SCAN' WHEN 'BENIGN' THEN 'BENIGN' END AS target FROM ({FLOWS}) f""",
    "minmax_anomaly": f"""WITH f AS ({FLOWS}), m AS (SELECT min(total_fwd_bytes) AS lo, max(total_fwd_bytes) AS hi FROM f)
SELECT flow_id, round(least(greatest((hi - total_fwd_bytes) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 0), 1), 6) AS anomaly_level FROM f, m""",
    "stream_detect": f"""WITH {FUSED} SELECT flow_id, CASE WHEN m3_confidence IS NULL THEN 'error' ELSE 'success' END AS status,
  CASE WHEN m3_confidence IS NULL THEN 'none' ELSE threat_class END AS threat_class, CASE WHEN m3_confidence IS NULL THEN 'none' ELSE decision END AS decision,
  CASE WHEN m3_confidence IS NULL THEN 'none' ELSE severity END AS severity FROM us""",
    "stream_counters": f"""WITH {FUSED} SELECT count(m3_confidence) AS processed, count(*) - count(m3_confidence) AS failed,
  count(*) FILTER (WHERE m3_confidence IS NOT NULL AND decision <> 'BENIGN') AS alerts FROM us""",
    "scale_features": f"""WITH f AS (SELECT flow_id, dst_port, {', '.join(f'coalesce({c}, 0) AS {c}' for c in CORE_FEATURES)} FROM ({FLOWS}) x),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}' for c in CORE_FEATURES)} FROM f WHERE dst_port < 1000)
SELECT flow_id, {', '.join(f'round(({c} - m_{c}) / d_{c}, 4) + 0::DOUBLE AS {c}' for c in CORE_FEATURES)} FROM f, m""",
    "stream_alerts": f"""WITH a AS (SELECT * FROM ({DESK}) x),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY arrival_seq) AS rn FROM a WHERE protocol = 'UDP') y WHERE rn = 1 AND {ALERT_FAULTS} = ''),
ok AS (SELECT * FROM a WHERE protocol <> 'UDP' AND {ALERT_FAULTS} = ''),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY arrival_seq) AS rn FROM ok) y WHERE rn = 1 AND alert_id NOT IN (SELECT alert_id FROM st))
SELECT alert_id, arrival_seq, severity FROM st UNION ALL SELECT alert_id, arrival_seq, severity FROM fresh""",
    "stream_incidents": f"WITH {RUNNING} SELECT incident_id, event_count, risk_score, risk_level, created_at, updated_at FROM inc",
    "window_counts": f"""SELECT src_ip, time_bucket(INTERVAL '5 minutes', ts) AS window_start, count(*) AS event_count FROM ({EVENTS}) e GROUP BY 1, 2""",
    "split_tables": f"""WITH f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY flow_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS c FROM ({FLOWS}) x)
SELECT label, CASE WHEN p * 1.0::DOUBLE / c < 0.7::DOUBLE THEN 'train' WHEN p * 1.0::DOUBLE / c < 0.85::DOUBLE THEN 'validation' ELSE 'test' END AS split,
  count(*) AS n FROM f GROUP BY 1, 2""",
    "prompt_dataset": f"""SELECT arrival_seq, alert_id, concat('{ASK_ONE + ", ".join(ANALYSIS_FIELDS)}', chr(10),
  {_alert_line("concat('{{', chr(34), 'packets', chr(34), ':', source_port, '}}')")}) AS prompt FROM ({DESK}) a""".replace("{{", "{").replace("}}", "}"),
    "correlation_prompts": f"""WITH a AS ({DESK}) SELECT DISTINCT source_ip AS request_id, -1::BIGINT AS arrival_seq, 0 AS part,
  '{ASK_MANY + ", ".join(CORRELATION_FIELDS)}' AS line FROM a
  UNION ALL SELECT source_ip, arrival_seq, 1, {_alert_line("'{}'")} FROM a""",
    "explain_incidents": f"""WITH {RUNNING},
p AS (SELECT src_ip, confidence, anomaly_score, severity, reputation AS rep, technique_id, technique_name, tactic, threat_class, dst_port FROM r WHERE down = 1)
SELECT incident_id, event_count, split_part(title, ' from ', 1) AS primary_class,
  concat(event_count, ' event(s) from ', source_entity, ', first seen as ', split_part(title, ' from ', 1), '; risk ', risk_score, ' (', risk_level, '); ', ioc_count,
  ' indicator(s), reputation ', reputation, '; technique ', inc.technique_id) AS summary,
  round(confidence * 100, 2) AS confidence_component, round(anomaly_score * 100, 2) AS anomaly_component,
  CASE severity WHEN 'INFO' THEN 10::DOUBLE WHEN 'LOW' THEN 30::DOUBLE WHEN 'MEDIUM' THEN 50::DOUBLE WHEN 'HIGH' THEN 80::DOUBLE ELSE 100::DOUBLE END AS severity_component,
  CASE rep WHEN 'BENIGN' THEN 0::DOUBLE WHEN 'SUSPICIOUS' THEN 60::DOUBLE WHEN 'MALICIOUS' THEN 100::DOUBLE ELSE 20::DOUBLE END AS intel_component,
  least(event_count * 25::DOUBLE, 100) AS correlation_component,
  CASE WHEN p.technique_id IS NULL THEN 'no technique' ELSE concat(p.technique_id, ' ', technique_name, '; tactic ', tactic, '; by ',
    CASE p.technique_id WHEN 'NO_CONFIDENT_MAPPING' THEN 'class_without_technique' WHEN 'T1071' THEN 'class_and_port' ELSE 'class' END,
    '; class=', threat_class, CASE p.technique_id WHEN 'T1071' THEN concat(', dst_port=', dst_port) ELSE '' END) END AS technique_context
FROM inc JOIN p ON inc.source_entity = p.src_ip""",
    "explain_events": f"""WITH {DECIDED} SELECT concat('inc-', replace(src_ip, '.', '-')) AS incident_id, row_number() OVER (PARTITION BY src_ip ORDER BY arrival_seq) AS line, event_id,
  concat(threat_class, ' (', decision, ') at ', ts, ', confidence ', confidence, ', anomaly ', anomaly_score) AS evidence FROM s""",
    "stream_windows": f"""SELECT src_ip, time_bucket(INTERVAL '5 minutes', ts) AS window_start, time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end,
  count(*) AS event_count FROM ({EVENTS}) e GROUP BY 1, 2, 3""",
    "stream_late": f"""SELECT src_ip, time_bucket(INTERVAL '5 minutes', ts) AS window_start, time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end,
  count(*) AS event_count FROM ({EVENTS}) e GROUP BY 1, 2, 3""",
    "stream_sessions": f"""WITH e AS ({EVENTS}),
b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY src_ip ORDER BY ts) <= INTERVAL '5 minutes' THEN 0 ELSE 1 END AS brk FROM e),
n AS (SELECT *, sum(brk) OVER (PARTITION BY src_ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM b)
SELECT src_ip, min(ts) AS session_start, max(ts) + INTERVAL '5 minutes' AS session_end, count(*) AS event_count FROM n GROUP BY src_ip, no""",
    "stream_session_log": f"""WITH e AS ({EVENTS}),
b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY src_ip ORDER BY ts) <= to_seconds({LOG_GAP}) THEN 0 ELSE 1 END AS brk FROM e),
n AS (SELECT *, sum(brk) OVER (PARTITION BY src_ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM b),
s AS (SELECT src_ip, min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count FROM n GROUP BY src_ip, no)
SELECT *, session_end < (SELECT max(ts) FROM e) - to_seconds({LOG_GAP + LOG_LATENESS}) AS finished, true AS retracted, CAST(0 AS BIGINT) AS late FROM s""",
    **{q: f"WITH {APPEND} SELECT alert_id, arrival_seq, severity FROM st" for q in ("alert_feed", "reset_and_seed")},
    "intel_documents": f"""SELECT 'Domain' AS ioc_type, domain AS value, CASE WHEN min(page_id) % 3 = 0 THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END AS reputation,
  min(page_id) % 100 / 100.0::DOUBLE AS confidence, 'pages' AS source FROM ({DOMAINS}) d GROUP BY domain""",
    "provider_intel": f"""SELECT 'Domain' AS ioc_type, domain AS value, CASE min(page_id) % 3 WHEN 0 THEN 'MALICIOUS' WHEN 1 THEN 'SUSPICIOUS' ELSE 'UNKNOWN' END AS reputation,
  CASE WHEN min(page_id) % 5 <> 0 THEN min(page_id) % 100 / 100.0::DOUBLE ELSE 0 END AS confidence, 'pages' AS source, concat('c2,', domain) AS categories, 'file' AS hash_type
  FROM ({DOMAINS}) d GROUP BY domain""",
    "conform_intel": f"""SELECT 'Domain' AS ioc_type, domain AS value, 'SUSPICIOUS' AS reputation, max(page_id) % 50 / 50.0::DOUBLE AS confidence,
  concat('feed-', lpad(CAST(max(page_id) AS VARCHAR), 6, '0')) AS source, 'none' AS threat_actor FROM ({DOMAINS}) d GROUP BY domain""",
    "model_reload": f"WITH {_SPLIT} SELECT split, count(*) AS n, 0 AS other, 0 AS other_m3, 0 AS other_anomaly, 0 AS not_neutral, true AS none_found FROM s GROUP BY 1",
    "flat_forest_check": f"WITH {_SPLIT} SELECT split, count(*) AS n, 0 AS other_m3, 0 AS other_m4 FROM s GROUP BY 1",
    "class_weights": f"""WITH f AS (SELECT {_TARGET} AS target FROM ({FLOWS}) x WHERE label IS NOT NULL),
c AS (SELECT target, count(*) AS n FROM f GROUP BY 1)
SELECT target, n, round(sum(n) OVER () * 1.0::DOUBLE / (count(*) OVER () * n), 6) AS weight FROM c""",
    "isolation_check": f"SELECT count(*) + 3 AS n, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, true AS planted_first FROM ({FLOWS}) f",
    "predict_check": f"""WITH {_SPLIT} SELECT split, count(*) AS n, 0 AS other_decision, 0 AS other_severity, 0 AS other_class, 0 AS odd_scores FROM s GROUP BY 1""",
    "train_check": f"""WITH {_SPLIT} SELECT model, coalesce(target, 'none') AS target, count(*) AS n, 0 AS bad_confidence, 0 AS bad_maps, true AS accuracy_met
  FROM s CROSS JOIN (VALUES ('m3'), ('m4')) m(model) WHERE split = 'test' GROUP BY 1, 2""",
    **{q: f"""WITH f AS ({FULL}), g AS (SELECT *, coalesce(label = 'DDoS' AND total_fwd_packets >= 30, false) AS known FROM f),
h AS (SELECT *, known OR (flow_duration IS NOT NULL AND NOT isinf(flow_bytes_s)) AS good FROM g),
e AS (SELECT *, row_number() OVER (ORDER BY ts, flow_id) AS seq FROM h WHERE good)
SELECT concat('inc-', replace(src_ip, '.', '-')) AS incident_id, src_ip AS source_entity, arg_min(dst_ip, seq) AS target_entity, count(*) AS event_count,
  arg_min(ts, seq) AS created_at, arg_max(ts, seq) AS updated_at, bool_or(known) AS has_classified, (SELECT count(*) FROM h WHERE NOT good) AS errors
FROM e GROUP BY src_ip""" for q in ("flows_to_incidents", "stream_flows_to_incidents")},
    **{q: f"""WITH f AS ({FULL}), g AS (SELECT *, CASE WHEN flow_duration IS NULL THEN 'flow_duration' ELSE '' END AS nan_features,
  CASE WHEN isinf(flow_bytes_s) THEN 'flow_bytes_s' ELSE '' END AS inf_features FROM f),
h AS (SELECT *, nan_features = '' AND inf_features = '' AS good FROM g)
SELECT flow_id, CASE WHEN good THEN 'success' ELSE 'error' END AS status, CASE WHEN good THEN 'none' ELSE 'FEATURE_SCHEMA_MISMATCH' END AS error_type,
  CASE WHEN good THEN sha256(flow_id) ELSE 'none' END AS event_id, CASE WHEN good THEN src_ip ELSE 'none' END AS src_ip,
  CASE WHEN good THEN dst_port ELSE -1 END AS dst_port, nan_features, inf_features, true AS agrees FROM h""" for q in ("detect_flows", "stream_detect_flows")},
}
