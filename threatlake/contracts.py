"""Flow, event, alert and answer contracts: schemas and the fixed values they rest on."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import types as T

# The 66 flow features in contract order, with their numeric type.
FLOW_FEATURES = (
    ("Destination Port", "long"),
    ("Flow Duration", "long"),
    ("Total Fwd Packets", "long"),
    ("Total Backward Packets", "long"),
    ("Total Length of Fwd Packets", "long"),
    ("Total Length of Bwd Packets", "long"),
    ("Fwd Packet Length Max", "long"),
    ("Fwd Packet Length Min", "long"),
    ("Fwd Packet Length Mean", "double"),
    ("Fwd Packet Length Std", "double"),
    ("Bwd Packet Length Max", "long"),
    ("Bwd Packet Length Min", "long"),
    ("Bwd Packet Length Mean", "double"),
    ("Bwd Packet Length Std", "double"),
    ("Flow Bytes/s", "double"),
    ("Flow Packets/s", "double"),
    ("Flow IAT Mean", "double"),
    ("Flow IAT Std", "double"),
    ("Flow IAT Max", "long"),
    ("Flow IAT Min", "long"),
    ("Fwd IAT Total", "long"),
    ("Fwd IAT Mean", "double"),
    ("Fwd IAT Std", "double"),
    ("Fwd IAT Max", "long"),
    ("Fwd IAT Min", "long"),
    ("Bwd IAT Total", "long"),
    ("Bwd IAT Mean", "double"),
    ("Bwd IAT Std", "double"),
    ("Bwd IAT Max", "long"),
    ("Bwd IAT Min", "long"),
    ("Fwd PSH Flags", "long"),
    ("Fwd Header Length", "long"),
    ("Bwd Header Length", "long"),
    ("Fwd Packets/s", "double"),
    ("Bwd Packets/s", "double"),
    ("Min Packet Length", "long"),
    ("Max Packet Length", "long"),
    ("Packet Length Mean", "double"),
    ("Packet Length Std", "double"),
    ("Packet Length Variance", "double"),
    ("FIN Flag Count", "long"),
    ("SYN Flag Count", "long"),
    ("PSH Flag Count", "long"),
    ("ACK Flag Count", "long"),
    ("URG Flag Count", "long"),
    ("Down/Up Ratio", "long"),
    ("Average Packet Size", "double"),
    ("Avg Fwd Segment Size", "double"),
    ("Avg Bwd Segment Size", "double"),
    ("Fwd Header Length.1", "long"),
    ("Subflow Fwd Packets", "long"),
    ("Subflow Fwd Bytes", "long"),
    ("Subflow Bwd Packets", "long"),
    ("Subflow Bwd Bytes", "long"),
    ("Init_Win_bytes_forward", "long"),
    ("Init_Win_bytes_backward", "long"),
    ("act_data_pkt_fwd", "long"),
    ("min_seg_size_forward", "long"),
    ("Active Mean", "double"),
    ("Active Std", "double"),
    ("Active Max", "long"),
    ("Active Min", "long"),
    ("Idle Mean", "double"),
    ("Idle Std", "double"),
    ("Idle Max", "long"),
    ("Idle Min", "long"),
)

# Columns found constant in the training capture and left out of the contract.
CONSTANT_FEATURES = (
    "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags", "RST Flag Count", "CWE Flag Count",
    "ECE Flag Count", "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
)

# Extra columns a flow may carry without being reported.
FLOW_EXTRAS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "Label", "target", "timestamp")

# Column roles.
ROLE_METADATA = "METADATA / IDENTIFIER"
ROLE_TARGET = "TARGET"
ROLE_FEATURE = "ML_FEATURE"

# Raw capture label -> class.
LABEL_TAXONOMY = {"BENIGN": "BENIGN", "DDoS": "DDOS", "PortScan": "PORT_SCAN"}

# Alert desk contract.
ALERT_SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
ALERT_PROTOCOLS = ("TCP", "UDP", "ICMP", "HTTP", "HTTPS", "DNS", "OTHER")
ALERT_ID_PATTERN = "^ALT-[0-9]+$"
TECHNIQUE_PATTERN = r"^T[0-9]+(\.[0-9]+)?$"
ALERT_FIELDS = (
    "alert_id", "timestamp", "threat", "severity", "confidence", "source_ip", "destination_ip",
    "source_port", "destination_port", "protocol", "mitre", "evidence",
)
MITRE_FIELDS = ("tactic", "technique", "technique_name")

# Analyst-answer contracts.
ANALYSIS_FIELDS = (
    "ai_summary", "threat_assessment", "risk_level", "confidence", "why_suspicious",
    "attack_stage", "mitre_context", "recommended_actions", "investigation_priority",
)
ANALYSIS_RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
ANALYSIS_PRIORITIES = ("LOW", "MEDIUM", "HIGH", "IMMEDIATE")
CORRELATION_FIELDS = (
    "related", "confidence", "summary", "common_indicators", "possible_attack_chain",
    "recommended_actions",
)

# Severity order used by the optional minimum-severity filter.
SEVERITY_RANK = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

# ATT&CK techniques (id, name, tactic).
TECHNIQUES = (
    ("T1046", "Network Service Scanning", "Discovery"),
    ("T1110", "Brute Force", "Credential Access"),
    ("T1190", "Exploitation of Public-Facing Application", "Initial Access"),
    ("T1498", "Network Denial of Service", "Impact"),
    ("T1071", "Application Layer Protocol", "Command and Control"),
    ("T1090", "Proxy", "Command and Control"),
)

_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "int64": T.LongType(), "float64": T.DoubleType()}


def snake(name: str) -> str:
    """Column-safe spelling of a capture header: ``Flow Bytes/s`` -> ``flow_bytes_s``."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


@dataclass(frozen=True)
class FlowContract:
    names: tuple[str, ...]
    types: tuple[str, ...]
    target: str = "target"
    raw_label: str = "Label"

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(snake(n) for n in self.names)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(snake(n), _TYPES[t]) for n, t in zip(self.names, self.types)])


def flow_contract() -> FlowContract:
    return FlowContract(tuple(n for n, _ in FLOW_FEATURES), tuple(t for _, t in FLOW_FEATURES))


def parse_contract(text: str) -> FlowContract:
    """Contract from JSON ``{ml_feature_names, feature_types, total_ml_features, ...}``."""
    doc = json.loads(text)
    names = tuple(doc["ml_feature_names"])
    if doc.get("total_ml_features") != len(names):
        raise ValueError(f"contract declares {doc.get('total_ml_features')} features, lists {len(names)}")
    types = doc.get("feature_types", {})
    return FlowContract(
        names,
        tuple(types.get(n, "float64") for n in names),
        doc.get("target_column", "target"),
        doc.get("raw_label_column", "Label"),
    )


#: the contract columns the rule detectors read, in contract order (short spellings)
CORE_FEATURES = (
    "flow_duration", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes",
    "fwd_pkt_len_max", "fwd_pkt_len_mean", "flow_iat_mean",
)

ALERT_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("threat", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("source_port", T.LongType()),
    T.StructField("destination_port", T.LongType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("mitre", T.StructType([T.StructField(f, T.StringType()) for f in MITRE_FIELDS])),
    T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
    T.StructField("arrival_seq", T.LongType()),
])

INTEL_SCHEMA = T.StructType([
    T.StructField("ioc_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("reputation", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("threat_actor", T.StringType()),
    T.StructField("hash_type", T.StringType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("arrival_seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("threat_class", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("anomaly_score", T.DoubleType()),
])
