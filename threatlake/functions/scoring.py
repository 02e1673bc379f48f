"""Rule scores as Catalyst expressions: decision, severity, technique, risk and detectors.

Every score is one fixed-order sum of DOUBLE terms, so a row scores alike in batch and stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Thresholds:
    """Fixed default values; pass another instance to change a rule."""

    malicious: float = 0.80
    benign: float = 0.80
    anomaly: float = 0.70
    fusion: float = 0.70
    critical_classes: tuple[str, ...] = ("DDOS", "DOS", "BOTNET", "BRUTE_FORCE", "INFILTRATION")


DEFAULTS = Thresholds()

# Risk weights, component scores and levels.
RISK_WEIGHTS = {"confidence": 0.25, "anomaly": 0.20, "severity": 0.25, "intel": 0.15, "correlation": 0.15}
SEVERITY_SCORES = {"INFO": 10.0, "LOW": 30.0, "MEDIUM": 50.0, "HIGH": 80.0, "CRITICAL": 100.0}
INTEL_SCORES = {"BENIGN": 0.0, "UNKNOWN": 20.0, "UNAVAILABLE": 20.0, "SUSPICIOUS": 60.0, "MALICIOUS": 100.0}
RISK_LEVELS = {"CRITICAL": 85.0, "HIGH": 60.0, "MEDIUM": 30.0}

# Detector ports, top-level domains and cut-offs.
C2_PORTS = (6667, 6697, 4444, 8443, 1337, 31337, 5555, 9001, 9090)
BOTNET_PORTS = (80, 443, 8080, 6667)
DGA_TLDS = (".ru", ".xyz", ".top", ".tk", ".biz", ".info", ".cn", ".work", ".click")
LIKELY_FROM, SUSPECT_FROM = 0.65, 0.35

NO_MAPPING = "NO_CONFIDENT_MAPPING"


def _ladder(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def _points(*terms: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for hit, worth in terms:
        total = total + F.when(hit, F.lit(worth)).otherwise(F.lit(0.0))
    return F.round(F.least(total, F.lit(1.0)), 4)


def _verdict(score: Column, likely: str, suspect: str, normal: str) -> Column:
    return F.when(score >= LIKELY_FROM, likely).when(score >= SUSPECT_FROM, suspect).otherwise(normal)


def _evidence(*terms: tuple[Column, str], none: str) -> Column:
    codes = F.concat_ws(",", *[F.when(hit, F.lit(code)) for hit, code in terms])
    return F.split(F.when(codes == "", F.lit(none)).otherwise(codes), ",")


def decision(threat_class: Column, confidence: Column, anomaly: Column, t: Thresholds = DEFAULTS) -> Column:
    name = F.coalesce(threat_class, F.lit("BENIGN"))
    conf = F.coalesce(confidence, F.lit(1.0))
    attack = name != "BENIGN"
    return (
        F.when(attack & (conf >= t.malicious), "MALICIOUS")
        .when(F.coalesce(anomaly, F.lit(0.0)) >= t.anomaly, "ANOMALOUS")
        .when(~attack & (conf >= t.benign), "BENIGN")
        .otherwise("SUSPICIOUS")
    )


def decision_reason(threat_class: Column, confidence: Column, anomaly: Column, t: Thresholds = DEFAULTS) -> Column:
    """Code of the rule that decided, and the value it compared with its threshold."""
    name = F.coalesce(threat_class, F.lit("BENIGN"))
    conf, odd = F.coalesce(confidence, F.lit(1.0)), F.coalesce(anomaly, F.lit(0.0))
    attack = name != "BENIGN"

    def told(code: str, value: Column, limit: float) -> Column:
        return F.concat(F.lit(f"{code}:"), F.round(value, 4).cast("string"), F.lit(f">={limit}"))

    return (
        F.when(attack & (conf >= t.malicious), told("attack_confidence", conf, t.malicious))
        .when(odd >= t.anomaly, told("anomaly", odd, t.anomaly))
        .when(~attack & (conf >= t.benign), told("benign_confidence", conf, t.benign))
        .when(attack, F.lit("attack_below_threshold"))
        .otherwise(F.lit("benign_below_threshold"))
    )


def severity(decided: Column, threat_class: Column, t: Thresholds = DEFAULTS) -> Column:
    return (
        F.when(decided == "BENIGN", "INFO")
        .when(decided == "SUSPICIOUS", "LOW")
        .when((decided == "MALICIOUS") & threat_class.isin(*t.critical_classes), "CRITICAL")
        .when(decided == "MALICIOUS", "HIGH")
        .otherwise("MEDIUM")
    )


def alert_title(decided: Column, threat_class: Column) -> Column:
    return (
        F.when(decided == "BENIGN", F.lit("Benign flow"))
        .when(decided == "SUSPICIOUS", F.concat(F.lit("Suspicious activity: "), threat_class))
        .when(decided == "ANOMALOUS", F.lit("Traffic anomaly"))
        .when(decided == "MALICIOUS", F.concat(F.replace(threat_class, F.lit("_"), F.lit(" ")), F.lit(" attack")))
        .otherwise(F.concat(F.lit("Alert: "), threat_class))
    )


def technique_id(threat_class: Column, decided: Column, dst_port: Column) -> Column:
    """ATT&CK technique of an event; NULL when nothing maps."""
    name = F.upper(F.coalesce(threat_class, F.lit("BENIGN")))
    web_port = F.coalesce(dst_port.isin(*BOTNET_PORTS), F.lit(False))
    mapped = (
        F.when(name.contains("PORT_SCAN"), "T1046")
        .when(name.contains("BRUTE"), "T1110")
        .when(name.contains("WEB"), "T1190")
        .when(name.contains("DOS"), "T1498")
        .when(name.contains("BOTNET") & web_port, "T1071")
        .when(name.contains("BOTNET") | name.contains("INFILTRATION"), NO_MAPPING)
    )
    return F.when(F.upper(F.coalesce(decided, F.lit("BENIGN"))) != "BENIGN", mapped)


def mapping_basis(technique: Column) -> Column:
    """What a technique rests on: the class, the class and the port, or a class that fits none."""
    return (
        F.when(technique.isNull(), F.lit(None).cast("string"))
        .when(technique == NO_MAPPING, "class_without_technique").when(technique == "T1071", "class_and_port").otherwise("class")
    )


def mapping_evidence(technique: Column, threat_class: Column, dst_port: Column) -> Column:
    """The facts behind a mapping as ``name=value`` texts; NULL when nothing maps."""
    told = F.concat(F.lit("class="), F.upper(threat_class))
    port = F.concat(F.lit("dst_port="), dst_port.cast("string"))
    return F.when(technique == "T1071", F.array(told, port)).when(technique.isNotNull(), F.array(told))


def technique_confidence(technique: Column, threat_class: Column, confidence: Column) -> Column:
    conf = F.coalesce(confidence, F.lit(0.0))
    botnet = F.upper(threat_class).contains("BOTNET")
    return (
        F.when(technique.isNull(), F.lit(None).cast("double"))
        .when(technique == NO_MAPPING, F.when(botnet, F.lit(0.40)).otherwise(F.lit(0.30)))
        .otherwise(F.round(conf * F.when(technique == "T1071", F.lit(0.85)).otherwise(F.lit(0.95)), 4))
    )


def risk_components(
    confidence: Column, anomaly: Column, severity_: Column, reputation: Column, count: Column
) -> dict[str, Column]:
    def percent(value: Column) -> Column:
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))

    return {
        "confidence": percent(F.coalesce(confidence, F.lit(0.80)) * F.lit(100.0)),
        "anomaly": percent(F.coalesce(anomaly, F.lit(0.0)) * F.lit(100.0)),
        "severity": _ladder(F.upper(F.coalesce(severity_, F.lit("INFO"))), SEVERITY_SCORES, 30.0),
        "intel": _ladder(F.upper(F.coalesce(reputation, F.lit("UNKNOWN"))), INTEL_SCORES, 20.0),
        "correlation": percent(count.cast("double") * F.lit(25.0)),
    }


def risk_score(parts: dict[str, Column]) -> Column:
    total = None
    for name, weight in RISK_WEIGHTS.items():
        term = F.lit(weight) * parts[name]
        total = term if total is None else total + term
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 2)


def risk_level(score: Column) -> Column:
    out = None
    for level, start in RISK_LEVELS.items():
        out = F.when(score >= start, level) if out is None else out.when(score >= start, level)
    return out.otherwise("LOW")


def _c2_terms(dst_port, fwd_packets, fwd_mean, iat_mean, duration, repeated):
    return (
        (F.coalesce(dst_port.isin(*C2_PORTS), F.lit(False)), "c2_port", 0.35),
        ((fwd_packets >= 5) & (fwd_mean > 0) & (fwd_mean <= 64.0), "small_frequent_packets", 0.30),
        ((iat_mean > 0) & (duration > 0), "inter_arrival", 0.20),
        (F.coalesce(repeated, F.lit(False)), "repeated_connection", 0.25),
    )


def c2(dst_port, fwd_packets, fwd_mean, iat_mean, duration, repeated) -> dict[str, Column]:
    """Beaconing score; ``repeated`` is TRUE from the fourth flow of a connection on."""
    terms = _c2_terms(dst_port, fwd_packets, fwd_mean, iat_mean, duration, repeated)
    score = _points(*[(hit, worth) for hit, _, worth in terms])
    return {
        "score": score,
        "classification": _verdict(score, "LIKELY_C2", "SUSPICIOUS_C2", "NO_C2_EVIDENCE"),
        "evidence": _evidence(*[(hit, code) for hit, code, _ in terms], none="normal_transport"),
    }


def exfiltration(dst_port, fwd_bytes, bwd_bytes, max_packet) -> dict[str, Column]:
    answered = (fwd_bytes > 5000) & (bwd_bytes > 0)
    ratio = F.try_divide(fwd_bytes, bwd_bytes)
    terms = (
        (answered & (ratio >= 10.0), "high_byte_ratio", 0.35),
        (answered & (ratio >= 4.0) & (ratio < 10.0), "elevated_byte_ratio", 0.20),
        ((fwd_bytes > 50000) & (bwd_bytes == 0), "one_way_transfer", 0.40),
        (max_packet >= 1400, "large_payload", 0.20),
        (fwd_bytes >= 1000000, "high_volume", 0.30),
        (F.coalesce(dst_port == 53, F.lit(False)) & (fwd_bytes > 2000), "dns_volume", 0.35),
    )
    score = _points(*[(hit, worth) for hit, _, worth in terms])
    return {
        "score": score,
        "classification": _verdict(score, "LIKELY_EXFILTRATION", "SUSPICIOUS_EXFILTRATION", "NORMAL"),
        "evidence": _evidence(*[(hit, code) for hit, code, _ in terms], none="normal_transfer"),
    }


def dga(domain: Column, stats: dict[str, Column]) -> dict[str, Column]:
    """Generated-domain score from ``functions.text.domain_features`` columns."""
    name = F.lower(F.trim(domain))
    tld = F.lit(False)
    for suffix in DGA_TLDS:
        tld = tld | name.endswith(suffix)
    label, bits = stats["main_label_length"], stats["domain_entropy"]
    terms = (
        (bits >= 4.2, "high_entropy", 0.40),
        ((bits >= 3.7) & (bits < 4.2), "elevated_entropy", 0.20),
        ((stats["unique_char_ratio"] >= 0.75) & (label >= 10), "unique_characters", 0.25),
        (stats["digit_ratio"] >= 0.20, "digits", 0.20),
        ((stats["vowel_consonant_ratio"] < 0.25) & (label >= 8), "few_vowels", 0.15),
        (tld, "suspicious_tld", 0.15),
    )
    known = F.coalesce(name != "", F.lit(False))
    score = F.when(known, _points(*[(hit, worth) for hit, _, worth in terms])).otherwise(F.lit(0.0))
    return {
        "dga_score": score,
        "classification": _verdict(score, "LIKELY_DGA", "SUSPICIOUS", "NORMAL"),
        "evidence": _evidence(*[(hit & known, code) for hit, code, _ in terms], none="normal_name"),
    }


def prefers_m3(m3_class: Column, m3_confidence: Column, m4_class: Column, t: Thresholds = DEFAULTS) -> Column:
    """TRUE where the flood/scan model overrides the general classifier."""
    sure = F.coalesce(m3_confidence, F.lit(0.0)) >= t.fusion
    return F.coalesce(m3_class, F.lit("BENIGN")).isin("DDOS", "PORT_SCAN") & sure & (m4_class == "BENIGN")
