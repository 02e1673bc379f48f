"""Flow -> threat event: endpoints, fusion, decision, alert and the behavioural detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from threatlake.functions import scoring, text
from threatlake.functions.network import port_number, row_id
from threatlake.functions.scoring import DEFAULTS, Thresholds
from threatlake.session import materialise

# Full contract spelling and short spelling of the detector inputs.
FLOW_ALIASES = {
    "flow_duration": ("flow_duration",),
    "total_fwd_packets": ("total_fwd_packets",),
    "total_bwd_packets": ("total_backward_packets", "total_bwd_packets"),
    "fwd_pkt_len_mean": ("fwd_packet_length_mean", "fwd_pkt_len_mean"),
    "fwd_pkt_len_max": ("fwd_packet_length_max", "fwd_pkt_len_max"),
    "flow_iat_mean": ("flow_iat_mean",),
    "total_fwd_bytes": ("total_length_of_fwd_packets", "total_fwd_bytes"),
    "total_bwd_bytes": ("total_length_of_bwd_packets", "total_bwd_bytes"),
}


def measure(df: DataFrame, name: str) -> Column:
    """Detector input by either spelling, 0.0 when the table has neither."""
    found = [F.col(c).cast("double") for c in FLOW_ALIASES[name] if c in df.columns]
    return F.coalesce(*found, F.lit(0.0))


def _dst_port(df: DataFrame) -> Column:
    integral = isinstance(df.schema["dst_port"].dataType, T.IntegralType)
    return F.col("dst_port") if integral else port_number(F.col("dst_port"))


def endpoints(df: DataFrame, slots: dict[str, list[str]]) -> DataFrame:
    """Fill each endpoint column from the first usable candidate; ports keep digits only.

    NULL, empty text and the number 0 are passed over; the text ``0`` is a value. A whole number in a fractional
    column is read as that number.
    """

    def usable(name: str) -> Column:
        kind = df.schema[name].dataType
        value = F.col(f"`{name}`")
        if isinstance(kind, T.FractionalType):
            whole = F.when(value == F.floor(value), value.try_cast("bigint").cast("string"))
            return F.when(value != 0, F.coalesce(whole, value.cast("string")))
        return F.when(value != (0 if isinstance(kind, T.NumericType) else ""), value).cast("string")

    picked = {}
    for slot, names in slots.items():
        value = F.coalesce(*[usable(n) for n in names if n in df.columns], F.lit(None).cast("string"))
        picked[slot] = port_number(value) if slot.endswith("port") else value
    return df.withColumns(picked)


def fuse(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """``m3_*`` and ``m4_*`` columns -> one class, confidence and anomaly score."""
    m3 = scoring.prefers_m3(F.col("m3_class"), F.col("m3_confidence"), F.col("m4_class"), t)
    return df.withColumns({
        "threat_class": F.when(m3, F.col("m3_class")).otherwise(F.col("m4_class")),
        "confidence": F.when(m3, F.col("m3_confidence")).otherwise(F.col("m4_confidence")),
        "anomaly_score": F.col("m4_anomaly"),
    })


def decide(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    verdict = F.col("threat_class"), F.col("confidence"), F.col("anomaly_score")
    return df.withColumns({"decision": scoring.decision(*verdict, t), "decision_reason": scoring.decision_reason(*verdict, t)})


def raise_alerts(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Severity, title and status of each decided event."""
    return df.withColumns({
        "severity": scoring.severity(F.col("decision"), F.col("threat_class"), t),
        "title": scoring.alert_title(F.col("decision"), F.col("threat_class")),
        "status": F.lit("NEW"),
    })


def assemble(df: DataFrame, keys: list[str], ingest_time: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """Nested threat-event rows after any ``keep`` columns; ids are a hash of ``keys`` so that a rerun yields the same ids.

    ``probabilities`` is the class map of the broad model (m4), also where the other model's verdict stands; each
    model's own map is under ``classifications``.
    """
    event_id = row_id(*[F.col(k) for k in keys])

    def known(name: str, dtype: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(dtype)

    classes = "map<string, double>"
    time = ingest_time if ingest_time is not None else known("ts", "timestamp")
    return df.select(
        *keep,
        F.lit("success").alias("status"),
        event_id.alias("event_id"),
        time.alias("timestamp"),
        "threat_class", "decision", "confidence", "anomaly_score",
        known("m4_probabilities", classes).alias("probabilities"),
        known("decision_reason", "string").alias("decision_reason"),
        F.struct(known("src_ip", "string").alias("src_ip"), known("src_port", "int").alias("src_port")).alias("source"),
        F.struct(known("dst_ip", "string").alias("dst_ip"), known("dst_port", "int").alias("dst_port")).alias("destination"),
        F.struct(
            F.struct(known("m3_class", "string").alias("threat_class"), known("m3_confidence", "double").alias("confidence"),
                     known("m3_probabilities", classes).alias("probabilities")).alias("m3"),
            F.struct(known("m4_class", "string").alias("threat_class"), known("m4_confidence", "double").alias("confidence"),
                     known("m4_probabilities", classes).alias("probabilities")).alias("m4"),
        ).alias("classifications"),
        F.struct(
            F.lit("forest_pair").alias("classifier"), F.lit("m3_m4_fusion").alias("model_version")
        ).alias("model"),
        F.struct(
            row_id(F.lit("alert"), event_id).alias("alert_id"), "severity", "title", F.col("status"), time.alias("created_at"),
            "threat_class", "decision", "confidence", "anomaly_score",
        ).alias("alert"),
    )


def repeated_connections(flows: DataFrame, connection: list[str], order: list[str], history: int = 3) -> DataFrame:
    """Add ``repeated``: the connection had at least ``history`` earlier flows in the order of the columns (time first).

    Only the ``history`` earliest flows per connection are needed; Spark keeps that many per key
    before the shuffle, so a hot connection sends a handful of rows. The table of those edges is
    written out, so the join back is a broadcast while it is small and a skew-split merge beyond.
    """
    place = F.struct(*order)
    w = W.partitionBy(*connection).orderBy(*order)
    edge = materialise(
        flows.select(*dict.fromkeys([*connection, *order])).withColumn("__r", F.row_number().over(w)).where(F.col("__r") == history)
        .select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(connection)], place.alias("__edge")),
        "edges",
    )
    match = None
    for i, c in enumerate(connection):
        same = flows[c].eqNullSafe(edge[f"__c{i}"])
        match = same if match is None else match & same
    joined = flows.join(edge, match, "left").drop(*[f"__c{i}" for i in range(len(connection))])
    return joined.withColumn("repeated", F.coalesce(place > F.col("__edge"), F.lit(False))).drop("__edge")


def _flat(prefix: str, parts: dict[str, Column]) -> dict[str, Column]:
    return {f"{prefix}_{name}": col for name, col in parts.items()}


def c2_scores(flows: DataFrame) -> DataFrame:
    """Add ``c2_*``; reads ``repeated`` when present."""
    m = {n: measure(flows, n) for n in ("total_fwd_packets", "fwd_pkt_len_mean", "flow_iat_mean", "flow_duration")}
    repeated = F.col("repeated") if "repeated" in flows.columns else F.lit(False)
    return flows.withColumns(_flat("c2", scoring.c2(
        _dst_port(flows), m["total_fwd_packets"], m["fwd_pkt_len_mean"], m["flow_iat_mean"],
        m["flow_duration"], repeated,
    )))


def exfil_scores(flows: DataFrame) -> DataFrame:
    """Add ``exfil_*``."""
    return flows.withColumns(_flat("exfil", scoring.exfiltration(
        _dst_port(flows), measure(flows, "total_fwd_bytes"), measure(flows, "total_bwd_bytes"),
        measure(flows, "fwd_pkt_len_max"),
    )))


def dga_scores(domains: DataFrame, column: str = "domain") -> DataFrame:
    """One row per distinct domain with its statistics and score, and how often it was seen."""
    distinct = domains.groupBy(F.lower(F.trim(F.col(column))).alias(column)).agg(F.count("*").alias("sightings"))
    stats = distinct.withColumns(text.domain_features(F.col(column)))
    read = {n: F.col(n) for n in ("main_label_length", "domain_entropy", "unique_char_ratio", "digit_ratio",
                                  "vowel_consonant_ratio")}
    return stats.withColumns(scoring.dga(F.col(column), read))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value; the total is a scalar subquery, so no value set meets in one task."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 4))


def batch_quality(checked: DataFrame) -> DataFrame:
    """One row: valid, failed and alerting rows of a checked and decided batch."""
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_valid")).alias("ok"),
        F.count_if(~F.col("is_valid")).alias("failed"),
        F.count_if(F.col("is_valid") & (F.col("decision") != "BENIGN")).alias("alerts"),
    )
