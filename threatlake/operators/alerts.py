"""Alert desk: contract check, duplicate rejection, filters, statistics, work-lists, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from threatlake.contracts import (
    ALERT_FIELDS, ALERT_ID_PATTERN, ALERT_PROTOCOLS, ALERT_SEVERITIES, MITRE_FIELDS, TECHNIQUE_PATTERN,
)
from threatlake.functions.documents import plain_text, unpack
from threatlake.functions.lists import listed
from threatlake.functions.network import iso_time
from threatlake.session import materialise


def codes(*checks: tuple[Column, str]) -> Column:
    """Codes of the checks that hold (or cannot be decided), in order."""
    return listed(*[(F.coalesce(hit, F.lit(True)), code) for hit, code in checks])


def outside(name: str, low: float, high: float) -> Column:
    """TRUE unless the number is in range (NULL: not a number)."""
    return ~F.col(f"__doc.{name}").between(low, high)


def not_one_of(name: str, allowed: tuple[str, ...]) -> Column:
    return ~F.col(f"__doc.{name}").isin(*allowed)


def check_documents(df: DataFrame, text: Column, schema: str, required: tuple[str, ...], checks: Column) -> DataFrame:
    """Add ``errors``: ``not_object``, else the missing fields, else the codes of ``checks``.

    To split on ``errors``, write the result first: a filter on it would repeat the parsing.
    """
    missing = F.array_except(F.array(*[F.lit(f) for f in required]), F.col("__keys"))
    ready = unpack(df, text, schema).withColumn("__missing", missing)
    errors = (
        F.when(F.col("__keys").isNull(), F.array(F.lit("not_object")))
        .when(F.size("__missing") > 0, F.transform("__missing", lambda f: F.concat(F.lit("missing:"), f)))
        .otherwise(checks)
    )
    return ready.withColumn("errors", errors).drop("__missing", "__keys", "__doc")


ALERT_DOCUMENT = (
    "alert_id string, timestamp string, threat variant, severity string, confidence double, source_ip variant, "
    "destination_ip variant, source_port bigint, destination_port bigint, protocol string, "
    "mitre struct<tactic: variant, technique: string, technique_name: variant>, evidence map<string, variant>"
)


def alert_checks() -> Column:
    """Codes of the value checks of the alert contract."""

    def blank(name: str) -> tuple[Column, str]:
        return ~(F.trim(plain_text(F.col(f"__doc.{name}"))) != ""), name

    mitre = F.col("__doc.mitre").isNotNull()
    badly_named = F.coalesce(~F.col("__doc.mitre.technique").rlike(TECHNIQUE_PATTERN), F.lit(True))
    return codes(
        (~F.col("__doc.alert_id").rlike(ALERT_ID_PATTERN), "alert_id"),
        (iso_time(F.col("__doc.timestamp")).isNull(), "timestamp"),
        blank("threat"),
        (not_one_of("severity", ALERT_SEVERITIES), "severity"),
        (outside("confidence", 0.0, 1.0), "confidence"),
        blank("source_ip"),
        blank("destination_ip"),
        (outside("source_port", 0, 65535), "source_port"),
        (outside("destination_port", 0, 65535), "destination_port"),
        (not_one_of("protocol", ALERT_PROTOCOLS), "protocol"),
        (~mitre, "mitre"),
        *[(mitre & F.col(f"__doc.mitre.{f}").isNull(), f"missing:mitre.{f}") for f in MITRE_FIELDS],
        (mitre & badly_named, "mitre.technique"),
        (F.col("__doc.evidence").isNull(), "evidence"),
    )


def validate_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``errors`` (array of codes, empty when the contract is met) for a column of JSON alerts."""
    return check_documents(df, F.col(body), ALERT_DOCUMENT, ALERT_FIELDS, alert_checks())


def to_bodies(alerts: DataFrame) -> DataFrame:
    """Desk rows as the JSON documents a sender would post."""
    doc = F.struct(
        "alert_id", F.col("event_time").alias("timestamp"), "threat", "severity", "confidence", "source_ip",
        "destination_ip", "source_port", "destination_port", "protocol",
        F.struct(F.lit("Discovery").alias("tactic"), "technique", F.lit("Network Service Scanning").alias("technique_name")).alias("mitre"),
        F.struct(F.col("source_port").alias("packets")).alias("evidence"),
    )
    return alerts.select("arrival_seq", "alert_id", F.to_json(doc).alias("body"))


def first_by_id(alerts: DataFrame, key: str = "alert_id", order: str = "arrival_seq") -> DataFrame:
    """First arrival per id. Spark keeps one row per id and task before the shuffle."""
    w = W.partitionBy(key).orderBy(order)
    return alerts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def new_alerts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """First arrivals whose id is not stored yet. A row without an id can't be told from a stored one: it is not
    accepted (the contract check reports it), or each replay would add it again.

    The stored ids are filtered by the arriving ids first: a large store is scanned, but only matching ids
    are shuffled further.
    """
    fresh = first_by_id(incoming.where(F.col("alert_id").isNotNull()))
    taken = stored.select("alert_id").join(fresh.select("alert_id"), "alert_id", "left_semi").distinct()
    return fresh.join(taken, "alert_id", "left_anti")


def append(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows and the incoming ones whose id is not taken."""
    return stored.unionByName(new_alerts(stored, incoming).select(*stored.columns))


def by_severity(alerts: DataFrame, severity: str) -> DataFrame:
    return alerts.where(F.col("severity") == severity.upper())


def by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    """The stored row of an id: its first arrival."""
    return alerts.where(F.col("alert_id") == alert_id).orderBy("arrival_seq").limit(1)


def by_threat(alerts: DataFrame, threat: str) -> DataFrame:
    return alerts.where(F.lower("threat") == threat.lower())


def newest(alerts: DataFrame) -> DataFrame:
    """Latest arrival first."""
    return alerts.orderBy(F.col("arrival_seq").desc())


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` earliest rows (top-k per task, then one merge)."""
    return df.orderBy(order).limit(n)


def stats(alerts: DataFrame) -> DataFrame:
    level = F.upper("severity")
    return alerts.agg(
        F.count("*").alias("total_alerts"),
        *[F.count_if(level == s).alias(s.lower()) for s in reversed(ALERT_SEVERITIES)],
    )


def threat_histogram(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.coalesce("threat", F.lit("Unknown")).alias("threat")).agg(F.count("*").alias("n"))


def worklist(alerts: DataFrame, analyses: DataFrame, refresh: bool = False) -> DataFrame:
    """Alerts still to analyse; ``refresh`` takes all again."""
    if refresh:
        return alerts
    return alerts.join(analyses.select("alert_id"), "alert_id", "left_anti")


def resolve_ids(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each requested id of each request with its alert, or ``found = false``.

    Requests naming fewer than two ids are marked ``too_few``.
    """
    counts = materialise(requests.groupBy("request_id").agg(F.count("*").alias("n_ids")), "requests")
    stored = materialise(first_by_id(alerts).select("alert_id", "arrival_seq", "threat", "severity"), "stored")
    joined = requests.join(stored, "alert_id", "left").join(counts, "request_id")
    found = F.col("arrival_seq").isNotNull()
    return joined.withColumn("found", found).withColumn("too_few", F.col("n_ids") < 2).drop("n_ids")


def _line(df: DataFrame) -> Column:
    proof = F.to_json("evidence") if "evidence" in df.columns else F.lit("{}")
    return F.concat_ws(
        " | ",
        F.concat_ws(": ", "alert_id", "threat"),
        F.concat(F.col("source_ip"), F.lit(":"), F.col("source_port"), F.lit(" -> "), F.col("destination_ip"),
                 F.lit(":"), F.col("destination_port")),
        F.col("protocol"), F.col("severity"), F.col("confidence").cast("string"), F.col("technique"), proof,
    )


ASK_ONE = "Assess this network alert from its data alone and answer as one JSON object with the fields: "
ASK_MANY = "Say from the data alone whether these alerts belong together; answer as one JSON object with the fields: "


def prompts(alerts: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One question text per alert."""
    text = F.concat(F.lit(ASK_ONE + ", ".join(fields) + "\n"), _line(alerts))
    return alerts.select("arrival_seq", "alert_id", text.alias("prompt"))


def correlation_prompt_lines(members: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Question over several alerts as numbered lines: the ask, then one line per alert.

    ``members`` has request_id and the alert columns. A request is not bounded, so its lines stay
    rows: ``line`` 0 is the ask and the others are ordered by arrival.
    """
    head = members.select("request_id").distinct().select(
        "request_id", F.lit(None).cast("long").alias("arrival_seq"), F.lit(0).alias("part"),
        F.lit(ASK_MANY + ", ".join(fields)).alias("line"),
    )
    body = members.select("request_id", "arrival_seq", F.lit(1).alias("part"), _line(members).alias("line"))
    return head.unionByName(body)
