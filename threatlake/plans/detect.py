"""Flows -> validated, classified, decided and alerted events, with quarantine."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.functions.scoring import DEFAULTS, Thresholds
from threatlake.operators import models
from threatlake.operators.anomaly import AnomalyModel
from threatlake.operators.detection import assemble, decide, endpoints, fuse, raise_alerts
from threatlake.operators.isolation import IsolationForest
from threatlake.operators.quality import FLOW_EXTRAS, validate_flows
from threatlake.operators.ranking import ranked
from threatlake.session import materialise


def classify(predicted: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Model verdicts -> class, decision, severity, title."""
    return raise_alerts(decide(fuse(predicted, t), t), t)


def detect(predicted: DataFrame, features: list[str], t: Thresholds = DEFAULTS) -> DataFrame:
    """Checked and classified rows in one narrow pass; ``status`` tells events from errors.

    A malformed row keeps its report and has no verdict, and the rest goes on.
    """
    out = classify(validate_flows(predicted, features), t)
    verdict = ("threat_class", "confidence", "anomaly_score", "decision", "severity", "title")
    return out.withColumns({
        **{c: F.when(F.col("is_valid"), F.col(c)) for c in verdict},
        "report": F.when(~F.col("is_valid"), F.col("report")),
        "status": F.when(F.col("is_valid"), "success").otherwise("error"),
        "error_type": F.when(~F.col("is_valid"), "FEATURE_SCHEMA_MISMATCH"),
    })


@dataclass(frozen=True)
class Detectors:
    """Fitted models and the features they read; an absent model gives its neutral verdict."""

    features: list[str]
    m4: PipelineModel | None = None
    m3: PipelineModel | None = None
    anomaly: IsolationForest | None = None

    def save(self, path: str, spark: SparkSession) -> None:
        """Everything a detection needs in one folder: features and, where there, both forests with their scaler and the anomaly model."""
        spark.createDataFrame([(self.features,)], "features array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
        for name in ("m4", "m3"):
            if (model := getattr(self, name)) is not None:
                models.save(model, f"{path}/{name}")
        if self.anomaly is not None:
            AnomalyModel(self.anomaly).write().overwrite().save(f"{path}/anomaly")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Detectors:
        """The saved detectors. A model that is not in the folder is absent, and gives its neutral verdict."""
        features = spark.read.parquet(f"{path}/features").first()["features"]
        anomaly = AnomalyModel.load(f"{path}/anomaly").forest if models.saved(spark, f"{path}/anomaly") else None
        return cls(list(features), models.load(spark, f"{path}/m4"), models.load(spark, f"{path}/m3"), anomaly)


#: Where an endpoint is looked for, in this order; the last name is that of the flow features.
ENDPOINTS = {
    "src_ip": ["src_ip", "source_ip"], "dst_ip": ["dst_ip", "destination_ip"],
    "src_port": ["src_port", "source_port"], "dst_port": ["dst_port", "destination_port"],
}
_VERDICT = ("threat_class", "confidence", "anomaly_score")


def _judged(df: DataFrame, t: Thresholds) -> DataFrame:
    """Fused, decided and alerted in one projection; ``__given`` rows keep the class they came with."""
    fused = fuse(df, t)
    if "__given" in df.columns:
        fused = fused.withColumns({c: F.when(F.col("__given"), F.col(f"__own.{c}")).otherwise(F.col(c)) for c in _VERDICT})
    return raise_alerts(decide(fused, t), t).drop("__given", "__own")


def _set_aside(df: DataFrame) -> DataFrame:
    """``__given``: the row has a class; ``__own``: its class, confidence and anomaly score."""
    own = [(F.col(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in _VERDICT]
    return df.withColumns({"__given": F.col("threat_class").isNotNull(), "__own": F.struct(*own)})


#: Where the flat columns of an event lie in the nested one.
_FLAT = {
    "event_id": "event_id", "ts": "timestamp", "src_ip": "source.src_ip", "src_port": "source.src_port",
    "dst_ip": "destination.dst_ip", "dst_port": "destination.dst_port", "threat_class": "threat_class", "confidence": "confidence",
    "anomaly_score": "anomaly_score", "decision": "decision", "decision_reason": "decision_reason", "severity": "alert.severity",
}


def detect_flows(
    flows: DataFrame, detectors: Detectors, keys: list[str], t: Thresholds = DEFAULTS, carry: Sequence[str] = (), nested: bool = True,
) -> DataFrame:
    """Raw flows -> assembled events and errors, in one narrow pass over a batch or a stream.

    Contract check, endpoints, both forests, anomaly score, fusion, decision, alert, event. Every row comes out
    once: ``status`` success with its ``event``, or error with its ``report`` and no verdict. Where the table has a
    ``threat_class``, rows that have one are events already: they keep it, with their confidence and anomaly
    score, and need no features. The models judge the rows whose verdict is kept: neither those nor broken ones.
    ``carry``: further columns to keep, such as domain or file_hash. Without ``nested`` there is no ``event`` but what
    ``flat_events`` reads of it, so that a table of the rows is as narrow as its reader.
    """
    given = "threat_class" in flows.columns
    checked = validate_flows(flows, detectors.features, extras=(*FLOW_EXTRAS, *(_VERDICT if given else ())))
    wanted = F.col("is_valid")
    if given:
        checked = _set_aside(checked).drop(*_VERDICT).withColumn("__judge", F.col("is_valid") & ~F.col("__given"))
        checked, wanted = checked.withColumn("is_valid", F.col("is_valid") | F.col("__given")), F.col("__judge")
    checked = endpoints(checked, ENDPOINTS)
    seen = models.predict(checked, detectors.features, detectors.m4, detectors.m3, detectors.anomaly, wanted)
    if given:  # no model has spoken of a row that came with its class
        seen = seen.withColumns({c: F.when(~F.col("__given"), F.col(c)) for c in seen.columns if c.startswith(("m3_", "m4_"))}).drop("__judge")
    judged = _judged(seen, t)
    events = assemble(judged, keys, keep=[*keys, *carry, "is_valid", "report"])
    body = [c for c in events.columns if c not in {*keys, *carry, "is_valid", "report", "status"}]
    good = F.col("is_valid")
    # read before the row is made an event or an error, the columns are all that Spark works out of it
    event = [F.when(good, F.struct(*body)).alias("event")] if nested else [F.when(good, F.col(path)).alias(c) for c, path in _FLAT.items()]
    return events.select(
        *keys, *carry,
        F.when(good, "success").otherwise("error").alias("status"),
        F.when(~good, "FEATURE_SCHEMA_MISMATCH").alias("error_type"),
        F.when(~good, F.col("report")).alias("report"),
        *event,
    )


def flat_events(detected: DataFrame, keys: list[str], carry: Sequence[str] = ()) -> DataFrame:
    """The events of ``detect_flows``, nested or not, as the flat rows that an investigation reads, without an arrival sequence."""
    place = (lambda path: f"event.{path}") if "event" in detected.columns else {path: c for c, path in _FLAT.items()}.get
    return detected.where(F.col("status") == "success").select(
        *keys, *[c for c in carry if c not in keys], *[F.col(place(path)).alias(c) for c, path in _FLAT.items()])


def quarantine(detected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that broke the contract, with their report."""
    return detected.where(F.col("status") == "error").select(*keys, "error_type", "report")


#: Positions of one batch lie below this, so arrival sequences of later batches are above those of earlier ones.
BATCH_STEP = 1 << 40


def arrived(events: DataFrame, order: list[str], batch: int = 0, table: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """Events with ``arrival_seq``: their position by ``order``, which must tell them apart, above all earlier batches.

    The same batch gets the same numbers whenever it is replayed. Rows are numbered in slices, one row per slice
    meets in a task.
    """
    placed = ranked(events, [], order, "arrival_seq", table=table)
    return placed.withColumn("arrival_seq", F.col("arrival_seq") + F.lit(batch * BATCH_STEP))


def route(mixed: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Rows that already have a class keep it; the others get theirs from the model verdicts. One projection."""
    return _judged(_set_aside(mixed).drop(*_VERDICT), t)
