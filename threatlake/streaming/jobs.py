"""Structured Streaming jobs built from the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from threatlake.functions.scoring import DEFAULTS, Thresholds
from threatlake.operators.alerts import new_alerts
from threatlake.operators.incidents import incidents, investigated, keyed, rated
from threatlake.operators.ranking import ranked
from threatlake.plans.desk import accept
from threatlake.plans.detect import Detectors, arrived, detect, detect_flows, flat_events, quarantine
from threatlake.session import Scratch
from threatlake.streaming.keyed import KeyedTable


class QualityCounters(StreamingQueryListener):
    """Running totals of the counters a detection stream observes.

    ``spark.streams.addListener(counters)``; a restarted stream goes on from its checkpoint, so the
    totals cover the batches since this listener was added.
    """

    def __init__(self) -> None:
        self.totals = {"processed": 0, "failed": 0, "alerts": 0}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("quality")
        if seen is not None:
            for name, value in seen.asDict().items():
                self.totals[name] += value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _start(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def detect_stream(
    flows: DataFrame, features: list[str], path: str, checkpoint: str, t: Thresholds = DEFAULTS,
    available_now: bool = False,
) -> StreamingQuery:
    """Validate and classify a flow stream into a table partitioned by ``status``.

    Stateless, so the file sink gives exactly-once; ``status=error`` is the quarantine. Counters
    are observed per micro-batch as ``quality`` (see ``StreamingQueryProgress.observedMetrics``).
    """
    out = detect(flows, features, t).observe(
        "quality",
        F.count_if(F.col("status") == "success").alias("processed"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(F.col("decision") != "BENIGN").alias("alerts"),
    )
    return _start(out.writeStream.format("parquet").partitionBy("status").option("path", path), checkpoint, available_now)


def flow_stream(flows: DataFrame, detectors: Detectors, keys: list[str], path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Raw flows -> assembled events and errors (``detect_flows``), partitioned by ``status``."""
    out = detect_flows(flows, detectors, keys)
    return _start(out.writeStream.format("parquet").partitionBy("status").option("path", path), checkpoint, available_now)


def event_stream(
    flows: DataFrame, detectors: Detectors, keys: list[str], order: list[str], events: str, errors: str, checkpoint: str,
    carry: Sequence[str] = (), available_now: bool = False,
) -> StreamingQuery:
    """Raw or classified flows -> flat events with their arrival sequence, and a quarantine, a folder per micro-batch.

    A replayed micro-batch has the same rows, so it numbers them alike and replaces its own folders. The events
    are the input of ``incident_stream``: read them with ``sources.flows.stream``.
    """
    more = list(dict.fromkeys([c for c in (*order, *carry) if c not in keys and c != "ts"]))

    def write(batch: DataFrame, batch_id: int) -> None:
        with Scratch(batch.sparkSession) as work:
            detected = work.table(detect_flows(batch, detectors, keys, carry=more, nested=False), "detected")
            placed = arrived(flat_events(detected, keys, more), order, batch_id, work.table)
            placed.write.mode("overwrite").parquet(f"{events}/batch_id={batch_id}")
            quarantine(detected, keys).write.mode("overwrite").parquet(f"{errors}/batch_id={batch_id}")

    return _start(flows.writeStream.foreachBatch(write), checkpoint, available_now)


def alert_stream(bodies: DataFrame, table: str, rejects: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Ingest alert documents: check, refuse stored ids, append; bad documents go to ``rejects``.

    A replayed batch finds its own ids stored already, so a restart adds nothing twice. ``table``
    must exist (``sources.alerts.reset_table``).
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with Scratch(spark) as work:
            good, bad = accept(batch, work=work)
            stored = spark.read.parquet(table)
            fresh = new_alerts(stored, good).select(*stored.columns)
            fresh.write.mode("append").parquet(table)
            bad.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    return _start(bodies.writeStream.foreachBatch(ingest), checkpoint, available_now)


def keyed_alert_stream(bodies: DataFrame, store: KeyedTable, rejects: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Ingest alert documents into a store keyed by ``alert_id``: check, refuse stored ids, write; bad documents go to ``rejects``.

    A micro-batch looks its ids up in the buckets they fall into and reads no other. It sees the batches before it,
    and a replay replaces its own rows, so a restart adds nothing twice. The store must exist: ``store.write(rows, SEED)``.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        with Scratch(batch.sparkSession) as work:
            good, bad = accept(batch, work=work)
            store.write(new_alerts(store.lookup(good, batch_id), good), batch_id)
            bad.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    return _start(bodies.writeStream.foreachBatch(ingest), checkpoint, available_now)


#: What ``running_stream`` keeps per source between micro-batches.
TOTALS = T.StructType([T.StructField("entity_key", T.StringType()), T.StructField("total", T.LongType())])


def running_stream(events: DataFrame, intel: DataFrame, totals: KeyedTable, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Incident state after each event, a folder per micro-batch: ``running_risk`` of all events so far.

    The number of a source's events before the batch is looked up in ``totals`` (key ``entity_key``, schema
    ``TOTALS``), positions inside the batch are counted in slices, so a source with a third of the rows is not one
    task. Batches must come in the order of ``arrival_seq``; totals and rows of a replayed batch replace its own.
    """

    def follow(batch: DataFrame, batch_id: int) -> None:
        with Scratch(batch.sparkSession) as work:
            placed = work.table(ranked(keyed(batch), ["entity_key"], ["arrival_seq"], "place", table=work.table), "placed")
            here = placed.groupBy("entity_key").agg(F.max("place").alias("n"))
            stored = totals.lookup(here, batch_id)
            before = stored.groupBy("entity_key").agg(F.max("total").alias("before"))
            known = work.table(here.join(before, "entity_key", "left").select("entity_key", "n", F.coalesce("before", F.lit(0)).alias("before")), "known")
            counted = placed.join(known.drop("n"), "entity_key").withColumn("events_so_far", F.col("place") + F.col("before")).drop("place", "before")
            rated(counted, intel).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            totals.write(known.select("entity_key", (F.col("n") + F.col("before")).alias("total")), batch_id)

    return _start(events.writeStream.foreachBatch(follow), checkpoint, available_now)


def late_rows(
    events: DataFrame, on_time: str, late: str, marks: str, checkpoint: str, size: str = "5 minutes", lateness: str = "10 minutes",
    available_now: bool = False,
) -> StreamingQuery:
    """Split a stream at its watermark: rows in time and, as rows too, those whose window was closed when they came.

    The watermark of a micro-batch is the latest event time of all batches before it less ``lateness``, kept in
    ``marks``, one row per batch. A row is late if the end of its window is not after it; it goes to ``late`` with its
    ``batch_id`` and the ``watermark`` that it missed. Rows without a time are in time. Windows over ``on_time`` and the
    late rows make up all rows.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema("batch_id long, latest timestamp").parquet(marks).where(F.col("batch_id") < batch_id) if batch_id else None
        latest = seen.agg(F.max("latest")).first()[0] if seen is not None else None
        mark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        # not F.window, which drops rows without a time
        micros, step = F.unix_micros(F.col("ts").cast("timestamp")), F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {size}"))
        end = F.timestamp_micros(micros - F.pmod(micros, step) + step)
        behind = F.coalesce(end <= mark, F.lit(False)) if latest is not None else F.lit(False)
        with Scratch(spark) as work:
            rows = work.table(batch.withColumn("__late", behind), "split")
            rows.where("NOT __late").drop("__late").write.mode("overwrite").parquet(f"{on_time}/batch_id={batch_id}")
            rows.where("__late").drop("__late").withColumn("watermark", mark).write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
            rows.agg(F.max(F.col("ts").cast("timestamp")).alias("latest")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")

    return _start(events.writeStream.foreachBatch(split), checkpoint, available_now)


def alert_feed(alerts: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """One consumer of new alerts; every consumer has its own checkpoint and sees each alert."""
    return _start(alerts.writeStream.outputMode("append").foreachBatch(deliver), checkpoint, available_now)


def incident_stream(events: DataFrame, intel: DataFrame, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Incident state per source, kept for ever; changed incidents are written per micro-batch.

    The state is the batch roll-up itself (count, first, latest) as a streaming aggregate: partial
    sums first, so a hot source costs one row per task. Without a watermark late events always count.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    out = incidents(investigated(events, intel))
    return _start(out.writeStream.outputMode("update").foreachBatch(publish), checkpoint, available_now)


def latest_snapshots(snapshots: DataFrame, keys: tuple[str, ...] = ("incident_id",)) -> DataFrame:
    """Current rows from the snapshot table: the last one written per key."""
    rest = [c for c in snapshots.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*rest), "batch_id").alias("s")
    return snapshots.groupBy(*keys).agg(newest).select(*keys, "s.*")


def compact_snapshots(spark: SparkSession, table: str, compacted: str, keys: tuple[str, ...] = ("incident_id",)) -> DataFrame:
    """Write the current rows to ``compacted``, where they replace all snapshots up to their newest batch.

    Readers union ``compacted`` with the later ``batch_id`` folders of ``table``; the older ones may go.
    """
    snapshots = spark.read.parquet(table)
    upto = snapshots.agg(F.max("batch_id")).first()[0]
    latest_snapshots(snapshots.where(F.col("batch_id") <= upto), keys).withColumn("batch_id", F.lit(upto)).write.mode("overwrite").parquet(compacted)
    return spark.read.parquet(compacted)


def windowed(events: DataFrame, size: str = "5 minutes", slide: str | None = None, lateness: str | None = "10 minutes") -> DataFrame:
    """Events per source in tumbling or sliding windows; the batch and the streaming form alike.

    With a watermark, later rows are dropped and show in ``numRowsDroppedByWatermark``.
    """
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp"))
    if lateness and events.isStreaming:
        timed = timed.withWatermark("event_time", lateness)
    span = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    counted = timed.groupBy(span.alias("w"), "src_ip").agg(F.count("*").alias("event_count"))
    return counted.select(
        "src_ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_count"
    )


def sessions(events: DataFrame, gap: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Streaming sessions per source."""
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("event_time", lateness)
    counted = timed.groupBy(F.session_window("event_time", gap).alias("w"), "src_ip").agg(F.count("*").alias("event_count"))
    return counted.select("src_ip", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_count")


def window_updates(counted: DataFrame, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Every changed window per micro-batch; ``latest_snapshots`` of the table is the count over all rows
    that came in time, open windows included."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return _start(counted.writeStream.outputMode("update").foreachBatch(publish), checkpoint, available_now)


def session_snapshots(counted: DataFrame, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """All sessions so far, open ones included, replacing the table with every micro-batch.

    Sessions merge as rows arrive, so their current rows can't be told by a key: the whole result is
    written. For a feed of finished sessions use ``window_stream``.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    return _start(counted.writeStream.outputMode("complete").foreachBatch(publish), checkpoint, available_now)


def window_stream(counted: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Closed windows into a table."""
    writer = counted.writeStream.outputMode("append").format("parquet").option("path", path)
    return _start(writer, checkpoint, available_now)

