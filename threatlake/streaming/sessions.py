"""Sessions of a stream as a change log: what each micro-batch opened, extended, merged and finished.

Only open sessions are state. A micro-batch reduces its rows to sessions of their own, merges these with the open
ones and logs the sessions that changed; those that no row in time can reach any more are logged as finished and leave the
state. Nothing that was logged before is read or written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from threatlake.operators.correlate import WINDOW_SECONDS, epoch_micros, session_groups
from threatlake.session import Scratch
from threatlake.streaming.jobs import _start, latest_snapshots

#: A session of the log is known by these; its start moves only by retraction.
SESSION_KEY = ("src_ip", "session_start")


def _merged(parts: DataFrame, gap_seconds: int) -> DataFrame:
    """``parts`` (sessions that may touch) with ``first``, the start of the merged session each belongs to.

    A source is bounded by its sessions in the batch and its open ones, not by its rows.
    """
    in_time = W.partitionBy("src_ip").orderBy("session_start", "session_end")
    reach = F.max("session_end").over(in_time.rowsBetween(W.unboundedPreceding, -1))
    silence = epoch_micros(F.col("session_start")) - epoch_micros(reach)
    opens = F.when(reach.isNull() | (silence > gap_seconds * 1_000_000), F.col("session_start"))
    upto = in_time.rowsBetween(W.unboundedPreceding, W.currentRow)
    return parts.withColumn("opens", opens).withColumn("first", F.last("opens", ignorenulls=True).over(upto)).drop("opens")


def _before(mark: Column, seconds: int) -> Column:
    return mark - F.make_dt_interval(secs=F.lit(seconds))


def session_log(
    events: DataFrame, log: str, late: str, state: str, checkpoint: str, gap_seconds: int = WINDOW_SECONDS,
    lateness_seconds: int = 600, available_now: bool = False,
) -> StreamingQuery:
    """Log the changes of the sessions per source, a folder per micro-batch.

    A row of the log is ``set`` (the session is new or changed; ``finished`` tells whether it is closed) or ``retract``
    (it is no session of its own any more; ``replaced_by`` is the start of the one that took it in). A key has one
    row per batch, so ``current_sessions`` is the last row per key.

    The watermark of a batch is the latest time of the batches before it less the lateness. Rows behind it go to
    ``late`` with the ``watermark`` they missed; a session is finished once the gap after its end lies behind the watermark
    of the next batch, so no row in time can extend it. Rows without a time or a source belong to no session.

    The state (open sessions, latest time) lies in two places used in turn: a batch reads what the one before it
    wrote and replaces what the one before that wrote. A replayed batch so reads the same and writes the same.
    """

    def follow(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine, last = f"{state}/turn={batch_id % 2}", f"{state}/turn={(batch_id - 1) % 2}"
        seen = spark.read.parquet(f"{last}/latest").first()[0] if batch_id else None
        stamp = batch.schema["ts"].dataType
        mark = _before(F.lit(seen).cast(stamp), lateness_seconds)
        with Scratch(spark) as work:
            timed = batch.where(F.col("src_ip").isNotNull() & F.col("ts").isNotNull())
            missed = F.lit(False) if seen is None else F.col("ts") < mark
            timed.where(missed).withColumn("watermark", mark).write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
            fresh = session_groups(timed.where(~missed), gap_seconds).drop("session_no").withColumn("known", F.lit(False))
            parts = fresh
            if batch_id:
                parts = parts.unionByName(spark.read.parquet(f"{last}/open").withColumn("known", F.lit(True)))
            parts = work.table(_merged(parts, gap_seconds), "parts")
            latest = parts.agg(F.greatest(F.max("session_end"), F.lit(seen).cast(stamp)).alias("latest"))
            latest = work.table(latest, "latest")
            ahead = _before(F.lit(latest.first()[0]).cast(stamp), lateness_seconds + gap_seconds)
            whole = parts.groupBy("src_ip", F.col("first").alias("session_start")).agg(
                F.max("session_end").alias("session_end"), F.sum("event_count").alias("event_count"),
                F.bool_or(~F.col("known")).alias("changed"),
            )
            whole = work.table(whole.withColumn("finished", F.col("session_end") < ahead), "whole")
            logged = whole.where("changed OR finished").select(
                F.lit("set").alias("change"), *SESSION_KEY, "session_end", "event_count", "finished", F.lit(None).cast(stamp).alias("replaced_by"))
            gone = parts.where("known AND session_start <> first").select(
                F.lit("retract").alias("change"), *SESSION_KEY, "session_end", "event_count", F.lit(False).alias("finished"), F.col("first").alias("replaced_by"))
            logged.union(gone).write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
            whole.where("NOT finished").select(*SESSION_KEY, "session_end", "event_count").write.mode("overwrite").parquet(f"{mine}/open")
            latest.write.mode("overwrite").parquet(f"{mine}/latest")

    return _start(events.writeStream.foreachBatch(follow), checkpoint, available_now)


def current_sessions(log: DataFrame) -> DataFrame:
    """The log applied: every session, finished or open, as after its newest batch."""
    return latest_snapshots(log, SESSION_KEY).where("change = 'set'").select(*SESSION_KEY, "session_end", "event_count", "finished")


def open_sessions(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    """The state after a batch, while neither the next but one has replaced it."""
    return spark.read.parquet(f"{state}/turn={batch_id % 2}/open")
