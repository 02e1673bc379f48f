"""Flow behaviour from packets, as arrays on the flow row or as packet rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatlake.functions import flow


def from_arrays(flows: DataFrame) -> DataFrame:
    """Add behaviour columns to flows carrying ``packet_lengths`` and ``inter_arrival_times``."""
    return flows.withColumns({
        "total_packets": flow.total_packets(F.col("packets_out"), F.col("packets_in")),
        "upload_download_ratio": flow.upload_ratio(F.col("bytes_out"), F.col("bytes_in")),
        "periodicity_cov": flow.periodicity(F.col("inter_arrival_times")),
        "packet_length_mean": flow.packet_mean(F.col("packet_lengths")),
    })


def from_packets(packets: DataFrame, key: str) -> DataFrame:
    """Behaviour per flow from packet rows (outbound, bytes, interval): partial aggregates only."""
    out = F.col("outbound")
    rolled = packets.groupBy(key).agg(
        F.count_if(out).alias("packets_out"),
        F.count_if(~out).alias("packets_in"),
        F.coalesce(F.sum(F.when(out, F.col("bytes"))), F.lit(0)).alias("bytes_out"),
        F.coalesce(F.sum(F.when(~out, F.col("bytes"))), F.lit(0)).alias("bytes_in"),
        F.avg("bytes").alias("packet_length_mean"),
        F.avg("interval").alias("__mean"),
        F.stddev_pop("interval").alias("__spread"),
    )
    cov = (
        F.when(F.col("__mean").isNull(), F.lit(flow.NO_PERIODICITY))
        .when(F.col("__mean") == 0, F.lit(0.0))
        .otherwise(F.col("__spread") / F.col("__mean"))
    )
    return rolled.withColumns({
        "total_packets": flow.total_packets(F.col("packets_out"), F.col("packets_in")),
        "upload_download_ratio": flow.upload_ratio(F.col("bytes_out"), F.col("bytes_in")),
        "periodicity_cov": cov,
    }).drop("__mean", "__spread")
