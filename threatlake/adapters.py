"""Star-schema test tables -> flows, threat events, desk alerts, domains.

Each text is plain SQL that Spark and other engines read alike; ``{table}`` marks an input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.contracts import flow_contract

THREAT_EVENTS = """
SELECT concat('evt-', event_id) AS event_id, event_id AS arrival_seq, ts,
  concat('10.0.', CAST(FLOOR(user_id / 50) AS BIGINT), '.', user_id % 50 + 1) AS src_ip,
  concat('192.168.1.', event_id % 20 + 1) AS dst_ip,
  CASE k % 7 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 6667
    WHEN 4 THEN 53 WHEN 5 THEN 8080 ELSE 9999 END AS dst_port,
  CASE event_type WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN 'PORT_SCAN'
    WHEN 'signup' THEN 'BRUTE_FORCE' WHEN 'purchase' THEN 'WEB_ATTACK'
    ELSE CASE k % 3 WHEN 0 THEN 'DDOS' WHEN 1 THEN 'BOTNET' ELSE 'INFILTRATION' END END AS threat_class,
  CAST(50 + k % 51 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CAST(event_id * 37 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS anomaly_score,
  CASE k % 10 WHEN 0 THEN ' Blog.Tionsh.example.NET' WHEN 1 THEN concat('192.168.1.', event_id % 20 + 1)
    WHEN 2 THEN '  ' END AS domain,
  CASE WHEN k % 25 = 3 THEN upper(md5(CAST(event_id AS VARCHAR(20)))) END AS file_hash
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

FLOWS = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS flow_id,
  l_shipdate AS ts,
  concat('10.1.', l_suppkey % 4, '.', l_suppkey % 100 + 1) AS src_ip,
  concat('172.16.0.', l_partkey % 50 + 1) AS dst_ip,
  CASE l_partkey % 8 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 53
    WHEN 4 THEN 6667 WHEN 5 THEN 4444 WHEN 6 THEN 8443 ELSE 3389 END AS dst_port,
  l_quantity AS total_fwd_packets, CAST(l_linenumber AS DOUBLE) AS total_bwd_packets,
  CAST(FLOOR(l_extendedprice * CASE WHEN l_returnflag = 'A' THEN 20 ELSE 1 END) AS DOUBLE) AS total_fwd_bytes,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN CAST(0 AS DOUBLE)
    ELSE CAST(FLOOR(l_extendedprice * (l_discount * 4 + l_tax)) AS DOUBLE) END AS total_bwd_bytes,
  CAST(l_partkey % 1600 AS DOUBLE) AS fwd_pkt_len_max,
  CAST(l_partkey % 128 AS DOUBLE) AS fwd_pkt_len_mean,
  l_tax * 1000 AS flow_iat_mean,
  l_quantity * 100 * (l_linenumber % 2) AS flow_duration,
  CASE l_returnflag WHEN 'A' THEN 'DDoS' WHEN 'R' THEN 'PortScan' ELSE CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE 'BENIGN' END END AS label
FROM {lineitem}
"""

FLOWS_DIRTY = """
SELECT h AS row_key,
  CASE WHEN h % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS total_fwd_packets,
  CASE WHEN h % 17 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity * 100 END AS flow_duration,
  CASE WHEN h % 19 = 0 THEN NULL ELSE CAST(l_partkey % 128 AS DOUBLE) END AS fwd_pkt_len_mean,
  CASE WHEN h % 23 = 0 THEN 'bad' ELSE CAST(l_linenumber AS VARCHAR(10)) END AS total_bwd_packets_text,
  0 AS urg_flag, l_shipdate AS ts
FROM (SELECT *, l_orderkey AS h FROM {lineitem}
      UNION ALL SELECT *, l_orderkey AS h FROM {lineitem} WHERE l_orderkey % 29 = 0) l
"""

DESK_ALERTS = """
SELECT o_orderkey AS arrival_seq,
  concat(CASE WHEN o_orderkey % 17 = 0 THEN 'BAD-' ELSE 'ALT-' END,
         o_orderkey - CASE WHEN o_orderkey % 5 = 4 THEN 1 ELSE 0 END) AS alert_id,
  CASE WHEN o_orderkey % 29 = 0 THEN 'not-a-date' ELSE concat(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10), 'T00:00:00Z') END AS event_time,
  CASE o_orderkey % 6 WHEN 0 THEN 'Port Scan' WHEN 1 THEN 'DDoS' WHEN 2 THEN 'C2 Communication'
    WHEN 3 THEN 'Suspicious DNS' WHEN 4 THEN 'Brute Force' ELSE 'Data Exfiltration' END AS threat,
  CASE WHEN o_orderkey % 23 = 0 THEN 'EXTREME' WHEN o_orderpriority = '1-URGENT' THEN 'CRITICAL'
    WHEN o_orderpriority = '2-HIGH' THEN 'HIGH' WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CAST(o_custkey % 111 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  concat('10.2.0.', o_custkey % 200 + 1) AS source_ip, concat('192.168.2.', o_orderkey % 50 + 1) AS destination_ip,
  o_custkey * 97 % 70000 AS source_port, 443 AS destination_port,
  CASE o_orderstatus WHEN 'P' THEN 'TCP' WHEN 'F' THEN 'UDP' ELSE 'DNS' END AS protocol,
  CASE WHEN o_orderkey % 31 = 0 THEN 'X1' ELSE 'T1046' END AS technique
FROM {orders}
"""

DOMAINS = """
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain FROM {pages}
UNION ALL
SELECT page_id, concat(substr(md5(CAST(page_id AS VARCHAR(20))), 1, 16),
  CASE page_id % 3 WHEN 0 THEN '.ru' WHEN 1 THEN '.com' ELSE '.xyz' END) FROM {pages}
"""

INTEL = """
SELECT * FROM (VALUES
  ('IPv4','10.0.0.6','MALICIOUS',CAST(0.91 AS DOUBLE),'feed-b','actor-1'), ('IPv4','10.0.1.9','SUSPICIOUS',CAST(0.64 AS DOUBLE),'feed-a',NULL),
  ('IPv4','10.0.2.3','BENIGN',CAST(0.90 AS DOUBLE),'feed-a',NULL), ('IPv4','192.168.1.4','SUSPICIOUS',CAST(0.91 AS DOUBLE),'feed-a',NULL),
  ('IPv4','192.168.1.7','BENIGN',CAST(0.80 AS DOUBLE),'feed-c',NULL), ('Domain','blog.tionsh.example.net','MALICIOUS',CAST(0.96 AS DOUBLE),'feed-a','actor-2'),
  ('IPv4','10.0.0.6','BENIGN',CAST(0.99 AS DOUBLE),'feed-a',NULL), ('IPv4','192.168.1.4','MALICIOUS',CAST(0.50 AS DOUBLE),NULL,NULL)
) AS t(ioc_type, value, reputation, confidence, source, threat_actor)
"""

# Model verdicts for a flow, by rule, so that fusion and event assembly can be checked in SQL.
PREDICTED_FLOWS = """
SELECT flow_id, ts, src_ip, dst_ip, dst_port,
  CASE WHEN label = 'DDoS' THEN 'DDOS' WHEN label = 'PortScan' THEN 'PORT_SCAN' ELSE 'BENIGN' END AS m3_class,
  CASE WHEN total_bwd_packets = 7 THEN NULL
    ELSE CAST(50 + CAST(fwd_pkt_len_mean AS INT) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) END AS m3_confidence,
  CASE CAST(total_fwd_packets AS INT) % 6 WHEN 0 THEN 'BOTNET' WHEN 1 THEN 'WEB_ATTACK' WHEN 2 THEN 'BRUTE_FORCE'
    ELSE 'BENIGN' END AS m4_class,
  CAST(60 + CAST(fwd_pkt_len_max AS INT) % 40 AS DOUBLE) / CAST(100 AS DOUBLE) AS m4_confidence,
  CAST(CAST(total_fwd_bytes AS BIGINT) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS m4_anomaly
FROM ({flows}) f
"""

#: all contract columns by rule: eight as in ``flows``, the others whole numbers of the line's keys
_KNOWN = {
    "destination_port": "dst_port", "flow_duration": "CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE flow_duration END",
    "total_fwd_packets": "total_fwd_packets", "total_backward_packets": "total_bwd_packets",
    "total_length_of_fwd_packets": "total_fwd_bytes", "total_length_of_bwd_packets": "total_bwd_bytes",
    "fwd_packet_length_max": "fwd_pkt_len_max", "fwd_packet_length_mean": "fwd_pkt_len_mean", "flow_iat_mean": "flow_iat_mean",
    "flow_bytes_s": "CASE WHEN l_partkey % 59 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE total_fwd_bytes / 8 END",
}
_FULL = ", ".join(
    f"CAST({_KNOWN.get(c, f'(l_partkey * {i + 3} + l_suppkey * 7 + l_linenumber) % {50 + 13 * i}')} AS DOUBLE) AS {c}"
    for i, c in enumerate(flow_contract().columns)
)

def _full_text(carry: Sequence[str] = ()) -> str:
    keyed = ", ".join(dict.fromkeys(["l_partkey", "l_suppkey", "l_linenumber", *carry]))
    return f"SELECT {', '.join(['flow_id, ts, src_ip, dst_ip, dst_port, label', _FULL, *carry])} FROM ({FLOWS.replace('l_shipdate AS ts,', f'l_shipdate AS ts, {keyed},')}) f"


FULL_FLOWS = _full_text()

_INPUTS = {
    "full_flows": (FULL_FLOWS, ("lineitem",)),
    "threat_events": (THREAT_EVENTS, ("events",)),
    "flows": (FLOWS, ("lineitem",)),
    "flows_dirty": (FLOWS_DIRTY, ("lineitem",)),
    "desk_alerts": (DESK_ALERTS, ("orders",)),
    "domains": (DOMAINS, ("pages",)),
    "intel": (INTEL, ()),
    "predicted_flows": (PREDICTED_FLOWS.replace("{flows}", FLOWS), ("lineitem",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, inputs = _INPUTS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in inputs})


def full_flows(lines: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``FULL_FLOWS`` of given rows of ``lineitem``, with the columns ``carry`` of theirs behind the others."""
    return lines.sparkSession.sql(_full_text(carry), lineitem=lines)


def lone_tasks(rows: DataFrame) -> bool:
    """Some task would read more than twice its share of the rows: a row group is one task, however large it is.

    Counts rows per partition of a scan, which reads no column.
    """
    held = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    most, total = held.agg(F.max("n"), F.sum("n")).first()
    return (most or 0) * rows.sparkSession.sparkContext.defaultParallelism > 2 * (total or 0)


def spread(rows: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``rows`` dealt evenly, two tasks per core, where ``lone_tasks`` says so of them, or of ``like`` for a stream of its files."""
    if not lone_tasks(rows if like is None else like):
        return rows
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def sql_text(name: str) -> str:
    """The adapter as a sub-query over tables registered under their own names."""
    text, inputs = _INPUTS[name]
    return text.format(**{t: t for t in inputs}).strip()
