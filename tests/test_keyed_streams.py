"""Keyed state between micro-batches: alerts, running risk, late rows; replays and restarts."""

import re

import pytest
from pyspark.sql import functions as F

from threatlake.adapters import load
from threatlake.operators import alerts as desk, incidents as inc
from threatlake.plans.desk import accept
from threatlake.sources import flows as source
from threatlake.streaming import jobs, sessions
from threatlake.streaming.keyed import SEED, KeyedTable


def told(df):
    return sorted(map(repr, df.collect()))


def again(mark, batch):
    """Forget that a batch was committed: it runs again."""
    (mark / "commits" / str(batch)).unlink()
    (mark / "commits" / f".{batch}.crc").unlink(missing_ok=True)


@pytest.fixture(scope="module")
def events(spark, sf):
    return load(spark, sf, "threat_events").cache()


def test_lookup_reads_the_buckets_of_its_keys(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    store = KeyedTable(str(tmp_path), "k", rows.schema, 16)
    store.write(rows, SEED)
    store.write(rows.where("v < 10").withColumn("v", F.col("v") + 1), 0)
    keys = spark.createDataFrame([("k3",), ("k700",), (None,), ("k3",)], "k string")
    found = store.lookup(keys, 1)
    assert len(store.buckets_of(keys)) <= 2
    assert {(r["k"], r["v"], r["batch_id"]) for r in found.collect()} >= {("k3", 3, -1), ("k3", 4, 0), ("k700", 700, -1)}
    assert found.count() < 300
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", found._jdf.queryExecution().toString())[1]
    assert "bucket" in filters and "batch_id" in filters
    assert store.lookup(keys, 0).where("batch_id >= 0").isEmpty() and store.lookup(keys.limit(0), 1).isEmpty()
    store.write(rows.where("v < 5"), 0)  # a replay replaces
    assert store.read(spark).where("batch_id = 0").count() == 5
    merged = KeyedTable(str(tmp_path / "merged"), "k", rows.schema, 8)
    store.write(rows.where("v = 1"), 1)
    store.compact(spark, merged, 0, lambda r: r.groupBy("k").agg(F.max_by("v", "batch_id").alias("v")))
    assert merged.read(spark).where("batch_id = -1").count() == 1000 and merged.read(spark).where("batch_id = 1").count() == 1


def test_alerts(spark, sf, tmp_path):
    """As in one batch, whatever the micro-batches; a replay and a restart add nothing."""
    rows = load(spark, sf, "desk_alerts")
    bodies = desk.to_bodies(rows).select("arrival_seq", "body")
    good, bad = accept(bodies)
    store = KeyedTable(str(tmp_path / "store"), "alert_id", good.schema, 8)
    seed = desk.first_by_id(good.where("arrival_seq % 3 = 0"))
    store.write(seed, SEED)
    drop, mark, rejects = str(tmp_path / "drop"), tmp_path / "mark", str(tmp_path / "rejects")
    last = rows.agg(F.max("arrival_seq")).first()[0]
    run = lambda: jobs.keyed_alert_stream(source.stream(spark, drop, bodies.schema), store, rejects, str(mark), available_now=True).awaitTermination()
    for part in range(3):
        bodies.where(F.col("arrival_seq").between(part * last // 3 + (part > 0), (part + 1) * last // 3)).write.mode("append").parquet(drop)
        run()
    want = told(desk.append(seed, good).select("alert_id", "arrival_seq"))
    stored = lambda: told(store.read(spark).select("alert_id", "arrival_seq"))
    assert stored() == want and spark.read.parquet(rejects).count() == bad.count()
    again(mark, 2)
    run()
    assert stored() == want and spark.read.parquet(rejects).count() == bad.count()


def test_running_risk(spark, sf, events, tmp_path):
    """Row by row what the batch operator gives; one source holds most rows; the second batch runs twice."""
    hot = events.withColumn("src_ip", F.when(F.col("arrival_seq") % 10 < 7, F.lit("10.0.0.1")).when(F.col("arrival_seq") % 10 == 7, None).otherwise(F.col("src_ip")))
    intel = load(spark, sf, "intel")
    totals = KeyedTable(str(tmp_path / "totals"), "entity_key", jobs.TOTALS, 8)
    totals.write(spark.createDataFrame([], jobs.TOTALS), SEED)
    drop, mark, out = str(tmp_path / "drop"), tmp_path / "mark", str(tmp_path / "out")
    last = hot.agg(F.max("arrival_seq")).first()[0]
    run = lambda: jobs.running_stream(source.stream(spark, drop, hot.schema), intel, totals, out, str(mark), available_now=True).awaitTermination()
    for part in range(3):
        hot.where(F.col("arrival_seq").between(part * last // 3 + (part > 0), (part + 1) * last // 3)).write.mode("append").parquet(drop)
        run()
        if part == 1:
            again(mark, 1)
            run()
    columns = ["event_id", "entity_key", "events_so_far", "risk_score", "risk_level"]
    assert told(spark.read.parquet(out).select(columns)) == told(inc.running_risk(hot, intel).select(columns))
    final = totals.read(spark).groupBy("entity_key").agg(F.max("total").alias("n"))
    assert told(final) == told(inc.keyed(hot).groupBy("entity_key").agg(F.count("*").alias("n")))


def test_late_rows(spark, events, tmp_path):
    """In time and late make up all rows; the late ones are behind all that came before them."""
    rows = events.withColumn("ts", F.when(F.col("arrival_seq") % 50 != 0, F.col("ts")))
    drop, good, late, marks, mark = (str(tmp_path / p) for p in ("drop", "good", "late", "marks", "mark"))
    for part in range(3):
        rows.where(F.col("arrival_seq") % 3 == part).coalesce(1).write.mode("append").parquet(drop)
        jobs.late_rows(source.stream(spark, drop, rows.schema), good, late, marks, mark, available_now=True).awaitTermination()
    kept, missed = spark.read.parquet(good), spark.read.parquet(late)
    assert told(kept.select("event_id").union(missed.select("event_id"))) == told(rows.select("event_id"))
    seen = {r["batch_id"]: r["latest"] for r in spark.read.parquet(marks).collect()}
    for r in missed.collect():
        before = max(v for k, v in seen.items() if k < r["batch_id"])
        assert (before - r["watermark"]).total_seconds() == 600 and r["ts"] <= r["watermark"]
    assert missed.count() > 10 and kept.where("ts IS NULL").count() == rows.where("ts IS NULL").count()
    counts = jobs.windowed(kept.where("ts IS NOT NULL")).agg(F.sum("event_count")).first()[0]
    assert counts + missed.count() == rows.where("ts IS NOT NULL").count()


GAP, LATENESS = 3 * 3600, 2 * 86400


def slow_sessions(rows):
    """Sessions of (source, time) rows by walking them in order."""
    out = []
    for src, ts in sorted(rows):
        if out and out[-1][0] == src and (ts - out[-1][2]).total_seconds() <= GAP:
            out[-1][2], out[-1][3] = ts, out[-1][3] + 1
        else:
            out.append([src, ts, ts, 1])
    return sorted(map(tuple, out))


def test_session_log(spark, events, tmp_path):
    """The log applied is the sessions of all rows in time, one source holds most; a batch runs twice; finished ones leave."""
    n = F.col("arrival_seq")
    rows = events.withColumns({
        "src_ip": F.when(n % 10 < 6, F.lit("10.0.0.1")).when(n % 31 == 7, None).otherwise(F.col("src_ip")),
        "ts": F.when(n % 50 != 0, F.col("ts")),
    }).cache()
    drop, log, late, state = (str(tmp_path / p) for p in ("drop", "log", "late", "state"))
    mark = tmp_path / "mark"
    day = F.dayofmonth(F.coalesce("ts", F.lit("2024-01-02").cast("timestamp_ntz")))
    run = lambda: sessions.session_log(source.stream(spark, drop, rows.schema), log, late, state, str(mark), GAP, LATENESS, available_now=True).awaitTermination()
    for part in range(5):  # each reaches back a day, and a few rows much further
        rows.where(F.least(F.floor((day + (n % 2) + F.when(n % 40 == 3, 9).otherwise(0)) / 8), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(drop)
        run()
        if part in (1, 3):
            before = told(spark.read.parquet(log)), told(spark.read.parquet(late))
            again(mark, part)
            run()
            assert before == (told(spark.read.parquet(log)), told(spark.read.parquet(late)))
    missed = {r["event_id"]: r for r in spark.read.parquet(late).collect()}
    timed = [r for r in rows.collect() if r["src_ip"] is not None and r["ts"] is not None]
    kept = [(r["src_ip"], r["ts"]) for r in timed if r["event_id"] not in missed]
    assert missed and all(r["ts"] < r["watermark"] for r in missed.values())
    found = sessions.current_sessions(spark.read.parquet(log)).collect()
    assert sorted((r["src_ip"], r["session_start"], r["session_end"], r["event_count"]) for r in found) == slow_sessions(kept)
    last = spark.read.parquet(log).agg(F.max("batch_id")).first()[0]
    still = {(r["src_ip"], r["session_start"]) for r in sessions.open_sessions(spark, state, last).collect()}
    assert still == {(r["src_ip"], r["session_start"]) for r in found if not r["finished"]} and 0 < len(still) < len(found)
    changes = spark.read.parquet(log).collect()
    assert len({(r["batch_id"], r["src_ip"], r["session_start"]) for r in changes}) == len(changes)
    sets = {(r["batch_id"], r["src_ip"], r["session_start"]) for r in changes if r["change"] == "set"}
    gone = [r for r in changes if r["change"] == "retract"]
    assert gone and all((r["batch_id"], r["src_ip"], r["replaced_by"]) in sets and r["replaced_by"] < r["session_start"] for r in gone)
    done = {}
    for r in sorted(changes, key=lambda r: r["batch_id"]):  # a finished session is never touched again
        key = (r["src_ip"], r["session_start"])
        assert key not in done
        if r["finished"]:
            done[key] = r
