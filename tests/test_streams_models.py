"""Streams equal their batch forms; models train, predict, save and load."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake.adapters import load, table
from threatlake.catalog import queries as q
from threatlake.operators import alerts as desk, detection, incidents as inc, isolation, models, quality
from threatlake.plans import detect as plan
from threatlake.sources import alerts as source
from threatlake.streaming import jobs


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_detect_stream_equals_batch(spark, sf, tmp_path):
    features = ["m3_confidence", "m4_confidence", "m4_anomaly"]
    stream = q._stream(spark, sf, "lineitem", "predicted_flows")
    counters = jobs.QualityCounters()
    spark.streams.addListener(counters)
    query = jobs.detect_stream(stream, features, str(tmp_path / "out"), str(tmp_path / "mark"), available_now=True)
    query.awaitTermination()
    cols = ["flow_id", "status", "threat_class", "decision", "severity", "error_type"]
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = plan.detect(load(spark, sf, "predicted_flows"), features)
    assert rows(got.select(cols)) == rows(batch.select(cols))
    seen = [p["observedMetrics"]["quality"] for p in query.recentProgress if p["observedMetrics"]]
    assert sum(s["processed"] for s in seen) == got.where("status = 'success'").count()
    assert sum(s["failed"] for s in seen) == got.where("status = 'error'").count() > 0
    deadline = time.time() + 20  # listeners run behind the query
    while sum(counters.totals[k] for k in ("processed", "failed")) < got.count() and time.time() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(counters)
    assert counters.totals["failed"] == got.where("status = 'error'").count()


def test_incident_stream_equals_batch_over_many_batches(spark, sf, tmp_path):
    """Late and out-of-order events count: the drop is split by event id into three files."""
    events, intel = load(spark, sf, "threat_events"), load(spark, sf, "intel")
    drop = str(tmp_path / "drop")
    for part in range(3):
        events.where(F.col("arrival_seq") % 3 == part).coalesce(1).write.mode("append").parquet(drop)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(drop)
    jobs.incident_stream(stream, intel, str(tmp_path / "out"), str(tmp_path / "mark"), available_now=True).awaitTermination()
    snapshots = spark.read.parquet(str(tmp_path / "out"))
    assert snapshots.select("batch_id").distinct().count() == 3
    latest = jobs.latest_snapshots(snapshots)
    batch = inc.incidents(inc.investigated(events, intel))
    assert rows(latest.select(batch.columns)) == rows(batch)


def test_alert_stream_and_feeds(spark, sf, tmp_path):
    home, drop = str(tmp_path / "alerts"), str(tmp_path / "drop")
    alerts = desk.to_bodies(load(spark, sf, "desk_alerts")).select("arrival_seq", "body")
    from threatlake.plans.desk import accept
    good, bad = accept(alerts)
    source.reset_table(good.where("false"), home)
    for low in (0, 500, 1000):
        alerts.where(F.col("arrival_seq").between(low, low + 499)).coalesce(1).write.mode("append").parquet(drop)
    stream = source.stream(spark, drop, alerts.schema, files_per_trigger=3)
    jobs.alert_stream(stream, home, str(tmp_path / "rejects"), str(tmp_path / "mark"), available_now=True).awaitTermination()
    got = spark.read.parquet(home)
    assert got.count() == got.select("alert_id").distinct().count() == good.select("alert_id").distinct().count()
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == bad.count()
    jobs.alert_stream(stream, home, str(tmp_path / "rejects"), str(tmp_path / "replay"), available_now=True).awaitTermination()
    assert spark.read.parquet(home).count() == got.count()  # a replay adds nothing
    for name in ("desk", "pager"):
        seen = str(tmp_path / name)
        feed = source.stream(spark, home, got.schema)
        jobs.alert_feed(feed, lambda b, i, p=seen: b.write.mode("overwrite").parquet(f"{p}/b={i}"), str(tmp_path / f"m-{name}"), available_now=True).awaitTermination()
        assert spark.read.parquet(seen).count() == got.count()


def test_windows_closed_by_watermark(spark, sf, tmp_path):
    stream = q._stream(spark, sf, "events", "threat_events")
    out = str(tmp_path / "out")
    jobs.window_stream(jobs.windowed(stream), out, str(tmp_path / "mark"), available_now=True).awaitTermination()
    batch = jobs.windowed(load(spark, sf, "threat_events"))
    last = batch.agg(F.max("window_end")).first()[0]
    closed = spark.read.parquet(out)
    missing = batch.join(closed, ["src_ip", "window_start", "window_end", "event_count"], "left_anti")
    assert missing.count() == batch.count() - closed.count()
    assert missing.where(F.col("window_end") < F.lit(last) - F.expr("INTERVAL 20 MINUTES")).isEmpty()
    sliding = jobs.windowed(load(spark, sf, "threat_events"), slide="1 minute")
    assert sliding.agg(F.sum("event_count")).first()[0] == 5 * table(spark, sf, "events").count()


def test_session_stream(spark, sf, tmp_path):
    stream = jobs.sessions(q._stream(spark, sf, "events", "threat_events"))
    jobs.window_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark"), available_now=True).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out"))
    batch = jobs.sessions(load(spark, sf, "threat_events"))
    assert closed.join(batch, closed.columns, "left_anti").isEmpty() and 0 <= batch.count() - closed.count() < 15


def test_forests(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = []
    for i in range(900):
        kind = ("BENIGN", "BENIGN", "BENIGN", "BENIGN", "DDOS", "PORT_SCAN")[i % 6]
        shift = {"BENIGN": 0.0, "DDOS": 6.0, "PORT_SCAN": -6.0}[kind]
        data.append((str(i), kind, *(float(v) for v in rng.normal(shift, 1.0, 3)), "oops" if i == 0 else "1"))
    df = spark.createDataFrame(data, "k string, target string, a double, b double, c double, t string").repartition(3)
    features, small = ["a", "b", "c", "t"], models.ForestSettings(trees=5, depth=4)
    weights = {r["target"]: r["w"] for r in models.balanced(df, "target").groupBy("target").agg(F.first("weight").alias("w")).collect()}
    assert weights == {"BENIGN": 0.5, "DDOS": 2.0, "PORT_SCAN": 2.0}
    m3, m4 = models.train_m3(df, features, settings=small), models.train_m4(df, features, settings=small)
    models.save(m4, str(tmp_path / "m4"))
    again = models.load(spark, str(tmp_path / "m4"))
    assert models.load(spark, str(tmp_path / "none")) is None
    forest = isolation.fit(df.select("k", "a", "b", "c"), ["a", "b", "c"], "k", trees=20, sample=64)
    out = detection.fuse(models.predict(df, features, again, m3, None)).cache()
    assert out.where("threat_class = target").count() > 890
    row = out.first()
    assert sum(row["m4_probabilities"].values()) == pytest.approx(1.0, abs=0.001) and set(row["m4_probabilities"]) == {"BENIGN", "DDOS", "PORT_SCAN"}
    assert row["m4_confidence"] == max(row["m4_probabilities"].values()) and row["m4_anomaly"] == 0.0
    alone = detection.fuse(models.predict(df, features, m4))
    assert alone.where("m3_class <> 'BENIGN' OR m3_confidence <> 0").isEmpty()
    scored = forest.score(df.select("k", "target", "a", "b", "c"))
    by = {r["target"]: r["m"] for r in scored.groupBy("target").agg(F.avg("anomaly_score").alias("m")).collect()}
    assert 0 <= by["BENIGN"] < by["DDOS"] <= 1 and by["BENIGN"] < by["PORT_SCAN"]
    span = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert (span[0], span[1]) == (0.0, 1.0)
    assert forest.nodes["tree"].nunique() == 20


def test_isolation_finds_outliers(spark):
    rng = np.random.default_rng(5)
    data = [(str(i), *map(float, rng.normal(0, 1, 2))) for i in range(500)] + [("far", 12.0, -12.0)]
    df = spark.createDataFrame(data, "k string, a double, b double")
    forest = isolation.fit(df, ["a", "b"], "k")
    assert forest.score(df).orderBy(F.desc("anomaly_score")).first()["k"] == "far"
    share = forest.raw_scores(df).where(F.col("raw_score") <= forest.threshold).count() / 501
    assert 0.05 < share < 0.15


def test_repeated_connections(spark):
    # ids run against time as text: 10 comes after 2
    data = [("hot", str(i)) for i in range(300)] + [("cold", str(i)) for i in range(3)] + [(None, str(i)) for i in range(5)]
    df = spark.createDataFrame([(c, o, int(o)) for c, o in data], "c string, o string, t int").repartition(4)
    got = {(r["c"], r["o"]): r["repeated"] for r in detection.repeated_connections(df, ["c"], ["t", "o"]).collect()}
    assert got == {(c, o): int(o) >= 3 for c, o in data}


def test_event_assembly_and_routing(spark, sf):
    base = plan.classify(load(spark, sf, "predicted_flows"))
    a = detection.assemble(base, ["flow_id"])
    assert a.select("event_id").distinct().count() == base.count()
    assert rows(a.select("event_id", "alert.alert_id")) == rows(detection.assemble(base, ["flow_id"]).select("event_id", "alert.alert_id"))
    report = quality.validate_flows(base, ["m3_confidence"])
    assert detection.batch_quality(report).first()["total"] == base.count()


def folders(spark):
    """Tables that scratch databases hold now."""
    names = [r[0] for r in spark.sql("SHOW DATABASES").collect() if r[0].startswith("scratch_")]
    return sum(spark.sql(f"SHOW TABLES IN {n}").count() for n in names)


def test_scratch_goes_with_its_block_and_on_release(spark, sf, tmp_path):
    from threatlake import session
    session.release(spark)
    with session.Scratch(spark) as work:
        one = work.table(spark.range(5), "one")
        kept = work.keep(spark.range(7), "two")
        assert one.count() == 5 and folders(spark) == 2
    assert folders(spark) == 1 and kept.count() == 7
    session.release(spark)
    assert folders(spark) == 0
    alerts = desk.to_bodies(load(spark, sf, "desk_alerts")).select("arrival_seq", "body")
    drop, home = str(tmp_path / "drop"), str(tmp_path / "home")
    for part in range(20):
        alerts.where(F.col("arrival_seq") % 20 == part).coalesce(1).write.mode("append").parquet(drop)
    from threatlake.plans.desk import accept
    source.reset_table(accept(alerts.limit(0))[0], home)
    session.release(spark)
    stream = source.stream(spark, drop, alerts.schema, files_per_trigger=1)
    jobs.alert_stream(stream, home, str(tmp_path / "rejects"), str(tmp_path / "mark"), available_now=True).awaitTermination()
    assert folders(spark) == 0 and spark.read.parquet(home).count() > 0


def test_third_class_and_unlabelled_rows(spark):
    rng = np.random.default_rng(1)
    data = [(k, float(rng.normal(s, 0.3))) for k, s in (("BENIGN", 0), ("DDOS", 5), ("PORT_SCAN", -5), ("BOTNET", 0), (None, 9)) for _ in range(40)]
    df = spark.createDataFrame(data, "target string, a double")
    small = models.ForestSettings(trees=5, depth=4)
    m3 = models.train_m3(df, ["a"], settings=small)
    assert set(models.labels_of(m3)) == set(models.M3_CLASSES) and models.unlabelled(df) == 40
    assert set(models.labels_of(models.train_m4(df, ["a"], settings=small))) == {"BENIGN", "BOTNET", "DDOS", "PORT_SCAN"}


def test_window_updates_cover_open_windows(spark, sf, tmp_path):
    events = load(spark, sf, "threat_events")
    drop, out = str(tmp_path / "drop"), str(tmp_path / "out")
    for part in range(3):
        events.where(F.col("arrival_seq") % 3 == part).coalesce(1).write.mode("append").parquet(drop)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(drop)
    jobs.window_updates(jobs.windowed(stream, lateness=None), out, str(tmp_path / "mark"), available_now=True).awaitTermination()
    keys = ("src_ip", "window_start", "window_end")
    latest = jobs.latest_snapshots(spark.read.parquet(out), keys)
    assert rows(latest) == rows(jobs.windowed(events).select(latest.columns))
    compacted = jobs.compact_snapshots(spark, out, str(tmp_path / "small"), keys)
    assert compacted.count() == latest.count() and rows(jobs.latest_snapshots(compacted, keys)) == rows(latest)


def test_isolation_forest_is_fitted_on_all_valid_training_rows(spark, sf, monkeypatch):
    seen = {}
    monkeypatch.setattr(q, "TRAIN_ROWS", 50)
    monkeypatch.setattr(q, "_FITTED", {})
    monkeypatch.setattr(q.models, "train_m3", lambda df, *a: seen.setdefault("m3", df.count()))
    monkeypatch.setattr(q.models, "train_m4", lambda df, *a: seen.setdefault("m4", df.count()))
    monkeypatch.setattr(q.isolation, "fit", lambda df, *a: seen.setdefault("anomaly", df.count()))
    rows, _ = q.fitted(spark, sf)
    train = q.quality.validate_flows(rows, q.FEATURES).where("is_valid AND split = 'train' AND target IS NOT NULL").count()
    assert seen == {"m3": 50, "m4": 50, "anomaly": train} and train > 50
