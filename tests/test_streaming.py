import pytest
from pyspark.sql import functions as F

from blockyard.operators.requests import document_changes, tab_counters
from blockyard.plans.derived import requests
from blockyard.streaming import jobs


@pytest.fixture(scope="module")
def events(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    df = requests(spark, sf_dir).withColumnRenamed("request_id", "event_id").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_counters_equal_batch(spark, events):
    batch, stream = events
    got = jobs.to_memory(jobs.tab_counters_stream(stream), "counters", "update")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in tab_counters(batch).collect()}


def test_document_changes_equal_batch(spark, events):
    batch, stream = events
    shape = lambda df: df.filter("navigation").selectExpr("event_id as nav_id", "tab_id", "ts", "page_url as url", "title")
    got = jobs.to_memory(jobs.document_changes_stream(shape(stream)), "changes")
    want = document_changes(shape(batch)).select("tab_id", "nav_id", "title")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_recent_log(spark, events):
    _, stream = events
    got = jobs.to_memory(jobs.recent_log_stream(stream.withColumnRenamed("event_id", "request_id"), 5), "recent", "update")
    assert got.count() > 0 and all(len(r["ids"]) <= 5 for r in got.collect())


def test_decisions_equal_batch(spark, events, tmp_path):
    import json

    from blockyard.operators.requests import decide_requests
    from blockyard.sources.files import read_rule_sets, rule_tables

    rules = tmp_path / "rules"
    rules.mkdir()
    (rules / "a.json").write_text(json.dumps({"match": ["*news*"], "block": ["*/banner/*"]}))
    (rules / "b.json").write_text(json.dumps({"match": ["*"], "redirect": [{"from": "https://cdn.example.org/*", "to": "https://own.example/$1"}]}))
    batch, stream = events
    shape = lambda df: df.withColumnRenamed("event_id", "request_id").select("request_id", "ts", "url", "page_url", "type")
    jobs.decide_requests_stream(shape(stream), str(rules), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    want = decide_requests(shape(batch), *rule_tables(read_rule_sets(spark, str(rules))[0])).select("request_id", "decision", "target", "decided_by")
    got = spark.read.parquet(str(tmp_path / "out")).select("request_id", "decision", "target", "decided_by")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == batch.count()
    assert {r["decision"] for r in got.collect()} == {"allow", "block", "redirect"}


def test_blocked_updates_equal_batch(spark, events):
    from blockyard.operators.requests import blocked_updates

    batch, stream = events
    got = jobs.to_memory(jobs.blocked_updates_stream(stream), "updates", "update")
    last = {(r["tab_id"], r["window_start"]): r["blocked"] for r in got.collect()}
    assert last == {(r["tab_id"], r["window_start"]): r["blocked"] for r in blocked_updates(batch).collect()}


def batches(spark, tmp_path, frames, schema):
    """One file a batch."""
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    return stream.withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def test_state_over_several_batches(spark, tmp_path):
    """Counters and the log go on from batch to batch, and the list is cut only now and then."""
    kind = "tab_id long, event_id long, ms long, navigation boolean, blocked boolean"
    rows = [(i % 2, i, 1_700_000_000_000 + i * 1000, i % 7 == 0, i % 3 == 0) for i in range(60)]
    stream = batches(spark, tmp_path, [rows[:20], rows[20:35], rows[35:]], kind)
    got = jobs.run_available(jobs.tab_counters_stream(stream), str(tmp_path / "counters"), "update")
    last = {(r["tab_id"], r["nav_no"]): (r["requests"], r["blocked"]) for r in got.orderBy("batch").collect()}
    want = tab_counters(spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_millis("ms")))
    assert last == {(r["tab_id"], r["nav_no"]): (r["requests"], r["blocked"]) for r in want.collect()} and got.select("batch").distinct().count() == 3
    log = jobs.run_available(jobs.recent_log_stream(stream.withColumnRenamed("event_id", "request_id"), 4), str(tmp_path / "log"), "update")
    last = {r["tab_id"]: r["ids"] for r in log.orderBy("batch").collect()}
    assert last == {t: [r[1] for r in rows if r[0] == t][-4:] for t in (0, 1)}


def test_state_expires_after_an_hour_of_silence(spark, tmp_path):
    kind = "tab_id long, event_id long, ms long, navigation boolean, blocked boolean"
    at, hour = 1_700_000_000_000, 3_600_000
    frames = [[(1, 1, at, False, False)], [(2, 2, at + 2 * hour, False, False)], [(2, 3, at + 2 * hour + 1, False, False)], [(1, 4, at + 2 * hour + 2, False, True)]]
    got = jobs.run_available(jobs.tab_counters_stream(batches(spark, tmp_path, frames, kind)), str(tmp_path / "out"), "update").orderBy("batch").collect()
    assert [(r["tab_id"], r["requests"]) for r in got] == [(1, 1), (2, 1), (2, 2), (1, 1)]  # the first tab begins anew


def test_late_and_repeated_rows(spark, tmp_path):
    """Rows that come again count once; rows later than the watermark are dropped, and the progress tells how many."""
    kind = "tab_id long, event_id long, ms long, blocked boolean"
    at = 1_700_000_000_000
    frames = [[(1, 1, at, True), (1, 1, at, True), (1, 2, at + 700, True)], [(1, 2, at + 700, True), (1, 3, at + 60_000, True)], [(1, 4, at + 60_001, True)], [(1, 6, at + 60_700, True)], [(1, 7, at + 60_701, False), (1, 5, at + 1, True)]]
    out = jobs.blocked_updates_stream(batches(spark, tmp_path, frames, kind), key="event_id", observed="seen")
    running = out.writeStream.format("memory").queryName("late_updates").outputMode("update").start()
    try:
        running.processAllAvailable()
        progress = running.recentProgress
    finally:
        running.stop()
    last = {}
    for r in spark.table("late_updates").collect():
        last[r["window_start"]] = max(r["blocked"], last.get(r["window_start"], 0))
    assert sum(last.values()) == 5 and max(last.values()) == 2  # events 1, 2, 3, 4 and 6; 3 and 4 share a window
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) >= 1
    assert sum(p["observedMetrics"]["seen"]["rows"] for p in progress if p["numInputRows"]) == 9
