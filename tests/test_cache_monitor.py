"""The detection cache asks for each text once; the monitor's stream says the same as the table, and notices silence."""

import datetime as dt
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from pairlens.operators.cache import DetectionCache
from pairlens.streaming import monitor


def test_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def detect(t):
        calls.add(1)
        return re.findall("[A-Z][a-z]+", t)

    docs = spark.createDataFrame([(1, "Ann met Bob"), (2, "Ann met Bob"), (3, "no one"), (4, None), (5, "")], "doc_id long, text string")
    cache = DetectionCache(spark, f"{tmp_path}/c", "caps", least=1)
    got = {r["doc_id"]: r["names"] for r in cache.names(docs, detect).collect()}
    assert got == {1: ["Ann", "Bob"], 2: ["Ann", "Bob"], 3: [], 4: None, 5: []}
    first = calls.value
    assert first == 3  # distinct texts, each in one window
    again = DetectionCache(spark, f"{tmp_path}/c", "caps", least=1)
    assert {r["doc_id"]: r["names"] for r in again.names(docs, detect).collect()} == got and calls.value == first
    more = docs.unionByName(spark.createDataFrame([(6, "Cy"), (1, "Ann left")], docs.schema))  # a new text, and a changed one under an old id
    found = sorted((r["doc_id"], r["text"], r["names"]) for r in again.names(more, detect).filter("doc_id in (1, 6)").collect())
    assert found == [(1, "Ann left", ["Ann"]), (1, "Ann met Bob", ["Ann", "Bob"]), (6, "Cy", ["Cy"])] and calls.value == first + 2
    stale = DetectionCache(spark, f"{tmp_path}/c", "caps", least=2)
    assert stale.unseen(docs).count() == 3 and stale.known().count() == 0
    stale.add(docs, detect)
    assert calls.value == first + 5 and again.known().count() == 5 and again.unseen(more).isEmpty()
    spark.read.parquet(f"{tmp_path}/c").write.mode("append").partitionBy("settings").parquet(f"{tmp_path}/twice")
    spark.read.parquet(f"{tmp_path}/c").write.mode("append").partitionBy("settings").parquet(f"{tmp_path}/twice")
    assert DetectionCache(spark, f"{tmp_path}/twice", "caps", least=1).known().count() == 5


T0 = dt.datetime(2024, 1, 1)
LINES = [
    ("a", "running", "ok", 0, 100, 0), ("a", "running", None, 30, 100, 60), ("a", "running", None, 30, 100, 60), ("b", "FAILED: memory", None, 1, 10, 61), ("a", "running", None, 80, 100, 5000), ("c", "running", None, 0, None, 70),
    ("a", "finished", None, 100, 100, 5060), ("b", "running", None, 5, 10, 90), ("b", "finished", None, 10, 10, 100),
]


def rows():
    return [(j, s, c, d, t, T0 + dt.timedelta(seconds=x)) for j, s, c, d, t, x in LINES]


def test_stream_and_table(spark, tmp_path):
    src = tmp_path / "status"
    src.mkdir()
    for i, (j, s, c, d, t, at) in enumerate(rows()):
        (src / f"{i:02}.json").write_text(json.dumps({"job": j, "status": s, "canary": c, "done": d, "total": t, "updated": at.isoformat()}))
    (src / "torn.json").write_text('{"job": "a", "sta')
    events = monitor.watch(monitor.status_files(spark, str(src), a_time=2), stall_seconds=4)
    q = events.writeStream.format("memory").queryName("watched_events").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 90
        got = []
        while time.time() < end:
            got = [tuple(r) for r in spark.table("watched_events").select("job", "event").collect()]
            if ("c", "stall") in got:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert ("c", "stall") in got  # nothing came for it
    assert got.count(("c", "stall")) == 1
    now = F.lit(T0 + dt.timedelta(seconds=9000))
    table = {(r["job"], r["event"], r["at"]) for r in monitor.watched(spark.createDataFrame(rows(), monitor.STATUS), 900, now).collect()}
    at = lambda s: T0 + dt.timedelta(seconds=s)
    want = {("a", "canary", at(0)), ("a", "done 25", at(60)), ("a", "done 50", at(5000)), ("a", "done 75", at(5000)), ("a", "done 100", at(5060)), ("a", "finished", at(5060)), ("a", "stall", at(60)), ("c", "stall", at(70)), ("b", "problem", at(61)), ("b", "done 25", at(90)), ("b", "done 50", at(90)), ("b", "done 75", at(100)), ("b", "done 100", at(100)), ("b", "finished", at(100))}
    assert table == want
    streamed = [x for x in got if x[1] != "stall"]
    assert sorted(streamed) == sorted((j, e) for j, e, _ in want if e != "stall")  # each once


def test_guard(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "fp string, v long")
    assert monitor.guarded(df.filter("fp = 'x'"), "fp", "x").count() == 1
    with pytest.raises(Exception, match="fp is not x"):
        monitor.guarded(df, "fp", "x").collect()
    src = tmp_path / "in"
    df.coalesce(1).write.json(str(src))
    stream = monitor.guarded(spark.readStream.schema("fp string, v long").json(str(src)), "fp", "x")
    q = stream.writeStream.format("memory").queryName("guarded_rows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="fp is not x"):
        q.awaitTermination()


def test_empty(spark):
    none = spark.createDataFrame([], monitor.STATUS)
    assert monitor.watched(none, 5).count() == 0


def test_a_detector_gets_one_window_at_a_time(spark):
    from pyspark.sql import functions as F

    from pairlens.functions import plugged
    from pairlens.functions.text import chunked

    df = spark.createDataFrame([("é" * 2 + "x" * n,) for n in (0, 1, 7, 8, 9, 25)] + [("",), (None,)], "t string")
    got = df.select(plugged.detected(F.col("t"), lambda w: [w], 10, 3).alias("got"), chunked(F.col("t"), 10, 3).alias("want"), "t").collect()
    assert all(r["got"] == (sorted(set(r["want"]), key=lambda n: (-len(n), n)) if r["t"] is not None else []) for r in got)
    plan = df.select(plugged.detected(F.col("t"), lambda w: [w])).drop("t")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(sequence" not in plan  # windows are not columns
