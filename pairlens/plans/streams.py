"""Streaming-like behaviour on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prefix
from ..streaming import budget, monitor
from .fixtures import table
from .registry import query
from .shares import rounded


def events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 4) AS rolling FROM events")
def x3_rolling_budget(spark, sf):
    return budget.rolling_sum(events(spark, sf), F.col("value"), 3600, "user_id").select("event_id", "user_id", F.round("rolling", 4).alias("rolling"))


@query("WITH g AS (SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap_s FROM events) SELECT event_id, user_id, round(gap_s, 6) AS gap_s FROM g WHERE gap_s > 12 * 3600")
def x6_stalls(spark, sf):
    return rounded(budget.stalls(events(spark, sf), 720, "user_id").select("event_id", "user_id", "gap_s"), "gap_s")


@query("""WITH p AS (SELECT event_type, ts, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY event_type) AS total FROM events), s AS (SELECT event_type, floor(4 * done / total)::INTEGER AS step, ts FROM p)
SELECT event_type, step, epoch_us(min(ts)) AS at FROM s WHERE step > 0 GROUP BY ALL""")
def x5_x7_milestones(spark, sf):
    e = events(spark, sf).select("event_type", "ts", "event_id")
    total = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
    p = prefix.ranks(e, ["event_type"], "ts", ["event_id"], descending=False).withColumnRenamed("rank", "done").join(total, "event_type")
    return budget.milestones(p, F.col("total"), 4, "event_type").select("event_type", "step", F.unix_micros("at").alias("at"))


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def x1_resumed_log(spark, sf):
    return budget.resumed(events(spark, sf).select("user_id", "event_type"), ["user_id", "event_type"])


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) FILTER (value = 0) / count(*), 6) AS pct_tie, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def x4_running_share(spark, sf):
    return rounded(budget.running_share(events(spark, sf), "event_type"), "pct_tie", "mean")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def x6_sessions(spark, sf):
    return budget.sessions(events(spark, sf), "6 hours", "user_id").select("user_id", F.unix_micros("start").alias("start"), "n")


@query("""WITH r AS (SELECT user_id, event_id, value, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) SELECT user_id, event_id, round(total, 4) AS total, floor(total / 500)::BIGINT AS batch FROM r""")
def w10_x8_running_total(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "ts", "value")
    r = prefix.running(e, ["user_id"], ["ts", "event_id"], {"before": "value"}).withColumn("total", F.col("before") + F.coalesce("value", F.lit(0.0)))
    return r.select("user_id", "event_id", F.round("total", 4).alias("total"), F.floor(F.col("total") / 500).alias("batch"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events),
s AS (SELECT user_id::VARCHAR AS job, ts, done, total, after, CASE WHEN done = total THEN 'finished' WHEN event_type = 'error' THEN 'FAILED' ELSE 'running' END AS status FROM n),
e AS (SELECT job, 'done ' || q AS event, ts FROM s, (SELECT unnest([25, 50, 75, 100]) AS q) WHERE done >= total * q / 100 UNION ALL SELECT job, 'problem', ts FROM s WHERE status = 'FAILED' UNION ALL SELECT job, 'finished', ts FROM s WHERE status = 'finished')
SELECT job, event, epoch_us(min(ts)) AS at FROM e GROUP BY ALL UNION ALL SELECT job, 'stall', epoch_us(ts) FROM s WHERE status = 'running' AND after > ts + INTERVAL 12 HOUR""")
def x2_x6_s28_status_events(spark, sf):
    """Users' events as the statuses of jobs: what a monitor says of them, each once, and the silences of running ones."""
    e = events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    n = prefix.ranks(e, ["user_id"], "ts", ["event_id"], descending=False).join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("total")), "user_id")
    status = F.when(F.col("rank") == F.col("total"), "finished").when(F.col("event_type") == "error", "FAILED").otherwise("running")
    s = n.select(F.col("user_id").cast("string").alias("job"), status.alias("status"), F.lit(None).cast("string").alias("canary"), F.col("rank").alias("done"), "total", F.col("ts").alias("updated"))
    return monitor.watched(s, 12 * 3600).select("job", "event", F.unix_micros("at").alias("at"))
