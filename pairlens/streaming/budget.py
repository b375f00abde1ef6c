"""What the scoring runs watch while they go, on a stream or a table of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_sum(events: DataFrame, value: Column, seconds: int, by: str, ts: str = "ts") -> DataFrame:
    """At each event, the sum of the last ``seconds`` (inclusive), by key."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("rolling", F.sum(value).over(w))


def stalls(events: DataFrame, minutes: int, by: str, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Events that come more than ``minutes`` after the one before."""
    w = Window.partitionBy(by).orderBy(ts, key)
    g = events.withColumn("before", F.lag(ts).over(w))
    return g.withColumn("gap_s", (F.unix_micros(ts) - F.unix_micros("before")) / 1e6).filter(F.col("gap_s") > 60 * minutes)


def milestones(progress: DataFrame, total: Column, steps: int, by: str, done: str = "done", order: str = "ts") -> DataFrame:
    """Each of ``steps`` shares of the work once, at the event that first reaches it."""
    r = progress.withColumn("step", F.floor(steps * F.col(done) / total).cast("int")).filter("step > 0")
    return r.groupBy(by, "step").agg(F.min(order).alias("at"))


def resumed(log: DataFrame, key: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A stream or table of log lines, each key once. On a stream state is dropped after the watermark."""
    if log.isStreaming:
        return log.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)
    return log.dropDuplicates(key)


def running_share(rows: DataFrame, by: str) -> DataFrame:
    """Share and ties so far; complete-mode on a stream."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(F.col("value") == 0) / F.count(F.lit(1))).alias("pct_tie"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str, by: str, ts: str = "ts") -> DataFrame:
    """Runs of events without a longer gap; works on streams with a watermark."""
    return events.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None):
    """Drives a stream over what is there and stops; the result is the table ``name``."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
