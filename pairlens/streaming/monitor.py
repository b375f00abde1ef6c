"""Status lines of running jobs, on a stream of files or as a table: what happened once, and what has stopped happening."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATUS = "job string, status string, canary string, done long, total long, updated timestamp"
EVENT = "job string, event string, at timestamp, detail string"
STEPS = (25, 50, 75, 100)


def status_files(spark: SparkSession, folder: str, a_time: int | None = None) -> DataFrame:
    """A stream of the JSON status files that appear in a folder; a torn file gives no rows."""
    reader = spark.readStream.schema(f"{STATUS}, _torn string").option("columnNameOfCorruptRecord", "_torn")
    if a_time:
        reader = reader.option("maxFilesPerTrigger", a_time)
    return reader.json(folder).filter(F.col("_torn").isNull() & F.col("job").isNotNull()).drop("_torn")


def guarded(rows: DataFrame, column: str, fingerprint: str) -> DataFrame:
    """Rows of one configuration; a row that another one wrote stops the stream or the job."""
    other = F.raise_error(F.concat(F.lit(f"{column} is not {fingerprint}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return rows.filter(F.when(F.col(column).eqNullSafe(F.lit(fingerprint)), F.lit(True)).otherwise(other.cast("boolean")))


def failed(status: Column) -> Column:
    return status.startswith("FAILED") | status.startswith("ERROR")


def watch(statuses: DataFrame, stall_seconds: float) -> DataFrame:
    """Events of a stream, each once a job: ``canary``, ``problem``, ``done 25`` to ``done 100``, ``finished``; and ``stall``, once for each silence.

    The state of a job is a few values. A timer of processing time is set anew by every status of a running job, so the
    stall of a job that sends nothing more comes without any input. A late or repeated file, older than what was seen, changes nothing.
    """
    state = "said string, updated timestamp, running boolean, stalled boolean"

    def step(key: tuple, batches: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        said, updated, running, stalled = held.get if held.exists else ("", None, False, False)
        known, out = set(filter(None, said.split("|"))), []
        if held.hasTimedOut:
            if running and not stalled:
                out.append((key[0], "stall", updated, f"no progress since {updated}"))
            held.update((said, updated, running, True))
        else:
            rows = pd.concat(list(batches)).sort_values("updated", kind="stable")
            for r in rows.itertuples():
                if updated is not None and r.updated < pd.Timestamp(updated):
                    continue
                moved = updated is None or r.updated > pd.Timestamp(updated)
                updated, running = r.updated.to_pydatetime(), r.status == "running"
                stalled = stalled and not moved
                for event, detail in _events(r):
                    if event not in known:
                        known.add(event)
                        out.append((key[0], event, r.updated, detail))
            held.update(("|".join(sorted(known)), updated, running, stalled))
            if running and not stalled:
                held.setTimeoutDuration(int(stall_seconds * 1000))
        yield pd.DataFrame(out, columns=["job", "event", "at", "detail"])

    return statuses.groupBy("job").applyInPandasWithState(step, EVENT, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _events(r) -> list[tuple[str, str]]:
    out = [("canary", r.canary)] if isinstance(r.canary, str) else []
    if isinstance(r.status, str) and r.status.startswith(("FAILED", "ERROR")):
        out.append(("problem", r.status))
    if pd.notna(r.total) and pd.notna(r.done) and r.total > 0:
        out += [(f"done {q}", f"{int(r.done)}/{int(r.total)}") for q in STEPS if r.done >= r.total * q / 100]
    return out + ([("finished", r.status)] if r.status == "finished" else [])


def watched(statuses: DataFrame, stall_seconds: float, now: Column | None = None) -> DataFrame:
    """The same events of a table of statuses. A stall is a running job's status that the next one follows too late, or none until ``now``."""
    share = F.col("done") >= F.col("total") * F.col("q") / 100
    at = statuses.select("job", "status", "canary", "done", "total", "updated")
    done = F.concat(F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"))
    kinds = [
        at.filter("canary is not null").select("job", F.lit("canary").alias("event"), "updated", F.col("canary").alias("detail")),
        at.filter(failed(F.col("status"))).select("job", F.lit("problem").alias("event"), "updated", F.col("status").alias("detail")),
        at.filter("total > 0").withColumn("q", F.explode(F.array(*map(F.lit, STEPS)))).filter(share).select("job", F.concat(F.lit("done "), F.col("q").cast("string")).alias("event"), "updated", done.alias("detail")),
        at.filter("status = 'finished'").select("job", F.lit("finished").alias("event"), "updated", F.col("status").alias("detail")),
    ]
    every = kinds[0]
    for k in kinds[1:]:
        every = every.unionByName(k)
    first = every.groupBy("job", "event").agg(F.min(F.struct("updated", "detail")).alias("f")).select("job", "event", F.col("f.updated").alias("at"), F.col("f.detail").alias("detail"))
    last = at.groupBy("job", "updated").agg(F.max_by("status", "done").alias("status"))
    after = F.coalesce(F.lead("updated").over(Window.partitionBy("job").orderBy("updated")), now if now is not None else F.lit(None).cast("timestamp"))
    silent = last.withColumn("after", after).filter((F.col("status") == "running") & ((F.unix_micros("after") - F.unix_micros("updated")) / 1e6 > stall_seconds))
    stalls = silent.select("job", F.lit("stall").alias("event"), F.col("updated").alias("at"), F.concat(F.lit("no progress since "), F.col("updated").cast("string")).alias("detail"))
    return first.unionByName(stalls)
