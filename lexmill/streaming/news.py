"""The incremental pieces as streams; each has a batch twin in ``lexmill.operators.incremental`` that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Views by day and kind; a day is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("views")).select(F.col("w.start").alias("day"), "event_type", "views")


def first_seen(events: DataFrame, key: str) -> DataFrame:
    """The first row of each key; the state is one entry a key."""
    return events.dropDuplicates([key])


def run_digest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each trigger's rows are one digest window, written under its number: a window that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/window={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state, most: int, stale: pd.Timedelta) -> Iterator[pd.DataFrame]:
    last_ts, last, attempts, failures = state.get if state.exists else (pd.Timestamp(0), "", 0, 0)
    for pdf in batches:
        if not len(pdf):  # a timeout brings no rows
            continue
        attempts += int((pdf["event"] == "start").sum())
        failures += int((pdf["event"] == "fail").sum())
        newest = pdf.sort_values(["ts", "event"]).iloc[-1]
        if (newest["ts"], newest["event"]) > (last_ts, last):
            last_ts, last = newest["ts"], newest["event"]
    if state.hasTimedOut:  # the watermark has passed the start by the time a run may take
        done = "rescued"
    else:
        done = "done" if last == "done" else "failed" if last == "fail" and failures >= most else "running" if last == "start" else "queued"
    state.update((last_ts, last, attempts, failures))
    if done == "running":
        due = int((pd.Timestamp(last_ts) + stale).timestamp() * 1000) + 1
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"job_id": [key[0]], "state": [done], "attempts": [attempts], "failures": [failures]})


def job_states(log: DataFrame, most: int = 3, stale_minutes: int = 30) -> DataFrame:
    """The state of each job after every batch of its log (job_id, event, ts); a run without an end is rescued once the log's newest time is ``stale_minutes`` past its start."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    work = partial(_advance, most=most, stale=pd.Timedelta(minutes=stale_minutes))
    marked = log.withWatermark("ts", "0 seconds")
    return marked.groupBy("job_id").applyInPandasWithState(work, "job_id long, state string, attempts long, failures long", "ts timestamp, last string, attempts long, failures long", "update", GroupStateTimeout.EventTimeTimeout)
