"""Arriving files and status events as streams.

Sinks are parquet folders in the shared work folder. Batch-wise sinks write one sub-folder for
each micro-batch and overwrite it when the batch is repeated, so a restart changes nothing.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliomill.operators import clean, convert, quality
from foliomill.operators.lifecycle import HARD_LIMIT_SECONDS, event_status, job_status
from foliomill.sources import workspace


def table_stream(
    spark: SparkSession, folder: str, table: str, *columns: str, files_per_batch: int = 64
) -> DataFrame:
    """The parquet files of a table as a stream, a bounded number for each micro-batch.

    A table is one file or a folder of part files. A stream source only takes a single file from a
    path pattern; the pattern here names the table alone and serves both.
    """
    path = f"{folder}/{table}.parquet"
    stored = spark.read.parquet(path)
    return (
        spark.readStream.schema(stored.select(*columns).schema if columns else stored.schema)
        .option("maxFilesPerTrigger", str(files_per_batch)).parquet(path[:-1] + "[t]")
    )


def drain(stream: DataFrame, purpose: str) -> tuple[DataFrame, StreamingQuery]:
    """Run everything available into a parquet sink, exactly once, and read the sink back."""
    spark = stream.sparkSession
    folder = workspace.fresh(spark, purpose)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), query


def drain_batches(
    stream: DataFrame, purpose: str, reduce: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame], compact_every: int = 32,
) -> DataFrame:
    """Reduce every micro-batch and keep the partial results, one sub-folder each.

    For results that merge (sums, maxima): the stream itself holds no state. ``merge`` takes partial
    results of the same columns together. Every ``compact_every`` batches it is applied to all
    results so far, so a reader merges one base and the few batches after it. A repeated batch
    overwrites what it wrote before. A source without rows gives an empty result.
    """
    spark = stream.sparkSession
    folder = workspace.fresh(spark, purpose)
    schema = reduce(stream).schema
    # What this run has written: the newest base, and the batches after it.
    bases: list[str] = []
    batches: dict[int, str] = {}

    def stored() -> DataFrame:
        parts = bases[-1:] + [batches[number] for number in sorted(batches)]
        return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)

    def store(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/rows/batch={batch_id}"
        reduce(batch).write.mode("overwrite").parquet(path)
        batches[batch_id] = path
        if len(batches) >= compact_every:
            base = f"{folder}/base/upto={batch_id}"
            merge(stored()).write.mode("overwrite").parquet(base)
            bases.append(base)
            batches.clear()

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stored()


def with_event_time(events: DataFrame) -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_clean(pages: DataFrame, where: Column | str | None = None) -> DataFrame:
    """HTML rows to cleaned, scored Markdown; stateless. ``where`` is applied at the scan."""
    converted = convert.html_to_markdown(pages, where=where)
    cleaned = clean.clean_corpus(converted, "markdown")
    return quality.assess(cleaned.withColumns({
        "input_bytes": F.octet_length("html").cast("long"), "pages": F.lit(None).cast("int"),
    })).drop("html")


def stream_dedupe(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Repeated deliveries of an event collapse to one."""
    return (
        with_event_time(events).withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
    )


def latest_events(events: DataFrame) -> DataFrame:
    """Latest event of each file within one batch; a maximum, so batches merge in any order."""
    return events.groupBy("job_id", "file_id").agg(F.max(F.struct("ts", "event_id", "kind")).alias("latest"))


def merged_latest(changes: DataFrame) -> DataFrame:
    return changes.groupBy("job_id", "file_id").agg(F.max("latest").alias("latest"))


def job_status_of(changes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job status from the stored per-batch latest events.

    ``jobs`` has each job's own ``total_files``: a job is not done before files that have not
    reported yet are. Jobs without an event so far are not listed.
    """
    files = merged_latest(changes).select(
        "job_id", "file_id", event_status(F.col("latest.kind")).alias("status"),
        F.col("latest.ts").alias("finished_at"),
    )
    seen = jobs.select("job_id", "total_files").join(files, "job_id", "left_semi")
    return job_status(seen, files).select("job_id", "total_files", "succeeded", "failed", "status")


def stream_job_status(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Running job status: batch-wise latest events in, merged status out."""
    return job_status_of(drain_batches(events, "job-status", latest_events, merged_latest), jobs)


def rate_windows(events: DataFrame) -> DataFrame:
    """Requests for each client and minute within one batch."""
    minute = F.date_trunc("minute", "ts").cast(events.schema["ts"].dataType)
    return events.groupBy("client", minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("requests")
    )


def merged_windows(windows: DataFrame) -> DataFrame:
    return windows.groupBy("client", "minute").agg(F.sum("requests").alias("requests"))


def over_limit(windows: DataFrame, limit: int) -> DataFrame:
    return merged_windows(windows).filter(F.col("requests") > limit)


def stream_rate_limit(events: DataFrame, limit: int) -> DataFrame:
    """Clients over ``limit`` requests in a minute, the last open minute included."""
    return over_limit(drain_batches(events, "rate-limit", rate_windows, merged_windows), limit)


def rate_limit_alerts(events: DataFrame, limit: int, delay: str = "5 minutes") -> DataFrame:
    """The running form: a minute is reported once the watermark has passed it."""
    counted = with_event_time(events).withWatermark("ts", delay).groupBy(
        F.window("ts", "1 minute"), "client"
    ).agg(F.count(F.lit(1)).alias("requests"))
    return counted.filter(F.col("requests") > limit).select(
        "client", F.col("window.start").alias("minute"), "requests"
    )


class DroppedRows(StreamingQueryListener):
    """Rows that one query's stateful operators dropped behind the watermark, summed over all its batches.

    A query keeps the progress of its last batches only; a listener is told of every one.
    """

    def __init__(self) -> None:
        self.ended: set[str] = set()
        self.waiting: list[tuple[str, int, int]] = []
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        dropped = sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)
        with self.changed:
            self.waiting.append((str(event.progress.runId), event.progress.batchId, dropped))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def of(self, query: StreamingQuery, seconds: float = 60) -> dict[int, int]:
        """Dropped rows by batch, once the query has ended: its last event comes behind all others. A batch
        that was told of twice counts once."""
        run = str(query.runId)
        with self.changed:
            if not self.changed.wait_for(lambda: run in self.ended, seconds):
                raise TimeoutError("the end of the stream was not reported")
            return {batch: dropped for of_run, batch, dropped in self.waiting if of_run == run}


def count_late(stream: DataFrame, purpose: str) -> int:
    """Rows of a stream that come behind its watermark, as its own operators count them."""
    spark = stream.sparkSession
    listener = DroppedRows()
    spark.streams.addListener(listener)
    try:
        _, query = drain(stream, purpose)
        return sum(listener.of(query).values())
    finally:
        spark.streams.removeListener(listener)


def late_events(events: DataFrame, kept: DataFrame) -> DataFrame:
    """Events of the source that a deduplicating stream dropped for coming behind its watermark.

    ``kept`` is what the stream let through. A repeated delivery of a kept event is not late.
    """
    return events.dropDuplicates(["event_id"]).join(kept.select("event_id"), "event_id", "left_anti")


def arriving(events: DataFrame, slots: int, order: Column, purpose: str, files: int = 2) -> DataFrame:
    """A stream in which rows arrive slot by slot, one slot of ``order`` a micro-batch.

    The rows of a slot are dealt over ``files`` files, which no slot may be too small for.
    """
    spark = events.sparkSession
    folder = workspace.fresh(spark, purpose)
    for slot in range(slots):
        events.filter(order == slot).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", str(files)).parquet(folder)


STUCK = "event_id long, job_id long, file_id long, started_at timestamp"
PENDING = "job array<long>, file array<long>, missing array<long>, event array<long>, time array<long>, is_end array<long>"
PENDING_COLUMNS = ("job", "file", "missing", "event", "time", "is_end")
BUCKETS = 2048  # groups of files that share a state


def _undecided(rows: np.ndarray, limit: int, watermark: int) -> tuple[np.ndarray, np.ndarray]:
    """(stuck, kept) rows, given as columns of PENDING_COLUMNS, of a bucket's starts and ends in microseconds.

    Sorted by file and time, the next end behind a start is the only one that can be in time.
    """
    rows = rows[:, np.lexsort(rows[[5, 4, 2, 1, 0]])]
    job, file, missing, _, time, is_end = rows
    owner = np.stack([job, file, missing & 3])  # an event without an id is of its file all the same
    count = rows.shape[1]
    following = np.minimum.accumulate(np.where(is_end == 1, np.arange(count), count)[::-1])[::-1]
    behind = np.minimum(following, count - 1)
    ended = (following < count) & (owner[:, behind] == owner).all(axis=0) & (time[behind] <= time + limit)
    open_ = (is_end == 0) & ~ended
    stuck = open_ & (time + limit < watermark)
    repeated = np.zeros(count, bool)
    repeated[1:] = (is_end[1:] == 1) & (is_end[:-1] == 1) & (time[1:] == time[:-1]) & (owner[:, 1:] == owner[:, :-1]).all(axis=0)
    return rows[:, stuck], rows[:, (open_ & ~stuck) | ((is_end == 1) & ~repeated & (time >= watermark))]


def stream_stuck_files(
    events: DataFrame, limit_seconds: int = HARD_LIMIT_SECONDS, delay: str = "10 minutes", buckets: int = BUCKETS
) -> DataFrame:
    """Starts without an end of the same file within the limit, once the watermark is past it.

    Files are dealt over ``buckets``, as a call and a state for each file cost far more than its few events do. A
    bucket's state holds the open starts of its files, and the ends that a start behind them may still belong to:
    those that the watermark has not passed. Its timer is set to the deadline of the earliest open start. The
    watermark is that of the slower of starts and ends.
    """
    limit = limit_seconds * 1_000_000
    kind = events.schema["event_id"].dataType, events.schema["job_id"].dataType, events.schema["file_id"].dataType
    # Nulls would make doubles of the numbers in pandas; they are told apart by the bits of ``missing``.
    ids = {"job": "job_id", "file": "file_id", "event": "event_id"}
    missing = sum((F.when(F.col(ids[name]).isNull(), bit).otherwise(0) for name, bit in (("job", 1), ("file", 2), ("event", 4))), F.lit(0))
    timed = with_event_time(events).select(
        "ts", "kind", F.pmod(F.xxhash64("job_id", "file_id"), F.lit(buckets)).alias("bucket"), missing.cast("long").alias("missing"),
        *[F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")).alias(short) for short, name in ids.items()])
    starts = timed.filter(F.col("kind") == "start").drop("kind").withColumn("is_end", F.lit(0).cast("long")).withWatermark("ts", delay)
    ends = timed.filter(F.col("kind").isin("complete", "fail")).drop("kind").withColumn(
        "is_end", F.lit(1).cast("long")).withWatermark("ts", delay)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [np.array(list(state.get), np.int64)] if state.exists else []
        if not state.hasTimedOut:
            for batch in batches:
                columns = batch.assign(time=batch["ts"].to_numpy("datetime64[us]").astype("int64"))
                parts.append(np.stack([columns[name].to_numpy(np.int64) for name in PENDING_COLUMNS]))
        watermark = state.getCurrentWatermarkMs()
        stuck, kept = _undecided(np.concatenate(parts, axis=1), limit, watermark * 1000)
        if kept.shape[1]:
            state.update(tuple(kept.tolist()))
            times, is_end = kept[4], kept[5] == 1
            due = int(times.max()) // 1000 if is_end.all() else (int(times[~is_end].min()) + limit) // 1000
            state.setTimeoutTimestamp(max(due, watermark))
        elif state.exists:
            state.remove()
        if stuck.shape[1]:
            job, file, absent, event, time, _ = stuck
            yield pd.DataFrame({
                "event_id": pd.arrays.IntegerArray(event, (absent & 4) > 0),
                "job_id": pd.arrays.IntegerArray(job, (absent & 1) > 0),
                "file_id": pd.arrays.IntegerArray(file, (absent & 2) > 0), "started_at": pd.to_datetime(time, unit="us")})

    found = starts.unionByName(ends).groupBy("bucket").applyInPandasWithState(
        watch, STUCK, PENDING, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*[F.col(name).cast(of).alias(name) for name, of in zip(("event_id", "job_id", "file_id"), kind)],
                        "started_at")
