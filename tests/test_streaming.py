"""Streams against their batch results."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliomill.operators import lifecycle
from foliomill.plans.catalog import CATALOG
from foliomill.sources import tables, workspace
from foliomill.streaming import jobs as streams

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def arriving(spark, folder, batches, schema):
    """One file for each batch, read one at a time in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)


def test_clean_stream_equals_batch(spark):
    batch = streams.stream_clean(tables.pages(spark, SF)).select("page_id", "markdown", "quality_score")
    stream = streams.stream_clean(streams.table_stream(spark, SF, "pages").select("page_id", "html"))
    rows, _ = streams.drain(stream, "clean")
    assert sorted(map(tuple, rows.select("page_id", "markdown", "quality_score").collect())) == sorted(map(tuple, batch.collect()))


def test_job_status_stream_equals_batch_over_several_batches(spark, tmp_path):
    events = tables.file_events(spark, SF)
    folder = str(tmp_path / "events")
    events.repartition(5, "event_id").write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(folder)
    jobs = tables.event_jobs(spark, SF)
    got = {r.job_id: (r.succeeded, r.failed) for r in streams.stream_job_status(stream, jobs).collect()}
    state = lifecycle.file_state(events).groupBy("job_id").agg(
        F.count_if(F.col("status") == "done").alias("ok"), F.count_if(F.col("status") == "failed").alias("bad"))
    assert got == {r.job_id: (r.ok, r.bad) for r in state.collect()}


def test_dedupe_and_late_events(spark, tmp_path):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    stream = arriving(spark, str(tmp_path / "in"), [
        [(1, at(0)), (1, at(0)), (2, at(1))], [(3, at(600)), (2, at(1))], [(4, at(601))], [(9, at(2)), (5, at(602))],
    ], "event_id int, ts timestamp")
    rows, _ = streams.drain(streams.stream_dedupe(stream, "10 minutes"), "dedupe")
    ids = sorted(r.event_id for r in rows.collect())
    assert ids == [1, 2, 3, 4, 5]  # 9 came ten hours behind the watermark
    # Repeated deliveries of 1 and 2 are not late.
    assert [r.event_id for r in streams.late_events(spark.read.parquet(str(tmp_path / "in")), rows).collect()] == [9]


def test_a_job_waits_for_its_unseen_files(spark, tmp_path):
    stream = arriving(spark, str(tmp_path / "in"), [[(1, T0, 1, 11, "complete"), (2, T0, 2, 21, "fail")], [(3, T0, 2, 22, "complete")]],
                      "event_id int, ts timestamp, job_id int, file_id int, kind string")
    jobs = spark.createDataFrame([(1, 10), (2, 2), (3, 1)], "job_id int, total_files int")
    got = {r.job_id: (r.total_files, r.succeeded, r.failed, r.status) for r in streams.stream_job_status(stream, jobs).collect()}
    assert got == {1: (10, 1, 0, "processing"), 2: (2, 1, 1, "partial_success")}


def test_partial_results_are_compacted(spark, tmp_path):
    batches = [[("a", T0 + timedelta(seconds=i))] for i in range(5)]
    stream = arriving(spark, str(tmp_path / "in"), batches, "client string, ts timestamp")
    merged = streams.drain_batches(stream, "compact", streams.rate_windows, streams.merged_windows, compact_every=2)
    assert merged.count() == 2 and [r.requests for r in streams.over_limit(merged, 0).collect()] == [5]


def test_a_source_without_rows(spark, tmp_path):
    schema = "event_id int, ts timestamp, job_id int, file_id int, kind string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs = spark.createDataFrame([(1, 1)], "job_id int, total_files int")
    assert streams.stream_job_status(stream, jobs).count() == 0


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """The smallest tables as folders of eight part files."""
    folder = str(tmp_path_factory.mktemp("parted"))
    for name in ("events", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(8).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", [
    "stream_clean", "stream_dedupe", "stream_job_status", "stream_rate_limit", "stream_late_events", "stream_stuck_files"])
def test_folders_of_part_files_give_the_same_rows(spark, parted, name):
    def rows(folder):
        return sorted(map(tuple, CATALOG[name](spark, folder).collect()), key=repr)
    found = rows(parted)
    assert found == rows(SF) and found


def test_one_file_a_batch_reads_every_part(spark, parted):
    stream = streams.table_stream(spark, parted, "events", "event_id", files_per_batch=1)
    rows, query = streams.drain(stream, "parts")
    assert rows.count() == 1000 and len(query.recentProgress) >= 8


def test_rate_alerts(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [[("a", at(1)), ("a", at(2)), ("b", at(3))], [("a", at(4)), ("b", at(61))], [("c", at(4000))]]
    stream = arriving(spark, str(tmp_path / "in"), batches, "client string, ts timestamp")
    merged = streams.stream_rate_limit(stream, 2).collect()
    assert [(r.client, r.requests) for r in merged] == [("a", 3)]
    stream = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    alerts, _ = streams.drain(streams.rate_limit_alerts(stream, 2), "alerts")
    assert [(r.client, r.requests) for r in alerts.collect()] == [("a", 3)]


def test_stuck_files(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "event_id int, ts timestamp, job_id int, file_id int, kind string"
    stream = arriving(spark, str(tmp_path / "in"), [
        [(1, at(0), 1, 1, "start"), (2, at(0), 1, 2, "start"), (3, at(10), 1, 3, "start")],
        [(4, at(359), 1, 1, "complete"), (5, at(361), 1, 2, "fail")], [(6, at(9000), 1, 4, "start")], [(7, at(9001), 1, 4, "complete")],
    ], schema)
    rows, _ = streams.drain(streams.stream_stuck_files(stream), "stuck")
    assert sorted(r.event_id for r in rows.collect()) == [2, 3]


def test_work_folder_follows_the_session(spark):
    assert workspace.fresh(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_rows_behind_the_watermark_are_counted_over_all_batches(spark, tmp_path):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    batches = [[(n, at(600 * n))] + [(100 + n, at(0))] * (n > 1) for n in range(8)]
    stream = arriving(spark, str(tmp_path / "in"), batches, "event_id int, ts timestamp")
    # A batch drops by the watermark that the batch before it began with: the first late row is kept.
    assert streams.count_late(streams.stream_dedupe(stream, "10 minutes"), "late-count") == 5


def test_stuck_files_with_ends_before_starts_and_many_events(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "event_id int, ts timestamp, job_id int, file_id int, kind string"
    many = [(10 + i, at(i), 1, 9, "start") for i in range(300)] + [(1000 + i, at(i + 1), 1, 9, "complete") for i in range(0, 200, 2)]
    stream = arriving(spark, str(tmp_path / "in"), [
        [(1, at(100), 1, 1, "complete"), *many], [(2, at(50), 1, 1, "start"), (3, at(101), 1, 1, "start")],
        [(4, at(9000), 1, 5, "start"), (5, at(9000), 1, 5, "fail")], [(6, at(20_000), 1, 6, "start"), (7, at(20_000), 1, 6, "fail")],
    ], schema)
    rows, _ = streams.drain(streams.stream_stuck_files(stream), "stuck")
    # The last end of file 9 is at 199; starts after it are stuck.
    assert sorted(r.event_id for r in rows.collect()) == [3, *range(10 + 200, 310)]


def test_files_of_a_bucket_share_a_call_but_not_their_events(spark, tmp_path, monkeypatch):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "event_id int, ts timestamp, job_id int, file_id int, kind string"
    rng = random.Random(11)
    events = [(n, at(rng.randrange(4000)), rng.choice([1, 2, None]), rng.choice([*range(40), None]), rng.choice(["start", "start", "complete", "fail", "queued"]))
              for n in range(3000)]
    last = [(5001, at(9000), 7, 7, "start"), (5002, at(9000), 7, 7, "fail"), (None, at(100), 3, 3, "start")]
    stream = arriving(spark, str(tmp_path / "in"), [events + last], schema)
    called = spark.sparkContext.accumulator(0)
    undecided = streams._undecided

    def counted(*args):
        called.add(1)
        return undecided(*args)

    monkeypatch.setattr(streams, "_undecided", counted)
    rows, _ = streams.drain(streams.stream_stuck_files(stream, buckets=3), "stuck")
    assert 0 < called.value <= 2 * 3  # once with its events, once by its timer
    wanted = [(e, t, j, f) for e, t, j, f, kind in events + last if kind == "start" and t + timedelta(seconds=360) < at(8400) and not any(
        (j2, f2) == (j, f) and kind2 in ("complete", "fail") and t <= t2 <= t + timedelta(seconds=360) for _, t2, j2, f2, kind2 in events + last)]
    assert sorted(((r.event_id, r.started_at, r.job_id, r.file_id) for r in rows.collect()), key=repr) == sorted(wanted, key=repr) and wanted
