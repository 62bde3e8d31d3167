"""Job status, paging, nesting, events, audits; skew-safe windows against plain ones."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.operators import audit, lifecycle, skew

FILE = ("job_id int, file_id string, original_filename string, status string, storage_path string, output_path string, "
        "size_bytes long, pages int, converter_used string, finished_at timestamp_ntz, original_format string, "
        "error_message string, warnings array<string>, quality_score double, quality_level string, created_at timestamp_ntz, "
        "stored_filename string")
T0 = datetime(2024, 1, 1)


def files_of(spark, rows):
    return spark.createDataFrame([
        (job, fid, name, status, f"input/{fid}", out, size, pages, conv, T0 + timedelta(seconds=i),
         "html", None, None, None, None, T0, fid)
        for i, (job, fid, name, status, out, size, pages, conv) in enumerate(rows)], FILE)


@pytest.mark.parametrize("total,ok,bad,expected", [
    (3, 3, 0, "done"), (3, 0, 3, "failed"), (3, 2, 1, "partial_success"), (3, 1, 0, "processing"), (0, 0, 0, "pending")])
def test_status(one, total, ok, bad, expected):
    assert one(lifecycle.status_of, total, ok, bad) == expected


@pytest.fixture
def small(spark):
    jobs = spark.createDataFrame(
        [(1, T0, "markdown", 2), (2, None, "pdf", 2), (3, T0 + timedelta(days=1), "markdown", 0), (4, T0, "epub", 2)],
        "job_id int, created_at timestamp_ntz, target_format string, total_files int")
    files = files_of(spark, [
        (1, "b", "z.html", "failed", None, None, 3, "pandoc"), (1, "a", "y.html", "done", "output/1/a.md", 7, None, "ocr"),
        (2, "c", "x.md", "processing", None, 5, 1, None), (2, "d", "x.md", "done", "output/2/d.PDF", 5, 1, "export-pdf"),
        (4, "e", "q", "done", "output/4/e", 1, 1, "export-epub"), (4, "f", "q", "done", "output/4/f.bin", 1, 1, "export-epub")])
    return jobs, files


def test_status_progress_and_terminal_fields(small):
    rows = lifecycle.job_progress(lifecycle.job_terminal_fields(lifecycle.job_status(*small)))
    got = {r.job_id: (r.status, r.progress, r.error_message, r.completed_at) for r in rows.collect()}
    assert got == {
        1: ("partial_success", "2/2", "1 of 2 file(s) failed to convert", T0 + timedelta(seconds=1)),
        2: ("processing", "1/2", None, None), 3: ("pending", "0/0", None, None),
        4: ("done", "2/2", None, T0 + timedelta(seconds=5))}


def test_paging_orders_nulls_last_and_nests(small):
    page = lifecycle.list_jobs(*small, limit=500).collect()
    assert [r.job_id for r in page] == [3, 1, 4, 2]
    assert page[0].files is None and [f.file_id for f in page[1].files] == ["a", "b"]
    assert [r.job_id for r in lifecycle.list_jobs(*small, limit=0, offset=1).collect()] == [1]
    assert [r.job_id for r in lifecycle.list_jobs(*small, after=(T0, 1)).collect()] == [4, 2]
    assert [r.job_id for r in lifecycle.list_jobs(*small, after=(None, 2)).collect()] == []
    first = page[1]
    assert (first.status, first.processed_files, first.error_message) == ("partial_success", 2, "1 of 2 file(s) failed to convert")
    assert tuple(first.files[0].asDict()) == lifecycle.FILE_FIELDS


def test_large_jobs_continue_in_chunks(spark):
    files = files_of(spark, [(1, f"{i * 37 % 256:02x}{i:04d}", "n", "done", None, 1, 1, None) for i in range(230)])
    rows = sorted(lifecycle.nest_files(files).collect(), key=lambda r: r.chunk)
    assert [len(r.files) for r in rows] == [50, 50, 50, 50, 30]
    ids = [f.file_id for r in rows for f in r.files]
    assert ids == sorted(ids) and len(set(ids)) == 230


def test_cards_names_previews(small):
    jobs, files = small
    cards = {r.job_id: (r.title, r.extra_files, r.total_bytes, r.total_pages, r.converters)
             for r in lifecycle.job_card(jobs, files).collect()}
    assert cards[1] == ("y.html", 1, 7, 3, ["ocr", "pandoc"]) and cards[3] == ("Sans titre", 0, 0, 0, [])
    names = {r.file_id: (r.download_name, r.media_type) for r in lifecycle.download_names(files).collect()}
    assert names == {"a": ("y.md", "text/markdown; charset=utf-8"), "d": ("x.PDF", "application/pdf"),
                     "e": ("q.md", "text/markdown; charset=utf-8"), "f": ("q.bin", "application/octet-stream")}
    previews = {r.file_id: r.preview for r in lifecycle.preview_availability(files).collect()}
    assert previews == {"a": "available", "b": "conflict", "c": "conflict", "d": "unsupported", "e": "unsupported", "f": "unsupported"}


def test_deletion(small):
    jobs, files = small
    gone = jobs.filter("job_id in (1, 2)")
    assert {r.file_id for r in lifecycle.delete_cascade(files, gone).collect()} == {"e", "f"}
    odd = files.withColumn("storage_path", F.when(F.col("file_id") == "a", "../a").otherwise(F.col("storage_path")))
    assert {r.path for r in lifecycle.cleanup_paths(odd, gone).collect()} == {
        "input/b", "output/1/a.md", "input/c", "input/d", "output/2/d.PDF"}


def test_warnings_are_capped(spark):
    df = spark.createDataFrame([(["q"] * 3, ["c"] * 60), (None, []), (["q"], None)], "a array<string>, b array<string>")
    merged = [r[0] for r in df.select(lifecycle.merge_warnings(F.col("a"), F.col("b"))).collect()]
    assert merged[0] == ["q"] * 3 + ["c"] * 47 and merged[1:] == [None, ["q"]]


EVENT = ("event_id int, ts timestamp_ntz, job_id int, file_id int, kind string, error_class string, attempt int, "
         "converter string, output_path string, size_bytes long, pages int")


def events_of(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=s), 1, f, k, e, a, "ocr" if f == 2 else "pandoc", f"o{i}", i, i) for i, (s, f, k, e, a) in enumerate(rows)], EVENT)


def test_events(spark):
    events = events_of(spark, [
        (0, 1, "queued", None, 0), (10, 1, "start", None, 0), (320, 1, "fail", "TimeoutError", 2), (400, 1, "start", None, 0),
        (500, 1, "complete", None, 0), (0, 2, "start", None, 0), (3600 * 5, 2, "fail", "ConversionError", 0),
        (3600 * 30, 3, "fail", "ConnectionError", 3), (3600 * 30, 3, "complete", None, 0)])
    state = {r.file_id: (r.status, r.error_class) for r in lifecycle.file_state(events).collect()}
    assert state == {1: ("done", "TimeoutError"), 2: ("failed", "ConversionError"), 3: ("done", "ConnectionError")}
    done = {r.file_id: (r.converter, r.output_path, r.size_bytes, r.pages) for r in lifecycle.file_state(events).collect()}
    assert done == {1: ("pandoc", "o4", 4, 4), 2: (None,) * 4, 3: ("pandoc", "o8", 8, 8)}
    slow = {(r.file_id, r.event_id): r.limit for r in lifecycle.time_limit_breaches(events).collect()}
    assert slow == {(1, 2): "soft", (2, 6): "ocr"}
    retries = {r.event_id: (r.retry, r.delay_seconds) for r in lifecycle.retry_plan(events).collect()}
    assert retries == {2: (True, 4), 6: (False, None), 7: (False, None)}
    assert {r.event_id for r in lifecycle.result_expiry(events).collect()} == {7, 8}


def test_bucketed_windows_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("hhhhab"), f"{rng.getrandbits(64):016x}", T0 + timedelta(minutes=rng.randint(0, 3000)), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, id string, ts timestamp_ntz, n int")
    ranked = skew.bucketed_row_number(df, ["k"], F.substring("id", 1, 2), [F.col("id")], "rank")
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert sorted(map(tuple, ranked.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    back = skew.bucketed_lag(df, ["k"], F.date_trunc("hour", "ts"), ["ts", "n"], F.struct("n"), "prev")
    lagged = df.withColumn("prev", F.lag(F.struct("n")).over(Window.partitionBy("k").orderBy("ts", "n")))
    key = lambda r: r[3]
    assert sorted(map(tuple, back.select(*lagged.columns).collect()), key=key) == sorted(map(tuple, lagged.collect()), key=key)


def test_bucketed_windows_take_null_keys(spark):
    df = spark.createDataFrame([(None, "aa"), (None, "ab"), ("k", "aa"), (None, "ba")], "k string, id string")
    ranked = skew.bucketed_row_number(df, ["k"], F.substring("id", 1, 1), [F.col("id")], "n")
    assert sorted((str(r.k), r.id, r.n) for r in ranked.collect()) == [
        ("None", "aa", 1), ("None", "ab", 2), ("None", "ba", 3), ("k", "aa", 1)]


def test_audits(small):
    jobs, files = small
    stored = jobs.withColumns({
        "stored_status": F.lit("partial_success"), "processed_files": F.when(F.col("job_id") != 3, 2)})
    drift = {r.job_id: r.drift for r in audit.counter_drift(stored, files).collect()}
    assert drift == {2: "status,processed", 3: "status", 4: "status"}
    assert [r.job_id for r in audit.jobs_without_files(jobs, files).collect()] == [3]
    assert {r.file_id for r in audit.orphan_files(files, jobs.filter("job_id <> 4")).collect()} == {"e", "f"}
    listing = files.select(F.col("storage_path").alias("path")).filter("path <> 'input/a'").unionByName(
        jobs.limit(1).select(F.lit("output/stray.md").alias("path")))
    found = {r.path: r.finding for r in audit.unreferenced_outputs(listing, files).collect()}
    assert found["input/a"] == "missing" and found["output/stray.md"] == "unreferenced" and "input/b" not in found
    bad = files.withColumns({
        "quality_score": F.when(F.col("file_id") == "a", 1.2), "quality_level": F.lit("odd"),
        "size_bytes": F.when(F.col("file_id") == "c", -1).otherwise(F.col("size_bytes"))})
    rules = [r.rule for r in audit.domain_violations(stored, bad).collect()]
    assert sorted(rules) == ["quality_level"] * 6 + ["quality_score", "size_bytes"]


@pytest.mark.parametrize("hot, parts", [(20_000, 6), (4, 6)])
def test_files_are_dealt_by_job_before_they_are_collected(spark, monkeypatch, hot, parts):
    monkeypatch.setattr(lifecycle, "FILES_A_TASK", 10)
    monkeypatch.setattr(lifecycle.skew, "HOT", hot)
    jobs = spark.createDataFrame([(n, 5) for n in range(12)], "job_id long, total_files int")
    files = spark.range(55).selectExpr(
        "lpad(id, 4, '0') AS file_id", "CASE WHEN id < 50 THEN id DIV 5 WHEN id = 50 THEN 10 END AS job_id", "'a.md' AS original_filename",
        "'md' AS original_format", "'done' AS status", "'x' AS converter_used", "'o' AS output_path", "id AS size_bytes", "1 AS pages",
        "'e' AS error_message", "array('w') AS warnings", "1.0D AS quality_score", "'high' AS quality_level", "current_date() AS created_at",
        "current_date() AS finished_at")
    detail = lifecycle.job_detail(jobs, files, 3)
    got = [(r.job_id, r.chunk, [f.file_id for f in r.files or []]) for r in detail.orderBy("job_id", "chunk").collect()]
    want = [(job, chunk, [f"{n:04d}" for n in range(job * 5 + chunk * 3, min(job * 5 + 5, job * 5 + chunk * 3 + 3))])
            for job in range(10) for chunk in range(2)] + [(10, 0, ["0050"]), (11, 0, [])]
    assert got == want
    if hot > 5:
        plan = detail._jdf.queryExecution().executedPlan().toString()
        assert f", {parts}), REPARTITION_BY_NUM" in plan
        merged = plan[plan.index(" collect_list("):plan.index("partial_collect_list(")]
        assert "Exchange" not in merged
