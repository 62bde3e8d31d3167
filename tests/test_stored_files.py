"""Files and tables on disk: written, listed, sniffed, deleted from."""

import os

import pytest
from pyspark.sql import functions as F

from foliomill.operators import audit, ingest, skew
from foliomill.plans.catalog import CATALOG
from foliomill.sources import manifest, sinks, workspace


def parts(folder):
    """Data files below a folder with their times, by partition."""
    found = {}
    for path, _, names in os.walk(folder):
        for name in names:
            if name.endswith(".parquet"):
                at = os.path.join(path, name)
                found.setdefault(os.path.relpath(path, folder), set()).add((name, os.stat(at).st_mtime_ns))
    return found


@pytest.fixture
def table(spark, tmp_path):
    rows = [(job, f"{job}-{i}") for job in range(40) for i in range(3)]
    folder = str(tmp_path / "table")
    sinks.write_by_job(spark.createDataFrame(rows, "job_id long, file_id string"), folder, buckets=8)
    return folder, rows


def left(spark, folder):
    return sorted((r.job_id, r.file_id) for r in spark.read.parquet(folder).collect())


def test_deletion_touches_only_its_buckets_and_can_be_repeated(spark, tmp_path, table):
    folder, rows = table
    gone = spark.createDataFrame([(3,), (3,), (5,), (999,)], "job_id long")
    before = parts(folder)
    touched = sinks.delete_jobs(spark, folder, gone, str(tmp_path / "staging"), buckets=8)
    after = parts(folder)
    wanted = sorted(r for r in rows if r[0] not in (3, 5))
    assert left(spark, folder) == wanted and 1 <= len(touched) <= 2
    for name in before:
        assert (after[name] == before[name]) == (int(name.split("=")[1]) not in touched)
    assert sinks.delete_jobs(spark, folder, gone, str(tmp_path / "staging"), buckets=8) == touched
    assert left(spark, folder) == wanted


def test_deletion_that_stopped_goes_on(spark, tmp_path, table, monkeypatch):
    folder, rows = table
    gone = spark.createDataFrame([(job,) for job in range(40) if job % 2], "job_id long")
    staging = str(tmp_path / "staging")

    class Stopped(Exception):
        pass

    real = type(gone).hint

    def stop(df, name, *args):
        if name == "rebalance":
            raise Stopped
        return real(df, name, *args)

    with monkeypatch.context() as m:
        m.setattr(type(gone), "hint", stop)
        with pytest.raises(Stopped):
            sinks.delete_jobs(spark, folder, gone, staging, buckets=8)
    assert left(spark, folder) == sorted(rows)
    sinks.delete_jobs(spark, folder, gone, staging, buckets=8)
    assert left(spark, folder) == sorted(r for r in rows if r[0] % 2 == 0)


def test_emptied_buckets_and_nothing_to_delete(spark, tmp_path, table):
    folder, rows = table
    sinks.delete_jobs(spark, folder, spark.createDataFrame([], "job_id long"), str(tmp_path / "none"), buckets=8)
    assert left(spark, folder) == sorted(rows)
    sinks.delete_jobs(spark, folder, spark.createDataFrame([(j,) for j in range(40)], "job_id long"), str(tmp_path / "all"), buckets=8)
    assert left(spark, folder) == []


def test_files_are_listed_and_read_back(spark, tmp_path):
    rows = [("input/1/a b.txt", "text\nmore"), ("input/2/é%41.html", ""), ("out/x+y=z.md", "<p>"), ("big", "x" * 5000)]
    folder = str(tmp_path / "files")
    sinks.write_files(spark.createDataFrame(rows, "path string, body string"), folder, "path", "body")
    files = {r.path: (r.original_filename, r.size_bytes, bytes(r.content).decode()) for r in manifest.stored_files(spark, folder).collect()}
    assert files == {p: (p.rsplit("/", 1)[-1], len(b), b) for p, b in rows}
    small = manifest.stored_files(spark, folder, max_bytes=100)
    assert {r.path for r in small.select("path").collect()} == {p for p, b in rows if len(b) <= 100}
    assert "LessThanOrEqual(length,101)" in small._jdf.queryExecution().toString()


def test_listing_by_relative_path(spark, tmp_path):
    for name in ("input/a b.txt", "output/7/é.md", "output/50%.md", "plus+sign.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    listed = manifest.corpus_manifest(spark, str(tmp_path)).select(manifest.relative_path(F.col("path"), str(tmp_path)).alias("path"))
    assert sorted(r.path for r in listed.collect()) == ["input/a b.txt", "output/50%.md", "output/7/é.md", "plus+sign.md"]
    odd = spark.createDataFrame([("file:/data//in/a%20b",), ("file:///data/in/c",), ("s3a://bucket/data/in//d",), ("/other/e",)], "p string")
    assert [r[0] for r in odd.select(manifest.relative_path(F.col("p"), "hdfs://host/data/in/")).collect()] == ["a b", "c", "d", "/other/e"]
    rows = spark.createDataFrame([("input/a b.txt", "output/7/é.md"), ("input/gone", None)], "storage_path string, output_path string")
    assert {(r.path, r.finding) for r in audit.unreferenced_outputs(listed, rows).collect()} == {
        ("input/gone", "missing"), ("output/50%.md", "unreferenced"), ("plus+sign.md", "unreferenced")}


def test_split_sink_reads_contents_once_and_takes_repeats(spark, tmp_path):
    rows = [(1, 1, "a.txt", "x"), (2, 1, "b.exe", "x"), (3, 2, "c.pdf", "x")]
    files = spark.createDataFrame(rows, "file_id long, job_id long, original_filename string, content string")
    files.write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    checked = ingest.detect_format(read)
    assert checked._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    folder = str(tmp_path / "out")
    for batch, part in ((0, "file_id = 1"), (1, "file_id > 1"), (1, "file_id > 1")):
        sinks.write_validated(checked.filter(part), folder, batch)
    assert [r.file_id for r in sinks.read_validated(spark, folder, True).collect()] == [1]
    rejected = sinks.read_validated(spark, folder, False)
    assert sorted((r.file_id, r.error.split(":")[0]) for r in rejected.collect()) == [
        (2, "UnsupportedExtensionError"), (3, "MimeTypeMismatchError")]
    assert "accepted" in rejected._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]


@pytest.mark.parametrize("data, mime", [
    (b"{\\rtf1\\ansi text}", "text/rtf"), (b"\x1f\x8b\x08\x00", "application/gzip"), (b"\x89PNG\r\n\x1a\n\x00", "image/png"),
    (b"\xff\xd8\xff\xe0\x00\x10JFIF", "image/jpeg"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1\x00", "application/x-ole-storage"),
    ("text".encode("utf-32"), "text/plain"), (b"\x00\x00\xfe\xff\x00\x00\x00a", "text/plain"), ("text".encode("utf-16"), "text/plain"),
    (b"\x00" * 257 + b"ustar\x00", "application/x-tar"), (b"RIFF\x00\x00\x00\x00WEBPVP8 ", "image/webp"), (b"MZ\x90\x00", "application/x-dosexec"),
    (b"MZ is a word", "text/plain"), (b"ID3 is a tag", "text/plain"), (b"%!PS-Adobe", "application/postscript"),
    (b"PK\x03\x04" + b"." * 26 + b"mimetypeapplication/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.text"),
    (b"PK\x03\x04" + b"." * 26 + b"[Content_Types].xml ppt/slides", manifest.OFFICE_PARTS[2][1]), (b"\x00\x01\x02", "application/octet-stream")])
def test_signatures(spark, data, mime):
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert df.select(manifest.sniff_mime(F.col("content"))).first()[0] == mime


def test_large_keys_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 50)
    rows = [("big", f"{i * 7919 % 500:03d}") for i in range(500)] + [("small", f"{i}") for i in range(9)] + [(None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "k string, id string")
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.k, r.id): r.place for r in skew.sized_row_number(df, ["k"], "id", "place", sizes, "n").collect()}
    want = {}
    for key in ("big", "small", None):
        want |= {(key, i): n for n, i in enumerate(sorted(i for k, i in rows if k == key), 1)}
    assert got == want


def test_folders_of_a_scope_go(spark):
    kept = workspace.fresh(spark, "kept")
    with workspace.scope(spark):
        inner = workspace.written(spark.range(3), "inner")
        inside = os.path.dirname(inner.inputFiles()[0]).removeprefix("file:").replace("///", "/")
        outer = workspace.written(inner, "outer", kept)
        assert os.path.isdir(inside)
    assert not os.path.isdir(inside) and outer.count() == 3


def test_files_of_a_task_share_a_folder(spark, tmp_path):
    long = "input/" + "é" * 300 + ".txt"
    rows = [(f"input/{i}/doc.txt", "x" * i) for i in range(200)] + [("same", "one"), ("same", "other"), (long, "long"), (None, None)]
    folder = str(tmp_path / "files")
    sinks.write_files(spark.createDataFrame(rows, "path string, body string").coalesce(2), folder, "path", "body")
    files = sorted((r.path or "", bytes(r.content).decode()) for r in manifest.stored_files(spark, folder).collect())
    assert files == sorted((p or "", b or "") for p, b in rows)
    assert sum(name.startswith("part-") for name in os.listdir(folder) if os.path.isdir(os.path.join(folder, name))) <= 2
    none = str(tmp_path / "none")
    sinks.write_files(spark.createDataFrame([], "path string, body string"), none, "path", "body")
    assert manifest.stored_files(spark, none).count() == 0


def test_stored_rows_of_digests_take_little_more_than_half_their_digits(spark, tmp_path):
    folder = str(tmp_path / "digests")
    digests = spark.range(20000).select(F.col("id").alias("job_id"), F.md5(F.col("id").cast("string").cast("binary")).alias("file_id"))

    def stored():
        return sum(os.path.getsize(os.path.join(path, name)) for path, _, names in os.walk(folder) for name in names if name.endswith(".parquet"))

    sinks.write_by_job(digests, folder, buckets=2)
    assert stored() < 20000 * 32
    sinks.delete_jobs(spark, folder, digests.filter("job_id < 10").select("job_id"), str(tmp_path / "staging"), buckets=2)
    assert stored() < 20000 * 32 and spark.read.parquet(folder).count() == 19990


def test_paths_are_listed_by_tasks(spark, tmp_path):
    long = "input/" + "é" * 300 + ".txt"
    rows = [(f"input/{i}", "") for i in range(sinks.FILES_A_FOLDER + 50)] + [("same", "one"), ("same", "other"), (long, "long"), (None, None)]
    folder = str(tmp_path / "files")
    sinks.write_files(spark.createDataFrame(rows, "path string, body string").coalesce(1), folder, "path", "body")
    for name in (".part-left", "part-9"):
        (tmp_path / "files" / name).mkdir()
    (tmp_path / "files" / ".part-left" / "0-61").write_text("x")
    listed = manifest.stored_paths(spark, folder)
    want = sorted((p or "", len(b or "")) for p, b in rows)
    assert sorted((r.path or "", r.size_bytes) for r in listed.collect()) == want
    assert sorted((r.path or "", r.size_bytes) for r in manifest.stored_files(spark, folder).select("path", "size_bytes").collect()) == want
    assert max(len(names) for _, _, names in os.walk(folder)) <= sinks.FILES_A_FOLDER
    none = str(tmp_path / "none")
    sinks.write_files(spark.createDataFrame([], "path string, body string"), none, "path", "body")
    assert manifest.stored_paths(spark, none).count() == 0


def test_the_audit_of_stored_files_lists_none_in_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(30)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, f"text {i}", "en", "web") for i in range(30)], "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = CATALOG["unreferenced_files"](spark, str(tmp_path))
    assert found.count() == 13 and "binaryFile" not in found._jdf.queryExecution().toString()
