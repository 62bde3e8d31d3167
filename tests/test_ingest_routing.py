"""Format detection on real bytes, path checks, routing, page votes."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from foliomill.sources.lookups import DOCX_MIME
from foliomill.sources.manifest import sniff_mime
from foliomill.operators import ingest, routing
from foliomill.plans import catalog
from foliomill.sources import manifest, sinks, workspace


def archive(*entries, first=None, comment=b""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        if first:
            z.writestr("mimetype", first)
        for entry in entries:
            z.writestr(entry, "x" * 100)
        z.comment = comment
    return data.getvalue()


EPUB = archive("META-INF/container.xml", first="application/epub+zip")
CASES = [
    ("book.epub", EPUB, "application/epub+zip", None),
    ("bare.epub", archive("a.txt"), "application/zip", None),
    ("late.EPUB", b"\x00junk" + archive("META-INF/container.xml", comment=b"note"), "application/epub+zip", None),
    ("fake.epub", b"\x00META-INF/container.xml" + archive("a.txt"), "application/octet-stream", "MimeTypeMismatchError"),
    ("near.epub", b"\x00" + archive("META-INF/container.xml.bak"), "application/octet-stream", "MimeTypeMismatchError"),
    ("cut.docx", b"\x00" + archive("[Content_Types].xml")[:-30], "application/octet-stream", "MimeTypeMismatchError"),
    ("word.docx", b"\x00" + archive("a", "[Content_Types].xml"), ingest.lookups.DOCX_MIME, None),
    ("word.txt", b"\x00" + archive("[Content_Types].xml"), "application/octet-stream", "MimeTypeMismatchError"),
    ("p.pdf", b"%PDF-1.4 \xff\x00", "application/pdf", None),
    ("p2.pdf", b"not a pdf at all", "text/plain", "MimeTypeMismatchError"),
    ("h.HTML", b"\n <!DOCTYPE HTML><p>x", "text/html", None),
    ("x.html", b'<?xml version="1.0"?><!DOCTYPE html PUBLIC "XHTML 1.0">', "application/xhtml+xml", None),
    ("cut.txt", b"a" * 4095 + "é".encode(), "text/plain", None),
    ("latin.txt", b"caf\xe9 noir", "text/plain", None),
    ("bad.txt", b"caf\xe9 \x01 noir", "application/octet-stream", "MimeTypeMismatchError"),
    ("n.exe", b"MZ", "text/plain", "UnsupportedExtensionError"),
    ("noext", b"x", "text/plain", "UnsupportedExtensionError"),
]


def test_detect_format_on_files(spark, tmp_path):
    for name, content, _, _ in CASES:
        (tmp_path / name).write_bytes(content)
    files = manifest.corpus_content(spark, str(tmp_path))
    got = {r.original_filename: (r.mime_type, r.error_class) for r in ingest.detect_format(files).collect()}
    assert got == {name: (mime, error) for name, _, mime, error in CASES}
    listed = {r.file_name: (r.extension, r.size_bytes) for r in manifest.corpus_manifest(spark, str(tmp_path)).collect()}
    assert listed["late.EPUB"][0] == ".epub" and listed["book.epub"][1] == len(EPUB)


def test_empty_content(spark):
    df = spark.createDataFrame([("e.txt", bytearray())], "original_filename string, content binary")
    row = ingest.detect_format(df).first()
    assert (row.mime_type, row.error_class) == ("application/x-empty", "MimeTypeMismatchError")


def test_size_limit_is_strict_and_last(spark):
    df = spark.createDataFrame([("a.txt", bytearray(b"x" * n)) for n in (1024**2, 1024**2 + 1)],
                               "original_filename string, content binary")
    rows = ingest.detect_format(df, max_file_mb=1).orderBy("size_bytes").collect()
    assert [r.error_class for r in rows] == [None, "FileTooLargeError"]
    assert rows[1].error_message == "file is 1048577 bytes; limit is 1048576 (1 MB)"


def test_directions(spark):
    df = spark.createDataFrame([("a.md", "x", "import"), ("a.md", "x", "export"), ("a.txt", "x", "export")],
                               "original_filename string, content string, way string")
    rows = ingest.detect_format(df, direction=F.col("way")).orderBy("original_filename", "way").collect()
    assert [r.error_class for r in rows] == [None, "UnsupportedExtensionError", "UnsupportedExtensionError"]


@pytest.mark.parametrize("path,verdict", [
    ("/etc/passwd", "absolute"), ("a/../b", "contained"), ("a/../../b", "escapes"), ("..", "escapes"), ("", "contained"),
    ("a/..", "contained"), ("./a//b", "contained"), ("..hidden/x", "contained"), ("a/../../a/../b", "escapes")])
def test_path_verdict(one, path, verdict):
    assert one(ingest.path_verdict, path) == verdict


def test_batch_limits_and_atomic_accept(spark):
    jobs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "job_id int")
    files = spark.createDataFrame([(1, 5), (2, 5), (2, None), (2, 1), (3, 99)], "job_id int, size_bytes long")
    got = {r.job_id: r.limit_error for r in ingest.batch_limits(jobs, files, max_files=2, max_bytes=50).collect()}
    assert got == {1: None, 2: "too many files", 3: "job too large", 4: "no files"}
    checked = spark.createDataFrame([(1, None), (1, "X"), (2, None)], "job_id int, error_class string")
    assert [r.job_id for r in ingest.atomic_job_accept(checked).collect()] == [2]


def test_routing(spark):
    df = spark.createDataFrame([
        (".epub", None, None), (".pdf", "scanned", None), (".pdf", "unknown", None), (".pdf", None, None),
        (".txt", None, None), (".txt", None, "pandoc"), (".html", None, "nope"), (".pdf", "scanned", "pymupdf"),
        (".md", None, None)], "extension string, flavour string, override string")
    got = [(r.extension, r.flavour, r.override, r.target, r.converter_name, r.route_error is None)
           for r in routing.route_files(df).collect()]
    assert sorted(got, key=str) == sorted([
        (".epub", None, None, "epub", "pandoc", True), (".pdf", "scanned", None, "pdf_scanned", "ocr", True),
        (".pdf", "unknown", None, "pdf_native", "pymupdf", True), (".pdf", None, None, "pdf_native", "pymupdf", True),
        (".txt", None, None, "txt", "markitdown", True), (".txt", None, "pandoc", "txt", "pandoc", False),
        (".html", None, "nope", "html", "nope", False),
        (".pdf", "scanned", "pymupdf", "pdf_scanned", "pymupdf", True), (".md", None, None, None, None, False)], key=str)


def test_page_votes(spark):
    def doc(pdf, *chars, width=612.0):
        return [(pdf, i, c, width, 792.0) for i, c in enumerate(chars)]

    rows = (doc(1, *[600] * 5) + doc(2, *[0] * 5) + doc(3, *[0] * 3, *[600] * 7) + doc(4, *[0] * 9, 600)
            + doc(5, 600, width=0.0) + doc(6, 600))
    pages = spark.createDataFrame(rows, "pdf_id int, page_no int, chars int, width double, height double")
    got = {r.pdf_id: (r.flavour, r.sampled_pages, r.text_page_ratio) for r in routing.pdf_flavour(pages).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        1: "text_native", 2: "scanned", 3: "text_native", 4: "scanned", 5: "unknown", 6: "text_native"}
    assert got[1][1:] == (5, 1.0) and got[2][2] == 0.0 and got[5][1:] == (1, None)


@pytest.mark.parametrize("pages", [1, 2, 7, 8, 9, 15, 36, 100])
def test_sampled_pages_round_half_even(spark, pages):
    counts = spark.createDataFrame([(1, pages)], "pdf_id int, page_count long")
    got = sorted(r.page_no for r in routing.pdf_sample_plan(counts).collect())
    k = min(8, pages)
    assert got == sorted({round(i * (pages - 1) / (k - 1)) if k > 1 else 0 for i in range(k)})


def test_written_documents_keep_every_row(spark):
    docs = spark.createDataFrame([(i, i % 3, f"Doc {i}?.html", f"text {i}") for i in range(50)],
                                 "file_id long, job_id long, original_filename string, markdown string")
    target = workspace.fresh(spark, "docs")
    sinks.write_markdown(docs, target, buckets=4)
    back = spark.read.parquet(target)
    assert back.count() == 50 and back.select("output_path").distinct().count() == 50
    assert all(p.output_path.startswith("output/") and p.output_path.endswith(".md") for p in back.collect())


@pytest.mark.parametrize("content,mime", [
    (b"\xff\xfeh\x00i\x00", "text/plain"), (b"caf\xe9 au lait", "text/plain"), (b"\xef\xbb\xbf<html>", "text/html"),
    (b"  <!-- x --><p>", "text/html"), (b"<body>", "text/html"), (b"a\x00b", "application/octet-stream"),
    (b"PK\x03\x04" + b"." * 26 + b"[Content_Types].xml..word/document.xml", DOCX_MIME),
    (b"PK\x03\x04" + b"." * 26 + b"[Content_Types].xml..xl/workbook.xml", "application/zip"),
])
def test_signatures(spark, content, mime):
    df = spark.createDataFrame([(content,)], "c binary")
    assert df.select(sniff_mime(df["c"])).first()[0] == mime


def test_every_stored_file_is_listed_with_its_rows(spark, tmp_path):
    spark.range(0, 70, 1, 3).withColumn("x", F.lit("a")).write.parquet(str(tmp_path / "parts.parquet"))
    spark.range(5).selectExpr("id + 0.5 AS other").coalesce(1).write.parquet(str(tmp_path / "a b+c%" / "PARTS.parquet"))
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "none.parquet"))
    wanted = sorted(
        (name, ".parquet", os.path.getsize(os.path.join(at, name)))
        for at, _, names in os.walk(tmp_path) for name in names if name.endswith(".parquet"))
    rows = catalog.CATALOG["corpus_files"](spark, str(tmp_path)).collect()
    assert sorted((r.file_name, r.extension, r.size_bytes) for r in rows) == wanted and len({r.path for r in rows}) == len(rows)
    assert sum("/parts.parquet/" in r.path for r in rows) == 3
    assert sorted(r.rows for r in rows) == [0, 5, 23, 23, 24]


def test_every_table_of_a_folder_is_listed(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.file_name: r for r in catalog.CATALOG["corpus_files"](spark, folder).collect()}
    assert {n: r.size_bytes for n, r in rows.items()} == {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder)}
    for name in rows:
        assert rows[name].rows == spark.read.parquet(f"{folder}/{name}").count()
