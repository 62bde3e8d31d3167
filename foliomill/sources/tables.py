"""Document, job, file and event tables derived from the given parquet tables.

The engine's own tables (jobs, files, uploads, ...) are not among the given ones, so these
projections stand in for them. Row identities come from the row itself, not from a numbering
window, so no key's rows ever have to meet in one task.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TASKS_A_CORE = 4


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", "text", "lang", "source")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt anew by their values, for long work on each row.

    A Parquet file is read by one task for each row group, and a row group can hold a hundred thousand documents.
    """
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, *rows.columns)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages").select("page_id", "html")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One job for each order."""
    counts = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return read(spark, folder, "orders").join(counts, "o_orderkey", "left").selectExpr(
        "o_orderkey AS job_id",
        "o_orderdate AS created_at",
        "CASE o_orderkey % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'epub' "
        "ELSE 'markdown' END AS target_format",
        "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'processing' END "
        "AS stored_status",
        "CAST(coalesce(n, 0) AS INT) AS total_files",
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One file for each order line; the id is a digest of the line."""
    identity = (
        "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        "CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT), "
        "CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), "
        "l_returnflag, l_linestatus, date_format(l_shipdate, 'yyyy-MM-dd')))"
    )
    lines = read(spark, folder, "lineitem").withColumn("file_id", F.expr(identity))
    ready = "(l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F'))"
    return lines.selectExpr(
        "file_id",
        "l_orderkey AS job_id",
        "CASE l_partkey % 5 WHEN 0 THEN 'part.html' WHEN 1 THEN 'part-2.html' WHEN 2 THEN 'part-2-2.html' "
        "WHEN 3 THEN 'part-3.html' ELSE 'part-0.html' END AS original_filename",
        "concat(file_id, '.html') AS stored_filename",
        "'html' AS original_format",
        "CASE WHEN l_returnflag = 'R' THEN 'failed' "
        "WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'processing' ELSE 'done' END AS status",
        "concat(CASE WHEN l_suppkey % 17 = 0 THEN '../' ELSE '' END, 'input/', file_id, '.html') "
        "AS storage_path",
        f"CASE WHEN {ready} THEN concat('output/', l_orderkey, '/', file_id, "
        "CASE l_orderkey % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.epub' ELSE '.md' END) "
        "END AS output_path",
        "CASE l_suppkey % 4 WHEN 0 THEN 'pandoc' WHEN 1 THEN 'pymupdf' WHEN 2 THEN 'markitdown' END "
        "AS converter_used",
        "CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes",
        "CAST(l_quantity AS INT) AS pages",
        "CASE WHEN l_linenumber % 3 = 0 THEN array('missing image', 'unknown glyph') "
        "WHEN l_linenumber % 3 = 1 THEN array('missing image') END AS warnings",
        "CAST(l_discount * 10 AS DOUBLE) AS quality_score",
        "CASE WHEN l_discount >= 0.075 THEN 'high' WHEN l_discount >= 0.045 THEN 'medium' "
        "ELSE 'low' END AS quality_level",
        "CASE WHEN l_returnflag = 'R' THEN concat('ConversionError: line ', l_linenumber) END AS error_message",
        "l_shipdate - INTERVAL '1' DAY AS created_at",
        "l_shipdate AS finished_at",
    )


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate files, four to a job: good, mislabelled and foreign ones, some binary."""
    web = pages(spark, folder).selectExpr(
        "page_id AS file_id",
        "CAST(floor(page_id / 4) AS BIGINT) AS job_id",
        "concat('page ', page_id, CASE WHEN page_id % 11 = 0 THEN '.pdf' "
        "WHEN page_id % 7 = 0 THEN '.HTML' ELSE '.html' END) AS original_filename",
        "html AS content",
    )
    zip_head = "concat('PK', char(3), char(4))"
    plain = documents(spark, folder).selectExpr(
        "1000000 + doc_id AS file_id",
        "1000000 + CAST(floor(doc_id / 4) AS BIGINT) AS job_id",
        "concat('doc ', doc_id, CASE WHEN doc_id % 13 = 0 THEN '.md' WHEN doc_id % 17 = 0 THEN '.exe' "
        "WHEN doc_id % 19 = 0 THEN '.pdf' WHEN doc_id % 23 = 0 THEN '.docx' "
        "WHEN doc_id % 29 = 0 THEN '.epub' ELSE '.txt' END) AS original_filename",
        "CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN text "
        "WHEN doc_id % 19 = 0 THEN concat('%PDF-1.7', char(10), text) "
        f"WHEN doc_id % 23 = 0 THEN concat({zip_head}, CASE WHEN doc_id % 2 = 0 "
        "THEN concat(repeat('.', 26), '[Content_Types].xml....word/document.xml') ELSE '' END, text) "
        f"WHEN doc_id % 29 = 0 THEN concat({zip_head}, repeat('.', 26), "
        "'mimetypeapplication/epub+zip', text) "
        "WHEN doc_id % 31 = 0 THEN '' "
        "WHEN doc_id % 37 = 0 THEN concat('\ufeff <!-- page --><p>', text) ELSE text END AS content",
    )
    return web.unionAll(plain)


def quality_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with headings, blanks and replacement characters."""
    return documents(spark, folder).selectExpr(
        "doc_id AS file_id",
        "concat(CASE WHEN doc_id % 3 = 0 AND doc_id % 10 <> 9 "
        "THEN concat('# Title ', doc_id, char(10), char(10)) ELSE '' END, "
        "CASE WHEN doc_id % 10 = 9 THEN '' ELSE text END, "
        "repeat('�', CAST(CASE WHEN doc_id % 4 = 0 THEN doc_id % 9 ELSE 0 END AS INT))) AS markdown",
        "CASE WHEN doc_id % 5 = 0 THEN CAST(25000 AS BIGINT) ELSE CAST(length(text) AS BIGINT) END "
        "AS input_bytes",
        "CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 50 AS INT) END AS pages",
    )


def pdf_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of PDF documents: every 64 events are two documents of 1 to 63 pages each."""
    cut = "(1 + floor(event_id / 64) * 7 % 62)"
    second = f"(event_id % 64 >= {cut})"
    return read(spark, folder, "events").selectExpr(
        f"CAST(floor(event_id / 64) * 2 + CASE WHEN {second} THEN 1 ELSE 0 END AS BIGINT) AS pdf_id",
        f"CAST(event_id % 64 - CASE WHEN {second} THEN {cut} ELSE 0 END AS INT) AS page_no",
        "CASE WHEN event_type IN ('error', 'click', 'view') THEN 0 "
        "ELSE CAST(floor(value * 10) AS INT) END AS chars",
        "CASE WHEN event_id % 640 < 64 THEN 0.0D ELSE 612.0D END AS width",
        "792.0D AS height",
    )


FILE_EVENT_COLUMNS = (
    "event_id",
    "ts",
    "user_id AS job_id",
    "user_id * 1000 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS file_id",
    "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'complete' "
    "WHEN 'error' THEN 'fail' ELSE 'start' END AS kind",
    "CASE event_id % 4 WHEN 0 THEN 'OperationalError' WHEN 1 THEN 'ConnectionError' "
    "WHEN 2 THEN 'ConversionError' ELSE 'FormatNotSupportedError' END AS error_class",
    "CAST(event_id % 5 AS INT) AS attempt",
    "CASE event_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'pandoc' ELSE 'markitdown' END AS converter",
    "concat('output/', user_id, '/', event_id, '.md') AS output_path",
    "event_id * 37 % 100000 AS size_bytes",
    "CAST(event_id % 41 AS INT) AS pages",
)


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """Append-only status events of files."""
    return read(spark, folder, "events").selectExpr(*FILE_EVENT_COLUMNS)


def event_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of the event stream with their stored totals; every third has files yet to report."""
    return read(spark, folder, "events").selectExpr(*FILE_EVENT_COLUMNS[2:4]).groupBy("job_id").agg(
        (F.count_distinct("file_id") + F.when(F.col("job_id") % 3 == 0, 2).otherwise(0)).cast("int").alias("total_files")
    )


ARRIVALS = 6


def late_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """File events with the slot they arrive in: sixths of the time, every fiftieth two later."""
    events = file_events(spark, folder)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = (events.agg(end(micros)).scalar() for end in (F.min, F.max))
    slot = F.floor((micros - low) * ARRIVALS / F.greatest(F.lit(1), high - low + 1)).cast("int")
    late = F.when(F.col("event_id") % 50 == 0, 2).otherwise(0)
    return events.withColumn("arrival", F.least(F.lit(ARRIVALS - 1), slot + late))


def dirty_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents wrapped in residue for every cleaning stage."""
    pieces = [
        """'<span id="c', doc_id, '.xhtml"></span><svg a="1"><image/></svg>', char(10)""",
        """'<div class="k"><p>', text, '</p></div>', char(10)""",
        """CASE WHEN doc_id % 2 = 0 THEN concat('<table class="t"><colgroup><col /></colgroup>"""
        """<tbody><tr><td><p>✅ ', lang, '</p><p>', source, '</p></td></tr></tbody></table>') """
        """ELSE '<table><tbody><tr><td><p>plain</p></td></tr><tr><td>b</td></tr></tbody></table>' END, """
        """char(10)""",
        """CASE WHEN doc_id % 3 = 0 THEN '<div class="class_sM3"><span>one</span> <span>two</span></div>' """
        """ELSE '### <span class="x">orphan' END, char(10)""",
        """'<a href="#c1.xhtml">toc</a> <a href="https://example.org/', doc_id, """
        """'">ext</a> <a name="q">other</a> [md](#c2.xhtml_a)', char(10)""",
        """'<img src="d/', doc_id % 5, '_media/f', doc_id % 3, '.png" alt="A"/><img class="none"/>', """
        """char(10)""",
        """'<strong>b</strong><em>i</em><code>c</code><br/><hr/><sup>1</sup>   ', char(10), char(10), """
        """char(10), char(10), CASE WHEN doc_id % 11 = 0 THEN '<se<sup>ction>' ELSE '' END, 'end'""",
    ]
    return spread(documents(spark, folder)).selectExpr(
        "doc_id AS file_id",
        "CAST(floor(doc_id / 4) AS BIGINT) AS job_id",
        f"concat({', '.join(pieces)}) AS text",
    )


def archive_hex(entry: str, *, end_record: bool = True) -> str:
    """Hex text of a minimal ZIP archive with one empty entry."""
    name = entry.encode()
    fixed = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, 0, 0, 0, len(name), 0)
    local = b"PK\x03\x04" + fixed + name
    central = b"PK\x01\x02" + struct.pack("<H", 20) + fixed + struct.pack("<HHHII", 0, 0, 0, 0, 0) + name
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)
    return (local + central + (end if end_record else b"")).hex().upper()


def container_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Binary files that do not sniff as archives: a document's bytes in front of a real archive,
    one with a foreign entry, a bare name without an archive, or an archive without its end."""
    def plus(archive: str) -> str:
        return f"concat(X'00', encode(text, 'UTF-8'), X'{archive}')"

    epub, docx = archive_hex("META-INF/container.xml"), archive_hex("[Content_Types].xml")
    return documents(spark, folder).selectExpr(
        "doc_id AS file_id",
        "concat('box ', doc_id, CASE doc_id % 6 WHEN 2 THEN '.docx' WHEN 3 THEN '.docx' "
        "WHEN 4 THEN '.txt' ELSE '.epub' END) AS original_filename",
        f"CASE doc_id % 6 WHEN 0 THEN {plus(epub)} WHEN 1 THEN {plus(archive_hex('notes.txt'))} "
        f"WHEN 2 THEN {plus(docx)} WHEN 4 THEN {plus(epub)} "
        "WHEN 3 THEN concat(X'00', encode('[Content_Types].xml', 'UTF-8'), encode(text, 'UTF-8')) "
        f"ELSE {plus(archive_hex('META-INF/container.xml', end_record=False))} END AS content",
    )


# Heads of files in formats that are told by their first bytes, in hex digits; the type expected
# for each is stated in the SQL checks.
HEADS = (
    "7B5C727466315C616E7369", "1F8B080000000000", "89504E470D0A1A0A0000000D", "FFD8FFE000104A464946",
    "D0CF11E0A1B11AE10000", "FFFE000041000000", "0000FEFF00000041", "474946383961010001008000",
    "377ABCAF271C0004", "4D5A90000300000004000000", "25215053", "49492A0008000000", "0001020304",
    "504B0304" + "2E" * 26 + "5B436F6E74656E745F54797065735D2E786D6C2E2E2E2E786C2F776F726B626F6F6B",
)


def signed_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents behind the head of another format."""
    heads = ", ".join(f"X'{head}'" for head in HEADS)
    return documents(spark, folder).selectExpr(
        "doc_id AS file_id", "concat('file ', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.pdf' END) AS original_filename",
        f"concat(element_at(array({heads}), CAST(doc_id % {len(HEADS)} AS INT) + 1), encode(text, 'UTF-8')) AS content")


def block_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents, each on one line, in nested lists, quotations, a table and verbatim text."""
    line = r"replace(concat('x ', regexp_replace(coalesce(text, ''), '\\s+', ' ')), '&', '&amp;')"
    pieces = (
        "'<ol><li>', doc_id, '<ul class=\"k\"><li>', lang, '</li></ul></li><LI>', line, '</li></ol>'",
        "'<blockquote>', source, '<blockquote><p>', line, '</p></blockquote></blockquote>'",
        "'<table><thead><tr><th>id</th><th>text</th></tr></thead><tr><td>', doc_id, '</td><td><b>b</b> ', line, '</td></tr></table>'",
        "'<pre><code>', doc_id, char(10), char(10), char(10), line, '</code></pre>'",
    )
    return spread(documents(spark, folder)).selectExpr("doc_id", "lang", "source", f"{line} AS line").selectExpr(
        "doc_id", f"concat({', '.join(pieces)}) AS html")
