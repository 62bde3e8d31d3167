"""File listings and sniffing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions.text import WHITESPACE, basename, suffix
from foliomill.sources import sinks
from foliomill.sources.lookups import DOCX_MIME

SNIFF_BYTES = 4096
TASKS_A_CORE = 16


def corpus_manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Every file below ``folder``; the content is not read, only listed."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    )
    return listed.select(
        "path",
        basename(F.col("path")).alias("file_name"),
        F.lower(suffix(F.col("path"))).alias("extension"),
        F.col("length").alias("size_bytes"),
        "modificationTime",
    )


def relative_path(path: Column, folder: str) -> Column:
    """A listed path below ``folder`` as rows name it: without scheme, escapes, doubled slashes and the folder."""
    def plain(text: Column) -> Column:
        bare = F.regexp_replace(text, "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
        return F.regexp_replace(bare, "/{2,}", "/")

    # A plus sign is no escape in a path, a per cent sign that begins none stays one.
    readable = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    root = F.concat(F.rtrim(plain(F.lit(folder)), F.lit("/")), F.lit("/"))
    below = plain(F.url_decode(readable))
    return F.when(F.startswith(below, root), F.substring(below, F.length(root) + 1, F.length(below))).otherwise(below)


def _stored_path() -> Column:
    """The path that ``sinks.write_files`` was given, from that of the file it stored."""
    digits = F.replace(F.regexp_extract("path", "/part-[0-9]+/(?:[0-9]+/)?[0-9]+-([0-9A-F/a-f]*)$", 1), F.lit("/"))
    return F.when(digits != "", F.decode(F.unhex(digits), "UTF-8"))


def stored_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes) of files that ``sinks.write_files`` stored, listed by tasks.

    Spark's own file sources list every file in the driver. Here the driver lists the folders of the writing tasks
    alone; what is in them goes from folder to folder in a task. Names that begin with a point or an underscore and
    files of zero bytes are left out, as Spark does.
    """
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(folder)
    entries = top.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(top)
    names = sorted(name for name in (entry.getPath().getName() for entry in entries) if name[0] not in "._")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = sinks.opened(folder)
        for batch in batches:
            for entry in files.get_file_info([f"{root}/{names[i]}" for i in batch["id"]]):
                found, waiting = [], [entry]
                while waiting:
                    at = waiting.pop()
                    if at.type == fs.FileType.Directory:
                        waiting += [below for below in files.get_file_info(fs.FileSelector(at.path)) if below.base_name[0] not in "._"]
                    elif at.size:
                        found.append((at.path, at.size))
                    if found and (not waiting or len(found) == sinks.FILES_A_FOLDER):
                        yield pd.DataFrame(found, columns=["path", "length"])
                        found = []

    tasks = min(len(names), TASKS_A_CORE * context.defaultParallelism)
    files = spark.range(0, len(names), 1, max(1, tasks)).mapInPandas(listed, "path string, length long")
    return files.select(_stored_path().alias("path"), (F.col("length") - 1).alias("size_bytes"))


def stored_files(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """(path, original_filename, size_bytes, content) of files that ``sinks.write_files`` stored.

    A size limit goes to the listing: larger files are not opened. Without ``content`` in the plan none is.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes + 1)
    # A scan counts some megabytes for each file that it opens, so small ones would give a task for every few.
    files = files.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    size = F.col("length") - 1
    stored = _stored_path()
    return files.select(
        stored.alias("path"), basename(stored).alias("original_filename"),
        size.alias("size_bytes"), F.substring("content", F.lit(1), size.cast("int")).alias("content"))


def table_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every Parquet file below ``folder``, each once, with the number of its rows; 0 if it has none.

    No column is read, so tables of any schema are counted in one scan.
    """
    def files(source: str) -> DataFrame:
        reader = spark.read.format(source).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        return (reader.schema(T.StructType([])) if source == "parquet" else reader).load(folder)

    at = F.col("_metadata.file_path")
    listed = files("binaryFile").select(at.alias("at"), "path", F.col("length").alias("size_bytes"))
    held = files("parquet").groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("rows"))
    return listed.join(held, "at", "left").select(
        "path", basename(F.col("path")).alias("file_name"), F.lower(suffix(F.col("path"))).alias("extension"),
        "size_bytes", F.coalesce("rows", F.lit(0)).alias("rows"))


def corpus_content(spark: SparkSession, folder: str, glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """The listing with file contents; a size limit prunes files before they are opened.

    Spark's file sources leave files of zero bytes out; empty submissions are only seen when they
    arrive as rows of a table.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    )
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    return files.select(
        "path", basename(F.col("path")).alias("original_filename"),
        F.col("length").alias("size_bytes"), "content",
    )


# What HTML starts with, after blanks and a byte order mark.
HTML_STARTS = (
    "<!doctype html", "<html", "<head", "<title", "<body", "<script", "<style", "<table", "<h1", "<a href=", "<!--",
)
# First entries of an Office archive, and the folder of its parts by format.
OFFICE_ENTRIES = ("[Content_Types].xml", "_rels/.rels", "docProps/", "word/", "xl/", "ppt/")
_OOXML = "application/vnd.openxmlformats-officedocument."
OFFICE_PARTS = (("word/", DOCX_MIME), ("xl/", f"{_OOXML}spreadsheetml.sheet"), ("ppt/", f"{_OOXML}presentationml.presentation"))
# Fixed values: (offset, bytes in hex digits, MIME type) of formats that are no text.
SIGNATURES = (
    (0, "25504446", "application/pdf"),
    (0, "504B0304", "application/zip"),
    (0, "504B0506", "application/zip"),
    (30, "6D696D65747970656170706C69636174696F6E2F657075622B7A6970", "application/epub+zip"),
    (30, "6D696D65747970656170706C69636174696F6E2F766E642E6F617369732E6F70656E646F63756D656E742E74657874",
     "application/vnd.oasis.opendocument.text"),
    (0, "1F8B08", "application/gzip"),
    (0, "425A68", "application/x-bzip2"),
    (0, "FD377A585A00", "application/x-xz"),
    (0, "28B52FFD", "application/zstd"),
    (0, "377ABCAF271C", "application/x-7z-compressed"),
    (0, "526172211A07", "application/x-rar"),
    (257, "7573746172", "application/x-tar"),
    (0, "89504E470D0A1A0A", "image/png"),
    (0, "FFD8FF", "image/jpeg"),
    (0, "474946383761", "image/gif"),
    (0, "474946383961", "image/gif"),
    (0, "49492A00", "image/tiff"),
    (0, "4D4D002A", "image/tiff"),
    (8, "57454250", "image/webp"),
    (8, "57415645", "audio/x-wav"),
    (4, "66747970", "video/mp4"),
    (0, "494433", "audio/mpeg"),
    (0, "4F676753", "audio/ogg"),
    (0, "664C6143", "audio/flac"),
    (0, "D0CF11E0A1B11AE1", "application/x-ole-storage"),
    (0, "7B5C727466", "text/rtf"),
    (0, "25215053", "application/postscript"),
    (0, "7F454C46", "application/x-executable"),
    (0, "4D5A", "application/x-dosexec"),
    (0, "CAFEBABE", "application/x-java-applet"),
    (0, "53514C69746520666F726D6174203300", "application/vnd.sqlite3"),
    (0, "50415231", "application/vnd.apache.parquet"),
)
# Those whose bytes are letters and marks: they count in a text too, the others only where it is none.
PRINTED = ("application/pdf", "text/rtf", "application/postscript")
# Control characters that text does not hold; blanks, escape and next-line are not among them.
CONTROL = "[\x00-\x06\x0e-\x1a\x1c-\x1f\x7f]"


def signature(head: Column, among: tuple[str, ...] | None = None) -> Column:
    """MIME type of the longest signature that the bytes have, null for none."""
    found = F.lit(None).cast("string")
    for offset, digits, mime in sorted(SIGNATURES, key=lambda s: len(s[1])):
        if among is None or mime in among:
            value = bytes.fromhex(digits)
            found = F.when(F.substring(head, offset + 1, len(value)) == F.lit(value), mime).otherwise(found)
    return found


def sniff_mime(content: Column) -> Column:
    """MIME type from the first bytes of a binary column.

    A table of signatures, the longest first, narrower than a full magic database: documents, archives, images,
    sound, programs. EPUB and Office archives by their first entry; UTF-16 and UTF-32 text by its
    mark; HTML and XHTML by how they start; text in UTF-8 or in an eight-bit code, which holds no control
    characters; empty; anything else.
    """
    head = F.substring(content, 1, SNIFF_BYTES)
    marks = F.hex(F.substring(content, 1, 4))
    latin = F.decode(head, "ISO-8859-1")
    opening = F.lower(F.ltrim(F.regexp_replace(head.cast("string"), "^\ufeff", ""), F.lit(WHITESPACE)))
    is_html = F.lit(False)
    for start in HTML_STARTS:
        is_html = is_html | F.startswith(opening, F.lit(start))
    first_entry = F.substring(content, 31, 28)
    listed = F.lit(False)
    for entry in OFFICE_ENTRIES:
        listed = listed | F.startswith(first_entry, F.lit(entry.encode()))
    office = F.lit(None).cast("string")
    for part, mime in reversed(OFFICE_PARTS):
        office = F.when(F.contains(head, F.lit(part.encode())), mime).otherwise(office)
    is_zip = marks.isin("504B0304", "504B0506")
    return (
        F.when(F.octet_length(head) == 0, "application/x-empty")
        .when(is_zip, F.coalesce(F.when(listed, office), signature(head)))
        .when(marks.isin("0000FEFF", "FFFE0000") | F.substring(marks, 1, 4).isin("FFFE", "FEFF"), "text/plain")
        .when(latin.rlike(CONTROL), F.coalesce(signature(head), F.lit("application/octet-stream")))
        .when(is_html, "text/html")
        .when(F.startswith(opening, F.lit("<?xml")) & F.contains(opening, F.lit("xhtml")),
              "application/xhtml+xml")
        .otherwise(F.coalesce(signature(head, PRINTED), F.lit("text/plain")))
    )
