"""Validation of submitted files: format, size, batch limits, paths, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import safe_name, stem, suffix
from foliomill.sources import lookups
from foliomill.sources.manifest import sniff_mime

MAX_FILE_MB = 100
MAX_JOB_MB = 500
MAX_FILES_PER_JOB = 50
_EOCD_WINDOW = 65_557  # end record plus the longest archive comment


def extension(name: Column) -> Column:
    return F.lower(suffix(name))


def sniffed(files: DataFrame, name: str = "original_filename", content: str = "content") -> DataFrame:
    """Add ``extension``, ``mime_type`` and ``size_bytes`` of each file."""
    body = F.col(content).cast("binary")
    return files.withColumns({
        "extension": extension(F.col(name)),
        "mime_type": sniff_mime(body),
        "size_bytes": F.octet_length(body).cast("long"),
    })


def _little_endian(four_bytes: Column) -> Column:
    digits = F.hex(four_bytes)
    flipped = F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])
    return F.conv(flipped, 16, 10).cast("long")


def archive_holds(content: Column, entry: Column) -> Column:
    """True where the binary is a ZIP whose central directory lists ``entry``.

    The end record at the tail gives the directory's size; the directory is then searched for a
    record whose name has exactly the entry's length and text. Names that only occur in file data
    do not count. ZIP64 archives, beyond any accepted file size, are not read.
    """
    size = F.octet_length(content)
    skipped = F.greatest(size - _EOCD_WINDOW, F.lit(0))
    tail = F.decode(F.substring(content, skipped + 1, size), "ISO-8859-1")
    before_end = F.regexp_extract(tail, r"(?s)^(.*)PK\x05\x06.{18}", 1)
    found = tail.rlike(r"(?s)PK\x05\x06.{18}")
    end_at = skipped + F.length(before_end)  # bytes before the end record
    directory_size = _little_endian(F.substring(content, (end_at + 13).cast("int"), F.lit(4)))
    start = F.greatest(end_at - directory_size, F.lit(0))
    directory = F.decode(
        F.substring(content, (start + 1).cast("int"), directory_size.cast("int")), "ISO-8859-1"
    )
    name_length = F.length(entry)
    record = F.concat(
        F.lit(r"(?s)PK\x01\x02.{24}\x"), F.lower(F.lpad(F.hex(name_length), 2, "0")),
        F.lit(r"\x00.{16}\Q"), entry, F.lit(r"\E"),
    )
    return F.coalesce(found & F.regexp_like(directory, record), F.lit(False))


def detect_format(
    files: DataFrame,
    *,
    direction: Column | None = None,
    max_file_mb: int = MAX_FILE_MB,
    content: str = "content",
    rescue: bool = True,
) -> DataFrame:
    """Accept a file or give it one error class; checks run in the order extension, type, size.

    A type that does not fit a container extension is accepted after all when the archive's own
    directory proves the format. ``direction`` ('import' or 'export') selects the whitelist.
    """
    spark = files.sparkSession
    files = sniffed(files, content=content).withColumn(
        "direction", F.lit("import") if direction is None else direction
    )
    files = files.join(F.broadcast(lookups.formats(spark)), ["direction", "extension"], "left")
    mime_ok = F.coalesce(F.array_contains("mimes", F.col("mime_type")), F.lit(False))
    rescued = F.lit(None).cast("string")
    if rescue:
        files = files.join(F.broadcast(lookups.containers(spark)), "extension", "left")
        body = F.col(content).cast("binary")
        rescued = F.when(
            F.col("marker").isNotNull() & F.col("mimes").isNotNull() & ~mime_ok
            & archive_holds(body, F.col("marker")),
            F.col("canonical_mime"),
        )
    files = files.withColumns({"_mime_ok": mime_ok, "_rescued": rescued})
    limit = max_file_mb * 1024 * 1024
    error = (
        F.when(F.col("mimes").isNull(), "UnsupportedExtensionError")
        .when(~F.col("_mime_ok") & F.col("_rescued").isNull(), "MimeTypeMismatchError")
        .when(F.col("size_bytes") > limit, "FileTooLargeError")
    )
    expected = F.when(
        F.col("direction") == "import", F.lit(str(sorted(lookups.IMPORT_EXTENSIONS)))
    ).otherwise(F.lit(str(sorted(lookups.EXPORT_EXTENSIONS))))
    files = files.withColumn("error_class", error)
    message = (
        F.when(F.col("error_class") == "UnsupportedExtensionError", F.concat(
            F.lit("extension '"), "extension", F.lit("' is not allowed; expected one of "), expected))
        .when(F.col("error_class") == "MimeTypeMismatchError", F.concat(
            F.lit("libmagic detected '"), "mime_type",
            F.lit("' which is incompatible with extension '"), "extension", F.lit("'")))
        .when(F.col("error_class") == "FileTooLargeError", F.concat(
            F.lit("file is "), F.col("size_bytes").cast("string"),
            F.lit(f" bytes; limit is {limit} ({max_file_mb} MB)")))
    )
    return files.withColumns({
        "error_message": message,
        "mime_type": F.coalesce("_rescued", "mime_type"),
    }).drop("mimes", "marker", "canonical_mime", "_mime_ok", "_rescued")


def _whitelist(files: DataFrame, direction: str) -> DataFrame:
    formats = lookups.formats(files.sparkSession)
    return F.broadcast(formats.filter(F.col("direction") == direction).select("extension"))


def reject_unsupported_ext(files: DataFrame, direction: str = "import") -> DataFrame:
    """Files whose extension is outside the whitelist."""
    named = files.withColumn("extension", extension(F.col("original_filename")))
    return named.join(_whitelist(files, direction), "extension", "left_anti")


def accept_supported_ext(files: DataFrame, direction: str = "import") -> DataFrame:
    """Files whose extension is inside the whitelist."""
    named = files.withColumn("extension", extension(F.col("original_filename")))
    return named.join(_whitelist(files, direction), "extension", "left_semi")


def reject_oversized(files: DataFrame, max_bytes: int = MAX_FILE_MB * 1024 * 1024) -> DataFrame:
    """Files strictly above the size limit."""
    return files.filter(F.col("size_bytes") > max_bytes)


def invalid_target_format(jobs: DataFrame) -> DataFrame:
    """Jobs whose target is not a known output format."""
    return jobs.filter(~F.col("target_format").isin(*lookups.TARGET_FORMATS))


def batch_limits(
    jobs: DataFrame,
    files: DataFrame,
    *,
    max_files: int = MAX_FILES_PER_JOB,
    max_bytes: int = MAX_JOB_MB * 1024 * 1024,
) -> DataFrame:
    """Files, bytes and first broken limit of each job."""
    sums = files.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"),
    )
    counted = jobs.select("job_id").join(sums, "job_id", "left").fillna(0, ["files", "bytes"])
    return counted.withColumn(
        "limit_error",
        F.when(F.col("files") == 0, "no files")
        .when(F.col("files") > max_files, "too many files")
        .when(F.col("bytes") > max_bytes, "job too large"),
    )


def atomic_job_accept(validated: DataFrame) -> DataFrame:
    """Files of the jobs without any rejected file.

    ``validated`` is read twice, so pass a stored manifest rather than the validation itself.
    """
    spoiled = (
        validated.filter(F.col("error_class").isNotNull()).groupBy("job_id").agg(F.count(F.lit(1)))
    )
    return validated.join(spoiled, "job_id", "left_anti")


def dead_letter(validated: DataFrame) -> DataFrame:
    """Rejected files with their error text."""
    return validated.filter(F.col("error_class").isNotNull()).withColumn(
        "error", F.concat_ws(": ", "error_class", "error_message")
    )


def path_verdict(path: Column) -> Column:
    """'absolute', 'escapes' or 'contained' for a path relative to the data folder."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("escaped"))

    def step(acc: Column, part: Column) -> Column:
        up, stay = part == "..", part.isin("", ".")
        depth = F.when(stay, acc["depth"]).when(up, F.greatest(acc["depth"] - 1, F.lit(0)))
        return F.struct(
            depth.otherwise(acc["depth"] + 1).alias("depth"),
            (acc["escaped"] | (up & (acc["depth"] == 0))).alias("escaped"),
        )

    escaped = F.aggregate(F.split(path, "/", -1), start, step, lambda acc: acc["escaped"])
    return (
        F.when(F.startswith(path, F.lit("/")), "absolute")
        .when(F.contains(path, F.lit("..")) & escaped, "escapes").otherwise("contained")
    )


def dedupe_staged(staged: DataFrame) -> DataFrame:
    """First file by arrival for each (job, name, size); a mergeable minimum, not a window."""
    keys = ["job_id", "original_filename", "size_bytes"]
    return staged.groupBy(*keys).agg(F.min("file_id").alias("file_id"))


def stored_names(files: DataFrame) -> DataFrame:
    """Collision-free stored name and path of each file, derived from its id."""
    name = F.col("original_filename")
    stored = F.concat(
        F.md5(F.col("file_id").cast("string").cast("binary")), F.lit("_"),
        safe_name(stem(name)), extension(name),
    )
    return files.withColumn("stored_filename", stored).withColumn(
        "storage_path", F.concat(F.lit("input/"), "stored_filename")
    )
