"""One query for each operator: (spark, table folder) -> DataFrame.

Arrays and structs are flattened to text here so that results can be compared across engines;
the operators themselves return them as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.text import stem, safe_name
from foliomill.operators import (
    audit, clean, convert, ingest, lifecycle, quality, routing, structure,
)
from foliomill.sources import manifest, sinks, tables, workspace
from foliomill.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

UPLOAD_COLUMNS = ("file_id", "job_id", "original_filename")
VERDICT = ("extension", "mime_type", "size_bytes", "error_class", "error_message")


def query(run: Query) -> Query:
    CATALOG[run.__name__] = run
    return run


def lines(column: str):
    """Array column as one text, one element a line."""
    return F.array_join(column, "\n")


def validated_uploads(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.detect_format(tables.uploads(spark, folder))


def stored_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The validated manifest as a stored table, contents left out."""
    return workspace.written(
        validated_uploads(spark, folder).select(*UPLOAD_COLUMNS, *VERDICT), "manifest"
    )


def routed_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Validated uploads with PDF votes and some wanted converters, routed."""
    flavours = routing.pdf_flavour(tables.pdf_pages(spark, folder)).select(
        (F.col("pdf_id") + 1000000).alias("file_id"), "flavour"
    )
    wanted = (
        F.when(F.col("file_id") % 31 == 0, "pandoc").when(F.col("file_id") % 37 == 0, "unlisted")
    )
    files = validated_uploads(spark, folder).join(flavours, "file_id", "left")
    log = F.when(F.col("file_id") % 3 == 0, F.concat(
        F.lit("note "), F.col("file_id").cast("string"), F.lit("\n   \nmissing image"))).otherwise("")
    return routing.route_files(files.withColumns({"override": wanted, "converter_log": log}))


def cleaned_dirty(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_corpus(tables.dirty_docs(spark, folder))


def converted_pages(spark: SparkSession, folder: str) -> DataFrame:
    return convert.html_to_markdown(tables.pages(spark, folder))


def scored_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages through conversion, cleaning and scoring."""
    return streams.stream_clean(tables.pages(spark, folder))


# -- scans, sources, sinks --------------------------------------------------------------------


@query
def corpus_manifest(spark, folder):
    """Every stored table of the listing: that its files have bytes, and the rows that they hold."""
    listed = manifest.table_files(spark, folder).withColumn(
        "table_name", F.regexp_extract("path", r"([^/]+)[.]parquet(?:/[^/]*)?$", 1))
    return listed.groupBy("table_name", "extension").agg(
        (F.sum("size_bytes") > 0).alias("has_bytes"), F.sum("rows").alias("rows"))


@query
def corpus_files(spark, folder):
    """Every stored file with its path, name, extension and size, and the rows that it holds."""
    return manifest.table_files(spark, folder)


@query
def corpus_sniff_scan(spark, folder):
    return ingest.sniffed(tables.uploads(spark, folder)).select(
        *UPLOAD_COLUMNS, "extension", "mime_type", "size_bytes"
    )


@query
def corpus_file_scan(spark, folder):
    """Uploads written as files and sniffed from their bytes; files over the limit are not opened."""
    target = workspace.fresh(spark, "upload-files")
    named = tables.uploads(spark, folder).withColumn("at", F.concat(
        F.lit("input/"), F.col("file_id").cast("string"), F.lit("/"), "original_filename"))
    sinks.write_files(named, target, "at", "content")
    files = manifest.stored_files(spark, target, max_bytes=200_000)
    return ingest.sniffed(files).select("path", "original_filename", "extension", "mime_type", "size_bytes")


@query
def sniff_signatures(spark, folder):
    """Files of foreign formats, named by their first bytes, and whether they are accepted."""
    return ingest.detect_format(tables.signed_docs(spark, folder)).select(
        "file_id", "original_filename", "mime_type", "size_bytes", "error_class")


@query
def jobs_scan(spark, folder):
    return tables.jobs(spark, folder)


@query
def write_markdown(spark, folder):
    converted = convert.convert_corpus(routed_uploads(spark, folder)).filter(F.col("status") == "done")
    target = workspace.fresh(spark, "markdown")
    sinks.write_markdown(
        converted.select("file_id", "job_id", "original_filename", "markdown"), target
    )
    return spark.read.parquet(target).select(
        "file_id", "job_id", "output_path", F.octet_length("markdown").cast("long").alias("output_bytes")
    )


@query
def bundle_manifest(spark, folder):
    return lifecycle.bundle_manifest(tables.files(spark, folder))


@query
def dead_letter(spark, folder):
    return ingest.dead_letter(validated_uploads(spark, folder)).select(*UPLOAD_COLUMNS, "error")


@query
def dead_letter_sink(spark, folder):
    """Rejected files read back from the split sink; the second batch is delivered twice."""
    target = workspace.fresh(spark, "validated")
    uploads = tables.uploads(spark, folder)
    for batch, part in ((0, "file_id % 2 = 0"), (1, "file_id % 2 = 1"), (1, "file_id % 2 = 1")):
        checked = ingest.detect_format(uploads.filter(part)).select(*UPLOAD_COLUMNS, *VERDICT)
        sinks.write_validated(checked, target, batch)
    return sinks.read_validated(spark, target, accepted=False).select(*UPLOAD_COLUMNS, "error")


# -- ingest -----------------------------------------------------------------------------------


@query
def detect_format(spark, folder):
    return validated_uploads(spark, folder).select(*UPLOAD_COLUMNS, *VERDICT)


@query
def reject_unsupported_ext(spark, folder):
    return ingest.reject_unsupported_ext(tables.uploads(spark, folder)).select(
        *UPLOAD_COLUMNS, "extension"
    )


@query
def accept_supported_ext(spark, folder):
    return ingest.accept_supported_ext(tables.uploads(spark, folder)).select(
        *UPLOAD_COLUMNS, "extension"
    )


@query
def container_rescue(spark, folder):
    return ingest.detect_format(tables.container_docs(spark, folder)).select(
        "file_id", "original_filename", "mime_type", "size_bytes", "error_class"
    )


@query
def reject_oversized(spark, folder):
    sized = ingest.sniffed(tables.uploads(spark, folder))
    return ingest.reject_oversized(sized, 8192).select(*UPLOAD_COLUMNS, "size_bytes")


@query
def validate_by_direction(spark, folder):
    direction = F.when(F.col("job_id") % 8 < 3, "export").otherwise("import")
    return ingest.detect_format(tables.uploads(spark, folder), direction=direction).select(
        *UPLOAD_COLUMNS, "direction", "extension", "mime_type", "error_class"
    )


@query
def invalid_target_format(spark, folder):
    jobs = tables.jobs(spark, folder).withColumn(
        "target_format", F.when(F.col("job_id") % 97 == 0, "rtf").otherwise(F.col("target_format"))
    )
    return ingest.invalid_target_format(jobs).select("job_id", "target_format")


@query
def batch_limits(spark, folder):
    return ingest.batch_limits(
        tables.jobs(spark, folder), tables.files(spark, folder), max_files=6, max_bytes=200_000
    )


@query
def atomic_job_accept(spark, folder):
    return ingest.atomic_job_accept(stored_manifest(spark, folder)).select(
        *UPLOAD_COLUMNS, "extension", "size_bytes"
    )


@query
def path_containment(spark, folder):
    paths = tables.documents(spark, folder).selectExpr(
        "doc_id",
        "CASE doc_id % 6 WHEN 0 THEN concat('/etc/', doc_id) WHEN 1 THEN concat('a/../b/', doc_id) "
        "WHEN 2 THEN concat('a/../../', doc_id) WHEN 3 THEN concat('./input//', doc_id, '/.') "
        "WHEN 4 THEN concat('output/', doc_id, '/x.md') ELSE concat('../', doc_id) END AS path",
    )
    return paths.withColumn("verdict", ingest.path_verdict(F.col("path")))


@query
def dedupe_staged(spark, folder):
    sized = ingest.sniffed(tables.uploads(spark, folder)).select(*UPLOAD_COLUMNS, "size_bytes")
    again = sized.filter(F.col("file_id") % 3 == 0).withColumn("file_id", F.col("file_id") + 10000000)
    return ingest.dedupe_staged(sized.unionByName(again))


@query
def stored_names(spark, folder):
    return ingest.stored_names(tables.uploads(spark, folder).select(*UPLOAD_COLUMNS))


# -- routing ----------------------------------------------------------------------------------


@query
def route_files(spark, folder):
    return routed_uploads(spark, folder).select(
        *UPLOAD_COLUMNS, "extension", "flavour", "target", "converter_name", "route_error"
    )


@query
def route_export(spark, folder):
    return routing.route_export(tables.jobs(spark, folder)).select(
        "job_id", "target_format", "converter_name", "route_error"
    )


@query
def pdf_flavour(spark, folder):
    return routing.pdf_flavour(tables.pdf_pages(spark, folder)).select(
        "pdf_id", "flavour", "sampled_pages",
        F.round("char_pixel_ratio", 9).alias("char_pixel_ratio"),
        F.round("text_page_ratio", 6).alias("text_page_ratio"),
    )


@query
def pdf_sample_plan(spark, folder):
    return routing.pdf_sample_plan(routing.page_counts(tables.pdf_pages(spark, folder)))


# -- quality ----------------------------------------------------------------------------------


@query
def quality_signals(spark, folder):
    return quality.with_signals(tables.quality_docs(spark, folder)).drop("markdown")


@query
def quality_score(spark, folder):
    return quality.assess(tables.quality_docs(spark, folder)).select("file_id", "quality_score")


@query
def quality_level(spark, folder):
    return quality.assess(tables.quality_docs(spark, folder)).select(
        "file_id", "quality_score", "quality_level"
    )


@query
def quality_warnings(spark, folder):
    return quality.assess(tables.quality_docs(spark, folder)).select(
        "file_id", lines("quality_warnings").alias("quality_warnings")
    )


@query
def quality_skip_export(spark, folder):
    files = tables.files(spark, folder)
    jobs = tables.jobs(spark, folder).select("job_id", "target_format")
    return quality.skip_for_exports(files.join(jobs, "job_id")).select(
        "file_id", "job_id", "target_format", F.round("quality_score", 3).alias("quality_score"),
        "quality_level",
    )


@query
def quality_report(spark, folder):
    """Flagship: web pages converted, cleaned and scored, documents scored, and both rolled up."""
    scored = scored_pages(spark, folder).select("quality_level", "quality_score")
    docs = quality.assess(tables.quality_docs(spark, folder)).select("quality_level", "quality_score")
    return quality.quality_report(scored.unionByName(docs))


@query
def quality_docs_report(spark, folder):
    return quality.quality_report(quality.assess(tables.quality_docs(spark, folder)))


@query
def conversion_report(spark, folder):
    return quality.conversion_report(tables.files(spark, folder))


# -- cleaning ---------------------------------------------------------------------------------


def _stage(name: str, stage: Callable[..., DataFrame]) -> None:
    def run(spark, folder):
        return stage(tables.dirty_docs(spark, folder))

    CATALOG[name] = run


for _name, _operator in zip(
    ("strip_svg", "convert_callouts", "strip_table_scaffold", "convert_quoted_div",
     "rewrite_anchors", "strip_spans", "unwrap_paragraphs", "strip_divs", "convert_img_tags",
     "strip_residual_html", "rewrite_image_paths", "normalise_whitespace"),
    clean.STAGES, strict=True,
):
    _stage(_name, _operator)


@query
def clean_corpus(spark, folder):
    return cleaned_dirty(spark, folder)


@query
def clean_pages(spark, folder):
    """The cleaner on raw, malformed HTML."""
    return clean.clean_corpus(tables.pages(spark, folder), "html")


@query
def clean_stats_report(spark, folder):
    return clean.clean_stats_report(cleaned_dirty(spark, folder))


@query
def media_rename_plan(spark, folder):
    renames = cleaned_dirty(spark, folder).select("job_id", "file_id", "media_dir_old", "media_dir_new")
    return clean.media_rename_plan(workspace.written(renames, "renames"))


@query
def residual_html_audit(spark, folder):
    return clean.residual_html_audit(cleaned_dirty(spark, folder)).select("file_id")


@query
def clean_idempotence_audit(spark, folder):
    once = cleaned_dirty(spark, folder).select("file_id", F.col("text").alias("once"), "text")
    twice = clean.clean_corpus(once)
    return twice.filter(F.col("once") != F.col("text")).select("file_id", "once", "text")


# -- conversion -------------------------------------------------------------------------------


@query
def html_to_markdown(spark, folder):
    return converted_pages(spark, folder).select("page_id", "title", "markdown")


@query
def text_to_markdown(spark, folder):
    texts = convert.text_to_markdown(tables.documents(spark, folder).select("doc_id", "text"))
    return clean.clean_corpus(texts, "markdown").select("doc_id", "markdown")


@query
def convert_corpus(spark, folder):
    return convert.convert_corpus(routed_uploads(spark, folder)).select(
        *UPLOAD_COLUMNS, "converter_name", "status", "output_bytes", "error", "markdown",
        lines("warnings").alias("warnings"),
    )


@query
def reject_empty_output(spark, folder):
    webs = converted_pages(spark, folder).select(F.col("page_id").alias("file_id"), "markdown")
    texts = tables.quality_docs(spark, folder).select(
        (F.col("file_id") + 1000000).alias("file_id"), "markdown"
    )
    return convert.reject_empty(webs.unionByName(texts)).select("file_id")


@query
def warning_lines(spark, folder):
    logs = tables.documents(spark, folder).selectExpr(
        "doc_id",
        "concat(replace(replace(text, char(10), concat(char(10), 'WARNING: ')), '. ', "
        "concat('.', char(10))), char(10), '   ', char(10), '[WARNING] missing image') AS log",
    )
    logs = logs.withColumns({
        "kept": convert.warning_lines(F.col("log")),
        "exported": convert.warning_lines(F.col("log"), export=True),
    })
    return logs.select(
        "doc_id", F.size("kept").alias("lines"), F.size("exported").alias("export_lines"),
        lines("exported").alias("export_log"),
    )


# -- structure --------------------------------------------------------------------------------


@query
def html_blocks(spark, folder):
    """Nested lists, quotations, tables and verbatim text as Markdown."""
    return convert.html_to_markdown(tables.block_pages(spark, folder)).select("doc_id", "markdown")


@query
def heading_outline(spark, folder):
    docs = tables.quality_docs(spark, folder).select("file_id", "markdown")
    webs = converted_pages(spark, folder).select(
        (F.col("page_id") + 1000000).alias("file_id"), "markdown"
    )
    return structure.heading_outline(docs.unionByName(webs), "markdown", "file_id")


@query
def heading_slugs(spark, folder):
    outline = structure.heading_outline(converted_pages(spark, folder), "markdown", "page_id")
    return structure.heading_slugs(outline)


@query
def document_title(spark, folder):
    named = tables.quality_docs(spark, folder).withColumn(
        "name", F.concat(F.lit("doc "), F.col("file_id").cast("string"), F.lit("!.md"))
    )
    title = structure.document_title(F.col("markdown"), safe_name(stem(F.col("name"))))
    return named.select("file_id", title.alias("title"))


@query
def media_references(spark, folder):
    return structure.media_references(tables.dirty_docs(spark, folder), "text", "file_id")


@query
def link_inventory(spark, folder):
    webs = tables.pages(spark, folder).select(F.col("page_id").alias("file_id"), F.col("html").alias("text"))
    docs = tables.dirty_docs(spark, folder).select(
        (F.col("file_id") + 1000000).alias("file_id"), "text"
    )
    return structure.link_inventory(webs.unionByName(docs), "text", "file_id")


# -- lifecycle --------------------------------------------------------------------------------


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.job_status(tables.jobs(spark, folder), tables.files(spark, folder))


@query
def job_status(spark, folder):
    return statuses(spark, folder).select("job_id", "total_files", "succeeded", "failed", "status")


@query
def job_terminal_fields(spark, folder):
    return lifecycle.job_terminal_fields(statuses(spark, folder)).select(
        "job_id", "status", "completed_at", "error_message"
    )


@query
def job_progress(spark, folder):
    return lifecycle.job_progress(statuses(spark, folder)).select(
        "job_id", "processed_files", "total_files", "progress"
    )


@query
def file_state(spark, folder):
    return lifecycle.file_state(tables.file_events(spark, folder))


def _nested_as_text(df: DataFrame) -> DataFrame:
    def shown(f):
        values = {name: f[name] for name in lifecycle.FILE_FIELDS}
        values["warnings"] = F.array_join(F.coalesce(f["warnings"], F.array().cast("array<string>")), ";")
        values["quality_score"] = F.round(f["quality_score"] * 100).cast("long")
        values["created_at"] = F.date_format(f["created_at"], "yyyy-MM-dd")
        return F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("-")) for v in values.values()])

    return df.withColumns({
        "file_count": F.coalesce(F.size("files"), F.lit(0)),
        "files": F.coalesce(F.array_join(F.transform("files", shown), "\n"), F.lit("")),
    })


JOB_COLUMNS = (
    "job_id", "target_format", "created_at", "status", "completed_at", "error_message", "total_files", "processed_files",
    "chunk", "file_count", "files",
)


@query
def list_jobs(spark, folder):
    page = lifecycle.list_jobs(
        tables.jobs(spark, folder), tables.files(spark, folder), limit=20, offset=20
    )
    return _nested_as_text(page).select(*JOB_COLUMNS)


@query
def job_detail(spark, folder):
    detail = lifecycle.job_detail(tables.jobs(spark, folder), tables.files(spark, folder))
    return _nested_as_text(detail).select(*JOB_COLUMNS)


def deleted_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.jobs(spark, folder).filter(F.col("stored_status") == "done")


@query
def delete_cascade(spark, folder):
    return lifecycle.delete_cascade(tables.files(spark, folder), deleted_jobs(spark, folder)).select(
        "job_id", "file_id"
    )


@query
def delete_stored(spark, folder):
    """Files that are left in the stored table after their jobs were deleted from it."""
    target = workspace.fresh(spark, "stored-files")
    sinks.write_by_job(tables.files(spark, folder).select("job_id", "file_id", "storage_path", "output_path"), target)
    sinks.delete_jobs(spark, target, deleted_jobs(spark, folder), workspace.fresh(spark, "deletion"))
    return spark.read.parquet(target).select("job_id", "file_id")


@query
def delete_cleanup_paths(spark, folder):
    return lifecycle.cleanup_paths(tables.files(spark, folder), deleted_jobs(spark, folder))


@query
def job_card(spark, folder):
    cards = lifecycle.job_card(tables.jobs(spark, folder), tables.files(spark, folder))
    return cards.withColumn("converters", F.array_join("converters", ", "))


@query
def bundle_names(spark, folder):
    return lifecycle.bundle_names(tables.files(spark, folder)).select("job_id", "file_id", "member_name")


@query
def download_names(spark, folder):
    return lifecycle.download_names(tables.files(spark, folder)).select(
        "file_id", "download_name", "media_type"
    )


@query
def preview_availability(spark, folder):
    return lifecycle.preview_availability(tables.files(spark, folder)).select("file_id", "preview")


@query
def merge_warnings(spark, folder):
    docs = quality.assess(tables.quality_docs(spark, folder))
    log = F.regexp_replace("markdown", "[.] ", ".\n")
    merged = lifecycle.merge_warnings(F.col("quality_warnings"), convert.warning_lines(log))
    return docs.select(
        "file_id", F.coalesce(F.size(merged), F.lit(0)).alias("warnings"),
        F.array_join(merged, "\n").alias("merged"),
    )


@query
def conversion_results(spark, folder):
    converted = convert.convert_corpus(routed_uploads(spark, folder)).filter(F.col("status") == "done")
    named = sinks.with_output_name(converted).withColumns({
        "input_bytes": F.col("size_bytes"), "pages": F.lit(None).cast("int"),
    })
    scored = quality.assess(named).withColumns({
        "converter": F.col("converter_name"), "target_format": F.col("target"),
        "detected_mime": F.col("mime_type"), "size_bytes": F.col("output_bytes"),
        "pages": F.lit(None).cast("int"), "duration_seconds": F.col("file_id") % 977 / 8,
        "warnings": F.concat("quality_warnings", "warnings"),
    })
    return lifecycle.conversion_results(scored).withColumn("warnings", lines("warnings"))


@query
def active_jobs(spark, folder):
    return lifecycle.active_jobs(tables.jobs(spark, folder)).select("job_id", "stored_status")


@query
def retry_plan(spark, folder):
    return lifecycle.retry_plan(tables.file_events(spark, folder))


@query
def time_limit_breaches(spark, folder):
    return lifecycle.time_limit_breaches(tables.file_events(spark, folder))


@query
def result_expiry(spark, folder):
    return lifecycle.result_expiry(tables.file_events(spark, folder)).select("event_id", "file_id", "kind")


@query
def backfill_status(spark, folder):
    files = tables.files(spark, folder).withColumn(
        "status", F.when(F.col("status") == "done", "pending").otherwise(F.col("status"))
    )
    return lifecycle.backfill_status(files).select("file_id", "status")


@query
def staged_totals(spark, folder):
    sized = tables.files(spark, folder).select("job_id", (F.col("size_bytes") * 37).alias("size_bytes"))
    return lifecycle.staged_totals(sized)


@query
def file_lookup_by_id(spark, folder):
    found = lifecycle.file_lookup_by_id(tables.files(spark, folder), tables.jobs(spark, folder))
    return found.select("file_id", "job_id", "target_format")


# -- audits -----------------------------------------------------------------------------------


@query
def domain_violations(spark, folder):
    jobs = tables.jobs(spark, folder).withColumns({
        "stored_status": F.when(F.col("job_id") % 89 == 0, "queued").otherwise(F.col("stored_status")),
        "target_format": F.when(F.col("job_id") % 97 == 0, "rtf").otherwise(F.col("target_format")),
    })
    files = tables.files(spark, folder).withColumns({
        "size_bytes": F.when(F.col("size_bytes") % 101 == 0, -1).otherwise(F.col("size_bytes")),
        "quality_score": F.when(F.col("pages") == 50, 1.5).otherwise(F.col("quality_score")),
        "original_filename": F.when(F.col("size_bytes") % 103 == 0, None)
        .otherwise(F.col("original_filename")),
        "original_format": F.when(F.col("size_bytes") % 107 == 0, None).otherwise(F.col("original_format")),
        "stored_filename": F.when(F.col("size_bytes") % 109 == 0, None).otherwise(F.col("stored_filename")),
    })
    return audit.domain_violations(jobs, files)


@query
def orphan_files(spark, folder):
    jobs = tables.jobs(spark, folder).filter(F.col("stored_status") != "processing")
    return audit.orphan_files(tables.files(spark, folder), jobs).select("file_id", "job_id")


@query
def jobs_without_files(spark, folder):
    return audit.jobs_without_files(tables.jobs(spark, folder), tables.files(spark, folder)).select("job_id")


@query
def counter_drift(spark, folder):
    jobs = tables.jobs(spark, folder).withColumn(
        "processed_files", F.when(F.col("job_id") % 5 > 0, F.col("total_files"))
    )
    return audit.counter_drift(jobs, tables.files(spark, folder))


@query
def unreferenced_outputs(spark, folder):
    files = tables.files(spark, folder)
    stored = files.filter(F.col("pages") != 7).select(F.col("storage_path").alias("path"))
    outputs = files.filter(F.col("output_path").isNotNull() & (F.col("pages") != 9)).select(
        F.when(F.col("pages") == 11, F.concat("output_path", F.lit(".bak")))
        .otherwise(F.col("output_path")).alias("path")
    )
    return audit.unreferenced_outputs(stored.unionByName(outputs), files)


@query
def unreferenced_files(spark, folder):
    """Uploads written as files, some of them not, some twice, against the rows that name them."""
    target = workspace.fresh(spark, "audited-files")
    files = ingest.stored_names(tables.uploads(spark, folder))
    stray = files.filter("file_id % 11 = 0").withColumn("storage_path", F.concat("storage_path", F.lit(".bak")))
    sinks.write_files(files.unionByName(stray).filter("file_id % 7 <> 0"), target, "storage_path", "content")
    listing = manifest.stored_paths(spark, target).select("path")
    return audit.unreferenced_outputs(listing, files.select(
        "storage_path", F.lit(None).cast("string").alias("output_path")))


# -- streaming --------------------------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return streams.table_stream(spark, folder, "events").selectExpr(*tables.FILE_EVENT_COLUMNS)


@query
def stream_clean(spark, folder):
    pages = streams.table_stream(spark, folder, "pages", "page_id", "html")
    rows, _ = streams.drain(streams.stream_clean(pages), "stream-clean")
    return rows.select("page_id", "title", "markdown", "quality_score", "quality_level")


@query
def stream_dedupe(spark, folder):
    once = event_stream(spark, folder)
    rows, _ = streams.drain(
        streams.stream_dedupe(once.unionByName(event_stream(spark, folder)), "60 days"), "stream-dedupe"
    )
    return rows.select("event_id", "job_id", "file_id", "kind")


@query
def stream_job_status(spark, folder):
    return streams.stream_job_status(event_stream(spark, folder), tables.event_jobs(spark, folder))


@query
def stream_rate_limit(spark, folder):
    requests = streams.table_stream(spark, folder, "events").select("ts", F.col("user_id").alias("client"))
    return streams.stream_rate_limit(requests, 1)


@query
def rate_limit_alerts(spark, folder):
    """The running form: minutes that the watermark has closed, each reported once."""
    requests = streams.table_stream(spark, folder, "events").select("ts", F.col("user_id").alias("client"))
    rows, _ = streams.drain(streams.rate_limit_alerts(requests, 1), "rate-alerts")
    return rows.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query
def stream_late_count(spark, folder):
    """Rows that the deduplicating stream drops behind its watermark, as it counts them itself."""
    source = streams.arriving(tables.late_arrivals(spark, folder), tables.ARRIVALS, F.col("arrival"), "arriving")
    dropped = streams.count_late(streams.stream_dedupe(source, "1 hour"), "stream-late-count")
    return spark.range(1).select(F.lit(dropped).cast("long").alias("late_rows"))


@query
def stream_late_events(spark, folder):
    """Events that arrive behind the watermark of an hour."""
    events = tables.late_arrivals(spark, folder)
    source = streams.arriving(events, tables.ARRIVALS, F.col("arrival"), "arriving")
    rows, _ = streams.drain(streams.stream_dedupe(source, "1 hour"), "stream-late")
    return streams.late_events(events, rows).select("event_id", "file_id", "kind", "arrival")


@query
def stream_stuck_files(spark, folder):
    rows, _ = streams.drain(streams.stream_stuck_files(event_stream(spark, folder)), "stream-stuck")
    return rows.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
