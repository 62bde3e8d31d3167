"""Jobs and their files: status, paging, names, retries, limits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions.text import human_size, if_empty, safe_name, stem, suffix
from foliomill.operators import skew
from foliomill.operators.ingest import path_verdict
from foliomill.operators.skew import (
    HOT, bucketed_lag, bucketed_row_number, bucketed_running_sum, large_keys, range_bucket, sized_row_number, split_points,
    within,
)
from foliomill.sources import lookups, workspace

MAX_WARNINGS = 50
FILES_PER_CHUNK = 50
FILES_A_TASK = 100_000
UNSORTED_PARTS = 200  # beyond that Spark sorts, and spills, rows before it writes a shuffle
PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
SOFT_LIMIT_SECONDS, HARD_LIMIT_SECONDS = 300, 360
RESULT_HOURS = 24
OCR_LIMIT_SECONDS = 900
# The placeholder of a job without files, and what is shown of a file.
UNTITLED = "Sans titre"
FILE_FIELDS = (
    "file_id", "job_id", "original_filename", "original_format", "status", "converter_used", "output_path",
    "size_bytes", "pages", "error_message", "warnings", "quality_score", "quality_level", "created_at",
)


# -- status ---------------------------------------------------------------------------------


def _tally() -> list[Column]:
    done, failed = F.col("status") == "done", F.col("status") == "failed"
    return [
        F.count(F.lit(1)).alias("file_rows"),
        F.count_if(done).alias("succeeded"),
        F.count_if(failed).alias("failed"),
        F.max(F.when(done | failed, F.col("finished_at"))).alias("last_finished_at"),
    ]


def tallies(files: DataFrame) -> DataFrame:
    """Files and finished files of each job, and when the last one finished."""
    return files.groupBy("job_id").agg(*_tally())


def status_of(total: Column, succeeded: Column, failed: Column) -> Column:
    return (
        F.when(total <= 0, "pending")
        .when(succeeded + failed < total, "processing")
        .when(failed == 0, "done")
        .when(succeeded == 0, "failed")
        .otherwise("partial_success")
    )


def job_status(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Status of every job from its files; jobs without files are kept."""
    return _with_status(jobs.join(tallies(files), "job_id", "left"))


def _with_status(joined: DataFrame) -> DataFrame:
    joined = joined.fillna(0, ["succeeded", "failed", "file_rows"])
    total = F.coalesce("total_files", F.lit(0))
    return joined.withColumns({
        "total_files": total,
        "status": status_of(total, F.col("succeeded"), F.col("failed")),
    })


def job_terminal_fields(statuses: DataFrame) -> DataFrame:
    """Completion time and error text, only for jobs that ended."""
    ended = F.col("status").isin("done", "failed", "partial_success")
    message = F.concat(
        F.col("failed").cast("string"), F.lit(" of "), F.col("total_files").cast("string"),
        F.lit(" file(s) failed to convert"),
    )
    return statuses.withColumns({
        "completed_at": F.when(ended, F.col("last_finished_at")),
        "error_message": F.when(ended & (F.col("failed") > 0), message),
    })


def job_progress(statuses: DataFrame) -> DataFrame:
    """Processed files, counted rather than incremented, so a redelivery changes nothing."""
    processed = F.col("succeeded") + F.col("failed")
    return statuses.withColumns({
        "processed_files": processed,
        "progress": F.concat_ws("/", processed.cast("string"), F.col("total_files").cast("string")),
    })


STATUS_OF_EVENT = {"queued": "pending", "start": "processing", "complete": "done", "fail": "failed"}


def event_status(kind: Column) -> Column:
    status = F.lit(None).cast("string")
    for event, name in STATUS_OF_EVENT.items():
        status = F.when(kind == event, name).otherwise(status)
    return status


def file_state(events: DataFrame) -> DataFrame:
    """Current state of each file: its latest event, its latest failure's error class, and what its
    latest completion recorded. A later failure leaves that record as it is.

    Maxima of (time, id, value) merge before the shuffle; no file's events are gathered.
    """
    stamp = F.struct("ts", "event_id", "kind")
    recorded = ("converter", "output_path", "size_bytes", "pages")
    completion = F.when(F.col("kind") == "complete", F.struct("ts", "event_id", *recorded))
    failure = F.when(F.col("kind") == "fail", F.struct("ts", "event_id", "error_class"))
    return events.groupBy("job_id", "file_id").agg(
        F.max(stamp).alias("_latest"), F.max(failure).alias("_failure"), F.max(completion).alias("_done"),
        F.count(F.lit(1)).alias("events"),
    ).select(
        "job_id", "file_id", event_status(F.col("_latest.kind")).alias("status"),
        F.col("_latest.ts").alias("changed_at"), F.col("_failure.error_class").alias("error_class"),
        "events", *[F.col(f"_done.{name}").alias(name) for name in recorded],
    )


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs still waiting or running."""
    return jobs.filter(F.col("stored_status").isin("pending", "processing"))


def backfill_status(files: DataFrame) -> DataFrame:
    """Files with an output are done, whatever their status says."""
    return files.withColumn(
        "status", F.when(F.col("output_path").isNotNull(), "done").otherwise(F.col("status"))
    )


# -- reads ----------------------------------------------------------------------------------


def nest_files(files: DataFrame, chunk: int = FILES_PER_CHUNK) -> DataFrame:
    """Files as arrays of structs, in id order: (job_id, chunk, files).

    A job within the batch limit is one row. A larger one continues in further rows, so no array
    grows with the job and no file is left out.
    """
    ranked = bucketed_row_number(
        files.select(*FILE_FIELDS), ["job_id"], range_bucket("file_id", split_points(files, "file_id")), [F.col("file_id")], "_at"
    )
    part = F.floor((F.col("_at") - 1) / chunk).cast("int")
    return ranked.groupBy("job_id", part.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct(*FILE_FIELDS))).alias("files")
    )


def job_detail(jobs: DataFrame, files: DataFrame, chunk: int = FILES_PER_CHUNK) -> DataFrame:
    """Jobs with status, counters, end and error, and their files nested; a job without files has
    one row and no array.

    One grouping gives tallies and files of each job. Jobs of more files than one task takes are known from
    a count beforehand: theirs are nested in chunks from the start.
    """
    sizes = files.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    parts = min(max(1, math.ceil(total / FILES_A_TASK)), UNSORTED_PARTS)
    if most <= skew.HOT:
        return _detail(jobs, files, chunk, parts)
    large = workspace.written(large_keys(sizes, ["job_id"], "n"), "large-jobs")
    usual = _detail(within(jobs, large, ["job_id"], "left_anti"), within(files, large, ["job_id"], "left_anti"), chunk, parts)
    theirs = within(files, large, ["job_id"], "left_semi")
    # An inner join: adaptive execution can split a very large job's chunks.
    told = _told(job_status(within(jobs, large, ["job_id"], "left_semi"), theirs))
    return usual.unionByName(told.join(nest_files(theirs, chunk), "job_id").drop("file_rows"))


def _told(statuses: DataFrame) -> DataFrame:
    return job_progress(job_terminal_fields(statuses)).drop("last_finished_at", "progress")


def _detail(jobs: DataFrame, files: DataFrame, chunk: int, parts: int) -> DataFrame:
    """``job_detail`` of jobs whose files fit a task.

    Files are dealt by job as they are, over so many ``parts`` that sorting one stays in memory. Collecting them before
    would sort, and spill, every row twice to merge the few files that a job has in one task.
    """
    grouped = files.select(*FILE_FIELDS, "finished_at").repartition(parts, "job_id").groupBy("job_id").agg(
        *_tally(), F.sort_array(F.collect_list(F.struct(*FILE_FIELDS))).alias("_all"))
    told = _told(_with_status(jobs.join(grouped, "job_id", "left")))
    last = F.floor((F.greatest("file_rows", F.lit(1)) - 1) / chunk).cast("int")
    return told.withColumn("chunk", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "files", F.slice("_all", F.col("chunk") * chunk + 1, F.lit(chunk))).drop("_all", "file_rows")


def list_jobs(
    jobs: DataFrame, files: DataFrame, limit: int = PAGE_SIZE, offset: int = 0, after: tuple | None = None
) -> DataFrame:
    """One page of jobs, newest first, with nested files.

    The page is cut and stored before any file is joined, so only its jobs' files are read further;
    at most 100 job ids are broadcast. ``after`` is the (created_at, job_id) that the page before
    ended with: pages far down then need no offset, which gathers all rows before it.
    """
    limit, offset = max(1, min(limit, MAX_PAGE_SIZE)), max(0, offset)
    created = F.col("created_at")
    if after is not None:
        at, job = after
        later = F.col("job_id") > F.lit(job)
        jobs = jobs.filter(
            created.isNull() & later if at is None
            else created.isNull() | (created < F.lit(at)) | ((created == F.lit(at)) & later))
    page = workspace.written(
        jobs.orderBy(created.desc_nulls_last(), "job_id").offset(offset).limit(limit), "job-page")
    wanted = workspace.written(files.join(F.broadcast(page.select("job_id")), "job_id", "left_semi"), "page-files")
    return job_detail(page, wanted).orderBy(created.desc_nulls_last(), "job_id", "chunk")


def job_card(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Headline of each job: first file's name, further files, bytes, pages, converters."""
    summed = files.groupBy("job_id").agg(
        F.min_by("original_filename", "file_id").alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_bytes"),
        F.sum(F.coalesce("pages", F.lit(0)).cast("long")).alias("total_pages"),
        F.sort_array(F.collect_set("converter_used")).alias("converters"),
    )
    joined = jobs.select("job_id").join(summed, "job_id", "left")
    return joined.select(
        "job_id",
        F.coalesce("_first", F.lit(UNTITLED)).alias("title"),
        F.greatest(F.coalesce("_n", F.lit(0)) - 1, F.lit(0)).alias("extra_files"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
        F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
        F.coalesce("converters", F.array().cast("array<string>")).alias("converters"),
    )


def file_lookup_by_id(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each file with its job's target format."""
    return files.join(jobs.select("job_id", "target_format"), "job_id")


def staged_totals(files: DataFrame) -> DataFrame:
    """Files and bytes of each submission, with a readable size."""
    sums = files.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )
    return sums.withColumn("readable", human_size(F.col("bytes")))


# -- deletion -------------------------------------------------------------------------------


def delete_cascade(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Files left after their jobs were deleted."""
    return files.join(deleted.select("job_id"), "job_id", "left_anti")


def cleanup_paths(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Stored paths of deleted jobs; paths that leave the data folder are never touched."""
    gone = files.join(deleted.select("job_id"), "job_id", "left_semi")
    paths = gone.select("job_id", F.explode(F.array("storage_path", "output_path")).alias("path"))
    return paths.filter(
        F.col("path").isNotNull() & (F.col("path") != "") & (path_verdict(F.col("path")) == "contained")
    )


# -- downloads ------------------------------------------------------------------------------


def output_suffix(path: Column) -> Column:
    return if_empty(suffix(path), ".md")


def with_media_type(df: DataFrame, path: str = "output_path") -> DataFrame:
    types = lookups.media_types(df.sparkSession)
    keyed = df.withColumn("suffix", F.lower(output_suffix(F.col(path))))
    return keyed.join(F.broadcast(types), "suffix", "left").withColumn(
        "media_type", F.coalesce("media_type", F.lit(lookups.DEFAULT_MEDIA_TYPE))
    ).drop("suffix")


def download_names(files: DataFrame) -> DataFrame:
    """Attachment name and media type of each converted file."""
    ready = files.filter(F.col("output_path").isNotNull())
    name = F.concat(safe_name(stem(F.col("original_filename"))), output_suffix(F.col("output_path")))
    return with_media_type(ready.withColumn("download_name", name))


def preview_availability(files: DataFrame) -> DataFrame:
    """Whether a file's output can be shown as text."""
    kind = F.lower(suffix(F.col("output_path")))
    return files.withColumn(
        "preview",
        F.when(F.coalesce("output_path", F.lit("")) == "", "conflict")
        .when(~kind.isin(".md", ".markdown"), "unsupported").otherwise("available"),
    )


# Longer numbers than 18 digits cannot be reached by counting files.
_NUMBER = "[2-9]|[1-9][0-9]{1,17}"
_NUMBERED = f"^(.*)-({_NUMBER})$"
NAME_KEYS = ["job_id", "ext", "name_stem"]
STRETCH = 10_000  # numbers of one family that are settled at a time


def _sibling_pairs(groups: DataFrame) -> DataFrame:
    """Numbered names next to the plain name in the same job: ``a-2`` beside ``a``, if counting can reach them."""
    numbered = groups.filter(F.col("name_stem").rlike(_NUMBERED)).select(
        "job_id", "ext", F.regexp_extract("name_stem", _NUMBERED, 1).alias("name_stem"),
        F.col("name_stem").alias("sibling"), F.col("first_id").alias("file_id"),
        F.regexp_extract("name_stem", _NUMBERED, 2).cast("long").alias("number"),
    )
    beside = numbered.join(groups.select(*NAME_KEYS, F.col("files").alias("parent_files")), NAME_KEYS)
    # A parent's files take at most as many numbers as there are of them and of its siblings.
    siblings = beside.groupBy(*NAME_KEYS).agg(F.count(F.lit(1)).alias("siblings"))
    reached = beside.join(siblings, NAME_KEYS).filter(F.col("number") <= F.col("parent_files") + F.col("siblings") + 1)
    return reached.withColumn("stretch", F.when(F.col("siblings") <= STRETCH, 0).otherwise(F.floor(F.col("number") / STRETCH)))


def _placed(pairs: DataFrame, ready: DataFrame) -> DataFrame:
    """Pairs with ``before``, the parent's files that came before the sibling's first one, by a running count over both."""
    parents = pairs.select(*NAME_KEYS, "parent_files", "siblings").distinct()
    files = ready.join(parents.select(*NAME_KEYS), NAME_KEYS, "left_semi").select(*NAME_KEYS, "file_id", F.lit(1).alias("is_file"))
    both = files.unionByName(pairs.withColumn("is_file", F.lit(0)), allowMissingColumns=True)
    large = large_keys(parents.withColumn("n", F.col("parent_files") + F.col("siblings")), NAME_KEYS, "n")
    order = Window.partitionBy(*NAME_KEYS).orderBy("file_id", "sibling").rowsBetween(Window.unboundedPreceding, 0)
    usual = both if large is None else within(both, large, NAME_KEYS, "left_anti")
    counted = usual.withColumn("before", F.sum("is_file").over(order))
    if large is not None:
        hot = within(both, large, NAME_KEYS, "left_semi")
        counted = counted.unionByName(bucketed_running_sum(
            hot, NAME_KEYS, range_bucket("file_id", split_points(hot, "file_id")),
            [F.col("file_id"), F.col("sibling")], F.col("is_file"), "before"))
    return counted.filter("is_file = 0").drop("is_file")


def _settled(pairs: DataFrame) -> DataFrame:
    """How literal names like ``a-2`` push the numbering of ``a``: (keys, shift, skip_at).

    A row has either ``shift`` 1, where the group's plain name was already taken by its parent's numbering, or
    ``skip_at``, an arrival from which on one more number is skipped. What is decided in sequence goes number by
    number within a parent: a sibling keeps its name if it came before the parent's numbering reached it,
    which depends on the names kept before. All families are settled at once, a stretch of numbers after the
    other and parents before their siblings, so no array grows with a family.
    """
    trailing = F.regexp_extract("name_stem", f"((?:-(?:{_NUMBER}))*)$", 1)
    pairs = workspace.written(pairs.withColumn("level", F.size(F.split(trailing, "-"))), "name-pairs")
    steps = sorted(tuple(r) for r in pairs.select("level", "stretch").distinct().collect())
    settled = None
    for level, stretch in steps:
        part = pairs.filter((F.col("level") == level) & (F.col("stretch") == stretch))
        if settled is None:
            part = part.withColumns({"shifted": F.lit(0).cast("long"), "skipped": F.lit(0).cast("long")})
        else:
            known = settled.groupBy(*NAME_KEYS).agg(
                F.max("shift").cast("long").alias("shifted"), F.count("skip_at").alias("skipped"))
            part = part.join(known, NAME_KEYS, "left").fillna(0, ["shifted", "skipped"])
        done = workspace.written(_stretch(part), "names-settled")
        settled = done if settled is None else settled.unionByName(done)
    return settled


def _stretch(pairs: DataFrame) -> DataFrame:
    """``_settled`` of one stretch of siblings for each parent; ``skipped`` counts the names kept before."""
    row = "struct<name_stem: string, shift: int, skip_at: bigint>"
    acc_type = f"struct<skipped: bigint, found: array<{row}>>"

    def settle(acc: Column, pair: Column) -> Column:
        """A sibling that came first keeps its name; one that the numbering passed before loses it."""
        arrival = pair["number"] - acc["skipped"] - F.col("shifted")
        kept = pair["before"] < arrival
        told = F.struct(
            F.when(kept, F.col("name_stem")).otherwise(pair["sibling"]).alias("name_stem"),
            F.when(kept, 0).otherwise(1).alias("shift"), F.when(kept, arrival).alias("skip_at")).cast(row)
        # The numbering never gets to a sibling beyond the parent's last file.
        return F.when(arrival > F.col("parent_files"), acc).otherwise(F.struct(
            (acc["skipped"] + kept.cast("long")).alias("skipped"), F.array_append(acc["found"], told).alias("found")))

    gathered = pairs.groupBy(*NAME_KEYS, "parent_files", "shifted", "skipped").agg(
        F.array_sort(F.collect_list(F.struct("number", "before", "sibling"))).alias("pairs"))
    start = F.struct(F.col("skipped").alias("skipped"), F.array().alias("found")).cast(acc_type)
    folded = F.aggregate("pairs", start, lambda acc, pair: settle(acc, pair).cast(acc_type), lambda acc: acc["found"])
    return gathered.select("job_id", "ext", F.explode(folded).alias("f")).select("job_id", "ext", "f.*")


def _past_breaks(named: DataFrame, breaks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Arrivals moved on by the breaks that are not behind them, by a running count over both."""
    rows = named.withColumns({"_at": F.col("_number").cast("long"), "_skip": F.lit(0)}).unionByName(
        breaks.select(*NAME_KEYS, F.col("skip_at").alias("_at"), F.lit(1).alias("_skip")), allowMissingColumns=True)
    order = Window.partitionBy(*NAME_KEYS).orderBy("_at", F.desc("_skip")).rowsBetween(Window.unboundedPreceding, 0)
    large = large_keys(sizes, NAME_KEYS, "files")
    usual = rows if large is None else within(rows, large, NAME_KEYS, "left_anti")
    counted = usual.withColumn("_passed", F.sum("_skip").over(order))
    if large is not None:
        counted = counted.unionByName(bucketed_running_sum(
            within(rows, large, NAME_KEYS, "left_semi"), NAME_KEYS, F.floor(F.col("_at") / HOT),
            [F.col("_at"), F.desc("_skip")], F.col("_skip"), "_passed"))
    return counted.filter("_skip = 0").withColumn("_number", F.col("_number") + F.col("_passed")).drop("_at", "_skip", "_passed")


def _named_in_order(ready: DataFrame) -> DataFrame:
    """Member names of jobs that fit a task: one pass over the files of each job in file id order.

    Only the numbers and literal names of the job at hand are kept; other columns pass as they come.
    """
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, numbers, taken = None, {}, set()
        for batch in batches:
            out = []
            for owner, stem_, ext in zip(*(batch.column(c).to_pylist() for c in ("job_id", "name_stem", "ext"))):
                if owner != job:
                    job, numbers, taken = owner, {}, set()
                if stem_ is None:
                    out.append(None)
                    continue
                number = numbers.get((ext, stem_), 0) + 1
                told = stem_ if number == 1 else f"{stem_}-{number}"
                # Files without a job are no bundle, their names are counted only.
                while owner is not None and (ext, told) in taken:
                    number += 1
                    told = f"{stem_}-{number}"
                numbers[ext, stem_] = number
                taken.add((ext, told))
                out.append(told + ext)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("job_id", "file_id", "output_path")] + [pa.array(out, pa.string())],
                names=["job_id", "file_id", "output_path", "member_name"])

    rows = ready.repartition("job_id").sortWithinPartitions("job_id", "file_id", "name_stem", "ext", "output_path")
    schema = ready.select("job_id", "file_id", "output_path", F.lit(None).cast("string").alias("member_name")).schema
    return rows.mapInArrow(name, schema)


def bundle_names(files: DataFrame) -> DataFrame:
    """(job_id, file_id, output_path, member_name): names of each job's download bundle, in file id order.

    The first file of a name keeps it; later ones get the smallest free ``-n`` from 2. Jobs of more files than
    one task takes are known from a count; theirs are named by counting.
    """
    ready = workspace.written(files.filter(
        F.col("output_path").isNotNull() & (path_verdict(F.col("output_path")) == "contained")
    ).select("job_id", "file_id", "output_path", safe_name(stem(F.col("original_filename"))).alias("name_stem"),
             output_suffix(F.col("output_path")).alias("ext")), "bundle-files")
    large = large_keys(ready.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")), ["job_id"], "n")
    if large is None:
        return _named_in_order(ready)
    large = workspace.written(large, "large-bundles")
    return _named_in_order(within(ready, large, ["job_id"], "left_anti")).unionByName(
        _named_by_counting(workspace.written(within(ready, large, ["job_id"], "left_semi"), "large-bundle-files")))


def _named_by_counting(ready: DataFrame) -> DataFrame:
    """Member names of jobs of any size. Only names beside a literally numbered one that counting can reach need
    more than counting."""
    groups = workspace.written(
        ready.groupBy(*NAME_KEYS).agg(F.count(F.lit(1)).alias("files"), F.min("file_id").alias("first_id")), "bundle-names")
    named = sized_row_number(ready, NAME_KEYS, "file_id", "_number", groups, "files")
    settled = _settled(_placed(_sibling_pairs(groups), ready))
    if settled is not None:
        settled = workspace.written(settled, "names-moved")
        moved = settled.groupBy(*NAME_KEYS).agg(F.max("shift").alias("_shift"), F.count("skip_at").alias("_breaks"))
        named = workspace.written(named.join(moved, NAME_KEYS, "left").withColumn(
            "_number", F.col("_number") + F.coalesce("_shift", F.lit(0))).drop("_shift"), "bundle-arrivals")
        breaks = settled.filter("skip_at IS NOT NULL").join(
            moved.select(*NAME_KEYS, "_shift"), NAME_KEYS).withColumn("skip_at", F.col("skip_at") + F.col("_shift"))
        broken = named.filter("_breaks > 0").drop("_breaks")
        named = named.filter("_breaks IS NULL OR _breaks = 0").drop("_breaks").unionByName(_past_breaks(broken, breaks, groups))
    number = F.col("_number")
    name = F.when(number == 1, F.concat("name_stem", "ext")).otherwise(
        F.concat(F.col("name_stem"), F.lit("-"), number.cast("string"), F.col("ext")))
    return named.select("job_id", "file_id", "output_path", name.alias("member_name"))


def bundle_manifest(files: DataFrame) -> DataFrame:
    """Contents of each job's bundle: member name, source path, media type."""
    return with_media_type(bundle_names(files)).select(
        "job_id", "file_id", "member_name", "output_path", "media_type"
    )


# -- results, retries, limits -----------------------------------------------------------------


def merge_warnings(quality: Column, converter: Column) -> Column:
    """Quality warnings, then the converter's, first 50; NULL when there are none."""
    none = F.array().cast("array<string>")
    merged = F.concat(F.coalesce(quality, none), F.coalesce(converter, none))
    return F.when(F.size(merged) > 0, F.slice(merged, 1, MAX_WARNINGS))


RESULT_FIELDS = (
    "file_id", "job_id", "output_path", "converter", "target_format", "detected_mime", "pages",
    "size_bytes", "duration_seconds", "quality_score", "quality_level", "warnings",
)


def conversion_results(scored: DataFrame) -> DataFrame:
    """Result payload of each converted file, as JSON."""
    payload = F.to_json(F.struct(*RESULT_FIELDS), {"ignoreNullFields": "false"})
    return scored.select(*RESULT_FIELDS, payload.alias("payload"))


def retry_plan(events: DataFrame) -> DataFrame:
    """Failures with their repeat decision and delay; the random jitter is left out."""
    failures = events.filter(F.col("kind") == "fail")
    transient = lookups.retryable_errors(events.sparkSession).withColumn("transient", F.lit(True))
    joined = failures.join(F.broadcast(transient), "error_class", "left")
    retry = F.coalesce("transient", F.lit(False)) & (F.col("attempt") < lookups.MAX_RETRIES)
    delay = F.least(F.lit(lookups.MAX_BACKOFF_SECONDS), F.pow(F.lit(2), F.col("attempt")).cast("int"))
    return joined.select(
        "event_id", "file_id", "error_class", "attempt", retry.alias("retry"),
        F.when(retry, delay).alias("delay_seconds"),
    )


def time_limit_breaches(
    events: DataFrame, soft: int = SOFT_LIMIT_SECONDS, hard: int = HARD_LIMIT_SECONDS,
    ocr: int = OCR_LIMIT_SECONDS,
) -> DataFrame:
    """Runs (start directly followed by an end) that took longer than a limit.

    Text recognition has a limit of its own, which is reported where a run passed it.
    """
    looked = bucketed_lag(
        events.select("event_id", "ts", "file_id", "kind", "converter"), ["file_id"],
        F.date_trunc("minute", "ts"), ["ts", "event_id"], F.struct("kind", "ts"), "_before",
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_before.ts").cast("timestamp"))
    runs = looked.filter(
        F.col("kind").isin("complete", "fail") & (F.col("_before.kind") == "start")
    ).withColumn("run_micros", micros)
    return runs.filter(F.col("run_micros") > soft * 1_000_000).select(
        "file_id", "event_id", "kind", "run_micros",
        F.when((F.col("converter") == "ocr") & (F.col("run_micros") > ocr * 1_000_000), "ocr")
        .when(F.col("run_micros") > hard * 1_000_000, "hard").otherwise("soft").alias("limit"),
    )


def result_expiry(events: DataFrame, hours: int = RESULT_HOURS) -> DataFrame:
    """Results not older than a day, counted from the newest event."""
    newest = events.agg(F.max("ts").alias("ts")).scalar()
    results = events.filter(F.col("kind").isin("complete", "fail"))
    return results.filter(F.col("ts") >= newest - F.expr(f"INTERVAL '{hours}' HOUR"))
