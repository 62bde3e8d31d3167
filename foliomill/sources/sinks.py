"""Writing converted documents, files, verdicts; deleting from stored tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.text import safe_name, stem

BUCKETS = 64
PACKED = "zstd"  # hex digits and paths, most of these rows, take half of what Snappy makes of them
NAME_PIECE = 200  # file systems take names of 255 bytes
FILES_A_FOLDER = 10_000


def with_output_name(converted: DataFrame) -> DataFrame:
    """Add ``output_name``: a name derived from the file id, and the job's output folder."""
    name = F.concat(
        F.md5(F.col("file_id").cast("string").cast("binary")), F.lit("_"),
        safe_name(stem(F.col("original_filename"))), F.lit(".md"),
    )
    return converted.withColumn("output_name", name).withColumn(
        "output_path",
        F.concat(F.lit("output/"), F.col("job_id").cast("string"), F.lit("/"), F.col("output_name")),
    )


def job_bucket(buckets: int = BUCKETS) -> Column:
    """The bucket that a job's rows are stored in."""
    return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")


def write_markdown(converted: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Store documents, the rows of a job in one folder of ``job_bucket``.

    Jobs have at most a few dozen files, so a folder for each job would mean millions of tiny
    files; a fixed number of job buckets keeps reads by job pruned. The rebalance hint lets
    adaptive execution merge small buckets' tasks and split a bucket with a very large job.
    """
    write_by_job(with_output_name(converted), folder, buckets)


def write_by_job(rows: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Store rows of jobs by ``job_bucket``."""
    bucketed = rows.withColumn("job_bucket", job_bucket(buckets))
    bucketed.hint("rebalance", "job_bucket").write.option("compression", PACKED).partitionBy("job_bucket").parquet(folder)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A written table, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def delete_jobs(spark: SparkSession, folder: str, deleted: DataFrame, staging: str, buckets: int = BUCKETS) -> list[int]:
    """Delete the rows of the given jobs from a table that ``write_by_job`` stored; which buckets were rewritten.

    Only buckets that hold a deleted job are read and replaced; the files of all others stay. What remains of
    them is first written to ``staging``, a folder that belongs to this deletion. If the job stops at any point,
    calling it again with the same folder goes on: before the staging is complete the table is untouched, and
    after that it is not read again, so buckets that were replaced already are replaced by the same rows.
    """
    done = _stored(spark, f"{staging}/complete")
    if done is None:
        gone = deleted.select("job_id").distinct().withColumn("job_bucket", job_bucket(buckets))
        table = spark.read.parquet(folder)
        schema = table.schema
        # At most one number for each bucket.
        asked = [r.job_bucket for r in gone.select("job_bucket").distinct().collect()]
        held = table.filter(F.col("job_bucket").isin(asked)).select("job_id", "job_bucket")
        touched = sorted(r.job_bucket for r in held.join(gone.select("job_id"), "job_id", "left_semi").select(
            "job_bucket").distinct().collect()) if asked else []
        rest = table.filter(F.col("job_bucket").isin(touched)).join(gone.select("job_id"), "job_id", "left_anti")
        rest.select(*schema.names).write.mode("overwrite").option("compression", PACKED).parquet(f"{staging}/rest")
        spark.createDataFrame([(b,) for b in touched], "job_bucket int").write.mode("overwrite").parquet(f"{staging}/complete")
        done = spark.read.parquet(f"{staging}/complete")
    touched = sorted(r.job_bucket for r in done.collect())
    rest = spark.read.parquet(f"{staging}/rest")
    left = {r.job_bucket for r in rest.select("job_bucket").distinct().collect()}
    rest.hint("rebalance", "job_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", PACKED).partitionBy("job_bucket").parquet(folder)
    # A dynamic overwrite leaves partitions alone that no row is written to.
    for bucket in touched:
        if bucket not in left:
            rest.drop("job_bucket").limit(0).write.mode("overwrite").parquet(f"{folder}/job_bucket={bucket}")
    return touched


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds a folder, and the folder's name in it, for a task's own reading and writing."""
    place = re.sub("^file:/+", "/", folder)
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


def write_files(rows: DataFrame, folder: str, path: str, content: str) -> None:
    """One file for each row below a folder, named by the row's path; the content is text.

    A task writes its rows' files to one folder, which gets its final name once all of them are there: a task
    that is repeated leaves nothing twice, and there are as many folders as tasks, not as files. The tasks write
    to the folder themselves, so it must be one that Python's Arrow can open on every executor. Names are hex
    digits, behind the row's number, in folders that can be listed one by one. A line break ends every file, so that
    empty ones are listed too: Spark lists no file of zero bytes. ``manifest.stored_files`` reads the folder,
    ``manifest.stored_paths`` lists it.
    """
    named = rows.select(F.col(path).cast("string").alias("path"), F.col(content).cast("string").alias("value"))

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        files, root = opened(folder)
        target, started = f"{root}/part-{task.partitionId()}", f"{root}/.part-{uuid.uuid4().hex}"
        written = 0
        for batch in batches:
            for name, value in zip(batch["path"], batch["value"]):
                # A name is cut into folders where it is longer than a file system takes.
                digits = (name or "").encode().hex()
                pieces = [digits[at:at + NAME_PIECE] for at in range(0, len(digits), NAME_PIECE)] or [""]
                at = "/".join([f"{started}/{written // FILES_A_FOLDER}/{written}-{pieces[0]}", *pieces[1:]])
                if written % FILES_A_FOLDER == 0 or pieces[1:]:
                    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(at) as out:
                    out.write((value or "").encode() + b"\n")
                written += 1
        if written:
            if files.get_file_info(target).type == fs.FileType.NotFound:
                files.move(started, target)
            else:
                files.delete_dir(started)
        yield pd.DataFrame({"files": [written]})

    # Known to the reader even if there is no row.
    spark = rows.sparkSession
    spark.range(0).select(F.lit("").alias("value")).write.text(folder)
    named.mapInPandas(store, "files long").write.format("noop").mode("overwrite").save()


def write_validated(validated: DataFrame, folder: str, batch: int) -> None:
    """Accepted and rejected files of a batch, split by ``accepted``, in one pass over the contents.

    A batch has a folder of its own, which a repeated batch writes anew: nothing is added twice.
    ``read_validated`` reads either side over all batches.
    """
    told = validated.withColumns({
        "accepted": F.col("error_class").isNull(),
        "error": F.when(F.col("error_class").isNotNull(), F.concat_ws(": ", "error_class", "error_message")),
    })
    told.write.mode("overwrite").partitionBy("accepted").parquet(f"{folder}/batch={batch}")


def read_validated(spark: SparkSession, folder: str, accepted: bool) -> DataFrame:
    """The accepted or the rejected files of all batches; only their folders are read."""
    return spark.read.parquet(folder).filter(F.col("accepted") == accepted).drop("accepted")
