"""Constraint and integrity audits over jobs and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.operators.lifecycle import job_progress, job_status
from foliomill.sources import lookups

# The domains of the stored columns.
JOB_STATUSES = ("pending", "processing", "done", "failed", "partial_success")
FILE_STATUSES = ("pending", "processing", "done", "failed")
QUALITY_LEVELS = ("high", "medium", "low")


def _broken(df: DataFrame, id_column: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, id) for each broken rule, all rules in one pass over the table."""
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(
        F.explode(hits).alias("rule"), F.col(id_column).cast("string").alias("row_id")
    )


def domain_violations(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Values outside their domain and NULLs in required columns."""
    job_rules = {
        "job_status": ~F.col("stored_status").isin(*JOB_STATUSES),
        "target_format": ~F.col("target_format").isin(*lookups.TARGET_FORMATS),
        "job_status_missing": F.col("stored_status").isNull(),
        "target_format_missing": F.col("target_format").isNull(),
    }
    file_rules = {
        "file_status": ~F.col("status").isin(*FILE_STATUSES),
        "quality_level": ~F.col("quality_level").isin(*QUALITY_LEVELS),
        "quality_score": (F.col("quality_score") < 0) | (F.col("quality_score") > 1),
        "size_bytes": F.col("size_bytes") < 0,
        "pages": F.col("pages") < 0,
        "job_id_missing": F.col("job_id").isNull(),
        "original_filename_missing": F.col("original_filename").isNull(),
        "stored_filename_missing": F.col("stored_filename").isNull(),
        "original_format_missing": F.col("original_format").isNull(),
        "storage_path_missing": F.col("storage_path").isNull(),
    }
    return _broken(jobs, "job_id", job_rules).unionByName(_broken(files, "file_id", file_rules))


def orphan_files(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files whose job does not exist."""
    return files.join(jobs.select("job_id"), "job_id", "left_anti")


def jobs_without_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs without a single file."""
    return jobs.join(files.groupBy("job_id").agg(F.count(F.lit(1))), "job_id", "left_anti")


def counter_drift(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs whose stored status or counters disagree with their files.

    ``jobs`` has ``stored_status``, ``total_files`` and ``processed_files`` as stored.
    """
    counts = files.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("actual_files"))
    stored = jobs.withColumnRenamed("processed_files", "stored_processed")
    current = job_progress(job_status(stored, files)).join(counts, "job_id", "left").fillna(
        0, ["actual_files"]
    )
    checks = {
        "status": F.col("stored_status").eqNullSafe(F.col("status")),
        "total": F.col("total_files").eqNullSafe(F.col("actual_files")),
        "processed": F.coalesce("stored_processed", F.lit(0)).eqNullSafe(F.col("processed_files")),
    }
    drifted = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return current.withColumn("drift", F.concat_ws(",", drifted)).filter(
        ~reduce(lambda a, b: a & b, checks.values())
    ).select("job_id", "stored_status", "status", "total_files", "actual_files",
             F.coalesce("stored_processed", F.lit(0)).alias("stored_processed"),
             "processed_files", "drift")


def unreferenced_outputs(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Stored files no row points to, and paths rows point to that are not stored."""
    referenced = files.select(F.explode(F.array("storage_path", "output_path")).alias("path")).filter(
        F.col("path").isNotNull()
    ).groupBy("path").agg(F.lit(True).alias("_referenced"))
    stored = listing.groupBy("path").agg(F.lit(True).alias("_stored"))
    return stored.join(referenced, "path", "full_outer").filter(
        F.col("_stored").isNull() | F.col("_referenced").isNull()
    ).select("path", F.when(F.col("_stored").isNull(), "missing").otherwise("unreferenced").alias("finding"))
