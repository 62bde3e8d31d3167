"""Which converter handles a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.sources import lookups

SAMPLE_PAGES = 8
PAGE_THRESHOLD = 1e-4
MIN_TEXT_PAGE_RATIO = 0.4


def pdf_sample_plan(page_counts: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Page numbers to look at, spread evenly over each document: (pdf_id, page_count, page_no).

    Positions round half to even, hence ``rint``.
    """
    n = F.col("page_count")
    k = F.least(F.lit(sample_pages).cast("long"), n)
    step = (n - 1).cast("double") / (k - 1).cast("double")
    spread = F.array_distinct(
        F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.rint(i * step).cast("long"))
    )
    first = F.array(F.lit(0).cast("long"))
    return page_counts.filter(n > 0).select(
        "pdf_id", "page_count", F.explode(F.when(k == 1, first).otherwise(spread)).alias("page_no")
    )


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("pdf_id").agg(F.count(F.lit(1)).alias("page_count"))


def pdf_flavour(
    pages: DataFrame,
    *,
    sample_pages: int = SAMPLE_PAGES,
    threshold: float = PAGE_THRESHOLD,
    min_text_page_ratio: float = MIN_TEXT_PAGE_RATIO,
) -> DataFrame:
    """Text or scan, by the share of sampled pages that carry text.

    The join is on document and page, so a document with very many pages stays spread out.
    """
    plan = pdf_sample_plan(page_counts(pages), sample_pages).drop("page_count")
    sampled = plan.join(
        pages.select("pdf_id", F.col("page_no").cast("long").alias("page_no"), "chars",
                     (F.col("width") * F.col("height")).alias("pixels")),
        ["pdf_id", "page_no"], "left",
    )
    is_text = F.when(F.col("pixels") > 0, F.col("chars") / F.col("pixels") >= threshold)
    votes = sampled.groupBy("pdf_id").agg(
        F.count(F.lit(1)).alias("sampled_pages"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("_chars"),
        F.coalesce(F.sum("pixels"), F.lit(0.0)).alias("_pixels"),
        F.count_if(is_text).alias("_text_pages"),
    )
    seen = F.col("_pixels") > 0
    ratio = F.col("_text_pages") / F.col("sampled_pages")
    return votes.select(
        "pdf_id",
        F.when(~seen, "unknown").when(ratio >= min_text_page_ratio, "text_native")
        .otherwise("scanned").alias("flavour"),
        "sampled_pages",
        F.when(seen, F.col("_chars") / F.col("_pixels")).alias("char_pixel_ratio"),
        F.when(seen, ratio).alias("text_page_ratio"),
    )


def route_files(validated: DataFrame) -> DataFrame:
    """Add target, converter or routing error to validated files.

    Reads ``extension`` and, if present, ``flavour`` (PDF vote) and ``override`` (wanted converter).
    """
    spark = validated.sparkSession
    for column in ("flavour", "override"):
        if column not in validated.columns:
            validated = validated.withColumn(column, F.lit(None).cast("string"))
    keyed = validated.withColumn(
        "_flavour",
        F.when(F.col("extension") == ".pdf", F.coalesce("flavour", F.lit("unknown"))).otherwise("any"),
    )
    routes = lookups.routes(spark).withColumnRenamed("flavour", "_flavour")
    routed = keyed.join(F.broadcast(routes), ["extension", "_flavour"], "left").withColumn(
        "converter_name", F.coalesce("override", "default_converter")
    )
    routed = routed.join(F.broadcast(lookups.registry(spark)), "converter_name", "left")
    error = (
        F.when(F.col("target").isNull(), F.concat(
            F.lit("no target format for extension '"), "extension", F.lit("'")))
        .when(F.col("supports").isNull(), F.concat(
            F.lit("converter '"), "converter_name", F.lit("' is not registered (target_format="),
            "target", F.lit(")")))
        .when(~F.array_contains("supports", F.col("extension")), F.concat(
            F.lit("converter '"), "converter_name", F.lit("' does not support '"), "extension",
            F.lit("' files")))
    )
    return routed.withColumn(
        "route_error", F.concat(F.lit("FormatNotSupportedError: "), error)
    ).drop("_flavour", "default_converter", "supports")


def route_export(jobs: DataFrame) -> DataFrame:
    """Export converter of each job, or an error for unknown targets."""
    registry = lookups.registry(jobs.sparkSession).select("converter_name")
    named = jobs.withColumn("_wanted", F.concat(F.lit("export-"), "target_format"))
    routed = named.join(F.broadcast(registry), F.col("_wanted") == F.col("converter_name"), "left")
    return routed.withColumn("route_error", F.when(
        F.col("converter_name").isNull(),
        F.concat(F.lit("FormatNotSupportedError: unsupported export target '"), "target_format",
                 F.lit("'")),
    )).drop("_wanted")
