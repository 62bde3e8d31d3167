"""Confidence score of a converted document: signals, penalties, band, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import patterns as P
from foliomill.functions.text import strip

# Floors, penalties and bands of the score.
SMALL_INPUT_BYTES = 20_000
SMALL_OUTPUT_CHARS = 200
STRUCTURE_CHARS = 2_000
SMALL_OUTPUT_PENALTY = 0.7
NO_HEADING_PENALTY = 0.2
REPLACEMENT_BASE, REPLACEMENT_STEP, REPLACEMENT_CAP = 0.1, 0.05, 0.4
HIGH, MEDIUM = 0.75, 0.45
REPLACEMENT_CHAR = "�"
EMPTY_MESSAGE = "Conversion produced no text content."
NO_HEADING_MESSAGE = "No headings detected — the document structure may have been lost."


def with_signals(
    df: DataFrame, markdown: str = "markdown", input_bytes: str = "input_bytes", pages: str = "pages"
) -> DataFrame:
    """Add ``chars``, ``heading_count`` and ``replacement_count``; settle ``pages`` and ``input_bytes``."""
    text = F.col(markdown)
    headings = F.when(
        F.contains(text, F.lit("#")), F.regexp_count(text, F.lit(P.lines(P.HEADING_START)))
    ).otherwise(0)
    without = F.replace(text, F.lit(REPLACEMENT_CHAR), F.lit(""))
    return df.withColumns({
        "input_bytes": F.col(input_bytes).cast("long"),
        "chars": F.length(strip(text)),
        "heading_count": headings,
        "replacement_count": F.length(text) - F.length(without),
        "pages": F.coalesce(F.col(pages), F.lit(0)).cast("int"),
    })


def _tiny() -> Column:
    return (F.col("input_bytes") >= SMALL_INPUT_BYTES) & (F.col("chars") < SMALL_OUTPUT_CHARS)


def _flat() -> Column:
    return (F.col("chars") >= STRUCTURE_CHARS) & (F.col("heading_count") == 0)


def _garbled() -> Column:
    return F.col("replacement_count") > 0


def _raw_score() -> Column:
    """Unrounded score in double arithmetic, penalties in their fixed order."""
    score = F.lit(1.0)
    score = score - F.when(_tiny(), F.lit(SMALL_OUTPUT_PENALTY)).otherwise(F.lit(0.0))
    score = score - F.when(_flat(), F.lit(NO_HEADING_PENALTY)).otherwise(F.lit(0.0))
    garbled = F.least(
        F.lit(REPLACEMENT_CAP),
        F.lit(REPLACEMENT_BASE) + F.lit(REPLACEMENT_STEP) * F.col("replacement_count").cast("double"),
    )
    score = score - F.when(_garbled(), garbled).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def with_score(df: DataFrame) -> DataFrame:
    """Add ``quality_score`` (3 decimals) and ``quality_level``; needs the signal columns."""
    raw, empty = F.col("_raw_score"), F.col("chars") == 0
    return df.withColumn("_raw_score", F.when(empty, 0.0).otherwise(_raw_score())).withColumns({
        "quality_score": F.round(raw, 3),
        "quality_level": F.when(empty, "low")
        .when(raw >= HIGH, "high").when(raw >= MEDIUM, "medium").otherwise("low"),
    }).drop("_raw_score")


def with_warnings(df: DataFrame) -> DataFrame:
    """Add ``quality_warnings``, an ordered string array; needs the signal columns."""
    tiny = F.concat(
        F.lit("Output is suspiciously small ("), F.col("chars").cast("string"),
        F.lit(" chars) for a "), F.expr("input_bytes div 1024").cast("string"),
        F.lit(" KB source — extraction may be incomplete."),
    )
    garbled = F.concat(
        F.col("replacement_count").cast("string"),
        F.lit(" replacement character(s) present — the source may have an encoding problem."),
    )
    messages = F.array_compact(F.array(
        F.when(_tiny(), tiny), F.when(_flat(), F.lit(NO_HEADING_MESSAGE)), F.when(_garbled(), garbled)
    ))
    return df.withColumn(
        "quality_warnings",
        F.when(F.col("chars") == 0, F.array(F.lit(EMPTY_MESSAGE))).otherwise(messages),
    )


def assess(df: DataFrame, markdown: str = "markdown", input_bytes: str = "input_bytes",
           pages: str = "pages") -> DataFrame:
    """Signals, score, band and warnings."""
    return with_warnings(with_score(with_signals(df, markdown, input_bytes, pages)))


def quality_report(scored: DataFrame) -> DataFrame:
    """Documents, mean score and mean percent by band."""
    return scored.groupBy("quality_level").agg(
        F.count(F.lit(1)).alias("documents"),
        F.round(F.avg("quality_score"), 6).alias("mean_score"),
        F.round(F.avg(F.round(F.col("quality_score") * 100)), 4).alias("mean_percent"),
        F.min("quality_score").alias("min_score"),
        F.max("quality_score").alias("max_score"),
    )


def skip_for_exports(df: DataFrame, target: str = "target_format") -> DataFrame:
    """Score and band only exist for conversions to Markdown."""
    importing = F.col(target) == "markdown"
    return df.withColumns({
        name: F.when(importing, F.col(name)) for name in ("quality_score", "quality_level")
    })


def conversion_report(files: DataFrame) -> DataFrame:
    """Outcome by converter."""
    return files.groupBy("converter_used").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.avg("size_bytes"), 4).alias("mean_size"),
        F.sum(F.coalesce(F.size("warnings"), F.lit(0)).cast("long")).alias("warnings"),
    )
