"""Outlines, titles, media references and links of Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import patterns as P
from foliomill.functions.rewrite import count_matches, if_contains
from foliomill.functions.text import slug, strip


def heading_outline(df: DataFrame, markdown: str, *keys: str) -> DataFrame:
    """One row for each heading: position from 1, level, text."""
    pattern = F.lit(P.lines(P.HEADING_LINE))
    text = F.col(markdown)
    found = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("marks"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("heading"),
    )
    rows = df.filter(F.contains(text, F.lit("#"))).select(
        *keys, F.posexplode(found).alias("at", "item")
    )
    return rows.select(
        *keys,
        (F.col("at") + 1).alias("position"),
        F.length("item.marks").alias("level"),
        F.col("item.heading").alias("heading"),
    )


def heading_slugs(outline: DataFrame) -> DataFrame:
    """Add a URL slug to each heading of an outline."""
    return outline.withColumn("slug", slug(F.col("heading")))


def document_title(markdown: Column, fallback: Column) -> Column:
    """Text of the first top-level heading, else ``fallback``."""
    title = strip(F.regexp_extract(markdown, P.lines(P.TITLE_LINE), 1))
    return F.when(title == "", fallback).otherwise(title)


def media_references(df: DataFrame, text: str, *keys: str, media_dir: str = "media") -> DataFrame:
    """One row for each media reference: old folder, file, new path."""
    pattern = F.lit(P.java(P.MEDIA_PATH_ANCHORED))
    body = F.col(text)
    found = F.arrays_zip(
        F.regexp_extract_all(body, pattern, F.lit(2)).alias("folder"),
        F.regexp_extract_all(body, pattern, F.lit(3)).alias("file"),
    )
    rows = df.filter(body.rlike(P.any_case("_media/"))).select(
        *keys, F.posexplode(found).alias("at", "item")
    )
    return rows.select(
        *keys,
        (F.col("at") + 1).alias("position"),
        F.col("item.folder").alias("media_folder"),
        F.col("item.file").alias("media_file"),
        F.concat(F.lit(media_dir + "/"), F.col("item.file")).alias("new_path"),
    )


def link_inventory(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Links by document and kind: internal chapter anchors, web links, other anchors.

    A link counts for the first kind that fits, so each kind is looked for in what the ones
    before it left.
    """
    body = F.col("_links")
    df = df.select(*keys, F.col(text).alias("_links"))
    for kind, pattern in (
        ("internal", P.ANCHOR_XHTML), ("external", P.ANCHOR_EXTERNAL), ("other", P.ANCHOR_ANY)
    ):
        inner = "$2" if kind == "external" else "$1"
        df = df.withColumns({
            kind: if_contains(body, "</", count_matches(body, P.java(pattern)), F.lit(0)),
            "_links": if_contains(body, "</", F.regexp_replace(body, P.java(pattern), inner), body),
        })
    markdown = if_contains(body, ".xhtml", count_matches(body, P.MD_LINK_XHTML), F.lit(0))
    rows = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), n.alias("links"))
        for kind, n in (
            ("internal", F.col("internal") + markdown), ("external", F.col("external")),
            ("other", F.col("other")),
        )
    ])).alias("item"))
    return rows.select(*keys, "item.kind", "item.links").filter(F.col("links") > 0)
