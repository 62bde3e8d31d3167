"""Markdown cleaning as twelve stacked projections.

Each stage rewrites one text column and adds its counters. Stages are separate projections,
never nested expressions, so the plan grows linearly. Rules that match an opening tag up to a
closing one only look at the text up to the last closing tag: an opener behind it can never
match, and skipping it keeps broken HTML with thousands of unclosed tags linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import patterns as P
from foliomill.functions.rewrite import (
    behind, complete_tags, count_matches, fence, if_contains, let, masked, replace_tags, rewrite_pairs, unmasked,
)
from foliomill.functions.text import strip, substitute

MEDIA_DIR = "media"
COUNTERS = (
    "svg_removed",
    "callouts_converted",
    "table_scaffold_removed",
    "quoted_blocks_converted",
    "xhtml_anchors_dropped",
    "external_anchors_converted",
    "other_anchors_stripped",
    "empty_spans_removed",
    "spans_removed",
    "orphan_span_tags_removed",
    "paragraphs_unwrapped",
    "divs_removed",
    "img_tags_converted",
    "residual_html_tags_removed",
    "image_paths_rewritten",
)


def strip_svg(df: DataFrame, column: str = "text") -> DataFrame:
    """Delete ``<svg>`` blocks."""
    pattern = P.java(P.SVG)
    return rewrite_pairs(df, column, P.closing("svg"), lambda t: F.regexp_replace(t, pattern, ""),
                  {"svg_removed": lambda t: count_matches(t, pattern)}, opener=P.starting("svg"))


def _paragraphs(cell: Column) -> Column:
    """Non-blank ``<p>`` bodies of a table cell, stripped."""
    bodies = F.regexp_extract_all(masked(cell, P.starting("p")), F.lit(P.java(P.PARAGRAPH)), F.lit(1))
    return F.filter(F.transform(bodies, lambda p: strip(unmasked(p, cell))), lambda p: p != "")


_CALLOUT_START = "^(?:" + "|".join(P.CALLOUT_EMOJIS) + ")"


def _is_callout(paragraphs: Column) -> Column:
    return F.coalesce(F.get(paragraphs, 0).rlike(_CALLOUT_START), F.lit(False))


def _callout_markdown(table: Column) -> Column:
    def markdown(paragraphs: Column) -> Column:
        following = F.slice(paragraphs, 2, F.greatest(F.size(paragraphs) - 1, F.lit(0)))
        quoted = F.concat(
            F.lit("> **"), F.get(paragraphs, 0), F.lit("**"),
            F.array_join(F.transform(following, lambda p: F.concat(F.lit("\n>\n> "), p)), ""),
            F.lit("\n"),
        )
        plain = F.concat(F.array_join(paragraphs, "\n\n"), F.lit("\n"))
        return (
            F.when(F.size(paragraphs) == 0, table)
            .when(_is_callout(paragraphs), quoted)
            .otherwise(plain)
        )

    return let(_paragraphs(F.regexp_extract(table, P.java(P.SINGLE_CELL), 1)), markdown)


def convert_callouts(df: DataFrame, column: str = "text") -> DataFrame:
    """Single-cell tables: emoji-led ones become block quotes, others plain paragraphs."""
    pattern = P.java(P.SINGLE_CELL)

    def converted(text: Column) -> Column:
        cells = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.size(F.filter(cells, lambda cell: _is_callout(_paragraphs(cell))))

    def without_stray_groups(text: Column) -> Column:
        """Column groups behind the last one that a cell follows are hidden: none of them can
        belong to a match, and each would be looked through to the end of the text."""
        groups = F.size(F.split(text, P.COLGROUP_START)) > 2
        useful = F.regexp_extract(text, P.java(f"^(.*{P.COLGROUP_END})"), 1)
        rest = behind(text, useful)
        hidden = F.concat(useful, F.regexp_replace(rest, P.COLGROUP_START, "\ue000colgroup"))
        return F.when(groups & ~F.contains(text, F.lit("\ue000")), hidden).otherwise(text)

    return rewrite_pairs(df, column, P.SINGLE_CELL_END,
                  lambda t: substitute(t, pattern, _callout_markdown),
                  {"callouts_converted": converted}, opener=P.starting("table"), prepare=without_stray_groups)


def strip_table_scaffold(df: DataFrame, column: str = "text") -> DataFrame:
    """Delete remaining table tags; a cell end becomes a line break."""
    return replace_tags(df, column,
                 [(P.TABLE_SCAFFOLD, ""), (P.CELL_OPEN, ""), (P.CELL_CLOSE, "\n")],
                 "table_scaffold_removed")


def convert_quoted_div(df: DataFrame, column: str = "text") -> DataFrame:
    """Quoted divisions: one block-quote line for each non-blank inner span."""
    pattern = P.java(P.QUOTED_DIV)

    def spans(body: Column) -> Column:
        found = F.regexp_extract_all(masked(body, P.starting("span")), F.lit(P.java(P.SPAN_PAIR)), F.lit(1))
        return F.filter(F.transform(found, lambda s: strip(unmasked(s, body))), lambda s: s != "")

    def quote(body: Column) -> Column:
        rows = F.transform(spans(body), lambda s: F.concat(F.lit("> "), s, F.lit("\n")))
        return F.array_join(rows, "")

    def converted(text: Column) -> Column:
        bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.size(F.filter(bodies, lambda body: F.size(spans(body)) > 0))

    return rewrite_pairs(df, column, P.closing("div"), lambda t: substitute(t, pattern, quote, 1),
                  {"quoted_blocks_converted": converted}, opener=P.starting("div"))


def rewrite_anchors(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop anchors into chapter files, turn web anchors into links, unwrap the others."""
    for name, pattern, replacement, start in (
        ("_xhtml_html", P.ANCHOR_XHTML, "$1", P.A_START),
        ("external_anchors_converted", P.ANCHOR_EXTERNAL, "[$2]($1)", P.A_START),
        ("other_anchors_stripped", P.ANCHOR_ANY, "$1", P.starting("a")),
    ):
        df = rewrite_pairs(
            df, column, P.closing("a"),
            lambda t, p=P.java(pattern), r=replacement: F.regexp_replace(t, p, r),
            {name: lambda t, p=P.java(pattern): count_matches(t, p)}, opener=start,
        )
    text = F.col(column)
    return df.withColumns({
        column: if_contains(text, ".xhtml", F.regexp_replace(text, P.MD_LINK_XHTML, "$1"), text),
        "xhtml_anchors_dropped": F.col("_xhtml_html")
        + if_contains(text, ".xhtml", count_matches(text, P.MD_LINK_XHTML), F.lit(0)),
    }).drop("_xhtml_html")


def strip_spans(df: DataFrame, column: str = "text") -> DataFrame:
    """Delete empty spans, then unwrap nested ones, then delete unpaired tags.

    All span tags go in one pass; how many of them were pairs follows from a fold over the tag
    sequence. Only where deleting a tag spells a new one (``<sp<span>an>``) are pairs really
    unwrapped round by round.
    """
    any_tag, pair = P.java(P.SPAN_TAG), P.java(P.SPAN_PAIR)
    text = F.col(column)
    empty = P.java(P.SPAN_EMPTY)
    df = rewrite_pairs(df, column, P.closing("span"), lambda t: F.regexp_replace(t, empty, ""),
                  {"empty_spans_removed": lambda t: count_matches(t, empty)}, opener=P.starting("span"))
    df = df.withColumn("_complete", if_contains(text, "<", complete_tags(text), F.lit("")))
    df = df.withColumn(
        "_span_tags",
        F.when(F.col("_complete") != "", F.regexp_extract_all("_complete", F.lit(any_tag), F.lit(0)))
        .otherwise(F.array().cast("array<string>")),
    )
    tags = F.col("_span_tags")
    df = df.withColumn("_bare", F.when(F.size(tags) == 0, text).otherwise(F.concat(
        F.regexp_replace("_complete", any_tag, ""), behind(text, F.col("_complete")))))

    def fold(acc: Column, one: Column) -> Column:
        closes = F.startswith(one, F.lit("</"))
        pairs_up = closes & (acc["open"] > 0)
        return F.struct(
            F.when(pairs_up, acc["open"] - 1).when(closes, acc["open"])
            .otherwise(acc["open"] + 1).alias("open"),
            (acc["pairs"] + pairs_up.cast("int")).alias("pairs"),
        )

    pairs = F.aggregate(
        tags, F.struct(F.lit(0).alias("open"), F.lit(0).alias("pairs")), fold, lambda a: a["pairs"]
    )

    def unwrap(acc: Column, _: Column) -> Column:
        n = count_matches(acc["text"], pair)
        return F.when(n == 0, acc).otherwise(F.struct(
            F.regexp_replace(acc["text"], pair, "$1").alias("text"),
            (acc["pairs"] + n).alias("pairs"),
        ))

    rounds = F.sequence(F.lit(1), F.length(text) - F.length(F.replace(text, F.lit("<"))) + 1)
    opened, closed = P.java(P.opening("span")), P.java(P.closing("span"))
    stepwise = F.aggregate(
        rounds, F.struct(text.alias("text"), F.lit(0).alias("pairs")), unwrap,
        lambda a: F.struct(
            F.regexp_replace(F.regexp_replace(a["text"], opened, ""), closed, "").alias("text"),
            a["pairs"].alias("pairs"),
            (count_matches(a["text"], opened)
             + count_matches(F.regexp_replace(a["text"], opened, ""), closed)).alias("orphans"),
        ),
    )
    in_one_pass = F.struct(
        F.col("_bare").alias("text"), pairs.alias("pairs"),
        (F.size(tags) - 2 * pairs).alias("orphans"),
    )
    respelled = (F.size(tags) > 0) & complete_tags(F.col("_bare")).rlike(any_tag)
    df = df.withColumn("_spans", F.when(respelled, stepwise).otherwise(in_one_pass))
    return df.withColumns({
        column: F.col("_spans.text"),
        "spans_removed": F.col("_spans.pairs"),
        "orphan_span_tags_removed": F.col("_spans.orphans"),
    }).drop("_complete", "_span_tags", "_bare", "_spans")


def unwrap_paragraphs(df: DataFrame, column: str = "text") -> DataFrame:
    """``<p>x</p>`` becomes ``x`` and a blank line; blank paragraphs vanish."""
    pattern = P.java(P.PARAGRAPH)

    def paragraph(body: Column) -> Column:
        inner = strip(body)
        return F.when(inner == "", "").otherwise(F.concat(inner, F.lit("\n\n")))

    return rewrite_pairs(df, column, P.closing("p"), lambda t: substitute(t, pattern, paragraph, 1),
                  {"paragraphs_unwrapped": lambda t: count_matches(t, pattern)}, opener=P.starting("p"))


def strip_divs(df: DataFrame, column: str = "text") -> DataFrame:
    """Delete every division tag.

    Opening tags go first: deleting one may spell a new closing tag, not the reverse.
    """
    opened, closed = P.opening("div"), P.closing("div")
    df = replace_tags(df, column, [(opened, "")], "_opened")
    df = replace_tags(df, column, [(closed, "")], "_closed")
    return df.withColumn("divs_removed", F.col("_opened") + F.col("_closed")).drop("_opened", "_closed")


def convert_img_tags(df: DataFrame, column: str = "text", where: Column | None = None) -> DataFrame:
    """``<img>`` becomes a Markdown image, or nothing without a source; ``where`` tells which texts need be looked at."""
    pattern, src, alt = P.java(P.IMG), P.java(P.IMG_SRC), P.java(P.IMG_ALT)
    text = F.col(column)

    def image(attrs: Column) -> Column:
        target = F.regexp_extract(attrs, src, 1)
        return F.when(target == "", "").otherwise(
            F.concat(F.lit("!["), F.regexp_extract(attrs, alt, 1), F.lit("]("), target, F.lit(")"))
        )

    found = F.contains(text, F.lit("<"))
    df = df.withColumn("_complete", F.when(
        found if where is None else where & found, complete_tags(text)).otherwise(F.lit("")))
    df = df.withColumn("_attrs", F.when(F.col("_complete") != "", F.regexp_extract_all(
        "_complete", F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>")))
    return df.withColumns({
        column: F.when(F.size("_attrs") == 0, text).otherwise(F.concat(
            substitute(F.col("_complete"), pattern, image, 1),
            behind(text, F.col("_complete")))),
        "img_tags_converted": F.size(F.filter("_attrs", lambda a: a.rlike(src))),
    }).drop("_complete", "_attrs")


def strip_residual_html(df: DataFrame, column: str = "text") -> DataFrame:
    """Map breaks, rules and emphasis to Markdown and delete other wrapper tags."""
    df = replace_tags(df, column, [
        (P.BR, "\n"), (P.HR, "\n\n---\n\n"), (P.STRONG, "**"), (P.EMPHASIS, "*"), (P.CODE, "`"),
    ])
    return replace_tags(df, column, [(P.RESIDUAL, "")], "residual_html_tags_removed")


def _first_most_frequent(names: Column) -> Column:
    """Most frequent element, earliest seen on ties, by one fold over the sorted array."""
    indexed = F.array_sort(
        F.transform(names, lambda name, i: F.struct(name.alias("name"), i.alias("at")))
    )
    start = F.struct(
        F.lit(None).cast("string").alias("name"), F.lit(0).alias("first"), F.lit(0).alias("run"),
        F.lit(None).cast("string").alias("best"), F.lit(0).alias("best_first"),
        F.lit(0).alias("best_run"),
    )

    def fold(acc: Column, one: Column) -> Column:
        same = one["name"].eqNullSafe(acc["name"])
        run = F.when(same, acc["run"] + 1).otherwise(1)
        first = F.when(same, acc["first"]).otherwise(one["at"])
        wins = (run > acc["best_run"]) | ((run == acc["best_run"]) & (first < acc["best_first"]))
        return F.struct(
            one["name"].alias("name"), first.alias("first"), run.alias("run"),
            F.when(wins, one["name"]).otherwise(acc["best"]).alias("best"),
            F.when(wins, first).otherwise(acc["best_first"]).alias("best_first"),
            F.when(wins, run).otherwise(acc["best_run"]).alias("best_run"),
        )

    return F.aggregate(indexed, start, fold, lambda acc: acc["best"])


def rewrite_image_paths(df: DataFrame, column: str = "text", media_dir: str = MEDIA_DIR) -> DataFrame:
    """Flatten ``…/<x>_media/<file>`` to ``<media_dir>/<file>`` and vote for the old folder."""
    pattern = P.java(P.MEDIA_PATH_ANCHORED)
    text = F.col(column)
    # No match begins before the word of the first folder, so what is before it is not searched.
    df = df.withColumn("_at", F.regexp_instr(text, F.lit(P.any_case("_media/"))))
    df = df.withColumn("_before", F.when(F.col("_at") > 0, F.regexp_extract(
        F.substring(text, F.lit(1), F.col("_at") - 1), P.java(f"^(.*{P.WORD_END})"), 1)))
    df = df.withColumn("_words", behind(text, F.col("_before")))
    df = df.withColumn("_dirs", F.when(F.col("_at") > 0, F.regexp_extract_all("_words", F.lit(pattern), F.lit(2))).otherwise(
        F.array().cast("array<string>")))
    replacement = media_dir.replace("\\", "\\\\").replace("$", "\\$") + "/$3"
    voted = F.when(F.size("_dirs") > 0, _first_most_frequent(F.col("_dirs")))
    return df.withColumns({
        column: F.when(F.size("_dirs") == 0, text)
        .otherwise(F.concat("_before", F.regexp_replace("_words", pattern, replacement))),
        "image_paths_rewritten": F.size("_dirs"),
        "media_dir_old": F.when(voted != media_dir, voted),
    }).drop("_at", "_before", "_words", "_dirs")


def normalise_whitespace(df: DataFrame, column: str = "text") -> DataFrame:
    """Trim line ends, collapse blank runs, strip, end with one newline."""
    text = F.col(column)
    squeezed = F.regexp_replace(F.regexp_replace(text, P.TRAILING_BLANKS, ""), P.BLANK_RUN, "\n\n")
    return df.withColumn(column, F.concat(strip(squeezed), F.lit("\n")))


STAGES: tuple[Callable[..., DataFrame], ...] = (
    strip_svg,
    convert_callouts,
    strip_table_scaffold,
    convert_quoted_div,
    rewrite_anchors,
    strip_spans,
    unwrap_paragraphs,
    strip_divs,
    convert_img_tags,
    strip_residual_html,
    rewrite_image_paths,
    normalise_whitespace,
)


def clean_corpus(
    df: DataFrame, column: str = "text", media_dir: str = MEDIA_DIR, where: Column | str | None = None
) -> DataFrame:
    """All stages in their fixed order; adds the counters, ``media_dir_old`` and ``media_dir_new``.

    ``where`` is a condition on other columns, such as an id; it is applied before the stages and
    so reaches the scan, which later filters do not.
    """
    if where is not None:
        df = df.filter(where)
    for stage in STAGES:
        df = stage(df, column, media_dir) if stage is rewrite_image_paths else stage(df, column)
    return fence(df.withColumn(
        "media_dir_new", F.when(F.col("media_dir_old").isNotNull(), F.lit(media_dir))
    ))


def clean_stats_report(cleaned: DataFrame) -> DataFrame:
    """Corpus totals of every counter."""
    return cleaned.agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.sum(F.col(name).cast("long")).alias(name) for name in COUNTERS],
    )


def media_rename_plan(cleaned: DataFrame, job: str = "job_id", file: str = "file_id") -> DataFrame:
    """Folder renames by document, flagged where several documents of a job want the same one."""
    renames = cleaned.filter(F.col("media_dir_old").isNotNull()).select(
        job, file, "media_dir_old", "media_dir_new"
    )
    wanted = renames.groupBy(job).agg(F.count(F.lit(1)).alias("_wanting"))
    return renames.join(wanted, job).select(
        job, file, "media_dir_old", "media_dir_new",
        (F.col("_wanting") > 1).alias("collision"),
    )


# Markup that must be gone from cleaned text.
FORBIDDEN = P.either(
    "svg|span|div|table|tbody|thead|tfoot|tr|td|th|colgroup|col|caption|br|hr|strong|b|em|i|code|"
    + P.RESIDUAL_NAMES
)


def residual_html_audit(cleaned: DataFrame, column: str = "text") -> DataFrame:
    """Documents whose cleaned text still holds a tag the cleaner covers."""
    return cleaned.filter(F.col(column).rlike(P.java(FORBIDDEN)))
