"""Text and HTML to Markdown, as projections over a document table."""

from __future__ import annotations

import json
import zlib
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import patterns as P
from foliomill.functions.rewrite import (
    fence, has_tag, if_contains, masked, matchable, replace_tags, rewrite_pairs, squeeze, tag_names,
)
from foliomill.functions.text import LINE_BREAK, SPACE, strip, substitute
from foliomill.operators import blocks, clean

BLOCK_NAMES = (
    "p|div|article|section|header|footer|main|nav|aside|ul|ol|dl|dd|dt|table|thead|tbody|tfoot|"
    "tr|td|th|caption|figure|figcaption|form|address|body|html|head"
)
BLOCK_TAG = P.either(BLOCK_NAMES)
# A target in double, single or no quotes.
LINK = (
    f"<{P.any_case('a')}[{SPACE}](?:[^>]*[{SPACE}\"'/])?{P.any_case('href')}[{SPACE}]*=[{SPACE}]*"
    + f"(?:\"([^\"]*)\"|'([^']*)'|([^{SPACE}\"'>]+))[^>]*>(.*?)" + P.closing("a")
)
TITLE = P.opening("title") + "(.*?)" + P.closing("title")
OTHER_TAG = "</?[A-Za-z][^>]*>|<![^>]*>"
ENTITY = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


_SHELVES = 256  # of the table of entities: looking a name up reads one shelf


def _entity_table() -> Column:
    """Characters by entity name in shelves by the name's checksum: all names of HTML 5 that end with a
    semicolon, and the numbers that browsers read as Windows-1252. Made from the standard library's tables."""
    chars = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
    for code in range(0x80, 0xA0):
        char = bytes([code]).decode("cp1252", "ignore")
        if char:
            chars[f"#{code}"] = char
    shelves: list[dict[str, str]] = [{} for _ in range(_SHELVES)]
    for name, char in chars.items():
        shelves[zlib.crc32(name.encode()) % _SHELVES][name] = char
    return F.from_json(F.lit(json.dumps(shelves)), "array<map<string, string>>")


def _entity(name: Column) -> Column:
    """Character of an entity without ``&`` and ``;``; unknown names stay as they were written."""
    digits = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(
        F.substring(name, 2, 7))
    code = digits.try_cast("int")
    usable = code.isNotNull() & (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    key = F.when(F.startswith(name, F.lit("#")), F.concat(F.lit("#"), code.cast("string"))).otherwise(name)
    return F.coalesce(
        F.try_element_at(F.get(_entity_table(), (F.crc32(key.cast("binary")) % _SHELVES).cast("int")), key),
        F.when(F.startswith(name, F.lit("#")), F.when(usable, char).otherwise("\ufffd")),
        F.concat(F.lit("&"), name, F.lit(";")),
    )


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, in one pass, so nothing is decoded twice."""
    return if_contains(text, "&", substitute(text, ENTITY, _entity, 1), text)


def html_to_markdown(
    df: DataFrame, html: str = "html", into: str = "markdown", where: Column | str | None = None
) -> DataFrame:
    """Visible text of an HTML column as Markdown in ``into``, and its ``title``.

    Scripts, styles and comments go first: they may hold text that looks like tags. Nested blocks are
    marked and, once all other tags are gone, written by one fold (``blocks``); texts without them skip it.
    ``where`` is a condition on other columns; applied first, it reaches the scan, which later filters do not.
    """
    if where is not None:
        df = df.filter(where)
    text, names = F.col(into), F.col("_names")

    def has(*wanted: str) -> Column:
        return has_tag(names, *wanted)

    def named(df: DataFrame, changed: Column) -> DataFrame:
        """Names anew where a rule may have left nothing in a tag's place, so that what is around it makes another."""
        return df.withColumn("_names", F.when(changed, tag_names(text)).otherwise(names))

    # HTML has no NUL: readers show it as a replacement character.
    df = df.withColumn(into, if_contains(
        F.col(html), blocks.MARK, F.replace(F.col(html), F.lit(blocks.MARK), F.lit("\ufffd")), F.col(html)))
    # A rule is tried where its tags are: to look for each of them in all of the text is most of the work.
    df = df.withColumn("_names", tag_names(text))
    df = df.withColumn("_titled", F.when(
        has("title"), masked(matchable(F.col(html), P.closing("title"), "<"), P.starting("title"))).otherwise(F.lit("")))
    df = df.withColumn(
        "title", decode_entities(strip(F.regexp_extract("_titled", P.java(TITLE), 1)))).drop("_titled")
    hidden = F.col("_hidden")
    df = df.withColumn("_hidden", has("script", "style", "title") | F.contains(text, F.lit("<!--")))
    for opener, closer, start in (
        (P.opening("script"), P.closing("script"), P.starting("script")),
        (P.opening("style"), P.closing("style"), P.starting("style")),
        ("<!--", "-->", None), (P.opening("title"), P.closing("title"), P.starting("title")),
    ):
        df = rewrite_pairs(
            df, into, closer,
            lambda t, p=P.java(f"{opener}.*?{closer}"): F.regexp_replace(t, p, ""), needle="<", opener=start, where=hidden,
        )
    df = named(df, hidden).drop("_hidden")
    df = rewrite_pairs(df, into, P.closing("a"), lambda t: F.regexp_replace(t, P.java(LINK), "[$4]($1$2$3)"),
                       opener=P.A_START, where=has("a"))
    df = named(df, has("a"))
    nested = F.col("_nested")
    df = df.withColumn("_nested", F.when(has(*blocks.BLOCKS), text.rlike(P.java(blocks.NESTED))).otherwise(F.lit(False)))
    for at, step in enumerate(blocks.marked(text, names, substitute)):
        df = df.withColumn(into, F.when(nested, step).otherwise(text))
        if not at:
            df = named(df, nested & has("table"))
    headings = [f"h{level}" for level in range(1, 7)]
    df = replace_tags(df, into, [
        (f"<[hH]([1-6]){P.ATTRS}>", "\n\n<h$1>", has(*headings)), ("</[hH][1-6]>", "\n\n", has(*headings)),
    ])
    headed = text
    for level in range(1, 7):
        headed = F.replace(headed, F.lit(f"<h{level}>"), F.lit("#" * level + " "))
    df = df.withColumn(into, if_contains(text, "<h", headed, text))
    df = replace_tags(df, into, [
        (P.opening("li"), "\n- ", has("li")), (P.BR, "\n", has("br")), (P.HR, "\n\n---\n\n", has("hr")),
        (P.STRONG, "**", has("strong", "b")), (P.EMPHASIS, "*", has("em", "i")), (P.CODE, "`", has("code")),
    ])
    df = clean.convert_img_tags(df, into, has("img")).drop("img_tags_converted")
    df = named(df, has("img"))
    df = replace_tags(df, into, [(BLOCK_TAG, "\n\n", has(*BLOCK_NAMES.split("|"))), (OTHER_TAG, "")]).drop("_names")
    df = df.withColumn(into, decode_entities(text))
    return fence(df.withColumn(into, strip(F.when(nested, blocks.written_column(df.sparkSession, into)).otherwise(squeeze(text)))).drop("_nested"))


def text_to_markdown(df: DataFrame, text: str = "text", into: str = "markdown") -> DataFrame:
    """Plain text is its own Markdown, stripped."""
    return df.withColumn(into, strip(F.col(text)))


def reject_empty(df: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Conversions without visible text."""
    return df.filter(F.length(strip(F.col(markdown))) == 0)


def warning_lines(log: Column, *, export: bool = False) -> Column:
    """Non-blank lines of a converter's log; exports drop style-sheet chatter."""
    lines = F.filter(F.split(log, LINE_BREAK, -1), lambda line: strip(line) != "")
    if export:
        lines = F.filter(lines, lambda line: ~F.startswith(line, F.lit("WARNING:")))
    return lines


# Error texts of the converters.
EMPTY_OUTPUT_ERROR = "ConversionError: markitdown returned empty output"
UNAVAILABLE_ERROR = "ConverterUnavailableError: no decoder for {} files"


def convert_corpus(routed: DataFrame, content: str = "content") -> DataFrame:
    """Convert every routed file in one pass over the content.

    HTML and plain text become cleaned Markdown; binary documents and rejected or unroutable
    files keep an error instead, so the result has exactly the input's rows. The branches are
    conditional columns, not filtered copies, so the content is scanned once. ``warnings`` are the
    lines of the converter's log, if the input has one as ``converter_log``.
    """
    convertible = F.col("route_error").isNull() & F.col("error_class").isNull()
    html, txt = F.col("extension") == ".html", F.col("extension") == ".txt"
    df = routed.withColumns({
        "_html": F.when(convertible & html, F.col(content)).otherwise(""),
        "_plain": F.when(convertible & txt, F.col(content)).otherwise(""),
    })
    df = html_to_markdown(df, "_html", "_from_html")
    df = df.withColumn("text", F.when(html, F.col("_from_html")).otherwise(strip(F.col("_plain"))))
    df = df.withColumns({
        "_empty": F.col("text") == "",
        # Converters report on what they were given; HTML and text need none of their warnings.
        "warnings": warning_lines(F.coalesce(F.col("converter_log"), F.lit("")) if "converter_log" in routed.columns else F.lit("")),
    })
    df = clean.clean_corpus(df.drop("_html", "_plain", "_from_html"))
    error = (
        F.when(F.col("error_class").isNotNull(),
               F.concat_ws(": ", "error_class", "error_message"))
        .when(F.col("route_error").isNotNull(), F.col("route_error"))
        .when(~html & ~txt, F.concat(
            F.lit(UNAVAILABLE_ERROR.split("{}")[0]), F.col("extension"),
            F.lit(UNAVAILABLE_ERROR.split("{}")[1])))
        .when(F.col("_empty"), F.lit(EMPTY_OUTPUT_ERROR))
    )
    df = df.withColumn("error", error)
    done = F.col("error").isNull()
    return df.withColumns({
        "status": F.when(done, "done").otherwise("failed"),
        "markdown": F.when(done, F.col("text")),
        "warnings": F.when(done, F.col("warnings")),
        "output_bytes": F.when(done, F.octet_length("text").cast("long")),
    }).drop("_empty", "text")
