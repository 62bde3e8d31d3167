"""Projection helpers for tag rewriting: one projection a step, counters beside the text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.patterns import BLANK_RUN, TRAILING_BLANKS, java

_HEAD, _TAGGED, _PARTS = "_matchable", "_tagged", "_between"
# One that the text does not hold stands for "<" of an opening tag inside another one while a rule runs.
_MASKS = ("\ue000", "\ufdd0", "\ufdef", "\uf8ff")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def if_contains(text: Column, needle: str, value: Column, otherwise: Column) -> Column:
    """Byte-level test in front of a regex; text without the needle skips the regex."""
    return F.when(F.contains(text, F.lit(needle)), value).otherwise(otherwise)


def behind(text: Column, head: Column) -> Column:
    """What follows a text's beginning ``head``. Cut by bytes: characters would be counted one by one."""
    return F.substring(text.cast("binary"), F.octet_length(head) + 1, F.octet_length(text)).cast("string")


def complete_tags(text: Column) -> Column:
    """The text up to its last ``>``: no tag ends behind it, and looking for the end of one would
    scan the rest of the document once for every opener."""
    size = F.octet_length(text) - F.octet_length(F.substring_index(text, ">", -1))
    return F.substring(text.cast("binary"), F.lit(1), size).cast("string")


def tag_names(text: Column) -> Column:
    """Names in lower case of all tags that begin in a text; null if one has a letter that passes for one of
    ASCII where case is ignored. See ``has_tag``."""
    def lowered(names: Column) -> Column:
        odd = F.array_join(names, " ").rlike("[\u0130\u0131\u017f\u212a]")
        return F.when(~odd, F.array_distinct(F.transform(names, F.lower)))

    return let(F.regexp_extract_all(text, F.lit(r"</?([\p{L}\p{N}_]+)"), F.lit(1)), lowered)


def has_tag(names: Column, *wanted: str) -> Column:
    """Whether a text with these ``tag_names`` can hold one of the tags, so that a rule on them need be tried."""
    return F.coalesce(F.arrays_overlap(names, F.array(*[F.lit(name) for name in wanted])), F.lit(True))


def replace_tags(
    df: DataFrame,
    column: str,
    rules: list[tuple[str, str] | tuple[str, str, Column]],
    counter: str | None = None,
) -> DataFrame:
    """Replace stand-alone tags, rule after rule; ``counter`` counts the first rule's matches.

    A rule's third entry tells which texts it need be tried on.
    """
    text, tagged = F.col(column), F.col(_TAGGED)
    for at, (pattern, replacement, *tried) in enumerate(rules):
        found = F.contains(text, F.lit("<"))
        for where in tried:
            found = where & found
        df = df.withColumn(_TAGGED, F.when(found, complete_tags(text)).otherwise(F.lit("")))
        rest = behind(text, tagged)
        if counter and not at and "$" not in replacement:
            # One pass gives both: what is between the matches, and so their number.
            df = df.withColumn(_PARTS, F.when(tagged != "", F.split(tagged, java(pattern), -1)))
            df = df.withColumns({
                column: F.when(tagged == "", text).otherwise(F.concat(F.array_join(_PARTS, replacement), rest)),
                counter: F.when(tagged == "", 0).otherwise(F.size(_PARTS) - 1),
            }).drop(_PARTS)
            continue
        added = {column: F.when(tagged == "", text).otherwise(
            F.concat(F.regexp_replace(tagged, java(pattern), replacement), rest))}
        if counter and not at:
            added[counter] = F.when(tagged == "", 0).otherwise(count_matches(tagged, java(pattern)))
        df = df.withColumns(added)
    return df.drop(_TAGGED)


def _mask(text: Column) -> Column:
    """The first of the mask characters that a text does not hold; null if it holds them all."""
    free = F.lit(None).cast("string")
    for char in reversed(_MASKS):
        free = F.when(~F.contains(text, F.lit(char)), char).otherwise(free)
    return free


def masked(text: Column, opener: str) -> Column:
    """Hide openers that stand inside an opening tag of the same kind.

    ``opener`` is a pattern of a tag's start, without its ``<``. All openers before one ``>`` end
    there together: if the first of them begins no match, neither does another. Trying them all
    would scan that stretch once for each, so all but the first are masked.
    """
    crowded = text.rlike(f"(?s)<{opener}[^>]*<{opener}")
    inner = f"(?s)((?:<{opener}|(?!\\A)\\G)(?:[^<>]|<(?!{opener}))*+)<(?={opener})"
    hidden = F.regexp_replace(text, F.lit(inner), F.concat(F.lit("$1"), _mask(text)))
    return F.when(crowded, F.coalesce(hidden, text)).otherwise(text)


def unmasked(text: Column, before: Column) -> Column:
    """Undo ``masked``; ``before`` is the text as it was before masking."""
    return let(_mask(before), lambda mask: F.when(
        F.contains(text, mask), F.replace(text, mask, F.lit("<"))).otherwise(text))


def squeeze(text: Column) -> Column:
    """No blanks before line breaks and at the end, two line breaks in a row at most.

    Bytes tell whether there is anything to do: the pattern looks at every blank of a text.
    """
    blank_end = F.endswith(text, F.lit(" ")) | F.endswith(text, F.lit("\t"))
    trailing = blank_end | F.contains(text, F.lit(" \n")) | F.contains(text, F.lit("\t\n"))
    trimmed = F.when(trailing, F.regexp_replace(text, TRAILING_BLANKS, "")).otherwise(text)
    squeezed = let(trimmed, lambda t: if_contains(t, "\n\n\n", F.regexp_replace(t, BLANK_RUN, "\n\n"), t))
    return F.when(blank_end | F.contains(text, F.lit("\n")), squeezed).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, for use inside lambda expressions."""
    return F.get(F.transform(F.array(value), body), 0)


def matchable(text: Column, closer: str, needle: str = "</") -> Column:
    """The text up to the last ``closer``."""
    return if_contains(text, needle, F.regexp_extract(text, java(f"^(.*{closer})"), 1), F.lit(""))


def rewrite_pairs(
    df: DataFrame,
    column: str,
    closer: str,
    rewrite: Callable[[Column], Column],
    counters: dict[str, Callable[[Column], Column]] | None = None,
    needle: str = "</",
    opener: str | None = None,
    prepare: Callable[[Column], Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Apply ``rewrite`` and ``counters`` to the text up to the last ``closer``.

    An opening tag behind the last closing tag can never match, and looking for its end would
    scan the rest of the document once for every such tag. ``opener`` is the start of the rule's
    opening tag, see ``masked``; ``prepare`` masks further; ``where`` tells which texts the rule need be tried on.
    """
    text, head, ready = F.col(column), F.col(_HEAD), F.col(_TAGGED)
    whole = matchable(text, closer, needle)
    df = df.withColumn(_HEAD, whole if where is None else F.when(where, whole).otherwise(F.lit("")))
    masks = masked(head, opener) if opener else head
    if prepare:
        df = df.withColumn(_TAGGED, masks)
        masks = prepare(ready)
    df = df.withColumn(_TAGGED, masks)
    rest = behind(text, head)
    return df.withColumns({
        column: F.when(head == "", text).otherwise(F.concat(unmasked(rewrite(ready), head), rest)),
        **{
            name: F.when(head == "", 0).otherwise(count(ready))
            for name, count in (counters or {}).items()
        },
    }).drop(_HEAD, _TAGGED)


def fence(df: DataFrame) -> DataFrame:
    """Keep later filters above this point.

    Pushing a filter on rewritten text below the rewriting would repeat every stage in the
    filter's condition, stage by stage. An observation stops that and still lets unused columns go.
    """
    return df.observe(f"rewritten-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
