"""Nested HTML blocks as Markdown: lists in lists, quotations, tables and verbatim text.

A text is cut at its block tags, which stand in it as a NUL and a letter: HTML has no NUL. One running
fold over the pieces keeps the stack of open blocks and notes for each piece what its lines begin with;
each piece is then written by that and the piece before it. Nothing is matched by a regular expression
across tags, so nesting has no limit.

The fold goes in two steps, pieces within a stretch and then stretches, so that appending a note does not
copy all earlier ones: the cost grows with the text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import patterns as P
from foliomill.functions.rewrite import behind, complete_tags, has_tag, if_contains, let, matchable, squeeze
from foliomill.functions.text import strip

MARK = "\x00"
PIECES = 128  # of a stretch
DEEPEST = 40  # open blocks; those inside are written like the text of the last one
# What a letter behind the mark stands for: a quotation, a bulleted and a numbered list, the end of either,
# an item, verbatim text and its end, a table, a row and its end, a cell.
QUOTE, UNQUOTE, BULLETS, NUMBERS, END_LIST, ITEM, CODE, END_CODE, TABLE, ROW, END_ROW, CELL = "qQuoLipPtrRc"
TEXT, VERBATIM = " ", "v"  # a piece of text behind a block, and one inside a fence

_NOT_BLOCK = P.any_case("table|ul|ol|dl|pre|blockquote|h[1-6]")
# A table with rows of cells and no block in it; others lay out a page, and only their text counts.
DATA_TABLE = P.opening("table") + f"([^<]*(?:<(?!/?{_NOT_BLOCK}[^\\p{{L}}\\p{{N}}_])[^<]*)*+)" + P.closing("table")
CODE_START = P.opening("pre") + f"(?:[{P.SPACE}]*{P.opening('code')})?"
CODE_STOP = f"(?:{P.closing('code')}[{P.SPACE}]*)?" + P.closing("pre")
# Blocks that need the fold. A list of bullets without another inside it does not.
NESTED = (
    f"<(?:{P.any_case('ol|pre|blockquote|table')}[^\\p{{L}}\\p{{N}}_]|{P.any_case('ul')}{P.ATTRS}>[^<]*"
    f"(?:<(?!/?{P.any_case('ul')}[^\\p{{L}}\\p{{N}}_])[^<]*)*+<{P.any_case('ul')}[^\\p{{L}}\\p{{N}}_])"
)
# Pattern, marks, names of the tags.
TAGS = (
    (P.opening("blockquote"), MARK + QUOTE, ["blockquote"]), (P.closing("blockquote"), MARK + UNQUOTE, ["blockquote"]),
    (P.opening("ul"), MARK + BULLETS, ["ul"]), (P.closing("ul|ol"), MARK + END_LIST, ["ul", "ol"]),
    (P.opening("li"), MARK + ITEM, ["li"]), (CODE_START, MARK + CODE, ["pre"]),
    (CODE_STOP, MARK + END_CODE + MARK + TEXT, ["pre"]),
)
BLOCKS = ("ol", "ul", "pre", "blockquote", "table")
ORDERED_START = P.opening("ol")
STARTS_AT = f"(?:^|[^\\p{{L}}\\p{{N}}_-]){P.any_case('start')}[{P.SPACE}]*=[{P.SPACE}]*[\"']?([0-9]{{1,9}})"

ENTRY = "struct<kind: string, n: int, prefix: string>"  # an open block, its last number, what lines in it begin with
# What is known behind a piece: open blocks, whether a fence is open, rows and cells of the table, and how
# many lists have begun outside of others.
STATE = f"stack: array<{ENTRY}>, code: boolean, rows: int, cells: int, lists: int"
# A piece and what its lines begin with: the first line (outside an item's own list), its marker, the others.
NOTE = "kind: string, text: string, around: string, marker: string, inside: string, rows: int, cells: int, lists: int"
START = f"cast(named_struct('stack', array(), 'code', false, 'rows', 0, 'cells', 0, 'lists', 0) as struct<{STATE}>)"


def _table(body: Column) -> Column:
    for pattern, replacement in (
        (P.either("thead|tbody|tfoot|colgroup|col"), ""), (P.opening("tr"), MARK + ROW), (P.closing("tr"), MARK + END_ROW), (P.opening("td|th"), MARK + CELL),
        # Text of a row outside its cells is a cell of its own.
        (P.closing("td|th"), " "), (f"({MARK}[{ROW}{END_ROW}][{P.SPACE}]*+)(?=[^{MARK}])", f"$1{MARK}{CELL}"),
    ):
        body = F.regexp_replace(body, P.java(pattern), replacement)
    return F.concat(F.lit(MARK + TABLE), body, F.lit(MARK + END_ROW + MARK + TEXT))


def marked(text: Column, names: Column, substitute: Callable) -> list[Column]:
    """Projections that put marks in the place of block tags, each to be applied to the result of the one before.

    ``names`` are the text's ``tag_names``, which only the first of them, on tables, can change.
    """
    def numbers(tag: Column) -> Column:
        start = F.regexp_extract(tag, P.java(STARTS_AT), 1).try_cast("int")
        return F.when(tag.isNotNull(), F.concat(
            F.lit(MARK + NUMBERS), F.coalesce(start, F.lit(1)).cast("string"), F.lit(MARK + TEXT)))

    # Behind the last ">" no tag ends, and behind the last end of a table none is whole.
    whole = matchable(text, P.closing("table"))
    tables = F.concat(substitute(whole, P.java(DATA_TABLE), _table, 1), behind(text, whole))
    complete, rest = complete_tags(text), F.substring_index(text, ">", -1)
    ordered = F.concat(substitute(complete, P.java(ORDERED_START), numbers, 0), rest)
    steps = [(if_contains(text, "</", tables, text), ["table"]), (ordered, ["ol"])]
    steps += [(F.concat(F.regexp_replace(complete, P.java(pattern), marks), rest), tags) for pattern, marks, tags in TAGS]
    return [F.when(has_tag(names, *tags), step).otherwise(text) for step, tags in steps]


def _below(stack: Column) -> Column:
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))


def _prefix(stack: Column) -> Column:
    """What a line inside the stack begins with."""
    return F.coalesce(F.try_element_at(stack, F.lit(-1))["prefix"], F.lit(""))


def _popped(stack: Column, *kinds: str) -> Column:
    """The stack without its last entry of the kinds and all above it; as it is if there is none."""
    places = F.transform(stack, lambda e, i: F.when(e["kind"].isin(*kinds), i + 1).otherwise(0))
    at = F.coalesce(F.array_max(places), F.lit(0))
    return F.when(F.try_element_at(stack, F.lit(-1))["kind"].isin(*kinds), _below(stack)).when(
        at > 0, F.slice(stack, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(stack)


def _entry(kind: Column, n: Column, outer: Column) -> Column:
    inner = F.when(kind == QUOTE, "> ").when(kind == BULLETS, "  ").otherwise(F.repeat(F.lit(" "), F.length(n.cast("string")) + 2))
    return F.struct(kind.alias("kind"), n.alias("n"), F.concat(outer, inner).alias("prefix"))


def _stacked(stack: Column, kind: Column, body: Column) -> Column:
    """The open blocks behind a tag."""
    before = F.when(kind == NUMBERS, F.greatest(body.try_cast("int") - 1, F.lit(0))).otherwise(0)
    top = F.try_element_at(stack, F.lit(-1))
    return (
        F.when(kind.isin(QUOTE, BULLETS, NUMBERS) & (F.size(stack) < DEEPEST),
               F.array_append(stack, _entry(kind, before, _prefix(stack))))
        .when(kind == UNQUOTE, _popped(stack, QUOTE))
        .when(kind == END_LIST, _popped(stack, BULLETS, NUMBERS))
        .when((kind == ITEM) & (top["kind"] == NUMBERS), let(_below(stack), lambda below: F.array_append(
            below, _entry(top["kind"], top["n"] + 1, _prefix(below)))))
        .otherwise(stack).cast(f"array<{ENTRY}>"))


def _noted(state: Column, piece: Column) -> Column:
    """(state, note) after one piece: a letter, then text up to the next mark."""
    letter, body = F.substring(piece, 1, 1), F.substring(piece, F.lit(2), F.length(piece))
    # Inside a fence tags of other blocks are gone and their text is verbatim.
    kind = F.when(state["code"] & (letter != END_CODE), VERBATIM).when(
        ~state["code"] & (letter == END_CODE), TEXT).otherwise(letter)

    def behind(p: Column) -> Column:
        kind, stack = p["kind"], p["stack"]
        top, cells = F.try_element_at(stack, F.lit(-1)), state["cells"]
        listed = (kind == ITEM) & F.coalesce(top["kind"].isin(BULLETS, NUMBERS), F.lit(False))
        # An item's first line begins where its list does, behind a marker as wide as the others' indent.
        around = F.when(listed, _prefix(_below(stack))).otherwise(_prefix(stack))
        marker = F.when(kind != ITEM, "").when(top["kind"] == NUMBERS, F.concat(top["n"].cast("string"), F.lit(". "))).otherwise("- ")
        rows = F.when(kind == TABLE, 0).otherwise(state["rows"] + ((kind == CELL) & (cells == 0)).cast("int"))
        # A list that begins outside of any other, or behind a quotation, is set apart from items before it.
        lists = state["lists"] + ((kind == UNQUOTE) | kind.isin(BULLETS, NUMBERS) & (F.size(stack) == 1)).cast("int")
        text = F.when(kind == NUMBERS, "").when(kind.isin(CODE, VERBATIM), p["body"]).otherwise(strip(squeeze(p["body"])))
        return F.struct(
            F.struct(
                stack.alias("stack"), ((kind == CODE) | (kind == VERBATIM)).alias("code"), rows.alias("rows"),
                F.when(kind == CELL, cells + 1).when(kind.isin(TABLE, ROW, END_ROW), 0).otherwise(cells).alias("cells"),
                lists.alias("lists")).cast(f"struct<{STATE}>").alias("state"),
            F.struct(
                kind.alias("kind"), text.alias("text"), around.alias("around"), marker.alias("marker"),
                _prefix(stack).alias("inside"), rows.alias("rows"), cells.alias("cells"), lists.alias("lists"),
            ).cast(f"struct<{NOTE}>").alias("note"))

    return let(F.struct(kind.alias("kind"), body.alias("body")), lambda p: let(
        F.struct(p["kind"].alias("kind"), p["body"].alias("body"), _stacked(state["stack"], p["kind"], p["body"]).alias("stack")),
        behind))


def _lines(text: Column, prefix: Column) -> Column:
    """Every further line behind the prefix, empty ones without its blanks."""
    new = F.lit("\n")
    return F.when(prefix == "", text).otherwise(F.replace(
        F.replace(text, new, F.concat(new, prefix)), F.concat(new, prefix, new), F.concat(new, F.rtrim(prefix), new)))


def _line(note: Column, last: Column) -> Column:
    """What a piece adds to the text behind the piece ``last``, which is null for the first."""
    kind, new, inside = note["kind"], F.lit("\n"), note["inside"]
    # A blank line between two prefixes has what they share.
    shared = F.rtrim(F.when(F.startswith(last["inside"], note["around"]), note["around"])
                     .when(F.startswith(note["around"], last["inside"]), last["inside"]).otherwise(""))
    # An item of several paragraphs is set apart from what follows.
    tight = (kind == ITEM) & (last["kind"] == ITEM) & (last["lists"] == note["lists"]) & ~F.contains(last["text"], F.lit("\n\n"))
    start = F.concat(F.when(last.isNull(), "").when(tight, new).otherwise(F.concat(new, shared, new)), note["around"])
    joined = if_contains(note["text"], "\n", F.regexp_replace(note["text"], "[ \t]*\n\\s*", " "), note["text"])
    cell = F.replace(joined, F.lit("|"), F.lit("\\|"))
    broken = F.startswith(note["text"], F.lit("\n")) | F.startswith(note["text"], F.lit("\r\n"))
    verbatim = F.when(broken, F.regexp_replace(note["text"], "^\r?\n", "")).otherwise(note["text"])
    rule = F.concat(new, inside, F.lit("|"), F.repeat(F.lit(" --- |"), note["cells"]))
    return (
        F.when(kind == CODE, F.concat(start, F.lit("```\n"), inside, _lines(verbatim, inside)))
        .when(kind == VERBATIM, _lines(note["text"], inside))
        .when(kind == END_CODE, F.concat(F.when((last["text"] == "") | F.endswith(last["text"], F.lit("\n")), "").otherwise(F.concat(new, inside)), F.lit("```")))
        .when(kind == CELL, F.concat(F.when(note["cells"] > 0, " | ").when(
            note["rows"] > 1, F.concat(new, inside, F.lit("| "))).otherwise(F.concat(start, F.lit("| "))), cell))
        .when(kind.isin(ROW, END_ROW), F.concat(F.lit(" |"), F.when(note["rows"] == 1, rule).otherwise("")))
        .otherwise(F.concat(start, F.rtrim(F.concat(note["marker"], _lines(note["text"], inside))))))


def written(text: Column) -> Column:
    """A marked text as Markdown."""
    acc_type = f"struct<state: struct<{STATE}>, notes: array<struct<{NOTE}>>>"

    def start(state: Column) -> Column:
        return F.struct(state.alias("state"), F.array().alias("notes")).cast(acc_type)

    def noted(acc: Column, piece: Column) -> Column:
        return let(_noted(acc["state"], piece), lambda after: F.struct(
            after["state"].alias("state"), F.array_append(acc["notes"], after["note"]).alias("notes")).cast(acc_type))

    def stretch(acc: Column, pieces: Column) -> Column:
        return let(F.aggregate(pieces, start(acc["state"]), noted), lambda done: F.struct(
            done["state"].alias("state"), F.concat(acc["notes"], F.array(done["notes"])).alias("notes")).cast(whole_type))

    whole_type = f"struct<state: struct<{STATE}>, notes: array<array<struct<{NOTE}>>>>"

    def folded(pieces: Column) -> Column:
        stretches = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / PIECES).cast("int")),
            lambda i: F.slice(pieces, i * PIECES + 1, F.lit(PIECES)))
        first = F.struct(F.expr(START).alias("state"), F.array().alias("notes")).cast(whole_type)
        notes = F.aggregate(stretches, first, stretch, lambda acc: F.flatten(acc["notes"]))
        said = F.filter(notes, lambda n: n["kind"].isin(ITEM, CODE, END_CODE, CELL) | F.when(
            n["kind"].isin(ROW, END_ROW), n["cells"] > 0).otherwise(n["text"] != ""))
        return let(said, lambda notes: F.array_join(F.transform(notes, lambda n, i: _line(n, F.get(notes, i - 1))), ""))

    # The text before the first mark is a piece too; a fence that no tag ends is ended here.
    return let(F.split(F.concat(F.lit(TEXT), text, F.lit(MARK + END_CODE)), MARK, -1), folded)


@functools.lru_cache(maxsize=16)
def _prepared(gateway: object, name: str) -> Column:
    return written(F.col(name))


def written_column(spark: SparkSession, name: str) -> Column:
    """``written`` of a column by name, put together once for each name: that takes longer than planning it."""
    return _prepared(spark.sparkContext._gateway, name)
