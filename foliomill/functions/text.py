"""Text expressions with Python-compatible Unicode rules, built from JVM functions only."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes. Spark's trim() alone
# only removes U+0020, and Java's \s misses U+001C-U+001F and the non-ASCII ones.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regex character class. Naming the property keeps the class
# one test for each character; listing its members would be a dozen.
SPACE = r"\p{IsWhite_Space}\x1c\x1d\x1e\x1f"
# Line boundaries recognised by Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """Unicode strip of both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def substitute(
    text: Column, pattern: str, replace: Callable[[Column], Column], group: int = 0
) -> Column:
    """Replace every match by ``replace(group text)``, a Column-valued callback.

    ``split`` yields the n+1 gaps and ``regexp_extract_all`` the n matches; zipping them
    keeps the whole rewrite inside the JVM.
    """
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.array_join(
        F.zip_with(
            gaps, matches, lambda gap, m: F.concat(gap, F.coalesce(replace(m), F.lit("")))
        ),
        "",
    )


# From the start of the last path component; what may follow it: slashes and "." components.
_COMPONENT, _TAIL = r"(?<![^/])", r"(?:/\.?)*+\z"


def basename(path: Column) -> Column:
    """Last path component; trailing slashes and ``.`` components are ignored."""
    return F.regexp_extract(path, rf"{_COMPONENT}((?!\.(?:/|\z))[^/]*+){_TAIL}", 1)


def suffix(path: Column) -> Column:
    """Extension with its dot, as written; empty for dot-files and trailing dots."""
    return F.regexp_extract(path, rf"{_COMPONENT}[^/]+(\.[^./]+){_TAIL}", 1)


def stem(path: Column) -> Column:
    """Last path component without its extension."""
    return F.regexp_extract(
        path, rf"{_COMPONENT}((?!\.(?:/|\z))[^/]*?)(?:(?<=[^/])\.[^./]+)?{_TAIL}", 1
    )


def if_empty(text: Column, default: str) -> Column:
    """``default`` for the empty string; evaluates ``text`` only once."""
    return F.regexp_replace(text, r"^\z", default)


def safe_name(name: Column, max_length: int = 200) -> Column:
    """File-system-safe form of a name: no directories, conservative alphabet."""
    kept = F.btrim(F.regexp_replace(basename(name), r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.substring(if_empty(kept, "file"), 1, max_length)


def human_size(n: Column) -> Column:
    """Byte count in B / KB / MB / GB, 1024 steps."""
    kib, mib, gib = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n < kib, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mib, F.concat(F.format_string("%.1f", n / kib), F.lit(" KB")))
        .when(n < gib, F.concat(F.format_string("%.1f", n / mib), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.2f", n / gib), F.lit(" GB")))
    )


@lru_cache(maxsize=1)
def _ascii_folding() -> tuple[str, str, list[str], list[str]]:
    """ASCII part of every NFKD decomposition, generated from the Unicode database.

    One-character results feed ``translate``; longer ones (ligatures, fractions) are
    returned as a key list and a value list.
    """
    one_from, one_to, many_from, many_to = [], [], [], []
    for code in range(0x80, 0x20000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            one_from.append(char)
            one_to.append(folded)
        elif folded:
            many_from.append(char)
            many_to.append(folded)
    return "".join(one_from), "".join(one_to), many_from, many_to


def fold_ascii(text: Column) -> Column:
    """Compatibility-decompose and keep only ASCII. Pure ASCII input is passed through."""
    one_from, one_to, many_from, many_to = _ascii_folding()
    table = F.map_from_arrays(
        F.split(F.lit("".join(many_from)), ""), F.split(F.lit("\x00".join(many_to)), "\x00")
    )
    expanded = F.when(
        text.rlike("[" + "".join(many_from) + "]"),
        F.array_join(
            F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)),
            "",
        ),
    ).otherwise(text)
    folded = F.regexp_replace(F.translate(expanded, one_from, one_to), r"[^\x00-\x7f]+", "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), folded).otherwise(text)


def slug(text: Column) -> Column:
    """Heading slug: ASCII, lower case, words joined by single hyphens."""
    lowered = strip(F.lower(fold_ascii(text)))
    words = F.regexp_replace(lowered, r"[^A-Za-z0-9_\t-\r\x1c-\x20-]", "")
    return F.btrim(F.regexp_replace(words, r"[\t-\r\x1c-\x20_]+", "-"), F.lit("-"))
