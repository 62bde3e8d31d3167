"""Regular expressions of the Markdown cleaner.

Spelled so that Java and RE2 read them alike: an explicit whitespace class instead of ``\\s``,
and an explicit "not a word character" instead of a word boundary after a tag name. Only names
are matched without case; a whole pattern without case would fold every character of the text.
"""

from __future__ import annotations

from foliomill.functions.text import SPACE

# What may follow a tag name up to, not including, the closing ">".
ATTRS = r"(?:[^\p{L}\p{N}_>][^>]*)?"
_S = f"[{SPACE}]*"


def any_case(literal: str) -> str:
    """A group that ignores case by Unicode rules."""
    return f"(?iu:{literal})"


def starting(names: str) -> str:
    """What follows the ``<`` of an opening tag up to the end of its name."""
    return any_case(names) + r"(?=[^\p{L}\p{N}_])"


def opening(names: str) -> str:
    return f"<{any_case(names)}{ATTRS}>"


def closing(names: str) -> str:
    """An exact closing tag, without blanks or attributes."""
    return f"</{any_case(names)}>"


def either(names: str) -> str:
    """An opening or closing tag, attributes allowed in both."""
    return f"</?{any_case(names)}{ATTRS}>"


# The tags, classes, attributes and path shapes each cleaning rule acts on.
SVG = opening("svg") + ".*?" + closing("svg")
SINGLE_CELL_END = f"{closing('td')}{_S}{closing('tr')}{_S}{closing('tbody')}{_S}{closing('table')}"
SINGLE_CELL = (
    opening("table") + _S
    + f"(?:{opening('colgroup')}.*?{closing('colgroup')}{_S})?"
    + f"<{any_case('tbody')}>{_S}<{any_case('tr')}>{_S}{opening('td')}(.*?){SINGLE_CELL_END}"
)
# What must follow a column group for it to belong to a single-cell table.
COLGROUP_END = f"{closing('colgroup')}{_S}<{any_case('tbody')}>{_S}<{any_case('tr')}>{_S}{opening('td')}"
COLGROUP_START = any_case("<colgroup")
PARAGRAPH = opening("p") + "(.*?)" + closing("p")
TABLE_SCAFFOLD = either("table|tbody|thead|tfoot|tr|colgroup|col|caption")
CELL_OPEN = opening("td|th")
CELL_CLOSE = closing("td|th")
QUOTED_DIV = (
    f"<{any_case('div')}[^\\p{{L}}\\p{{N}}_>][^>]*{any_case('class=')}\"{any_case('class_sM3')}\"[^>]*>"
    f"(.*?){closing('div')}"
)
A_START = f"{any_case('a')}(?=[{SPACE}])"
_A_HREF = f"<{any_case('a')}[{SPACE}][^>]*{any_case('href=')}"
ANCHOR_XHTML = f'{_A_HREF}"#[^"]*{any_case("[.]xhtml")}[^"]*"[^>]*>(.*?){closing("a")}'
ANCHOR_EXTERNAL = f'{_A_HREF}"({any_case("https?://")}[^"]+)"[^>]*>(.*?){closing("a")}'
ANCHOR_ANY = opening("a") + "(.*?)" + closing("a")
MD_LINK_XHTML = r"\[([^\]]*)\]\(#[^)]*[.]xhtml[^)]*\)"
SPAN_EMPTY = opening("span") + closing("span")
SPAN_PAIR = opening("span") + "(.*?)" + closing("span")
SPAN_TAG = opening("span") + "|" + closing("span")
IMG = f"<{any_case('img')}({ATTRS})>"
IMG_SRC = any_case("src=") + '"([^"]+)"'
IMG_ALT = any_case("alt=") + '"([^"]*)"'
BR = opening("br")
HR = opening("hr")
STRONG = either("strong|b")
EMPHASIS = either("em|i")
CODE = either("code")
RESIDUAL_NAMES = (
    "section|article|aside|figure|figcaption|header|footer|nav|main|"
    "cite|small|sup|sub|mark|u|abbr|q|s|strike|del|ins|wbr|time|var|kbd|"
    "samp|address|bdi|bdo|data|dfn|ruby|rt|rp"
)
RESIDUAL = either(RESIDUAL_NAMES)
_PATH = SPACE + r"\"'()\[\]"
WORD_END = f"[{_PATH}]"
MEDIA_FILE = f"[^{_PATH}]+[.]{any_case('jpg|jpeg|png|gif|svg|webp|bmp')}"
MEDIA_FOLDER = f"[^{_PATH}/]+{any_case('_media')}"
MEDIA_PATH = f"([^{_PATH}]*?)({MEDIA_FOLDER})/({MEDIA_FILE})"
HEADING_START = f"^#{{1,6}}[{SPACE}]+[^{SPACE}]"
HEADING_LINE = f"^(#{{1,6}})[{SPACE}]+(.+?)[{SPACE}]*$"
TITLE_LINE = f"^#[{SPACE}]+(.+?)[{SPACE}]*$"
CALLOUT_EMOJIS = ("✅", "⚠️", "💡", "🎯", "📝", "📌", "🚨", "🔥", "ℹ️", "❗")

# The same language as MEDIA_PATH, but tried once per space-free word and once per path
# segment, so a long base64 run costs linear instead of quadratic time in a backtracking engine.
MEDIA_PATH_ANCHORED = f"(?<![^{_PATH}])((?:[^{_PATH}]*?/)??)({MEDIA_FOLDER})/({MEDIA_FILE})"
# Trailing blanks, tried once per blank run; what stands before is only looked at where there is a blank.
TRAILING_BLANKS = r"[ \t](?<![ \t]{2})[ \t]*+(?=\n|\z)"
BLANK_RUN = r"\n{3,}"


def java(pattern: str) -> str:
    """Let ``.`` cross lines."""
    return "(?s)" + pattern


def lines(pattern: str) -> str:
    """``^`` and ``$`` at ``\\n`` only."""
    return "(?dm)" + pattern
