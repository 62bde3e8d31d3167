"""What the SQL checks hold the engine to, stated on its own: nothing here comes from the engine.

Patterns are RE2. A tag name is followed by a character that is no letter, digit or underscore, or
by the end of the tag.
"""

from __future__ import annotations

import io
import zipfile
from html.entities import name2codepoint

# What Python's str.strip() removes, as characters and as a class of a pattern.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "               　"
)
BLANK = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_REST = r"(?:[^\p{L}\p{N}_>][^>]*)?>"


def opens(names: str) -> str:
    return f"<(?i:{names}){_REST}"


def closes(name: str) -> str:
    return f"</(?i:{name})>"


def both(names: str) -> str:
    return f"</?(?i:{names}){_REST}"


def pair(name: str) -> str:
    return f"{opens(name)}(.*?){closes(name)}"


def block(name: str) -> str:
    return f"{opens(name)}.*?{closes(name)}"


ATTRIBUTES = _REST[:-1]
# The cleaner's rules by their order of use.
SVG = block("svg")
SINGLE_CELL = (
    rf"{opens('table')}[{BLANK}]*(?:{block('colgroup')}[{BLANK}]*)?<(?i:tbody)>[{BLANK}]*<(?i:tr)>[{BLANK}]*{opens('td')}(.*?)"
    rf"</(?i:td)>[{BLANK}]*</(?i:tr)>[{BLANK}]*</(?i:tbody)>[{BLANK}]*</(?i:table)>"
)
PARAGRAPH = pair("p")
CALLOUTS = ("✅", "⚠️", "💡", "🎯", "📝", "📌", "🚨", "🔥", "ℹ️", "❗")
SCAFFOLD = both("table|tbody|thead|tfoot|tr|colgroup|col|caption")
CELL_OPENS, CELL_CLOSES = opens("td|th"), closes("td|th")
QUOTED = rf'<(?i:div)[^\p{{L}}\p{{N}}_>][^>]*(?i:class=)"(?i:class_sM3)"[^>]*>(.*?){closes("div")}'
CHAPTER_ANCHOR = rf'<(?i:a)[{BLANK}][^>]*(?i:href=)"#[^"]*(?i:[.]xhtml)[^"]*"[^>]*>(.*?){closes("a")}'
WEB_ANCHOR = rf'<(?i:a)[{BLANK}][^>]*(?i:href=)"((?i:https?://)[^"]+)"[^>]*>(.*?){closes("a")}'
ANY_ANCHOR = pair("a")
CHAPTER_LINK = r"\[([^\]]*)\]\(#[^)]*[.]xhtml[^)]*\)"
EMPTY_SPAN, SPAN, SPAN_TAG = opens("span") + closes("span"), pair("span"), f"{opens('span')}|{closes('span')}"
DIV_OPENS, DIV_CLOSES = opens("div"), closes("div")
IMAGE = f"<(?i:img)({ATTRIBUTES})>"
IMAGE_SOURCE, IMAGE_TEXT = '(?i:src=)"([^"]+)"', '(?i:alt=)"([^"]*)"'
LINE_BREAK, RULE = opens("br"), opens("hr")
STRONG, EMPHASIS, CODE = both("strong|b"), both("em|i"), both("code")
WRAPPERS = (
    "section|article|aside|figure|figcaption|header|footer|nav|main|cite|small|sup|sub|mark|u|abbr|q|s|strike|del|ins|"
    "wbr|time|var|kbd|samp|address|bdi|bdo|data|dfn|ruby|rt|rp"
)
WRAPPER = both(WRAPPERS)
LEFT_OVER = both(
    "svg|span|div|table|tbody|thead|tfoot|tr|td|th|colgroup|col|caption|br|hr|strong|b|em|i|code|" + WRAPPERS)
_WORD = rf"[^{BLANK}\"'()\[\]]"
_PART = rf"[^{BLANK}\"'()\[\]/]"
MEDIA_PATH = rf"({_WORD}*?)({_PART}+(?i:_media))/({_WORD}+[.](?i:jpg|jpeg|png|gif|svg|webp|bmp))"
BLANK_LINES = r"\n{3,}"
HEADING_START = rf"^#{{1,6}}[{BLANK}]+[^{BLANK}]"
HEADING = rf"^(#{{1,6}})[{BLANK}]+(.+?)[{BLANK}]*$"
FIRST_HEADING = rf"^#[{BLANK}]+(.+?)[{BLANK}]*$"

# HTML to Markdown.
TITLE = pair("title")
LINK = (
    rf"""<(?i:a)[{BLANK}](?:[^>]*[{BLANK}"'/])?(?i:href)[{BLANK}]*=[{BLANK}]*"""
    rf"""(?:"([^"]*)"|'([^']*)'|([^{BLANK}"'>]+))[^>]*>(.*?){closes("a")}"""
)
BLOCKS = both(
    "p|div|article|section|header|footer|main|nav|aside|ul|ol|dl|dd|dt|table|thead|tbody|tfoot|tr|td|th|caption|"
    "figure|figcaption|form|address|body|html|head")
OTHER_TAG = "</?[A-Za-z][^>]*>|<![^>]*>"
ENTITY = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}

# Texts and types of the results.
EMPTY_OUTPUT = "ConversionError: markitdown returned empty output"
NO_DECODER = ("ConverterUnavailableError: no decoder for ", " files")
NO_TEXT = "Conversion produced no text content."
NO_HEADING = "No headings detected — the document structure may have been lost."
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
ACCEPTED = "['.docx', '.epub', '.html', '.pdf', '.txt']"


def archive(entry: str, ended: bool = True) -> str:
    """Hex digits of an archive with one empty entry."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr(zipfile.ZipInfo(entry), b"")
    data = out.getvalue()
    return (data if ended else data[:data.rindex(b"PK\x05\x06")]).hex().upper()
