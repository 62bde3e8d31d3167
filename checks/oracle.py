"""DuckDB SQL for every catalogue query that SQL can express.

Views restate the derived tables; each query names the views it needs and gets them as CTEs.
"""

from __future__ import annotations

from checks import rules as R
from checks.rules import WHITESPACE


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, flags: str = "(?s)") -> str:
    """A pattern as an RE2 literal."""
    return q(flags + pattern)


WS = q(WHITESPACE)
NL = "chr(10)"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def sub(text: str, pattern: str, replacement: str, flags: str = "(?s)") -> str:
    return f"regexp_replace({text}, {re2(pattern, flags)}, {replacement}, 'g')"


def count(text: str, pattern: str, flags: str = "(?s)") -> str:
    return f"CAST(len(regexp_extract_all({text}, {re2(pattern, flags)})) AS INTEGER)"


def found(text: str, pattern: str, group: int, flags: str = "(?s)") -> str:
    return f"regexp_extract_all({text}, {re2(pattern, flags)}, {group})"


def callback(text: str, pattern: str, group: int, body) -> str:
    """Replace every match by ``body(variable)``; texts without a match stay as they are."""
    return (
        f"CASE WHEN regexp_matches({text}, {re2(pattern)}) THEN array_to_string(flatten(list_transform("
        f"list_zip(string_split_regex({text}, {re2(pattern)}), {found(text, pattern, group)}), "
        f"lambda z: [z[1], CASE WHEN z[2] IS NULL THEN '' ELSE {body('z[2]')} END])), '') ELSE {text} END"
    )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


view("jobs", """
SELECT o.o_orderkey AS job_id, o.o_orderdate AS created_at,
  CASE o.o_orderkey % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'epub' ELSE 'markdown' END AS target_format,
  CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'processing' END AS stored_status,
  CAST(coalesce(c.n, 0) AS INTEGER) AS total_files
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) c
  ON c.l_orderkey = o.o_orderkey""")
view("lines", """
SELECT *, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
  CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
  l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS file_id
FROM lineitem""")
view("files", """
SELECT file_id, l_orderkey AS job_id, CASE l_partkey % 5 WHEN 0 THEN 'part.html' WHEN 1 THEN 'part-2.html' WHEN 2 THEN 'part-2-2.html'
    WHEN 3 THEN 'part-3.html' ELSE 'part-0.html' END AS original_filename,
  CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'processing'
    ELSE 'done' END AS status,
  CASE WHEN l_suppkey % 17 = 0 THEN '../' ELSE '' END || 'input/' || file_id || '.html' AS storage_path,
  CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F') THEN
    'output/' || l_orderkey || '/' || file_id ||
    CASE l_orderkey % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.epub' ELSE '.md' END END AS output_path,
  CASE l_suppkey % 4 WHEN 0 THEN 'pandoc' WHEN 1 THEN 'pymupdf' WHEN 2 THEN 'markitdown' END AS converter_used,
  CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes, CAST(l_quantity AS INTEGER) AS pages,
  CASE WHEN l_linenumber % 3 = 0 THEN 2 WHEN l_linenumber % 3 = 1 THEN 1 ELSE 0 END AS warning_count,
  CASE WHEN l_linenumber % 3 = 0 THEN 'missing image;unknown glyph' WHEN l_linenumber % 3 = 1 THEN 'missing image' ELSE '' END AS warning_text,
  CASE WHEN l_returnflag = 'R' THEN 'ConversionError: line ' || l_linenumber END AS error_message,
  strftime(l_shipdate - INTERVAL 1 DAY, '%Y-%m-%d') AS created_day,
  CAST(l_discount * 10 AS DOUBLE) AS quality_score,
  CASE WHEN l_discount >= 0.075::DOUBLE THEN 'high' WHEN l_discount >= 0.045::DOUBLE THEN 'medium' ELSE 'low' END AS quality_level,
  l_shipdate AS finished_at
FROM lines""", "lines")
view("uploads", """
SELECT page_id AS file_id, CAST(floor(page_id / 4) AS BIGINT) AS job_id,
  'page ' || page_id || CASE WHEN page_id % 11 = 0 THEN '.pdf' WHEN page_id % 7 = 0 THEN '.HTML' ELSE '.html' END
    AS original_filename, html AS content
FROM pages
UNION ALL
SELECT 1000000 + doc_id, 1000000 + CAST(floor(doc_id / 4) AS BIGINT),
  'doc ' || doc_id || CASE WHEN doc_id % 13 = 0 THEN '.md' WHEN doc_id % 17 = 0 THEN '.exe'
    WHEN doc_id % 19 = 0 THEN '.pdf' WHEN doc_id % 23 = 0 THEN '.docx' WHEN doc_id % 29 = 0 THEN '.epub' ELSE '.txt' END,
  CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN text
    WHEN doc_id % 19 = 0 THEN '%PDF-1.7' || chr(10) || text
    WHEN doc_id % 23 = 0 THEN 'PK' || chr(3) || chr(4) || CASE WHEN doc_id % 2 = 0
      THEN repeat('.', 26) || '[Content_Types].xml....word/document.xml' ELSE '' END || text
    WHEN doc_id % 29 = 0 THEN 'PK' || chr(3) || chr(4) || repeat('.', 26) || 'mimetypeapplication/epub+zip' || text
    WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 37 = 0 THEN '\ufeff <!-- page --><p>' || text ELSE text END
FROM documents""")
view("sniffed", f"""
SELECT *, lower(regexp_extract(original_filename, '(\\.[^.]+)$', 1)) AS extension, strlen(content) AS size_bytes,
  CASE WHEN content = '' THEN 'application/x-empty'
    WHEN starts_with(content, '%PDF') THEN 'application/pdf'
    WHEN starts_with(content, 'PK' || chr(3) || chr(4)) THEN
      CASE WHEN substr(content, 31, 28) = 'mimetypeapplication/epub+zip' THEN 'application/epub+zip'
        WHEN starts_with(substr(content, 31), '[Content_Types].xml') AND contains(substr(content, 1, 4000), 'word/') THEN '{R.DOCX}'
        ELSE 'application/zip' END
    WHEN regexp_matches(ltrim(regexp_replace(content, '^\ufeff', ''), {WS}),
      '^(?i:<!doctype html|<html|<head|<title|<body|<script|<style|<table|<h1|<a href=|<!--)') THEN 'text/html'
    ELSE 'text/plain' END AS mime_type
FROM uploads""", "uploads")


def _verdict(source: str, direction: str) -> str:
    docx = R.DOCX
    return f"""
SELECT *, {direction} AS direction,
  CASE WHEN {direction} = 'import' THEN extension IN ('.epub', '.pdf', '.docx', '.html', '.txt')
    ELSE extension IN ('.md', '.markdown') END AS ext_ok,
  CASE extension WHEN '.epub' THEN mime_type IN ('application/epub+zip', 'application/zip')
    WHEN '.docx' THEN mime_type IN ('{docx}', 'application/zip') WHEN '.pdf' THEN mime_type = 'application/pdf'
    WHEN '.html' THEN mime_type IN ('text/html', 'application/xhtml+xml') WHEN '.txt' THEN mime_type = 'text/plain'
    ELSE mime_type IN ('text/plain', 'text/markdown', 'text/x-markdown') END AS mime_ok
FROM {source}"""


_ERROR = """CASE WHEN NOT ext_ok THEN 'UnsupportedExtensionError' WHEN NOT mime_ok THEN 'MimeTypeMismatchError'
    WHEN size_bytes > 104857600 THEN 'FileTooLargeError' END"""
view("checked", _verdict("sniffed", "'import'"), "sniffed")
view("validated", f"""
SELECT file_id, job_id, original_filename, content, extension, mime_type, size_bytes, {_ERROR} AS error_class,
  CASE WHEN NOT ext_ok THEN 'extension ''' || extension || ''' is not allowed; expected one of '
      || {q(R.ACCEPTED)}
    WHEN NOT mime_ok THEN 'libmagic detected ''' || mime_type || ''' which is incompatible with extension '''
      || extension || '''' END AS error_message
FROM checked""", "checked")
view("quality_docs", """
SELECT doc_id AS file_id,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 10 <> 9 THEN '# Title ' || doc_id || chr(10) || chr(10) ELSE '' END
  || CASE WHEN doc_id % 10 = 9 THEN '' ELSE text END
  || repeat('�', CAST(CASE WHEN doc_id % 4 = 0 THEN doc_id % 9 ELSE 0 END AS INTEGER)) AS markdown,
  CASE WHEN doc_id % 5 = 0 THEN CAST(25000 AS BIGINT) ELSE length(text) END AS input_bytes,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 50 AS INTEGER) END AS pages
FROM documents""")
view("cuts", """
SELECT *, CAST(event_id // 64 AS BIGINT) AS block, event_id % 64 AS slot, 1 + (event_id // 64) * 7 % 62 AS cut FROM events""")
view("pdf_pages", """
SELECT block * 2 + CASE WHEN slot >= cut THEN 1 ELSE 0 END AS pdf_id,
  slot - CASE WHEN slot >= cut THEN cut ELSE 0 END AS page_no,
  CASE WHEN event_type IN ('error', 'click', 'view') THEN 0 ELSE CAST(floor(value * 10) AS INTEGER) END AS chars,
  CASE WHEN event_id % 640 < 64 THEN 0.0::DOUBLE ELSE 612.0::DOUBLE END * 792.0::DOUBLE AS pixels
FROM cuts""", "cuts")
view("sample_plan", """
SELECT DISTINCT pdf_id, n AS page_count,
  CASE WHEN k = 1 THEN 0 ELSE CAST(round_even(i * ((n - 1)::DOUBLE / (k - 1)::DOUBLE), 0) AS BIGINT) END AS page_no
FROM (SELECT pdf_id, n, k, unnest(range(k)) AS i
      FROM (SELECT pdf_id, count(*) AS n, least(8, count(*)) AS k FROM pdf_pages GROUP BY pdf_id))""", "pdf_pages")
view("flavours", """
SELECT pdf_id, CASE WHEN px <= 0 THEN 'unknown' WHEN text_pages / sampled_pages >= 0.4::DOUBLE THEN 'text_native'
    ELSE 'scanned' END AS flavour,
  sampled_pages, CASE WHEN px > 0 THEN round(chars / px, 9) END AS char_pixel_ratio,
  CASE WHEN px > 0 THEN round(text_pages / sampled_pages, 6) END AS text_page_ratio
FROM (SELECT pdf_id, count(*) AS sampled_pages, sum(chars)::DOUBLE AS chars, sum(pixels) AS px,
        count(*) FILTER (pixels > 0 AND chars / pixels >= 1e-4::DOUBLE)::DOUBLE AS text_pages
      FROM sample_plan JOIN pdf_pages USING (pdf_id, page_no) GROUP BY pdf_id)""", "sample_plan", "pdf_pages")
view("wanted", """
SELECT v.*, f.flavour, CASE WHEN v.file_id % 31 = 0 THEN 'pandoc' WHEN v.file_id % 37 = 0 THEN 'unlisted' END AS override
FROM validated v LEFT JOIN flavours f ON f.pdf_id + 1000000 = v.file_id""", "validated", "flavours")
view("targeted", """
SELECT *, CASE extension WHEN '.epub' THEN 'epub' WHEN '.docx' THEN 'docx' WHEN '.html' THEN 'html' WHEN '.txt' THEN 'txt'
    WHEN '.pdf' THEN CASE WHEN flavour = 'scanned' THEN 'pdf_scanned' ELSE 'pdf_native' END END AS target
FROM wanted""", "wanted")
view("chosen", """
SELECT *, coalesce(override, CASE target WHEN 'epub' THEN 'pandoc' WHEN 'pdf_native' THEN 'pymupdf'
    WHEN 'pdf_scanned' THEN 'ocr' WHEN 'docx' THEN 'markitdown' WHEN 'html' THEN 'markitdown'
    WHEN 'txt' THEN 'markitdown' END) AS converter_name
FROM targeted""", "targeted")
view("routed", """
SELECT *, 'FormatNotSupportedError: ' ||
  CASE WHEN target IS NULL THEN 'no target format for extension ''' || extension || ''''
    WHEN converter_name NOT IN ('pandoc', 'pymupdf', 'markitdown', 'ocr', 'export-pdf', 'export-docx', 'export-epub')
      THEN 'converter ''' || converter_name || ''' is not registered (target_format=' || target || ')'
    WHEN NOT CASE converter_name WHEN 'pandoc' THEN extension = '.epub' WHEN 'markitdown' THEN
        extension IN ('.docx', '.html', '.txt') ELSE extension = '.pdf' END
      THEN 'converter ''' || converter_name || ''' does not support ''' || extension || ''' files' END AS route_error
FROM chosen""", "chosen")
view("file_events", """
SELECT event_id, ts, user_id AS job_id, user_id * 1000 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS file_id,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'start' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'OperationalError' WHEN 1 THEN 'ConnectionError' WHEN 2 THEN 'ConversionError'
    ELSE 'FormatNotSupportedError' END AS error_class,
  CAST(event_id % 5 AS INTEGER) AS attempt,
  CASE event_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'pandoc' ELSE 'markitdown' END AS converter,
  'output/' || user_id || '/' || event_id || '.md' AS output_path, event_id * 37 % 100000 AS size_bytes,
  CAST(event_id % 41 AS INTEGER) AS pages
FROM events""")
view("slots", """
SELECT e.*, CAST(least(5, floor((epoch_us(ts) - low) * 6 / greatest(1, high - low + 1)) + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END)
  AS INTEGER) AS arrival
FROM file_events e, (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events)""", "file_events")
view("dirty_docs", """
SELECT doc_id AS file_id, CAST(floor(doc_id / 4) AS BIGINT) AS job_id,
  '<span id="c' || doc_id || '.xhtml"></span><svg a="1"><image/></svg>' || chr(10)
  || '<div class="k"><p>' || text || '</p></div>' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '<table class="t"><colgroup><col /></colgroup><tbody><tr><td><p>✅ ' || lang
       || '</p><p>' || source || '</p></td></tr></tbody></table>'
     ELSE '<table><tbody><tr><td><p>plain</p></td></tr><tr><td>b</td></tr></tbody></table>' END || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '<div class="class_sM3"><span>one</span> <span>two</span></div>'
     ELSE '### <span class="x">orphan' END || chr(10)
  || '<a href="#c1.xhtml">toc</a> <a href="https://example.org/' || doc_id
  || '">ext</a> <a name="q">other</a> [md](#c2.xhtml_a)' || chr(10)
  || '<img src="d/' || (doc_id % 5) || '_media/f' || (doc_id % 3) || '.png" alt="A"/><img class="none"/>' || chr(10)
  || '<strong>b</strong><em>i</em><code>c</code><br/><hr/><sup>1</sup>   ' || chr(10) || chr(10) || chr(10) || chr(10)
  || CASE WHEN doc_id % 11 = 0 THEN '<se<sup>ction>' ELSE '' END || 'end' AS text
FROM documents""")
view("container_docs", f"""
SELECT doc_id AS file_id, 'box ' || doc_id || CASE doc_id % 6 WHEN 2 THEN '.docx' WHEN 3 THEN '.docx' WHEN 4 THEN '.txt'
    ELSE '.epub' END AS original_filename,
  CASE doc_id % 6 WHEN 3 THEN '00' || hex('[Content_Types].xml') || hex(text)
    ELSE '00' || hex(text) || CASE doc_id % 6 WHEN 1 THEN '{R.archive("notes.txt")}'
      WHEN 2 THEN '{R.archive("[Content_Types].xml")}'
      WHEN 5 THEN '{R.archive("META-INF/container.xml", ended=False)}'
      ELSE '{R.archive("META-INF/container.xml")}' END END AS bytes_hex
FROM documents""")


# -- the cleaner as a chain of CTEs -------------------------------------------------------------

_CALLOUT = " OR ".join(f"starts_with(ps[1], {q(e)})" for e in R.CALLOUTS)


def _paragraph_list(cell: str) -> str:
    return (
        f"list_filter(list_transform({found(cell, R.PARAGRAPH, 1)}, lambda p: {strip('p')}), lambda p: p <> '')"
    )


def _callout(match: str) -> str:
    ps = _paragraph_list(f"regexp_extract({match}, {re2(R.SINGLE_CELL)}, 1)")
    is_callout = _CALLOUT.replace("ps[1]", f"({ps})[1]")
    return (
        f"CASE WHEN len({ps}) = 0 THEN {match} WHEN {is_callout} THEN '> **' || ({ps})[1] || '**' || "
        f"array_to_string(list_transform(({ps})[2:], lambda p: chr(10) || '>' || chr(10) || '> ' || p), '') || chr(10) "
        f"ELSE array_to_string({ps}, chr(10) || chr(10)) || chr(10) END"
    )


def _spans(body: str) -> str:
    return (
        f"list_filter(list_transform({found(body, R.SPAN, 1)}, lambda s: {strip('s')}), lambda s: s <> '')"
    )


def _quoted(body: str) -> str:
    return (
        f"CASE WHEN len({_spans(body)}) = 0 THEN '' ELSE "
        f"array_to_string(list_transform({_spans(body)}, lambda s: '> ' || s), chr(10)) || chr(10) END"
    )


def _paragraph(body: str) -> str:
    return f"CASE WHEN {strip(body)} = '' THEN '' ELSE {strip(body)} || chr(10) || chr(10) END"


def _image(attrs: str) -> str:
    src = f"regexp_extract({attrs}, {re2(R.IMAGE_SOURCE)}, 1)"
    return f"CASE WHEN {src} = '' THEN '' ELSE '![' || regexp_extract({attrs}, {re2(R.IMAGE_TEXT)}, 1) || '](' || {src} || ')' END"


SOURCE = "<source>"


def _stage(new_text: str, **counters: str) -> str:
    added = "".join(f", {sql} AS {name}" for name, sql in counters.items())
    return f"SELECT * REPLACE ({new_text} AS text){added} FROM {SOURCE}"


def _steps(*rules: tuple[str, str]) -> str:
    text = "text"
    for pattern, replacement in rules:
        text = sub(text, pattern, replacement)
    return text


_DIV_OPEN, _DIV_CLOSE = R.opens("div"), R.closes("div")
_RESIDUAL_FIRST = _steps(
    (R.LINE_BREAK, NL), (R.RULE, "chr(10) || chr(10) || '---' || chr(10) || chr(10)"), (R.STRONG, "'**'"),
    (R.EMPHASIS, "'*'"), (R.CODE, "'`'"),
)
_A2 = sub("text", R.CHAPTER_ANCHOR, "'\\1'")
_A3 = sub(_A2, R.WEB_ANCHOR, "'[\\2](\\1)'")
_A4 = sub(_A3, R.ANY_ANCHOR, "'\\1'")
_NO_EMPTY = sub("text", R.EMPTY_SPAN, "''")
_TOKENS = f"regexp_extract_all({_NO_EMPTY}, {re2(R.SPAN_TAG)})"
_SIGNS = f"list_transform({_TOKENS}, lambda t: CASE WHEN starts_with(t, '</') THEN 1 ELSE -1 END)"
_CLOSES = f"len(list_filter({_TOKENS}, lambda t: starts_with(t, '</')))"
_PREFIXES = (
    f"list_transform(range(1, len({_TOKENS}) + 1), lambda i: list_sum(({_SIGNS})[1:i]))"
)
_PAIRS = f"({_CLOSES} - greatest(0, coalesce(list_max({_PREFIXES}), 0)))"
_WHITE = sub(sub("text", "[ \\t]+$", "''", "(?m)"), R.BLANK_LINES, "chr(10) || chr(10)")

STAGE_SQL = {
    "strip_svg": _stage(sub("text", R.SVG, "''"), svg_removed=count("text", R.SVG)),
    "convert_callouts": _stage(
        callback("text", R.SINGLE_CELL, 0, _callout),
        callouts_converted=(
            f"CAST(len(list_filter({found('text', R.SINGLE_CELL, 1)}, lambda c: coalesce("
            + _CALLOUT.replace("ps[1]", f"({_paragraph_list('c')})[1]") + ", false))) AS INTEGER)"
        ),
    ),
    "strip_table_scaffold": _stage(
        _steps((R.SCAFFOLD, "''"), (R.CELL_OPENS, "''"), (R.CELL_CLOSES, NL)),
        table_scaffold_removed=count("text", R.SCAFFOLD),
    ),
    "convert_quoted_div": _stage(
        callback("text", R.QUOTED, 1, _quoted),
        quoted_blocks_converted=(
            f"CAST(len(list_filter({found('text', R.QUOTED, 1)}, lambda b: len({_spans('b')}) > 0)) AS INTEGER)"
        ),
    ),
    "rewrite_anchors": _stage(
        sub(_A4, R.CHAPTER_LINK, "'\\1'"),
        xhtml_anchors_dropped=f"{count('text', R.CHAPTER_ANCHOR)} + {count(_A4, R.CHAPTER_LINK)}",
        external_anchors_converted=count(_A2, R.WEB_ANCHOR),
        other_anchors_stripped=count(_A3, R.ANY_ANCHOR),
    ),
    "strip_spans": _stage(
        sub(_NO_EMPTY, R.SPAN_TAG, "''"),
        empty_spans_removed=count("text", R.EMPTY_SPAN),
        spans_removed=f"CAST({_PAIRS} AS INTEGER)",
        orphan_span_tags_removed=f"CAST(len({_TOKENS}) - 2 * {_PAIRS} AS INTEGER)",
    ),
    "unwrap_paragraphs": _stage(
        callback("text", R.PARAGRAPH, 1, _paragraph), paragraphs_unwrapped=count("text", R.PARAGRAPH)
    ),
    "strip_divs": _stage(
        _steps((_DIV_OPEN, "''"), (_DIV_CLOSE, "''")),
        divs_removed=f"{count('text', _DIV_OPEN)} + {count('text', _DIV_CLOSE)}",
    ),
    "convert_img_tags": _stage(
        callback("text", R.IMAGE, 1, _image),
        img_tags_converted=(
            f"CAST(len(list_filter({found('text', R.IMAGE, 1)}, lambda a: regexp_matches(a, {re2(R.IMAGE_SOURCE)}))) AS INTEGER)"
        ),
    ),
    "strip_residual_html": _stage(
        sub(_RESIDUAL_FIRST, R.WRAPPER, "''"),
        residual_html_tags_removed=count(_RESIDUAL_FIRST, R.WRAPPER),
    ),
    "rewrite_image_paths": _stage(
        sub("text", R.MEDIA_PATH, "'media/\\3'"),
        image_paths_rewritten=count("text", R.MEDIA_PATH),
        media_dir_old=(
            f"(SELECT d FROM (SELECT unnest(l) AS d, generate_subscripts(l, 1) AS i FROM "
            f"(SELECT {found('text', R.MEDIA_PATH, 2)} AS l)) GROUP BY d ORDER BY count(*) DESC, min(i) LIMIT 1)"
        ),
    ),
    "normalise_whitespace": _stage(f"{strip(_WHITE)} || chr(10)"),
}


def clean_chain(source: str, name: str) -> list[tuple[str, str]]:
    """CTEs that clean the ``text`` column of ``source``; the last one is called ``name``."""
    steps, previous = [], source
    for i, sql in enumerate(STAGE_SQL.values()):
        steps.append((f"{name}_{i}", sql.replace(SOURCE, previous)))
        previous = f"{name}_{i}"
    steps.append((name, f"SELECT *, CASE WHEN media_dir_old IS NOT NULL THEN 'media' END AS media_dir_new FROM {previous}"))
    return steps


_LINKED = "'[\\4](\\1\\2\\3)'"
_NAMED = f"MAP {{{', '.join(f'{q(name)}: {q(char)}' for name, char in R.ENTITIES.items())}}}"


def entity(name: str) -> str:
    """Character of an entity; unknown names stay. Numbers of the corpus are plain characters."""
    number = f"CASE WHEN lower({name}[2]) = 'x' THEN CAST('0x' || {name}[3:] AS INTEGER) ELSE CAST({name}[2:] AS INTEGER) END"
    return (
        f"CASE WHEN {name}[1] = '#' THEN chr({number}) ELSE coalesce({_NAMED}[{name}], '&' || {name} || ';') END"
    )


def html_chain(source: str, name: str) -> list[tuple[str, str]]:
    """CTEs that turn the ``html`` column into ``title`` and ``text``."""
    gone = "html"
    for tags in (
        R.opens("script") + ".*?" + R.closes("script"), R.opens("style") + ".*?" + R.closes("style"),
        "<!--.*?-->", R.opens("title") + ".*?" + R.closes("title"),
    ):
        gone = sub(gone, tags, "''")
    blank = "chr(10) || chr(10)"

    def decoded(text: str) -> str:
        return callback(text, R.ENTITY, 1, entity)

    marks = "text"
    for level in range(1, 7):
        marks = sub(marks, f"<[hH]{level}{R.ATTRIBUTES}>", f"{blank} || '{'#' * level} '")
    lists = marks
    for pattern, replacement in (
        ("</[hH][1-6]>", blank), (R.opens("li"), "chr(10) || '- '"), (R.LINE_BREAK, NL),
        (R.RULE, f"{blank} || '---' || {blank}"), (R.STRONG, "'**'"), (R.EMPHASIS, "'*'"), (R.CODE, "'`'"),
    ):
        lists = sub(lists, pattern, replacement)
    bare = sub(sub("text", R.BLOCKS, blank), R.OTHER_TAG, "''")
    return [
        (f"{name}_0", f"SELECT *, {decoded(strip(f'regexp_extract(html, {re2(R.TITLE)}, 1)'))} AS title, {gone} AS text FROM {source}"),
        (f"{name}_1", f"SELECT * REPLACE ({sub('text', R.LINK, _LINKED)} AS text) FROM {name}_0"),
        (f"{name}_2", f"SELECT * REPLACE ({lists} AS text) FROM {name}_1"),
        (f"{name}_3", f"SELECT * REPLACE ({callback('text', R.IMAGE, 1, _image)} AS text) FROM {name}_2"),
        (f"{name}_4", f"SELECT * REPLACE ({decoded(bare)} AS text) FROM {name}_3"),
        (name, f"SELECT * REPLACE ({strip(_WHITE)} AS text) FROM {name}_4"),
    ]


def _chain(steps: list[tuple[str, str]], *needs: str) -> None:
    """Register a chain; each step needs the one before."""
    for name, sql in steps:
        view(name, sql, *needs)
        needs = (name,)


_chain(clean_chain("dirty_docs", "cleaned"), "dirty_docs")
view("page_texts", "SELECT page_id, html AS text FROM pages")
_chain(clean_chain("page_texts", "cleaned_pages"), "page_texts")
view("page_html", "SELECT page_id, html FROM pages")
_chain(html_chain("page_html", "converted"), "page_html")
_chain(clean_chain("converted", "scored_pages"), "converted")
view("doc_texts", f"SELECT doc_id, {strip('text')} AS text FROM documents")
_chain(clean_chain("doc_texts", "cleaned_texts"), "doc_texts")
view("upload_html", """
SELECT *, error_class IS NULL AND route_error IS NULL AS convertible,
  CASE WHEN error_class IS NULL AND route_error IS NULL AND extension = '.html' THEN content ELSE '' END AS html
FROM routed""", "routed")
_chain(html_chain("upload_html", "upload_converted"), "upload_html")
view("upload_texts", f"""
SELECT * REPLACE (CASE WHEN extension = '.html' THEN text WHEN convertible AND extension = '.txt' THEN {strip('content')}
  ELSE '' END AS text) FROM upload_converted""", "upload_converted")
view("upload_marked", "SELECT *, text = '' AS is_empty FROM upload_texts", "upload_texts")
_chain(clean_chain("upload_marked", "upload_cleaned"), "upload_marked")
_before, _after = R.NO_DECODER
view("upload_results", f"""
SELECT *, CASE WHEN file_id % 3 = 0 THEN ['note ' || file_id, 'missing image'] ELSE []::VARCHAR[] END AS log,
  CASE WHEN error_class IS NOT NULL THEN error_class || ': ' || error_message
    WHEN route_error IS NOT NULL THEN route_error
    WHEN extension NOT IN ('.html', '.txt') THEN {q(_before)} || extension || {q(_after)}
    WHEN is_empty THEN {q(R.EMPTY_OUTPUT)} END AS error
FROM upload_cleaned""", "upload_cleaned")


# -- quality --------------------------------------------------------------------------------------


def quality_cte(source: str, markdown: str, input_bytes: str, pages: str) -> str:
    """Signals, score, level and warnings beside the source's columns."""
    signals = f"""
SELECT * EXCLUDE ({'pages' if pages == 'pages' else 'no_pages'}{', input_bytes' if input_bytes == 'input_bytes' else ''}),
  CAST({input_bytes} AS BIGINT) AS input_bytes, CAST(length({strip(markdown)}) AS INTEGER) AS chars,
  {count(markdown, R.HEADING_START, '(?m)')} AS heading_count,
  CAST(length({markdown}) - length(replace({markdown}, '�', '')) AS INTEGER) AS replacement_count,
  CAST(coalesce({pages}, 0) AS INTEGER) AS pages
FROM {source}"""
    tiny, flat, bad = (
        "(input_bytes >= 20000 AND chars < 200)", "(chars >= 2000 AND heading_count = 0)", "(replacement_count > 0)"
    )
    return f"""
SELECT *, round(raw, 3) AS quality_score,
  CASE WHEN chars = 0 THEN 'low' WHEN raw >= 0.75::DOUBLE THEN 'high' WHEN raw >= 0.45::DOUBLE THEN 'medium'
    ELSE 'low' END AS quality_level,
  CASE WHEN chars = 0 THEN [{q(R.NO_TEXT)}] ELSE list_filter([
    CASE WHEN {tiny} THEN 'Output is suspiciously small (' || chars || ' chars) for a ' || (input_bytes // 1024)
      || ' KB source — extraction may be incomplete.' END,
    CASE WHEN {flat} THEN {q(R.NO_HEADING)} END,
    CASE WHEN {bad} THEN replacement_count || ' replacement character(s) present — the source may have an encoding problem.' END
  ], lambda w: w IS NOT NULL) END AS quality_warnings
FROM (SELECT *, CASE WHEN chars = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    ((1.0::DOUBLE - CASE WHEN {tiny} THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END)
    - CASE WHEN {flat} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
    - CASE WHEN {bad} THEN least(0.4::DOUBLE, 0.1::DOUBLE + 0.05::DOUBLE * replacement_count::DOUBLE) ELSE 0.0::DOUBLE END)) END AS raw
  FROM ({signals}))"""


view("assessed", quality_cte("quality_docs", "markdown", "input_bytes", "pages"), "quality_docs")
view("pages_ready", "SELECT *, NULL AS no_pages FROM scored_pages", "scored_pages")
view("pages_assessed", quality_cte("pages_ready", "text", "strlen(html)", "no_pages"), "pages_ready")
_REPORT = """
SELECT quality_level, count(*) AS documents, round(avg(quality_score), 6) AS mean_score,
  round(avg(round(quality_score * 100)), 4) AS mean_percent, min(quality_score) AS min_score, max(quality_score) AS max_score
FROM {} GROUP BY quality_level"""


def outline(source: str, keys: str, markdown: str) -> str:
    pattern = re2(R.HEADING, "(?m)")
    return f"""
SELECT {keys}, CAST(i AS INTEGER) AS position, CAST(length(marks[i]) AS INTEGER) AS level, heads[i] AS heading
FROM (SELECT {keys}, marks, heads, unnest(range(1, len(marks) + 1)) AS i FROM (
  SELECT {keys}, regexp_extract_all({markdown}, {pattern}, 1) AS marks,
    regexp_extract_all({markdown}, {pattern}, 2) AS heads FROM {source}))"""


# -- lifecycle ------------------------------------------------------------------------------------

view("statuses", """
SELECT j.job_id, j.target_format, j.stored_status, j.total_files, coalesce(t.succeeded, 0) AS succeeded,
  coalesce(t.failed, 0) AS failed, t.last_finished_at,
  CASE WHEN j.total_files <= 0 THEN 'pending' WHEN coalesce(succeeded, 0) + coalesce(failed, 0) < j.total_files THEN 'processing'
    WHEN coalesce(failed, 0) = 0 THEN 'done' WHEN coalesce(succeeded, 0) = 0 THEN 'failed' ELSE 'partial_success' END AS status
FROM jobs j LEFT JOIN (
  SELECT job_id, count(*) FILTER (status = 'done') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
    max(finished_at) FILTER (status IN ('done', 'failed')) AS last_finished_at
  FROM files GROUP BY job_id) t USING (job_id)""", "jobs", "files")
view("chunks", """
SELECT job_id, CAST((rn - 1) // 50 AS INTEGER) AS chunk, CAST(count(*) AS INTEGER) AS file_count,
  string_agg(concat_ws('|', file_id, job_id, original_filename, 'html', status, coalesce(converter_used, '-'), coalesce(output_path, '-'),
    size_bytes, pages, coalesce(error_message, '-'), warning_text, CAST(round(quality_score * 100) AS BIGINT), quality_level, created_day),
    chr(10) ORDER BY file_id) AS files
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY file_id) AS rn FROM files) GROUP BY ALL""", "files")
view("ready", """
SELECT job_id, file_id, output_path, regexp_replace(original_filename, '[.]html$', '') AS stem,
  regexp_extract(output_path, '([.][a-z]+)$', 1) AS ext, row_number() OVER (PARTITION BY job_id ORDER BY file_id) AS rn
FROM files WHERE output_path IS NOT NULL""", "files")
# File after file: the first of its name, name-2, name-3, ... that no file before has taken.
view("bundles", """
WITH RECURSIVE named AS (
  SELECT job_id, file_id, output_path, rn, stem || ext AS member_name, [stem || ext] AS used FROM ready WHERE rn = 1
  UNION ALL
  SELECT job_id, file_id, output_path, rn, member_name, list_append(used, member_name) FROM (
    SELECT r.job_id, r.file_id, r.output_path, r.rn, n.used, list_filter(
      list_transform(range(1, r.rn + 1), lambda k: r.stem || CASE WHEN k = 1 THEN '' ELSE '-' || k END || r.ext),
      lambda c: NOT list_contains(n.used, c))[1] AS member_name
    FROM named n JOIN ready r ON r.job_id = n.job_id AND r.rn = n.rn + 1))
SELECT job_id, file_id, output_path, member_name FROM named""", "ready")
_MEDIA = """CASE regexp_extract(output_path, '([.][a-z]+)$', 1) WHEN '.md' THEN 'text/markdown; charset=utf-8'
  WHEN '.pdf' THEN 'application/pdf' WHEN '.epub' THEN 'application/epub+zip' WHEN '.docx' THEN
  'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END"""
_HUMAN = """CASE WHEN bytes < 1024 THEN bytes || ' B'
  WHEN bytes < 1048576 THEN printf('%.1f', round(bytes / 1024, 1)) || ' KB'
  WHEN bytes < 1073741824 THEN printf('%.1f', round(bytes / 1048576, 1)) || ' MB'
  ELSE printf('%.2f', round(bytes / 1073741824, 2)) || ' GB' END"""


def safe(name: str) -> str:
    kept = f"trim(regexp_replace({name}, '[^A-Za-z0-9._-]+', '_', 'g'), '._-')"
    return f"substr(CASE WHEN {kept} = '' THEN 'file' ELSE {kept} END, 1, 200)"


_STEM = r"regexp_replace(original_filename, '\.[^.]+$', '')"
_STORED = f"md5(CAST(file_id AS VARCHAR)) || '_' || {safe(_STEM)}"
_LOG_LINE = "[\\r\\n\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def log_lines(log: str) -> str:
    return f"list_filter(string_split_regex({log}, {q(_LOG_LINE)}), lambda r: {strip('r')} <> '')"


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *needs: str) -> None:
    """Register a query with the views it needs, in dependency order."""
    ordered: dict[str, str] = {}

    def add(view_name: str) -> None:
        if view_name not in ordered:
            for need in VIEWS[view_name][0]:
                add(need)
            ordered[view_name] = VIEWS[view_name][1]

    for need in needs:
        add(need)
    ctes = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in ordered.items())
    ORACLES[name] = f"WITH {ctes}\n{sql}" if ctes else sql


UPLOAD = "file_id, job_id, original_filename"
oracle("corpus_manifest", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '.parquet' AS extension, true AS has_bytes, count(*) AS rows FROM {name}"
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations")))
oracle("corpus_file_scan", """SELECT 'input/' || file_id || '/' || original_filename AS path, original_filename, extension,
  mime_type, size_bytes FROM sniffed WHERE size_bytes <= 200000""", "sniffed")
_HEADS = (
    (11, "text/rtf"), (8, "application/gzip"), (12, "image/png"), (10, "image/jpeg"), (10, "application/x-ole-storage"),
    (8, "text/plain"), (8, "text/plain"), (12, "image/gif"), (8, "application/x-7z-compressed"), (12, "application/x-dosexec"),
    (4, "application/postscript"), (8, "image/tiff"), (5, "application/octet-stream"),
    (64, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"))
oracle("sniff_signatures", f"""
SELECT *, CASE WHEN mime_type <> 'text/plain' OR original_filename LIKE '%.pdf' THEN 'MimeTypeMismatchError' END AS error_class
FROM (SELECT doc_id AS file_id, 'file ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.pdf' END AS original_filename,
  {[mime for _, mime in _HEADS]}[doc_id % {len(_HEADS)} + 1] AS mime_type,
  {[size for size, _ in _HEADS]}[doc_id % {len(_HEADS)} + 1] + strlen(text) AS size_bytes FROM documents)""")
oracle("dead_letter_sink", f"SELECT {UPLOAD}, error_class || ': ' || error_message AS error FROM validated WHERE error_class IS NOT NULL", "validated")
oracle("delete_stored", "SELECT job_id, file_id FROM files WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE stored_status = 'done')", "files", "jobs")
oracle("unreferenced_files", f"""
SELECT place AS path, 'missing' AS finding FROM (SELECT file_id, 'input/' || {_STORED} || extension AS place FROM sniffed) WHERE file_id % 7 = 0
UNION ALL SELECT place || '.bak', 'unreferenced'
FROM (SELECT file_id, 'input/' || {_STORED} || extension AS place FROM sniffed) WHERE file_id % 11 = 0 AND file_id % 7 <> 0""", "sniffed")
oracle("corpus_sniff_scan", f"SELECT {UPLOAD}, extension, mime_type, size_bytes FROM sniffed", "sniffed")
oracle("jobs_scan", "SELECT * FROM jobs", "jobs")
oracle("write_markdown", f"""SELECT file_id, job_id, 'output/' || job_id || '/' || {_STORED} || '.md' AS output_path,
  strlen(text) AS output_bytes FROM upload_results WHERE error IS NULL""", "upload_results")
oracle("bundle_manifest", f"SELECT job_id, file_id, member_name, output_path, {_MEDIA} AS media_type FROM bundles", "bundles")
oracle("dead_letter", f"SELECT {UPLOAD}, error_class || ': ' || error_message AS error FROM validated WHERE error_class IS NOT NULL", "validated")
oracle("detect_format", f"SELECT {UPLOAD}, extension, mime_type, size_bytes, error_class, error_message FROM validated", "validated")
oracle("reject_unsupported_ext", f"SELECT {UPLOAD}, extension FROM sniffed WHERE extension NOT IN ('.epub','.pdf','.docx','.html','.txt')", "sniffed")
oracle("accept_supported_ext", f"SELECT {UPLOAD}, extension FROM sniffed WHERE extension IN ('.epub','.pdf','.docx','.html','.txt')", "sniffed")


def _record(entry: str) -> str:
    """Directory record of an entry followed later by an end record, in hex digits."""
    return (
        "504B0102(?:[0-9A-F]{48})" + f"{len(entry):02X}00" + "(?:[0-9A-F]{32})"
        + entry.encode().hex().upper() + "(?:[0-9A-F]*)504B0506"
    )


oracle("container_rescue", f"""
SELECT file_id, original_filename,
  CASE WHEN ok THEN CASE extension WHEN '.epub' THEN 'application/epub+zip' ELSE '{R.DOCX}' END
    ELSE 'application/octet-stream' END AS mime_type,
  length(bytes_hex) // 2 AS size_bytes, CASE WHEN NOT ok THEN 'MimeTypeMismatchError' END AS error_class
FROM (SELECT *, CASE extension WHEN '.epub' THEN regexp_matches(bytes_hex, '{_record("META-INF/container.xml")}')
    WHEN '.docx' THEN regexp_matches(bytes_hex, '{_record("[Content_Types].xml")}') ELSE false END AS ok
  FROM (SELECT *, regexp_extract(original_filename, '([.][a-z]+)$', 1) AS extension FROM container_docs))""", "container_docs")
oracle("reject_oversized", f"SELECT {UPLOAD}, size_bytes FROM sniffed WHERE size_bytes > 8192", "sniffed")
view("directed", _verdict("sniffed", "CASE WHEN job_id % 8 < 3 THEN 'export' ELSE 'import' END"), "sniffed")
oracle("validate_by_direction", f"SELECT {UPLOAD}, direction, extension, mime_type, {_ERROR} AS error_class FROM directed", "directed")
oracle("invalid_target_format", "SELECT job_id, 'rtf' AS target_format FROM jobs WHERE job_id % 97 = 0", "jobs")
oracle("batch_limits", """
SELECT job_id, coalesce(n, 0) AS files, CAST(coalesce(b, 0) AS BIGINT) AS bytes,
  CASE WHEN coalesce(n, 0) = 0 THEN 'no files' WHEN n > 6 THEN 'too many files' WHEN b > 200000 THEN 'job too large' END AS limit_error
FROM jobs LEFT JOIN (SELECT job_id, count(*) AS n, sum(coalesce(size_bytes, 0)) AS b FROM files GROUP BY job_id) USING (job_id)""",
    "jobs", "files")
oracle("atomic_job_accept", f"""
SELECT {UPLOAD}, extension, size_bytes FROM validated
WHERE job_id NOT IN (SELECT job_id FROM validated WHERE error_class IS NOT NULL)""", "validated")
oracle("path_containment", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/etc/' || doc_id WHEN 1 THEN 'a/../b/' || doc_id WHEN 2 THEN 'a/../../' || doc_id
    WHEN 3 THEN './input//' || doc_id || '/.' WHEN 4 THEN 'output/' || doc_id || '/x.md' ELSE '../' || doc_id END AS path,
  CASE doc_id % 6 WHEN 0 THEN 'absolute' WHEN 2 THEN 'escapes' WHEN 5 THEN 'escapes' ELSE 'contained' END AS verdict
FROM documents""")
oracle("dedupe_staged", """
SELECT file_id, job_id, original_filename, size_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, original_filename, size_bytes ORDER BY file_id) AS rn FROM (
    SELECT file_id, job_id, original_filename, size_bytes FROM sniffed
    UNION ALL SELECT file_id + 10000000, job_id, original_filename, size_bytes FROM sniffed WHERE file_id % 3 = 0))
WHERE rn = 1""", "sniffed")
oracle("stored_names", f"""
SELECT {UPLOAD}, stored_filename, 'input/' || stored_filename AS storage_path
FROM (SELECT *, {_STORED} || extension AS stored_filename FROM sniffed)""", "sniffed")
oracle("route_files", f"SELECT {UPLOAD}, extension, flavour, target, converter_name, route_error FROM routed", "routed")
oracle("route_export", """
SELECT job_id, target_format, CASE WHEN target_format <> 'markdown' THEN 'export-' || target_format END AS converter_name,
  CASE WHEN target_format = 'markdown' THEN 'FormatNotSupportedError: unsupported export target ''markdown''' END AS route_error
FROM jobs""", "jobs")
oracle("pdf_flavour", "SELECT * FROM flavours", "flavours")
oracle("pdf_sample_plan", "SELECT * FROM sample_plan", "sample_plan")
oracle("quality_signals", "SELECT file_id, input_bytes, pages, chars, heading_count, replacement_count FROM assessed", "assessed")
oracle("quality_score", "SELECT file_id, quality_score FROM assessed", "assessed")
oracle("quality_level", "SELECT file_id, quality_score, quality_level FROM assessed", "assessed")
oracle("quality_warnings", "SELECT file_id, array_to_string(quality_warnings, chr(10)) AS quality_warnings FROM assessed", "assessed")
oracle("quality_skip_export", """
SELECT file_id, job_id, target_format, CASE WHEN target_format = 'markdown' THEN round(quality_score, 3) END AS quality_score,
  CASE WHEN target_format = 'markdown' THEN quality_level END AS quality_level FROM files JOIN jobs USING (job_id)""", "files", "jobs")
oracle("quality_report", _REPORT.format("""(
  SELECT quality_level, quality_score FROM pages_assessed UNION ALL SELECT quality_level, quality_score FROM assessed)"""),
    "pages_assessed", "assessed")
oracle("quality_docs_report", _REPORT.format("assessed"), "assessed")
oracle("conversion_report", """
SELECT converter_used, count(*) AS files, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
  round(avg(size_bytes), 4) AS mean_size, CAST(sum(warning_count) AS BIGINT) AS warnings FROM files GROUP BY converter_used""", "files")
for _name, _sql in STAGE_SQL.items():
    oracle(_name, _sql.replace(SOURCE, "dirty_docs"), "dirty_docs")
COUNTERS = (
    "svg_removed, callouts_converted, table_scaffold_removed, quoted_blocks_converted, xhtml_anchors_dropped, "
    "external_anchors_converted, other_anchors_stripped, empty_spans_removed, spans_removed, orphan_span_tags_removed, "
    "paragraphs_unwrapped, divs_removed, img_tags_converted, residual_html_tags_removed, image_paths_rewritten"
)
oracle("clean_corpus", f"SELECT file_id, job_id, text, {COUNTERS}, media_dir_old, media_dir_new FROM cleaned", "cleaned")
oracle("clean_pages", f"SELECT page_id, text AS html, {COUNTERS}, media_dir_old, media_dir_new FROM cleaned_pages", "cleaned_pages")
oracle("clean_stats_report", "SELECT count(*) AS documents, " + ", ".join(
    f"CAST(sum({name}) AS BIGINT) AS {name}" for name in COUNTERS.split(", ")) + " FROM cleaned", "cleaned")
oracle("media_rename_plan", """
SELECT job_id, file_id, media_dir_old, media_dir_new, count(*) OVER (PARTITION BY job_id) > 1 AS collision
FROM cleaned WHERE media_dir_old IS NOT NULL""", "cleaned")
oracle("residual_html_audit", f"SELECT file_id FROM cleaned WHERE regexp_matches(text, {re2(R.LEFT_OVER)})", "cleaned")
view("once_texts", "SELECT file_id, text AS once, text FROM cleaned", "cleaned")
_chain(clean_chain("once_texts", "cleaned_twice"), "once_texts")
oracle("clean_idempotence_audit", "SELECT file_id, once, text FROM cleaned_twice WHERE once <> text", "cleaned_twice")
oracle("html_to_markdown", "SELECT page_id, title, text AS markdown FROM converted", "converted")
_LINE = f"""{strip("'x ' || regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')")}"""
oracle("html_blocks", f"""
SELECT doc_id, '1. ' || doc_id || n || '   - ' || lang || n || '2. ' || line || n || n || '> ' || source || n || '>' || n || '> > ' || line
  || n || n || '| id | text |' || n || '| --- | --- |' || n || '| ' || doc_id || ' | **b** ' || replace(line, '|', '\\|') || ' |'
  || n || n || '```' || n || doc_id || n || n || n || line || n || '```' AS markdown
FROM (SELECT *, chr(10) AS n, {_LINE} AS line FROM documents)""")
oracle("text_to_markdown", "SELECT doc_id, text AS markdown FROM cleaned_texts", "cleaned_texts")
oracle("convert_corpus", f"""
SELECT {UPLOAD}, converter_name, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN error IS NULL THEN strlen(text) END AS output_bytes, error, CASE WHEN error IS NULL THEN text END AS markdown,
  CASE WHEN error IS NULL THEN array_to_string(log, chr(10)) END AS warnings
FROM upload_results""", "upload_results")
oracle("reject_empty_output", f"""
SELECT page_id AS file_id FROM converted WHERE text = ''
UNION ALL SELECT file_id + 1000000 FROM quality_docs WHERE {strip('markdown')} = ''""", "converted", "quality_docs")
oracle("warning_lines", f"""
SELECT doc_id, CAST(len(kept) AS INTEGER) AS lines, CAST(len(exported) AS INTEGER) AS export_lines,
  array_to_string(exported, chr(10)) AS export_log
FROM (SELECT doc_id, kept, list_filter(kept, lambda r: NOT starts_with(r, 'WARNING:')) AS exported FROM (
  SELECT doc_id, {log_lines("replace(replace(text, chr(10), chr(10) || 'WARNING: '), '. ', '.' || chr(10)) || chr(10) || '   ' || chr(10) || '[WARNING] missing image'")} AS kept
  FROM documents))""")
oracle("heading_outline", outline(
    "(SELECT file_id, markdown FROM quality_docs UNION ALL SELECT page_id + 1000000, text FROM converted)",
    "file_id", "markdown"), "quality_docs", "converted")
_ASCII = "lower(regexp_replace(strip_accents(heading), '[^\\x00-\\x7f]+', '', 'g'))"
oracle("heading_slugs", f"""
SELECT *, trim(regexp_replace(regexp_replace(trim({_ASCII}, {q(WHITESPACE[:10])}), '[^A-Za-z0-9_\\s\\x0b\\x1c-\\x1f-]', '', 'g'),
  '[\\s\\x0b\\x1c-\\x1f_]+', '-', 'g'), '-') AS slug
FROM ({outline("converted", "page_id", "text")})""", "converted")
oracle("document_title", f"""
SELECT file_id, CASE WHEN t = '' THEN 'doc_' || file_id ELSE t END AS title
FROM (SELECT file_id, {strip(f"regexp_extract(markdown, {re2(R.FIRST_HEADING, '(?m)')}, 1)")} AS t FROM quality_docs)""", "quality_docs")
oracle("media_references", f"""
SELECT file_id, CAST(i AS INTEGER) AS position, d[i] AS media_folder, f[i] AS media_file, 'media/' || f[i] AS new_path
FROM (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM (
  SELECT file_id, {found('text', R.MEDIA_PATH, 2)} AS d, {found('text', R.MEDIA_PATH, 3)} AS f FROM dirty_docs))""", "dirty_docs")
_B2 = sub(_A2, R.WEB_ANCHOR, "'\\2'")
_B3 = sub(_B2, R.ANY_ANCHOR, "'\\1'")
oracle("link_inventory", f"""
SELECT file_id, kind, links FROM (
  SELECT file_id, unnest(['internal', 'external', 'other']) AS kind, unnest([
    {count('text', R.CHAPTER_ANCHOR)} + {count(_B3, R.CHAPTER_LINK)}, {count(_A2, R.WEB_ANCHOR)}, {count(_B2, R.ANY_ANCHOR)}]) AS links
  FROM (SELECT page_id AS file_id, html AS text FROM pages UNION ALL SELECT file_id + 1000000, text FROM dirty_docs))
WHERE links > 0""", "dirty_docs")
oracle("job_status", "SELECT job_id, total_files, succeeded, failed, status FROM statuses", "statuses")
oracle("job_terminal_fields", """
SELECT job_id, status, CASE WHEN status IN ('done', 'failed', 'partial_success') THEN last_finished_at END AS completed_at,
  CASE WHEN status IN ('failed', 'partial_success') THEN failed || ' of ' || total_files || ' file(s) failed to convert' END AS error_message
FROM statuses""", "statuses")
oracle("job_progress", """
SELECT job_id, succeeded + failed AS processed_files, total_files, (succeeded + failed) || '/' || total_files AS progress FROM statuses""", "statuses")
_STATE = "CASE kind WHEN 'queued' THEN 'pending' WHEN 'start' THEN 'processing' WHEN 'complete' THEN 'done' ELSE 'failed' END"
oracle("file_state", f"""
SELECT job_id, file_id, {_STATE} AS status, ts AS changed_at, error_class_last AS error_class, n AS events,
  completed.converter AS converter, completed.output_path AS output_path, completed.size_bytes AS size_bytes, completed.pages AS pages
FROM (SELECT *,
    max_by({{'converter': converter, 'output_path': output_path, 'size_bytes': size_bytes, 'pages': pages}}, (ts, event_id))
      FILTER (kind = 'complete') OVER (PARTITION BY file_id) AS completed, row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) AS rn,
    count(*) OVER (PARTITION BY file_id) AS n,
    max_by(error_class, (ts, event_id)) FILTER (kind = 'fail') OVER (PARTITION BY file_id) AS error_class_last FROM file_events)
WHERE rn = 1""", "file_events")
view("told", """
SELECT j.created_at, s.job_id, s.target_format, s.status, s.total_files, s.succeeded + s.failed AS processed_files,
  CASE WHEN s.status IN ('done', 'failed', 'partial_success') THEN s.last_finished_at END AS completed_at,
  CASE WHEN s.status IN ('failed', 'partial_success') THEN s.failed || ' of ' || s.total_files || ' file(s) failed to convert' END AS error_message
FROM statuses s JOIN jobs j USING (job_id)""", "statuses", "jobs")
_TOLD = """SELECT t.*, coalesce(chunk, 0) AS chunk, coalesce(file_count, 0) AS file_count, coalesce(files, '') AS files
FROM {} t LEFT JOIN chunks USING (job_id)"""
oracle("list_jobs", _TOLD.format("(SELECT * FROM told ORDER BY created_at DESC NULLS LAST, job_id LIMIT 20 OFFSET 20)"), "told", "chunks")
oracle("job_detail", _TOLD.format("told"), "told", "chunks")
oracle("delete_cascade", "SELECT job_id, file_id FROM files WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE stored_status = 'done')", "files", "jobs")
oracle("delete_cleanup_paths", """
SELECT job_id, path FROM (
  SELECT job_id, storage_path AS path FROM files UNION ALL SELECT job_id, output_path FROM files WHERE output_path IS NOT NULL)
WHERE job_id IN (SELECT job_id FROM jobs WHERE stored_status = 'done') AND NOT starts_with(path, '../')""", "files", "jobs")
oracle("job_card", """
SELECT job_id, coalesce(first_name, 'Sans titre') AS title, greatest(coalesce(n, 0) - 1, 0) AS extra_files,
  CAST(coalesce(b, 0) AS BIGINT) AS total_bytes, CAST(coalesce(p, 0) AS BIGINT) AS total_pages, coalesce(c, '') AS converters
FROM jobs LEFT JOIN (SELECT job_id, min_by(original_filename, file_id) AS first_name, count(*) AS n, sum(size_bytes) AS b,
  sum(pages) AS p, string_agg(DISTINCT converter_used, ', ' ORDER BY converter_used) AS c FROM files GROUP BY job_id) USING (job_id)""",
    "jobs", "files")
oracle("bundle_names", "SELECT job_id, file_id, member_name FROM bundles", "bundles")
oracle("download_names", f"""
SELECT file_id, regexp_replace(original_filename, '[.]html$', '') || regexp_extract(output_path, '([.][a-z]+)$', 1) AS download_name,
  {_MEDIA} AS media_type FROM files WHERE output_path IS NOT NULL""", "files")
oracle("preview_availability", """
SELECT file_id, CASE WHEN output_path IS NULL THEN 'conflict' WHEN output_path LIKE '%.md' THEN 'available' ELSE 'unsupported' END AS preview
FROM files""", "files")
oracle("merge_warnings", f"""
SELECT file_id, CAST(len(w) AS INTEGER) AS warnings, CASE WHEN len(w) > 0 THEN array_to_string(w, chr(10)) END AS merged
FROM (SELECT file_id, list_concat(quality_warnings, {log_lines("regexp_replace(markdown, '[.] ', '.' || chr(10), 'g')")})[1:50] AS w FROM assessed)""", "assessed")
view("result_rows", f"""
SELECT file_id, job_id, 'output/' || job_id || '/' || {_STORED} || '.md' AS output_path, converter_name AS converter,
  target AS target_format, mime_type AS detected_mime, size_bytes AS in_bytes, strlen(text) AS out_bytes, text, log, NULL AS no_pages
FROM upload_results WHERE error IS NULL""", "upload_results")
view("results_assessed", quality_cte("result_rows", "text", "in_bytes", "no_pages"), "result_rows")
oracle("conversion_results", """
SELECT * REPLACE (array_to_string(warnings, chr(10)) AS warnings), to_json({'file_id': file_id, 'job_id': job_id,
  'output_path': output_path, 'converter': converter, 'target_format': target_format, 'detected_mime': detected_mime,
  'pages': pages, 'size_bytes': size_bytes, 'duration_seconds': duration_seconds, 'quality_score': quality_score, 'quality_level': quality_level,
  'warnings': warnings})::VARCHAR AS payload
FROM (SELECT file_id, job_id, output_path, converter, target_format, detected_mime, NULL::INTEGER AS pages,
  out_bytes AS size_bytes, file_id % 977 / 8 AS duration_seconds, quality_score, quality_level,
  list_concat(quality_warnings, log) AS warnings FROM results_assessed)""", "results_assessed")
oracle("active_jobs", "SELECT job_id, stored_status FROM jobs WHERE stored_status IN ('pending', 'processing')", "jobs")
oracle("retry_plan", """
SELECT event_id, file_id, error_class, attempt, ok AS retry, CASE WHEN ok THEN CAST(least(60, pow(2, attempt)) AS INTEGER) END AS delay_seconds
FROM (SELECT *, error_class IN ('OperationalError', 'InterfaceError', 'ConnectionError', 'TimeoutError') AND attempt < 3 AS ok
  FROM file_events WHERE kind = 'fail')""", "file_events")
oracle("time_limit_breaches", """
SELECT file_id, event_id, kind, run_micros, CASE WHEN converter = 'ocr' AND run_micros > 900000000 THEN 'ocr' WHEN run_micros > 360000000 THEN 'hard' ELSE 'soft' END AS "limit"
FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS run_micros, lag(kind) OVER w AS previous FROM file_events
  WINDOW w AS (PARTITION BY file_id ORDER BY ts, event_id))
WHERE kind IN ('complete', 'fail') AND previous = 'start' AND run_micros > 300000000""", "file_events")
oracle("result_expiry", """
SELECT event_id, file_id, kind FROM file_events WHERE kind IN ('complete', 'fail')
  AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""", "file_events")
oracle("backfill_status", """
SELECT file_id, CASE WHEN output_path IS NOT NULL THEN 'done' WHEN status = 'done' THEN 'pending' ELSE status END AS status FROM files""", "files")
oracle("staged_totals", f"""
SELECT *, {_HUMAN} AS readable FROM (SELECT job_id, count(*) AS files, CAST(sum(size_bytes * 37) AS BIGINT) AS bytes FROM files GROUP BY job_id)""", "files")
oracle("file_lookup_by_id", "SELECT file_id, job_id, target_format FROM files JOIN jobs USING (job_id)", "files", "jobs")
oracle("domain_violations", """
SELECT 'job_status' AS rule, CAST(job_id AS VARCHAR) AS row_id FROM jobs WHERE job_id % 89 = 0
UNION ALL SELECT 'target_format', CAST(job_id AS VARCHAR) FROM jobs WHERE job_id % 97 = 0
UNION ALL SELECT 'size_bytes', file_id FROM files WHERE size_bytes % 101 = 0
UNION ALL SELECT 'quality_score', file_id FROM files WHERE pages = 50
UNION ALL SELECT 'original_filename_missing', file_id FROM files WHERE size_bytes % 103 = 0
UNION ALL SELECT 'original_format_missing', file_id FROM files WHERE size_bytes % 107 = 0
UNION ALL SELECT 'stored_filename_missing', file_id FROM files WHERE size_bytes % 109 = 0""", "jobs", "files")
oracle("orphan_files", "SELECT file_id, job_id FROM files WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE stored_status <> 'processing')", "files", "jobs")
oracle("jobs_without_files", "SELECT job_id FROM jobs WHERE total_files = 0", "jobs")
oracle("counter_drift", """
SELECT *, concat_ws(',', CASE WHEN stored_status <> status THEN 'status' END, CASE WHEN total_files <> actual_files THEN 'total' END,
  CASE WHEN stored_processed <> processed_files THEN 'processed' END) AS drift
FROM (SELECT job_id, stored_status, status, total_files, total_files AS actual_files,
  CASE WHEN job_id % 5 > 0 THEN total_files ELSE 0 END AS stored_processed, succeeded + failed AS processed_files FROM statuses)
WHERE stored_status <> status OR total_files <> actual_files OR stored_processed <> processed_files""", "statuses")
oracle("unreferenced_outputs", """
SELECT storage_path AS path, 'missing' AS finding FROM files WHERE pages = 7
UNION ALL SELECT output_path, 'missing' FROM files WHERE output_path IS NOT NULL AND pages IN (9, 11)
UNION ALL SELECT output_path || '.bak', 'unreferenced' FROM files WHERE output_path IS NOT NULL AND pages = 11""", "files")
oracle("stream_clean", "SELECT page_id, title, text AS markdown, quality_score, quality_level FROM pages_assessed", "pages_assessed")
oracle("stream_dedupe", "SELECT event_id, job_id, file_id, kind FROM file_events", "file_events")
view("latest_states", f"""
SELECT job_id, file_id, {_STATE} AS status FROM file_events
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) = 1""", "file_events")
oracle("stream_job_status", """
SELECT *, CASE WHEN succeeded + failed < total_files THEN 'processing' WHEN failed = 0 THEN 'done' WHEN succeeded = 0 THEN 'failed'
  ELSE 'partial_success' END AS status
FROM (SELECT job_id, CAST(count(*) + CASE WHEN job_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS total_files,
  count(*) FILTER (status = 'done') AS succeeded, count(*) FILTER (status = 'failed') AS failed FROM latest_states GROUP BY job_id)""", "latest_states")
# A batch drops by the watermark of the batch before it, which is the newest event of earlier slots less an hour, in milliseconds.
oracle("stream_late_events", """
SELECT event_id, file_id, kind, arrival FROM slots
WHERE ts <= (SELECT make_timestamp(epoch_ms(max(e.ts)) * 1000) FROM slots e WHERE e.arrival < slots.arrival - 1) - INTERVAL 1 HOUR""", "slots")
oracle("stream_late_count", """
SELECT count(*) AS late_rows FROM slots
WHERE ts <= (SELECT make_timestamp(epoch_ms(max(e.ts)) * 1000) FROM slots e WHERE e.arrival < slots.arrival - 1) - INTERVAL 1 HOUR""", "slots")
# A minute is closed once the watermark, five minutes behind the newest event in milliseconds, is at its end.
oracle("rate_limit_alerts", """
SELECT * FROM (
  SELECT user_id AS client, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1)
WHERE minute + INTERVAL 1 MINUTE <= (SELECT make_timestamp(epoch_ms(max(ts)) * 1000) FROM events) - INTERVAL 5 MINUTE""")
oracle("stream_rate_limit", """
SELECT user_id AS client, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 1""")
# A start is reported once the watermark, ten minutes behind the slower of both sides, is past its limit.
oracle("stream_stuck_files", """
SELECT s.event_id, s.job_id, s.file_id, s.ts AS started_at FROM file_events s
WHERE s.kind = 'start' AND NOT EXISTS (SELECT 1 FROM file_events e WHERE e.file_id = s.file_id AND e.kind IN ('complete', 'fail')
    AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 360 SECOND)
  AND s.ts + INTERVAL 360 SECOND < (SELECT least(max(ts) FILTER (kind = 'start'), max(ts) FILTER (kind IN ('complete', 'fail')))
    FROM file_events) - INTERVAL 10 MINUTE""", "file_events")
