"""Small fixed lookup tables; all have at most a dozen rows, so broadcasting them is safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"

# MIME types accepted for each extension, and the whitelist each direction allows.
ACCEPTED_MIMES = {
    ".epub": ("application/epub+zip", "application/zip"),
    ".docx": (DOCX_MIME, "application/zip"),
    ".txt": ("text/plain",),
    ".html": ("text/html", "application/xhtml+xml"),
    ".pdf": ("application/pdf",),
    ".md": ("text/plain", "text/markdown", "text/x-markdown"),
    ".markdown": ("text/plain", "text/markdown", "text/x-markdown"),
}
IMPORT_EXTENSIONS = (".epub", ".pdf", ".docx", ".html", ".txt")
IMPORT_MIMES = ("application/epub+zip", "application/pdf", DOCX_MIME, "text/html", "text/plain")
EXPORT_EXTENSIONS = (".md", ".markdown")
EXPORT_MIMES = ("text/plain", "text/markdown", "text/x-markdown")
# Archive entry that proves a container format.
CONTAINER_MARKERS = {
    ".epub": ("application/epub+zip", "META-INF/container.xml"),
    ".docx": (DOCX_MIME, "[Content_Types].xml"),
}
# Routing defaults and what each converter reads.
ROUTES = (
    (".epub", "any", "epub", "pandoc"),
    (".pdf", "text_native", "pdf_native", "pymupdf"),
    (".pdf", "unknown", "pdf_native", "pymupdf"),
    (".pdf", "scanned", "pdf_scanned", "ocr"),
    (".docx", "any", "docx", "markitdown"),
    (".html", "any", "html", "markitdown"),
    (".txt", "any", "txt", "markitdown"),
)
REGISTRY = {
    "pandoc": (".epub",),
    "pymupdf": (".pdf",),
    "markitdown": (".docx", ".html", ".txt"),
    "ocr": (".pdf",),
    "export-pdf": (".md", ".markdown"),
    "export-docx": (".md", ".markdown"),
    "export-epub": (".md", ".markdown"),
}
TARGET_FORMATS = ("markdown", "pdf", "docx", "epub")
# Download media types.
MEDIA_TYPES = {
    ".md": "text/markdown; charset=utf-8",
    ".markdown": "text/markdown; charset=utf-8",
    ".pdf": "application/pdf",
    ".docx": DOCX_MIME,
    ".epub": "application/epub+zip",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"
# Failures worth repeating, and the repeat policy.
RETRYABLE_ERRORS = ("OperationalError", "InterfaceError", "ConnectionError", "TimeoutError")
MAX_RETRIES = 3
MAX_BACKOFF_SECONDS = 60


def _values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A literal relation: known to the optimiser, no Python workers involved."""
    def literal(value: object) -> str:
        if isinstance(value, tuple):
            return "array(" + ", ".join(map(literal, value)) + ")"
        return "'" + str(value) + "'"

    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def formats(spark: SparkSession) -> DataFrame:
    """(direction, extension, accepted MIME types usable in that direction)."""
    rows = []
    for direction, extensions, whitelist in (
        ("import", IMPORT_EXTENSIONS, IMPORT_MIMES), ("export", EXPORT_EXTENSIONS, EXPORT_MIMES)
    ):
        for extension in extensions:
            accepted = ACCEPTED_MIMES[extension]
            # One whitelisted type makes every type accepted for the extension usable.
            usable = accepted if set(accepted) & set(whitelist) else ("",)
            rows.append((direction, extension, usable))
    return _values(spark, "direction, extension, mimes", rows)


def containers(spark: SparkSession) -> DataFrame:
    return _values(spark, "extension, canonical_mime, marker",
                   [(ext, *spec) for ext, spec in CONTAINER_MARKERS.items()])


def routes(spark: SparkSession) -> DataFrame:
    return _values(spark, "extension, flavour, target, default_converter", list(ROUTES))


def registry(spark: SparkSession) -> DataFrame:
    return _values(spark, "converter_name, supports", list(REGISTRY.items()))


def media_types(spark: SparkSession) -> DataFrame:
    return _values(spark, "suffix, media_type", list(MEDIA_TYPES.items()))


def retryable_errors(spark: SparkSession) -> DataFrame:
    return _values(spark, "error_class", [(name,) for name in RETRYABLE_ERRORS])
