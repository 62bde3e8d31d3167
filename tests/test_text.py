"""Text expressions against the Python behaviour they stand for."""

from pathlib import PurePosixPath

import pytest

from foliomill.functions import text as X

PATHS = [
    "a.txt", "dir/b.tar.gz", ".hidden", "..", ".", "", "/", "a/", "a/.", "a//", "trail.", "two..dots", "x/.y.z",
    "../../etc/passwd", "./", "a/./b.md", "no_ext", "..a", "a/../b.c", "über straße.PDF",
]


@pytest.mark.parametrize("path", PATHS)
def test_path_parts(one, path):
    expected = PurePosixPath(path)
    assert one(X.basename, path) == expected.name
    # newer Python versions count a trailing dot as a suffix; the engine follows the older rule
    name = expected.name
    dot = name.rfind(".")
    cut = dot if 0 < dot < len(name) - 1 else len(name)
    assert one(X.suffix, path) == name[cut:]
    assert one(X.stem, path) == name[:cut]


@pytest.mark.parametrize("raw,expected", [
    ("../../etc/passwd", "passwd"), ("My Book Title?.pdf", "My_Book_Title_.pdf"), ("", "file"),
    ("...", "file"), ("x" * 300, "x" * 200), ("-a_b-", "a_b"),
])
def test_safe_name(one, raw, expected):
    assert one(X.safe_name, raw) == expected


@pytest.mark.parametrize("raw", [" a \x1c", "\x85　", "plain", "\x1f x \n", "​z"])
def test_strip_is_python_strip(one, raw):
    assert one(X.strip, raw) == raw.strip()


@pytest.mark.parametrize("raw,expected", [
    ("Perché questo manuale", "perche-questo-manuale"), ("ORA 1 — Installazione", "ora-1-installazione"),
    ("Manifesto Strategico", "manifesto-strategico"), ("ﬁne ½ Ⅳ", "fine-12-iv"), ("__a  b--", "a-b"),
    ("Việt Nam Ångström", "viet-nam-angstrom"), ("日本", ""),
])
def test_slug(one, raw, expected):
    assert one(X.slug, raw) == expected


@pytest.mark.parametrize("size,expected", [
    (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (5 * 1024**2, "5.0 MB"), (3 * 1024**3, "3.00 GB"),
])
def test_human_size(one, size, expected):
    assert one(X.human_size, size) == expected
