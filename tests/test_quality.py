"""Score, band, warnings and document structure."""

import pytest

from foliomill.operators import quality, structure
from pyspark.sql import functions as F


@pytest.fixture
def assessed(spark):
    def run(size, text, pages=None):
        df = spark.createDataFrame([(size, text, pages)], "input_bytes long, markdown string, pages int")
        return quality.assess(df).first()

    return run


def test_structured_text_is_high(assessed):
    row = assessed(10_000, "# Title\n\nProse.\n\n## More\n\nText.\n", 5)
    assert (row.quality_score, row.quality_level, row.quality_warnings) == (1.0, "high", [])
    assert (row.heading_count, row.pages, row.chars) == (2, 5, 31)


def test_empty_text(assessed):
    row = assessed(10_000, " \n\x1c", 1)
    assert (row.quality_score, row.quality_level) == (0.0, "low")
    assert row.quality_warnings == ["Conversion produced no text content."]


def test_tiny_output(assessed):
    row = assessed(500_000, "a few words only")
    assert (row.quality_score, row.quality_level, row.pages) == (0.3, "low", 0)
    assert row.quality_warnings == [
        "Output is suspiciously small (16 chars) for a 488 KB source — extraction may be incomplete."]


@pytest.mark.parametrize("n,score,level", [
    (1, 0.85, "high"), (3, 0.75, "high"), (4, 0.7, "medium"), (6, 0.6, "medium"), (50, 0.6, "medium")])
def test_replacement_band_edges(assessed, n, score, level):
    row = assessed(100, "# T\n\nx" + "�" * n)
    assert (row.quality_score, row.quality_level) == (score, level)


def test_flat_and_garbled(assessed):
    row = assessed(100, "flat text " * 300 + "�" * 5)
    expected = 1.0 - 0.2 - min(0.4, 0.1 + 0.05 * 5)
    assert row.quality_score == round(expected, 3)
    assert row.quality_level == ("medium" if expected >= 0.45 else "low")
    assert len(row.quality_warnings) == 2


def test_score_never_negative(assessed):
    assert assessed(1_000_000, "�" * 50).quality_score == 0.0


def test_heading_may_start_on_the_next_line(assessed):
    assert assessed(10, "#\n\ntext").heading_count == 1
    assert assessed(10, "a\r# no").heading_count == 0
    assert assessed(10, "####### seven").heading_count == 0


def test_outline_title_and_links(spark):
    df = spark.createDataFrame([(1, "intro\n## Two  \n# One \n#no\n### Three #")], "id int, md string")
    rows = structure.heading_outline(df, "md", "id").orderBy("position").collect()
    assert [(r.position, r.level, r.heading) for r in rows] == [(1, 2, "Two"), (2, 1, "One"), (3, 3, "Three #")]
    title = structure.document_title(F.col("md"), F.lit("fallback"))
    assert df.select(title.alias("t")).first().t == "One"
    assert spark.createDataFrame([("## x",)], "md string").select(title.alias("t")).first().t == "fallback"
    links = spark.createDataFrame(
        [(1, '<a href="#a.xhtml">x</a><a href="http://h">y</a><a name="n">z</a>[q](#b.xhtml)')], "id int, t string")
    assert {r.kind: r.links for r in structure.link_inventory(links, "t", "id").collect()} == {
        "internal": 2, "external": 1, "other": 1}
