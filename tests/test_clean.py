"""The cleaner on hand-written input with hand-written results."""

import time

import pytest
from pyspark.sql import functions as F

from foliomill.functions import patterns as P
from foliomill.operators import clean, convert
from foliomill.sources import tables

SAMPLE = """# Keeping bees

<p>Open the hive <a name="top">slowly</a>, on <span>a <span>warm</span> day</span>.</p>
<table><tbody><tr><td><p>Smoke calms.</p></td></tr></tbody></table>
See <a href="https://bees.example/guide">the guide</a> and [notes](#n7.xhtml).



<div><div><img alt="queen" src="book/Bees_media/queen.jpg"/></div></div>
<div class="class_sM3"><span>Patience first.</span></div>
<span></span><svg><path d="M0 0"/></svg><section>Winter</section></span>
"""
GOLDEN = """# Keeping bees

Open the hive slowly, on a warm day.

Smoke calms.

See [the guide](https://bees.example/guide) and notes.

![queen](media/queen.jpg)
> Patience first.

Winter
"""


@pytest.fixture
def cleaned(spark):
    def run(*texts, stage=clean.clean_corpus):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
        return [r.asDict() for r in stage(df).orderBy("id").collect()]

    return run


def test_golden_counters_and_idempotence(cleaned):
    first = cleaned(SAMPLE)[0]
    assert first["text"] == GOLDEN
    expected = {
        "svg_removed": 1, "callouts_converted": 0, "quoted_blocks_converted": 1, "xhtml_anchors_dropped": 1,
        "external_anchors_converted": 1, "other_anchors_stripped": 1, "empty_spans_removed": 1,
        "spans_removed": 2, "orphan_span_tags_removed": 1, "paragraphs_unwrapped": 1, "divs_removed": 4,
        "img_tags_converted": 1, "residual_html_tags_removed": 2, "image_paths_rewritten": 1, "table_scaffold_removed": 0,
    }
    assert {k: first[k] for k in expected} == expected
    assert (first["media_dir_old"], first["media_dir_new"]) == ("Bees_media", "media")
    assert cleaned(first["text"])[0]["text"] == GOLDEN


def test_wrapper_tags_become_marks_or_go(cleaned):
    text = cleaned("<main>x<kbd>y</kbd> <code>z</code>\n<br>n<b>ew</b> <i>m</i><hr><img src='no'/><footer>end</footer></main>")[0]["text"]
    assert text == "xy `z`\n\nn**ew** *m*\n\n---\n\nend\n"


LONG = 60_000
CROWDED = [
    (clean.strip_spans, "<span " * LONG + "</span>"), (clean.strip_spans, "<span " * LONG),
    (clean.convert_callouts, "<table><colgroup>" * LONG + "x</td></tr></tbody></table>"),
    (clean.convert_callouts, "<table " * LONG + "</td></tr></tbody></table>"),
    (clean.rewrite_anchors, "<a " * LONG + "</a>"), (clean.rewrite_anchors, '<a href="#' * LONG + "</a>"),
    (clean.unwrap_paragraphs, "<p " * LONG + "</p>"), (clean.strip_divs, "<div " * LONG), (clean.strip_svg, "<svg " * LONG + "</svg>"),
    (clean.strip_residual_html, "<em " * LONG + "<br>"), (clean.convert_img_tags, "<img " * LONG),
]


@pytest.mark.parametrize("stage,text", CROWDED, ids=lambda v: getattr(v, "__name__", ""))
def test_crowded_openers_are_read_once(cleaned, stage, text):
    started = time.monotonic()
    cleaned(text, stage=stage)
    assert time.monotonic() - started < 20  # trying every opener takes minutes


@pytest.mark.parametrize("stage,text,expected", [
    (clean.strip_spans, "<span a<span b></span>x", "x"),
    (clean.strip_spans, "<span a<span b>y</span>", "y"),
    (clean.unwrap_paragraphs, "<p a<p b>y</p>z", "y\n\nz"),
    (clean.rewrite_anchors, '<a k <a href="https://u.example">t</a>', "[t](https://u.example)"),
    (clean.rewrite_anchors, "<a <b <a>t</a>", "t"),
    (clean.convert_quoted_div, '<div <div class="class_sM3"><span>q</span></div>', "> q\n"),
    (clean.convert_callouts, "<table><colgroup>a</colgroup>b</colgroup><tbody><tr><td><p>c</p></td></tr></tbody></table>"
     "<table><colgroup><table><colgroup>", "c\n<table><colgroup><table><colgroup>"),
])
def test_nested_openers_match_like_the_plain_rules(cleaned, stage, text, expected):
    assert cleaned(text, stage=stage)[0]["text"] == expected


def test_filters_on_other_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "<p>x</p>")], "page_id int, html string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    for df in (convert.html_to_markdown(pages, where="page_id = 5"), clean.clean_corpus(pages, "html", where="page_id = 5")):
        assert "EqualTo(page_id,5)" in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("html,markdown", [
    ("caf&eacute; &#8217;s &#x1F600; &#150; &amp;lt; &nope; &#0;", "café ’s \U0001F600 – &lt; &nope; �"),
    ("<a href='x y'>s</a> <a class=k href=u/v>n</a> <A data-href=\"no\" HREF = \"yes\">d</A>", "[s](x y) [n](u/v) [d](yes)"),
    ("<ol><li>one<li>two</ol><ul><li>x</ul>", "1. one\n2. two\n\n- x"),
    ("<blockquote><p>a<br>b</p></blockquote>after", "> a\n> b\n\nafter"),
    ("<pre><code>x = 1\n  y</code></pre><pre>z</pre>", "```\nx = 1\n  y\n```\n\n```\nz\n```"),
])
def test_html_forms(spark, html, markdown):
    df = spark.createDataFrame([(html,)], "html string")
    assert convert.html_to_markdown(df).first()["markdown"] == markdown


def test_unclosed_titles_are_read_once(spark):
    started = time.monotonic()
    convert.html_to_markdown(spark.createDataFrame([("<title>" * LONG,)], "html string")).collect()
    assert time.monotonic() - started < 20


def test_edges(cleaned):
    rows = cleaned("", "# Hello\n\nplain\n", "a \t\r\nb  \n\n\n\nc　", None)
    assert [r["text"] for r in rows] == ["\n", "# Hello\n\nplain\n", "a \t\r\nb\n\nc\n", None]
    assert rows[0]["media_dir_old"] is None


@pytest.mark.parametrize("raw,text,pairs,orphans,empties", [
    ("<span>a<span>b</span>c</span>", "abc", 2, 0, 0),
    ("</span>x<span>", "x", 0, 2, 0),
    ("</span><span>a</span></span><span>", "a", 1, 3, 0),
    ("<sp<span></span>an>x</span>", "x", 1, 0, 1),
    ("<sp<span>an>x</span>", "x", 1, 1, 0),
    ("<SPAN a='1'>q</Span>", "q", 1, 0, 0),
    ("<spank>z</spank>", "<spank>z</spank>", 0, 0, 0),
    ("no tags", "no tags", 0, 0, 0),
])
def test_spans(cleaned, raw, text, pairs, orphans, empties):
    row = cleaned(raw, stage=clean.strip_spans)[0]
    assert row["text"] == text
    assert (row["spans_removed"], row["orphan_span_tags_removed"], row["empty_spans_removed"]) == (
        pairs, orphans, empties)


def test_unclosed_openers_are_left_and_linear(cleaned):
    tail = "<p>" * 50_000
    row = cleaned("<p>one</p>" + tail, stage=clean.unwrap_paragraphs)[0]
    assert row["text"] == "one\n\n" + tail and row["paragraphs_unwrapped"] == 1


def test_paragraph_takes_everything_up_to_its_end(cleaned):
    row = cleaned("<p>a<p> b </p><p> </p>c", stage=clean.unwrap_paragraphs)[0]
    assert row["text"] == "a<p> b\n\nc" and row["paragraphs_unwrapped"] == 2


def test_tables(cleaned):
    cell = "<table><tbody><tr><td>{}</td></tr></tbody></table>"
    rows = cleaned(
        cell.format("<p>💡 x</p><p></p><p>y</p>"), cell.format("<p>x</p><p>y</p>"), cell.format("bare"),
        cell.format("<p>ℹ info</p>"), stage=clean.convert_callouts,
    )
    assert [r["text"] for r in rows] == [
        "> **💡 x**\n>\n> y\n", "x\n\ny\n", cell.format("bare"), "ℹ info\n"]
    assert [r["callouts_converted"] for r in rows] == [1, 0, 0, 0]


def test_media_vote_first_seen_wins_ties(cleaned):
    rows = cleaned(
        "(b_media/1.png) (a_media/2.png) (a_media/3.jpg) (b_media/4.gif)",
        "x/y_media/a.png?q media/a.png media_media/b.webp", "no_media/file.txt",
        "data:image/png;base64," + "QUJD" * 50_000 + " z_media/a.b.svg",
        stage=clean.rewrite_image_paths,
    )
    assert [r["media_dir_old"] for r in rows] == ["b_media", "y_media", None, "z_media"]
    assert rows[0]["text"] == "(media/1.png) (media/2.png) (media/3.jpg) (media/4.gif)"
    assert rows[1]["text"] == "media/a.png?q media/a.png media/b.webp"
    assert rows[3]["text"].endswith(" media/a.b.svg")


def test_word_boundary_is_unicode(cleaned):
    rows = cleaned("<b>x</b> <bé>y", "<br/>z<HR>", "<s>1</S ><sup\n>2", stage=clean.strip_residual_html)
    assert [r["text"] for r in rows] == ["**x** <bé>y", "\nz\n\n---\n\n", "12"]


def test_filter_above_the_cleaner_stays_above(spark):
    df = clean.clean_corpus(spark.createDataFrame([("<p>x</p>",)], "text string"))
    plan = df.filter(F.col("text").rlike(P.java(clean.FORBIDDEN)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Filter") and len(plan) < 200_000


def test_media_collisions(spark):
    df = spark.createDataFrame(
        [(1, 1, "x_media", "media"), (1, 2, "y_media", "media"), (2, 3, "z_media", "media"), (2, 4, None, None)],
        "job_id int, file_id int, media_dir_old string, media_dir_new string")
    got = {r.file_id: r.collision for r in clean.media_rename_plan(df).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_html_conversion(spark):
    html = (
        '<!DOCTYPE html><html><head><title>T &amp; U</title><script>var t="</p>";</script><style>p{}</style></head>'
        '<body><!-- <p>no</p> --><h1 class="x">Head</h1><ul><li><a href="/x">link</a></li><li>two</li></ul>'
        '<p>a &lt;3 &amp;amp; <b>bold</b><br>next<p>unclosed<img src="i.png" alt="I"><H2>Sub</H2>'
    )
    row = convert.html_to_markdown(spark.createDataFrame([(html,), ("",)], "html string")).collect()
    assert row[0].title == "T & U"
    assert row[0].markdown == (
        "# Head\n\n- [link](/x)\n- two\n\na <3 &amp; **bold**\nnext\n\nunclosed![I](i.png)\n\n## Sub")
    assert row[1].markdown == ""


def test_warning_lines(one):
    log = "a\r\n \nWARNING: css\x0b[WARNING] image b"
    assert one(lambda c: convert.warning_lines(c), log) == ["a", "WARNING: css", "[WARNING] image", "b"]
    assert one(lambda c: convert.warning_lines(c, export=True), log) == ["a", "[WARNING] image", "b"]


def test_image_paths_and_blanks_in_large_texts(spark):
    texts = ["é" * 50 + ' "x/é_MEDIA/a.png" b_media/c.PNG y(z/b_media/d.gif) \t\n \t', "a_media/ b.png \t x\t", "_media/x.png", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = [tuple(r) for r in clean.normalise_whitespace(clean.rewrite_image_paths(df)).select(
        "text", "image_paths_rewritten", "media_dir_old").sort("id").collect()]
    assert out == [
        ("é" * 50 + ' "media/a.png" media/c.PNG y(media/d.gif)\n', 3, "b_media"), ("a_media/ b.png \t x\n", 0, None),
        ("_media/x.png\n", 0, None), (None, out[3][1], None)]


def test_documents_of_one_row_group_are_cleaned_by_many_tasks(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "web") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(
        str(tmp_path / "documents.parquet"))
    for made in (tables.dirty_docs, tables.block_pages):
        df = made(spark, str(tmp_path))
        assert df.count() == 400
        assert df.select(F.spark_partition_id()).distinct().count() > 4
