import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliomill.functions import rewrite
from foliomill.operators import blocks, convert


@pytest.fixture
def markdown(spark):
    def run(*pages):
        df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
        rows = convert.html_to_markdown(df).select("i", "markdown").collect()
        return [r.markdown for r in sorted(rows)]
    return run


CASES = {
    "<ol><li>a<ul><li>x</li><li>y</li></ul></li><li>b</li></ol>end": "1. a\n   - x\n   - y\n2. b\n\nend",
    "<ol start='9'><li>i<li>j</ol><OL START=0><LI>k</OL><ol data-start=4><li>l</ol>": "9. i\n10. j\n\n1. k\n\n1. l",
    "<ul><li>a<p>more</p><ol><li>x</ol></li></ul><ul><li>b</ul>": "- a\n\n  more\n\n  1. x\n\n- b",
    "z<blockquote>a<br>b<blockquote>c<blockquote><p>d</p><p>e</p></blockquote></blockquote>f</blockquote>g":
        "z\n\n> a\n> b\n>\n> > c\n> >\n> > > d\n> > >\n> > > e\n>\n> f\n\ng",
    "<pre><code class=x>a = 1\n\n\n  <span>b</span> &lt;c\n</code></pre><pre>\nz</pre>t": "```\na = 1\n\n\n  b <c\n```\n\n```\nz\n```\n\nt",
    "<blockquote><pre>1\n\n2</pre></blockquote>": "> ```\n> 1\n>\n> 2\n> ```",
    "<pre>open\n <ul><li>x": "```\nopen\n x\n```",
    "<table><caption>cap</caption><thead><tr><th>A<th>B</tr></thead><tbody><tr><td>1</td><td>2<br>3</td></tr>"
    "<tr><td>a|b</td><td><b>x</b></td></tr></tbody></table>t": "cap\n\n| A | B |\n| --- | --- |\n| 1 | 2 3 |\n| a\\|b | **x** |\n\nt",
    "<table>\n<tr>\n<td>a</td><td></td></tr> loose <tr><td>b</table>": "| a |  |\n| --- | --- |\n| loose |\n| b |",
    "<table><tr><td><h1>lay</h1><table><tr><td>in</td></tr></table></td><td>side</td></tr></table>":
        "# lay\n\n| in |\n| --- |\n\nside",
    "<li>lone</li><ol></ol></blockquote></ul></pre>x": "- lone\n\nx",
    "<p>a &#xe001;b&#xe002; c</p><blockquote>q</blockquote>": "a b c\n\n> q",
    "a\x00b<ol><li>\x00</ol>": "a�b\n\n1. �",
    "&check; &lbrace; &NotEqualTilde; &nope; &amp;check;": "✓ { ≂̸ &nope; &check;",
    "<ol><li></ol>": "1.",
    "<olx>a</olx><prefix>b</prefix><ul><li>c</ul>": "ab\n\n- c",
}


def test_nested_blocks(markdown):
    assert dict(zip(CASES, markdown(*CASES))) == CASES


def tree(rng, depth, words):
    """(html, {word: (quotations around it, what its line says before it)}) of random blocks."""
    html, told = [], {}
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["p", "quote", "ol", "ul"]) if depth else "p"
        if kind == "p":
            word = next(words)
            html.append(f"<p>{word}</p>")
            told[word] = 0, ""
            continue
        items = []
        for n in range(rng.randrange(1, 4)):
            word = next(words)
            inner, inside = tree(rng, depth - 1, words) if rng.random() < 0.6 else ("", {})
            items.append((word, inner, inside, n))
        if kind == "quote":
            word, inner, inside, _ = items[0]
            html.append(f"<blockquote>{word}{inner}</blockquote>")
            told |= {word: (1, "")} | {w: (q + 1, m) for w, (q, m) in inside.items()}
        else:
            html.append(f"<{kind}>" + "".join(f"<li>{w}{inner}</li>" for w, inner, _, _ in items) + f"</{kind}>")
            for word, _, inside, n in items:
                told |= {word: (0, f"{n + 1}. " if kind == "ol" else "- ")} | inside
    return "".join(html), told


def test_random_trees_keep_words_quotations_and_numbers(markdown):
    rng = random.Random(1)
    made = []
    for page in range(60):
        words = (f"w{page}x{i}" for i in range(10**6))
        made.append(tree(rng, 5, words))
    for (html, told), text in zip(made, markdown(*[html for html, _ in made])):
        assert re.findall(r"w\d+x\d+", text) == re.findall(r"w\d+x\d+", html)
        assert "\n\n\n" not in text and not re.search(r"[ \t]$", text, re.M)
        for line in text.split("\n"):
            found = re.fullmatch(r"([> ]*?)((?:\d+\. |- )?)(w\d+x\d+)", line)
            if found:
                before, marker, word = found.groups()
                assert (before.count(">"), marker) == told[word], (html, text)
            else:
                assert not line.strip("> ")


@pytest.mark.parametrize("page", [
    "<ul><li>a" * 20_000, "<ol><li>" * 20_000 + "</ol>" * 20_000, "<table>" * 30_000,
    "<table><tr>" + "<td>a" * 30_000 + "</table>", "<pre>" + "<li>\n" * 30_000, "<ol " * 30_000 + "<ol><li>x</ol>" * 10_000])
def test_many_blocks_take_linear_time(markdown, page):
    started = time.monotonic()
    markdown(page)
    assert time.monotonic() - started < 40


def test_deep_blocks_keep_their_text(markdown):
    depth = blocks.DEEPEST + 50
    text, = markdown("".join(f"<blockquote>w{i}" for i in range(depth)))
    assert re.findall(r"w\d+", text) == [f"w{i}" for i in range(depth)]


def test_rules_are_tried_where_their_tags_are(spark):
    pages = ["<p>a</p><ol><li>b</ol>", "x", None, "<ſtrong>c</B><Kbd>", "</scıpt><a href=u>d</a>"]
    told = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").withColumn(
        "names", rewrite.tag_names(F.col("html"))).select(
        "i", "names", rewrite.has_tag(F.col("names"), "li", "br").alias("tried"))
    assert [(r.names, r.tried) for r in sorted(told.collect())] == [
        (["p", "ol", "li"], True), ([], False), (None, True), (None, True), (None, True)]


def test_tags_that_removals_leave_are_found(markdown):
    pages = {
        "<<script></script>b>x</b>": "**x**", "<b<style></style>r>y": "y", "<<!-- -->h1>t</h1>": "# t",
        "<ſtrong>s</strong>": "**s**", "<<img>p>a<<img>p>b": "a\n\nb",
        "<table><tr><td>1</td></tr><<tbody>li>x</table><blockquote>q</blockquote>": "| 1 |\n| --- |\n| \n\n- x |\n\n> q",
    }
    assert dict(zip(pages, markdown(*pages))) == pages


def test_blanks_and_breaks_are_squeezed(spark):
    texts = ["a \nb", "a\t", "a b", "a\n\n\n\nb \t\n c ", "\n \n \n\nx", "", None, " ", "a \x0b\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", rewrite.TRAILING_BLANKS, ""), rewrite.BLANK_RUN, "\n\n")
    assert [tuple(r) for r in df.select(rewrite.squeeze(F.col("t")), plain).collect() if r[0] != r[1]] == []
