"""Extraction rules on hand-traced pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkloom.config import DEFAULT, DOCUMENTED, RULE_BREAK, SPACER_BREAK
from inkloom.functions.markup import gate_bytes, html_to_text
from inkloom.functions.strings import chapter_slug
from inkloom.operators import extract
from inkloom.operators.chain import page_edges
from inkloom.operators.events import CLOSE, _Events, add_page, page_events
from inkloom.operators.selectors import first_match

SIMPLE = """\ufeff<!doctype html><html><head>
<title>Fixture</title>
<link rel='next' href='https://example.com/next' />
</head><body>
<article><div class='entry-content'>
  <h1>Test Chapter 1.01 A</h1>
  <p>First paragraph.</p>
  <p>Second paragraph.</p>
  <p>***</p>
  <p>Third paragraph after scene break.</p>
</div></article>
</body></html>
"""


def pages(spark, *html, url="https://e.com/b/1"):
    rows = [(i, url, page) for i, page in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def blocks_of(spark, *html, config=DEFAULT):
    rows = extract.page_blocks(page_events(pages(spark, *html)), config).orderBy("page_id").collect()
    return [row["blocks"] for row in rows]


def article(body: str) -> str:
    return f"<html><head></head><body><article>{body}</article></body></html>"


def shape(html: str) -> str:
    """Compact rendering of the events of one page."""
    events = _Events(None)
    add_page(events, html)
    out = []
    for (_, _, _, _, _, kind, tag, text), end in zip(events.rows, events.ends):
        out.append(text if kind == "text" else f"</{tag}>" if kind == CLOSE else f"<{tag}>")
        assert end >= 0
    return "".join(out)


def body_of(html: str) -> str:
    return shape(html).split("<body>", 1)[1].rsplit("</body>", 1)[0]


def test_simple_chapter(spark):
    frame = extract.judged_pages(pages(spark, SIMPLE))
    row = frame.first()
    assert row["title"] == "Test Chapter 1.01 A"
    assert row["code"] == "1.01 A"
    assert row["next_href"] == "https://example.com/next"
    assert row["reject_reason"] is None
    assert row["html"].split("\n") == [
        "<p>First paragraph.</p>",
        "<p>Second paragraph.</p>",
        RULE_BREAK,
        "<p>Third paragraph after scene break.</p>",
    ]
    more = frame.select(
        gate_bytes(F.col("html")).alias("bytes"),
        chapter_slug(F.col("code"), F.col("title")).alias("slug"),
        F.concat("title", F.lit("\n"), html_to_text(F.col("html")), F.lit("\n")).alias("text"),
    ).first()
    assert more["bytes"] == 70
    assert more["slug"] == "1-01-a"
    assert more["text"] == (
        "Test Chapter 1.01 A\n"
        "\nFirst paragraph.\n\n\nSecond paragraph.\n\n\n\n\nThird paragraph after scene break."
        "\n"
    )


def test_documented_preset_rejects_short_pages(spark):
    rejected = extract.rejects(pages(spark, SIMPLE), DOCUMENTED).collect()
    assert [row["reject_reason"] for row in rejected] == [extract.TOO_SHORT]


def test_status_and_strict(spark):
    frame = pages(spark, SIMPLE, SIMPLE).withColumn("status", F.when(F.col("page_id") == 1, 404))
    reasons = {row["page_id"]: row["reject_reason"] for row in extract.rejects(frame).collect()}
    assert reasons == {1: "http status 404"}
    with pytest.raises(Exception, match="http status 404"):
        extract.chapters(frame, strict=True).collect()


def test_empty_pages_are_rejected_not_lost(spark):
    frame = pages(spark, "", None, "<p>hi", SIMPLE)
    judged = extract.judged_pages(frame).collect()
    assert len(judged) == 4
    assert sum(row["reject_reason"] is None for row in judged) == 1


@pytest.mark.parametrize(
    "html, body",
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
        ("<p><b>x<br><p>y</p>", "<p><b>x<br></b></p><p><b>y</b></p>"),
        ("<p><i>x</p>y</i>z", "<p><i>x</i></p><i>y</i>z"),
        ("x<script>if (a<b) '</p>'</script>t", "x<script>if (a<b) '</p>'</script>t"),
        ("a<!-- <p>no</p> -->b", "ab"),
        ("a &amp; &copy &#39;", "a & © '"),
        ("<p>x<div>y</div>", "<p>x</p><div>y</div>"),
        ("<a href=1>x<a href=2>y</a>", "<a>x</a><a>y</a>"),
        ("x<img src='a", "x"),
        ("<p title='a>b'>x", "<p>x</p>"),
        ("a < b", "a < b"),
        ("<b><b><b><b>x<p>y", "<b><b><b><b>x<p>y</p></b></b></b></b>"),
    ],
)
def test_tree_rules(html, body):
    assert body_of(html) == body


def test_title_sources(spark):
    frame = pages(
        spark,
        "<header><h1> In header </h1></header>",
        "<h1> </h1><meta property='og:title' content=' Graph '>",
        "<p>none</p>",
        "<h1>A <em>b</em></h1><h1>second</h1>",
    )
    titled = extract.rooted_events(page_events(frame)).orderBy("page_id").collect()
    assert [row["title"] for row in titled] == ["In header", "Graph", "Untitled Chapter", "A b"]


def test_root_priority_and_fallbacks(spark):
    html = {
        "<div class='entry-content'>out</div><article><p class='x entry-content'>in</p></article>": "in",
        "<div class='chapter-content'>c</div><article>a</article>": "a",
        "<div id='content'>id</div><main>m</main>": "id",
        "plain": "plain",
    }
    rooted = extract.rooted_events(page_events(pages(spark, *html))).orderBy("page_id")
    inside = extract.inside_text(F.col("events")["text"], F.col("root"))
    assert [row[0] for row in rooted.select(inside).collect()] == list(html.values())


def test_selector_grammar(spark):
    frame = page_events(pages(spark, "<div class='a b' id=k data-x='one two'><p><i lang=en>t</i></p></div>"))
    opens = F.filter("events", lambda e: e["kind"] == "open")

    ready = extract.settle(frame, [], opens=opens)
    hits = (".a.b", "div#k", "[data-x*=two]", "div p i", ".b i[lang=en]", "h1, i", "[lang]")
    misses = (".c", "p div", "div#z", "[data-x=two]", "h1, h2", "i p")
    found = [first_match(F.col("opens"), s).isNotNull() for s in (*hits, *misses)]
    row = ready.select(*[f.alias(f"s{i}") for i, f in enumerate(found)]).first()
    assert list(row) == [True] * len(hits) + [False] * len(misses)
    with pytest.raises(ValueError):
        first_match(F.col("opens"), "div > p")


def test_noise_below_root_only(spark):
    html = "<aside><article><p>kept words</p><footer><p>gone</p></footer><div class='x sharedaddy'><p>gone</p></div></article></aside>"
    assert blocks_of(spark, html) == [["<p>kept words</p>"]]
    root_is_noise = DEFAULT.but(selectors=("aside",))
    assert blocks_of(spark, "<aside><p>stays</p></aside>", config=root_is_noise) == [["<p>stays</p>"]]


def test_nested_blocks_repeat(spark):
    html = article("<blockquote>q<p>a</p><hr></blockquote><ul><li><p>b</p></li></ul>")
    expected = ["<blockquote>qa</blockquote>", "<p>a</p>", RULE_BREAK, "<p>b</p>", "<p>b</p>"]
    assert blocks_of(spark, html) == [expected]
    once = ["<blockquote>qa</blockquote>", "<p>b</p>"]
    assert blocks_of(spark, html, config=DEFAULT.but(dedupe_nested=True)) == [once]


def test_inline_markup(spark):
    html = article('<p>a <em>b</em> <strong>c</strong> <u>d</u> <span>e</span> <a class=z href="x?a=1&amp;b=\'">f</a> &lt;"g"</p>')
    assert blocks_of(spark, html) == [[
        "<p>a <i>b</i> <b>c</b> <u>d</u> e <a href=\"x?a=1&amp;b=&#39;\">f</a> &lt;&#34;g&#34;</p>"
    ]]


def test_breaks(spark):
    html = article("<hr><p>***</p><p>a<br><br><br/>b<br><br>c</p><p>* * *</p><p>———</p><p>†</p><p>--</p><h2>no</h2>")
    assert blocks_of(spark, html) == [
        [RULE_BREAK, "<p>a</p>", RULE_BREAK, "<p>b<br/><br/>c</p>", RULE_BREAK, "<p>--</p>"]
    ]
    spacer = blocks_of(spark, html, config=DEFAULT.but(scene_break_style="Spacer"))[0]
    assert spacer[0] == SPACER_BREAK and RULE_BREAK not in spacer
    none = blocks_of(spark, html, config=DEFAULT.but(scene_break_style="none"))[0]
    assert none == ["<p>a<br/><br/><br/>b<br/><br/>c</p>", "<p>--</p>"]


def test_nav_only_rows(spark):
    link = "<p><a href=/x>{}</a>{}</p>"
    gone = ["Next Chapter", "previous page", "NEXT", "Prev", "→", "«", ""]
    kept = ["Next Chapter →", "Contents"]
    html = article("".join(link.format(label, "") for label in gone + kept) + link.format("Next", " more"))
    assert blocks_of(spark, html) == [[
        '<p><a href="/x">Next Chapter →</a></p>', '<p><a href="/x">Contents</a></p>', '<p><a href="/x">Next</a> more</p>'
    ]]
    trimmed = blocks_of(spark, html, config=DEFAULT.but(trim_nav_labels=True))[0]
    assert len(trimmed) == 2


NEXT_CASES = [
    ("<link rel='prenext' href='/a'>", "", "/a"),
    ("<link rel=next><link rel=next href=/b>", "<a href='/c'>Next</a>", "/c"),
    ("", "<a href=''>Next</a><a href='/d'> Next </a>", "/d"),
    ("", "<a href='/e'>read NEXT part</a>", "/e"),
    ("", "<a>next</a><a href='/f'>next one</a>", None),
    ("", "<nav><a href='/g'>Next</a></nav>", None),
    ("", "</article><nav><a href='/h'>Next</a></nav>", "/h"),
    ("", "<a href='/i'>»</a>", "/i"),
    ("", "<a href='/j'>other</a>", None),
]


def test_next_link(spark):
    html = [
        f"<html><head>{head}</head><body><article><p>{'word ' * 20}</p>{body}</article></body></html>"
        for head, body, _ in NEXT_CASES
    ]
    found = extract.chapters(pages(spark, *html)).orderBy("page_id").collect()
    assert [row["next_href"] for row in found] == [href for _, _, href in NEXT_CASES]


def test_edges_resolve_against_the_page(spark):
    html = article(f"<p>{'word ' * 20}</p><a href='2'>Next</a>")
    edge = page_edges(extract.chapters(pages(spark, html))).first()
    assert edge["next_url"] == "https://e.com/b/2"
