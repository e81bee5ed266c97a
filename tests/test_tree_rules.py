"""End tags, references and comments of broken pages, and time that grows with the page."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from inkloom.functions import markup
from inkloom.functions.sentences import chunk_text
from inkloom.operators.events import _Events, add_page
from inkloom.operators.extract import chapters


def tree(page: str) -> str:
    events = _Events(None)
    add_page(events, page)
    shown = [f"<{r[6]}>" if r[5] == "open" else f"</{r[6]}>" if r[5] == "close" else r[7] for r in events.rows]
    return "".join(shown).removeprefix("<html><body>").removesuffix("</body></html>")


@pytest.mark.parametrize(
    "page, shown",
    [
        ("<h1>Chapter 1.01 A</h2><p>x", "<h1>Chapter 1.01 A</h1><p>x</p>"),
        ("<article><table><td>x</article></td></table><p>after</p>", "<article><table><td>x</td></table><p>after</p></article>"),
        ("<div><table><td>x</div></td></table>after", "<div><table><td>x</td></table>after</div>"),
        ("<span><p>text</span>more</p>", "<span><p>textmore</p></span>"),
        ("<p>a</p><!--><p>b</p>", "<p>a</p><p>b</p>"),
        ("a<!--->b<!-- x --!>c<!-- y", "abc"),
        ("<ul><li>a<blockquote><li>b</ul>", "<ul><li>a<blockquote><li>b</li></blockquote></li></ul>"),
        ("<ul><li>a<div><li>b</ul>", "<ul><li>a<div></div></li><li>b</li></ul>"),
        ("one\r\ntwo\rthree", "one\ntwo\nthree"),
        ("<p>a<div>b</div></p>c", "<p>a</p><div>b</div>c"),
    ],
)
def test_tree_rules(page, shown):
    assert tree(page) == shown


@pytest.mark.parametrize(
    "source, value",
    [("/c?b=5&section=2", "/c?b=5&section=2"), ("&copy=1", "&copy=1"), ("&copy;=1", "©=1"), ("&copy", "©"),
     ("&amp;x&lt;", "&x<"), ("&notit;", "&notit;"), ("&#65;&#x42", "AB"), ("&nothing;", "&nothing;")],
)
def test_references_in_attributes(source, value):
    events = _Events(None)
    add_page(events, f'<a href="{source}">x</a>')
    assert events.attr_values == [value]


@pytest.mark.parametrize("piece", ["<div>", "<a ", "<p><button><div>", "<b id=%d>", "<li>", "</b><b>", "<span>", "<!-- "])
def test_parsing_time_grows_with_the_page(piece):
    def seconds(n):
        page = "".join(piece.replace("%d", str(k)) for k in range(n))
        started = time.thread_time()
        add_page(_Events(None), page)
        return time.thread_time() - started

    seconds(1000)
    assert seconds(80_000) < 40 * seconds(8000) + 0.5


def test_many_line_breaks_do_not_end_the_task(spark):
    run = "<br>" * 100_000 + "<BR/> \n" * 100_000
    text = "long enough text " * 9
    page = f"<html><body><article><h1>T</h1><p>{text}{run}{text}</p></article></body></html>"
    rows = chapters(spark.createDataFrame([(1, "http://a/1", page)], "page_id bigint, url string, html string"))
    assert rows.count() == 1


def test_marks_in_the_text_survive(spark):
    row = spark.createDataFrame([("a\u0001b\u0001ec",), ], "t string").select(
        markup.split_on_break(F.col("t")).alias("pieces"),
        markup.html_to_text(F.lit("<p>a\u0002Nb\u0002</p>")).alias("plain"),
    ).first()
    assert row.pieces == ["a\u0001b\u0001ec"]
    assert row.plain.strip("\n") == "a\u0002Nb\u0002"


def test_chunk_limits(spark):
    text = "A sentence of some length here. " * 100
    row = spark.createDataFrame([(text,)], "t string").select(
        chunk_text(F.col("t")).alias("usual"), chunk_text(F.col("t"), 0).alias("zero"),
        chunk_text(F.col("t"), -5).alias("less"), chunk_text(F.col("t"), 50, floor=400).alias("floor"),
        chunk_text(F.col("t"), 400).alias("f400"),
    ).first()
    assert row.usual == row.zero == row.less and row.floor == row.f400 and len(row.f400) > len(row.usual)
