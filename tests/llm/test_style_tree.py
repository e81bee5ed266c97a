"""Main text of pages: markup roles, the style tree, awkward and broken markup."""

from __future__ import annotations

import time

import pytest

from inkloom.llm import style_tree
from inkloom.llm.style_tree import Page, extracted

NONE = frozenset()


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>T</h1><p>a<p>b  c\n d</article>", "T\na\nb c d"),
        ("<body><p>x<b>y</b>z &eacute;&#x41;&nbsp;q</p>", "xyz éA q"),
        ("<nav>menu</nav><header>site</header><article>text</article><footer>foot</footer>", "text"),
        ("<div class='Cookie-Notice'>we</div><p>text</p><div id=sidebar><p>side</p></div>", "text"),
        ("<article><p>a</p><section class='comments'><article><p>me</p></article></section><p>b</p></article>", "a\nb"),
        ("<article><header><h1>Title</h1></header><p>a</p><form>name<input></form><button>ok</button></article>", "Title\na"),
        ("<article>a<script>if(a<b){'</p>'}</script>b<style>p{}</style><!-- c --><svg><text>s</text></svg></article>", "ab"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one\ntwo\nc\nd"),
        ("<main><p>m</p></main><p>outside</p>", "m"),
        ("<p>a</p><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p>", "a"),
        ("<article><p><b>open<br><p>next</article><footer>x", "open\nnext"),
        ("<p title='a > b'>t</p><p title=\"it's\">u</p>", "t\nu"),
        ("<p>a<br>b</p>< 5 and <", "a b\n< 5 and <"),
        ("<p>text<!-- never closed", "text"),
    ],
)
def test_text_of_a_page(html, text):
    assert extracted(html, NONE, NONE) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<main class='content with-sidebar'><p>a</p></main>", "a"),
        ("<div class=has-sidebar><p>menu</p><main><p>whole</p></main></div><p>longer text outside</p>", "whole"),
        ("<div id=page-no-sidebar><p>whole page</p><div class=ad>ad</div></div>", "whole page"),
        ("<article><div class='side-by-side'><p>whole article</p></div></article>", "whole article"),
        ("<body class=form-page><form><nav>menu</nav><p>whole page</p></form>", "whole page"),
        ("<div class=share-wrapper><article><p>t</p><div class=share>s</div></article></div>", "t"),
        ("<div class=header-fixed><p>whole page</p></div><p>x</p>", "whole page\nx"),
        ("<main><h1>T</h1><div class=has-sidebar><article>long text</article></div></main>", "T\nlong text"),
        ("<article><p>short</p><div class=comments><p>a much longer comment</p></div></article>", "short"),
        ("<p>menu</p><div class=comments-open><article>whole</article></div>", "whole"),
        ("<main><article>a</article><div class=comments><article>longer</article></div></main>", "a"),
        ("<article><p>long article</p></article><div class=sidebar><article>tease</article></div>", "long article"),
    ],
)
def test_noise_words_do_not_remove_what_wraps_the_page(html, text):
    assert extracted(html, NONE, NONE) == text


def pages(n=20, host="h.example"):
    """No semantic markup: a changing text between two branches that all pages share."""
    return [
        (k, f"https://{host}/{k}", f"<body><div class=x{k}><div class=top><p>Welcome to us</p><p>Home</p></div>"
         f"<div class=body><p>Story {k} of many</p><p>More {k * k} words</p><p>Follow us now</p></div></div>")
        for k in range(n)
    ]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><p>a<button>x<p>b</p><p>c</p></article>", "a\nb\nc"),
        ("<article><div>a<video src=v></div><p>b</p></article>", "a\nb"),
        ("<article><p>a<button>x<p>b<button>y</button> z</article>", "a\nb z"),
        ("<article><p>a <button><div>no</div>text</button>b</p></article>", "a b"),
        ("<p>short</p><div class=comments><p>a much longer comment</p><p>and another</p></div>", "short"),
        ("<div class=comments><main><p>all of it</p></main></div>", "all of it"),
        ("<nav>menu</nav><footer>foot</footer>", ""),
    ],
)
def test_unclosed_inline_noise_and_replies(html, text):
    assert extracted(html, NONE, NONE) == text


def test_boilerplate_inside_articles_goes(spark):
    notice = "<p>Subscribe to our newsletter today</p><ul><li>Home</li><li>Shop</li></ul>"
    rows = [
        (100 * h + k, f"https://h{h}.example/{k}", f"<article><h1>Title {h} {k}</h1><p>Story {k} of {h}</p>{notice}</article>")
        for h, n in ((1, 40), (2, 7), (3, 4), (4, 2)) for k in range(n)
    ]
    rows.append((900, "https://h1.example/menu", f"<article>{notice}</article>"))
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in style_tree.main_text(frame).collect()}
    assert {k: t for k, t in got.items() if k < 400} == {
        100 * h + k: f"Title {h} {k}\nStory {k} of {h}" for h, n in ((1, 40), (2, 7), (3, 4)) for k in range(n)
    }
    assert got[900] == "" and got[400].startswith("Title 4 0\nStory 0 of 4\nSubscribe")


def test_branches_of_deep_pages(spark):
    deep = lambda inside: "<div>" * 200 + inside + "</div>" * 200
    rows = [
        (k, f"https://deep.example/{k}", f"<body><div class=top>{deep('<p>Welcome to us</p>')}</div><p>Story {k}</p>")
        for k in range(12)
    ]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    low = {r.node for r in style_tree.low_importance(frame).filter("not is_text").collect()}
    top = style_tree.branches_of(Page(rows[0][2]).blocks[0].branches)
    assert len(top) == 202 and top[-1] in low
    assert extracted(rows[0][2], frozenset([top[-1]]), NONE) == "Story 0"


def importance_by_hand(pages_of_host):
    """Importance of every text and branch by counting over whole pages, in plain Python."""
    import math

    seen = {"\n".join(b.text for b in p.blocks): p for p in pages_of_host}
    m, texts, orders, ways = len(seen), {}, {}, {}
    for whole, page in seen.items():
        for b in page.blocks:
            texts.setdefault((b.path, style_tree.hashed(f"{b.path} {b.text}")), set()).add(whole)
            ways[b.path] = style_tree.branches_of(b.branches)
        for path, order in page.orders:
            orders.setdefault(path, {}).setdefault(order, set()).add(whole)
    worth = {key: 1 - math.log(len(n)) / math.log(m) for key, n in texts.items()}
    low = {(item, True) for (_, item), value in worth.items() if value < style_tree.MIN_IMPORTANCE}
    for node in {n for way in ways.values() for n in way}:
        below = [value for (path, _), value in worth.items() if node in ways[path]]
        counts = [len(n) for n in orders[node].values()]
        if sum(counts) < style_tree.MIN_PAGES:
            continue
        spread = -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts) / math.log(m)
        weight = style_tree.DECAY ** len(counts)
        value = (1 - weight) * min(1.0, spread) + weight * sum(below) / len(below)
        if value < style_tree.MIN_IMPORTANCE:
            low.add((node, False))
    return low


def test_importance_equals_a_count_by_hand(spark):
    frame = spark.createDataFrame(pages(13) + pages(5, "k.example"), "page_id bigint, url string, html string")
    got = {(r.node, r.is_text) for r in style_tree.low_importance(frame).collect()}
    by_host = [importance_by_hand([Page(html) for _, _, html in pages(n)]) for n in (13, 5)]
    assert got == by_host[0] | by_host[1] and len(got) > 3


def test_shared_branches_and_texts_go(spark):
    frame = spark.createDataFrame(pages(), "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in style_tree.main_text(frame).collect()}
    assert got == {k: f"Story {k} of many\nMore {k * k} words" for k in range(20)}


def test_copies_and_small_hosts_are_no_evidence(spark):
    story = "<body><p>One long story</p><p>told again</p>"
    rows = [(k, "https://copies.example/a", story) for k in range(30)]
    rows += [(100 + k, f"https://few.example/{k}", "<body><p>Same text</p>") for k in range(3)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in style_tree.main_text(frame).collect()}
    assert {got[k] for k in range(30)} == {"One long story\ntold again"}
    assert {got[k] for k in range(100, 103)} == {"Same text"}


def test_texts_count_once_a_page(spark):
    cells = "".join("<tr><td>yes</td><td>no</td></tr>" for _ in range(30))
    rows = [
        (k, f"https://cells.example/{k}", f"<body><div><p>Story {k}</p>{f'<table>{cells}</table>' if k < 2 else ''}</div>")
        for k in range(20)
    ]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in style_tree.main_text(frame).collect()}
    assert got[0] == "Story 0\n" + "\n".join(["yes", "no"] * 30) and got[5] == "Story 5"


def test_a_hot_group_of_copies_and_a_near_copy_is_no_evidence(spark):
    shared = "".join(f"<p>Part {k} of the saga</p>" for k in range(5))
    rows = [(k, "https://hot.example/s", f"<body><div>{shared}<p>The end</p></div>") for k in range(160)]
    rows.append((160, "https://hot.example/t", f"<body><div>{shared}<p>Another end</p></div>"))
    rows += [(k, f"https://hot.example/{k}", f"<body><div><p>Story {k}</p><p>of its own {k}</p></div>") for k in range(161, 200)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in style_tree.main_text(frame).collect()}
    saga = [f"Part {k} of the saga" for k in range(5)]
    assert got[0] == [*saga, "The end"] and got[160] == [*saga, "Another end"]


def test_large_tables_of_noise_are_joined_salted(spark, monkeypatch):
    monkeypatch.setattr(style_tree, "BROADCAST_ROWS", -1)
    frame = spark.createDataFrame(pages() + pages(10, "k.example"), "page_id bigint, url string, html string")
    texts = [r.text for r in style_tree.main_text(frame).collect()]
    assert len(texts) == 30 and not any("Welcome" in t or "Follow" in t for t in texts)


def test_awkward_rows(spark):
    rows = [(1, None, "<p>a</p>"), (None, "no host", "<p>b</p>"), (2, "http://x/", None), (2, "http://x/", None)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as paths")
    got = sorted(((r.page_id or -1, r.text, r.n_chars) for r in style_tree.main_text(frame).collect()))
    assert got == [(-1, "b", 1), (1, "a", 1), (2, "", 0), (2, "", 0)]
    assert style_tree.main_text(frame.filter("page_id < 0")).count() == 0


@pytest.mark.parametrize("piece", ["<div>", "<p>", "<li>", "<a ", "<!-- x", "</div>", "<script>", "<b>t</b>", "<div class='a", "<td><div>"])
def test_time_grows_with_the_page(piece):
    def seconds(n):
        started = time.thread_time()
        Page(piece * n)
        return time.thread_time() - started

    seconds(2000)
    assert seconds(40_000) < 30 * seconds(4000) + 0.5
