"""Markup rules the captured pages do not show, over markup built from ``documents``.

The SQL that builds the markup is plain enough to run in both engines unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.config import DEFAULT, RULE_BREAK, SPACER_BREAK
from inkloom.functions import markup, strings
from inkloom.operators import extract
from inkloom.operators.events import page_events
from inkloom.suite import query, table
from inkloom.suite.texts import sql_escape, sql_trim

ESCAPED = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
BREAKS = f"('{RULE_BREAK}', '{SPACER_BREAK}')"
SCENE = r"^[-_*]{3,}$|^\* *\* *\* *$|^—+$|^†$"


def _documents(spark, sf_dir, **columns: str) -> DataFrame:
    named = [F.expr(sql).alias(name) for name, sql in columns.items()]
    return table(spark, sf_dir, "documents").select("doc_id", *named)


# Every document twice: with its source, which picks a canned case, and without, so that its own
# whole text is used.
CASES = """WITH cases AS (SELECT 2 * doc_id AS doc_id, text, lang, source FROM documents
  UNION ALL SELECT 2 * doc_id + 1, text, lang, 'own' FROM documents) """


def _cases(spark, sf_dir, **columns: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    canned = docs.select((2 * F.col("doc_id")).alias("doc_id"), "text", "lang", "source")
    own = docs.select((2 * F.col("doc_id") + 1).alias("doc_id"), "text", "lang", F.lit("own").alias("source"))
    named = [F.expr(sql).alias(name) for name, sql in columns.items()]
    return canned.unionByName(own).select("doc_id", *named)


def _pages(spark, sf_dir, html: str, rows=_documents) -> DataFrame:
    pages = rows(spark, sf_dir, html=html)
    return pages.select(F.col("doc_id").alias("page_id"), F.lit("https://site.example/").alias("url"), "html")


def _rows(frame: DataFrame, pieces, out: str) -> DataFrame:
    rows = frame.select("doc_id", F.posexplode(pieces).alias("_at", out))
    return rows.select("doc_id", (F.col("_at") + 1).alias("ord"), out)


def sql_label(text: str) -> str:
    plain = f"translate({sql_trim(text)}, '{strings.NAV_GLYPHS}', '')"
    return f"regexp_replace(lower({plain}), '[\\t\\n\\f\\r ]+', ' ', 'g')"


LABEL_TEXT = "concat(' « ', text, CASE WHEN lang = 'en' THEN ' →' ELSE '►' END)"


@query("nav_label", f"SELECT doc_id, {sql_label(LABEL_TEXT)} AS label FROM documents")
def nav_label(spark, sf_dir) -> DataFrame:
    rows = _documents(spark, sf_dir, label=LABEL_TEXT)
    return rows.select("doc_id", strings.nav_label(F.col("label")).alias("label"))


LINK_LABEL = """CASE source WHEN 'src0' THEN 'Next Chapter' WHEN 'src1' THEN ' previous page '
  WHEN 'src2' THEN 'Next Chapter →' WHEN 'src3' THEN '→' WHEN 'src4' THEN '' WHEN 'src5' THEN 'NEXT'
  WHEN 'src6' THEN 'Prev' WHEN 'src7' THEN '»' WHEN 'src8' THEN 'Contents' ELSE text END"""
LINK_LABEL_HTML = LINK_LABEL.replace("ELSE text", f"ELSE {ESCAPED}")
NAV_PAGE = f"""concat('<html><body><article><h1>T</h1><p> <a href="/n">', {LINK_LABEL_HTML}, '</a>',
  CASE lang WHEN 'de' THEN ' more' WHEN 'fr' THEN '<br> <a href="/p">prev</a>' ELSE '' END,
  '</p></article></body></html>')"""


@query(
    "nav_only_block",
    f"""{CASES} SELECT doc_id, lang <> 'de' AND (regexp_matches(label, '^(prev(ious)?|next)(\\s+(chapter|page))?$')
      OR label IN ('', '>>', '<<', 'next', 'prev', 'previous', 'next chapter', 'next page',
                   'previous chapter')) AS nav_only
    FROM (SELECT *, {sql_label(LINK_LABEL)} AS label FROM cases)""",
)
def nav_only_block(spark, sf_dir) -> DataFrame:
    events = page_events(_pages(spark, sf_dir, NAV_PAGE, _cases), keep_attrs=extract.kept_attributes(DEFAULT))
    block = F.get("candidates", F.lit(0))
    return extract.page_candidates(events).select(
        F.col("page_id").alias("doc_id"), block["skip"].alias("nav_only")
    )


BREAK_TEXT = """CASE source WHEN 'src0' THEN '***' WHEN 'src1' THEN '* * *' WHEN 'src2' THEN '———'
  WHEN 'src3' THEN '†' WHEN 'src4' THEN '--' WHEN 'src5' THEN '' WHEN 'src6' THEN '-_*-'
  WHEN 'src7' THEN '*** ' ELSE text END"""


@query(
    "is_scene_break",
    f"""{CASES} SELECT doc_id, {sql_trim('t')} <> '' AND regexp_matches(t, '{SCENE}') AS is_break
    FROM (SELECT doc_id, {BREAK_TEXT} AS t FROM cases)""",
)
def is_scene_break(spark, sf_dir) -> DataFrame:
    hit = markup.is_scene_break(F.col("t"), DEFAULT.scene_break_patterns)
    return _cases(spark, sf_dir, t=BREAK_TEXT).select("doc_id", hit.alias("is_break"))


STYLE = "CASE lang WHEN 'en' THEN 'hr' WHEN 'fr' THEN 'Spacer' WHEN 'de' THEN 'NONE' ELSE source END"


@query(
    "scene_break_html",
    f"""SELECT doc_id, CASE lower({STYLE}) WHEN 'spacer' THEN '{SPACER_BREAK}' WHEN 'none' THEN ''
      ELSE '{RULE_BREAK}' END AS html FROM documents""",
)
def scene_break_html(spark, sf_dir) -> DataFrame:
    rows = _documents(spark, sf_dir, style=STYLE)
    return rows.select("doc_id", markup.scene_break_html(F.col("style")).alias("html"))


# Ends of sentences become runs of two to five line breaks in several spellings.
BR_TEXT = """replace(replace(text, '. ', CASE lang WHEN 'en' THEN '<br/><BR>' ELSE '<br> <br /><BR/>' END),
  ', ', '<br/><br/><br/> <br><br/>')"""


@query(
    "br_runs_to_break",
    f"""SELECT doc_id, regexp_replace(t, '(?i)(?:<br[\\t\\n\\f\\r ]*/?>[\\t\\n\\f\\r ]*){{3,}}', '{RULE_BREAK}', 'g') AS html
    FROM (SELECT doc_id, {BR_TEXT} AS t FROM documents)""",
)
def br_runs_to_break(spark, sf_dir) -> DataFrame:
    rows = _documents(spark, sf_dir, t=BR_TEXT)
    return rows.select("doc_id", markup.br_runs_to_break(F.col("t"), DEFAULT).alias("html"))


SPLIT_TEXT = f"replace(replace(text, '. ', '{RULE_BREAK}'), ', ', '{SPACER_BREAK}')"


@query(
    "split_on_break",
    f"""SELECT doc_id, unnest(l) AS piece, unnest(range(1, len(l) + 1))::INT AS ord FROM (
      SELECT doc_id, list_filter(string_split(regexp_replace({SPLIT_TEXT},
        '({RULE_BREAK}|{SPACER_BREAK})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') AS l
      FROM documents)""",
)
def split_on_break(spark, sf_dir) -> DataFrame:
    return _rows(_documents(spark, sf_dir, t=SPLIT_TEXT), markup.split_on_break(F.col("t")), "piece")


@query(
    "wrap_block",
    f"""WITH t AS (SELECT doc_id, regexp_replace({BR_TEXT.replace('text', ESCAPED)},
        '(?i)(?:<br[\\t\\n\\f\\r ]*/?>[\\t\\n\\f\\r ]*){{3,}}', chr(1) || '{RULE_BREAK}' || chr(1), 'g') AS t FROM documents),
    l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda p:
        CASE WHEN {sql_trim('p')} = '' THEN '' WHEN p = '{RULE_BREAK}' THEN p ELSE '<p>' || {sql_trim('p')} || '</p>' END),
        lambda p: p <> '') AS l FROM t)
    SELECT doc_id, unnest(l) AS html, unnest(range(1, len(l) + 1))::INT AS ord FROM l""",
)
def wrap_block(spark, sf_dir) -> DataFrame:
    """One block per document, cut into blocks at its runs of line breaks."""
    rows = _documents(spark, sf_dir, t=BR_TEXT.replace("text", ESCAPED))
    return _rows(rows, extract.wrap_block(F.lit("p"), F.col("t"), DEFAULT), "html")


# Words as blocks: two kinds of breaks fall next to each other often.
WORD_BLOCK = f"""CASE WHEN w LIKE '%a%' THEN '{RULE_BREAK}' WHEN w LIKE '%o%' THEN '{SPACER_BREAK}'
  ELSE concat('<p>', w, '</p>') END"""


@query(
    "dedupe_adjacent_breaks",
    f"""WITH words AS (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS k
      FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)),
    b AS (SELECT doc_id, k, {WORD_BLOCK} AS html FROM words),
    f AS (SELECT *, html IN {BREAKS} AND
        coalesce(lag(html) OVER (PARTITION BY doc_id ORDER BY k) IN {BREAKS}, false) AS gone FROM b)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INT AS ord, html FROM f WHERE NOT gone""",
)
def dedupe_adjacent_breaks(spark, sf_dir) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    block = lambda w: (
        F.when(F.contains(w, F.lit("a")), F.lit(RULE_BREAK))
        .when(F.contains(w, F.lit("o")), F.lit(SPACER_BREAK))
        .otherwise(F.concat(F.lit("<p>"), w, F.lit("</p>")))
    )
    blocks = extract.settle(words, ["doc_id"], blocks=F.transform("words", block))
    return _rows(blocks, markup.dedupe_adjacent_breaks(F.col("blocks")), "html")


HEAD_LINK = """CASE lang WHEN 'fr' THEN '<link rel="prenext" href="/rel">' WHEN 'de' THEN '<link rel="next">'
  ELSE '<link rel="prev" href="/prev">' END"""
LINK_BODY = f"""CASE source WHEN 'src0' THEN '<a href="">Next</a><a href="/second"> Next </a>'
  WHEN 'src1' THEN '<a href="/fuzzy">read NEXT part</a>' WHEN 'src2' THEN '<a>next up</a><a href="/x">next</a>'
  WHEN 'src3' THEN '<a href="/arrow"> → </a>'
  ELSE concat('<nav><a href="/hidden">Next</a></nav><a href="/text">', {ESCAPED}, '</a>') END"""
LINK_PAGE = f"""concat('<html><head>', {HEAD_LINK}, '</head><body>',
  CASE WHEN source = 'src4' THEN '<nav><a href="/shown">Next</a></nav>' ELSE '' END,
  '<article><h1>T</h1><p>', {LINK_BODY}, '</p></article></body></html>')"""


@query(
    "next_link",
    CASES + """SELECT doc_id, CASE WHEN lang = 'fr' THEN '/rel' WHEN source = 'src0' THEN '/second'
      WHEN source = 'src1' THEN '/fuzzy' WHEN source = 'src2' THEN NULL WHEN source = 'src3' THEN '/arrow'
      WHEN source = 'src4' THEN '/shown' WHEN regexp_matches(text, '(?i)next') THEN '/text' END AS next_href
    FROM cases""",
)
def next_link(spark, sf_dir) -> DataFrame:
    """Every rule of the next link: relation, exact label, loose label, and what noise hides."""
    events = page_events(_pages(spark, sf_dir, LINK_PAGE, _cases), keep_attrs=extract.kept_attributes(DEFAULT))
    live = extract.live_events(extract.rooted_events(events))
    href = extract.next_href(F.col("opens"), F.col("live"), F.col("root"))
    return live.select(F.col("page_id").alias("doc_id"), href.alias("next_href"))


# Line ends of another system, a heading closed by another, end tags out of place, a comment that
# ends at once, and a parameter that begins like a character reference.
RULES_PAGE = f"""concat('<html><body><article><h1>', source, '</h2><p>', replace({ESCAPED}, chr(10), chr(13) || chr(10)),
  '</p><!--><span><p>in</span>side</p></span><table><tr><td>cell</article></td></tr></table>',
  '<ul><li>a<blockquote><li>b</blockquote><li>c</ul><a href="/c?b=5&section=', source, '&copy=1&amp;z">next</a>',
  '</article></body></html>')"""


@query(
    "tree_rules",
    """SELECT doc_id, source || '|' || replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))
        || '|in|side|cell|a|b|c|next' AS texts,
      'html,body,article,h1,p,span,p,table,tr,td,ul,li,blockquote,li,li,a' AS tags,
      '/c?b=5&section=' || source || '&copy=1&z' AS href
    FROM documents""",
)
def tree_rules(spark, sf_dir) -> DataFrame:
    """The tree of broken markup around every whole text."""
    events = page_events(_pages(spark, sf_dir, RULES_PAGE), keep_attrs=["href"])
    of = lambda kind: F.filter("events", lambda e: e["kind"] == kind)
    link = F.element_at(F.filter("events", lambda e: e["tag"] == "a"), 1)
    return events.select(
        F.col("page_id").alias("doc_id"),
        F.array_join(F.transform(of("text"), lambda e: e["text"]), "|").alias("texts"),
        F.array_join(F.transform(of("open"), lambda e: e["tag"]), ",").alias("tags"),
        link["attrs"]["href"].alias("href"),
    )


# Pages without a heading or a title, and roots that only later rules find.
BRANCH_HEAD = "CASE WHEN lang = 'en' THEN concat('Head ', source) ELSE '' END"
BRANCH_META = """CASE WHEN lang = 'fr' THEN '' ELSE concat('<meta property="og:title" content="Meta ', source, '">') END"""
BRANCH_ROOT = f"""CASE WHEN source IN ('src0', 'src1') THEN concat('<article>before<div class="entry-content">', {ESCAPED}, '</div></article>')
  WHEN source IN ('src2', 'src3') THEN concat('<div class="post-content">', {ESCAPED}, '</div><article>later</article>')
  WHEN source IN ('src4', 'src5') THEN concat('<div class="box content">', {ESCAPED}, '</div>')
  WHEN source IN ('src6', 'src7') THEN concat('<div id="content">', {ESCAPED}, '</div>')
  ELSE {ESCAPED} END"""
BRANCH_PAGE = f"""concat('<html><head>', {BRANCH_META}, '</head><body><h1>', {BRANCH_HEAD}, '</h1><div>outer</div>',
  {BRANCH_ROOT}, '<div>tail</div></body></html>')"""
UNIX = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query(
    "page_branches",
    f"""SELECT doc_id, CASE WHEN lang = 'en' THEN 'Head ' || source WHEN lang = 'fr' THEN 'Untitled Chapter'
      ELSE 'Meta ' || source END AS title,
      CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN {UNIX}
      ELSE {BRANCH_HEAD} || 'outer' || {UNIX} || 'tail' END AS words
    FROM documents""",
)
def page_branches(spark, sf_dir) -> DataFrame:
    """Title and content root by every rule, with the whole text inside."""
    events = page_events(_pages(spark, sf_dir, BRANCH_PAGE), keep_attrs=extract.kept_attributes(DEFAULT))
    live = extract.live_events(extract.rooted_events(events))
    words = extract.inside_text(F.col("live"), F.col("root"))
    return live.select(F.col("page_id").alias("doc_id"), "title", words.alias("words"))


STATUS = "CASE WHEN source = 'src1' THEN 404 WHEN source = 'src2' THEN 503 WHEN source = 'src3' THEN 200 END"
STATUS_PAGE = f"concat('<article><p>', repeat('long ', 20), {ESCAPED}, '</p></article>')"


@query(
    "status_rejects",
    f"""SELECT doc_id AS page_id, 'https://site.example/' AS url, 'http status ' || {STATUS} AS reject_reason
    FROM documents WHERE {STATUS} >= 400""",
)
def status_rejects(spark, sf_dir) -> DataFrame:
    """Captures of error pages, whatever their text."""
    pages = _documents(spark, sf_dir, html=STATUS_PAGE, status=STATUS)
    url = F.lit("https://site.example/").alias("url")
    return extract.rejects(pages.select(F.col("doc_id").alias("page_id"), url, "html", "status"))


MARKUP = f"""concat('<blockquote><p><strong>', replace({ESCAPED}, chr(10), '</strong></p><p><strong>'),
  '</strong></p></blockquote>{RULE_BREAK}<hr/><em>', source, '</em>')"""


def sql_simplified(text: str) -> str:
    for old, new in markup.SIMPLE_MARKUP:
        text = f"replace({text}, '{old}', '{new}')"
    return text


@query("simplify_markup", f"SELECT doc_id, {sql_simplified(MARKUP)} AS html FROM documents")
def simplify_markup(spark, sf_dir) -> DataFrame:
    rows = _documents(spark, sf_dir, t=MARKUP)
    return rows.select("doc_id", markup.simplify_markup(F.col("t")).alias("html"))


TEXT_HTML = f"""concat('<blockquote><p>', replace({sql_escape('text')}, chr(10), concat('</p>', chr(10), '<p>')),
  '</p></blockquote>', chr(10), '{RULE_BREAK}', chr(10), '<p><i>', source, '</i></p>')"""


@query(
    "html_to_text",
    """SELECT doc_id, chr(10) || replace(text, chr(10), repeat(chr(10), 3)) || repeat(chr(10), 6) || source AS text
    FROM documents""",
)
def html_to_text(spark, sf_dir) -> DataFrame:
    rows = _documents(spark, sf_dir, t=TEXT_HTML)
    return rows.select("doc_id", markup.html_to_text(F.col("t")).alias("text"))
