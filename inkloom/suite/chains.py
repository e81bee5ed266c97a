"""Edges, walks and chained chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators import chain, extract
from inkloom.operators.books import book_txt
from inkloom.plans.pipelines import books_from_pages, chapter_counts_from_pages
from inkloom.session import cut_lineage
from inkloom.suite import query
from inkloom.suite.turns import TURNS_SQL, turn_edges, turn_pages, turn_starts

MAX_PAGES = 50


@query(
    "next_edge",
    f"""WITH {TURNS_SQL} SELECT t.url, t.next_url, n.url IS NOT NULL AS target_found
    FROM turns t LEFT JOIN turns n ON n.url = t.next_url""",
)
def next_edge(spark, sf_dir) -> DataFrame:
    return chain.next_edges(chain.page_edges(turn_edges(spark, sf_dir)))


@query(
    "next_page",
    f"""WITH {TURNS_SQL} SELECT t.url, t.next_url, n.title AS next_title, n.html AS next_html
    FROM good t LEFT JOIN good n ON n.url = t.next_url""",
)
def next_page(spark, sf_dir) -> DataFrame:
    """Every good page with the title and text of the page that follows it."""
    pages = cut_lineage(extract.chapters(turn_pages(spark, sf_dir)))
    thin = chain.page_edges(pages.select("url", "next_href"))
    return chain.next_pages(thin, pages, "title", "html")


@query(
    "dangling_next",
    f"""WITH {TURNS_SQL} SELECT url, next_url FROM turns t
    WHERE NOT EXISTS (SELECT 1 FROM turns n WHERE n.url = t.next_url)""",
)
def dangling(spark, sf_dir) -> DataFrame:
    return chain.dangling_next(chain.page_edges(turn_edges(spark, sf_dir)))


def walk_sql(source: str, starts: str, limit: int) -> str:
    return f"""walk AS (
      SELECT url AS start_url, 0::BIGINT AS seq, url FROM {source} WHERE {starts}
      UNION ALL
      SELECT w.start_url, w.seq + 1, n.url FROM walk w JOIN {source} t ON t.url = w.url
      JOIN {source} n ON n.url = t.next_url WHERE w.seq + 1 < {limit})"""


@query(
    "crawl_chain",
    f"WITH RECURSIVE {TURNS_SQL}, {walk_sql('turns', 'turn = 0', 3)} SELECT start_url, seq, url FROM walk",
)
def crawl_chain(spark, sf_dir) -> DataFrame:
    """At most three pages from the first page of every conversation."""
    edges = chain.page_edges(turn_edges(spark, sf_dir))
    return chain.crawl_many(edges, turn_starts(spark, sf_dir), 3)


@query(
    "crawl_many",
    f"WITH RECURSIVE {TURNS_SQL}, {walk_sql('turns', 'true', MAX_PAGES)} SELECT start_url, seq, url FROM walk",
)
def crawl_many(spark, sf_dir) -> DataFrame:
    """A walk from every page: walks share their tails."""
    edges = chain.page_edges(turn_edges(spark, sf_dir))
    return chain.crawl_many(edges, edges.select(F.col("url").alias("start_url")), MAX_PAGES)


BOOKS_SQL = f"""WITH RECURSIVE {TURNS_SQL}, {walk_sql('good', 'turn = 0', MAX_PAGES)},
books AS (SELECT w.start_url AS book_id, w.seq + 1 AS seq, g.url, g.title, g.code, g.html
          FROM walk w JOIN good g ON g.url = w.url)"""


def _books(spark, sf_dir) -> DataFrame:
    return books_from_pages(turn_pages(spark, sf_dir), turn_starts(spark, sf_dir), MAX_PAGES)


@query("chain_pages", f"{BOOKS_SQL} SELECT book_id, seq, url, title, code, html FROM books")
def chain_pages(spark, sf_dir) -> DataFrame:
    """Raw pages to ordered chapters: extraction, link resolution, walk and join."""
    return _books(spark, sf_dir).drop("page_id")


@query("chain_latest_captures", f"{BOOKS_SQL} SELECT book_id, seq, url, title, code, html FROM books")
def chain_latest_captures(spark, sf_dir) -> DataFrame:
    """Every page captured twice: the later capture counts, so the books are those of one capture."""
    pages = turn_pages(spark, sf_dir)
    lowest = F.lit(-(2**63))
    older = pages.select(
        F.greatest(lowest, F.shiftright("page_id", 1) - F.lit(2**62)).alias("page_id"), "url",
        F.replace("html", F.lit("<h1>"), F.lit("<h1>Outdated ")).alias("html"),
    )
    newer = pages.select(F.shiftrightunsigned("page_id", 1).alias("page_id"), "url", "html")
    both = older.unionByName(newer)
    return books_from_pages(both, turn_starts(spark, sf_dir), MAX_PAGES).drop("page_id")


@query("chapter_count", f"{BOOKS_SQL} SELECT book_id, count(*) AS chapters FROM books GROUP BY book_id")
def chapter_count(spark, sf_dir) -> DataFrame:
    pages, starts = turn_pages(spark, sf_dir), turn_starts(spark, sf_dir)
    return chapter_counts_from_pages(pages, starts, MAX_PAGES)


@query(
    "pages_to_book_txt",
    f"""{BOOKS_SQL} SELECT book_id, seq AS chapter_no, CASE WHEN seq > 1 THEN chr(10) ELSE '' END || title
      || chr(10) || chr(10) || plain || chr(10) AS text
    FROM (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(html,
      '</p>' || chr(10) || '<p>', repeat(chr(10), 3)), '<p>', ''), '</p>', ''), '&#39;', ''''), '&#34;', '"'),
      '&gt;', '>'), '&lt;', '<'), '&amp;', '&') AS plain FROM books)""",
)
def pages_to_book_txt(spark, sf_dir) -> DataFrame:
    """The whole way from raw pages to the text of every book."""
    return book_txt(_books(spark, sf_dir).select("book_id", "seq", "title", "html"))
