"""Chapters to stored chapters, book text and book sections.

A book is never one row: every output keeps a row per chapter (or fragment) and an ordinal, so
a book may be larger than any single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.markup import escape_html, html_to_text
from inkloom.functions.strings import chapter_slug, safe_name
from inkloom.operators.keyed import numbered


def with_slug(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("slug", chapter_slug(F.col("code"), F.col("title")))


def chapter_store(chapters: DataFrame) -> DataFrame:
    """The last chapter (by ``seq``, unique in a book) of every slug of a book.

    Which one is found on thin columns, combined before they shuffle; the chapters are dealt once
    against that, by a hash join so that no html is sorted.
    """
    slugged = chapters if "slug" in chapters.columns else with_slug(chapters)
    keys = ["book_id", "slug", "seq"]
    latest = slugged.groupBy("book_id", "slug").agg(F.max("seq").alias("seq"))
    others = [name for name in slugged.columns if name not in ("book_id", "slug")]
    stored = slugged.join(latest.hint("shuffle_hash"), keys, "left_semi")
    return stored.select("book_id", "slug", *others)


def chapter_meta(stored: DataFrame) -> DataFrame:
    """Metadata document and relative path of every stored chapter."""
    path = F.concat(F.lit("chapters/"), F.col("slug"), F.lit("/index.html"))
    meta = F.to_json(F.struct("code", path.alias("html"), "title", "url"))
    return stored.select("book_id", "slug", path.alias("path"), meta.alias("meta"))


def chapter_number(chapters: DataFrame, **tuning) -> DataFrame:
    """Adds the 1-based ``chapter_no`` and its three-digit form."""
    counted = numbered(chapters, ["book_id"], "seq", "chapter_no", **tuning)
    return counted.withColumn("chapter_label", F.format_string("%03d", F.col("chapter_no")))


def book_txt(chapters: DataFrame, **tuning) -> DataFrame:
    """Text each chapter adds to its book; joined in ``chapter_no`` order they are the file."""
    counted = chapter_number(chapters, **tuning)
    gap = F.when(F.col("chapter_no") > 1, F.lit("\n")).otherwise("")
    text = F.concat(gap, F.col("title"), F.lit("\n"), html_to_text(F.col("html")), F.lit("\n"))
    return counted.select("book_id", "chapter_no", text.alias("text"))


def book_sections(chapters: DataFrame, *, toc: bool = True, **tuning) -> DataFrame:
    """Sections of every book in order of ``section_no`` then ``fragment_no``.

    Chapters are sections of one fragment. The contents page, section 0, is one fragment per
    entry between an opening and a closing fragment.
    """
    counted = chapter_number(chapters, **tuning).withColumn(
        "file_name",
        F.concat(
            F.lit("ch_"), F.col("chapter_label"), F.lit("_"), safe_name(F.col("code")), F.lit(".xhtml")
        ),
    )
    heading = escape_html(F.col("title"))
    body = F.concat(F.lit("<h2>"), heading, F.lit("</h2>"), F.col("html"))
    one = F.lit(1).cast("bigint")
    sections = counted.select(
        "book_id", F.col("chapter_no").alias("section_no"), one.alias("fragment_no"),
        "file_name", "title", body.alias("body"),
    )
    if not toc:
        return sections
    zero = F.lit(0).cast("bigint")
    page = (F.lit("toc.xhtml").alias("file_name"), F.lit("Table of Contents").alias("title"))
    entry = F.concat(
        F.lit('<li><a href="'), F.col("file_name"), F.lit('">'), heading, F.lit("</a></li>")
    )
    entries = counted.select(
        "book_id", zero.alias("section_no"), F.col("chapter_no").alias("fragment_no"),
        *page, entry.alias("body"),
    )
    ends = F.array(
        F.struct(zero.alias("fragment_no"), F.lit("<h1>Table of Contents</h1><ol>").alias("body")),
        F.struct((F.col("_count") + 1).alias("fragment_no"), F.lit("</ol>").alias("body")),
    )
    frame = (
        chapters.groupBy("book_id")
        .agg(F.count(F.lit(1)).alias("_count"))
        .select("book_id", F.inline(ends))
        .select("book_id", zero.alias("section_no"), "fragment_no", *page, "body")
    )
    return sections.unionByName(entries).unionByName(frame)
