"""Pages to books, and documents to speech requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.config import DEFAULT, ExtractConfig, SitePresets
from inkloom.functions.sentences import MAX_CHARS
from inkloom.operators import chain
from inkloom.operators.chunks import chunks
from inkloom.operators.extract import chapters
from inkloom.operators.keyed import lookup_join
from inkloom.operators.voices import resolve_voice, synth_requests
from inkloom.session import cut_lineage


def _walk(extracted: DataFrame, starts: DataFrame, max_pages: int, **tuning) -> DataFrame:
    """Walks over the latest capture of every url, each step with its ``page_id``."""
    captures = cut_lineage(chain.latest_captures(extracted.select("url", "page_id", "next_href"), "next_href"))
    walk = chain.crawl_many(chain.page_edges(captures), starts, max_pages, **tuning)
    return lookup_join(
        walk, captures.select("url", "page_id"), "url", spread=["start_url", "seq"], how="inner", **tuning
    )


def books_from_pages(
    pages: DataFrame,
    starts: DataFrame,
    max_pages: int,
    config: ExtractConfig = DEFAULT,
    **tuning,
) -> DataFrame:
    """One book per start page: every page is extracted once, in parallel, and then ordered.

    The chapters are written to the shared checkpoint folder, since the walk and the final join
    both read them and extraction is the expensive part. Of a page captured more than once the
    good capture of the largest ``page_id`` counts.
    """
    extracted = cut_lineage(chapters(pages, config))
    walk = _walk(extracted, starts, max_pages, **tuning)
    return chain.chain_chapters(
        walk, extracted.select("url", "page_id", "title", "code", "html"), "page_id", **tuning
    )


def chapter_counts_from_pages(
    pages: DataFrame,
    starts: DataFrame,
    max_pages: int,
    config: ExtractConfig = DEFAULT,
    **tuning,
) -> DataFrame:
    """Chapters per book; only addresses and links are written, no html."""
    thin = cut_lineage(chapters(pages, config).select("url", "page_id", "next_href"))
    walk = _walk(thin, starts, max_pages, **tuning)
    return chain.chapter_counts(walk.withColumnRenamed("start_url", "book_id"))


def site_chapters(
    pages: DataFrame, sites: DataFrame, presets: dict[str, ExtractConfig], default: ExtractConfig = DEFAULT
) -> DataFrame:
    """Chapters by per-site settings: ``sites`` names the preset of a ``host``.

    A preset is a whole configuration, so selectors, link texts, patterns and limits all take
    effect. Hosts without a row, or with an unknown preset, use ``default``. The name of the preset
    travels with the page: pages are read, joined and parsed once for any number of presets.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    named = sites.select(F.lower("host").alias("_host"), F.col("preset").alias("_preset")).dropDuplicates(["_host"])
    hosted = pages.withColumn("_host", host)
    joined = lookup_join(hosted, named, "_host", spread=["page_id"]).drop("_host")
    return chapters(joined, SitePresets(presets, default))


def requests_from_documents(
    documents: DataFrame,
    voices: DataFrame,
    aliases: DataFrame,
    limit: int = MAX_CHARS,
    requested: str = "lang",
) -> DataFrame:
    """Ready-to-send requests: one per chunk, with the voice each document asks for."""
    asked = documents.select("doc_id", "text", F.col(requested).alias("requested"))
    # Voices are looked up per document, before there are chunks to carry them to.
    voiced = resolve_voice(asked, voices, aliases, "requested")
    parts = chunks(voiced, limit, keep=("voice", "lang_code"))
    return synth_requests(parts.drop("n_chars"), voice=F.col("voice"))
