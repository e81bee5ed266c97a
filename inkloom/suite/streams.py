"""Streams over the same files; each must give what its batch query gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from inkloom.session import shared_folder
from inkloom.sources.pages import PAGE_SCHEMA
from inkloom.streaming import stream_chapters, stream_chunks, table_stream
from inkloom.streaming.store import ChapterStore, stream_saves
from inkloom.suite import query, table
from inkloom.suite.books import STORE_SQL
from inkloom.suite.pages import CHAPTERS_SQL
from inkloom.suite.texts import chunk_ctes
from inkloom.suite.turns import chapters_of


def _drained(spark, start) -> DataFrame:
    """Run a stream over what is there now and read its output back."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    started = start(f"{folder}/out", f"{folder}/checkpoint")
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_chapters", CHAPTERS_SQL)
def chapters(spark, sf_dir) -> DataFrame:
    pages = table_stream(spark, f"{sf_dir}/pages.parquet", PAGE_SCHEMA)
    return _drained(spark, lambda out, checkpoint: stream_chapters(pages, out, checkpoint))


@query(
    "stream_chunks",
    f"WITH RECURSIVE {chunk_ctes(1800)} SELECT doc_id, part_no, text, n_chars FROM chunks",
)
def chunks(spark, sf_dir) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents = table_stream(spark, f"{sf_dir}/documents.parquet", scan.schema)
    return _drained(
        spark, lambda out, checkpoint: stream_chunks(documents, out, checkpoint, key="doc_id")
    )


@query("stream_store", f"WITH {STORE_SQL} SELECT book_id, slug, seq, url, title, code, html FROM store")
def store(spark, sf_dir) -> DataFrame:
    """Chapters saved batch by batch as they arrive, the last one of a slug kept."""
    folder = f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "conversations").schema
    arriving = chapters_of(table_stream(spark, f"{sf_dir}/conversations.parquet", schema))
    kept = ChapterStore(f"{folder}/store", buckets=16)
    stream_saves(arriving, kept.save, f"{folder}/checkpoint").awaitTermination()
    return kept.chapters(spark).select("book_id", "slug", "seq", "url", "title", "code", "html")
