"""Writers: ordered, split by key and safe for books larger than one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _spread(frame: DataFrame, keys: list[str], order: list[str], files: int | None) -> DataFrame:
    """Range partitions over key and order: a large key fills several, small keys share one."""
    columns = [*keys, *order]
    ranged = (
        frame.repartitionByRange(files, *columns) if files else frame.repartitionByRange(*columns)
    )
    return ranged.sortWithinPartitions(*columns)


def write_chapter_store(stored: DataFrame, path: str, *, buckets: int = 64, files: int | None = None) -> None:
    """Chapters with their metadata, in a fixed number of book buckets."""
    bucket = F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int")
    spread = _spread(stored.withColumn("book_bucket", bucket), ["book_bucket", "book_id"], ["slug"], files)
    spread.write.mode("overwrite").partitionBy("book_bucket").parquet(path)


def write_book_text(lines: DataFrame, path: str, *, files: int | None = None) -> None:
    """``book_id=.../part-*.txt``: a book's files in name order are its text."""
    if lines.isEmpty():
        raise ValueError("no chapters to write")
    # The writer ends every row with the newline the text already ends with.
    rows = _spread(lines, ["book_id"], ["chapter_no"], files).select(
        "book_id", F.regexp_replace("text", r"\n\z", "").alias("value")
    )
    rows.write.mode("overwrite").partitionBy("book_id").text(path)


def write_manifest(parts: DataFrame, path: str, *, buckets: int = 64, files: int | None = None) -> None:
    """Part rows in a fixed number of document buckets."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    spread = _spread(parts.withColumn("doc_bucket", bucket), ["doc_bucket", "doc_id"], ["part_no"], files)
    spread.write.mode("overwrite").partitionBy("doc_bucket").parquet(path)


def write_text_files(texts: DataFrame, folder: str) -> DataFrame:
    """A file for each row of ``name`` and ``content`` (binary) below ``folder``, a full address.

    Gives the names written, and writes them when that is read. A task that runs again writes the
    same files again. Names may hold folders, which are made.
    """
    from inkloom.sources.text_folder import opened

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, _ = opened(folder)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                path = f"{root.rstrip('/')}/{name}"
                above = path.rsplit("/", 1)[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(path) as stream:
                    stream.write(content or b"")
            yield batch.select(["name"])

    return texts.select("name", "content").mapInArrow(write, "name string")
