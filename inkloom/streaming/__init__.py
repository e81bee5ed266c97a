"""The same operators over streams; both are stateless and append only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from inkloom.config import DEFAULT, ExtractConfig
from inkloom.functions.sentences import MAX_CHARS
from inkloom.operators.chunks import chunks
from inkloom.operators.extract import chapters
from inkloom.sources.pages import PAGE_SCHEMA
from inkloom.sources.texts import (
    TEXT_FILES,
    directly_in,
    drop_broken_bytes,
    file_path,
    refuse_hidden,
)


def page_stream(
    spark: SparkSession, folder: str, files: str = "*.parquet", schema: StructType = PAGE_SCHEMA
) -> DataFrame:
    """Pages from parquet files as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A parquet table as its files arrive, be it a folder of files or one file.

    The path goes to the source as a pattern of one match: a plain path must be a folder there.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def stream_chapters(
    pages: DataFrame, out: str, checkpoint: str, config: ExtractConfig = DEFAULT
) -> StreamingQuery:
    """Append every chapter as it is extracted; pick the latest per slug when reading."""
    return _append(chapters(pages, config), out, checkpoint)


def text_stream(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """Whole text files as they arrive, with the paths that ``text_inputs`` gives.

    Text files of hidden names that are there at the start are an error.
    """
    refuse_hidden(spark, folder, recursive)
    files = (
        spark.readStream.option("recursiveFileLookup", True)
        .option("pathGlobFilter", TEXT_FILES)
        .text(folder, wholetext=True)
    )
    if not recursive:
        files = files.filter(directly_in(spark, folder))
    return files.select(file_path().alias("path"), drop_broken_bytes(F.col("value")).alias("text"))


def document_stream(
    spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet"
) -> DataFrame:
    """Documents from parquet files as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def stream_chunks(
    texts: DataFrame, out: str, checkpoint: str, limit: int = MAX_CHARS, *, key: str = "path"
) -> StreamingQuery:
    """Append the chunk rows of every text as it arrives."""
    return _append(chunks(texts, limit, key=key), out, checkpoint)


def _append(frame: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        frame.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
