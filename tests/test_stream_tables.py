"""Stream queries over tables that are folders of files."""

from __future__ import annotations

from __spark_entry__ import queries

SMALL = "/root/testdata/sf0.001"


def _in_folders(spark, tmp_path, name: str) -> str:
    """The tables' folder, of the one table, which is a folder of three files there."""
    spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def _rows(frame) -> list[str]:
    return sorted(str(sorted(row.asDict().items())) for row in frame.collect())


def test_stream_chapters_of_a_folder(spark, tmp_path):
    found = queries()["stream_chapters"](spark, _in_folders(spark, tmp_path, "pages"))
    assert _rows(found) == _rows(queries()["chapters"](spark, SMALL)) != []


def test_stream_chunks_of_a_folder(spark, tmp_path):
    found = queries()["stream_chunks"](spark, _in_folders(spark, tmp_path, "documents"))
    assert _rows(found) == _rows(queries()["chunk_text"](spark, SMALL)) != []


def test_stream_store_of_a_folder(spark, tmp_path):
    found = queries()["stream_store"](spark, _in_folders(spark, tmp_path, "conversations"))
    stored = queries()["chapter_store"](spark, SMALL)
    assert _rows(found) == _rows(stored.select(*found.columns)) != []
