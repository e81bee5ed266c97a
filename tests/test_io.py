"""Text sources, writers and streams on temporary files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkloom.operators.chunks import chunks
from inkloom.operators.extract import chapters
from inkloom.sinks import write_book_text, write_chapter_store, write_manifest
from inkloom.sources import text_folder
from inkloom.sources.texts import text_inputs
from inkloom.streaming import page_stream, stream_chapters, stream_chunks, text_stream


def test_text_inputs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.TXT").write_bytes(b"bad \xff byte, kept \xef\xbf\xbd")
    (tmp_path / "a b+c.txt").write_text("two\nlines\n")
    (tmp_path / "c.md").write_text("no")
    (tmp_path / "sub" / "d.txt").write_text("deep")
    (tmp_path / "year=2024").mkdir()
    (tmp_path / "year=2024" / "e.txt").write_text("deep too")
    flat = sorted(text_inputs(spark, str(tmp_path)).collect())
    assert [r.path.rsplit("/", 1)[1] for r in flat] == ["a b+c.txt", "b.TXT"]
    assert [r.text for r in flat] == ["two\nlines\n", "bad  byte, kept �"]
    assert text_inputs(spark, str(tmp_path), recursive=True).count() == 4
    assert text_inputs(spark, str(tmp_path / "b.TXT")).count() == 1
    with pytest.raises(ValueError):
        text_inputs(spark, str(tmp_path / "c.md"))


def test_stream_paths_equal_batch_paths(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name in ("d e.txt", "a%20b.TXT", "c+d.txt", "sub/f.txt"):
        (folder / name).write_text(name)
    out, point = str(tmp_path / "out"), str(tmp_path / "point")
    stream_chunks(text_stream(spark, str(folder)), out, point).awaitTermination()
    streamed = sorted((r.path, r.text) for r in spark.read.parquet(out).collect())
    assert streamed == sorted((r.path, r.text) for r in text_inputs(spark, str(folder)).collect())
    assert [p.rsplit("/", 1)[1] for p, _ in streamed] == sorted(["d e.txt", "a%20b.TXT", "c+d.txt"])


@pytest.mark.parametrize("name", ["_x.txt", ".x.TXT", "_sub/x.txt"])
def test_hidden_text_files_are_read_but_not_streamed(spark, tmp_path, name):
    (tmp_path / "_sub").mkdir()
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / name).write_text("hidden")
    found = sorted((r.path, r.text) for r in text_inputs(spark, str(tmp_path), recursive=True).collect())
    assert found == sorted([(f"file:{tmp_path}/a.txt", "a"), (f"file:{tmp_path}/{name}", "hidden")])
    with pytest.raises(ValueError, match="x"):
        text_stream(spark, str(tmp_path), recursive=True)


def test_text_folder_deals_files_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_folder, "PART_FILES", 3)
    for k in range(8):
        (tmp_path / f"{k}.txt").write_text(str(k))
    for sub in ("s", "t"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "deep.txt").write_text(sub)
    reader = text_folder.TextFolderReader(f"file:{tmp_path}", True)
    parts = reader.partitions()
    assert sorted(len(p.files) for p in parts) == [0, 0, 2, 3, 3] and sum(len(p.folders) for p in parts) == 2
    texts = [batch["text"][0].as_py() for part in parts for batch in reader.read(part)]
    assert sorted(texts) == [*"01234567", "s", "t"]
    with pytest.raises(FileNotFoundError):
        text_folder.TextFolderReader(f"file:{tmp_path}/none", True).partitions()
    (tmp_path / "empty").mkdir()
    assert text_inputs(spark, str(tmp_path / "empty")).collect() == []


def test_stream_rejects_error_pages_like_the_batch(spark, tmp_path):
    html = "<html><body><article><h1>T</h1><p>" + "long enough text " * 9 + "</p></article></body></html>"
    rows = [(1, "http://a/1", html, 200), (2, "http://a/2", html, 404), (3, "http://a/3", html, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, status int")
    pages.write.parquet(str(tmp_path / "pages"))
    out, point = str(tmp_path / "out"), str(tmp_path / "point")
    stream_chapters(page_stream(spark, str(tmp_path / "pages")), out, point).awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(chapters(pages).collect())
    assert sorted(r.page_id for r in spark.read.parquet(out).collect()) == [1, 3]


def test_book_text_files(spark, tmp_path):
    lines = spark.range(1, 41).select(
        F.concat(F.lit("b"), F.col("id") % 2).alias("book_id"), F.col("id").alias("chapter_no"),
        F.concat(F.lit("T"), "id", F.lit("\n\nline\n")).alias("text"),
    )
    write_book_text(lines, str(tmp_path / "out"), files=5)
    for book in (0, 1):
        files = sorted((tmp_path / "out" / f"book_id=b{book}").glob("part-*.txt"))
        text = "".join(f.read_text() for f in files)
        assert text == "".join(f"T{i}\n\nline\n" for i in range(1, 41) if i % 2 == book)
    with pytest.raises(ValueError):
        write_book_text(lines.limit(0), str(tmp_path / "none"))


def test_bucketed_writers(spark, tmp_path):
    stored = spark.range(30).select(F.col("id").cast("string").alias("book_id"), F.lit("s").alias("slug"))
    write_chapter_store(stored, str(tmp_path / "store"), buckets=4, files=3)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 30
    parts = spark.range(30).select(F.col("id").alias("doc_id"), F.lit(1).alias("part_no"))
    write_manifest(parts, str(tmp_path / "parts"), buckets=4)
    assert len(list((tmp_path / "parts").glob("doc_bucket=*"))) <= 4


def test_streams_equal_batch(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "pages"))
    out, point = str(tmp_path / "out"), str(tmp_path / "point")
    stream_chapters(page_stream(spark, str(tmp_path / "pages")), out, point).awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(chapters(pages).collect())
    # Files that come later are added, the earlier ones are not read again.
    pages.limit(2).withColumn("page_id", F.col("page_id") + 10_000).write.mode("append").parquet(str(tmp_path / "pages"))
    stream_chapters(page_stream(spark, str(tmp_path / "pages")), out, point).awaitTermination()
    assert spark.read.parquet(out).filter("page_id < 10000").count() == chapters(pages).count()

    (tmp_path / "texts").mkdir()
    for i in range(5):
        (tmp_path / "texts" / f"{i}.txt").write_text(f"Sentence {i}. " * 50)
    texts = text_stream(spark, str(tmp_path / "texts"))
    stream_chunks(texts, str(tmp_path / "c"), str(tmp_path / "cp"), 100).awaitTermination()
    batch = chunks(text_inputs(spark, str(tmp_path / "texts")), 100, key="path").drop("path")
    got = spark.read.parquet(str(tmp_path / "c")).drop("path")
    assert sorted(got.collect()) == sorted(batch.collect())
