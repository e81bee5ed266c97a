"""The chapter store over batches: last writers, replays and failures."""

from __future__ import annotations

import random

import pytest

from inkloom.streaming.store import ChapterStore, stream_saves

SCHEMA = "book_id string, seq bigint, title string, code string, html string"


def held(store, spark):
    return {(r.book_id, r.slug): r.html for r in store.chapters(spark).collect()}


def test_the_last_writer_of_a_slug_wins_and_replays_change_nothing(spark, tmp_path):
    store = ChapterStore(str(tmp_path / "store"), buckets=4)
    with pytest.raises(ValueError, match="nothing has been stored"):
        store.chapters(spark)
    first = spark.createDataFrame([("a", 1, "t", "1.0", "old"), ("a", 2, "t", "2.0", "two"), ("a", 3, "t", "1.0", "newer")], SCHEMA)
    second = spark.createDataFrame([("a", 0, "t", "1.0", "newest"), ("b", 1, "t", "1.0", "b")], SCHEMA)
    store.save(first, 0)
    assert held(store, spark) == {("a", "1-0"): "newer", ("a", "2-0"): "two"}
    wanted = {("a", "1-0"): "newest", ("a", "2-0"): "two", ("b", "1-0"): "b"}
    for _ in range(2):
        store.save(second, 1)
        assert held(store, spark) == wanted
    store.save(spark.createDataFrame([], SCHEMA), 2)
    assert held(store, spark) == wanted
    assert store.chapters(spark).columns == ["book_id", "slug", "seq", "title", "code", "html"]


def test_a_batch_without_its_manifest_does_not_show(spark, tmp_path):
    store = ChapterStore(str(tmp_path / "store"), buckets=1)
    store.save(spark.createDataFrame([("a", 1, "t", "1.0", "kept")], SCHEMA), 0)
    # Data of a batch that failed before its commit, then the batch again.
    broken = store.chapters(spark).selectExpr("book_id", "slug", "seq", "title", "code", "'broken' as html", "0 as bucket")
    broken.write.partitionBy("bucket").parquet(str(tmp_path / "store" / "data" / "batch=1"))
    assert held(store, spark) == {("a", "1-0"): "kept"}
    store.save(spark.createDataFrame([("a", 1, "t", "2.0", "two")], SCHEMA), 1)
    assert held(store, spark) == {("a", "1-0"): "kept", ("a", "2-0"): "two"}


def test_a_stream_of_batches_equals_saving_in_turn(spark, tmp_path):
    rng, wanted = random.Random(4), {}
    folder = tmp_path / "in"
    store, own = ChapterStore(str(tmp_path / "store"), buckets=3), []
    for batch in range(3):
        rows = [(rng.choice("ab"), k, "t", f"{rng.randrange(6)}.0", f"{batch}-{k}") for k in range(8)]
        for book, _, _, code, html in rows:
            wanted[book, code.replace(".", "-")] = html
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        arriving = spark.readStream.schema(SCHEMA).parquet(str(folder))
        stream_saves(arriving, store.save, str(tmp_path / "store-log")).awaitTermination()
        stream_saves(arriving, lambda rows, k: own.append((k, rows.count())), str(tmp_path / "own-log")).awaitTermination()
        assert held(store, spark) == wanted
    assert own == [(0, 8), (1, 8), (2, 8)]
