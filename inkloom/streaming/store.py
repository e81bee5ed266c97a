"""A chapter store that is kept up while pages arrive: the last writer of a slug wins.

The store is a folder of two tables. ``data/batch=N`` holds, by bucket, the whole content of every
bucket that batch N touched; ``manifest/batch=N`` names those buckets and is written last, which
commits the batch. A bucket's content is that of the last committed batch that touched it, so a
batch rewrites only the buckets of its own slugs, readers never see half of one, and a batch that
runs again after a failure starts from the same content and writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkloom.operators.books import chapter_store
from inkloom.operators.keyed import null_safe_join

BUCKETS = 64


class ChapterStore:
    """Chapters by book and slug in ``folder``, in ``buckets`` buckets of (book, slug).

    Buckets go by book and slug together, so that a book with most of the chapters is spread too.
    Their number belongs to the folder: open it with the number it was made with.
    """

    def __init__(self, folder: str, buckets: int = BUCKETS):
        self.folder, self.buckets = folder.rstrip("/"), buckets

    def save(self, chapters: DataFrame, batch_id: int) -> None:
        """Merge a batch: of a slug its largest ``seq`` here, whatever was stored before.

        ``chapters`` has book_id, seq, title and code and any other columns, the same each time.
        Saving a batch id again replaces what it had saved, which changes nothing if the rows are
        the same; batches are saved in the order of their ids.
        """
        spark = chapters.sparkSession
        bucket = F.pmod(F.xxhash64("book_id", "slug"), F.lit(self.buckets)).cast("int")
        fresh = chapter_store(chapters).withColumn("bucket", bucket)
        # At most as many rows as there are buckets.
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
        if not touched:
            return
        merged = fresh
        stored = self._read(spark, {b: v for b, v in self._versions(spark, batch_id).items() if b in touched})
        if stored is not None:
            kept = null_safe_join(stored, fresh.select("book_id", "slug"), ["book_id", "slug"], "left_anti")
            merged = fresh.unionByName(kept)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={batch_id}")
        names = spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1)
        names.write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch_id}")

    def chapters(self, spark: SparkSession) -> DataFrame:
        """What the store holds now, a row for each book and slug."""
        stored = self._read(spark, self._versions(spark))
        if stored is None:
            raise ValueError(f"nothing has been stored in {self.folder}")
        return stored.drop("bucket")

    def _versions(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """The last committed batch of each bucket, of batches below ``before`` only."""
        path = f"{self.folder}/manifest"
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
            return {}
        commits = spark.read.schema("bucket int, batch bigint").parquet(path)
        if before is not None:
            commits = commits.filter(F.col("batch") < before)
        latest = commits.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()
        return {r.bucket: r.batch for r in latest}

    def _read(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame | None:
        if not versions:
            return None
        data = f"{self.folder}/data"
        paths = [f"{data}/batch={batch}/bucket={bucket}" for bucket, batch in sorted(versions.items())]
        stored = spark.read.option("basePath", data).parquet(*paths)
        return stored.withColumn("bucket", F.col("bucket").cast("int")).drop("batch")


def stream_saves(
    chapters: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand every batch of a stream of chapters to ``save(rows, batch_id)``: a store's own
    (:meth:`ChapterStore.save`) or any other that gives the same result when a batch comes again."""
    return (
        chapters.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
