"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "inkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans assume; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # No call-site capture per column expression: extraction plans are built of hundreds.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Pages are wide rows: small Arrow batches keep a Python worker's memory flat.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of its own only where that is unset and
    driver and executors are one process, as in tests."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="inkloom-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write ``frame`` once to the shared folder and read it from there.

    A parquet table rather than a row checkpoint: later steps read only the columns they need
    and know its size, and a lost executor costs nothing that was written.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
