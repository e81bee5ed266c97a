"""Documents to sentence rows, chunk rows, part manifests and per-document reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.sentences import MAX_CHARS, chunk_text, sentence_split


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = documents.select(key, F.posexplode(sentence_split(F.col(text))).alias("_at", "text"))
    return rows.select(key, (F.col("_at") + 1).alias("sent_no"), "text")


def chunks(
    documents: DataFrame,
    limit: int = MAX_CHARS,
    *,
    strict: bool = False,
    floor: int = 0,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per chunk with its 1-based part number; a map step, no shuffle."""
    pieces = chunk_text(F.col(text), limit, strict=strict, floor=floor)
    rows = documents.select(key, *keep, F.posexplode(pieces).alias("_at", "text"))
    return rows.select(
        key, *keep, (F.col("_at") + 1).alias("part_no"), "text", F.length("text").alias("n_chars")
    )


def part_file(base: Column, part_no: Column, extension: str = "wav") -> Column:
    return F.format_string(f"%s-part-%04d.{extension}", base, part_no)


def chunk_manifest(parts: DataFrame, base: Column, extension: str = "wav") -> DataFrame:
    """File name and list line of every part; order them by ``part_no``, not by name."""
    named = parts.withColumn("file_name", part_file(base, F.col("part_no"), extension))
    line = F.concat(F.lit("file '"), F.col("file_name"), F.lit("'"))
    return named.select("doc_id", "part_no", "file_name", line.alias("list_line"), "n_chars")


def chunk_plan(documents: DataFrame, limit: int = MAX_CHARS, *, strict: bool = True) -> DataFrame:
    """Number of chunks per document, nothing else done."""
    return documents.select(
        "doc_id", F.size(chunk_text(F.col("text"), limit, strict=strict)).alias("chunks")
    )


def document_report(documents: DataFrame, base: Column, status: Column, limit: int = MAX_CHARS) -> DataFrame:
    """Input, base, chunk count and status per document, plus the same as one JSON entry."""
    count = F.size(chunk_text(F.col("text"), limit, strict=True))
    rows = documents.select("doc_id", base.alias("base"), count.alias("chunks"), status.alias("status"))
    entry = F.to_json(F.struct("doc_id", "base", "chunks", "status"))
    return rows.withColumn("entry", entry)


def run_header(
    report: DataFrame, *, voice: str, rate: int, speed: float, run_id: str | None = None
) -> DataFrame:
    """One row for a run: its settings and what its documents came to.

    ``run_id`` joins it with the report's rows (see :func:`of_run`); by default it follows from
    the settings, so that a repeated run has the same.
    """
    return report.agg(
        F.count(F.lit(1)).alias("inputs"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.count_if(F.col("status") != "ok").alias("not_ok"),
    ).select(
        _run_id(voice, rate, speed, run_id).alias("run_id"),
        F.lit(voice).alias("voice"),
        F.lit(rate).alias("rate"),
        F.lit(speed).alias("speed"),
        "inputs",
        "chunks",
        "not_ok",
    )


def of_run(
    report: DataFrame, *, voice: str, rate: int, speed: float, run_id: str | None = None
) -> DataFrame:
    """The report's rows with the run they belong to."""
    return report.select(_run_id(voice, rate, speed, run_id).alias("run_id"), *report.columns)


def _run_id(voice: str, rate: int, speed: float, run_id: str | None) -> Column:
    return F.lit(run_id) if run_id else F.md5(F.lit(f"{voice}|{rate}|{speed}"))
