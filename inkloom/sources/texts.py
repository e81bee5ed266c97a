"""Plain text files, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.sources.text_folder import TextFolder

_REPLACEMENT = "\ufffd"
TEXT_FILES = "*.[tT][xX][tT]"


def _location(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def _is_file(spark: SparkSession, path: str) -> bool:
    location, system = _location(spark, path)
    return system.getFileStatus(location).isFile()


def refuse_hidden(spark: SparkSession, path: str, recursive: bool) -> None:
    """Fails if a text file's name, or a folder's on the way to it, begins with ``_`` or ``.``.

    Spark's file sources pass over such names without a word; here nothing is left out silently.
    """
    location, system = _location(spark, path)
    root = system.makeQualified(location).toString().rstrip("/")
    hidden, files = [], system.listFiles(location, recursive)
    while files.hasNext():
        name = files.next().getPath().toString()
        parts = name[len(root) :].split("/") if name != root else [name.rsplit("/", 1)[-1]]
        if name.lower().endswith(".txt") and any(part[:1] in ("_", ".") for part in parts if part):
            hidden.append(name)
    if hidden:
        raise ValueError(f"Spark skips these names, rename them: {', '.join(sorted(hidden))}")


def drop_broken_bytes(text: Column) -> Column:
    """Text without the bytes that are not UTF-8."""
    # A genuine replacement character waits as \u0001r, a \u0001 of the text as \u0001e.
    marked = F.replace(text, F.lit("\u0001"), F.lit("\u0001e"))
    marked = F.replace(marked, F.lit(_REPLACEMENT), F.lit("\u0001r"))
    valid = F.replace(F.make_valid_utf8(marked), F.lit(_REPLACEMENT), F.lit(""))
    valid = F.replace(valid, F.lit("\u0001r"), F.lit(_REPLACEMENT))
    return F.replace(valid, F.lit("\u0001e"), F.lit("\u0001"))


def file_path() -> Column:
    """The path of the file a row comes from, decoded; the same for batches and streams."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded)


def directly_in(spark: SparkSession, path: str) -> Column:
    """Whether a row's file lies in the folder itself, or is the file that ``path`` names."""
    location, system = _location(spark, path)
    plain = lambda text: F.regexp_replace(text, r"^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1/")
    root = plain(F.lit(system.makeQualified(location).toString().rstrip("/")))
    return plain(file_path()).eqNullSafe(root) | (
        F.regexp_replace(plain(file_path()), r"/[^/]*$", "") == root
    )


def text_inputs(spark: SparkSession, path: str, *, recursive: bool = False) -> DataFrame:
    """``path`` and ``text`` of one text file or of a folder's text files, in no order.

    The extension is matched in any case; a single file with another one is an error. Names that
    begin with ``_`` or ``.`` are names like others, unlike in Spark's own file sources. Bytes that
    are not UTF-8 are dropped. Sort the paths, not the texts, where the order matters.
    """
    if _is_file(spark, path) and not path.lower().endswith(".txt"):
        raise ValueError(f"not a .txt: {path}")
    location, system = _location(spark, path)
    spark.dataSource.register(TextFolder)
    reader = spark.read.format(TextFolder.name()).option("recursive", str(recursive).lower())
    return reader.option("path", system.makeQualified(location).toString()).load()
