"""Helpers the operators share: picking columns, carrying whole rows, held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that separate words; also what is stripped around lines.
SPACES = b" \t\n\x0b\x0c\r"


def renamed(frame: DataFrame) -> DataFrame:
    """Columns by position (``_0``, ``_1`` ...): whatever their names, they cannot clash."""
    return frame.toDF(*[f"_{k}" for k in range(len(frame.columns))])


def pick(frame: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; found by exact name, so other columns never clash.

    A table without the column gives nulls.
    """
    names, flat = frame.columns, renamed(frame)
    return flat.select(
        *[
            (F.col(f"_{names.index(name)}") if name in names else F.lit(None))
            .cast(kind)
            .alias(name)
            for name, kind in kinds.items()
        ]
    )


def packed(frame: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the other columns, by position, in the struct ``row``."""
    names, flat = frame.columns, renamed(frame)
    text = names.index("text")
    return flat.select(
        F.col(f"_{names.index('doc_id')}").cast("bigint").alias("doc_id"),
        F.col(f"_{text}").cast("string").alias("text"),
        F.struct(*[c for k, c in enumerate(flat.columns) if k != text]).alias("row"),
    )


def unpacked(frame: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns of the packed rows under their own names, some of them changed."""
    changed = {"text": F.col("text"), **changed}
    return frame.select(
        *[
            changed[name].alias(f"_{k}") if name in changed else F.col(f"row._{k}").alias(f"_{k}")
            for k, name in enumerate(names)
        ]
    ).toDF(*names)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))
