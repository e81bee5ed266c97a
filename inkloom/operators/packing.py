"""Chunks of documents that no single task could hold.

A document comes as rows of any cut. One that fits into a row is put together and packed there. The
parts of a longer one are cut anew at places that end a sentence whatever
stands around them, so sentences are found part by part. Each piece then has a position, the
characters before it, and the chunk that begins at a position ends at a position that follows from
sizes alone: greedy packing is a function from position to next position. Positions are dealt into
slabs of equal length. What a slab does to each of the few positions at which a chunk may enter it
is one step; the entry that counts is found by doubling those steps, on a few thin rows a slab, in
as many rounds as the logarithm of a document's slabs. With its entry known a slab is packed alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.sentences import MAX_CHARS, SAFE_CUT, chunk_limit, normalise_text, text_pieces
from inkloom.functions.strings import UNICODE_SPACE, trim_ws
from inkloom.operators.chunks import chunks
from inkloom.operators.extract import settle
from inkloom.operators.keyed import null_safe_join, running_sum
from inkloom.session import cut_lineage

# Workers get these functions with the plan and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters whose pieces are packed in one task.
SLAB_CHARS = 1 << 20
# Characters of a document that is put together in one row.
ROW_CHARS = 1 << 17


def recut(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, at, text): the same documents in rows that begin and end between sentences.

    A part that holds safe cuts keeps what lies between its first and last one, and that is not
    moved; what is left of it meets the rest of its neighbours. Only text without any such cut is
    joined into one row, which is as long as the sentence it may be. ``at`` is the part and the
    place in it that a row begins at.
    """
    source = parts.select(key, F.col(order).alias("_order"), F.coalesce(text, F.lit("")).alias("_text"))
    cut = settle(
        source, [key, "_order", "_text"],
        _head=F.regexp_extract("_text", rf"(?s)\A(.*?{SAFE_CUT})", 1),
        _upto=F.length(F.regexp_extract("_text", rf"(?s)\A(.*{SAFE_CUT})", 1)),
    )
    has_cut = F.col("_upto") > 0
    body = F.expr("substring(_text, length(_head) + 1, _upto - length(_head))")
    inner = cut.filter(has_cut).select(key, F.struct("_order", F.lit(1).alias("_n")).alias("at"), body.alias("text"))
    # The rest: a head ends the stretch before it, a tail begins one, a part without cut is within.
    rest = F.array(
        F.struct(F.lit(0).alias("_n"), F.when(has_cut, F.col("_head")).otherwise(F.col("_text")).alias("_own")),
        F.struct(F.lit(2).alias("_n"), F.when(has_cut, F.expr("substring(_text, _upto + 1)")).alias("_own")),
    )
    loose = cut.select(key, "_order", F.explode(rest).alias("_rest")).filter("_rest._own is not null")
    loose = cut_lineage(loose.select(key, F.struct("_order", "_rest._n").alias("_at"), F.col("_rest._own").alias("_own")))
    begins = (F.col("_at._n") == 2).cast("bigint")
    stretches = running_sum(loose, [key], "_at", begins, "_before").withColumn("_no", F.col("_before") + begins)
    joined = stretches.groupBy(key, "_no").agg(F.array_sort(F.collect_list(F.struct("_at", "_own"))).alias("_all"))
    joined = joined.select(key, F.get("_all", F.lit(0))["_at"].alias("at"), F.array_join("_all._own", "").alias("text"))
    return inner.unionByName(joined).filter(F.col("text") != "")


def _dealt(limit: int, slab_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of a unit, with its position and its slab; the first ones of a slab twice."""
    for batch in batches:
        units = batch["_pieces"]
        pieces = units.flatten()
        owner = pc.list_parent_indices(units).to_numpy()
        size = pieces.field("size").to_numpy().astype(np.int64)
        before = np.append(0, np.cumsum(size))[:-1]
        begins = np.searchsorted(owner, owner)
        at = batch["_offset"].to_numpy()[owner] + before - before[begins] if len(owner) else before
        slab = at // slab_chars
        near = np.flatnonzero((slab > 0) & (at - slab * slab_chars <= limit + 1))
        rows = np.append(np.arange(len(at)), near)
        taken = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch["_key"].take(pa.array(owner[rows])),
                pa.array(np.append(slab, slab[near] - 1)),
                pa.array(at[rows]),
                pieces.field("text").take(taken),
                pa.array(size[rows]),
                pieces.field("fresh").take(taken),
            ],
            names=["_key", "_slab", "_at", "_text", "_size", "_fresh"],
        )


def _next_positions(table: pa.Table, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pieces that hold text, in order, and the index of the next chunk's start
    if one starts there; their number stands for the end of what is known."""
    at = table["_at"].to_numpy()
    size = table["_size"].to_numpy()
    fresh = np.unique(at[table["_fresh"].to_numpy(zero_copy_only=False)])
    starts, sizes = at[size > 0], size[size > 0]
    own = np.arange(len(starts))
    full = np.searchsorted(starts + sizes, starts + limit, side="right")
    after = np.searchsorted(fresh, starts, side="right")
    forced = np.append(fresh, np.iinfo(np.int64).max)[after]
    return starts, np.minimum(np.maximum(full, own + 1), np.searchsorted(starts, forced))


def _crossings(limit: int, slab_chars: int, key_type: pa.DataType, keys: tuple, table: pa.Table) -> pa.Table:
    """Where a chunk that begins at an entry of the slab leads, the first start beyond the slab,
    and how many chunks that hold text begin in the slab on the way."""
    key, slab = keys
    slab = slab.as_py()
    table = table.sort_by("_at")
    starts, follow = _next_positions(table, limit)
    inside = int(np.searchsorted(starts, (slab + 1) * slab_chars))
    words = np.append(0, np.cumsum(table.filter(pc.greater(table["_size"], 0))["_words"].to_numpy()))
    full = np.append(words[follow] > words[:-1], False).astype(np.int64)
    jump = np.append(follow, len(starts))
    jump[inside:], full[inside:] = np.arange(inside, len(jump)), 0
    while (jump[:inside] < inside).any():
        full, jump = full + full[jump], jump[jump]
    entries = starts[:inside] <= slab * slab_chars + limit + 1
    exits = np.append(starts, -1)[jump[:inside][entries]]
    return pa.table(
        {
            "_key": pa.array([key.as_py()] * len(exits), key_type),
            "_entry": pa.array(starts[:inside][entries], pa.int64()),
            "_exit": pa.array(exits, pa.int64(), mask=exits < 0),
            "_full": pa.array(full[:inside][entries], pa.int64()),
        }
    )


def _packed(limit: int, slab_chars: int, key_type: pa.DataType, keys: tuple, table: pa.Table, entry: pa.Table) -> pa.Table:
    """The chunks that begin in the slab, from its entry on, numbered from what is before it."""
    key, slab = keys
    table = table.sort_by("_at")
    starts, follow = _next_positions(table, limit)
    texts = table.filter(pc.greater(table["_size"], 0))["_text"]
    inside = int(np.searchsorted(starts, (slab.as_py() + 1) * slab_chars))
    # A document begins at its first piece; a slab without an entry lies within one chunk.
    first, base = (entry["_entry"][0].as_py(), entry["_base"][0].as_py()) if len(entry) else (0, 0)
    at = int(np.searchsorted(starts, first)) if len(entry) or not slab.as_py() else inside
    found: list[str] = []
    while at < inside:
        upto = int(follow[at])
        if chunk := "".join(texts.slice(at, upto - at).to_pylist()).strip(UNICODE_SPACE):
            found.append(chunk)
        at = upto
    return pa.table(
        {
            "_key": pa.array([key.as_py()] * len(found), key_type),
            "part_no": pa.array(range(base + 1, base + 1 + len(found)), pa.int32()),
            "text": pa.array(found, pa.string()),
        }
    )


def _entries(crossings: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """(_key, _entry, _base) for all entries on the path from the first ones, by doubling steps."""
    reached = first
    steps = crossings.filter(F.col("_exit").isNotNull()).select("_key", "_entry", "_exit")
    # After r rounds the first 2^r entries of every document are known.
    for _ in range(most.bit_length()):
        onward = null_safe_join(reached, steps, ["_key", "_entry"]).select("_key", F.col("_exit").alias("_entry"))
        reached = cut_lineage(reached.unionByName(onward))
        second = steps.select("_key", F.col("_entry").alias("_exit"), F.col("_exit").alias("_then"))
        steps = cut_lineage(
            null_safe_join(steps, second, ["_key", "_exit"]).select("_key", "_entry", F.col("_then").alias("_exit"))
        )
    counted = null_safe_join(reached, crossings.drop("_exit"), ["_key", "_entry"])
    return running_sum(cut_lineage(counted), ["_key"], "_entry", F.col("_full"), "_base")


def chunks_of_parts(
    parts: DataFrame,
    limit: int = MAX_CHARS,
    *,
    strict: bool = False,
    floor: int = 0,
    key: str = "doc_id",
    order: str = "part",
    text: str = "text",
    slab_chars: int = SLAB_CHARS,
) -> DataFrame:
    """(key, part_no, text, n_chars): the chunks of documents that are stored as several rows.

    Equal to :func:`inkloom.operators.chunks.chunks` over the rows of each document put together
    by ``order``, which is unique in a document, wherever they are cut. Null text is empty; a null
    key is a document; a document without text has no chunks. Documents of up to ``ROW_CHARS``
    characters (or ``slab_chars``, if fewer) are packed in a row each. Of longer ones no row holds more
    than one part, one stretch of text without a sentence end, or ``slab_chars`` characters and one
    chunk.
    """
    limit = chunk_limit(limit, strict=strict, floor=floor)
    # A slab holds at least one piece, and a chunk leads to the next slab at most.
    slab_chars = max(slab_chars, 2 * (limit + 1))
    filled = parts.filter(F.length(text) > 0)
    sizes = filled.groupBy(key).agg(F.sum(F.length(text)).alias("_chars"))
    long = cut_lineage(sizes.filter(F.col("_chars") > min(ROW_CHARS, slab_chars)).select(key))
    own = F.struct(F.col(order).alias("_order"), F.col(text).alias("_text"))
    short = null_safe_join(filled, long, [key], "left_anti").groupBy(key).agg(F.array_sort(F.collect_list(own)).alias("_all"))
    whole = short.select(key, F.array_join("_all._text", "").alias(text))
    found = chunks(whole, limit, strict=strict, key=key, text=text)
    if long.isEmpty():
        return found
    in_parts = null_safe_join(filled, long, [key], "left_semi")
    return found.unionByName(_chunks_by_slab(in_parts, limit, strict, key, order, text, slab_chars))


def _chunks_by_slab(
    parts: DataFrame, limit: int, strict: bool, key: str, order: str, text: str, slab_chars: int
) -> DataFrame:
    """The chunks of long documents, packed slab by slab."""
    units = cut_lineage(recut(parts, key, order, text).withColumnRenamed(key, "_key"))

    def cut(frame: DataFrame, *own: str) -> DataFrame:
        found = text_pieces(normalise_text(F.col("text")), limit, strict=strict)
        return settle(frame, ["_key", "at", *own], _pieces=found)

    # Texts are moved twice: to the number of characters before them, and to their slab.
    sizes = cut(units).select("_key", "at", F.aggregate("_pieces.size", F.lit(0).cast("bigint"), lambda n, x: n + x).alias("_chars"))
    places = running_sum(cut_lineage(sizes), ["_key"], "at", F.col("_chars"), "_offset")
    places = cut_lineage(places)
    last = F.floor((F.col("_offset") + F.col("_chars")) / F.lit(slab_chars)).cast("bigint")
    long = cut_lineage(places.groupBy("_key").agg(F.max(last).alias("_last")).filter(F.col("_last") > 0))
    most = long.agg(F.max("_last")).first()[0]

    kind = f"_key {units.schema['_key'].dataType.simpleString()}"
    arrow_kind = units.select("_key").limit(0).toArrow().schema.field("_key").type

    def in_slabs(some: DataFrame) -> DataFrame:
        """The pieces of these places; what may end a chunk of the slab before is there as well."""
        sized = cut(null_safe_join(units, some.select("_key", "at", "_offset"), ["_key", "at"]), "_offset")
        rows = sized.select("_key", "_offset", "_pieces").mapInArrow(
            lambda batches: _dealt(limit, slab_chars, batches),
            f"{kind}, _slab bigint, _at bigint, _text string, _size bigint, _fresh boolean",
        )
        return rows.withColumn("_words", (trim_ws(F.col("_text")) != "").cast("bigint"))

    if most is None:
        entries = units.sparkSession.createDataFrame([], f"{kind}, _entry bigint, _base bigint")
    else:
        thin = in_slabs(null_safe_join(places, long.select("_key"), ["_key"])).drop("_text")
        crossings = thin.groupBy("_key", "_slab").applyInArrow(
            lambda keys, rows: _crossings(limit, slab_chars, arrow_kind, keys, rows),
            f"{kind}, _entry bigint, _exit bigint, _full bigint",
        )
        first = long.select("_key", F.lit(0).cast("bigint").alias("_entry"))
        entries = _entries(cut_lineage(crossings), first, most).select("_key", "_entry", "_base")
    entries = entries.withColumn("_slab", F.floor(F.col("_entry") / F.lit(slab_chars)).cast("bigint"))
    groups = in_slabs(places).drop("_words").groupBy("_key", "_slab")
    packed = groups.cogroup(entries.groupBy("_key", "_slab")).applyInArrow(
        lambda keys, rows, own: _packed(limit, slab_chars, arrow_kind, keys, rows, own),
        f"{kind}, part_no int, text string",
    )
    return packed.select(F.col("_key").alias(key), "part_no", "text", F.length("text").alias("n_chars"))


def text_parts(documents: DataFrame, chars: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, text): every text in rows of ``chars`` characters, wherever that cuts it."""
    cut = F.regexp_extract_all(F.col(text), F.lit(rf"(?s).{{1,{chars}}}"), F.lit(0))
    return documents.select(key, F.posexplode(cut).alias("part", "text"))
