"""Removal of long repeats by run-length indexes over shards of the corpus.

One index over all texts would be one task, so the corpus is dealt by content first. Every window
of ``length`` bytes owns an anchor, the least hash among its 32-byte strings, so two equal windows
own equal anchors. What is kept of an anchor is its context: the bytes of the windows that own it.

* Contexts that stand twice or more are repeats from end to end: they are marked by hash alone,
  and copies within a batch are found there, before anything is shuffled.
* Different contexts of one anchor may share windows in part. One of each goes to the anchor's
  shard as text, where a run-length index of the shard streams matching statistics and marks
  every match of ``length`` bytes. Contexts of one document that overlap are joined first, so a
  shard holds each byte of a document once and a match is always with another place.
* An anchor with more than ``hot`` different contexts would outgrow a shard. Its windows are
  counted by their hashes instead, which needs no group in one place.

Nothing is capped: each window is judged in exactly one of these ways. Hashes are compared in
pairs of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.llm.anchors import Hashes, sliding
from inkloom.llm.common import pick
from inkloom.llm.perfect_hash import mixed
from inkloom.llm.run_length_index import long_matches
from inkloom.session import cut_lineage

ANCHOR = 32
#: Bytes of a very long text that are looked at in one piece.
PIECE = 1 << 22
PLACE_BITS = 24
SEPARATOR = 255  # in no UTF-8 text
SHARD_BYTES = 1 << 21
HOT = 20_000
#: A span is start * 2^WIDTH_BITS + width * 2 + (1 if it is known to be repeated).
WIDTH_BITS = 20


def contexts(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, context hash, start, width) of every context of a text.

    Ties between equal hashes go to the leftmost place, so which anchor a window owns depends on
    its bytes only.
    """
    parts = []
    span = length - ANCHOR + 1
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        piece = data[at : at + PIECE + length - 1]
        hashes = Hashes(piece)
        grams = hashes.all_of(ANCHOR)
        place = np.arange(len(grams), dtype=np.uint64)
        high = ~np.uint64((1 << PLACE_BITS) - 1)
        least = sliding((grams & high) | place, span, np.minimum)
        owner = (least & ~high).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        stop = np.concatenate([first[1:], [len(owner)]]) - 1 + length
        anchor = owner[first]
        place_in = ((anchor - first) << 16 | (stop - anchor)).astype(np.uint64)
        context = hashes.of(first, stop) ^ mixed(place_in, 42)
        parts.append((grams[anchor], context, first + at, stop - first))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def _bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _coded(docs: DataFrame) -> DataFrame:
    """(doc_id, code, text): rows equal in id and text share the code, and their marks."""
    rows = pick(docs, doc_id="bigint", text="string")
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("code"), "text")


def anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """(h, c, code, span) of every context of (code, text) rows.

    Within a batch of rows the second and later copies of a context travel under a hash of their
    place instead of the anchor's, marked as repeated like the first: however many copies there
    are, an anchor gets one row a batch for each different context.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for text in batch["text"]:
                own = contexts(_bytes_of(text.as_py()), length)
                found.append(own)
                sizes.append(len(own[0]))
            h, c, start, width = (np.concatenate(x) for x in zip(*found, strict=True))
            code = np.repeat(batch["code"].to_numpy(), sizes)
            both = h ^ mixed(c, 43)
            order = np.argsort(both, kind="stable")
            fresh = np.ones(len(order), bool)
            fresh[1:] = both[order][1:] != both[order][:-1]
            copy = np.zeros(len(order), bool)
            copy[order] = ~fresh
            many = copy.copy()
            many[order[:-1]] |= ~fresh[1:]
            span = (start.astype(np.int64) << WIDTH_BITS) | (width << 1) | many
            apart = mixed(code.view(np.uint64) ^ span.view(np.uint64), 44)
            h = np.where(copy, apart, h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(code), pa.array(span)],
                names=["h", "c", "code", "span"],
            )

    return rows.select("code", "text").mapInArrow(
        emit, "h bigint, c bigint, code bigint, span bigint"
    )


def marked_contexts(anchors: DataFrame, shards: int, hot: int) -> DataFrame:
    """(code, full, parts, windows) per document with something to do.

    ``full``: spans that are repeated throughout. ``parts``: (shard, span) of contexts to be
    indexed. ``windows``: spans of hot anchors, whose windows are to be counted.
    """
    by_anchor = Window.partitionBy("h")
    by_context = Window.partitionBy("h", "c")
    rows = (
        anchors.repartition("h")
        .withColumn("rank", F.row_number().over(by_context.orderBy("code", "span")))
        .withColumn("n", F.count(F.lit(1)).over(by_context))
        .withColumn("kinds", F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).over(by_anchor))
    )
    full = (F.col("n") > 1) | (F.col("span").bitwiseAND(F.lit(1)) == 1)
    mixed_up = (F.col("kinds") > 1) & (F.col("rank") == 1)
    shard = F.pmod(F.col("h"), F.lit(shards)).alias("shard")
    return (
        rows.filter(full | mixed_up)
        .groupBy("code")
        .agg(
            F.collect_list(F.when(full, F.col("span"))).alias("full"),
            F.collect_list(
                F.when(mixed_up & (F.col("kinds") <= hot), F.struct(shard, F.col("span")))
            ).alias("parts"),
            F.collect_list(F.when(mixed_up & (F.col("kinds") > hot), F.col("span"))).alias("windows"),
        )
    )


def _spans(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = values >> WIDTH_BITS
    return start, start + ((values & ((1 << WIDTH_BITS) - 1)) >> 1)


def _joined(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Union of stretches, in order; touching ones become one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    cut = np.flatnonzero(start[1:] > stop[:-1]) + 1
    first = np.concatenate([[0], cut]) if len(start) else cut
    last = np.concatenate([cut, [len(start)]]) - 1 if len(start) else cut
    return list(zip(start[first].tolist(), stop[last].tolist(), strict=True))


def segments(rows: DataFrame) -> DataFrame:
    """(shard, code, start, piece): the bytes of a document that go to a shard, each byte once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for code, text, parts in zip(
                batch["code"].to_pylist(), batch["text"], batch["parts"], strict=True
            ):
                data = text.as_py().encode("utf-8", "surrogatepass")
                own = parts.values
                shard = own.field("shard").to_numpy()
                start, stop = _spans(own.field("span").to_numpy())
                order = np.argsort(shard, kind="stable")
                cut = np.flatnonzero(np.diff(shard[order])) + 1
                for group in np.split(order, cut):
                    for a, b in _joined(start[group], stop[group]):
                        for column, x in zip(
                            columns, (int(shard[group[0]]), code, a, data[a:b]), strict=True
                        ):
                            column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["shard", "code", "start", "piece"],
            )

    # doc_id is read so that both readers of the dealt texts read the same columns.
    return rows.select("doc_id", "code", "text", "parts").mapInArrow(
        emit, "shard bigint, code bigint, start bigint, piece binary"
    )


def shard_matches(length: int):
    """Arrow function over the segments of one shard -> (code, start, stop) of repeats."""

    def index(table: pa.Table) -> pa.Table:
        pieces = table["piece"].to_pylist()
        sizes = np.array([len(p) + 1 for p in pieces])
        data = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]), np.uint8)
        starts, stops = long_matches(data, SEPARATOR, length)
        ends = np.cumsum(sizes)
        piece = np.searchsorted(ends, starts, side="right")
        shift = table["start"].to_numpy()[piece] - (ends - sizes)[piece]
        return pa.table(
            {
                "code": pa.array(table["code"].to_numpy()[piece]),
                "start": pa.array(starts + shift),
                "stop": pa.array(stops + shift),
            }
        )

    return index


def window_matches(rows: DataFrame, length: int) -> DataFrame:
    """(code, start, stop) of the windows of hot anchors that stand in more than one place."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for code, text, spans in zip(
                batch["code"].to_pylist(), batch["text"], batch["windows"], strict=True
            ):
                data = _bytes_of(text.as_py())
                for a, b in _joined(*_spans(spans.values.to_numpy())):
                    hashes = Hashes(data[a:b])
                    whole, head = hashes.all_of(length), hashes.all_of(length // 2)[: b - a - length + 1]
                    columns[0].append(whole.view(np.int64))
                    columns[1].append(head.view(np.int64))
                    columns[2].append(np.full(len(whole), code))
                    columns[3].append(a + np.arange(len(whole)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns],
                names=["w", "v", "code", "start"],
            )

    windows = rows.select("doc_id", "code", "text", "windows").mapInArrow(
        emit, "w bigint, v bigint, code bigint, start bigint"
    )
    again = windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return windows.join(again, ["w", "v"]).select(
        "code", "start", (F.col("start") + length).alias("stop")
    )


def repeats(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """(doc_id, text, spans): each text with the byte stretches that hold a repeated string.

    ``spans`` are maximal (start, stop), in order, of the text as UTF-8: every byte in a string
    of ``length`` bytes that also starts at another place, in the same text or any other.

    Null or empty texts, and texts shorter than ``length``: no spans. Null doc_id: a document.
    Repeated rows are each other's repeats. Very long texts are hashed in pieces; of their
    windows none is lost between pieces. Empty table: no rows.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be {2 * ANCHOR} at least")
    spark = docs.sparkSession
    rows = _coded(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, -(-size // SHARD_BYTES))
    found = cut_lineage(marked_contexts(anchor_rows(rows, length), shards, hot))
    # Both readers of these texts share one exchange.
    dealt = rows.join(found, "code")
    pieces = segments(dealt.filter(F.size("parts") > 0))
    matched = pieces.groupBy("shard").applyInArrow(
        shard_matches(length), "code bigint, start bigint, stop bigint"
    )
    if found.filter(F.size("windows") > 0).limit(1).count():
        matched = matched.unionByName(
            window_matches(dealt.filter(F.size("windows") > 0), length)
        )
    union = F.arrow_udf(_union_of_marks, "array<struct<start: bigint, stop: bigint>>")
    marks = matched.groupBy("code").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    return (
        rows.join(found.select("code", "full"), "code", "left")
        .join(marks, "code", "left")
        .select("doc_id", "text", union("full", "marks").alias("spans"))
    )


def _union_of_marks(full: pa.Array, marks: pa.Array) -> pa.Array:
    """The maximal stretches of spans that are repeated throughout and of single matches."""
    none = np.zeros(0, np.int64)
    out = []
    for spans, found in zip(full, marks, strict=True):
        start, stop = _spans(spans.values.to_numpy()) if spans.is_valid else (none, none)
        if found.is_valid:
            start = np.concatenate([start, found.values.field("start").to_numpy()])
            stop = np.concatenate([stop, found.values.field("stop").to_numpy()])
        out.append([{"start": a, "stop": b} for a, b in _joined(start, stop)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.array(out, kind)


def what_is_left(text: str, spans: str) -> Column:
    """Struct (n_bytes, n_removed, n_spans, kept_sha256) of the bytes outside the spans."""
    kind = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return F.arrow_udf(_what_is_left, kind)(text, spans)


def _what_is_left(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for text, found in zip(texts, spans, strict=True):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        digest, at, removed, count = hashlib.sha256(), 0, 0, 0
        for span in found.as_py() or ():
            digest.update(data[at : span["start"]])
            at = span["stop"]
            removed += span["stop"] - span["start"]
            count += 1
        digest.update(data[at:])
        rows.append((len(data), removed, count, digest.hexdigest()))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (*[pa.int64()] * 3, pa.string())
    return pa.StructArray.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )
