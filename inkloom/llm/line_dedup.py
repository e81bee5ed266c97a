"""Line dedup: documents probe a sharded minimal perfect hash of line counts.

Every line becomes two 64-bit hashes: one finds the slot in the shard's perfect hash, the
other is the fingerprint kept in that slot, so a wrong answer needs 128 equal bits. Beside the
fingerprints a shard holds, per slot, the number of documents with the line and the largest
doc_id among them. Lines themselves are never shuffled.

Hot lines: their count is known before the probe, so a line with more than a shard's share of
rows is copied into as many shards as it needs, and its probes are spread over them by doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import SPACES, packed, pick, unpacked
from inkloom.llm.perfect_hash import PerfectHash, mixed
from inkloom.session import cut_lineage

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ROWS_A_SHARD = 1 << 19
#: A hot line has more than one part in so many of all rows, so that all of them can be broadcast.
HOT_LINES = 100_000
HASHES = "h bigint, f bigint, doc_id bigint"
SHARD = "shard bigint, sizes binary, bits binary, prints binary, counts binary, last binary"


def line_key(line: str) -> bytes:
    """The line without the six white-space bytes around it, A-Z lower-cased."""
    return line.encode("utf-8", "surrogatepass").strip(SPACES).translate(LOWER)


def _hashes(text: str | None, min_chars: int) -> tuple[list[str], list[bytes | None]]:
    """Lines, and per line 16 bytes of hash, or None where the key is too short to count."""
    lines = (text or "").split("\n")
    digests: list[bytes | None] = []
    for line in lines:
        digest = None
        if len(line) >= min_chars:
            key = line_key(line)
            # No code point is longer than its bytes, so most short keys end here.
            if len(key) >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars:
                digest = xxhash.xxh3_128_digest(key)
        digests.append(digest)
    return lines, digests


def line_hashes(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(h, f, doc_id), once per document and line key of at least ``min_chars`` code points."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, parts = batch.column(0), [], []
            for text in batch.column(1):
                own = {d for d in _hashes(text.as_py(), min_chars)[1] if d}
                counts.append(len(own))
                parts.extend(own)
            both = np.frombuffer(b"".join(parts), dtype="<i8").reshape(-1, 2)
            take = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), ids.take(take)],
                names=["h", "f", "doc_id"],
            )

    return pick(docs, doc_id="bigint", text="string").mapInArrow(emit, HASHES)


def line_counts(hashes: DataFrame, min_docs: int = 2) -> DataFrame:
    """(h, f, n, last) of the lines that at least ``min_docs`` documents hold."""
    return (
        hashes.distinct()
        .groupBy("h", "f")
        .agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last"))
        .filter(F.col("n") >= min_docs)
    )


def _build(table: pa.Table) -> pa.Table:
    # Copies of a hot line may meet in one shard: each (h, f) is placed once.
    keys, prints = table["h"].to_numpy(), table["f"].to_numpy()
    order = np.lexsort((prints, keys))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(keys[order]) != 0) | (np.diff(prints[order]) != 0)
    order = order[first]
    keys, prints = keys[order], prints[order]
    hashed = PerfectHash.build(_slot_keys(keys, prints))
    slots = hashed.slots(_slot_keys(keys, prints))
    columns = []
    for values in (prints, table["n"].to_numpy()[order], table["last"].to_numpy()[order]):
        placed = np.zeros(len(keys), np.int64)
        placed[slots] = values
        columns.append(pa.array([placed.tobytes()], pa.binary()))
    sizes, bits = hashed.to_bytes()
    return pa.Table.from_arrays(
        [
            pa.array([table["shard"][0].as_py()], pa.int64()),
            pa.array([sizes], pa.binary()),
            pa.array([bits], pa.binary()),
            *columns,
        ],
        names=["shard", "sizes", "bits", "prints", "counts", "last"],
    )


def _slot_keys(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The perfect hash's keys: both hashes folded into one, distinct but for one in 2^64."""
    return mixed(keys.astype(np.uint64), 63) ^ mixed(prints.astype(np.uint64), 62)


def _probe(probes: pa.Table, index: pa.Table) -> pa.Table:
    names = ["h", "f", "doc_id", "n", "last"]
    if not probes.num_rows or not index.num_rows:
        return pa.table({name: pa.array([], pa.int64()) for name in names})
    read = lambda name: np.frombuffer(index[name][0].as_py(), np.int64)
    hashed = PerfectHash.from_bytes(index["sizes"][0].as_py(), index["bits"][0].as_py())
    prints = probes["f"].to_numpy()
    slots = hashed.slots(_slot_keys(probes["h"].to_numpy(), prints))
    hit = np.flatnonzero((slots >= 0) & (read("prints")[slots] == prints))
    at = slots[hit]
    found = probes.select(["h", "f", "doc_id"]).take(pa.array(hit))
    return found.append_column("n", pa.array(read("counts")[at])).append_column(
        "last", pa.array(read("last")[at])
    )


def probed_lines(hashes: DataFrame, counts: DataFrame, shards: int, rows: int) -> DataFrame:
    """(h, f, doc_id, n, last) of every (line, document) that the index of ``counts`` knows.

    A line in more than rows / shards documents is hot; there are at most ``shards`` of those,
    each copied into enough shards that no shard gets more than about its share of probes. With
    more than ``HOT_LINES`` shards it takes rows / ``HOT_LINES`` documents, so there are no more
    hot lines than that.
    """
    share = max(1, rows // min(shards, HOT_LINES))
    hot = counts.filter(F.col("n") > share).select(
        "h", "f", F.ceil(F.col("n") / F.lit(share)).cast("int").alias("copies")
    )
    shard = F.pmod(F.xxhash64("h", "f", "salt"), F.lit(shards).cast("bigint")).alias("shard")
    copies = F.when(
        F.col("n") > share, F.sequence(F.lit(0), F.ceil(F.col("n") / F.lit(share)).cast("int") - 1)
    ).otherwise(F.array(F.lit(0)))
    index = (
        counts.select("h", "f", "n", "last", F.explode(copies).alias("salt"))
        .select(shard, "h", "f", "n", "last")
        .groupBy("shard")
        .applyInArrow(_build, SHARD)
    )
    probes = (
        hashes.join(F.broadcast(hot), ["h", "f"], "left")
        .withColumn(
            "salt",
            F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"), F.lit(0)),
        )
        .select(shard, "h", "f", "doc_id")
    )
    return (
        probes.groupBy("shard")
        .cogroup(index.groupBy("shard"))
        .applyInArrow(_probe, f"{HASHES}, n bigint, last bigint")
    )


def lines_to_drop(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, drop): per document the 16-byte hashes of the lines it loses."""
    hashes = cut_lineage(line_hashes(docs, min_chars))
    rows = hashes.count()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, -(-rows // ROWS_A_SHARD))
    counts = cut_lineage(line_counts(hashes))
    return (
        probed_lines(hashes, counts, shards, rows)
        .filter((F.col("n") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("h", "f")).alias("drop"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every row of ``docs`` packed, with the text that is left of it.

    A line counts by its key (white space around it off, A-Z lower-cased) when that has at least
    ``min_chars`` code points; keys in at least ``min_docs`` documents (distinct non-null
    doc_ids) lose all their lines but those in the largest doc_id that holds them. Returns the
    packed rows (``doc_id``, ``text``, ``row``) with ``kept``, ``n_lines`` and ``n_dropped``.

    Null or empty text: one empty line, nothing dropped. Null doc_id: its lines can be dropped
    but never make a line frequent, nor keep it. Rows that repeat a doc_id are one document.
    Very long texts: time in proportion to their length. Empty table: no rows.
    """
    drops = lines_to_drop(docs, min_chars, min_docs).withColumnRenamed("doc_id", "drop_id")
    same = F.col("doc_id").eqNullSafe(F.col("drop_id"))
    left = _rewriter(min_chars)("text", "drop")
    return (
        packed(docs)
        .join(drops, same, "left")
        .select("doc_id", "text", "row", left.alias("left"))
        .select("doc_id", "text", "row", "left.*")
    )


def _rewriter(min_chars: int):
    """Arrow function (text, hashes to drop) -> what is left of the text, and its counts."""

    @F.arrow_udf("kept string, n_lines bigint, n_dropped bigint, kept_sha256 string")
    def rewrite(texts: pa.Array, drops: pa.Array) -> pa.Array:
        rows = []
        for text, drop in zip(texts, drops, strict=True):
            text, drop = text.as_py() or "", drop.as_py()
            n_lines = text.count("\n") + 1
            n_dropped = 0
            if drop:
                gone = {np.array([d["h"], d["f"]], "<i8").tobytes() for d in drop}
                lines, digests = _hashes(text, min_chars)
                stay = [x for x, d in zip(lines, digests, strict=True) if d not in gone]
                n_dropped = n_lines - len(stay)
                text = "\n".join(stay)
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((text, n_lines, n_dropped, digest))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["kept", "n_lines", "n_dropped", "kept_sha256"],
        )

    return rewrite


def without_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the same columns: text rewritten, n_chars counted anew; every row stays."""
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return unpacked(dedup_lines(docs, min_chars, min_docs), docs.columns, **changed)
