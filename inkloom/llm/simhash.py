"""SimHash near-dedup: exact comparison of fingerprints in tiles.

Distinct fingerprints within ``radius`` bits agree on at least one way of leaving out ``radius``
of their blocks, so the comparison is dealt by block values: a pair that is never in one bucket
cannot be linked. Inside a bucket the fingerprints are cut into tiles in order of population
count, and a pair of tiles is a unit of work: numpy xors one tile against the other and counts
bits, unless the two ranges of population counts are further apart than the radius. A tile pair
gives a spanning forest of its links, never all pairs, and components do not change by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import packed, pick, unpacked
from inkloom.llm.components import components
from inkloom.llm.line_dedup import LOWER
from inkloom.session import cut_lineage

BITS = 64
TILE = 2048


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; fewer words: of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        runs, n = [b" ".join(words)], 1
    else:
        runs = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
        n = len(words) - shingle + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in more than half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp), one row a document row; fp is the fingerprint as a signed 64-bit number."""
    rows = pick(docs, doc_id="bigint", text="string")
    return rows.select("doc_id", _print_of(shingle, seed)("text").alias("fp"))


def _print_of(shingle: int, seed: int):
    """Arrow function text -> fingerprint."""

    @F.arrow_udf("bigint")
    def emit(texts: pa.Array) -> pa.Array:
        prints = [fingerprint(shingle_hashes(x.as_py(), shingle, seed)) for x in texts]
        return pa.array(np.array(prints, np.uint64).view(np.int64))

    return emit


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links between two tiles (or within one).

    ``tree`` numbers the trees; a fingerprint is linked once to each other tree near it. Indices
    of ``right`` follow those of ``left`` unless both are one array.
    """
    shift = 0 if left is right else len(left)
    tree = np.arange(shift + len(right))
    links: list[tuple[int, int]] = []
    rows = max(1, (1 << 18) // max(1, len(right)))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at : at + rows, None] ^ right[None, :]) <= radius
        if not shift:
            near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        for row in np.flatnonzero(near.any(axis=1)).tolist():
            a, around = at + row, np.flatnonzero(near[row]) + shift
            trees, first = np.unique(tree[around], return_index=True)
            other = trees != tree[a]
            if other.any():
                links.extend((a, b) for b in around[first[other]].tolist())
                tree[np.isin(tree, trees[other])] = tree[a]
    return links


def _blocks(count: int, radius: int) -> int:
    """Blocks a fingerprint is cut into: more of them, and so longer keys, for more fingerprints."""
    if radius == 0:
        return 1
    for extra, most in ((1, 1 << 22), (2, 1 << 31)):
        if count <= most:
            return radius + extra
    return radius + 3


def _keys(count: int, radius: int) -> list[int]:
    """Bit masks; two fingerprints within the radius agree under at least one of them."""
    blocks = _blocks(count, radius)
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): enough links between the ``node`` values of (node, fp) rows to connect all that
    are within ``radius`` bits; ``fp`` is distinct."""
    count = distinct.count()
    masks = _keys(count, radius)
    keyed = distinct.select(
        "node",
        "fp",
        F.bit_count("fp").alias("pop"),
        F.posexplode(
            F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")) for m in masks])
        ).alias("table", "block"),
    )
    # Pieces of a bucket: one for each started `tile` of its fingerprints, dealt by population
    # count, so that a piece is a narrow band of counts and far bands are never compared.
    sizes = (
        keyed.groupBy("table", "block", "pop")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("table", "block")
        .agg(F.sum("n").alias("size"), F.collect_list(F.struct("pop", "n")).alias("pops"))
        .filter("size > 1")
    )
    dealt = keyed.join(sizes.select("table", "block", "size", "pops"), ["table", "block"])
    # Of one population count, tiles are dealt by a hash; a tile is (pop, part).
    parts = F.greatest(
        F.lit(1),
        F.ceil(
            F.aggregate(
                "pops", F.lit(0).cast("bigint"),
                lambda acc, x: F.when(x["pop"] == F.col("pop"), x["n"]).otherwise(acc),
            )
            / F.lit(tile)
        ),
    ).cast("int")
    small = F.col("size") <= tile
    # (band, part) of this row; a small bucket is one tile.
    dealt = dealt.select(
        "node", "fp", "table", "block", "size",
        F.when(small, -1).otherwise(F.col("pop")).alias("band"),
        F.when(small, 0).otherwise(F.pmod(F.xxhash64("fp"), parts)).cast("int").alias("part"),
        F.when(small, F.array(F.struct(F.lit(-1).alias("pop"), F.lit(1).alias("parts"))))
        .otherwise(
            F.transform(
                F.filter("pops", lambda x: F.abs(x["pop"] - F.col("pop")) <= radius),
                lambda x: F.struct(
                    x["pop"].cast("int").alias("pop"),
                    F.greatest(F.lit(1), F.ceil(x["n"] / F.lit(tile))).cast("int").alias("parts"),
                ),
            )
        )
        .alias("near"),
    )
    # Every tile pair whose bands are within the radius, once: (lower tile, upper tile).
    pairs = dealt.select(
        "node", "fp", "table", "block",
        F.struct("band", "part").alias("own"),
        F.explode(
            F.flatten(
                F.transform(
                    "near",
                    lambda x: F.transform(
                        F.sequence(F.lit(0), x["parts"] - 1),
                        lambda p: F.struct(x["pop"].alias("band"), p.alias("part")),
                    ),
                )
            )
        ).alias("other"),
    )
    pairs = pairs.select(
        "node", "fp", "table", "block",
        F.least("own", "other").alias("lower"),
        F.greatest("own", "other").alias("upper"),
        (F.col("own") <= F.col("other")).alias("is_lower"),
    ).select(
        "node", "fp",
        F.xxhash64("table", "block", "lower", "upper").alias("pair"),
        F.xxhash64(F.lit(7), "table", "block", "lower", "upper").alias("check"),
        "is_lower",
        (F.col("lower") == F.col("upper")).alias("same"),
    )
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pairs.repartition(partitions, "pair").sortWithinPartitions("pair", "check")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            own = [
                batch[name].to_numpy(zero_copy_only=False)
                for name in ("pair", "check", "node", "fp", "is_lower", "same")
            ]
            ends = np.flatnonzero((np.diff(own[0]) != 0) | (np.diff(own[1]) != 0)) + 1
            cuts = [0, *ends.tolist(), len(own[0])]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = [c[a:b] for c in own]
                if held and held[0][0] == piece[0][0] and held[1][0] == piece[1][0]:
                    held = [np.concatenate(x) for x in zip(held, piece, strict=True)]
                    continue
                out += _tile_links(held, radius)
                held = piece
            yield _link_batch(out)
        yield _link_batch(_tile_links(held, radius))

    return spread.mapInArrow(compare, "a bigint, b bigint")


def _tile_links(columns: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    """Links, as nodes, within the rows of one tile pair."""
    if not columns or len(columns[0]) < 2:
        return []
    _, _, node, prints, lower, same = columns
    prints = prints.view(np.uint64)
    if same[0]:
        sides = [np.arange(len(node))] * 2
    else:
        sides = [np.flatnonzero(lower), np.flatnonzero(~lower)]
        if not len(sides[0]) or not len(sides[1]):
            return []
    left = prints[sides[0]]
    right = left if same[0] else prints[sides[1]]
    names = node[sides[0]] if same[0] else np.concatenate([node[sides[0]], node[sides[1]]])
    return [(int(names[a]), int(names[b])) for a, b in _forest(left, right, radius)]


def _link_batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(rows, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"]
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, tile: int = TILE
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id``
    is the smallest doc_id reachable. Null or empty text: fingerprint zero, linked like any
    other. Rows that repeat a doc_id are rows of their own. A null doc_id takes part with its
    fingerprint but is never the smallest; a component of null ids only has a null id. Long
    texts: memory of one text and its hashes. Empty table: no rows.
    """
    prints = cut_lineage(fingerprints(docs, shingle, seed))
    of_print = cut_lineage(_components_of(prints, radius, tile).select("fp", "component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def _components_of(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(fp, least, component, component_id) of each fingerprint: the smallest doc_id that has it,
    the component's label, which is one of its fingerprints, and its smallest doc_id."""
    # The node of a fingerprint: its own bits; the smallest document comes in after linking.
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(distinct.select(F.col("fp").alias("node"), "fp"), radius, tile))
    grouped = distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return grouped.join(smallest, "component")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id's, nulls last.

    Of rows that repeat that id in the component the smallest row by text and then by its other
    columns stays; components may share an id, and those of null ids only keep a row each.
    """
    prints = cut_lineage(fingerprints(docs, shingle, seed).distinct())
    found = cut_lineage(_components_of(prints, radius).select("fp", "component", "component_id"))
    # Thin rows first: the fingerprints, with their component, that a surviving row may have.
    keep = (
        prints.join(found, "fp")
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.col("doc_id").alias("keep_id"), F.col("fp").alias("keep_fp"), "component")
    )
    rows = packed(docs).withColumn("fp", _print_of(shingle, seed)("text"))
    chosen = (
        rows.join(keep, (F.col("fp") == F.col("keep_fp")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("component")
        .agg(F.min(F.struct("text", "row")).alias("least"))
    )
    return unpacked(chosen.select("least.text", "least.row"), docs.columns)
