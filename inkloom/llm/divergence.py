"""Source divergence audit: which terms set a source apart within its language.

Terms are counted by sorting pointers to token starts. A shard takes the Arrow text buffers of
its documents in slices, marks where tokens start and sorts the pointers with a multikey
quicksort whose characters are eight bytes wide: pointers with equal characters whose tokens go
on are sorted by the next eight. Equal runs of the sorted pointers are the terms; their lengths
by source are the source counts and their distinct documents the document frequency. Counts of
slices combine before and after the shuffle, so neither a frequent term nor a large source meets
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.llm.byte_pairs import gathered
from inkloom.llm.common import pick
from inkloom.llm.line_dedup import LOWER
from inkloom.operators.keyed import small_side
from inkloom.session import cut_lineage

#: Letters and every byte of a character beyond ASCII: the bytes of terms.
IN_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
LOWERED = np.frombuffer(LOWER, np.uint8)
#: Bytes of text sorted at once; a longer single text is a slice of its own.
SLICE = 8 << 20
#: Kept terms, and sources a side, that one task compares at once.
TERMS_AT_ONCE = 1 << 15
SIDE = 32
UNIT = 1_000_000_000


# -- counting ----------------------------------------------------------------------------------


def token_runs(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each token of the bytes; no token crosses one of the ``edges``."""
    inside = np.concatenate([[False], IN_TERM[data], [False]])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = edges[(edges > 0) & (edges < len(data))]
    first[cut] = inside[cut + 1]
    last[cut - 1] = inside[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def characters(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The next eight bytes of each pointer as a number that sorts as they do; zero-filled."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)[start]
    value = np.ascontiguousarray(wide).view(">u8").ravel().astype(np.uint64)
    unused = (8 * (8 - np.minimum(length, 8))).astype(np.uint64)
    return value >> unused << unused


def sorted_terms(
    data: np.ndarray, start: np.ndarray, length: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The pointers in the order of their tokens, and the number of each one's term.

    Tokens hold no zero byte, so zero-filled characters keep their order; of tokens with equal
    characters those that end here come before those that go on.
    """
    order = np.arange(len(start))
    edge = np.zeros(len(start), bool)
    places, group, depth = order.copy(), np.zeros(len(start), np.int64), 0
    while len(places):
        who = order[places]
        value = characters(data, start[who] + depth, length[who] - depth)
        goes_on = length[who] > depth + 8
        by = np.lexsort((goes_on, value, group) if depth else (goes_on, value))
        order[places] = who[by]
        value, goes_on, group = value[by], goes_on[by], group[by]
        new = np.ones(len(places), bool)
        new[1:] = (np.diff(group) != 0) | (value[1:] != value[:-1]) | (goes_on[1:] != goes_on[:-1])
        edge[places] |= new
        run = np.cumsum(new) - 1
        left = goes_on & (np.bincount(run)[run] > 1)
        places, group, depth = places[left], run[left], depth + 8
    return order, np.cumsum(edge) - 1


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array's texts, nulls as empty ones, and where each begins and ends."""
    flat = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return data, edges - edges[0]


def run_counts(data: np.ndarray, edges: np.ndarray, group: np.ndarray, groups: int):
    """(terms, group, n, df): of each term and group of documents that has it, its occurrences
    and the documents they stand in."""
    data = LOWERED[data]
    start, length = token_runs(data, edges)
    order, term = sorted_terms(data, start, length)
    documents = len(edges) - 1
    owner = np.repeat(np.arange(documents), np.diff(np.searchsorted(start, edges)))[order]
    pairs, times = np.unique(term * documents + owner, return_counts=True)
    key, back = np.unique(
        pairs // documents * groups + group[pairs % documents], return_inverse=True
    )
    first = order[np.flatnonzero(np.diff(term, prepend=-1))][key // groups]
    size = length[first]
    names = pa.StringArray.from_buffers(
        len(key),
        pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
        pa.py_buffer(gathered(data, start[first], size)),
    )
    n = np.zeros(len(key), np.int64)
    np.add.at(n, back, times)
    return names, key % groups, n, np.bincount(back, minlength=len(key))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) of (lang, source, text) rows without null lang or source."""
    size = SLICE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = bytes_of(batch["text"])[1]
            at = 0
            while at < len(batch):
                to = int(np.searchsorted(edges, edges[at] + size, "right")) - 1
                to = min(len(batch), max(at + 1, to))
                yield of_slice(batch.slice(at, to - at))
                at = to

    def of_slice(rows: pa.RecordBatch) -> pa.RecordBatch:
        codes: dict[tuple[str, str], int] = {}
        both = zip(rows["lang"].to_pylist(), rows["source"].to_pylist(), strict=True)
        group = np.array([codes.setdefault(x, len(codes)) for x in both], np.int64)
        names, own, n, df = run_counts(*bytes_of(rows["text"]), group, len(codes))
        columns = [pa.array([x[k] for x in codes], pa.string()).take(pa.array(own)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [*columns, names, pa.array(n), pa.array(df.astype(np.int64))],
            names=["lang", "source", "term", "n", "df"],
        )

    made = docs.select("lang", "source", "text").mapInArrow(
        count, "lang string, source string, term string, n bigint, df bigint"
    )
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


# -- comparing ---------------------------------------------------------------------------------


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), exact at any count; null where nothing is kept."""
    whole = (n + F.lit(1)).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", whole, F.nullif(total + kept, F.lit(0)).cast("decimal(20,0)")) + F.lit(1)


def gain(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, *, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    ``docs`` has lang, source and text; null is read as empty, other columns are not looked at.
    Every row is a document of its own, also one that repeats another or its id. Terms are runs
    of letters and of characters beyond ASCII, A to Z lower-cased; a language keeps those of
    ``min_docs`` of its documents. With p and q shares in units of 10^-9, add-one smoothed, part
    ``pair`` compares a source with each other source of its language, summed over the kept
    terms, and part ``term`` lists the ``top`` terms it has more of than its language. Ties go by
    the item's UTF-8 bytes. Texts without terms and languages without kept terms give pairs of
    value 0; an empty table gives no rows.
    """
    rows = pick(docs, lang="string", source="string", text="string")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")})
    word = Window.partitionBy("lang", "term")
    counted = term_counts(rows).select(
        "lang", "source", "term", "n",
        F.sum("n").over(word).alias("n_lang"),
        F.sum("df").over(word).alias("df_lang"),
        (F.row_number().over(word.orderBy("source")) == 1).cast("bigint").alias("first"),
    )
    known = cut_lineage(counted.filter(F.col("df_lang") >= min_docs).drop("df_lang"))
    by_lang = known.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("all"))
    by_source = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("bigint")
    sources = cut_lineage(
        rows.select("lang", "source").distinct()
        .join(by_source, ["lang", "source"], "left")
        .join(by_lang, "lang", "left")
        .select(
            "lang", "source",
            *[F.coalesce(c, none).alias(c) for c in ("total", "kept", "all")],
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("s"),
        )
        .withColumn("rare", share(none, F.col("total"), F.col("kept")))
    )
    known = known.join(small_side(sources), ["lang", "source"]).withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("kept"))
    )
    return _terms(known, top).unionByName(_pairs(known, sources))


def _ranked(frame: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return frame.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value",
        F.row_number().over(order).alias("rank"),
    )


def _terms(known: DataFrame, top: int) -> DataFrame:
    q = share(F.col("n_lang"), F.col("all"), F.col("kept"))
    found = known.withColumn("q", q).filter(F.col("p") > F.col("q"))
    found = found.select("lang", "source", F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))
    return _ranked(found, "term").filter(F.col("rank") <= top)


def _pairs(known: DataFrame, sources: DataFrame) -> DataFrame:
    """Sums over all kept terms for each two sources of a language.

    A unit of work is a shard of a language's kept terms and two blocks of its sources; terms
    that none of them has add the same for each, and are added as a number at the end.
    """
    sides = F.floor(F.col("s") / SIDE).cast("int")
    last = F.floor((F.max("s").over(Window.partitionBy("lang"))) / SIDE).cast("int")
    shards = F.greatest(F.lit(1), F.ceil(F.col("kept") / F.lit(TERMS_AT_ONCE))).cast("int")
    dealt = cut_lineage(
        sources.select("lang", "s", "rare", sides.alias("side"), last.alias("last"), shards.alias("shards"))
    )
    # Block pairs that a source takes part in, from either side.
    blocks = F.expr(
        "array_distinct(concat(transform(sequence(0, last), x -> struct(side AS i, x AS j)),"
        " transform(sequence(0, last), x -> struct(x AS i, side AS j))))"
    )
    cells = (
        dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select("lang", "s", "rare", "side", "shard", F.explode(blocks).alias("cell"))
        .select("lang", "s", "rare", "side", "shard", "cell.i", "cell.j")
        .toDF("lang", "s", "rare", "own", "shard", "i", "j")
    )
    counts = (
        known.select("lang", "term", "s", "p")
        .join(small_side(dealt.select("lang", "s", "side", "last", "shards")), ["lang", "s"])
        .withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
        .select("lang", "term", "s", "p", "side", "shard", F.explode(blocks).alias("cell"))
        .select("lang", "term", "s", "p", "side", "shard", "cell.i", "cell.j")
    )
    key = ["lang", "shard", "i", "j"]

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, _, i, j = (x.as_py() for x in key)
        s, rare, own = (right[c].to_numpy() for c in ("s", "rare", "own"))
        term = left["term"].combine_chunks().dictionary_encode()
        term = (term.chunk(0) if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
        terms = int(term.max()) + 1 if len(term) else 0
        s_of, p_of, side_of = (left[c].to_numpy() for c in ("s", "p", "side"))
        names, shares = [], []
        for side in (i, j):
            mine = np.sort(s[own == side])
            filled = np.broadcast_to(rare[own == side][np.argsort(s[own == side])], (terms, len(mine))).copy()
            here = side_of == side
            filled[term[here], np.searchsorted(mine, s_of[here])] = p_of[here]
            names.append(mine)
            shares.append(filled)
        out = []
        for k, a in enumerate(names[0].tolist()):
            apart = shares[0][:, k, None] - shares[1]
            total = (apart * apart // shares[1]).sum(axis=0)
            out += [(lang, a, b, v, terms) for b, v in zip(names[1].tolist(), total.tolist(), strict=True) if a != b]
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "a", "b", "value", "seen"])

    compared = counts.groupBy(*key).cogroup(cells.groupBy(*key)).applyInArrow(
        compare, "lang string, a int, b int, value bigint, seen bigint"
    )
    named = sources.select("lang", "s", "source", "rare", "kept")
    one = named.select("lang", F.col("s").alias("a"), "source", F.col("rare").alias("rare_a"), "kept")
    two = named.select("lang", F.col("s").alias("b"), F.col("source").alias("item"), F.col("rare").alias("rare_b"))
    total = (
        compared.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
        .join(small_side(one), ["lang", "a"]).join(small_side(two), ["lang", "b"])
    )
    unseen = (F.col("kept") - F.col("seen")) * gain(F.col("rare_a"), F.col("rare_b"))
    value = F.col("value") + F.coalesce(unseen, F.lit(0))
    return _ranked(total.select("lang", "source", "item", value.alias("value")), "pair")
