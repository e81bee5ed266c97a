"""Mixing sources to target weights by a low-discrepancy schedule, native from end to end.

Slot t of the schedule has the golden-ratio point frac(t * phi), in 30-bit integers so that it
is exact at any t. The points are mapped through the cumulative block needs of the sources; a
slot's rank among the slots of its source names the block it takes. Blocks are equal runs of
words of the source's documents in hash order, so rank r means block r modulo the number of
blocks, in pass r div that number.

Nothing is ordered in one place: ranks and word positions are sums over chunks plus a sum within
the chunk, and documents of one source, however many, lie in ``BUCKETS`` chunks of the hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.llm.common import packed, pick, unpacked
from inkloom.operators.keyed import lookup_join
from inkloom.session import cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"
#: round(2^30 / golden ratio); odd, so the points of one period are all different.
STEP, PERIOD = 663608941, 1 << 30
#: Hex digits of the md5 of the id that name a chunk of a source.
BUCKET_DIGITS = 3
#: Cells of the unit interval through which points meet the sources' ranges.
CELLS = 4096
CHUNK = 1 << 15


def _row_keyed(docs: DataFrame) -> DataFrame:
    """Packed rows with ``mix_row``, which rows share that are alike in every column."""
    alike = F.xxhash64("doc_id", "text", F.to_json("row"))
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), alike.alias("alike"))
    return packed(docs).withColumn("mix_row", key)


def sized(docs: DataFrame, *, by_row: bool = False) -> DataFrame:
    """(doc_id, source, size, mix_key): words of the whole text and the place in the shuffle.

    ``by_row`` adds ``mix_row``, what a row is found by when its words have been dealt.
    """
    if by_row:
        at = docs.columns.index("source") if "source" in docs.columns else None
        source = F.lit(None) if at is None else F.col(f"row._{at}")
        rows = _row_keyed(docs).withColumn("source", source.cast("string"))
    else:
        rows = pick(docs, doc_id="bigint", text="string", source="string")
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    own = ["mix_row"] if by_row else []
    return rows.select("doc_id", "source", size.alias("size"), key.alias("mix_key"), *own)


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: float, most: float
) -> DataFrame:
    """(s, source, source_size, target) for (source, source_size) rows, one a source.

    Sources by code point, null last, get the weights in turn; their targets add up to ``share``
    of all sizes. Ordered by cap over weight, the capped sources are a prefix: the first whose
    share of what is left is under its cap sets the level for itself and all after it.
    """
    everything = Window.partitionBy()
    numbered = sizes.withColumn(
        "s", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    ).withColumn(
        "w",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int"),
        ),
    )
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy(cap / F.col("w"), "s")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = numbered.select(
        "s", "source", "source_size", "w", cap.alias("cap"),
        (budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0))).alias("rest"),
        F.sum("w").over(onward).alias("rest_w"),
        F.row_number().over(by_ratio).alias("k"),
    )
    free = F.col("rest") * F.col("w") <= F.col("cap") * F.col("rest_w")
    first = F.min(F.when(free, F.struct("k", "rest", "rest_w"))).over(everything)
    return level.withColumn("first", first).select(
        "s", "source", "source_size",
        F.when(F.col("k") < F.coalesce("first.k", F.col("k") + 1), F.col("cap"))
        .otherwise(F.col("w") * F.col("first.rest") / F.col("first.rest_w"))
        .alias("target"),
    )


def _running(value: Column, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


def _placed(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents with their source's figures and ``start``, their first word's number in it."""
    chunked = docs.withColumn("bucket", F.substring("mix_key", 1, BUCKET_DIGITS))
    totals = chunked.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    offsets = totals.select(
        F.col("source").alias("o_source"),
        F.col("bucket").alias("o_bucket"),
        _running(F.col("total"), Window.partitionBy("source").orderBy("bucket")).alias("offset"),
    ).join(sources, F.col("o_source").eqNullSafe(F.col("source")))
    own = [name for name in docs.columns if name == "mix_row"]
    within = Window.partitionBy("source", "bucket").orderBy("mix_key", "doc_id", "size", *own)
    return (
        chunked.withColumn("within", _running(F.col("size"), within))
        .join(
            offsets.drop("source"),
            F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")),
        )
        .select(
            "doc_id", "size", "s", "source_size", "target", "block_words", "blocks",
            (F.col("offset") + F.col("within")).alias("start"), *own,
        )
    )


def _slots(sources: DataFrame, count: int, most: int) -> DataFrame:
    """(slot, s, block, pass): the schedule, each slot with the block it takes."""
    spark = sources.sparkSession
    needs = F.col("target") / F.col("block_words")
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = (
        sources.filter("source_size > 0")
        .select("s", "blocks", needs.alias("need"), F.sum(needs).over(upto).alias("upto"))
        .withColumn("all", F.max("upto").over(Window.partitionBy()))
        .withColumn("prior", F.lag("upto", 1, 0.0).over(Window.orderBy("s")))
        .select(
            "s", "blocks",
            (F.col("prior") / F.col("all")).alias("low"),
            F.when(F.col("upto") == F.col("all"), 1.0)
            .otherwise(F.col("upto") / F.col("all"))
            .alias("high"),
        )
    )
    cells = ranges.withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.floor(F.col("low") * CELLS),
                F.least(F.lit(CELLS - 1), F.floor(F.col("high") * CELLS)),
            )
        ),
    )
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count >> 20)
    point = F.pmod(F.pmod(F.col("id"), F.lit(PERIOD)) * F.lit(STEP), F.lit(PERIOD)) / F.lit(
        float(PERIOD)
    )
    slots = spark.range(0, count, 1, partitions).select(
        F.col("id").alias("slot"), point.alias("point"), F.floor(point * CELLS).alias("cell")
    )
    dealt = (
        slots.join(cells, "cell")
        .filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
        .select("slot", "s", "blocks", F.floor(F.col("slot") / F.lit(CHUNK)).alias("chunk"))
    )
    totals = dealt.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n"))
    offsets = totals.select(
        "s", "chunk", _running(F.col("n"), Window.partitionBy("s").orderBy("chunk")).alias("before")
    )
    within = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    rank = F.col("before") + F.col("within")
    return (
        dealt.withColumn("within", within)
        .join(offsets, ["s", "chunk"])
        .select(
            "slot", "s",
            F.pmod(rank, F.col("blocks")).alias("block"),
            F.floor(rank / F.col("blocks")).alias("pass"),
        )
        .filter(F.col("pass") < most)
    )


def _laid_out(
    docs: DataFrame, weights: Sequence[int], share: float, most: int,
    block_words: int, min_blocks: int, by_row: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Placed documents, and the schedule joined with the words of each block."""
    thin = cut_lineage(sized(docs, by_row=by_row))
    words = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    length = F.greatest(
        F.lit(1),
        F.least(F.lit(block_words), F.floor(F.col("source_size") / F.lit(min_blocks))),
    ).cast("bigint")
    sources = cut_lineage(
        source_targets(words, weights, share, most)
        .withColumn("block_words", length)
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("bigint"))
    )
    needed = sources.agg(F.sum(F.col("target") / F.col("block_words"))).first()[0] or 0.0
    placed = cut_lineage(_placed(thin, sources))
    first = F.floor(F.col("start") / F.col("block_words"))
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words"))
    pieces = (
        placed.filter("size > 0")
        .select("doc_id", "s", "start", "size", "block_words",
                F.explode(F.sequence(first, last)).alias("block"))
        .select(
            "doc_id", "s", "block", "start",
            F.greatest(F.col("start"), F.col("block") * F.col("block_words")).alias("from"),
            F.least(
                F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words")
            ).alias("to"),
        )
    )
    schedule = _slots(sources, int(needed + 0.5), most).join(pieces, ["s", "block"])
    return placed, schedule


def schedule(
    docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2,
    block_words: int = 1024, min_blocks: int = 256,
) -> DataFrame:
    """The mix in order: (slot, s, block, pass, doc_id, first_word, words) of every piece."""
    _, dealt = _laid_out(docs, weights, share, most, block_words, min_blocks)
    return dealt.select(
        "slot", "s", "block", "pass", "doc_id",
        (F.col("from") - F.col("start")).alias("first_word"),
        (F.col("to") - F.col("from")).alias("words"),
    )


def taken_words(
    docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2,
    block_words: int = 1024, min_blocks: int = 256,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    Null text: size 0, taken 0. Null source: a source of its own, the last. Null doc_id: a
    document whose place in the shuffle is that of an empty id. Rows that repeat a doc_id are
    documents of their own. No document is taken more than ``most`` times its size, as a block
    is passed over at most so often. A source misses its target by a few blocks at most, and has
    ``min_blocks`` blocks or as many as it has words. Empty table, or no words: nothing taken.
    """
    placed, dealt = _laid_out(docs, weights, share, most, block_words, min_blocks)
    # A document with words is told by its source and first word.
    taken = dealt.groupBy("s", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    with_words = placed.filter("size > 0").join(taken, ["s", "start"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    return with_words.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken")).union(
        placed.filter("size = 0").select(*columns, F.lit(0).cast("bigint").alias("taken"))
    )


def mixed(
    docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2,
    block_words: int = 1024, min_blocks: int = 256,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes words from, with ``mix_target`` and ``mix_taken``.

    Every row has what is taken from it alone, also among rows that share a doc_id or have none.
    Rows that are alike in all columns are as many as were taken from.
    """
    placed, dealt = _laid_out(docs, weights, share, most, block_words, min_blocks, by_row=True)
    taken = dealt.groupBy("s", "start").agg(F.sum(F.col("to") - F.col("from")).alias("mix_taken"))
    found = placed.filter("size > 0").join(taken.filter("mix_taken > 0"), ["s", "start"])
    found = found.select("mix_row", "s", "start", F.col("target").alias("mix_target"), "mix_taken")
    # Rows that are alike are one here and come back once for each row taken from.
    rows = _row_keyed(docs).dropDuplicates(["mix_row"])
    both = lookup_join(cut_lineage(found), rows, "mix_row", spread=["s", "start"], how="inner")
    return unpacked(
        both, [*docs.columns, "mix_target", "mix_taken"],
        mix_target=F.col("mix_target"), mix_taken=F.col("mix_taken"),
    )
