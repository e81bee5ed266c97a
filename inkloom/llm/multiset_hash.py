"""Document fingerprints by a homomorphic multiset hash, native from end to end.

A text is the multiset of its units: the sentences of its paragraphs, and of a sentence without
end at most ``UNIT_WORDS`` words at a time. The md5 of a unit gives two 60-bit numbers and from
these a wide sparse vector, 1 in the count lane and

* four dense lanes of 30 bits, which tell multisets apart;
* one binned lane of 16 bits on each level the unit reaches: all units reach level 0, half of
  them level 1, and so on to level ``LEVELS`` - 1. A level has ``BINS`` lanes.

Vectors are added lane by lane, modulo 2^32 (dense) and 2^16 (binned), so the sum does not depend
on the order of units; a unit is inserted by adding its vector and deleted by subtracting it, and
equal multisets have equal sums. The binned lanes answer more: a lane is equal in two sums unless
a unit that differs fell into it, so the share of equal lanes on a level that is not yet full
tells how many units differ, with a standard error of about a ninth of their number. The last
level is not full before a thousand million units differ.

A sum is a struct (n, dense, bins): ``bins`` holds the lanes that units reached, in order, each as
lane * 2^16 + sum. A fingerprint is its hex: 8 digits of n, 4 x 8 of the dense lanes, and 7 for
each binned lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.functions.strings import bind
from inkloom.llm.common import pick
from inkloom.session import cut_lineage

BINS = 128
LEVELS = 24
HALF = (1 << 30) - 1
UNIT_WORDS = 6
_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09\x0B-\x0D]"
#: Up to five words that end no sentence, and one word more, all of one line.
UNIT = rf"(?:{_WORD}*[^\x20\x09-\x0D.!?]{_GAP}+){{0,{UNIT_WORDS - 1}}}{_WORD}+"
#: All up to the last place behind which a unit begins, whatever follows.
WHOLE_UNITS = r"(?s)\A.*(?:\n|[.!?][\x20\x09-\x0D])"


def units_of(text: Column) -> Column:
    """The units of a text in order; none for a null or blank text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))


def numbers_of(units: Column) -> Column:
    """Two 60-bit numbers (x, y) from the md5 of each unit."""

    def numbers(unit: Column) -> Column:
        digest = F.md5(unit.cast("binary"))
        number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
        return F.struct(number(1).alias("x"), number(17).alias("y"))

    return F.transform(units, numbers)


def _codes(numbers: Column) -> Column:
    """lane * 2^32 + value, once for each level that the unit reaches."""
    x = numbers["x"]
    # The zeros that end the number's upper bits, LEVELS - 1 at most: the ones below the lowest one.
    upper = F.shiftright(x, 32).bitwiseOR(F.lit(1 << (LEVELS - 1)))
    levels = F.sequence(F.lit(0), F.bit_count(upper.bitwiseAND(-upper) - 1).cast("int"))
    lane = F.pmod(F.shiftright(x, 16).bitwiseAND(F.lit(0xFFFF)), F.lit(BINS)).cast("bigint")
    value = x.bitwiseAND(F.lit(0xFFFF))
    return F.transform(
        levels, lambda k: (lane + k * BINS) * F.lit(1 << 32) + value
    )


def _binned(codes: Column) -> Column:
    """Sums modulo 2^16 by lane: the codes in order, a lane is closed where the next one begins."""

    def lane_of(code: Column) -> Column:
        return F.shiftright(code, 32).cast("int")

    def closed(acc: Column) -> Column:
        total = (acc["lane"] * F.lit(1 << 16) + F.pmod(acc["total"], F.lit(1 << 16))).cast("int")
        return F.when(acc["lane"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(total)))

    def add(acc: Column, code: Column) -> Column:
        value = code.bitwiseAND(F.lit(0xFFFF))
        same = lane_of(code) == acc["lane"]
        return F.struct(
            F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"),
            lane_of(code).alias("lane"),
            F.when(same, acc["total"] + value).otherwise(value).alias("total"),
        )

    start = F.struct(
        F.array().cast("array<int>").alias("done"),
        F.lit(-1).alias("lane"),
        F.lit(0).cast("bigint").alias("total"),
    )
    return F.aggregate(F.sort_array(codes), start, add, closed)


def multiset_sum(numbers: Column) -> Column:
    """The vector sum of units, each given by its numbers."""

    def over(value) -> Column:
        total = F.aggregate(
            numbers, F.lit(0).cast("bigint"), lambda acc, u: acc + value(u)
        )
        return F.pmod(total, F.lit(1 << 32))

    dense = F.array(
        over(lambda u: u["x"].bitwiseAND(F.lit(HALF))),
        over(lambda u: F.shiftright(u["x"], 30)),
        over(lambda u: u["y"].bitwiseAND(F.lit(HALF))),
        over(lambda u: F.shiftright(u["y"], 30)),
    )
    return F.struct(
        F.size(numbers).cast("bigint").alias("n"),
        dense.alias("dense"),
        _binned(F.flatten(F.transform(numbers, _codes))).alias("bins"),
    )


def fingerprint(total: Column) -> Column:
    """The hex form of a sum."""
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")
    whole = F.concat(
        digits(total["n"], 8),
        F.array_join(F.transform(total["dense"], lambda x: digits(x, 8)), ""),
        F.array_join(F.transform(total["bins"], lambda x: digits(x, 7)), ""),
    )
    return F.lower(whole)


def combined(left: Column, right: Column, sign: int = 1) -> Column:
    """The sum of two multisets together or, with sign -1, of the first without the second."""
    codes = lambda side, s: F.transform(
        side["bins"],
        lambda b: F.shiftright(b, 16).cast("bigint") * F.lit(1 << 32)
        + F.pmod(b.bitwiseAND(F.lit(0xFFFF)) * F.lit(s), F.lit(1 << 16)),
    )
    dense = F.zip_with(
        left["dense"], right["dense"], lambda a, b: F.pmod(a + b * F.lit(sign), F.lit(1 << 32))
    )
    return F.struct(
        (left["n"] + right["n"] * F.lit(sign)).alias("n"),
        dense.alias("dense"),
        _binned(F.concat(codes(left, 1), codes(right, sign))).alias("bins"),
    )


def likeness(left: Column, right: Column) -> Column:
    """1 - d / (units of both), d the estimated number of units that only one of them has.

    On level k a lane differs with probability 1 - exp(-d / 2^k / BINS); the first level of which
    at most four fifths of the lanes differ is used, or the last. Equal sums have likeness 1.
    """
    lanes = lambda one, other: F.transform(
        F.array_except(one["bins"], other["bins"]), lambda b: F.shiftright(b, 16)
    )
    differ = F.array_union(lanes(left, right), lanes(right, left))
    return bind(differ, lambda d: _likeness(left, right, d))


def _likeness(left: Column, right: Column, differ: Column) -> Column:
    def off(k: Column) -> Column:
        within = lambda lane: (lane >= k * BINS) & (lane < (k + 1) * BINS)
        return F.struct(k.alias("level"), F.size(F.filter(differ, within)).alias("off"))

    # No lane differs on the level after the last one that has some.
    top = F.coalesce(F.floor(F.array_max(differ) / F.lit(BINS)).cast("int") + 1, F.lit(0))
    counts = F.transform(F.sequence(F.lit(0), F.least(top, F.lit(LEVELS - 1))), off)
    enough = lambda c: (5 * c["off"] <= 4 * BINS) | (c["level"] == LEVELS - 1)
    later = F.element_at(F.filter(counts, enough), 1)
    units = left["n"] + right["n"]

    def near(at: Column) -> Column:
        full = F.least(at["off"], F.lit(BINS - 0.5)) / F.lit(float(BINS))
        gone = -F.ln(1 - full) * F.lit(BINS) * F.pow(F.lit(2.0), at["level"])
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - gone / units))

    # The first level does for most texts; the others are counted only where it does not.
    at = bind(off(F.lit(0)), lambda c: F.when(enough(c), c).otherwise(later))
    same = (left["n"] == right["n"]) & (left["dense"] == right["dense"]) & (F.size(differ) == 0)
    return F.when(same | (units == 0), F.lit(1.0)).otherwise(F.round(bind(at, near), 6))


def _settled(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later steps read and the optimizer does not copy into each of them."""
    return frame.withColumn(name, F.explode(F.array(value)))


def with_sum(frame: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the vector sum of a text column's units."""
    hashed = _settled(frame, "_numbers", numbers_of(units_of(F.col(text))))
    return _settled(hashed, out, multiset_sum(F.col("_numbers"))).drop("_numbers")


def _stays(text: Column) -> Column:
    """What an edit leaves: the text without its last quarter, rounded down."""
    n = F.char_length(text)
    return F.substring(text, F.lit(1), n - F.floor(n / 4).cast("int"))


def _with_own_sums(rows: DataFrame) -> DataFrame:
    """Adds ``sums``: the whole units that an edit leaves, and ``at``, where they end; all units.

    Each unit is summed once, as the two parts of a text add up. Both are in one array, and read
    by ``element_at``, which is not pushed below a join: who reads one has the columns of both.
    """
    left = F.regexp_extract(_stays(F.col("text")), WHOLE_UNITS, 0)
    cut = _settled(rows, "left", left).withColumn("at", F.char_length("left"))
    cut = cut.withColumn("rest", F.expr("substring(text, at + 1)"))
    summed = with_sum(with_sum(cut, "left", "left_sum"), "rest", "rest_sum")
    both = F.array(
        F.struct("at", F.col("left_sum").alias("sum")),
        F.struct("at", combined(F.col("left_sum"), F.col("rest_sum")).alias("sum")),
    )
    return _settled(summed.drop("left", "rest"), "sums", both).select(*rows.columns, "sums")


def _followed(keys: DataFrame) -> DataFrame:
    """(id, code, n_chars, next_id, next_code): each document and the one after it.

    Ordered by range partitions: within one by a window, across them by their first rows.
    """
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        keys.repartitionByRange(partitions, "doc_id", "code").withColumn(
            "part", F.spark_partition_id()
        )
    )
    here = F.struct("doc_id", "id", "code")
    # One row a partition.
    firsts = ranged.groupBy("part").agg(F.min(here).alias("first"))
    following = F.lead("first").over(Window.orderBy("part"))
    firsts = firsts.select(
        "part", F.coalesce(following, F.min("first").over(Window.partitionBy())).alias("first")
    )
    after = F.lead(here).over(Window.partitionBy("part").orderBy("doc_id", "code"))
    return (
        ranged.withColumn("after", after)
        .join(firsts, "part")
        .withColumn("next", F.coalesce("after", "first"))
        .select(
            "id", "code", "n_chars",
            F.col("next.id").alias("next_id"), F.col("next.code").alias("next_code"),
        )
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter (of code points, rounded down) replaced by as many first
    code points of the next document, or all of them; after the last document comes the first.
    Null text counts as empty, its fingerprint as that of no units. Null doc_ids come first.
    Documents of one doc_id are ordered by a hash of their texts; rows equal in both are one
    document with several equal rows in the result. One document follows itself. Very long texts
    are one row's work, in proportion to their length. Empty table: no rows.
    """
    rows = pick(docs, doc_id="bigint", text="string").select(
        "doc_id",
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64(F.col("doc_id").isNull(), "text").alias("code"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    keys = rows.groupBy("doc_id", "id", "code").agg(
        F.max(F.char_length("text")).cast("bigint").alias("n_chars")
    )
    pairs = cut_lineage(_followed(keys))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = _with_own_sums(rows)
    # Texts and sums are dealt by (id, code) once; both joins read that exchange, so both read all
    # and neither is a broadcast join, before which every text would be summed once more.
    ahead = pairs.toDF("own_id", "own_code", "n_chars", "id", "code")
    heads = (
        rows.join(ahead.hint("merge"), ["id", "code"])
        .select(
            F.col("own_id").alias("id"), F.col("own_code").alias("code"), "n_chars",
            F.substring("text", F.lit(1), quarter).alias("head"),
            F.element_at("sums", 2)["sum"].alias("next_sum"), F.col("doc_id").alias("next_id"),
        )
        .groupBy("id", "code")
        .agg(F.min(F.struct("n_chars", "next_id", "head", "next_sum")).alias("next"))
    )
    joined = rows.join(heads.hint("merge"), ["id", "code"]).select(
        "doc_id", "next.n_chars", "next.next_sum",
        F.concat(_stays(F.col("text")), "next.head").alias("edited"),
        F.element_at("sums", 1)["at"].alias("at"), F.element_at("sums", 2)["sum"].alias("sum"), "sums",
    )
    # Of the edited text only what follows the whole units that stayed is summed anew.
    tail = joined.withColumn("tail", F.expr("substring(edited, at + 1)"))
    summed = with_sum(_settled(tail, "left_sum", F.element_at("sums", 1)["sum"]), "tail", "tail_sum")
    edited_sum = combined(F.col("left_sum"), F.col("tail_sum"))
    summed = _settled(summed, "edited_sum", edited_sum)
    return summed.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sum")).alias("fingerprint"),
        fingerprint(F.col("edited_sum")).alias("edited_fingerprint"),
        likeness(F.col("sum"), F.col("edited_sum")).alias("near_edited"),
        likeness(F.col("sum"), F.col("next_sum")).alias("near_next"),
    )
