"""Sentence segments, hard wrapping and size-bounded chunks, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.strings import bind, trim_ws

# A segment is at least one character and ends after closing punctuation and
# white space, at a blank line or at the very end of the text. Characters that cannot start an
# end are skipped in one go, which keeps the search linear without a step per character.
_END = r"[.!?]++[\"')\]]*+[\t\n\f\r ]+|\n{2,}"
_SKIP = r"[^.!?\n]*+"
SEGMENT = rf"(?s).{_SKIP}(?:(?!{_END}).{_SKIP})*+(?:{_END}|\z)"

MAX_CHARS = 1800
STRICT_FLOOR = 400
# A place that ends a segment whatever stands around it: closing punctuation after something that
# can neither end nor begin a segment by itself, white space, and more text.
SAFE_CUT = r"[^\t\n\f\r \x0B.!?][.!?]+[\"')\]]*[\t\n\f\r ]+(?=[^\t\n\f\r \x0B])"
# Pieces folded at a time. A fold copies what it has built at every step, so it builds piece
# numbers rather than text and does so slab by slab, which stays fast for very long texts.
SLAB = 256


def normalise_text(text: Column) -> Column:
    """Line ends as ``\\n``, other white-space runs as one space."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(unix, r"[ \t\f\x0B]{2,}|[\t\f\x0B]", " ")


def _segments(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(SEGMENT), F.lit(0))


def sentence_split(text: Column) -> Column:
    """Array of segments; joined together they are the normalised text."""
    return _segments(normalise_text(text))


def hard_wrap(sentence: Column, limit: int) -> Column:
    """Pieces of an over-long sentence, cut at the last white space within ``limit``.

    All but the last piece end in a newline. The first piece keeps its leading white space
    for the measure, later ones start after the white space at the cut.
    """
    pattern = (
        r"(?s)(?:\A|[\t\n\f\r ]*)"
        r"(.{1,%d}[\t\n\f\r ]*\z|.{1,%d}(?=[ \n\t])|.{%d})" % (limit, limit, limit)
    )
    cut = F.transform(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(1)), trim_ws)
    wrapped = bind(
        F.filter(cut, lambda piece, at: (at == 0) | (piece != "")),
        lambda kept: F.transform(
            kept,
            lambda piece, at: F.when(
                (at == 0) | (at < F.size(kept) - 1), F.concat(piece, F.lit("\n"))
            ).otherwise(piece),
        ),
    )
    return F.when(F.length(sentence) > limit, wrapped).otherwise(
        F.filter(F.array(sentence), lambda piece: piece != "")
    )


def _strict_wrap(sentence: Column, limit: int) -> Column:
    """Pieces for the strict rule: cut at spaces only, every piece but the rest stands alone."""
    pattern = r"(?s)(?:\A|[\t\n\f\r ]*)(.{1,%d}\z|.{1,%d}(?= )|.{%d})" % (limit, limit - 1, limit)
    return F.regexp_extract_all(sentence, F.lit(pattern), F.lit(1))


def _piece(text: Column, fresh: Column) -> Column:
    """A piece, its length and whether it must start a new chunk."""
    return F.struct(text.alias("text"), F.length(text).alias("size"), fresh.alias("fresh"))


def _as_pieces(sentence: Column, limit: int, strict: bool) -> Column:
    if strict:
        # A blank tail still closes the piece before it.
        pieces = F.transform(
            _strict_wrap(sentence, limit),
            lambda piece, at: _piece(
                F.when((at > 0) & (trim_ws(piece) == ""), F.lit("")).otherwise(piece), F.lit(True)
            ),
        )
    else:
        pieces = F.transform(
            hard_wrap(sentence, limit), lambda piece, at: _piece(piece, at == 0)
        )
    whole = F.array(_piece(sentence, F.lit(False)))
    return F.when(F.length(sentence) > limit, pieces).otherwise(whole)


def _chunk_starts(pieces: Column, limit: int) -> Column:
    """Numbers of the pieces that begin a chunk, found by filling chunks greedily."""
    none = F.array().cast("array<int>")

    def state(starts: Column, size: Column, at: Column) -> Column:
        return F.struct(starts.alias("starts"), size.alias("size"), at.alias("at"))

    def step(acc: Column, piece: Column) -> Column:
        full = (acc["size"] + piece["size"] > limit) | piece["fresh"]
        flush = full & (acc["size"] > 0)
        return state(
            F.when(flush, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]),
            F.when(flush, piece["size"]).otherwise(acc["size"] + piece["size"]),
            acc["at"] + 1,
        )

    def slab_step(acc: Column, slab: Column) -> Column:
        folded = F.aggregate(slab, state(none, acc["size"], acc["at"]), step)
        return bind(
            folded, lambda new: state(F.concat(acc["starts"], new["starts"]), new["size"], new["at"])
        )

    slabs = F.transform(
        F.sequence(F.lit(1), F.size(pieces), F.lit(SLAB)), lambda i: F.slice(pieces, i, SLAB)
    )
    first = state(F.array(F.lit(0)), F.lit(0), F.lit(0))
    return F.aggregate(slabs, first, slab_step, lambda acc: acc["starts"])


def _joined(pieces: Column, starts: Column) -> Column:
    """Chunk texts: the pieces from each start up to the next."""

    def assemble(texts: Column, begins: Column) -> Column:
        def one(begin: Column, k: Column) -> Column:
            end = F.coalesce(F.get(begins, k + 1), F.size(texts))
            return trim_ws(F.array_join(F.slice(texts, begin + 1, end - begin), ""))

        return F.transform(begins, one)

    return bind(pieces["text"], lambda texts: bind(starts, lambda begins: assemble(texts, begins)))


def chunk_limit(limit: int, *, strict: bool = False, floor: int = 0) -> int:
    """The limit in force: zero or less means the default, and one under a floor the floor."""
    limit = max(floor, limit if limit > 0 else MAX_CHARS)
    return max(STRICT_FLOOR, limit) if strict else limit


def text_pieces(normal: Column, limit: int, *, strict: bool = False) -> Column:
    """Array of (text, size, fresh): the sentences of a normalised text, over-long ones cut.

    A ``fresh`` piece begins a chunk even where it would fit into the one before it.
    """

    def pieces(sentences: Column) -> Column:
        # Sentences that need cutting are rare: look for one before taking the long way.
        return F.when(
            F.exists(sentences, lambda s: F.length(s) > limit),
            F.flatten(F.transform(sentences, lambda s: _as_pieces(s, limit, strict))),
        ).otherwise(F.transform(sentences, lambda s: _piece(s, F.lit(False))))

    return bind(_segments(normal), pieces)


def chunk_text(
    text: Column, limit: int = MAX_CHARS, *, strict: bool = False, floor: int = 0
) -> Column:
    """Array of chunks of at most ``limit`` characters, filled greedily with sentences.

    A limit of zero or less means the default, and one under ``floor`` the floor.

    ``strict`` is the second rule set: a floor of 400 characters and wrapped pieces that are
    never joined with what follows.
    """
    limit = chunk_limit(limit, strict=strict, floor=floor)
    normal = normalise_text(text)
    packed = bind(
        text_pieces(normal, limit, strict=strict), lambda p: _joined(p, _chunk_starts(p, limit))
    )
    # Most texts fit into one chunk and need neither the segments nor the fold.
    chunks = F.when(F.length(normal) <= limit, F.array(trim_ws(normal))).otherwise(packed)
    return F.filter(chunks, lambda chunk: chunk != "")
