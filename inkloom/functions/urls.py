"""Resolving an href against the address of its page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.strings import bind, trim_ws

# Fixed value: the generic address pattern of RFC 3986, appendix B.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?"
# Characters a path or fragment may hold as they are, and the narrower set
# that stays unescaped once anything has to be escaped.
_VALID = r"^[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%#]*$"
_KEEP = r"^[A-Za-z0-9\-_.~$&+,/:;=@%#]$"


def _parsed(url: Column) -> Column:
    """Struct of scheme, host, path, query and fragment, the last two with their marks."""

    def part(group: int) -> Column:
        return F.regexp_extract(url, _PARTS, group)

    return F.struct(
        F.lower(part(1)).alias("scheme"),
        url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//").alias("rooted"),
        part(2).alias("host"),
        part(3).alias("path"),
        part(4).alias("query"),
        part(5).alias("fragment"),
    )


def _escaped(text: Column) -> Column:
    """Percent-encode what a path may not hold; text that is already valid stays."""
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
            lambda char: F.when(char.rlike(_KEEP), char)
            # url_encode leaves the star alone, which a re-escaped path does not.
            .when(char == "*", F.lit("%2A"))
            .otherwise(F.replace(F.url_encode(char), F.lit("+"), F.lit("%20"))),
        ),
        "",
    )
    return F.when(text.rlike(_VALID), text).otherwise(encoded)


def _without_dots(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments; a path that is not empty starts with a slash."""

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.array_append(kept, segment))
        )

    def folded(segments: Column) -> Column:
        ends_in_dots = F.element_at(segments, -1).isin(".", "..")
        return bind(
            F.aggregate(segments, F.array().cast("array<string>"), step),
            lambda kept: F.concat(
                F.lit("/"),
                F.array_join(kept, "/"),
                F.when(ends_in_dots & (F.size(kept) > 0), F.lit("/")).otherwise(""),
            ),
        )

    return bind(
        F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)),
        lambda rooted: F.when(
            rooted.rlike(r"/\.\.?(/|$)"), bind(F.split(F.substring(rooted, 2, 1 << 30), "/"), folded)
        ).otherwise(rooted),
    )


def _join(base: Column, ref: Column) -> Column:
    """Target of the parsed reference ``ref`` on the parsed page address ``base``."""
    fragment = F.when(F.length(ref["fragment"]) <= 1, F.lit("")).otherwise(_escaped(ref["fragment"]))
    scheme = F.concat(base["scheme"], F.lit(":"))
    site = F.concat(scheme, F.when(base["rooted"], F.lit("//")).otherwise(""), base["host"])
    folder = F.regexp_extract(base["path"], r"(?s)^(.*/)", 1)
    path, host = ref["path"], F.concat(F.lit("//"), ref["host"])
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    bare = (path == "") & (ref["query"] == "")
    front = (
        F.when((ref["scheme"] != "") & ref["rooted"], F.concat(ref["scheme"], F.lit(":"), host, _escaped(path)))
        .when(ref["scheme"] != "", F.concat(ref["scheme"], F.lit(":"), path))
        .when(ref["rooted"], F.concat(scheme, host, _escaped(_without_dots(path))))
        .when(path == "", F.concat(site, _escaped(base["path"])))
        .otherwise(F.concat(site, _escaped(_without_dots(merged))))
    )
    own = (ref["scheme"] != "") | ref["rooted"]
    return F.concat(
        front,
        F.when(bare & ~own, base["query"]).otherwise(ref["query"]),
        F.when(bare & ~own & (fragment == ""), base["fragment"]).otherwise(fragment),
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute address of ``href`` on page ``base``; empty when there is nothing to follow."""
    bad_signs = (
        r"^$|[\x00-\x1f\x7f]|%(?![0-9A-Fa-f]{2})|^:"
        # A colon in the first segment of a relative address makes it unreadable.
        r"|^(?![A-Za-z][A-Za-z0-9+.-]*:)[^/?#]*:"
    )

    def target(ref: Column) -> Column:
        return F.when(ref.isNull() | ref.rlike(bad_signs), F.lit("")).otherwise(
            bind(_parsed(base), lambda b: bind(_parsed(ref), lambda r: _join(b, r)))
        )

    return bind(trim_ws(href), target)
