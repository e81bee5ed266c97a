"""White space, labels, slugs and names."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space when text is trimmed.
UNICODE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Arrow and chevron glyphs dropped from link labels.
NAV_GLYPHS = "«»←→›▶►"

# Runs that are not already one plain space: text is mostly single spaces, and not matching
# those is what makes collapsing cheap.
_RUNS = f"[{UNICODE_SPACE}]{{2,}}|[{UNICODE_SPACE.replace(' ', '')}]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(text: Column) -> Column:
    """Cut Unicode white space at both ends."""
    return F.btrim(text, F.lit(UNICODE_SPACE))


def collapse_ws(text: Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\t\n\f\r ]{2,}|[\t\n\f\r]", " ")


def words_joined(text: Column) -> Column:
    """Words separated by single spaces, nothing at the ends."""
    return F.btrim(F.regexp_replace(text, _RUNS, " "))


def none_if_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def nav_label(text: Column) -> Column:
    """Link label for comparison; the cut comes before the glyphs go, so a gap may stay."""
    plain = F.translate(trim_ws(text), NAV_GLYPHS, "")
    return collapse_ws(F.lower(plain))


def _accent_table() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is an ASCII letter plus marks."""
    composed, base = [], []
    for code in range(0xC0, 0x2100):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if (
            len(parts) > 1
            and "a" <= parts[0] <= "z"
            and all(unicodedata.category(mark) == "Mn" for mark in parts[1:])
        ):
            composed.append(char)
            base.append(parts[0])
    return "".join(composed), "".join(base)


_ACCENTED, _PLAIN = _accent_table()
SLUG_LENGTH = 64


def slugify(text: Column) -> Column:
    """ASCII slug of at most 64 characters; the cut may leave a hyphen at the end."""
    folded = F.translate(F.lower(trim_ws(text)), _ACCENTED, _PLAIN)
    unmarked = F.regexp_replace(folded, r"\p{Mn}+", "")
    hyphened = F.btrim(F.regexp_replace(unmarked, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.substring(hyphened, 1, SLUG_LENGTH)


def slugify_unicode(text: Column, default: str = "audiofile") -> Column:
    """Slug that keeps letters and digits of every script."""
    hyphened = F.regexp_replace(F.lower(trim_ws(text)), r"(?U)[^\w\s-]+", "-")
    joined = F.btrim(F.regexp_replace(hyphened, r"(?U)[\s_]+", "-"), F.lit("-"))
    return F.substring(F.coalesce(none_if_blank(joined), F.lit(default)), 1, SLUG_LENGTH)


def chapter_slug(code: Column, title: Column) -> Column:
    return F.coalesce(
        none_if_blank(slugify(code)), none_if_blank(slugify(title)), F.lit("chapter")
    )


def safe_name(text: Column) -> Column:
    """File-name form of a chapter code."""
    # Three characters become hyphens, the others are dropped.
    return F.translate(F.lower(trim_ws(text)), '— /:|?*"<>', "---")


def base_name(path: Column, given: Column | None = None) -> Column:
    """Output base of an input file: the slug of ``given`` or of the file stem."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    source = stem if given is None else F.coalesce(none_if_blank(trim_ws(given)), stem)
    return F.coalesce(none_if_blank(slugify(source)), F.lit("audiofile"))


def clean_tag_list(text: Column, allowed: Sequence[str]) -> Column:
    """Comma list to ordered distinct allowed tags; anything unknown is dropped."""
    tags = F.transform(F.split(text, ","), lambda tag: F.lower(trim_ws(tag)))
    return F.array_distinct(F.filter(tags, lambda tag: tag.isin(*allowed)))


def chapter_code(title: Column) -> Column:
    """The ``1.02 B`` style code in a title, or the title itself."""
    # (?<![0-9A-Za-z_]) and its twin are the ASCII word boundary.
    found = F.regexp_extract(
        title,
        r"(?<![0-9A-Za-z_])([0-9]+\.[0-9]+[\t\n\f\r ]*[A-Z]?)"
        r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))",
        1,
    )
    return F.coalesce(none_if_blank(trim_ws(collapse_ws(found))), title)
