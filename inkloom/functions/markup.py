"""Escaping, tags, scene breaks and text export of the sanitised markup."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.config import RULE_BREAK, SPACER_BREAK, ExtractConfig
from inkloom.functions.strings import trim_ws

# Markup escapes, ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"))
# Replacements of the simple renderer's markup.
SIMPLE_MARKUP = (
    ("<strong>", "<b>"),
    ("</strong>", "</b>"),
    ("<em>", "<i>"),
    ("</em>", "</i>"),
    ("<blockquote>", "<br><br>"),
    ("</blockquote>", "<br><br>"),
    (RULE_BREAK, "<br><br>"),
    ("<hr/>", "<br><br>"),
    ("</p>", "<br>"),
    ("<p>", ""),
)


def _replace_all(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def escape_html(text: Column) -> Column:
    return _replace_all(text, ESCAPES)


def escape_node_text(text: Column) -> Column:
    """Like :func:`escape_html`, for text taken from a parsed page (carriage return too)."""
    return _replace_all(text, (*ESCAPES, ("\r", "&#13;")))


def unescape_html(text: Column) -> Column:
    """Undo :func:`escape_node_text`, ampersand last."""
    pairs = [(b, a) for a, b in reversed((*ESCAPES, ("\r", "&#13;")))]
    return _replace_all(text, pairs)


def simplify_markup(html: Column) -> Column:
    return _replace_all(html, SIMPLE_MARKUP)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def gate_bytes(html: Column) -> Column:
    """Byte length the minimum-length gate looks at: tags gone, entities still escaped."""
    return F.octet_length(trim_ws(strip_tags(html)))


def passes_gate(html: Column, minimum: int) -> Column:
    return gate_bytes(html) >= F.lit(minimum)


def is_scene_break(text: Column, patterns: Sequence[str]) -> Column:
    """Non-blank text that matches any of the patterns."""
    # A dollar sign means the very end of the text here, not "before a last newline".
    exact = [p[:-1] + r"\z" if p.endswith("$") else p for p in patterns]
    return (trim_ws(text) != "") & text.rlike("|".join(f"(?:{p})" for p in exact))


def is_break_html(html: Column) -> Column:
    return html.isin(RULE_BREAK, SPACER_BREAK)


def scene_break_html(style: Column) -> Column:
    return (
        F.when(F.lower(style) == "spacer", F.lit(SPACER_BREAK))
        .when(F.lower(style) == "none", F.lit(""))
        .otherwise(F.lit(RULE_BREAK))
    )


def br_runs_to_break(html: Column, config: ExtractConfig) -> Column:
    """Runs of at least ``br_threshold`` line breaks become one scene break."""
    if config.br_threshold <= 1 or not config.break_html:
        return html
    # Possessive throughout: such a run is matched in a loop, however long it is.
    run = r"(?i)(?:<br[\t\n\f\r ]*+/?+>[\t\n\f\r ]*+){%d,}+" % config.br_threshold
    return F.regexp_replace(html, run, config.break_html)


def split_on_break(html: Column) -> Column:
    """Array of pieces with every scene break as its own element, no empty pieces."""
    # The mark is \u0001b; a \u0001 of the text itself waits as \u0001e.
    safe = F.replace(html, F.lit("\u0001"), F.lit("\u0001e"))
    marked = F.regexp_replace(
        safe, r'(<hr class="scene-break"[\t\n\f\r ]*+/>|<p class="spacer"></p>)', "\u0001b$1\u0001b"
    )
    pieces = F.filter(F.split(marked, "\u0001b"), lambda piece: piece != "")
    return F.transform(pieces, lambda piece: F.replace(piece, F.lit("\u0001e"), F.lit("\u0001")))


def dedupe_adjacent_breaks(blocks: Column) -> Column:
    """Drop a break that directly follows another break, whatever its style."""

    def keep(block: Column, at: Column) -> Column:
        previous = F.get(blocks, at - 1)
        return ~(is_break_html(block) & F.coalesce(is_break_html(previous), F.lit(False)))

    return F.filter(blocks, keep)


def html_to_text(html: Column) -> Column:
    """Plain text with layout for the sanitised markup.

    A block tag opens a line unless the last opening tag was a block tag too, and every
    closing block tag ends a line. Inline opening tags reset that memory; ``br`` and ``hr``
    give a line and leave it alone.
    """
    # Keep only the tags that matter: O = block open, C = block close, N = line, I = inline open;
    # E = a mark that the text itself holds.
    marked = F.replace(html, F.lit("\u0002"), F.lit("\u0002E"))
    marked = F.regexp_replace(marked, r"(?i)<(?:br|hr)\b[^>]*>", "\u0002N")
    marked = F.regexp_replace(marked, r"(?i)<(?:p|div|blockquote|li)(?:[\t\n\f\r /][^>]*)?>", "\u0002O")
    marked = F.regexp_replace(marked, r"(?i)</(?:p|div|blockquote|li)[\t\n\f\r ]*>", "\u0002C")
    marked = F.regexp_replace(marked, r"<[A-Za-z][^>]*>", "\u0002I")
    marked = F.regexp_replace(marked, r"</[^>]*>", "")
    # A block that opens after a block, with no close or inline tag between, gives no line.
    # Looking behind sees the unreplaced text, so one linear pass settles whole chains.
    nested = r"(?<=\u0002O)([^\u0002]*+(?:\u0002[NE][^\u0002]*+)*+)\u0002O"
    marked = F.regexp_replace(marked, nested, "$1\u0002P")
    plain = F.regexp_replace(marked, r"\u0002[NOC]", "\n")
    plain = F.regexp_replace(plain, r"\u0002[IP]", "")
    plain = F.replace(plain, F.lit("\u0002E"), F.lit("\u0002"))
    return F.rtrim(unescape_html(plain), F.lit("\n"))
