"""Events to chapters: title, content root, blocks, gate and next link on one row per page.

No step here shuffles. Stages are separated by :func:`settle`, so every array is built
once, however often later stages refer to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.config import DEFAULT, FALLBACK_ROOT, UNTITLED, ExtractConfig, Settings, SitePresets
from inkloom.functions import markup
from inkloom.functions.strings import chapter_code, nav_label, none_if_blank, trim_ws, words_joined
from inkloom.operators.events import CLOSE, OPEN, TEXT, page_events
from inkloom.operators.selectors import attributes_used, first_match, first_of, matching

KEYS = ("page_id", "url")
BLOCK_TAGS = ("p", "li", "blockquote", "hr")
# Fixed value: labels that make a link a page-to-page link whatever the settings.
NAV_LABEL = r"^(?:prev(?:ious)?|next)(?:\s+(?:chapter|page))?\z"

# The reasons of rejected pages.
TOO_SHORT = "chapter too short"
NO_CONTENT = "content node not found"


def settle(frame: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """``keep`` plus ``columns``, computed once.

    A one-row generator: filters are not pushed through it and its output is not inlined
    into later projections, both of which would run the same array work twice.
    """
    named = [column.alias(name) for name, column in columns.items()]
    return frame.select(*keep, F.inline(F.array(F.struct(*named))))


def inside_text(texts: Column, place: Column) -> Column:
    """Joined entries of ``texts`` strictly inside an element."""
    count = F.greatest(place["end"] - place["i"] - 1, F.lit(0))
    return F.array_join(F.slice(texts, place["i"] + 2, count), "")


def kept_attributes(config: Settings) -> list[str]:
    used = {"href", "rel", "property", "content"}
    for own in config.configs():
        for selector in (*own.selectors, FALLBACK_ROOT):
            used |= attributes_used(selector)
    return sorted(used)


def page_title(opens: Column, events: Column) -> Column:
    """First ``h1`` anywhere on the page, else the ``og:title`` entry, else a fixed text."""
    heading = F.get(F.filter(opens, lambda e: e["tag"] == "h1"), F.lit(0))
    meta = F.get(matching(opens, 'meta[property="og:title"]'), F.lit(0))
    return F.coalesce(
        none_if_blank(trim_ws(inside_text(events["text"], heading))),
        none_if_blank(trim_ws(meta["attrs"]["content"])),
        F.lit(UNTITLED),
    )


def content_root(opens: Column, config: Settings = DEFAULT) -> Column:
    """Place of the content root: configured selectors in order, then the usual fallbacks."""
    return config.choose(
        ("selectors",), lambda own: first_of(opens, [*own.selectors, FALLBACK_ROOT, "body"])
    )


def is_gone(event: Column, root: Column) -> Column:
    """Inside an unwanted subtree below the root (the root itself always stays)."""
    below = (event["i"] > root["i"]) & (event["i"] < root["end"])
    return below & (event["noise"] > root["i"])


def _inline_piece(event: Column, root: Column) -> Column:
    tag = event["tag"]
    opened = (
        F.when(tag.isin("em", "i"), F.lit("<i>"))
        .when(tag.isin("strong", "b"), F.lit("<b>"))
        .when(tag == "u", F.lit("<u>"))
        .when(tag == "br", F.lit("<br/>"))
        .when(
            tag == "a",
            F.concat(
                F.lit('<a href="'),
                markup.escape_node_text(F.coalesce(event["attrs"]["href"], F.lit(""))),
                F.lit('">'),
            ),
        )
        .otherwise("")
    )
    closed = (
        F.when(tag.isin("em", "i"), F.lit("</i>"))
        .when(tag.isin("strong", "b"), F.lit("</b>"))
        .when(tag == "u", F.lit("</u>"))
        .when(tag == "a", F.lit("</a>"))
        .otherwise("")
    )
    return (
        F.when(is_gone(event, root), F.lit(""))
        .when(event["kind"] == TEXT, markup.escape_node_text(event["text"]))
        .when(event["kind"] == OPEN, opened)
        .otherwise(closed)
    )


def is_nav_label(label: Column, config: Settings = DEFAULT) -> Column:
    """Label (already normalised) of a page-to-page link."""

    def known(own: ExtractConfig) -> Column:
        return label.isin(*[nav_label(F.lit(text)) for text in (*own.next_texts, *own.prev_texts)])

    return label.rlike(NAV_LABEL) | config.choose(("next_texts", "prev_texts"), known)


def _only_nav(block: Column, links: Column, loose: Column) -> Column:
    """Whether a block holds nothing but page-to-page links.

    ``links`` and ``loose`` have an entry per event, so what is inside is a slice: all blocks of a
    page take time in proportion to its size.
    """
    start, length = block["i"] + 2, F.greatest(block["end"] - block["i"] - 1, F.lit(0))
    within = F.slice(links, start, length)
    return (
        block["tag"].isin("p", "li")
        & F.exists(within, lambda nav: nav.isNotNull())
        & F.forall(within, lambda nav: F.coalesce(nav, F.lit(True)))
        & F.forall(
            F.slice(loose, start, length),
            lambda t: t["text"].isNull()
            | (t["anchor"] > block["i"])
            | (trim_ws(t["text"]) == ""),
        )
    )


def wrap_block(tag: Column, inner: Column, config: ExtractConfig) -> Column:
    """Inline markup of one block as an array of blocks, split at scene breaks."""

    def wrapped(text: Column) -> Column:
        return F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">"))

    def one(piece: Column) -> Column:
        return F.when(
            markup.is_break_html(piece) | (trim_ws(piece) == ""), trim_ws(piece)
        ).otherwise(wrapped(trim_ws(piece)))

    pieces = markup.split_on_break(markup.br_runs_to_break(inner, config))
    split = F.filter(F.transform(pieces, one), lambda html: html != "")
    # Most blocks hold no run of line breaks and need no splitting.
    lower = F.lower(inner)
    fewer = F.substring_index(lower, "<br", config.br_threshold) == lower
    if config.br_threshold <= 1 or not config.break_html:
        fewer = F.lit(True)
    plain = F.filter(F.array(trim_ws(inner)), lambda text: text != "")
    return F.when(fewer, F.transform(plain, wrapped)).otherwise(split)


def _block_html(block: Column, config: Settings) -> Column:
    """Blocks of one candidate ``(tag, skip, words, inner)``."""
    none = F.array().cast("array<string>")
    scene_break = config.choose(
        ("break_html",), lambda own: F.array(F.lit(own.break_html)) if own.break_html else none
    )
    in_words = config.choose(
        ("scene_break_patterns",), lambda own: markup.is_scene_break(block["words"], own.scene_break_patterns)
    )
    tag = F.when(block["tag"] == "blockquote", F.lit("blockquote")).otherwise(F.lit("p"))
    return (
        F.when(block["skip"], none)
        .when(
            (block["tag"] == "hr") | in_words,
            scene_break,
        )
        .otherwise(
            config.choose(
                ("break_html", "br_threshold"), lambda own: wrap_block(tag, block["inner"], own)
            )
        )
    )


def next_href(opens: Column, live: Column, root: Column, config: Settings = DEFAULT) -> Column:
    """Target of the next link: ``link[rel*=next]``, exact label, then any label with "next"."""
    href = lambda event: none_if_blank(event["attrs"]["href"])
    here = lambda event: ~F.coalesce(is_gone(event, root), F.lit(False))
    links = F.filter(
        opens,
        lambda e: (e["tag"] == "link") & F.contains(e["attrs"]["rel"], F.lit("next")) & here(e),
    )
    labels = F.transform(
        F.filter(opens, lambda e: (e["tag"] == "a") & here(e)),
        lambda e: F.struct(trim_ws(inside_text(live, e)).alias("label"), href(e).alias("href")),
    )
    exact = F.filter(
        labels,
        lambda a: config.choose(("next_texts",), lambda own: a["label"].isin(*own.next_texts))
        & a["href"].isNotNull(),
    )
    fuzzy = F.filter(labels, lambda a: a["label"].rlike("(?i)next"))
    first = F.lit(0)
    return F.coalesce(
        href(F.get(links, first)), F.get(exact, first)["href"], F.get(fuzzy, first)["href"]
    )


def rooted_events(events: DataFrame, config: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """Adds ``opens`` (open events only) and the content root's place."""
    opened = settle(events, [*keys, "events"], opens=F.filter("events", lambda e: e["kind"] == OPEN))
    return settle(
        opened,
        [*keys, "events", "opens"],
        root=content_root(F.col("opens"), config),
        title=page_title(F.col("opens"), F.col("events")),
    )


def live_events(rooted: DataFrame, keys=KEYS) -> DataFrame:
    """Adds ``live``: text per event, null where there is none or it was dropped as noise."""
    root = F.col("root")
    live = F.transform("events", lambda e: F.when(~is_gone(e, root), e["text"]))
    return settle(rooted, [*keys, "events", "opens", "root", "title"], live=live)


def page_candidates(events: DataFrame, config: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """Every block element of the content root in order: tag, skip flag, text, inline markup."""
    root, opens, live = F.col("root"), F.col("opens"), F.col("live")

    def is_nav(anchor: Column) -> Column:
        label = nav_label(inside_text(live, anchor))
        label = config.choose(
            ("trim_nav_labels",), lambda own: trim_ws(label) if own.trim_nav_labels else label
        )
        return is_nav_label(label, config)

    def in_root(event: Column) -> Column:
        return (
            (event["i"] > root["i"]) & (event["i"] < root["end"]) & (event["noise"] <= root["i"])
        )

    ready = settle(
        live_events(rooted_events(events, config, keys), keys),
        [*keys, "opens", "root", "title", "live"],
        inline=F.transform("events", lambda e: _inline_piece(e, root)),
        loose=F.arrays_zip(live.alias("text"), F.col("events")["anchor"].alias("anchor")),
        # Null where no link opens.
        links=F.transform(
            "events",
            lambda e: F.when((e["kind"] == OPEN) & (e["tag"] == "a") & in_root(e), is_nav(e)),
        ),
        found=F.filter(opens, lambda e: e["tag"].isin(*BLOCK_TAGS) & in_root(e)),
    )
    outer = F.filter(
        "found", lambda b: ~F.exists("found", lambda o: (o["i"] < b["i"]) & (o["end"] > b["end"]))
    )
    found = config.choose(("dedupe_nested",), lambda own: outer if own.dedupe_nested else F.col("found"))

    def candidate(block: Column) -> Column:
        return F.struct(
            block["tag"].alias("tag"),
            _only_nav(block, F.col("links"), F.col("loose")).alias("skip"),
            words_joined(inside_text(live, block)).alias("words"),
            inside_text(F.col("inline"), block).alias("inner"),
        )

    return settle(
        ready,
        [*keys, "root", "title"],
        candidates=F.coalesce(
            F.transform(found, candidate),
            F.array().cast("array<struct<tag:string,skip:boolean,words:string,inner:string>>"),
        ),
        next_href=next_href(opens, live, root, config),
    )


def page_blocks(events: DataFrame, config: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """Title, ordered block array and next link of every page."""
    raw = settle(
        page_candidates(events, config, keys),
        [*keys, "root", "title", "next_href"],
        raw_blocks=F.flatten(F.transform("candidates", lambda b: _block_html(b, config))),
    )
    return settle(
        raw,
        [*keys, "root", "title", "next_href"],
        blocks=markup.dedupe_adjacent_breaks(F.col("raw_blocks")),
    )


def judged_pages(
    pages: DataFrame, config: Settings = DEFAULT, keys=KEYS, *, strict: bool = False
) -> DataFrame:
    """Every page with its chapter fields and ``reject_reason`` (null for a good chapter).

    Pages of an error status are told by it alone: nothing of them is parsed, and their chapter
    fields are those of an empty page. ``strict`` fails the job on the first bad page instead.
    """
    has_status = "status" in pages.columns
    passed = [*keys, "status"] if has_status else list(keys)
    status = F.col("status") if has_status else F.lit(None).cast("int")
    if has_status:
        pages = pages.withColumn("html", F.when(status >= 400, F.lit("")).otherwise(F.col("html")))
    if isinstance(config, SitePresets):
        passed.append(config.column)
    events = page_events(pages, passed, keep_attrs=kept_attributes(config))
    blocks = page_blocks(events, config, passed)
    joined = settle(
        blocks,
        [*passed, "root", "title", "next_href"],
        html=F.array_join("blocks", "\n"),
    )
    reason = (
        F.when(status >= 400, F.concat(F.lit("http status "), status.cast("string")))
        .when(F.col("root").isNull(), F.lit(NO_CONTENT))
        .when(
            ~config.choose(("min_text_len",), lambda own: markup.passes_gate(F.col("html"), own.min_text_len)),
            F.lit(TOO_SHORT),
        )
    )
    if strict:
        reason = F.when(
            reason.isNotNull(), F.raise_error(F.concat(F.col("url"), F.lit(": "), reason))
        ).cast("string")
    return settle(
        joined,
        [*keys, "title", "html", "next_href"],
        code=chapter_code(F.col("title")),
        reject_reason=reason,
    )


def chapters(pages: DataFrame, config: Settings = DEFAULT, keys=KEYS, **options) -> DataFrame:
    """Good chapters: ``keys``, title, code, html and the unresolved next link."""
    return (
        judged_pages(pages, config, keys, **options)
        .filter(F.col("reject_reason").isNull())
        .select(*keys, "title", "code", "html", "next_href")
    )


def rejects(pages: DataFrame, config: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """Pages that give no chapter, with the reason."""
    return (
        judged_pages(pages, config, keys)
        .filter(F.col("reject_reason").isNotNull())
        .select(*keys, "reject_reason")
    )
