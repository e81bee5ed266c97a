"""Link chains: page edges, dangling links and ordered walks from many start pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.strings import none_if_blank
from inkloom.functions.urls import resolve_url
from inkloom.operators.extract import settle
from inkloom.operators.keyed import lookup_join
from inkloom.session import cut_lineage


def page_edges(pages: DataFrame, href: str = "next_href") -> DataFrame:
    """``url`` and the absolute ``next_url``, null at the end of a chain."""
    target = none_if_blank(resolve_url(F.col("url"), F.col(href)))
    return settle(pages, ["url"], next_url=target)


def latest_captures(captures: DataFrame, *columns: str) -> DataFrame:
    """One row per ``url``: the capture of the largest ``page_id``, with the named columns.

    A table of captures may hold a page many times, a walk may not. Read it thin: only the
    columns named here are grouped.
    """
    latest = F.max_by(F.struct("page_id", *columns), F.col("page_id")).alias("_latest")
    return captures.groupBy("url").agg(latest).select("url", "_latest.*")


def next_edges(edges: DataFrame, **tuning) -> DataFrame:
    """Every edge with ``target_found``: whether the next page exists (null without a link)."""
    edges = cut_lineage(edges.select("url", "next_url"))
    known = edges.select(F.col("url").alias("next_url"), F.lit(True).alias("_known"))
    joined = lookup_join(edges, known, "next_url", spread=["url"], **tuning)
    found = F.when(F.col("next_url").isNotNull(), F.col("_known").isNotNull())
    return joined.select("url", "next_url", found.alias("target_found"))


def next_pages(edges: DataFrame, pages: DataFrame, *columns: str, **tuning) -> DataFrame:
    """Every edge with ``columns`` of the page that it leads to, named ``next_...``.

    ``pages`` has a row for each ``url`` (see :func:`latest_captures`); null without a link, and
    where the next page is not there.
    """
    targets = pages.select(
        F.col("url").alias("next_url"), *[F.col(name).alias(f"next_{name}") for name in columns]
    )
    joined = lookup_join(edges.select("url", "next_url"), targets, "next_url", spread=["url"], **tuning)
    return joined.select("url", "next_url", *[f"next_{name}" for name in columns])


def dangling_next(edges: DataFrame, **tuning) -> DataFrame:
    """Edges whose target is not among the pages."""
    # Both sides and the search for hot targets read the edges: they are made once.
    edges = cut_lineage(edges.select("url", "next_url"))
    linked = edges.filter(F.col("next_url").isNotNull())
    # Each missing target is looked for once, however many pages point at it.
    targets = linked.select("next_url").distinct()
    missing = targets.join(
        edges.select(F.col("url").alias("next_url")), "next_url", "left_anti"
    ).withColumn("_missing", F.lit(True))
    return lookup_join(
        linked, missing, "next_url", spread=["url"], how="inner", **tuning
    ).select("url", "next_url")


def page_chains(edges: DataFrame, **tuning) -> tuple[DataFrame, DataFrame]:
    """All pages as disjoint chains and loops, and where each chain goes on.

    ``edges`` holds the pages with their ``next_url`` or null; of rows that repeat a ``url`` the
    one with the largest ``next_url`` counts. Gives ``(url, head, rank)``, a row for every page,
    ranks counted from 0, and ``(head, length, to_head, to_rank, loop)``, a row for every chain:
    the place that its last page links to, null at an end or a link to no page. ``loop``: that is
    its own beginning, which is the loop's least url. Every loop of pages is a chain of its own, so
    no other chain comes back to where it was. Both tables together are linear in the pages,
    however many walks share them.

    Of the pages that link to one page the least by url is its predecessor, unless another one is
    on a loop with it: loops that leave a chain and come back show among the chains, which are
    few, and their pages are ranked again with the predecessors of the loop.
    """
    pages = cut_lineage(
        edges.filter(F.col("url").isNotNull()).groupBy("url").agg(F.max("next_url").alias("next_url"))
    )
    # Chains are fewer than pages, which tells whether hot keys are possible at all.
    rows = pages.count()
    known = pages.select(F.col("url").alias("next_url"), F.lit(True).alias("_known"))
    links = cut_lineage(
        lookup_join(
            pages.filter(F.col("next_url").isNotNull()), known, "next_url", spread=["url"], how="inner",
            left_rows=rows, **tuning,
        ).select("url", "next_url")
    )
    heirs = links.groupBy(F.col("next_url").alias("url")).agg(F.min("url").alias("back"))
    chains = _ranked(pages, heirs)
    ends = _ends(chains, links, left_rows=rows, **tuning)
    looped = _on_loops(ends, **tuning)
    if looped is not None:
        again = ends.join(looped, "head").select(
            F.col("next_url").alias("url"), F.col("last_url").alias("_back")
        )
        heirs = heirs.join(again, "url", "left").select("url", F.coalesce("_back", "back").alias("back"))
        chains = _ranked(pages, cut_lineage(heirs))
        ends = _ends(chains, links, left_rows=rows, **tuning)
    return chains, ends.select("head", "length", "to_head", "to_rank", "loop")


def _ranked(pages: DataFrame, heirs: DataFrame) -> DataFrame:
    """(url, head, rank) by pointer jumping over each page's one predecessor.

    A round doubles how far back a page looks, so there are as many as the longest chain has
    binary digits. Both sides of the joins have a url once, and a page that sees its head drops
    out. As long as there are chains left, some of their pages drop out each round; when none
    does, the rest are loops, and they have been seen whole when a page has looked back further
    than there are pages left.
    """
    # A page looks `steps` pages back, to `back`, or to its head where that is null; `least` is
    # the least url on the way without `back`, first met `least_at` pages back.
    zero = F.lit(0).cast("bigint")
    state = cut_lineage(
        pages.select("url").join(heirs, "url", "left").select(
            "url", "back", F.when(F.col("back").isNull(), zero).otherwise(F.lit(1)).alias("steps"),
            F.col("url").alias("head"), F.col("url").alias("least"), zero.alias("least_at"),
        )
    )
    done = [state.filter(F.col("back").isNull()).select("url", "head", F.col("steps").alias("rank"))]
    active, span = state.filter(F.col("back").isNotNull()), 1
    left = active.count()
    while left:
        ahead = state.select(
            F.col("url").alias("back"), F.col("back").alias("_back"), F.col("steps").alias("_steps"),
            F.col("head").alias("_head"), F.col("least").alias("_least"), F.col("least_at").alias("_at"),
        )
        sooner = F.col("_least") < F.col("least")
        moved = cut_lineage(
            active.join(ahead, "back").select(
                "url", F.col("_back").alias("back"), (F.col("steps") + F.col("_steps")).alias("steps"),
                F.col("_head").alias("head"), F.least("least", "_least").alias("least"),
                F.when(sooner, F.col("steps") + F.col("_at")).otherwise(F.col("least_at")).alias("least_at"),
            )
        )
        done.append(moved.filter(F.col("back").isNull()).select("url", "head", F.col("steps").alias("rank")))
        active, span, before = moved.filter(F.col("back").isNotNull()), span * 2, left
        left = active.count()
        if left == before and span >= left:
            break
        # The next round looks up pages that are done or still on their way.
        finished = reduce(DataFrame.unionByName, done).select(
            "url", F.lit(None).cast("string").alias("back"), F.col("rank").alias("steps"), "head",
            F.col("url").alias("least"), zero.alias("least_at"),
        )
        state = active.unionByName(finished)
    loops = active.select("url", F.col("least").alias("head"), F.col("least_at").alias("rank"))
    return cut_lineage(reduce(DataFrame.unionByName, [*done, loops]))


def _ends(chains: DataFrame, links: DataFrame, **tuning) -> DataFrame:
    """Length and last page of each chain, and the place of the page that it links to."""
    last = chains.groupBy("head").agg(F.max(F.struct("rank", "url")).alias("last"))
    targets = last.select(
        "head", (F.col("last.rank") + 1).alias("length"), F.col("last.url").alias("url")
    ).join(links, "url", "left")
    places = chains.toDF("next_url", "to_head", "to_rank")
    own = (F.col("to_head") == F.col("head")) & (F.col("to_rank") == 0)
    return cut_lineage(
        lookup_join(targets, places, "next_url", spread=["head"], **tuning).select(
            "head", "length", F.col("url").alias("last_url"), "next_url", "to_head", "to_rank",
            F.coalesce(own, F.lit(False)).alias("loop"),
        )
    )


def _on_loops(ends: DataFrame, **tuning) -> DataFrame | None:
    """Heads of the chains that lie on a loop without being one, None if there are none.

    Where as many steps as there are chains lead is on a loop; steps double each round, and
    chains that reach an end drop out.
    """
    step = ends.filter(F.col("to_head").isNotNull() & ~F.col("loop")).select("head", F.col("to_head").alias("at"))
    count = rows = step.count()
    span = 1
    while rows and span <= count:
        ahead = step.select(F.col("head").alias("at"), F.col("at").alias("_at"))
        moved = lookup_join(step, ahead, "at", spread=["head"], how="inner", left_rows=rows, **tuning)
        step = cut_lineage(moved.select("head", F.col("_at").alias("at")))
        rows, span = step.count(), span * 2
    return step.select(F.col("at").alias("head")).distinct() if rows else None


def walk_slices(
    chains: DataFrame, ends: DataFrame, starts: DataFrame, max_pages: int, *, stop_on_cycle: bool = False, **tuning
) -> DataFrame:
    """Walks as slices of chains: ``(start_url, seq, head, rank, pages, length)``.

    Page ``seq`` + k of the walk is the one of rank (``rank`` + k) mod ``length`` in the chain of
    ``head``, for k below ``pages``. A walk has a slice for each chain that it passes, and one for
    a loop however often it goes round.
    """
    limit = max(1, max_pages)
    first = starts.select(F.col("start_url").alias("url")).distinct()
    at = cut_lineage(
        first.join(chains, "url").select(
            F.col("url").alias("start_url"), F.lit(0).cast("bigint").alias("seq"), "head", "rank"
        )
    )
    slices, rows = [], at.count()
    while rows or not slices:
        known = lookup_join(
            at, ends, "head", spread=["start_url", "seq"], how="inner", left_rows=rows, **tuning
        )
        rest = F.lit(limit) - F.col("seq")
        round_ = F.col("length") if stop_on_cycle else rest
        pages = F.least(rest, F.when(F.col("loop"), round_).otherwise(F.col("length") - F.col("rank")))
        cut = cut_lineage(known.select("*", pages.cast("bigint").alias("pages")))
        slices.append(cut.select("start_url", "seq", "head", "rank", "pages", "length"))
        at = cut.filter(
            F.col("to_head").isNotNull() & ~F.col("loop") & (F.col("seq") + F.col("pages") < limit)
        ).select(
            "start_url", (F.col("seq") + F.col("pages")).alias("seq"),
            F.col("to_head").alias("head"), F.col("to_rank").alias("rank"),
        )
        rows = at.count()
    return reduce(DataFrame.unionByName, slices)


def crawl_many(
    edges: DataFrame,
    starts: DataFrame,
    max_pages: int,
    *,
    stop_on_cycle: bool = False,
    **tuning,
) -> DataFrame:
    """Walk from every ``start_url``: ``(start_url, seq, url)`` with ``seq`` from 0.

    Pages are ranked in chains once (:func:`page_chains`), walks are slices of chains, and only
    here a slice becomes a row for each page: what is stored is linear in pages and slices, however
    long the tails that walks share. Loops repeat pages up to ``max_pages`` unless
    ``stop_on_cycle``: then a walk ends before the first page that it had. Each round is written
    to the shared checkpoint folder, which keeps plans small and lets lost executors resume.
    """
    chains, ends = page_chains(edges, **tuning)
    slices = walk_slices(chains, ends, starts, max_pages, stop_on_cycle=stop_on_cycle, **tuning)
    steps = slices.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pages") - 1)).alias("_k"))
    place = F.struct("head", ((F.col("rank") + F.col("_k")) % F.col("length")).alias("rank"))
    walked = steps.select("start_url", (F.col("seq") + F.col("_k")).alias("seq"), place.alias("_place"))
    pages = chains.select(F.struct("head", "rank").alias("_place"), "url")
    rows = slices.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    return lookup_join(
        walked, pages, "_place", spread=["start_url", "seq"], how="inner", left_rows=rows, **tuning
    ).select("start_url", "seq", "url")


def chain_chapters(walk: DataFrame, chapters: DataFrame, on: str = "url", **tuning) -> DataFrame:
    """Chapters of every walk in order: ``book_id`` is the start page, ``seq`` counts from 1.

    ``on`` tells a chapter: its ``url``, or the ``page_id`` of the capture that a walk names.
    """
    wanted = chapters.select(*[name for name in chapters.columns if name == on or name not in walk.columns])
    joined = lookup_join(walk, wanted, on, spread=["start_url", "seq"], how="inner", **tuning)
    others = [name for name in chapters.columns if name != "url"]
    return joined.select(
        F.col("start_url").alias("book_id"), (F.col("seq") + 1).alias("seq"), "url", *others
    )


def chapter_counts(book_chapters: DataFrame) -> DataFrame:
    return book_chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"))
