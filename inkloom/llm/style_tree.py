"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: a node is a path of tags with class and id, its
presentations are the orders of children that pages show there, its content nodes the texts. With
m pages, a text found in c of them has entropy log_m(c), as evenly spread as it can be, and
importance 1 - log_m(c). A node's importance is

    (1 - g^l) * entropy of its l presentations + g^l * mean importance of the content below it

so a branch that shows the same in every page is worth nothing. Branches and texts of hardly any
importance are removed. What markup itself names as no article (menus, forms, adverts and so on)
is removed first, and an article or main element, where a page has one, is what is extracted: the
tree then decides about the branches and texts inside it.

Only counts by host, path and text hash are shuffled. The low-importance nodes are few a host;
they are broadcast if their count is checked to be small, else joined with hot hosts salted.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import pick
from inkloom.operators.keyed import lookup_join
from inkloom.session import cut_lineage

# What HTML says about its elements.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu"
    " nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul"
    " caption search".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("body html option optgroup".split())
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
LISTS = frozenset("ul ol menu dl table tbody thead tfoot select".split())

# What is no article by its element, role, class or id.
NOISE_TAGS = frozenset(
    "nav footer aside form menu dialog select search template svg canvas object audio video"
    " button datalist map math".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu"
    " menubar toolbar tablist status".split()
)
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo"
    " promotion nav navbar navigation menu submenu breadcrumb breadcrumbs footer foot sidebar side"
    " aside masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal"
    " overlay newsletter subscribe subscription signup login share sharing social comment"
    " comments commentlist disqus respond replies related recommended teaser widget widgets"
    " pagination pager skip search searchbox form copyright disclaimer tracking hidden".split()
)
HEADER_WORDS = frozenset(("header", "head", "siteheader", "pageheader"))
#: Of the words above those of readers' replies and links, which may be longer than the article.
REPLY_WORDS = frozenset(
    "comment comments commentlist disqus respond replies related recommended".split()
)

TAG = re.compile(
    r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+>)"""
)
COMMENT = re.compile("<!--")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)|([^\s"'=<>/]++)""")
NAME_PARTS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

DECAY = 0.9
#: Fewer different pages of a host tell nothing: what all of them show may be chance.
MIN_PAGES = 4
MIN_IMPORTANCE = 0.05
BROADCAST_ROWS = 50_000
# Fixed value: the depth to which browsers nest elements; content counts for so many around it.
MOST_DEPTH = 512

#: How a node stands to the article: no part of it, unknown, or inside main content.
NOISE, PLAIN, MAIN = 0, 1, 2

#: What a row of ``style_counts`` tells of.
WHOLE, TEXT, ORDER, WAY = range(4)


#: The removable paths down to a place as a chain: the chain above and the innermost path.
Branches = tuple["Branches", int] | None


def branches_of(chain: Branches) -> list[int]:
    """The paths of a chain, innermost first."""
    found: list[int] = []
    while chain is not None and len(found) < MOST_DEPTH:
        chain, path = chain
        found.append(path)
    return found


@dataclass(frozen=True)
class Block:
    """One run of text between block boundaries. ``doubt`` is the innermost doubtful element
    around it and ``main_doubt`` that around its innermost article or main element;
    ``in_article`` tells of article elements only."""

    text: str
    path: int
    branches: Branches
    state: int
    doubt: int = -1
    main_doubt: int = -1
    in_article: bool = False


class Node:
    """An open element. ``branches`` are the paths down to it that the tree may remove: in main
    content only those with a class or id, as its plain elements are the article itself."""

    __slots__ = (
        "branches", "children", "doubt", "in_article", "label", "main_doubt", "path", "state", "tag",
    )

    def __init__(self, tag: str, label: str, above: Node | None, state: int):
        self.tag, self.label, self.state = tag, label, state
        self.path = hashed(label if above is None else f"{above.path} {label}")
        branches = None if above is None or above.state != state else above.branches
        plain = tag in ("html", "body") or (
            state == MAIN and (" " not in label or tag in ("article", "main"))
        )
        self.branches = branches if plain else (branches, self.path)
        self.children: list[str] = []
        self.doubt, self.main_doubt = (-1, -1) if above is None else (above.doubt, above.main_doubt)
        self.in_article = tag == "article" or (above is not None and above.in_article)


def hashed(text: str) -> int:
    """Signed 64-bit hash of a text."""
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        name = (m.group(1) or m.group(3)).lower()
        value = m.group(2) or ""
        if value[:1] in "\"'":
            value = value[1:-1]
        found.setdefault(name, entities.unescape(value) if "&" in value else value)
    return found


def _label(tag: str, own: dict[str, str]) -> str:
    names = f"{own.get('class', '')} {own.get('id', '')}".split()
    return " ".join([tag, *(DIGITS.sub("#", n.lower()) for n in names)])


def _state(tag: str, own: dict[str, str], above: Node | None) -> tuple[int, str | None]:
    """State of an element by its own markup, and a doubt whether it is noise all the same.

    Noise stays noise below; main content stays main unless markup says noise. Words of class and
    id and forms only raise a doubt ("word" or "reply"), as they may name what wraps a whole page.
    """
    inherited = PLAIN if above is None else above.state
    if inherited == NOISE:
        return NOISE, None
    names = CAMEL.sub(" ", f"{own.get('class', '')} {own.get('id', '')}").lower()
    words = set(NAME_PARTS.findall(names)) if names.strip() else set()
    role = own.get("role", "").lower()
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or (
        "style" in own and HIDDEN.search(own["style"]) is not None
    )
    form = tag == "form" or role == "form"
    if (tag in NOISE_TAGS or role in NOISE_ROLES) and not form or hidden:
        return NOISE, None
    if tag in ("body", "html"):
        return inherited, None
    reply = "reply" if words & REPLY_WORDS else None
    if tag in ("article", "main") or role in ("main", "article"):
        # An article in main content may be a reply; no other word says what an article is.
        return MAIN, reply if inherited == MAIN else None
    if tag == "header" and inherited != MAIN:
        return NOISE, None
    if words & NOISE_WORDS or form or (words & HEADER_WORDS and inherited != MAIN):
        return inherited, reply or "word"
    return inherited, None


class Page:
    """The text blocks of a page, and the order of children below each node."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.orders: list[tuple[int, int]] = []
        self.stack: list[Node] = []
        self.open: Counter = Counter()
        self.pieces: list[str] = []
        #: Of each doubtful element the doubtful one around it, and whether its word is of replies.
        self.doubts: list[tuple[int, bool]] = []
        self._read(source)
        self._flush()
        while self.stack:
            self._pop()
        self._settle_doubts()

    def _settle_doubts(self) -> None:
        """Makes noise of the doubtful elements that do not wrap the page.

        One wraps it that holds most of the page's text or most of the text of the articles, by
        the articles that begin in it. One of replies does not by its length: all articles must
        begin in it or, where there is none, most of the text of main elements.
        """
        if not self.doubts:
            return
        inside, mains, articles = ([0] * len(self.doubts) for _ in range(3))
        every = main = article = 0
        for b in self.blocks:
            if b.state == NOISE:
                continue
            every += len(b.text)
            main += len(b.text) if b.state == MAIN else 0
            article += len(b.text) if b.in_article else 0
            if b.doubt >= 0:
                inside[b.doubt] += len(b.text)
                articles[b.doubt] += len(b.text) if b.in_article else 0
            if b.state == MAIN and b.main_doubt >= 0:
                mains[b.main_doubt] += len(b.text)
        for k in range(len(self.doubts) - 1, -1, -1):
            around = self.doubts[k][0]
            if around >= 0:
                inside[around] += inside[k]
                mains[around] += mains[k]
                articles[around] += articles[k]
        noise: list[bool] = []
        for k, (around, reply) in enumerate(self.doubts):
            wraps = 2 * inside[k] > every or 2 * mains[k] > main
            if reply:
                wraps = articles[k] == article if article else 2 * mains[k] > main
            noise.append(not wraps or (around >= 0 and noise[around]))
        self.blocks = [
            replace(b, state=NOISE) if b.doubt >= 0 and noise[b.doubt] else b for b in self.blocks
        ]

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            if text:
                node = self.stack[-1] if self.stack else None
                where = (
                    (node.path, node.branches, node.state, node.doubt, node.main_doubt, node.in_article)
                    if node
                    else (0, None, PLAIN)
                )
                self.blocks.append(Block(text, *where))
                if node:
                    node.children.append("#")

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[node.tag] -= 1
        order = [c for k, c in enumerate(node.children) if not k or c != node.children[k - 1]]
        self.orders.append((node.path, hashed("|".join(order))))

    def _push(self, tag: str, own: dict[str, str]) -> None:
        above = self.stack[-1] if self.stack else None
        state, doubt = _state(tag, own, above)
        node = Node(tag, _label(tag, own), above, state)
        if doubt:
            self.doubts.append((node.doubt, doubt == "reply"))
            node.doubt = len(self.doubts) - 1
        if tag in ("article", "main") or own.get("role", "").lower() in ("main", "article"):
            node.main_doubt = node.doubt
        if above:
            above.children.append(node.label)
        self.stack.append(node)
        self.open[tag] += 1

    def _close(self, tags: tuple[str, ...], stop: frozenset[str] = frozenset()) -> None:
        """Pops up to the nearest of the tags, if none of ``stop`` stands before it."""
        if not any(self.open[t] > 0 for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k].tag in stop:
                return

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        last = source.rfind(">")
        # An inline element that is no text, such as a button; whether its own end tag comes next
        # of its kind, and how many blocks are open inside it.
        skipped: str | None = None
        ends, inner = False, 0
        while at < end:
            # No tag ends after the last ">"; a comment may still begin there and never end.
            m = TAG.search(source, at, last + 1) or COMMENT.search(source, max(at, last - 3))
            upto = m.start() if m else end
            if skipped is None and upto > at:
                text = source[at:upto]
                self.pieces.append(entities.unescape(text) if "&" in text else text)
            if m is None:
                return
            at = m.end()
            name = None if m.re is COMMENT else m.group(2) or m.group(5)
            if name is None:
                if m.group() == "<!--":
                    close = source.find("-->", at - 2)
                    at = end if close < 0 else close + 3
                continue
            tag, closing = name.lower(), bool(m.group(1) or m.group(4))
            rest = m.group(3) or m.group(6) or ""
            if skipped is not None:
                if closing and tag == skipped:
                    skipped = None
                    continue
                if tag in BLOCKS and tag != "hr":
                    inner += -1 if closing else 1
                # One that is never closed ends at the next block, any at its parent's end.
                if tag not in BLOCKS or (ends and inner >= 0):
                    continue
                skipped = None
            if closing:
                if tag in BLOCKS:
                    self._flush()
                    self._close((tag,))
                continue
            if tag in RAW:
                if not rest.endswith("/"):
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.IGNORECASE).search(source, at)
                    at = close.end() if close else end
                continue
            if tag in BLOCKS:
                self._flush()
                if self.open["p"] > 0 and tag in CLOSES_P:
                    self._close(("p",))
                if tag in SIBLINGS:
                    self._close(SIBLINGS[tag], LISTS)
                if tag != "hr":
                    self._push(tag, attributes(rest) if "=" in rest or rest.strip() else {})
            elif tag == "br":
                self.pieces.append(" ")
            elif tag in NOISE_TAGS and not rest.endswith("/"):
                found = re.compile(rf"<(/?){tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
                skipped, inner = tag, 0
                ends = found is not None and bool(found.group(1))


def kept_blocks(page: Page, paths: frozenset[int], texts: frozenset[int]) -> list[str]:
    """Texts of the article, in page order; none if all of the page is like the host's others.

    ``paths`` are low-importance branches of the host, ``texts`` low-importance texts.
    """
    blocks = [b for b in page.blocks if b.state != NOISE]
    main = [b for b in blocks if b.state == MAIN]
    #: Whether a place lies in a low branch, kept for each place that was looked at.
    low: dict[int, bool] = {id(None): False}

    def removed(chain: Branches) -> bool:
        below: list[Branches] = []
        while id(chain) not in low:
            below.append(chain)
            chain = chain[0]
        found = low[id(chain)]
        for place in reversed(below):
            found = low[id(place)] = found or place[1] in paths
        return found

    return [
        b.text
        for b in main or blocks
        if not (paths and removed(b.branches))
        and (not texts or hashed(f"{b.path} {b.text}") not in texts)
    ]


def extracted(source: str | None, paths: frozenset[int], texts: frozenset[int]) -> str:
    return "\n".join(kept_blocks(Page(source), paths, texts)) if source else ""


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host): the authority of the url, lower-cased; null without one."""
    rows = pick(pages, page_id="bigint", url="string", html="string")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    return rows.withColumn("host", F.when(host != "", host))


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, path, item, page, kind, above): what each page shows, once a page in every batch.

    ``page`` is a hash of all texts of the page, so copies are one page; ``item`` is a text or an
    order of children by ``kind``. Every page has one row of kind ``WHOLE``. Of each path one row
    a batch, of kind ``WAY``, has ``above``, the branches it lies in.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown: dict[tuple, None] = {}
            ways: dict[tuple[str, int], list[int]] = {}
            for host, source in zip(batch["host"], batch["html"], strict=True):
                host, page = host.as_py(), Page(source.as_py())
                blocks = [b for b in page.blocks if b.state != NOISE and b.path]
                whole = hashed("\n".join(b.text for b in blocks))
                shown[host, 0, 0, whole, WHOLE] = None
                for b in blocks:
                    shown[host, b.path, hashed(f"{b.path} {b.text}"), whole, TEXT] = None
                    if (host, b.path) not in ways:
                        ways[host, b.path] = branches_of(b.branches)
                for path, order in page.orders:
                    shown[host, path, order, whole, ORDER] = None
            rows = [(*key, None) for key in shown]
            rows += [(h, p, None, None, WAY, way) for (h, p), way in ways.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), *[pa.int64()] * 3, pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["host", "path", "item", "page", "kind", "above"],
            )

    return (
        with_host(pages)
        .filter(F.col("host").isNotNull() & F.col("html").isNotNull())
        .select("host", "html")
        .mapInArrow(
            emit,
            "host string, path bigint, item bigint, page bigint, kind int, above array<bigint>",
        )
    )


def low_importance(pages: DataFrame) -> DataFrame:
    """(host, node, is_text): branches and texts of the hosts' style trees to be removed.

    All counts are of different pages: n pages show a text or an order of children, however often
    it stands in them, and copies of a page are one page. Hosts with fewer than ``MIN_PAGES``
    pages have no such nodes: there is nothing to compare.
    """
    shown = cut_lineage(
        style_counts(pages)
        .groupBy("host", "path", "item", "kind", "page")
        .agg(F.first("above", ignorenulls=True).alias("above"))
        .groupBy("host", "path", "item", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.first("above", ignorenulls=True).alias("above"))
    )
    sites = shown.filter(F.col("kind") == WHOLE).select("host", F.col("n").alias("m"))
    shown = shown.filter(F.col("kind") != WHOLE).join(
        sites.filter(F.col("m") >= MIN_PAGES), "host"
    )
    entropy = F.ln(F.col("n").cast("double")) / F.ln(F.col("m").cast("double"))
    texts = shown.filter(F.col("kind") == TEXT).select(
        "host", "path", "item", (1 - entropy).alias("importance")
    )
    ways = shown.filter(F.col("kind") == WAY).select(
        "host", "path", F.explode("above").alias("node")
    )
    by_path = texts.groupBy("host", "path").agg(
        F.sum("importance").alias("worth"), F.count(F.lit(1)).alias("texts")
    )
    content = (
        by_path.join(ways, ["host", "path"])
        .groupBy("host", "node")
        .agg((F.sum("worth") / F.sum("texts")).alias("content"))
    )
    orders = shown.filter(F.col("kind") == ORDER)
    per_node = orders.groupBy("host", "path").agg(
        F.sum("n").alias("all"),
        F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("n_ln_n"),
        F.count(F.lit(1)).alias("l"),
        F.first("m").alias("m"),
    )
    spread = (F.ln("all") - F.col("n_ln_n") / F.col("all")) / F.ln(F.col("m").cast("double"))
    weight = F.pow(F.lit(DECAY), F.col("l"))
    branches = (
        per_node.withColumnRenamed("path", "node")
        .join(content, ["host", "node"])
        .filter((F.col("all") >= MIN_PAGES))
        .select(
            "host", "node",
            ((1 - weight) * F.least(F.lit(1.0), spread) + weight * F.col("content")).alias("importance"),
        )
    )
    low = F.col("importance") < MIN_IMPORTANCE
    return branches.filter(low).select("host", "node", F.lit(False).alias("is_text")).union(
        texts.filter(low).select("host", F.col("item").alias("node"), F.lit(True).alias("is_text"))
    )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null or empty html: empty text. Null url, or one without a host: markup alone decides. Null
    page_id: kept as null. Repeated rows: a result each, and as copies no evidence that their
    text is noise. Very long pages: read once, in one row's memory. Empty table: no rows.
    """
    nodes = F.collect_set(F.when(~F.col("is_text"), F.col("node")))
    texts = F.collect_set(F.when(F.col("is_text"), F.col("node")))
    # Per host as many as its templates have, whatever its pages.
    removed = cut_lineage(
        low_importance(pages).groupBy("host").agg(nodes.alias("paths"), texts.alias("texts"))
    )
    rows = with_host(pages)
    if removed.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(removed), "host", "left")
    else:
        joined = lookup_join(rows, removed, "host", spread=["page_id", "url"])

    @F.arrow_udf("string")
    def extract(sources: pa.Array, paths: pa.Array, texts: pa.Array) -> pa.Array:
        sets: dict = {}

        def as_set(values) -> frozenset[int]:
            found = tuple(values.as_py() or ())
            return sets.setdefault(found, frozenset(found))

        return pa.array(
            [
                extracted(source.as_py(), as_set(p), as_set(t))
                for source, p, t in zip(sources, paths, texts, strict=True)
            ],
            pa.string(),
        )

    text = joined.select("page_id", "url", extract("html", "paths", "texts").alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("bigint"))
