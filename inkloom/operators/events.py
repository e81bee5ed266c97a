"""Raw HTML to an ordered array of open, close and text events.

The one step that runs in Python workers. Every event carries its own index ``i`` and the
index ``end`` of the matching close, so "inside" is a comparison of integers and everything
after this step is a native expression. ``noise`` and ``anchor`` name the nearest enclosing
(or own) unwanted subtree and link, -1 for none.
"""

from __future__ import annotations

import html as html_entities
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from html.entities import html5 as HTML5_NAMES

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.config import NOISE_CLASSES, NOISE_TAGS

# The parser travels to the workers with the plan, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN, CLOSE, TEXT = "open", "close", "text"

EVENT_TYPE = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("noise", T.IntegerType()),
        T.StructField("anchor", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)

# Element kinds of the HTML standard.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
DECODED_RAW = frozenset(("textarea", "title"))
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
FORMATTING = frozenset(
    "a b big code em font i nobr s small strike strong tt u".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p "
    "pre search section summary table ul xmp".split()
)
# A new element of the kind on the left ends an open one of a kind on the right ...
SIBLINGS = {
    "li": ("li",),
    "dd": ("dd", "dt"),
    "dt": ("dd", "dt"),
    "option": ("option",),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
}
# ... unless one of these lies between.
SCOPE_STOPS = frozenset("ol ul dl table select button caption td th html".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# An end tag of a block does not reach out of these.
BLOCK_SCOPE = frozenset("applet caption html table td th marquee object template".split())
P_SCOPE = BLOCK_SCOPE | {"button"}
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption colgroup".split())
# Any other end tag does not reach out of these, nor a list item out of its list's blocks.
SPECIAL = CLOSES_P | BLOCK_SCOPE | TABLE_PARTS | frozenset("body button head iframe select".split())
ITEM_STOPS = {
    kind: SPECIAL - frozenset(("address", "div", "p", *SIBLINGS[kind])) for kind in ("li", "dd", "dt")
}

_TOKEN = re.compile(
    r"""<!--|<[!?][^>]*>
    |</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>
    |<(?P<open>[a-zA-Z][^\s/>]*)
     (?P<attrs>[^>"']*+(?:(?:(?<=[=\s])(?:"[^"]*"|'[^']*')|["'])[^>"']*+)*+)>
    |<(?P<plain>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>""",
    re.S | re.X,
)
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_REFERENCE = re.compile(r"&(?:#[xX]?[0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)")
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")


class _Events:
    """Column lists for one output batch; pages are appended one after the other."""

    def __init__(self, keep_attrs: frozenset[str] | None):
        self.keep_attrs = keep_attrs
        # Rows of (i, parent, depth, noise, anchor, kind, tag, text); "end" is filled in later.
        self.rows: list[tuple] = []
        self.ends: list[int] = []
        self.attr_offsets, self.attr_keys, self.attr_values = [0], [], []
        self.page_offsets = [0]

    def __len__(self) -> int:
        return self.page_offsets[-1]

    def start_page(self) -> None:
        self.base = self.page_offsets[-1]
        self.stack: list[list] = []  # [index, tag, noise, anchor, formatting entry or None]
        self.active: list[list] = []  # [tag, attributes, is open, place in the stack]
        self.alike: dict[tuple, list[list]] = {}  # the active ones by tag and attributes
        self.open_tags: Counter = Counter()
        self.open_p = [0]  # open paragraphs within each scope of the stack
        self.size = 0
        self.in_body = False

    def finish_page(self) -> None:
        self._enter_body()
        while self.stack:
            self._pop()
        self.page_offsets.append(self.base + self.size)

    def _emit(self, kind, noise, anchor, tag=None, text=None) -> None:
        stack, size = self.stack, self.size
        parent = stack[-1][0] if stack else -1
        self.rows.append((size, parent, len(stack), noise, anchor, kind, tag, text))
        self.ends.append(size)
        self.attr_offsets.append(len(self.attr_keys))
        self.size = size + 1

    def _pop(self) -> None:
        index, tag, noise, anchor, entry = self.stack.pop()
        self.open_tags[tag] -= 1
        if tag in P_SCOPE:
            self.open_p.pop()
        elif tag == "p":
            self.open_p[-1] -= 1
        if entry is not None:
            entry[2] = False
        self.ends[self.base + index] = self.size
        self._emit(CLOSE, noise, anchor, tag)

    def _pop_to(self, tags: Sequence[str], stops: frozenset[str] = frozenset()) -> None:
        """Close up to and including the nearest open element of one of ``tags``."""
        if not any(self.open_tags[tag] > 0 for tag in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][1] in tags:
                while len(self.stack) > at:
                    self._pop()
                return
            if self.stack[at][1] in stops:
                return

    def _push(self, tag, attrs, entry=None) -> None:
        noise, anchor = (self.stack[-1][2], self.stack[-1][3]) if self.stack else (-1, -1)
        if tag in NOISE_TAGS or any(
            key == "class" and not _CLASS_NOISE.isdisjoint(value.split()) for key, value in attrs
        ):
            noise = self.size
        if tag == "a":
            anchor = self.size
        for key, value in attrs:
            if self.keep_attrs is None or key in self.keep_attrs:
                self.attr_keys.append(key)
                self.attr_values.append(value)
        index = self.size
        self._emit(OPEN, noise, anchor, tag)
        if tag not in VOID:
            if entry is not None:
                entry[3] = len(self.stack)
            self.stack.append([index, tag, noise, anchor, entry])
            self.open_tags[tag] += 1
            if tag in P_SCOPE:
                self.open_p.append(0)
            elif tag == "p":
                self.open_p[-1] += 1

    def _close_p(self) -> None:
        if self.open_p[-1] > 0:
            self._pop_to(("p",), P_SCOPE)

    def _enter_body(self) -> None:
        if not self.in_body:
            self.in_body = True
            if not self.stack:
                self._push("html", ())
            self._pop_to(("head",))
            self._push("body", ())

    def _reopen_formatting(self) -> None:
        at = len(self.active)
        while at and not self.active[at - 1][2]:
            at -= 1
        for entry in self.active[at:]:
            entry[2] = True
            self._push(entry[0], entry[1], entry)

    def _close_formatting(self, tag) -> None:
        for entry in reversed(self.active):
            if entry[0] == tag:
                self._forget(entry)
                if entry[2]:
                    at = entry[3]
                    # A block in between keeps the element open until the block closes.
                    if all(item[1] not in CLOSES_P for item in self.stack[at + 1 :]):
                        while len(self.stack) > at:
                            self._pop()
                return

    def _forget(self, entry: list) -> None:
        """Takes an entry off the active list; entries are told by identity, newest first."""
        at = len(self.active) - 1
        while self.active[at] is not entry:
            at -= 1
        del self.active[at]
        same = self.alike[_kind(entry)]
        del same[next(k for k, old in enumerate(same) if old is entry)]

    def text(self, raw: str, decode: bool = True) -> None:
        if not raw:
            return
        if not self.stack or not self.in_body:
            if raw.isspace():
                return
            self._enter_body()
        self._reopen_formatting()
        self.raw(html_entities.unescape(raw) if decode and "&" in raw else raw)

    def raw(self, value: str) -> None:
        top = self.stack[-1]
        self._emit(TEXT, top[2], top[3], None, value)

    def open(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body" and not self.in_body:
                if not self.stack:
                    self._push("html", ())
                self._pop_to(("head",))
                self.in_body = True
                self._push("body", attrs)
            elif tag == "html" and not self.stack:
                self._push("html", attrs)
            elif tag == "head" and not self.in_body and len(self.stack) < 2:
                if not self.stack:
                    self._push("html", ())
                self._push("head", attrs)
            return
        if tag in HEAD_ONLY:
            if not self.stack:
                self._push("html", ())
        else:
            self._enter_body()
        if tag in CLOSES_P:
            self._close_p()
        if tag in ITEM_STOPS:
            self._pop_to(SIBLINGS[tag], ITEM_STOPS[tag])
        elif tag in SIBLINGS:
            for kind in SIBLINGS[tag]:
                self._pop_to((kind,), SCOPE_STOPS - {kind})
        elif tag in HEADINGS and self.stack[-1][1] in HEADINGS:
            self._pop()
        if tag in FORMATTING:
            if tag == "a":
                self._close_formatting("a")
            self._reopen_formatting()
            entry = [tag, attrs, True, -1]
            same = self.alike.setdefault(_kind(entry), [])
            if len(same) >= 3:  # the standard keeps at most three alike
                self._forget(same[0])
            self.active.append(entry)
            same.append(entry)
            self._push(tag, attrs, entry)
            return
        if tag not in CLOSES_P and tag not in HEAD_ONLY and tag not in SIBLINGS:
            self._reopen_formatting()
        self._push(tag, attrs)

    def close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.open("br", [])
        elif tag in FORMATTING:
            self._close_formatting(tag)
        elif tag == "p":
            self._close_p()
        elif tag in HEADINGS:
            self._pop_to(HEADINGS, BLOCK_SCOPE)
        elif tag == "li":
            self._pop_to(("li",), BLOCK_SCOPE | {"ol", "ul"})
        elif tag in CLOSES_P or tag in SIBLINGS:
            self._pop_to((tag,), BLOCK_SCOPE - TABLE_PARTS if tag in TABLE_PARTS else BLOCK_SCOPE)
        elif tag in SPECIAL:
            self._pop_to((tag,))
        else:
            self._pop_to((tag,), SPECIAL)

    def nodes(self) -> Iterator[tuple]:
        """A row per element or text node, in the order of the fields."""
        offsets = self.attr_offsets
        for at, (i, parent, depth, noise, anchor, kind, tag, text) in enumerate(self.rows):
            if kind != CLOSE:
                own = slice(offsets[at], offsets[at + 1])
                attrs = dict(zip(self.attr_keys[own], self.attr_values[own]))
                yield i, self.ends[at], parent, depth, noise, anchor, kind, tag, attrs, text

    def to_arrow(self) -> pa.Array:
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_offsets, pa.int32()),
            pa.array(self.attr_keys, pa.string()),
            pa.array(self.attr_values, pa.string()),
        )
        fields = ("i", "parent", "depth", "noise", "anchor", "kind", "tag", "text")
        named = {"end": pa.array(self.ends, pa.int32()), "attrs": attrs}
        for field, values in zip(fields, zip(*self.rows)):
            named[field] = pa.array(values, pa.int32() if field in fields[:5] else pa.string())
        names = [field.name for field in EVENT_TYPE]
        rows = pa.StructArray.from_arrays([named[name] for name in names], names)
        return pa.ListArray.from_arrays(pa.array(self.page_offsets, pa.int32()), rows)


_CLASS_NOISE = frozenset(NOISE_CLASSES)


def _kind(entry: list) -> tuple:
    return entry[0], tuple(entry[1])


def _decoded(value: str) -> str:
    """Character references in an attribute: a name without ``;`` stays before ``=``."""

    def one(found: re.Match) -> str:
        name = found.group()[1:]
        if name[0] == "#":
            return html_entities.unescape(found.group())
        text = HTML5_NAMES.get(name)
        if text is None or (name[-1] != ";" and value[found.end() : found.end() + 1] == "="):
            return found.group()
        return text

    return _REFERENCE.sub(one, value)


def _attributes(source: str) -> list[tuple[str, str]]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), _decoded(value) if "&" in value else value)
    return list(found.items())


def add_page(events: _Events, page: str) -> None:
    """Feed one page; a missing page counts as an empty one. Line ends become newlines."""
    page = (page or "").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    events.start_page()
    at, upto = 0, page.rfind(">") + 1
    while True:
        # Behind the last ">" no tag ends, so nothing is looked for there again and again.
        token = _TOKEN.search(page, at, upto)
        if token is None:
            # A tag the page ends in the middle of is dropped.
            cut = _UNFINISHED.search(page, at)
            events.text(page[at : cut.start()] if cut else page[at:])
            break
        events.text(page[at : token.start()])
        at = token.end()
        if token.group() == "<!--":
            end = _COMMENT_END.search(page, at) if at < upto else None
            at = end.end() if end else len(page)
            continue
        name = token["open"] or token["plain"]
        if name:
            tag, source = name.lower(), token["attrs"] or token["rest"]
            events.open(tag, _attributes(source) if source else [])
            if tag in RAW_TEXT:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                body = page[at : end.start()] if end else page[at:]
                if body:
                    decode = tag in DECODED_RAW and "&" in body
                    events.raw(html_entities.unescape(body) if decode else body)
                at = end.start() if end else len(page)
        elif token["close"]:
            events.close(token["close"].lower())
    events.finish_page()


def _batches(keep_attrs: frozenset[str] | None, limit: int, most_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.num_columns - 1)
            passed = batch.columns[:-1]
            first, chars, events = 0, 0, _Events(keep_attrs)
            for row in range(batch.num_rows):
                page = pages[row].as_py()
                chars += len(page or "")
                add_page(events, page)
                if len(events) >= limit or chars >= most_chars or row + 1 == batch.num_rows:
                    columns = [c.slice(first, row + 1 - first) for c in passed]
                    names = [*batch.schema.names[:-1], "events"]
                    # Nothing of a batch that is on its way is held while the next one is built.
                    found, events = events.to_arrow(), _Events(keep_attrs)
                    yield pa.RecordBatch.from_arrays([*columns, found], names)
                    first, chars, found = row + 1, 0, None

    return run


def page_events(
    pages: DataFrame,
    keys: Sequence[str] = ("page_id", "url"),
    html: str = "html",
    *,
    keep_attrs: Sequence[str] | None = None,
    batch_events: int = 20_000,
    batch_chars: int = 1_000_000,
) -> DataFrame:
    """``keys`` plus ``events ARRAY<STRUCT>`` for every page; a map step, no shuffle.

    Only the named columns reach the Python workers. ``keep_attrs`` limits which attributes
    are kept; ``batch_events`` and ``batch_chars`` (of the pages) bound a batch on its way back, which
    is full with the page that reaches either.
    """
    narrow = pages.select(*keys, html)
    schema = T.StructType(
        [narrow.schema[key] for key in keys] + [T.StructField("events", T.ArrayType(EVENT_TYPE))]
    )
    kept = None if keep_attrs is None else frozenset(keep_attrs)
    return narrow.mapInArrow(_batches(kept, batch_events, batch_chars), schema)


def page_nodes(events: DataFrame, keys: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One row per element or text node, for relational use."""
    return events.select(*keys, F.inline("events")).filter(F.col("kind") != CLOSE)


class _PageNodes:
    """The nodes of a page, a row each."""

    def eval(self, html: str) -> Iterator[tuple]:
        events = _Events(None)
        add_page(events, html)
        yield from events.nodes()


def register_page_nodes(spark: SparkSession, name: str = "page_nodes") -> None:
    """The table function ``name(html)`` for SQL: the rows of :func:`page_nodes` of one page.

    ``SELECT p.page_id, n.* FROM pages p, LATERAL page_nodes(p.html) n``. A null page is an empty
    one. Pages stay where they are: the lateral join has no shuffle. Rows go to and fro in Arrow
    batches; a function from batches to tables cannot stand in a lateral join.
    """
    spark.udtf.register(name, F.udtf(_PageNodes, returnType=EVENT_TYPE, useArrow=True))
