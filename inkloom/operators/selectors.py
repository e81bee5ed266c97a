"""A small selector grammar as predicates over event arrays.

Supported: ``tag``, ``.class``, ``#id``, ``[name=value]``, ``[name*=value]``, ``[name]``,
compounds of these, descendants (white space) and alternatives (comma).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIMPLE = re.compile(
    r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[(?P<name>[\w:-]+)(?:(?P<op>\*?=)["']?(?P<value>[^"'\]]*)["']?)?\]""",
    re.X,
)


def _compound(source: str):
    """Predicate over one open event for ``tag.class[attr=value]``."""
    tests, at = [], 0
    while at < len(source):
        match = _SIMPLE.match(source, at) if at else _SIMPLE.match(source)
        if match is None or (match["tag"] and at):
            raise ValueError(f"unsupported selector {source!r}")
        tests.append(match.groupdict())
        at = match.end()

    def test(event: Column, part: dict) -> Column:
        attrs = event["attrs"]
        if part["tag"]:
            return F.lit(True) if part["tag"] == "*" else event["tag"] == part["tag"].lower()
        if part["cls"]:
            words = F.split(attrs["class"], r"[\t\n\f\r ]+")
            return F.array_contains(words, part["cls"])
        if part["id"]:
            return attrs["id"] == part["id"]
        value = attrs[part["name"].lower()]
        if part["op"] == "*=":
            return F.contains(value, F.lit(part["value"]))
        return value.isNotNull() if part["op"] is None else value == part["value"]

    def predicate(event: Column) -> Column:
        hits = [F.coalesce(test(event, part), F.lit(False)) for part in tests]
        return reduce(lambda a, b: a & b, hits)

    return predicate


def attributes_used(selector: str) -> set[str]:
    """Names of the attributes a selector looks at."""
    names = {name.lower() for name in re.findall(r"\[([\w:-]+)", selector)}
    if "." in selector:
        names.add("class")
    if "#" in selector:
        names.add("id")
    return names


def _descendant_path(opens: Column, path: str) -> Column:
    found = None
    for source in path.split():
        predicate, outer = _compound(source), found

        def matches(event: Column) -> Column:
            here = predicate(event)
            if outer is None:
                return here
            inside = F.exists(outer, lambda a: (a["i"] < event["i"]) & (a["end"] > event["end"]))
            return here & inside

        found = F.filter(opens, matches)
    return found


def matching(opens: Column, selector: str) -> Column:
    """All matching open events in document order."""
    paths = [part.strip() for part in selector.split(",")]
    if all(len(path.split()) == 1 for path in paths):
        predicates = [_compound(path) for path in paths]
        return F.filter(opens, lambda e: reduce(lambda a, b: a | b, [p(e) for p in predicates]))
    found = [_descendant_path(opens, path) for path in paths]
    if len(found) == 1:
        return found[0]
    return F.array_sort(
        F.array_distinct(F.flatten(F.array(*[F.transform(f, _place) for f in found])))
    )


def _place(event: Column) -> Column:
    return F.struct(event["i"].alias("i"), event["end"].alias("end"))


def first_match(opens: Column, selector: str) -> Column:
    """Place ``(i, end)`` of the first matching element, null if there is none."""
    found = F.get(matching(opens, selector), F.lit(0))
    return F.when(found.isNotNull(), _place(found))


def first_of(opens: Column, selectors: tuple[str, ...] | list[str]) -> Column:
    """First match of the first selector that has one."""
    return F.coalesce(*[first_match(opens, selector) for selector in selectors])
