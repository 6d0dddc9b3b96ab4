"""Predicates and lookups over the elements of a page: columns of ``nodes`` arrays and their items."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sqltext

Test = Callable[[Column], Column]


def kit(x: Column | sqltext.Sql):
    """The functions for an element: of Columns, or of SQL text."""
    return sqltext if isinstance(x, sqltext.Sql) else F


def attr(x: Column, name: str) -> Column:
    """Value of an attribute; null where it is missing."""
    return kit(x).element_at(x["attrs"], kit(x).lit(name))


def has_attr(x: Column, name: str) -> Column:
    return attr(x, name).isNotNull()


def text_of(x: Column) -> Column:
    """Text of an element with all it holds, white space collapsed: pieces of the page's ``bits``."""
    K = kit(x)
    return K.trim(K.array_join(K.slice("bits", x["t0"], x["tn"]), ""))


def node(number: Column, nodes: str = "nodes") -> Column:
    """The element of that number; null for 0."""
    return kit(number).get(nodes, number - 1)


def classes(x: Column) -> Column:
    return kit(x).coalesce(attr(x, "class"), kit(x).lit(""))


def class_like(x: Column, *parts: str) -> Column:
    """The class attribute holds any of the parts, upper and lower case told apart."""
    return _any([classes(x).contains(p) for p in parts])


def tag_in(x: Column, *tags: str) -> Column:
    return x["tag"].isin(*tags)


def filled(c: Column) -> Column:
    return kit(c).coalesce(c != "", kit(c).lit(False))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


_PART = re.compile(r"\[([\w-]+)(?:([*^~$]?)=(?:'([^']*)'|\"([^\"]*)\"|([\w-]+))\s*(i?))?\]|#([\w-]+)|\.([\w-]+)|:not\(([^)]*)\)|([A-Za-z][\w-]*)|(\*)")


def compound_parts(selector: str) -> list[dict]:
    """A compound selector such as ``a.b[c*='d' i]:not([e])`` as data: tests ``{no, all}``, of which ``all`` lists parts
    ``{kind, name, op, value, fold}`` that hold together, or don't if ``no``."""
    parts = list(_PART.finditer(selector))
    if "".join(m[0] for m in parts) != selector.strip() or not parts:
        raise ValueError(f"selector not supported: {selector!r}")
    out = []
    for m in parts:
        name, op, a, b, c, fold, ident, cls, without, tag, _ = m.groups()
        if without is not None:
            out.append({"no": True, "all": [p for t in compound_parts(without) if not t["no"] for p in t["all"]]})
            continue
        want = a if a is not None else b if b is not None else c
        one = {"kind": "any", "name": "", "op": "", "value": "", "fold": False}
        if name:
            one |= {"kind": "attr", "name": name, "op": "has" if want is None else op or "=", "value": (want.lower() if fold else want) if want is not None else "", "fold": bool(fold)}
        elif ident or cls:
            one |= {"kind": "id" if ident else "class", "value": ident or cls}
        elif tag:
            one |= {"kind": "tag", "value": tag.lower()}
        out.append({"no": False, "all": [one]})
    return out


def simple(selector: str) -> Test:
    """A compound selector as a test of one element."""
    parsed = compound_parts(selector)

    def one(x: Column, p: dict) -> Column:
        K = kit(x)
        if p["kind"] == "any":
            return K.lit(True)
        if p["kind"] == "tag":
            return x["tag"] == p["value"]
        if p["kind"] == "id":
            return K.coalesce(attr(x, "id") == p["value"], K.lit(False))
        if p["kind"] == "class":
            return K.array_contains(K.split(classes(x), r"\s+"), p["value"])
        value, want = attr(x, p["name"]), p["value"]
        if p["op"] == "has":
            return value.isNotNull()
        value = K.lower(K.coalesce(value, K.lit(""))) if p["fold"] else K.coalesce(value, K.lit(""))
        held = {"=": lambda: value == want, "*": lambda: value.contains(want), "^": lambda: value.startswith(want), "$": lambda: value.endswith(want), "~": lambda: K.array_contains(K.split(value, r"\s+"), want)}[p["op"]]()
        return held & has_attr(x, p["name"])

    def test(x: Column) -> Column:
        tests = [(t["no"], _all([one(x, p) for p in t["all"]])) for t in parsed]
        return _all([~t if no else t for no, t in tests])

    return test


def chains_of(text: str) -> list[list[tuple[str, str]]]:
    """The chains of a selector list, from left to right: compound selectors and how each follows on the one before. Commas
    within brackets are not supported."""
    out = []
    for chain in text.split(","):
        steps, link, made = re.findall(r"[>+~](?!=)|(?:\[[^\]]*\]|:not\([^)]*\)|[^\s>+~\[])+", chain.strip()), "", []
        for s in steps:
            if s in (">", "+", "~"):
                link = s
            else:
                made.append((link or (" " if made else ""), s))
                link = ""
        if not made or link or made[0][0]:
            raise ValueError(f"selector not supported: {chain!r}")
        out.append(made)
    return out


def selector(text: str, nodes: str = "nodes") -> Test:
    """A selector list; a space asks for an ancestor, ``>`` for the parent, ``+`` for the sibling before, ``~`` for any before."""

    def one(chain: list[tuple[str, str]]) -> Test:
        (link, part), rest = chain[-1], chain[:-1]
        last, before = simple(part), one(rest) if rest else None

        def test(x: Column) -> Column:
            K = kit(x)
            if before is None:
                return last(x)
            if link == " ":
                return last(x) & any_above(x, before, nodes)
            if link == "~":
                return last(x) & K.coalesce(K.exists(K.slice(nodes, x["parent"] + 1, x["id"] - x["parent"] - 1), lambda y: (y["parent"] == x["parent"]) & before(y)), K.lit(False))
            return last(x) & K.coalesce(before(node(x["parent" if link == ">" else "prev"], nodes)), K.lit(False))

        return test

    tests = [one(c) for c in chains_of(text)]
    return lambda x: _any([t(x) for t in tests])


def inside(x: Column, test: Test, nodes: str = "nodes") -> Column:
    """Descendants of ``x`` that meet ``test``, in document order. They follow it at once, so no others are looked at."""
    K = kit(x)
    return K.filter(K.slice(nodes, x["id"] + 1, x["end"] - x["id"]), test)


def any_inside(x: Column, test: Test, nodes: str = "nodes") -> Column:
    K = kit(x)
    return K.exists(K.slice(nodes, x["id"] + 1, x["end"] - x["id"]), test)


def first_inside(x: Column, test: Test, nodes: str = "nodes") -> Column:
    """The first such descendant; null without one."""
    return kit(x).get(inside(x, test, nodes), kit(x).lit(0))


def any_above(x: Column, test: Test, nodes: str = "nodes") -> Column:
    return kit(x).exists(x["up"], lambda u: test(node(u, nodes)))


def children(x: Column, test: Test, nodes: str = "nodes") -> Column:
    return inside(x, lambda y: (y["parent"] == x["id"]) & test(y), nodes)


def next_sibling(x: Column, nodes: str = "nodes") -> Column:
    K, y = kit(x), kit(x).get(nodes, x["end"])
    return K.when(y["parent"] == x["parent"], y)


def has_name(x: Column, nodes: str = "nodes") -> Column:
    """An assistive technology can name the element: a label, a title, text that is not hidden, or the alternative text of
    its first image that has one."""
    K = kit(x)
    own = filled(attr(x, "aria-label")) | filled(attr(x, "aria-labelledby")) | filled(K.trim(attr(x, "title"))) | x["seen"]
    # from the first image on; most elements hold none
    pics = K.filter(K.slice(nodes, x["pic"], x["end"] - x["pic"] + 1), lambda y: (y["tag"] == "img") & has_attr(y, "alt"))
    return own | K.when(x["pic"] > 0, filled(K.trim(attr(K.get(pics, K.lit(0)), "alt")))).otherwise(False)


def explicit_name(x: Column, nodes: str = "nodes") -> Column:
    K = kit(x)
    own = filled(K.trim(attr(x, "aria-label"))) | filled(attr(x, "aria-labelledby")) | filled(K.trim(attr(x, "title")))
    return own | filled(text_of(node(x["title"], nodes)))


def is_decorative(x: Column) -> Column:
    K = kit(x)
    return K.coalesce(attr(x, "aria-hidden") == "true", K.lit(False)) | K.coalesce(K.lower(attr(x, "role")).isin("presentation", "none"), K.lit(False))


def is_visible(x: Column) -> Column:
    K = kit(x)
    hidden = K.coalesce(attr(x, "aria-hidden") == "true", K.lit(False)) | has_attr(x, "hidden") | K.coalesce(K.lower(attr(x, "style")).rlike(r"display\s*:\s*none|visibility\s*:\s*hidden"), K.lit(False))
    return ~hidden


def displayed(x: Column) -> Column:
    """Not taken out of the page by its own inline style or the hidden attribute."""
    K = kit(x)
    return ~(has_attr(x, "hidden") | K.coalesce(K.lower(attr(x, "style")).rlike(r"display\s*:\s*none"), K.lit(False)))


def pixels(x: Column, side: str) -> Column:
    """Width or height from the attribute, else the inline style; 0 where neither says."""
    K = kit(x)
    number = lambda c, p: K.regexp_extract(K.coalesce(c, K.lit("")), p, 1).try_cast("double")
    return K.coalesce(number(attr(x, "style"), rf"(?i)(?:^|;|\s){side}\s*:\s*([0-9.]+)\s*px"), number(attr(x, side), r"^\s*([0-9.]+)"), K.lit(0.0))
