"""CSS selectors over a page's elements, as filters by position.

`select` takes the elements of a whole page (`parse` without tags: an element stands at its position). A selector is tags, classes,
ids, attribute tests ([a], =, ~=, |=, ^=, $=, *=), :first-child, :last-child, :nth-child, :empty and :not(...), joined by
descendant, child (>), next (+) and later (~) combinators, and lists of these by commas. Everything is higher-order functions:
a child's parent stands at a known place, an element's descendants are a range of positions, and the element before it ends where it begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column, Column], Column]

_NAME = r"[\w\-]+"
_PARTS = re.compile(
    rf"""(?P<tag>\*|{_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<quoted>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
    |:not\((?P<no>[^()]*(?:\([^()]*\)[^()]*)*)\)|:nth-child\(\s*(?P<nth>[^)]*?)\s*\)|:(?P<state>first-child|last-child|empty)""",
    re.X,
)
_COMBINED = re.compile(r"""\s*([>+~])\s*|\s+""")
_QUOTED = re.compile(r"""\[[^\]]*\]|\([^()]*(?:\([^()]*\)[^()]*)*\)""")


def _cut(selector: str, at: re.Pattern[str]) -> list[tuple[str, str]]:
    """(separator before, part), not inside brackets."""
    hidden = _QUOTED.sub(lambda m: "x" * len(m[0]), selector)
    out, start, before = [], 0, ""
    for m in at.finditer(hidden):
        out.append((before, selector[start : m.start()]))
        before, start = m[0].strip() or " ", m.end()
    return [*out, (before, selector[start:])]


def _attribute(name: str, op: str | None, value: str) -> Test:
    def test(e: Column, every: Column) -> Column:
        own = F.try_element_at(e["attrs"], F.lit(name))
        found = {
            None: lambda: own.isNotNull(),
            "=": lambda: own == value,
            "~=": lambda: F.array_contains(F.split(own, r"\s+"), value),
            "|=": lambda: (own == value) | own.startswith(value + "-"),
            "^=": lambda: own.startswith(value) & F.lit(value != ""),
            "$=": lambda: own.endswith(value) & F.lit(value != ""),
            "*=": lambda: own.contains(value) & F.lit(value != ""),
        }[op]()
        return F.coalesce(found, F.lit(False))

    return test


def _nth(text: str) -> Test:
    text = {"odd": "2n+1", "even": "2n"}.get(text, text).replace(" ", "")
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not m or not text:
        raise ValueError(f"not a place among children: {text}")
    step = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    first = int(m[2] or 0)

    def test(e: Column, every: Column) -> Column:
        place = F.size(F.filter(every, lambda o: (o["parent"] == e["parent"]) & (o["pos"] <= e["pos"])))
        if step == 0:
            return place == first
        return (F.pmod(place - first, F.lit(abs(step))) == 0) & ((place >= first) if step > 0 else (place <= first))

    return test


_STATES: dict[str, Test] = {
    "first-child": lambda e, every: e["pos"] == e["parent"] + 1,
    "last-child": lambda e, every: e["end_pos"] == F.coalesce(F.get(every, F.when(e["parent"] >= 0, e["parent"]))["end_pos"], F.size(every) - 1),
    "empty": lambda e, every: (e["pos"] == e["end_pos"]) & (e["text"] == ""),
}


def _compound(text: str) -> list[Test]:
    """The tests of tag, classes and so on of one element."""
    out: list[Test] = []
    at = 0
    while at < len(text):
        m = _PARTS.match(text, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"not a selector: {text}")
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                out.append(lambda e, every, tag=m["tag"].lower(): e["tag"] == tag)
        elif m["cls"]:
            out.append(_attribute("class", "~=", m["cls"]))
        elif m["id"]:
            out.append(_attribute("id", "=", m["id"]))
        elif m["attr"]:
            out.append(_attribute(m["attr"].lower(), m["op"], next((v for v in (m["quoted"], m["single"], m["bare"]) if v is not None), "")))
        elif m["no"] is not None:
            out.append(lambda e, every, inner=compiled(m["no"]): ~inner(e, every))
        elif m["nth"] is not None:
            out.append(_nth(m["nth"]))
        else:
            out.append(_STATES[m["state"]])
    if not text:
        raise ValueError("an empty selector")
    return out


def _chain(parts: list[tuple[str, list[Test]]]) -> Test:
    """The last compound's tests, and by its combinator an element around or before it that matches the others."""
    combinator, tests = parts[-1]

    def test(e: Column, every: Column) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & t(e, every)
        if len(parts) == 1:
            return out
        rest = _chain(parts[:-1])
        if combinator == ">":
            above = F.get(every, F.when(e["parent"] >= 0, e["parent"]))
            return out & F.coalesce((e["parent"] >= 0) & rest(above, every), F.lit(False))
        if combinator == "+":
            return out & F.exists(every, lambda o: (o["parent"] == e["parent"]) & (o["end_pos"] == e["pos"] - 1) & rest(o, every))
        if combinator == "~":
            return out & F.exists(every, lambda o: (o["parent"] == e["parent"]) & (o["pos"] < e["pos"]) & rest(o, every))
        return out & F.exists(every, lambda o: (o["pos"] < e["pos"]) & (o["end_pos"] >= e["pos"]) & rest(o, every))

    return test


def compiled(selector: str) -> Test:
    """Whether an element of a page's elements matches a selector."""
    options = [_chain([(c, _compound(p)) for c, p in _cut(part.strip(), _COMBINED)]) for _, part in _cut(selector, re.compile(","))]

    def test(e: Column, every: Column) -> Column:
        out = options[0](e, every)
        for o in options[1:]:
            out = out | o(e, every)
        return out

    return test


def select(elements: Column | str, selector: str) -> Column:
    """All elements that match, in document order."""
    every = F.col(elements) if isinstance(elements, str) else elements
    test = compiled(selector)
    return F.filter(every, lambda e: test(e, every))


def select_one(elements: Column | str, selector: str) -> Column:
    """The first element that matches, else null."""
    return F.get(select(elements, selector), F.lit(0))
