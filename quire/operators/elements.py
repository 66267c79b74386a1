"""Pages as arrays of elements, and selectors over them.

`parse` runs the standard library's parser once over each page, in Arrow batches; everything after it is higher-order functions
on `elements array<struct<pos, end_pos, parent, depth, tag, attrs, text, inner_html, outer_html>>`. Positions are in document
order; an element's descendants are those with pos < p <= end_pos.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

ELEMENT = "struct<pos:int,end_pos:int,parent:int,depth:int,tag:string,attrs:map<string,string>,text:string,inner_html:string,outer_html:string>"
ELEMENT_TYPE = pa.struct(
    [("pos", pa.int32()), ("end_pos", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("inner_html", pa.string()), ("outer_html", pa.string())]
)
#: Bytes of elements that a batch of parsed pages holds, about (some 1,000 for each as a Python object); one page may be larger.
PARSED_BYTES = 8 << 20


class _Tree(HTMLParser):
    """Elements close at their end tag, or with the element around them; an end tag without a start is ignored."""

    def __init__(self, markup: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.markup = markup
        self.found: list[dict] = []
        self.open: list[dict] = []
        self.pieces: list[str] = []  # text in order, so that an element's text is a run of it
        self.source: list[str] = []  # markup likewise

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = {"pos": len(self.found), "end_pos": len(self.found), "parent": self.open[-1]["pos"] if self.open else -1, "depth": len(self.open), "tag": tag, "attrs": {}}
        for k, v in attrs:
            e["attrs"].setdefault(k, v or "")
        e["_text"], e["_outer"] = [len(self.pieces)], [len(self.source)]
        self.found.append(e)
        if self.markup:
            self.source.append(f"<{tag}{''.join(f' {k}="{html.escape(v)}"' for k, v in e['attrs'].items())}{'/' if tag in VOID else ''}>")
        if tag in VOID:
            self._close(e)
        else:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, e: dict) -> None:
        e["end_pos"] = len(self.found) - 1
        e["_text"].append(len(self.pieces))
        if self.markup and e["tag"] not in VOID:
            self.source.append(f"</{e['tag']}>")
        e["_outer"].append(len(self.source))

    def handle_endtag(self, tag: str) -> None:
        if any(e["tag"] == tag for e in self.open):
            while True:
                e = self.open.pop()
                self._close(e)
                if e["tag"] == tag:
                    return

    def handle_data(self, data: str) -> None:
        raw = self.open and self.open[-1]["tag"] in ("script", "style")
        if not raw:
            self.pieces.append(data)
        if self.markup:
            self.source.append(data if raw else html.escape(data, quote=False))

    def elements(self) -> list[dict]:
        while self.open:
            self._close(self.open.pop())
        for e in self.found:
            (a, b), (c, d) = e.pop("_text"), e.pop("_outer")
            e["text"] = "".join(self.pieces[a:b])
            e["inner_html"] = "".join(self.source[c + 1 : max(c + 1, d - 1)]) if self.markup else None
            e["outer_html"] = "".join(self.source[c:d]) if self.markup else None
            e["attrs"] = list(e["attrs"].items())
        return self.found


def elements_of(page: str, tags: frozenset[str] | None = None, markup: bool = True) -> list[dict]:
    tree = _Tree(markup)
    tree.feed(page)
    tree.close()
    found = tree.elements()
    return found if tags is None else [e for e in found if e["tag"] in tags]


def parse(pages: DataFrame, html_col: str = "html", tags: tuple[str, ...] | None = None, markup: bool = False) -> DataFrame:
    """pages with `elements` in place of the page; only of some tags, and without markup, if no more is needed."""
    wanted = frozenset(tags) if tags else None
    others = [c for c in pages.columns if c != html_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, found, weight = 0, [], 0
            for at in range(batch.num_rows):
                page = batch.column(html_col)[at].as_py()
                found.append(None if page is None else elements_of(page, wanted, markup))
                weight += sum(1000 + len(e["text"]) + len(e["outer_html"] or "") + len(e["inner_html"] or "") for e in found[-1] or ())
                if weight > PARSED_BYTES or at == batch.num_rows - 1:  # an element's text is held once for each element around it
                    own = batch.slice(start, len(found))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in others), pa.array(found, pa.list_(ELEMENT_TYPE))], [*others, "elements"])
                    start, found, weight = at + 1, [], 0

    return pages.mapInArrow(run, f"{schema}, elements array<{ELEMENT}>")


def matches(e: Column, tag: str | None = None, cls: str | None = None, attr: dict[str, str] | None = None, string: str | None = None) -> Column:
    """Whether an element has a tag, one class among its classes (several words: exactly these), attributes, and an exact text."""
    out = F.lit(True)
    if tag:
        out = out & (e["tag"] == tag)
    if cls and " " in cls:
        attr = {**(attr or {}), "class": cls}
    elif cls:
        out = out & F.coalesce(F.array_contains(F.split(F.try_element_at(e["attrs"], F.lit("class")), r"\s+"), cls), F.lit(False))
    for name, value in (attr or {}).items():
        out = out & F.coalesce(F.try_element_at(e["attrs"], F.lit(name)) == value, F.lit(False))
    if string is not None:
        out = out & (e["text"] == string)
    return out


def find_all(elements: Column | str, tag: str | None = None, cls: str | None = None, attr: dict[str, str] | None = None, string: str | None = None) -> Column:
    return F.filter(elements, lambda e: matches(e, tag, cls, attr, string))


def find(elements: Column | str, tag: str | None = None, cls: str | None = None, attr: dict[str, str] | None = None, string: str | None = None) -> Column:
    """The first match in document order, else null."""
    return F.get(find_all(elements, tag, cls, attr, string), F.lit(0))


def nth(elements: Column, n: int, strict: bool = False) -> Column:
    """The n-th from 0: null where there are fewer, or an error if strict."""
    return F.element_at(elements, n + 1) if strict else F.get(elements, F.lit(n))


def within(elements: Column | str, scope: Column) -> Column:
    """The descendants of an element, which is found once and not again for each of them."""
    pool = F.col(elements) if isinstance(elements, str) else elements
    return F.get(F.transform(F.array(scope), lambda s: F.filter(pool, lambda e: (e["pos"] > s["pos"]) & (e["pos"] <= s["end_pos"]))), F.lit(0))


def select_one(elements: Column | str, selector: str) -> Column:
    """First match of a simple selector: tag, .class, #id, tag.class, and descendants by spaces."""
    pool, found = F.col(elements) if isinstance(elements, str) else elements, None
    for part in selector.split():
        name, _, rest = part.partition("#")
        tag, _, cls = name.partition(".")
        found = find(pool, tag or None, cls or None, {"id": rest} if rest else None)
        pool = within(elements, found)
    return found


def attr(e: Column, name: str, strict: bool = False) -> Column:
    """An attribute: null where it is missing, or an error if strict."""
    value = F.try_element_at(e["attrs"], F.lit(name))
    return F.coalesce(value, F.raise_error(F.lit(f"no attribute {name}"))) if strict else value


def attr_or(e: Column, first: str, host: str, other: str) -> Column:
    """An attribute if it names a host, else another one, such as data-src for images that load late."""
    value = attr(e, first)
    return F.when(F.coalesce(value.contains(host), F.lit(False)), value).otherwise(attr(e, other))


def page_text(elements: Column | str) -> Column:
    """The text of all elements of a page."""
    return F.array_join(F.transform(F.filter(elements, lambda e: e["depth"] == 0), lambda e: e["text"]), "")


def pretty_html(markup: str) -> str:
    """Markup with each tag and text on a line of its own, a space deeper in each element."""
    lines: list[str] = []
    depth = 0

    class Lines(HTMLParser):
        def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
            nonlocal depth
            lines.append(f"{' ' * depth}<{tag}{''.join(f' {k}="{html.escape(v or '')}"' for k, v in attrs)}{'/' if tag in VOID else ''}>")
            depth += tag not in VOID

        def handle_endtag(self, tag: str) -> None:
            nonlocal depth
            if tag not in VOID:
                depth = max(0, depth - 1)
                lines.append(f"{' ' * depth}</{tag}>")

        def handle_data(self, data: str) -> None:
            if data.strip():
                lines.append(" " * depth + html.escape(data.strip(), quote=False))

    parser = Lines()
    parser.feed(markup)
    parser.close()
    return "\n".join(lines)


@F.arrow_udf(StringType())
def pretty(markup: pa.Array) -> pa.Array:
    return pa.array([None if x is None else pretty_html(x) for x in markup.to_pylist()], pa.string())


class _Words(HTMLParser):
    """The text of a page outside scripts and styles, with a space for each tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.raw = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.pieces.append(" ")
        self.raw = tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.pieces.append(" ")
        self.raw = False

    def handle_comment(self, data: str) -> None:
        self.pieces.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.pieces.append(data)


def words_of(markup: str) -> str:
    parser = _Words()
    parser.feed(markup)
    parser.close()
    return re.sub(r"[ \t\n\r\f\v]+", " ", "".join(parser.pieces)).strip(" ")


@F.arrow_udf(StringType())
def plain_text(markup: pa.Array) -> pa.Array:
    """Text of a page without scripts, styles, comments and tags, character references decoded, white space collapsed."""
    return pa.array([None if x is None else words_of(x) for x in markup.to_pylist()], pa.string())


def without(markup: Column, *tags: str) -> Column:
    """Markup without the elements of some tags and all below them, written anew."""

    @F.arrow_udf(StringType())
    def drop(pages: pa.Array) -> pa.Array:
        return pa.array([None if x is None else dropped(x, tags) for x in pages.to_pylist()], pa.string())

    return drop(markup)


def dropped(markup: str, tags: tuple[str, ...]) -> str:
    tree = _Tree(True)
    tree.feed(markup)
    tree.close()
    while tree.open:
        tree._close(tree.open.pop())
    kept, at = [], 0
    for e in tree.found:  # in page order, so that what lies inside a dropped element starts before `at`
        a, b = e["_outer"]
        if e["tag"] in tags and a >= at:
            kept += tree.source[at:a]
            at = b
    return "".join(kept + tree.source[at:])
