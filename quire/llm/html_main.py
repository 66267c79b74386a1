"""Main text of web pages by site style trees.

Pages of a host are merged to one tree whose nodes are element paths (tags with classes). A node has as many style variants as
its elements have different sequences of children; their entropy over the host's pages, to the base of the number of elements,
is its style importance. Its content is its pieces of text, links and images: one that d of the m pages with the node have
counts 1 - ln d / ln m, and the importance of a node's content is the mean over all pieces that pages have in it and below it. So what
every page has alike has no importance, and one link that differs doesn't make a menu important. Copies of a page count as one.
Branches of low importance are cut from each page of hosts with enough pages. Elements that by their tag, role or class can't be article text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments) are cut on every host, but classes and ids don't cut a main
part or article body below them, and words of a page's layout neither an article below them nor a branch with most text; inside an article only branches
that aren't paragraphs or headings can be cut for importance, and never what holds the article.

Defined cases: null html counts as empty (text is empty); pages without a host are a site without cuts for importance; each row
gets a text of its own, also repeated ones; other columns are ignored; an empty table gives an empty result; very long pages are
read whole, in time proportional to their length: elements nested deeper than `DEEPEST` stand beside each other there, as
browsers have it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, stored, text_slices

#: A node needs so many different pages of its host, and less importance than this, to be cut; inside an article less than the second.
LEAST_ELEMENTS, LOW, LOW_INSIDE = 8, 0.4, 0.05
#: Weight of the style entropy against the content entropy.
STYLE_WEIGHT = 0.2

#: Open elements at once.
DEEPEST = 512
#: Of several articles of a page those stay that have this share of the longest one's text.
ROOT_SHARE = 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CUT_TAGS = frozenset("head nav footer aside form button select option fieldset dialog menu object embed applet audio video canvas svg math map search datalist".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status tablist".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidebars widget widgets menu menus nav navbar navigation topnav breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations trending comment comments commentlist reply replies respond disqus footer header masthead topbar toolbar pagination pager paging login signin signup register search searchbox copyright disclaimer skip hidden".split()
)
#: Inside an article these are its own top, of which the headings stay; names that begin with the others only tell of a page's make-up.
TOPS = frozenset(["header", "masthead"])
ABOUT = (["has"], ["with"], ["no"], ["without"], ["is"], ["layout"], ["overflow"])
#: After these a word only tells of a page's make-up.
BEFORE = frozenset("with has no without".split())
#: Words that wrappers of whole pages carry too: a branch that has them stays if it holds more than SHARE of its scope's text.
LAYOUT = frozenset("sidebar sidebars widget widgets header footer overlay banner".split())
SHARE = 0.6
#: How an element is cut: by layout words only, by other words of class or id, by tag, role or style.
LAYOUT_CUT, NAME_CUT, FIRM_CUT = 1, 2, 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "head", "option", "optgroup", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section div main body nav aside footer header form blockquote select".split())

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/"'>]+)""")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
MASK = (1 << 63) - 1


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c, bare in ATTRIBUTE.findall(text):
        out.setdefault((name or bare).lower(), a or b or c)
    return out


def is_cut(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """How an element is marked as not being article text, by tag, role, class and id alone; 0 if not at all."""
    if tag in CUT_TAGS or (tag == "header" and not in_article):
        return FIRM_CUT
    if not attrs:
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return FIRM_CUT
    if attrs.get("role", "").lower() in CUT_ROLES:
        return FIRM_CUT
    if tag in ("body", "html", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody" or (tag == "article" and not in_article and attrs.get("class", "").lower() not in CUT_WORDS):
        return 0
    found = 0
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in NAME_WORDS.findall(name)]
        if words[:2] == ["elementor", "widget"]:
            words = words[2:]  # any box of that page builder
        if words[:1] not in ABOUT:
            for before, w in zip(["", *words], words, strict=False):
                if w in CUT_WORDS and before not in BEFORE and not (in_article and w in TOPS):
                    found = max(found, LAYOUT_CUT if w in LAYOUT and tag in BLOCK else NAME_CUT)
    return found


class Node:
    __slots__ = ("tag", "path", "cut", "article", "branch", "style", "content", "top")

    def __init__(self, tag: str, path: int, cut: int, article: int, branch: int) -> None:
        self.tag, self.path, self.cut, self.article, self.branch = tag, path, cut, article, branch
        self.style, self.content = 7, False
        self.top = False


def path_of(parent: int, tag: str, attrs: dict[str, str]) -> int:
    kind = ".".join(sorted(set(attrs.get("class", "").split()))) if attrs else ""
    return xxhash.xxh64_intdigest(f"{parent}/{tag}.{kind}") & MASK


class Page:
    """Walks a page once: `styles` counts (path, children), `pieces` are (path, hash) of texts, links and images, `above` has each path's parent; `blocks` are (root, branch, text), with root 0 outside articles and main parts, and the innermost branch that layout words cut."""

    def __init__(self, low: frozenset[int] = frozenset(), low_inside: frozenset[int] = frozenset(), counting: bool = False) -> None:
        self.low, self.low_inside, self.counting = low, low_inside, counting
        self.styles: Counter = Counter()
        self.pieces: set[tuple[int, int]] = set()
        self.above: dict[int, int] = {}
        #: Open elements by tag, and those that aren't held as they are nested too deep.
        self.open: Counter = Counter()
        self.deeper: Counter = Counter()
        self.blocks: list[tuple[int, int, str]] = []
        self.parts: list[str] = []
        self.roots = 0
        #: The branch around each branch, and the roots found in cut branches: whether they are sure to be the page's.
        self.around = [0]
        self.late: dict[int, bool] = {}

    def flush(self, node: Node) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.blocks.append((node.article, node.branch, text))

    def close(self, stack: list[Node], at: int) -> None:
        while len(stack) > at:
            node = stack.pop()
            self.open[node.tag] -= 1
            if node.tag in BLOCK:
                self.flush(node)
            if stack:
                stack[-1].style = (stack[-1].style * 1000003 + node.path) & MASK
                stack[-1].content |= node.content
            if self.counting and node.content:
                self.styles[node.path, node.style] += 1

    def piece(self, node: Node, kind: str, value: str) -> None:
        node.content = True
        self.pieces.add((node.path, xxhash.xxh64_intdigest(f"{kind}:{value}".encode("utf-8", "replace")) & MASK))

    def text(self, stack: list[Node], raw: str) -> None:
        top = stack[-1]
        if self.counting:
            if raw.strip():
                self.piece(top, "text", " ".join(raw.split()))
        elif top.cut <= LAYOUT_CUT:
            self.parts.append(html.unescape(raw) if "&" in raw else raw)

    def walk(self, source: str) -> Page:
        stack = [Node("", 0, 0, 0, 0)]
        at, marked = 0, source.find("<![CDATA[")
        last = source.rfind(">") + 1  # no element begins after it
        late = source.find("<!--", last)
        while at < len(source):
            m = TOKEN.search(source, at, last)
            if m is None:
                self.text(stack, source[at : late if late >= 0 else len(source)])
                break
            if m.start() > at:
                self.text(stack, source[at : m.start()])
            at = m.end()
            if marked >= 0 and source.startswith("<![CDATA[", m.start()):
                marked = source.find("]]>", m.start())
                at = max(at, marked + 3) if marked >= 0 else at
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.end(stack, tag)
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(f"</{tag}[\\s/>]", re.I).search(source, at)
                stop = source.find(">", end.start()) + 1 if end else len(source)
                at = stop or len(source)
                continue
            self.start(stack, tag, attributes(m[3]) if m[3].strip(" /\n") else {}, m[3].endswith("/"))
        self.close(stack, 1)
        self.flush(stack[0])
        return self

    def start(self, stack: list[Node], tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in CLOSES_P:
            self.close_open(stack, frozenset(["p"]))
        if tag in SIBLINGS:
            self.close_open(stack, SIBLINGS[tag])
        top = stack[-1]
        if tag in VOID:
            if self.counting:
                if tag == "img" and attrs.get("src"):
                    self.piece(top, "image", attrs["src"])
            elif top.cut <= LAYOUT_CUT:
                if tag == "hr":
                    self.flush(top)
                elif tag == "br":
                    self.parts.append(" ")
            return
        if tag in BLOCK:
            self.flush(top)
        path = path_of(top.path, tag, attrs)
        own = is_cut(tag, attrs, bool(top.article))
        if (path in self.low and not top.article and tag not in ("html", "body", "article", "main") or path in self.low_inside and top.article and tag not in HEADINGS and tag in BLOCK and tag != "p"):
            own = FIRM_CUT
        article, branch, cut = top.article, top.branch, max(top.cut, own)
        sure = tag == "main" or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        if not own and not article and (sure and top.cut < FIRM_CUT or tag == "article" and top.cut <= LAYOUT_CUT):
            self.roots += 1
            if top.cut:
                self.late[self.roots] = sure
            article, branch, cut = self.roots, 0, 0
        elif not cut and tag == "article" and article and next(n.tag for n in stack if n.article == article) != "article":
            self.roots += 1  # an article inside the main part is a root of its own
            article = self.roots
        if not cut and top.top and tag not in HEADINGS and tag not in ("hgroup", "div"):
            cut = FIRM_CUT  # of an article's top the headings stay
        if len(stack) > DEEPEST and (not own or top.cut >= own):
            self.deeper[tag] += 1
            return
        if own == cut == LAYOUT_CUT:
            self.around.append(branch)
            branch = len(self.around) - 1
        node = Node(tag, path, cut, article, branch)
        node.top = bool(article) and (tag == "header" or top.top and tag in ("hgroup", "div") or any(w.lower() in TOPS for w in NAME_WORDS.findall(attrs.get("class", "")))) if attrs or tag == "header" or top.top else False
        stack.append(node)
        self.open[tag] += 1
        if self.counting:
            self.above[path] = top.path
            if tag == "a" and attrs.get("href"):
                self.piece(node, "link", attrs["href"])

    def close_open(self, stack: list[Node], tags: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                self.close(stack, i)
                if "td" not in tags:
                    return
            elif stack[i].tag in SCOPES and stack[i].tag not in tags:
                return

    def end(self, stack: list[Node], tag: str) -> None:
        if self.deeper[tag]:
            self.deeper[tag] -= 1
            return
        if not self.open[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                self.close(stack, i)
                return
            if tag not in BLOCK and stack[i].tag in SCOPES:
                return

    def staying(self) -> list[tuple[int, str]]:
        """(root, text) of the blocks that no layout words cut, or that lie in branches with most of their scope's text."""
        if len(self.around) == 1:
            return [(root, text) for root, _, text in self.blocks]
        sizes: Counter = Counter()
        scopes: dict[int, int] = {}
        for root, branch, text in self.blocks:
            sizes["root", root] += len(text)
            while branch:
                sizes[branch] += len(text)
                scopes[branch] = root
                branch = self.around[branch]
        stays = {0: True}
        for branch, around in enumerate(self.around[1:], 1):
            scope = sizes[around] if around else sizes["root", scopes.get(branch, 0)]
            stays[branch] = stays[around] and sizes[branch] > SHARE * scope
        return [(root, text) for root, branch, text in self.blocks if stays[branch]]

    def main_text(self) -> str:
        """The blocks of the article with most text and of others of its size, or all where there is none; articles in cut branches only where there is no other."""
        blocks = self.staying()
        sizes: Counter = Counter()
        for root, text in blocks:
            sizes[root] += len(text)
        sure = [r for r in sizes if r and self.late.get(r, True)]
        inside = [r for r in sure if r not in self.late] or sure or [r for r in sizes if r and sizes[r] > sizes[0]]
        best = max(inside, key=lambda r: (sizes[r], -r)) if inside else 0
        least = ROOT_SHARE * sizes[best]
        kept = {r for r in inside if sizes[r] >= least} | {best}
        return "\n".join(text for root, text in blocks if root in kept)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: What a row of counts is about: children of a node, a piece of content, pages with the node, a node that it lies in.
STYLE, PIECE, PAGES, WITHIN = range(4)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in text_slices(batches, "html", 16 << 20):
        seen: dict[str, Counter] = {}
        for site, copies, page in zip(batch.column("host").to_pylist(), batch.column("copies").to_pylist(), pages, strict=True):
            if site:
                own, held = Page(counting=True).walk(page.decode("utf-8", "replace")), seen.setdefault(site, Counter())
                for (path, style), n in own.styles.items():
                    held[path, STYLE, style] += n / copies
                for path, value in own.pieces:
                    held[path, PIECE, value] += 1 / copies
                for path in {path for path, _ in own.styles}:
                    held[path, PAGES, 0] += 1 / copies
                for path in {path for path, _ in own.pieces}:
                    over = path
                    while over and (path, WITHIN, over) not in held:
                        held[path, WITHIN, over] = 1
                        over = own.above.get(over, 0)
        rows = [(site, path, what, value, n) for site, c in seen.items() for (path, what, value), n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["host", "path", "what", "value", "n"])


def importance(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance of each node of the hosts' trees, from (host, html); copies of a page share the weight of one."""
    keyed = pages.select("host", "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("key"))
    copied = stored(keyed.groupBy("host", "key").agg(F.count("*").alias("copies")).where("copies > 1 and host != ''"), "copied")
    weighed = keyed.join(bounded(copied), ["host", "key"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    variants = weighed.mapInArrow(_count, "host string, path long, what long, value long, n double").groupBy("host", "path", "what", "value").agg(F.round(F.sum("n"), 6).alias("n")).where("n > 0")
    variants = stored(variants, "variants")
    of = lambda what, x: F.sum(F.when(F.col("what") == what, x))
    n = F.col("n")
    nodes = variants.where(F.col("what") != WITHIN).groupBy("host", "path").agg(of(PAGES, n).alias("pages"), of(STYLE, n).alias("elements"), of(STYLE, n * F.ln(n)).alias("x"), of(PIECE, n).alias("pieces"), of(PIECE, n * F.ln(F.greatest(n, F.lit(1.0)))).alias("logs"))
    nodes = stored(nodes, "nodes")
    # what a node's own pieces are worth, and of these the mean over all nodes below it
    worth = F.when((F.col("pages") > 1) & (F.col("pieces") > 0), F.col("pieces") - F.col("logs") / F.ln("pages")).otherwise(F.col("pieces"))
    below = variants.where(F.col("what") == WITHIN).select("host", "path", F.col("value").alias("over"))
    content = below.join(nodes.select("host", "path", worth.alias("worth"), "pieces"), ["host", "path"]).groupBy("host", F.col("over").alias("path")).agg((F.sum("worth") / F.sum("pieces")).alias("content"))
    style = F.when(F.col("elements") > 1, 1 - F.col("x") / (F.col("elements") * F.ln("elements"))).otherwise(F.lit(1.0))
    both = STYLE_WEIGHT * style + (1 - STYLE_WEIGHT) * F.col("content")
    return nodes.where("pages is not null").join(content, ["host", "path"]).select("host", "path", "pages", both.alias("importance"))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in text_slices(batches, "html", 16 << 20):
        out = []
        for page, low, inside in zip(pages, batch.column("low").to_pylist(), batch.column("low_inside").to_pylist(), strict=True):
            out.append(Page(frozenset(low or ()), frozenset(inside or ())).walk(page.decode("utf-8", "replace")).main_text())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    nodes = importance(rows.select("host", "html")).where((F.col("pages") >= LEAST_ELEMENTS) & (F.col("importance") < LOW))
    inside = F.collect_list(F.when(F.col("importance") < LOW_INSIDE, F.col("path")))
    sites = stored(nodes.groupBy("host").agg(F.collect_list("path").alias("low"), inside.alias("low_inside")), "sites")  # a row a host; broadcast only below Spark's threshold
    return rows.join(sites, "host", "left").select("page_id", "url", "html", "low", "low_inside").mapInArrow(_cut, "page_id long, url string, text string, n_chars long")
