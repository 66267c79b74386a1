"""Queries over pages of the known layouts, books and archives, all built here from the stand-ins' rows.

The pages hold what their SQL computes from the rows alone, so parser, selectors and writers are held against another road.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import html, text, urls
from quire.operators import collections, elements, records
from quire.plans.catalogue import books
from quire.plans.registry import CH, attempts, failed, long, query, turns
from quire.sources import archives, landed, sinks
from quire.sources.shared import shared_path
from quire.sources.tables import read_table

SITE = "https://n.example"
#: The smallest image: one grey point.
PNG = bytes.fromhex("89504e470d0a1a0a0000000d49484452000000010000000108000000003a7e9b550000000a49444154789c63680000008200815f2ba9d60000000049454e44ae426082")


def _join(*parts: str | Column) -> Column:
    """Literals and columns as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _each(items: Column, markup) -> Column:
    return F.array_join(F.transform(items, markup), "")


def novels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n, roles, title, text, indices of each novel."""
    own = turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("role")).alias("roles"), F.min_by("text", "index").alias("text"), F.array_sort(F.collect_list("index")).alias("indices"))
    return own.withColumn("title", _join('Tom & "Ann" <', F.col("conv_id"), ">"))


def _parsed(rows: DataFrame, page: Column, url: Column, *keys: str, markup: bool = True) -> DataFrame:
    return elements.parse(rows.select(*keys, url.alias("url"), page.alias("html")), markup=markup)


def _number(url: str = "url") -> Column:
    return long(urls.last_number(F.col(url)))


#: The same novels in SQL.
NOVELS = f"""WITH c AS ({CH}), n AS (SELECT conv_id, count(*) AS n, list_sort(list(DISTINCT role)) AS roles, arg_min(text, index) AS text, list(index ORDER BY index) AS indices, 'Tom & "Ann" <' || conv_id || '>' AS title FROM c GROUP BY conv_id)"""
ESCAPED = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# novels


@query(
    f"""{NOVELS} SELECT conv_id, title, roles[1] AS author, '{SITE}/c/' || conv_id || '.jpg' AS cover_image, n AS num_chapters, '<div itemprop="description"><p>' || {ESCAPED.format(x="text")} || '</p></div>' AS description,
array_to_string(roles, '|') AS genres, '/t/' || conv_id || '/1' AS start_chapter, '/t/' || conv_id || '/' || n AS end_chapter FROM n"""
)
def layout_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, title = F.col("conv_id"), html.escape(F.col("title"))
    page = _join(
        '<html><body><a href="/">Home</a><h1 itemprop="name">not here</h1><div class="wide book-info"><img itemprop="image" src="/c/', c, '.jpg"><h2 itemprop="name">', title, '</h2><a itemprop="author">', F.get("roles", 0),
        "</a></div><ul><li class='li--genres'>", _each(F.col("roles"), lambda r: F.concat(F.lit("<a href='#'>"), r, F.lit("</a>"))), "</li></ul><p>Số chương: ", F.col("n"), '</p><div itemprop="description"><p>', html.escape(F.col("text")),
        '</p></div><a href="/t/', c, '/1">Chương 1</a><a href="/t/', c, "/", F.col("n"), '">Chương cuối</a></body></html>',
    )
    out = records.novel_info(_parsed(novels(spark, sf_dir), page, _join(f"{SITE}/t/", c)))
    return out.select(_number("novel_url").alias("conv_id"), "title", "author", "cover_image", "num_chapters", "description", F.array_join("genres", "|").alias("genres"), "start_chapter", "end_chapter")


@query(f"{NOVELS} SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Unknown Title' ELSE title END AS title, CASE WHEN conv_id % 3 = 0 THEN '' ELSE array_to_string(roles, '|') END AS genres, CASE WHEN conv_id % 3 = 0 THEN 'Unknown Status' ELSE 'done' END AS status, n + 1 AS num_chapters FROM n")
def layout_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _each(F.col("roles"), lambda r: F.concat(F.lit("<a> "), r, F.lit(" </a>")))
    row = lambda value: _join("<tr><td>k</td><td> ", value, " </td></tr>")
    rows = F.when(F.col("conv_id") % 3 == 0, F.lit("<tr><td>k</td></tr>")).otherwise(F.concat(row(F.lit("0")), row(html.escape(F.col("title"))), row(F.lit("A")), row(F.lit("3")), row(links), row(F.lit("done"))))
    box = _each(F.col("indices"), lambda i: F.concat(F.lit("<a>"), i.cast("string"), F.lit("</a>")))
    page = _join("<table>", rows, '</table><div class="bai-viet-box"><a>no</a></div><div class="bai-viet-box">', box, "</div>")
    out = records.novel_table(_parsed(novels(spark, sf_dir), page, _join(f"{SITE}/t/", F.col("conv_id")), markup=False))
    return out.select(_number("novel_url").alias("conv_id"), "title", F.array_join("genres", "|").alias("genres"), "status", "num_chapters")


@query(f"{NOVELS} SELECT title, roles[1] AS author, 'on' AS status, 'n ' || n AS attribute, conv_id || '.jpg' AS image_url FROM n")
def layout_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = _join(
        '<h1>no</h1><h1 class="big mb-2">', html.escape(F.col("title")), '</h1><a class="text-gray-500"> ', F.get("roles", 0), f' </a><a class="{records.STATUS_CLASS}"><svg></svg><span> on </span></a>',
        f'<a class="{records.ATTRIBUTE_CLASS}">n ', F.col("n"), f'</a><img class="{records.IMAGE_CLASS}" src="', F.col("conv_id"), '.jpg">',
    )
    return records.novel_cards(_parsed(novels(spark, sf_dir), page, F.lit(SITE)))


# chapters


def _chapters(spark: SparkSession, sf_dir: str, page: Column) -> DataFrame:
    return _parsed(turns(spark, sf_dir), page, _join(f"{SITE}/t/", F.col("conv_id"), "/chap-", F.col("index")), "conv_id", "index")


@query(f"WITH c AS ({CH}) SELECT '{SITE}/t/' || conv_id || '/chap-' || index AS url, title, '<div class=\"truyen\">' || chr(10) || ' <p>' || chr(10) || '  ' || text || chr(10) || ' </p>' || chr(10) || '</div>' AS content, CASE WHEN index % 4 <> 0 THEN '{SITE}/t/' || (index + 1) END AS next FROM c")
def layout_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("index")
    after = F.when(i % 4 != 0, _join('<a class="btn next" href="/t/', i + 1, '">n</a>')).otherwise(F.lit(""))
    return records.chapter(_chapters(spark, sf_dir, _join('<h2 class="x current-chapter"> ', html.escape(F.col("title")), ' </h2><div class="truyen"><p>', html.escape(F.col("text")), "</p></div>", after)))


@query(f"WITH c AS ({CH}) SELECT index, CASE WHEN index % 2 = 0 THEN title ELSE 'Chương ' || index END AS title, '<div class=\"ndtruyen\">' || chr(10) || ' ' || text || chr(10) || '</div>' AS content FROM c WHERE index % 5 <> 0")
def layout_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("index")
    head = F.when(i % 2 == 0, _join("<title> ", html.escape(F.col("title")), " </title>")).otherwise(F.lit(""))
    body = F.when(i % 5 == 0, F.lit("<p>gone</p>")).otherwise(_join('<div class="ndtruyen"><img src="i.jpg">', html.escape(F.col("text")), "</div>"))
    return records.numbered_chapter(_chapters(spark, sf_dir, F.concat(head, body)))


@query(
    f"""WITH c AS ({CH}) SELECT '{SITE}/t/' || conv_id || '/chap-' || index AS url, '<h2 class="{records.HEADING_CLASS}">' || title || '</h2>' AS title_html,
'<div class="break-words">' || text || repeat('<br/>', CAST(5 + index % 5 AS INTEGER)) || '</div>' AS html, index % 5 = 3 AS truncated FROM c WHERE index % 7 <> 0"""
)
def layout_card_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("index")
    head = F.when(i % 7 == 0, F.lit("")).otherwise(_join(f'<h2 class="{records.HEADING_CLASS}">', html.escape(F.col("title")), "</h2>"))
    return records.card_chapter(_chapters(spark, sf_dir, _join(head, '<div class="break-words">', html.escape(F.col("text")), F.repeat(F.lit("<br>"), (5 + i % 5).cast("int")), "</div>")))


# comics and galleries


@query(f"{NOVELS} SELECT '{SITE}/' || conv_id AS url, CAST(u.i - 1 AS BIGINT) AS pos, '/c/chap-' || u.i AS link FROM n, LATERAL (SELECT unnest(indices) AS i) u")
def layout_comic(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = _each(F.reverse("indices"), lambda i: F.concat(F.lit('<A HREF="/c/chap-'), i.cast("string"), F.lit("\" target='_self'>x</A><a href='/ad'>ad</a>")))
    return records.comic_chapters(_parsed(novels(spark, sf_dir), newest, _join(f"{SITE}/", F.col("conv_id")))).withColumn("pos", long(F.col("pos")))


@query(f"{NOVELS} SELECT conv_id || '.' || n AS chapter_num, CAST(u.i - 1 AS BIGINT) AS pos, u.i || '.png' AS url FROM n, LATERAL (SELECT unnest(indices) AS i) u")
def layout_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _each(F.col("indices"), lambda i: F.concat(F.lit("<img src=ad.jpg><img class='lazy wide' src="), i.cast("string"), F.lit(".png>")))
    return records.chapter_images(_parsed(novels(spark, sf_dir), images, _join(f"{SITE}/x-chap-", F.col("conv_id"), "-", F.col("n"), ".html"))).withColumn("pos", long(F.col("pos")))


@query(f"{NOVELS} SELECT '{SITE}/g/' || conv_id || '/' AS url, 'Tom & Ann ' || conv_id AS name, CAST(u.i - 1 AS BIGINT) AS pos, 'https://i.example/' || conv_id || '/' || u.i || '.png' AS image FROM n, LATERAL (SELECT unnest(indices) AS i) u WHERE u.i % 3 <> 0")
def layout_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnails, and the images of the pages they lead to; every third page hasn't landed."""
    c = F.col("conv_id")
    thumbs = _each(F.col("indices"), lambda i: _join('<div class="thumb-container"><a href="/g/', c, "/", i, '/"><img src="t.jpg"></a></div>'))
    found = records.gallery(_parsed(novels(spark, sf_dir), _join('<h1 class="title">', html.escape(F.col("title")), "</h1>", thumbs), _join(f"{SITE}/g/", c, "/")))
    viewer = _join('<img src="no.png"><section id="image-container"><a><img src="//i.example/', c, "/", F.col("index"), '.png"></a></section>')
    viewers = _parsed(turns(spark, sf_dir).where("index % 3 <> 0"), viewer, _join(f"{SITE}/g/", c, "/", F.col("index"), "/"))
    return records.gallery_images(found, viewers).withColumn("name", F.regexp_replace("name", "[<>]", " ")).select("url", F.trim("name").alias("name"), long(F.col("pos")).alias("pos"), "image")


# elements


@query(
    f"""{NOVELS} SELECT conv_id, 'deep ' || conv_id AS by_class, title AS by_attribute, 'id' || n AS by_id, 'yes' AS by_string, n AS n_class, n AS n_attribute, 'in ' || n AS by_selector, CAST(NULL AS VARCHAR) AS none,
CASE WHEN conv_id % 2 = 0 THEN 'https://img.example/a.jpg' ELSE '/late.jpg' END AS image FROM n"""
)
def element_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first by class, attribute, id and text; all by class and attribute; a selector; an attribute or another one."""
    c, n = F.col("conv_id"), F.col("n")
    items = _each(F.col("indices"), lambda i: F.concat(F.lit('<li class="a item" data-k="v">'), i.cast("string"), F.lit("</li>")))
    src = F.when(c % 2 == 0, F.lit("https://img.example/a.jpg")).otherwise(F.lit("data:x"))
    page = _join('<p class="deeper">no</p><p class="x deep y">deep ', c, "</p><p data-t='1'>", html.escape(F.col("title")), "</p><p id=main>id", n, "</p><a rel=n>yes, no</a><a rel=y>yes</a><ul>", items, '</ul><span class="in">out</span><div class="box"><b><span class="in">in ', n, '</span></b></div><img src="', src, '" data-src="/late.jpg">')
    parsed = elements.parse(novels(spark, sf_dir).select("conv_id", page.alias("html")))
    return parsed.select(
        "conv_id",
        elements.find("elements", cls="deep")["text"].alias("by_class"),
        elements.find("elements", "p", attr={"data-t": "1"})["text"].alias("by_attribute"),
        elements.select_one("elements", "#main")["text"].alias("by_id"),
        elements.find("elements", "a", string="yes")["text"].alias("by_string"),
        long(F.size(elements.find_all("elements", "li", cls="item"))).alias("n_class"),
        long(F.size(elements.find_all("elements", attr={"data-k": "v"}))).alias("n_attribute"),
        elements.select_one("elements", "div.box span.in")["text"].alias("by_selector"),
        elements.find("elements", "table")["text"].alias("none"),
        elements.attr_or(elements.find("elements", "img"), "src", "img.example", "data-src").alias("image"),
    )


@query(
    f"""{NOVELS} SELECT conv_id, '<div class="a"><p>' || {ESCAPED.format(x="title")} || '</p><p>b</p></div>' AS without, '<p>' || {ESCAPED.format(x="title")} || '</p>' AS outer, {ESCAPED.format(x="title")} AS inner,
'<html><body><p>' || {ESCAPED.format(x="title")} || '</p></body></html>' AS document, title AS plain, '<div class="a">' || chr(10) || ' <p>' || chr(10) || '  b' || chr(10) || ' </p>' || chr(10) || '</div>' AS pretty FROM n"""
)
def element_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup of elements: outer and inner, without descendants of a tag, wrapped, stripped, in lines."""
    title = html.escape(F.col("title"))
    page = _join('<div class="a"><p>', title, "</p><aside><p>no</p><aside>no</aside></aside><p>b</p></div>")
    parsed = elements.parse(novels(spark, sf_dir).select("conv_id", page.alias("page"), page.alias("html")), markup=True)
    p = elements.find("elements", "p")
    return parsed.select("conv_id", elements.without(F.col("page"), "aside").alias("without"), p["outer_html"].alias("outer"), p["inner_html"].alias("inner"), html.as_document(p["outer_html"]).alias("document"), html.decode(html.strip_tags(p["outer_html"])).alias("plain"), elements.pretty(F.lit("<div class='a'><p> b </p></div>")).alias("pretty"))


# forms of texts and URLs


@query(
    f"""WITH c AS ({CH}) SELECT conv_id, index, sha256(title) || '-' || sha256(role) AS identifier, 'a, b ' || role AS directory, role || index AS slug, 'a<br/><br/>b<br/><br/>c d' AS breaks, 'a<br/><br/>b c' AS lines,
upper(role[1]) || role[2:] AS capital, index % 2 = 0 AS yes, index + 1 AS listed, role || ', ' || index AS joined FROM c"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, names, line breaks, answers and lists of numbers as users type them."""
    role, i = F.col("role"), F.col("index")
    listed = text.parse_int_list(_join("[", i, ", ", i + 1, "]"))
    answer = F.when(i % 2 == 0, F.lit(" Y\n")).otherwise(F.lit("yes"))
    return turns(spark, sf_dir).select(
        "conv_id", "index",
        text.book_identifier(F.col("title"), role).alias("identifier"),
        text.directory_name(_join("a: b? ", role)).alias("directory"),
        text.file_slug(_join(f"{SITE}/", role, "-", i), f"{SITE}/").alias("slug"),
        text.normal_breaks(F.lit("a<br/><br/>b<br/>c\nd")).alias("breaks"),
        text.lines_to_breaks(F.lit("a\n\nb\nc")).alias("lines"),
        text.capitalised(role).alias("capital"),
        text.is_yes(answer).alias("yes"),
        F.get(listed, 1).alias("listed"),
        text.joined_or(F.array(role, i.cast("string"))).alias("joined"),
    )


@query(
    f"""SELECT o_orderkey, '{SITE}/truyen-tranh/x-' || o_orderkey || '-chap-' || (o_orderkey % 50) || CASE o_orderkey % 2 WHEN 0 THEN '' ELSE '-5' END || '.html' AS chapter, (o_orderkey % 50) || '.5' AS fraction,
'{SITE}/g/' || o_orderkey || '/' AS gallery, o_orderkey || '.pdf' AS converted, 'image/png' AS media, o_orderkey % 2 = 0 AS absolute, o_orderkey % 2 = 1 AS code, 'x' AS comic FROM orders"""
)
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and names made from numbers, and what they are."""
    k = F.col("o_orderkey")
    whole = k % 50
    number = F.when(k % 2 == 0, whole.cast("double")).otherwise(whole + 0.5)
    comic = _join(f"{SITE}/truyen-tranh/x-", k)
    url = F.when(k % 2 == 0, _join("http://n.example/", k)).otherwise(k.cast("string"))
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        urls.chapter_url(comic, number).alias("chapter"),
        urls.fractional_chapter_number(whole + 0.5).alias("fraction"),
        urls.gallery_url(F.lit(SITE), k).alias("gallery"),
        urls.with_extension(_join(k, ".cbz"), ".pdf").alias("converted"),
        urls.media_type(_join(k, ".png")).alias("media"),
        urls.is_absolute(url).alias("absolute"),
        urls.is_code(url).alias("code"),
        urls.comic_name(comic).alias("comic"),
    )


@query(f"WITH c AS ({CH}) SELECT conv_id, index, '{SITE}/truyen/x/' || index || '/' AS url FROM c")
def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered page of each chapter, from the range of all numbers."""
    chapters = turns(spark, sf_dir).select("conv_id", "index")
    most = chapters.agg(F.coalesce(F.max("index"), F.lit(1))).first()[0]
    return chapters.join(landed.numbered_urls(spark, 1, most, SITE + "/truyen/x/{}/"), "index").select("conv_id", "index", "url")


# selection and retries


@query(f"WITH c AS ({CH}) SELECT 'number' AS kind, conv_id, index FROM c WHERE index = 2 UNION ALL SELECT 'span', conv_id, index FROM c WHERE index BETWEEN 1 AND 3 UNION ALL SELECT 'link', conv_id, index FROM c WHERE conv_id = 3 AND index = 1 UNION ALL SELECT 'list', conv_id, index FROM c, (VALUES (2), (1), (2)) v(i) WHERE index = v.i")
def select_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selector for a number, a span, a link and a list."""
    rows = turns(spark, sf_dir).select("conv_id", "index", _join(F.col("conv_id"), "/", F.col("index")).alias("url"))
    parts = [collections.select(rows, wanted, "conv_id").select(F.lit(kind).alias("kind"), "conv_id", "index") for kind, wanted in (("number", 2), ("span", "1-3"), ("link", "3/1"), ("list", [2, 1, 2]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH c AS ({CH}), k AS (SELECT conv_id, index, row_number() OVER (PARTITION BY conv_id ORDER BY index) AS place FROM c WHERE NOT (conv_id % 2 = 0 AND index = 1)) SELECT conv_id, index, place FROM k WHERE index <> place")
def misplaced_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of novels whose first chapter is lost, the chapters that stand elsewhere than their number says."""
    rows = turns(spark, sf_dir).where("not (conv_id % 2 = 0 and index = 1)").select("conv_id", "index")
    return collections.misplaced(rows, "conv_id", "index").select("conv_id", "index", long(F.col("place")).alias("place"))


@query("WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, coalesce(arg_min(event_id, n) FILTER (event_type <> 'error' AND n <= 2), -user_id) AS event_id FROM a GROUP BY user_id")
def retry_then_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts, then another source."""
    tried = attempts(spark, sf_dir).withColumn("n", long(F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))))
    other = tried.select("user_id").distinct().select("user_id", (-F.col("user_id")).alias("event_id"))
    return collections.retry_then_other(tried, "user_id", "n", failed(), 2, "event_id", other)


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'retry' WHEN 'view' THEN 'ok' ELSE 'missing' END AS outcome FROM events")
def attempt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", 200).when(kind == "error", 503).otherwise(404)
    return attempts(spark, sf_dir).select("event_id", collections.outcome(status).alias("outcome"))


@query("SELECT event_id, 'Kind ' || event_type AS title FROM events")
def memo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on a key alone is worked out once a key."""
    derived = lambda keys: keys.withColumn("title", _join("Kind ", F.col("event_type")))
    return collections.once_for_each(attempts(spark, sf_dir).select("event_id", "event_type"), "event_type", derived).select("event_id", "title")


# sinks


@query(f"WITH c AS ({CH}) SELECT conv_id, CAST(to_json(list('/t/' || index ORDER BY index)) AS VARCHAR) AS value FROM c GROUP BY conv_id")
def link_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.link_json(turns(spark, sf_dir).select("conv_id", F.col("index").alias("pos"), _join("/t/", F.col("index")).alias("url")), "conv_id")


@query("SELECT event_id, 'Error at fetch ' || event_id || ' /u/' || user_id || ' 503' AS line FROM events WHERE event_type = 'error'")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = attempts(spark, sf_dir).where(failed()).select("event_id", F.lit("fetch").alias("stage"), F.col("event_id").alias("index"), _join("/u/", F.col("user_id")).alias("url"), F.lit("503").alias("error"))
    return failures.select("event_id", sinks.log_line().alias("line"))


@query(f"""{NOVELS} SELECT conv_id, 'Title: ' || title || chr(10) || 'Author: Unknown' || chr(10) || 'Number of Chapters: ' || n || chr(10) || 'Description: ' || text || chr(10) || 'Genres: ' || array_to_string(roles, ', ') || chr(10) || 'Novel URL: ' AS report FROM n""")
def book_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    shown = sinks.report(title=F.col("title"), author=nothing, chapters=F.col("n"), description=F.col("text"), genres=F.col("roles"), url=nothing)
    return novels(spark, sf_dir).select("conv_id", shown.alias("report"))


def _entries(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    """title, entry_name, page of the files with such names in the books of all novels."""
    meta = F.create_map(F.lit("status"), F.lit("done"), F.lit("chapters"), F.col("num_chapters").cast("string"))
    built = archives.build_epub(books(spark, sf_dir).withColumn("meta", meta))
    return landed.unzip(built.select("title", "content"), pattern=pattern).select("title", "entry_name", F.decode("entry_content", "UTF-8").alias("page"))


@query(f"WITH c AS ({CH}) SELECT 'Novel ' || conv_id AS title, 'EPUB/chap_' || index || '.xhtml' AS entry_name, title AS head, 'Chương ' || index || ': ' || title AS heading, 'Chương ' || index || ': ' || title || text AS text FROM c")
def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chapters in the finished files hold."""
    pages = _entries(spark, sf_dir, "EPUB/chap_*")
    parsed = elements.parse(pages, html_col="page", tags=("title", "h1", "body"))
    return parsed.select("title", "entry_name", *[elements.find("elements", tag)["text"].alias(name) for tag, name in (("title", "head"), ("h1", "heading"))], text.strip(elements.find("elements", "body")["text"]).alias("text"))


@query(f"WITH c AS ({CH}) SELECT 'Novel ' || conv_id AS title, 'author' AS creator, 'vi' AS language, 'done' AS status, CAST(count(*) AS VARCHAR) AS chapters, count(*) + 4 AS n_items, count(*) + CASE WHEN count(*) <= 100 THEN 2 ELSE 1 END AS n_spine, sha256('Novel ' || conv_id) || '-' || sha256('author') AS identifier FROM c GROUP BY conv_id")
def epub_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the finished files say of themselves: metadata, further metadata, contents and reading order."""
    found = elements.parse(_entries(spark, sf_dir, "EPUB/content.opf").select("title", "page"), html_col="page")
    text_of = lambda tag: elements.find("elements", tag)["text"]
    meta = lambda name: elements.attr(elements.find("elements", "meta", attr={"name": name}), "content")
    count = lambda tag: long(F.size(elements.find_all("elements", tag)))
    return found.select("title", text_of("dc:creator").alias("creator"), text_of("dc:language").alias("language"), meta("status").alias("status"), meta("chapters").alias("chapters"), count("item").alias("n_items"), count("itemref").alias("n_spine"), text_of("dc:identifier").alias("identifier"))


@query("SELECT 'Novel ' || conv_id AS title, 'Novel ' || conv_id AS heading, 'Tác giả: author' AS author, 'Số chương: ' || count(*) AS chapters, 'Thể loại: Khác' AS genres FROM conversations GROUP BY conv_id")
def epub_intro(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = elements.parse(_entries(spark, sf_dir, "EPUB/intro.xhtml").select("title", "page"), html_col="page", tags=("h1", "p"))
    line = lambda start: F.get(F.filter("elements", lambda e: e["text"].startswith(start)), 0)["text"]
    return found.select("title", elements.find("elements", "h1")["text"].alias("heading"), line("Tác giả").alias("author"), line("Số chương").alias("chapters"), line("Thể loại").alias("genres"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", _join(F.col("index"), ".png").alias("name"), F.lit(PNG).alias("content"))


def _pdf_pages(built: DataFrame) -> DataFrame:
    body = F.decode("content", "ISO-8859-1")
    return built.select("conv_id", "n_entries", long(F.regexp_count(body, F.lit("/Type /Page "))).alias("n_pages"), body.startswith("%PDF-").alias("is_pdf"))


@query("SELECT conv_id, count(*) AS n_entries, count(*) AS n_pages, true AS is_pdf FROM conversations GROUP BY conv_id")
def pdf_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf_pages(archives.build_pdf(_images(spark, sf_dir), "conv_id"))


@query("SELECT conv_id, count(*) - 1 AS n_entries, count(*) - 1 AS n_pages, true AS is_pdf FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def cbz_to_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives without their first image, as PDF files."""
    built = archives.build_cbz(_images(spark, sf_dir), "conv_id", drop_first=True)
    return _pdf_pages(archives.cbz_to_pdf(built.select("conv_id", "content"), "conv_id"))


@query(f"WITH c AS ({CH}) SELECT conv_id, index, CASE WHEN index % 2 = 0 THEN text END AS found FROM c")
def landed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with the file that landed at their path, if one did."""
    rows = turns(spark, sf_dir).withColumn("image", _join(F.col("conv_id"), "/", F.col("index"), ".txt"))
    files = rows.where("index % 2 = 0").select(F.col("image").alias("path"), F.col("text").cast("binary").alias("content"))
    return landed.with_files(rows, files, "image").select("conv_id", "index", F.decode("file_content", "UTF-8").alias("found"))


@query("SELECT conv_id || '.cbz' AS name, count(*) AS n_entries FROM conversations GROUP BY conv_id")
def written_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written by the tasks that build them, and the entries of the files read back."""
    folder = shared_path(spark, "archives")
    built = archives.build_cbz(_images(spark, sf_dir), "conv_id")
    archives.write_files(built.select(_join(F.col("conv_id"), ".cbz").alias("file"), "content"), folder, "file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cbz").load(folder)
    return landed.unzip(files.select(urls.last_segment(F.col("path")).alias("name"), "content")).groupBy("name").agg(F.count("*").alias("n_entries"))
