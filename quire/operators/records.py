"""Records of novels, chapters and galleries, projected from parsed pages of the known layouts.

Each function takes pages with `url` and `elements` (parsed with markup) and gives a row a page, or a row an item. Fields whose
element is missing are null, or have the default that the layout names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import html, text, urls
from quire.operators.elements import attr, find, find_all, nth, page_text, pretty, within

#: Fixed texts of the layouts.
FIRST, LAST, COUNT = "Chương 1", "Chương cuối", "Số chương: ([0-9]+)"


def _texts(found: Column) -> Column:
    return F.transform(found, lambda e: text.strip(e["text"]))


def novel_info(pages: DataFrame) -> DataFrame:
    """The layout with div.book-info and itemprop attributes."""
    info = within("elements", find("elements", "div", cls="book-info"))
    count = F.nullif(F.regexp_extract(page_text("elements"), COUNT, 1), F.lit(""))
    genres = find_all(within("elements", find("elements", "li", cls="li--genres")), "a")
    return pages.select(
        find(info, attr={"itemprop": "name"})["text"].alias("title"),
        find(info, attr={"itemprop": "author"})["text"].alias("author"),
        urls.resolve(urls.base_url(F.col("url")), attr(find(info, "img", attr={"itemprop": "image"}), "src")).alias("cover_image"),
        count.cast("long").alias("num_chapters"),
        find("elements", "div", attr={"itemprop": "description"})["outer_html"].alias("description"),
        F.transform(genres, lambda e: e["text"]).alias("genres"),
        F.col("url").alias("novel_url"),
        attr(find("elements", "a", string=FIRST), "href").alias("start_chapter"),
        attr(find("elements", "a", string=LAST), "href").alias("end_chapter"),
    )


def novel_table(pages: DataFrame) -> DataFrame:
    """The layout with a table: rows 1, 2, 4 and 5 hold title, author, genres and status; chapters are the second box's links and one."""
    rows = find_all("elements", "tr")
    cell = lambda n: nth(find_all(within("elements", nth(rows, n)), "td"), 1)
    known = lambda n, default: F.coalesce(text.strip(cell(n)["text"]), F.lit(default))
    box = nth(find_all("elements", "div", cls="bai-viet-box"), 1)
    empty = F.expr("cast(array() as array<string>)")
    return pages.select(
        known(1, "Unknown Title").alias("title"),
        known(2, "Unknown Author").alias("author"),
        F.coalesce(_texts(find_all(within("elements", cell(4)), "a")), empty).alias("genres"),
        known(5, "Unknown Status").alias("status"),
        (F.size(find_all(within("elements", box), "a")) + 1).cast("long").alias("num_chapters"),
        F.col("url").alias("novel_url"),
    )


#: Class attributes of the third layout.
TITLE_CLASS, AUTHOR_CLASS = "mb-2", "text-gray-500"
STATUS_CLASS = "inline-flex border border-primary rounded px-2 py-1 text-primary"
ATTRIBUTE_CLASS = "inline-flex border border-rose-700 dark:border-red-400 rounded px-2 py-1 text-rose-700 dark:text-red-400"
IMAGE_CLASS = "w-44 h-60 shadow-lg rounded mx-auto"
HEADING_CLASS, BODY_CLASS = "text-center text-gray-600 dark:text-gray-400 text-balance", "break-words"


def novel_cards(pages: DataFrame) -> DataFrame:
    """The layout with utility classes: title, author, status, attribute, image_url."""
    status = find("elements", "a", cls=STATUS_CLASS)
    return pages.select(
        find("elements", "h1", cls=TITLE_CLASS)["text"].alias("title"),
        text.strip(find("elements", "a", cls=AUTHOR_CLASS)["text"]).alias("author"),
        text.strip(find(within("elements", status), "span")["text"]).alias("status"),
        find("elements", "a", cls=ATTRIBUTE_CLASS)["text"].alias("attribute"),
        attr(find("elements", "img", cls=IMAGE_CLASS), "src").alias("image_url"),
    )


def chapter(pages: DataFrame) -> DataFrame:
    """title, content and the next link of a chapter page."""
    return pages.select(
        "url",
        text.strip(find("elements", cls="current-chapter")["text"]).alias("title"),
        pretty(find("elements", "div", cls="truyen")["outer_html"]).alias("content"),
        urls.resolve(urls.base_url(F.col("url")), attr(find("elements", cls="next"), "href")).alias("next"),
    )


def numbered_chapter(pages: DataFrame) -> DataFrame:
    """index, title and content, without images, of chapter pages with an index; pages that aren't there leave a gap."""
    body = find("elements", "div", cls="ndtruyen")["outer_html"]
    title = F.coalesce(text.strip(find("elements", "title")["text"]), F.concat(F.lit(f"{text.CHAPTER} "), F.col("index").cast("string")))
    return pages.select("index", title.alias("title"), pretty(html.drop_elements(body, "img")).alias("content")).where("content is not null")


def card_chapter(pages: DataFrame) -> DataFrame:
    """title_html, html, truncated of the layout with utility classes; a page without either element is dropped."""
    body, title = find("elements", "div", cls=BODY_CLASS)["outer_html"], find("elements", "h2", cls=HEADING_CLASS)["outer_html"]
    rows = pages.select("url", title.alias("title_html"), body.alias("html"), text.is_truncated(body).alias("truncated"))
    return rows.where("html is not null and title_html is not null")


def comic_chapters(pages: DataFrame) -> DataFrame:
    """url, pos and link of a comic's chapters, oldest first: the page lists them newest first."""
    links = F.transform(find_all("elements", "a", attr={"target": "_self"}), lambda e: attr(e, "href"))
    return pages.select("url", F.posexplode(F.reverse(links)).alias("pos", "link"))


def chapter_images(pages: DataFrame) -> DataFrame:
    """chapter_num, pos and url of a comic chapter's images."""
    links = F.transform(find_all("elements", "img", cls="lazy"), lambda e: attr(e, "src"))
    return pages.select(urls.chapter_number(F.col("url")).alias("chapter_num"), F.posexplode(links).alias("pos", "url"))


def gallery(pages: DataFrame) -> DataFrame:
    """url, name, pos, viewer: a row for each thumbnail of a gallery, with the page it leads to."""
    base = urls.base_url(F.col("url"))
    thumbs = F.transform(find_all("elements", "div", cls="thumb-container"), lambda t: attr(find(within("elements", t), "a"), "href"))
    name = text.clean_filename(find("elements", "h1", cls="title")["text"])
    return pages.select("url", name.alias("name"), base.alias("base"), F.posexplode(thumbs).alias("pos", "href")).select("url", "name", "pos", urls.resolve(F.col("base"), F.col("href")).alias("viewer"))


def gallery_images(galleries: DataFrame, viewers: DataFrame) -> DataFrame:
    """url, name, pos, image: each thumbnail's page joined, and its image's address; pages that aren't landed leave a gap."""
    src = attr(find(within("elements", find("elements", attr={"id": "image-container"})), "img"), "src")
    landed = viewers.select(F.col("url").alias("viewer"), urls.resolve(urls.base_url(F.col("url")), src).alias("image"))
    return galleries.join(landed, "viewer").select("url", "name", "pos", "image")
