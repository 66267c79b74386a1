"""Sinks of binary files, one a group: CBZ, PDF and EPUB, built with the standard library."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import CHAPTER, COVER, INTRO, NO_DESCRIPTION, OTHER
from quire.sources import pdf
from quire.sources.file_store import TIME, save_files
from quire.sources.shared import small_batches


def zip_bytes(entries: Sequence[tuple[str, bytes]], stored: Sequence[str] = ()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name, TIME), data, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def first_number(name: str) -> int:
    found = re.search(r"\d+", name)
    if not found:
        raise ValueError(f"no number in {name}")
    return int(found[0])


def _grouped(files: DataFrame, key: str, build, order: str | None, lexicographic: bool, drop_first: bool) -> DataFrame:
    kind = files.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if order:
            rows.sort(key=lambda r: r[order])
        else:
            rows.sort(key=lambda r: r["name"] if lexicographic else (first_number(r["name"]), r["name"]))
        rows = rows[1:] if drop_first else rows
        if not rows:
            return pa.table({key: table.column(key).slice(0, 0), "n_entries": pa.array([], pa.int64()), "content": pa.array([], pa.binary())})
        return pa.table({key: table.column(key).slice(0, 1), "n_entries": pa.array([len(rows)], pa.int64()), "content": pa.array([build(rows)], pa.binary())})

    return files.groupBy(key).applyInArrow(run, f"`{key}` {kind}, n_entries long, content binary")


def build_cbz(files: DataFrame, key: str, order: str | None = None, drop_first: bool = False) -> DataFrame:
    """(key, n_entries, content) of files (key, name, content): by first number in the name, or by a column. A group that is empty has no archive."""
    return _grouped(files, key, lambda rows: zip_bytes([(r["name"], bytes(r["content"])) for r in rows]), order, False, drop_first)


def build_pdf(files: DataFrame, key: str, order: str | None = None, drop_first: bool = False, lexicographic: bool = False) -> DataFrame:
    """Likewise PDF files of images; lexicographic order by name puts page 10 before page 2."""
    return _grouped(files, key, lambda rows: pdf.write([bytes(r["content"]) for r in rows]), order, lexicographic, drop_first)


def cbz_to_pdf(archives: DataFrame, key: str, lexicographic: bool = False) -> DataFrame:
    """PDF files of archives (key, content)."""
    from quire.functions import urls
    from quire.sources.landed import unzip

    entries = unzip(archives.select(key, "content")).where(urls.is_image(F.col("entry_name"), bmp=True))
    return build_pdf(entries.select(key, F.col("entry_name").alias("name"), F.col("entry_content").alias("content")), key, lexicographic=lexicographic)


STYLE = "body { font-family: serif; line-height: 1.5; margin: 5%; }\nh1, h2 { margin: 1.2em 0 0.6em; }\nimg { max-width: 100%; }\n"


def _page(title: str, body: str) -> bytes:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<head><title>{html.escape(title)}</title><link href="style.css" rel="stylesheet" type="text/css"/></head>\n<body>{body}</body>\n</html>\n'.encode()


def intro_page(book: dict) -> str:
    genres = ", ".join(book["genres"]) if book.get("genres") else OTHER
    url = html.escape(book.get("novel_url") or "")
    return (
        f"<h1>{html.escape(book['title'] or '')}</h1><p>Tác giả: {html.escape(book.get('author') or '')}</p><p>Số chương: {book.get('num_chapters') or 0}</p>"
        f"<p>Mô tả: {book.get('description') or NO_DESCRIPTION}</p><p>Thể loại: {html.escape(genres)}</p>"
        f'<p>Link truyện: <a href="{url}">{url}</a></p>'
    )


def chapter_heading(index: int, title: str) -> str:
    return title if CHAPTER in title else f"{CHAPTER} {index}: {title}"


def epub_bytes(book: dict, chapters: Sequence[dict], cover: bytes | None = None) -> bytes:
    """A book of its record and its chapters in order: cover if there is one, introduction, contents if it has at most 100 chapters, chapters."""
    items: list[tuple[str, str, str, bytes]] = [("style", "style.css", "text/css", STYLE.encode())]
    toc, spine = [], []
    if cover:
        name = (book.get("cover_image") or "cover.jpg").split("/")[-1]
        items.append(("cover-image", name, f"image/{name.split('.')[-1]}", cover))
        items.append(("cover", "cover.xhtml", "application/xhtml+xml", _page(COVER, f'<div id="cover"><img src="{html.escape(name)}" alt="Cover Image"/></div>')))
        toc.append(("cover.xhtml", COVER))
        spine.append("cover")
    items.append(("intro", "intro.xhtml", "application/xhtml+xml", _page(INTRO, intro_page(book))))
    toc.append(("intro.xhtml", INTRO))
    spine.append("intro")
    if (book.get("num_chapters") or 0) <= 100:
        spine.append("nav")
    for c in chapters:
        title = c.get("title") or ""
        body = f'<div class="chapter" id="chapter-{c["index"]}"><h1>{html.escape(chapter_heading(c["index"], title))}</h1></div>{c.get("content") or ""}'
        items.append((f"chap_{c['index']}", f"chap_{c['index']}.xhtml", "application/xhtml+xml", _page(title, body)))
        toc.append((f"chap_{c['index']}.xhtml", title))
        spine.append(f"chap_{c['index']}")
    listed = "".join(f'<li><a href="{html.escape(f)}">{html.escape(t)}</a></li>' for f, t in toc)
    points = "".join(f'<navPoint id="p{i}"><navLabel><text>{html.escape(t)}</text></navLabel><content src="{html.escape(f)}"/></navPoint>' for i, (f, t) in enumerate(toc))
    title, author, mark = html.escape(book["title"] or ""), html.escape(book.get("author") or ""), html.escape(book.get("identifier") or book["title"] or "")
    subjects = "".join(f"<dc:subject>{html.escape(g)}</dc:subject>" for g in book.get("genres") or [])
    metas = "".join(f'<meta name="{html.escape(k)}" content="{html.escape(str(v))}"/>' for k, v in (book.get("meta") or {}).items())
    manifest = "".join(f'<item id="{i}" href="{html.escape(f)}" media-type="{m}"/>' for i, f, m, _ in items)
    opf = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{mark}</dc:identifier><dc:title>{title}</dc:title><dc:language>vi</dc:language><dc:creator>{author}</dc:creator>'
        f"<dc:description>{html.escape(book.get('description') or NO_DESCRIPTION)}</dc:description>{subjects}{metas}</metadata>"
        f'<manifest>{manifest}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest>'
        f'<spine toc="ncx">{"".join(f"""<itemref idref="{s}"/>""" for s in spine)}</spine></package>\n'
    )
    ncx = f'<?xml version="1.0" encoding="UTF-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{mark}"/></head><docTitle><text>{title}</text></docTitle><navMap>{points}</navMap></ncx>\n'
    nav = _page(book["title"] or "", f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{listed}</ol></nav>')
    container = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'
    entries = [("mimetype", b"application/epub+zip"), ("META-INF/container.xml", container.encode()), ("EPUB/content.opf", opf.encode()), ("EPUB/toc.ncx", ncx.encode()), ("EPUB/nav.xhtml", nav)]
    return zip_bytes([*entries, *((f"EPUB/{f}", data) for _, f, _, data in items)], stored=["mimetype"])


def build_epub(novels: DataFrame) -> DataFrame:
    """(title, n_entries, content) of novels with nested chapters: one book must fit in a task. A column meta (map) becomes the book's further metadata."""
    small_batches(novels.sparkSession)
    fields = [c for c in ("title", "author", "description", "genres", "novel_url", "num_chapters", "cover_image", "identifier", "chapters", "cover", "meta") if c in novels.columns]

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # one book at a time in Python
                chapters = row.get("chapters") or []
                data = epub_bytes(row | {"meta": dict(row.get("meta") or [])}, chapters, row.get("cover"))
                yield pa.RecordBatch.from_arrays([pa.array([row["title"]], pa.string()), pa.array([len(chapters)], pa.int64()), pa.array([data], pa.binary())], ["title", "n_chapters", "content"])

    return novels.select(*fields).mapInArrow(run, "title string, n_chapters long, content binary")


def book_items(books: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """The rows of each book's contents and reading order: (key, pos, kind, file_name, title, in_toc, in_spine) from books (key, num_chapters, has_cover) and chapters (key, index, title)."""
    shown = lambda kind, pos, file, title, toc, spine: books.select(key, F.lit(pos).cast("long").alias("pos"), F.lit(kind).alias("kind"), F.lit(file).alias("file_name"), F.lit(title).alias("title"), F.lit(toc).alias("in_toc"), spine.alias("in_spine"))
    cover = shown("cover", 0, "cover.xhtml", COVER, True, F.lit(True)).join(books.where("has_cover").select(key), key, "left_semi")
    intro = shown("intro", 1, "intro.xhtml", INTRO, True, F.lit(True))
    nav = shown("nav", 2, "nav.xhtml", "", False, F.col("num_chapters") <= 100)
    rows = chapters.select(key, (F.col("index") + 2).cast("long").alias("pos"), F.lit("chapter").alias("kind"), F.concat(F.lit("chap_"), F.col("index").cast("string"), F.lit(".xhtml")).alias("file_name"), "title", F.lit(True).alias("in_toc"), F.lit(True).alias("in_spine"))
    return cover.unionByName(intro).unionByName(nav).unionByName(rows)


def write_files(built: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes each row's content to folder/name in the tasks that hold it; (name, path, n_bytes) of what was written.

    Names are given when all tasks are done, so a job that fails leaves no file; a file of the same name gives way.
    """
    return save_files(built.select(F.col(name).cast("string").alias("name"), "content"), folder)


def write_pretty(pages: DataFrame, folder: str, name: str, markup: str = "html") -> DataFrame:
    """Writes pages with each tag on a line of its own, one file a page."""
    from quire.operators.elements import pretty

    return write_files(pages.select(F.col(name).alias("name"), pretty(markup).cast("binary").alias("content")), folder, "name")


def convert_folder(spark: SparkSession, folder: str, lexicographic: bool = False) -> DataFrame:
    """(path, n_entries, content): a PDF for each CBZ file below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.cbz").load(folder)
    return cbz_to_pdf(found.select("path", "content"), "path", lexicographic)
