"""A page of each layout."""

import pytest

from quire.operators import elements, records

BASE = "https://n.example"
INFO = """<div class="book-info"><img itemprop="image" src="/c.jpg"><span itemprop="name">T</span><a itemprop="author">A</a></div>
<ul><li class="li--genres"><a>x</a><a>y</a></li></ul><p>Số chương: 12</p><div itemprop="description"><p>d</p></div>
<a href="/1">Chương 1</a><a href="/12">Chương cuối</a>"""
TABLE = "<table>" + "".join(f"<tr><td>k</td><td> {v} </td></tr>" for v in ("0", "T", "A", "3", "<a>g</a><a> h </a>", "done")) + '</table><div class="bai-viet-box"></div><div class="bai-viet-box"><a>1</a><a>2</a></div>'
CARDS = f'<h1 class="big mb-2">T</h1><a class="text-gray-500"> A </a><a class="{records.STATUS_CLASS}"><svg></svg><span> on </span></a><a class="{records.ATTRIBUTE_CLASS}">q</a><img class="{records.IMAGE_CLASS}" src="i.jpg">'


@pytest.fixture
def pages(spark):
    def make(*rows, schema="url string, html string"):
        return elements.parse(spark.createDataFrame(list(rows), schema), markup=True)

    return make


def test_novels(pages):
    r = records.novel_info(pages((f"{BASE}/t", INFO))).first()
    assert (r["title"], r["author"], r["cover_image"], r["num_chapters"], r["genres"], r["start_chapter"], r["end_chapter"]) == ("T", "A", f"{BASE}/c.jpg", 12, ["x", "y"], "/1", "/12")
    assert r["description"] == '<div itemprop="description"><p>d</p></div>'
    r = records.novel_table(pages((f"{BASE}/t", TABLE))).first()
    assert (r["title"], r["author"], r["genres"], r["status"], r["num_chapters"]) == ("T", "A", ["g", "h"], "done", 3)
    r = records.novel_table(pages((f"{BASE}/t", "<table><tr><td>0</td></tr></table>"))).first()
    assert (r["title"], r["genres"], r["status"]) == ("Unknown Title", [], "Unknown Status")
    r = records.novel_cards(pages((f"{BASE}/t", CARDS))).first()
    assert tuple(r) == ("T", "A", "on", "q", "i.jpg")
    shell = '<html><head><title>\n  App </title></head><body><div id="app"></div></body></html>'
    assert all(x is None for k, x in records.novel_info(pages((f"{BASE}/t", shell))).first().asDict().items() if k not in ("novel_url", "genres"))


def test_chapters(pages):
    page = '<h2 class="x current-chapter"> One </h2><div class="truyen"><p>a<img src="i"></p></div><a class="next" href="/2">n</a>'
    r = records.chapter(pages((f"{BASE}/1", page))).first()
    assert (r["title"], r["next"]) == ("One", f"{BASE}/2")
    assert r["content"] == '<div class="truyen">\n <p>\n  a\n  <img src="i"/>\n </p>\n</div>'
    numbered = pages((f"{BASE}/7", '<div class="ndtruyen"><img src="i">a</div>', 7), (f"{BASE}/8", "<p>gone</p>", 8), schema="url string, html string, index long")
    assert [tuple(r) for r in records.numbered_chapter(numbered).collect()] == [(7, "Chương 7", '<div class="ndtruyen">\n a\n</div>')]
    card = f'<h2 class="{records.HEADING_CLASS}">T</h2><div class="break-words">{"a<br>" * 8}</div>'
    rows = records.card_chapter(pages((f"{BASE}/1", card), (f"{BASE}/2", "<div class='break-words'></div>"))).collect()
    assert [(r["url"], r["truncated"]) for r in rows] == [(f"{BASE}/1", True)]


def test_comics(pages):
    index = '<a target="_self" href="/b">2</a><a target="_self" href="/a">1</a><a href="/c">x</a>'
    assert [(r["pos"], r["link"]) for r in records.comic_chapters(pages((BASE, index))).orderBy("pos").collect()] == [(0, "/a"), (1, "/b")]
    images = '<img class="lazy" src="1.jpg"><img src="ad.jpg"><img class="lazy x" src="2.jpg">'
    assert [tuple(r) for r in records.chapter_images(pages((f"{BASE}/x-chap-3-5.html", images))).orderBy("pos").collect()] == [("3.5", 0, "1.jpg"), ("3.5", 1, "2.jpg")]


def test_galleries(pages):
    thumbs = '<h1 class="title"> A:  b </h1><div class="thumb-container"><a href="/g/1/1/">1</a></div><div class="thumb-container"><a href="/g/1/2/">2</a></div>'
    viewers = pages((f"{BASE}/g/1/2/", '<section id="image-container"><a><img src="//i.example/2.png"></a></section>'))
    found = records.gallery(pages((f"{BASE}/g/1/", thumbs)))
    assert [r["viewer"] for r in found.orderBy("pos").collect()] == [f"{BASE}/g/1/1/", f"{BASE}/g/1/2/"]
    assert [tuple(r) for r in records.gallery_images(found, viewers).collect()] == [(f"{BASE}/g/1/", "A b", 1, "https://i.example/2.png")]
