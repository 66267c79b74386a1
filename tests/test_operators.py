"""Elements, selection, links, snapshots, retries and archives on small fixtures."""

import io
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import collections, elements, links, records
from quire.sources import archives, landed, pdf, sinks

PAGE = """<html><head><title>Two &amp; two</title><script>var x = "<p>no</p>";</script></head><body>
<div class="box first"><a href="/1" target="_self">One</a><a target="_self">Two</a></div>
<div id="image-container"><img class="lazy big" src="x" data-src="y"><p>a<b>b</p><p>c</p></div>
<a href="/end">Chương cuối</a></body></html>"""


def one(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def parsed(spark):
    return elements.parse(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string"), markup=True)


def pick(parsed, column):
    return one(parsed.where("id = 1").select(column))


def test_selectors(parsed):
    assert pick(parsed, elements.find("elements", "title")["text"]) == "Two & two"
    assert pick(parsed, F.size(elements.find_all("elements", "a", attr={"target": "_self"}))) == 2
    assert pick(parsed, elements.find("elements", "div", cls="first")["text"]) == "OneTwo"
    assert pick(parsed, elements.find("elements", cls="big")["tag"]) == "img"
    assert pick(parsed, elements.find("elements", "div", cls="fir")) is None
    assert pick(parsed, elements.attr(elements.find("elements", "a", string="Chương cuối"), "href")) == "/end"
    scope = elements.find("elements", attr={"id": "image-container"})
    assert pick(parsed, elements.attr(elements.find(elements.within("elements", scope), "img"), "src")) == "x"
    assert pick(parsed, elements.attr_or(elements.find("elements", "img"), "src", "cdn.example", "data-src")) == "y"
    assert pick(parsed, elements.attr(elements.nth(elements.find_all("elements", "a"), 1), "href")) is None
    assert pick(parsed, elements.nth(elements.find_all("elements", "a"), 9)) is None
    assert pick(parsed, elements.select_one("elements", "#image-container p b")["text"]) == "b"
    assert pick(parsed, elements.select_one("elements", "div.first a")["outer_html"]) == '<a href="/1" target="_self">One</a>'
    assert pick(parsed, F.size(elements.find_all("elements", "p"))) == 2
    assert pick(parsed, elements.find("elements", "title")["inner_html"]) == "Two &amp; two"
    assert one(parsed.where("id = 2").select("elements")) is None
    assert one(parsed.where("id = 3").select(F.size("elements"))) == 0


def test_strict_selectors_raise(parsed):
    with pytest.raises(Exception, match="no attribute href"):
        pick(parsed, elements.attr(elements.nth(elements.find_all("elements", "a"), 1), "href", strict=True))
    with pytest.raises(Exception, match="(?i)index"):
        pick(parsed, elements.nth(elements.find_all("elements", "a"), 9, strict=True))


def test_selection(spark):
    chapters = spark.createDataFrame([("n", 1, "a"), ("n", 2, "b"), ("n", 3, "c"), ("n", 3, "d")], "novel string, index long, title string")
    got = collections.select_list(chapters, [3, 1, 3, 99], "novel", order="title").orderBy("request_pos").collect()
    assert [(r["request_pos"], r["title"]) for r in got] == [(0, "c"), (1, "a"), (2, "c")]
    assert collections.select_range(chapters, 2, 3).count() == 3
    for start, end in ((0, 2), (3, 2)):
        with pytest.raises(ValueError, match="range"):
            collections.select_range(chapters, start, end)
    assert [r["title"] for r in collections.first_of(chapters, ["index"], "title").orderBy("index").collect()] == ["a", "b", "c"]
    with pytest.raises(Exception, match="no such link"):
        one(spark.range(1).select(collections.position(F.array(F.lit("a")), F.lit("b"), strict=True)))


def test_pages_sort_by_number(spark):
    files = spark.createDataFrame([("c", n) for n in ("10.jpg", "2.jpg", "1.jpg")], "chapter string, name string")
    natural = [r["name"] for r in collections.page_ranks(files, ["chapter"], "name").orderBy("page").collect()]
    assert natural == ["1.jpg", "2.jpg", "10.jpg"]
    assert [r["name"] for r in collections.page_ranks(files, ["chapter"], "name", lexicographic=True).orderBy("page").collect()] == ["1.jpg", "10.jpg", "2.jpg"]
    assert [r["name"] for r in collections.page_ranks(files, ["chapter"], "name", drop_first=True).orderBy("page").collect()] == ["2.jpg", "10.jpg"]


def test_walk_stops_at_the_end_and_at_the_bound(spark):
    chain = spark.createDataFrame([(f"u{i}", f"u{i + 1}" if i < 8 else None) for i in range(9)], "url string, next string")
    seeds = spark.createDataFrame([("s", "u0"), ("t", "u6")], "seed string, url string")
    got = {(r["seed"], r["hop"], r["url"]) for r in links.walk(chain, seeds, 5).collect()}
    assert got == {("s", i, f"u{i}") for i in range(5)} | {("t", i, f"u{6 + i}") for i in range(3)}


def test_long_walk_has_a_small_plan(spark):
    chain = spark.range(1100).select(F.col("id").cast("string").alias("url"), F.when(F.col("id") < 1099, (F.col("id") + 1).cast("string")).alias("next"))
    walked = links.walk(chain.unionByName(chain), spark.createDataFrame([("s", "0")], "seed string, url string"), 1000)
    assert walked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert {(r["hop"], r["url"]) for r in walked.collect()} == {(i, str(i)) for i in range(1000)} and walked.count() == 1000


def test_selector_and_places(spark):
    rows = spark.createDataFrame([("a", i, f"http://x/{i}") for i in (1, 2, 3, 5)], "k string, index long, url string")
    got = lambda wanted: [r["index"] for r in collections.select(rows, wanted, "k").collect()]
    assert sorted(got("all")) == [1, 2, 3, 5] and got(2) == [2] and got("3") == [3] and sorted(got("2-5")) == [2, 3, 5]
    assert got("http://x/5") == [5] and sorted(got([5, 1, 9])) == [1, 5]
    assert [(r["index"], r["place"]) for r in collections.misplaced(rows, "k", "index").collect()] == [(5, 4)]
    with pytest.raises(ValueError, match="not a range"):
        collections.select_range(rows, 1, 6, count=5)


def test_epub_metadata(spark):
    book = spark.createDataFrame([("T", {"status": "done", "attribute": "x"}, [(1, "c", "<p>y</p>")])], "title string, meta map<string,string>, chapters array<struct<index:long,title:string,content:string>>")
    data = archives.build_epub(book).first()["content"]
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        opf = z.read("EPUB/content.opf").decode()
    assert '<meta name="status" content="done"/>' in opf and '<meta name="attribute" content="x"/>' in opf


def test_retries(spark):
    rows = spark.createDataFrame([("a", i, f) for i, f in enumerate("FFFFFSFF")], "k string, n long, s string")
    failed = F.col("s") == "F"
    assert [r["streak"] for r in collections.streaks(rows, "k", ["n"], failed).orderBy("n").collect()] == [1, 2, 3, 4, 5, 0, 1, 2]
    assert [r["n"] for r in collections.given_up(rows, "k", ["n"], failed, 5).collect()] == [4]
    assert collections.first_good(rows, "k", "n", failed, 4).first()["attempt"] is None
    assert collections.first_good(rows, "k", "n", failed, 10).first()["attempt"] == 5
    assert [one(spark.range(1).select(collections.outcome(F.lit(s)))) for s in (200, 404, 500)] == ["ok", "missing", "retry"]


def test_snapshots(spark):
    schema = "title string, author string, num_chapters long, start_chapter string, end_chapter string, chapter_links array<string>"
    fresh = spark.createDataFrame([("new", "a", 2, "1", "2", None), ("same", "a", 2, "1", "2", None), ("gap", "a", 2, "1", "2", None), ("grown", "a", 3, "1", "3", None), ("moved", "a", 2, "0", "2", None)], schema)
    stored = spark.createDataFrame([("same", "a", 2, "1", "2", ["1", "2"]), ("gap", "a", 2, "1", "2", ["1"]), ("grown", "a", 2, "1", "2", ["1", "2"]), ("moved", "a", 2, "1", "2", ["1", "2"])], schema)
    got = {r["title"]: r["outcome"] for r in links.merge_snapshots(fresh, stored).collect()}
    assert got == {"new": "create", "same": "reuse", "gap": "rebuild_links", "grown": "extend", "moved": "rebuild_all"}
    assert one(spark.range(1).select(links.extend(F.array(*map(F.lit, "abc")), F.lit("b"), F.array(F.lit("x"))))) == ["a", "b", "x"]
    merged = links.upsert(stored.select("title", "num_chapters"), fresh.where("title = 'same'").select("title", "num_chapters"), ["title"])
    assert merged.count() == 4


def images():
    png = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes([8, 6, 0, 0, 0])), (b"IDAT", zlib.compress(bytes([0, 255, 0, 0, 255, 0, 255, 0, 0]))), (b"IEND", b"")):
        png += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0x80, 0, 0, 1, 2, 3, 0, 0, 0]) + bytes([0x2C, 0, 0, 0, 0, 1, 0, 1, 0, 0, 2, 2, 0x44, 1, 0, 0x3B])
    jpeg = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x01\x00\x02\x01\x01\x11\x00\xff\xd9"
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes([1, 0, 24, 0]) + bytes(24) + bytes([3, 2, 1, 0])
    return {"1.png": png, "2.gif": gif, "3.jpg": jpeg, "10.bmp": bmp}


def test_pdf_images():
    found = {name: pdf.image(data) for name, data in images().items()}
    assert [found[n][:2] for n in found] == [(2, 1), (1, 1), (2, 1), (1, 1)]
    assert zlib.decompress(found["1.png"][3]) == bytes([255, 0, 0, 255, 255, 255])
    assert zlib.decompress(found["2.gif"][3]) == bytes([1, 2, 3])
    assert zlib.decompress(found["10.bmp"][3]) == bytes([1, 2, 3])
    book = pdf.write(list(images().values()))
    assert book.startswith(b"%PDF-1.4") and book.count(b"/Type /Page ") == 4


def test_cbz_pdf_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("c", n, bytearray(d)) for n, d in images().items()], "chapter string, name string, content binary")
    cbz = archives.build_cbz(files, "chapter", drop_first=True)
    with zipfile.ZipFile(io.BytesIO(bytes(cbz.first()["content"]))) as z:
        assert z.namelist() == ["2.gif", "3.jpg", "10.bmp"]
    assert archives.build_cbz(files.where("name = '1.png'"), "chapter", drop_first=True).count() == 0
    assert archives.cbz_to_pdf(archives.build_cbz(files, "chapter").select("chapter", "content"), "chapter").first()["n_entries"] == 4
    paths = archives.write_files(cbz.withColumn("name", F.lit("c.cbz")), f"file://{tmp_path}/out", "name")
    assert landed.list_files(spark, f"file://{tmp_path}/out", "*.cbz").count() == paths.count() == 1
    assert archives.convert_folder(spark, f"file://{tmp_path}/out").first()["n_entries"] == 3


def test_epub(spark):
    book = {"title": "T", "author": "A", "genres": [], "num_chapters": 2, "identifier": "i", "cover_image": "x/c.png"}
    data = archives.epub_bytes(book, [{"index": 2, "title": "Chương 2", "content": "<p>x</p>"}, {"index": 1, "title": "t", "content": ""}], b"img")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        opf = z.read("EPUB/content.opf").decode()
        assert opf.index('idref="chap_2"') < opf.index('idref="chap_1"') and 'idref="nav"' in opf
        assert "<h1>Chương 1: t</h1>" in z.read("EPUB/chap_1.xhtml").decode()
        assert "Khác" in z.read("EPUB/intro.xhtml").decode()
    assert 'idref="nav"' not in archives.epub_bytes(book | {"num_chapters": 101}, []).decode("latin-1")


def test_files_and_logs(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert landed.read_or_empty(spark, f"{base}/none", "index bigint").count() == 0
    failures = spark.createDataFrame([("n", 3, "u3", "t", "fetch", "404"), ("n", 1, "u1", "t", "fetch", "500")], "novel_id string, index bigint, url string, title string, stage string, error string")
    sinks.append_failures(failures, f"{base}/f")
    sinks.append_failures(failures, f"{base}/f")
    sinks.append_log(failures, f"{base}/log")
    read = sinks.read_dead_letters(spark, f"{base}/f", failures.schema.simpleString()[7:-1].replace(":", " ")).first()
    assert [c["index"] for c in read["chapters"]] == [1, 1, 3, 3]
    assert spark.read.text(f"{base}/log").count() == 2
    assert [r["url"] for r in landed.numbered_urls(spark, 1, 3, "https://a.example/{}/").collect()] == [f"https://a.example/{i}/" for i in (1, 2, 3)]
    sinks.write_links(spark.createDataFrame([("n", 1, "b"), ("n", 0, "a")], "k string, pos int, url string"), "k", f"{base}/l")
    assert spark.read.text(f"{base}/l").first()["value"] == '["a","b"]'
    novels = spark.createDataFrame([("T", ["g"])], "title string, genres array<string>")
    sinks.write_novels(novels, f"{base}/n")
    assert landed.read_novels(spark, f"{base}/n").first()["genres"] == ["g"]
    shown = novels.select(sinks.report(title=F.col("title"), author=F.lit(None).cast("string"), chapters=F.lit(2), description=F.lit("d"), genres=F.col("genres"), url=F.lit("u")))
    assert "Genres: g" in one(shown) and "Author: Unknown" in one(shown)
    assert one(spark.range(1).select(text.capitalised(F.lit("yes")))) == "Yes"


def test_odd_markup(spark):
    page = """<TITLE>caf&eacute; &#233;&nbsp;x</TITLE><a class="x" href="/a">1</a><a href='/b'>2</a><A HREF="/c">3</A><a href=/d>4</a><script>a("<p>")</script><!-- <p> -->b"""
    parsed = elements.parse(spark.createDataFrame([(page,)], "html string").withColumn("page", F.col("html")))
    hrefs = F.transform(elements.find_all("elements", "a"), lambda e: elements.attr(e, "href"))
    got = parsed.select(hrefs.alias("h"), elements.find("elements", "title")["text"].alias("t"), elements.plain_text("page").alias("p")).first()
    assert got["h"] == ["/a", "/b", "/c", "/d"]
    assert got["t"] == "caf\u00e9 \u00e9\u00a0x"
    assert got["p"] == "caf\u00e9 \u00e9\u00a0x 1 2 3 4 b"


def test_dropped_elements():
    assert elements.dropped("a<b>x<i>y</i></b>c<i>z</i><br>", ("i",)) == "a<b>x</b>c<br/>"
    assert elements.dropped("<div><i>a<div><i>b</i></div></i>c</div>", ("i",)) == "<div>c</div>"
    assert elements.dropped("<i>never closed <b>x</b>", ("i",)) == "" and elements.dropped("", ("i",)) == ""


def test_answers_that_must_be_there(spark):
    rows = spark.createDataFrame([(200, "u"), (404, "v")], "status int, url string")
    checked = rows.select(collections.require_ok(F.col("status"), F.col("url")).alias("s"))
    with pytest.raises(Exception, match="not landed: v"):
        checked.collect()
    assert [r["s"] for r in rows.where("status = 200").select(collections.require_ok(F.col("status"), F.col("url")).alias("s")).collect()] == [200]


def test_pretty_pages_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a.html", "<p>x<br>y</p>"), (None, "z"), ("b.html", None)], "name string, html string")
    found = archives.write_pretty(rows, f"file://{tmp_path}/pretty", "name").collect()
    assert [r["name"] for r in found] == ["a.html"]
    assert (tmp_path / "pretty" / "a.html").read_text() == "<p>\n x\n <br/>\n y\n</p>"
    assert sorted(p.name for p in (tmp_path / "pretty").iterdir() if not p.name.endswith(".crc")) == ["a.html"]


def test_descendants_of_an_element_of_a_long_page(spark):
    """The element around is found once a page: found anew for each descendant, a nested search of 200 rows took minutes."""
    table = "<table>" + "".join(f"<tr><td>k</td><td> v{i} <a> g{i} </a></td></tr>" for i in range(200)) + '</table><div class="bai-viet-box"></div><div class="bai-viet-box"><a>1</a></div>'
    parsed = elements.parse(spark.createDataFrame([("u", table), ("v", "<p>none</p>"), ("w", None)], "url string, html string"))
    began = time.monotonic()
    rows = {r["novel_url"]: r for r in records.novel_table(parsed).collect()}
    assert time.monotonic() - began < 30
    assert (rows["u"]["title"], rows["u"]["status"], rows["u"]["genres"], rows["u"]["num_chapters"]) == ("v1  g1", "v5  g5", ["g4"], 2)
    assert (rows["v"]["title"], rows["v"]["genres"], rows["v"]["num_chapters"]) == ("Unknown Title", [], 1)
    assert rows["w"]["title"] == "Unknown Title"


def test_unzip_reads_what_is_asked_for(spark):
    """Entries with other names aren't read: this one's content is damaged."""
    data = bytearray(archives.zip_bytes([("a.txt", b"a" * 50), ("b/c.txt", b"c" * 50)], stored=["a.txt", "b/c.txt"]))
    data[data.index(b"a" * 50)] = 0
    rows = landed.unzip(spark.createDataFrame([(1, bytes(data))], "id long, content binary"), pattern="b/*").collect()
    assert [(r["id"], r["entry_pos"], r["entry_name"], bytes(r["entry_content"])) for r in rows] == [(1, 1, "b/c.txt", b"c" * 50)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
