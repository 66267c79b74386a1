"""Scalar functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from quire.functions import html, text, urls


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


COMIC = "https://comics.example.vn/truyen-tranh/some-hero-1234"


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (urls.base_url, "https://a.example/b/c", "https://a.example"),
        (urls.base_url, "a.example/b", "https://a.example"),
        (urls.referrer, "http://a.example/b", "https://a.example/"),
        (urls.referrer, "http://a.example", None),
        (urls.title_from_url, "https://a.example/x/the-old_man", "the old man"),
        (urls.title_from_url, "https://a.example/x/", ""),
        (urls.strip_slash, "https://a.example/x//", "https://a.example/x/"),
        (urls.comic_name, COMIC, "some-hero"),
        (urls.comic_name, "https://a.example/1234", "Unknown Comic"),
        (urls.chapter_number, f"{COMIC}-chap-7.html", "7"),
        (urls.chapter_number, f"{COMIC}-chap-7-5.html", "7.5"),
        (urls.extension, "https://a.example/x/1.JPG?gt=hd", ".jpg"),
        (urls.extension, "https://a.example/x/1", ""),
        (urls.last_number, COMIC, "1234"),
        (urls.media_type, "cover.png", "image/png"),
        (urls.is_image, "a/1.GIF", True),
        (urls.is_image, "a/1.bmp", False),
        (urls.is_code, "12345", True),
        (urls.is_code, "12a", False),
        (text.directory_name, "What: now?", "What, now"),
        (text.is_yes, " Y ", True),
        (text.normal_breaks, "a<br/><br/>b\nc<br/>d", "a<br/><br/>b c<br/><br/>d"),
        (text.lines_to_breaks, "a\n\nb\nc", "a<br/><br/>b c"),
        (text.is_truncated, "<br/>" * 8, True),
        (text.is_truncated, "<br/>" * 9, False),
        (text.parse_int_list, "[3, 1, 3]", [3, 1, 3]),
        (text.parse_int_list, "__import__('os')", None),
        (text.clean_filename, "  a/b:  c\t\n", "ab c"),
        (text.clean_filename, "x" * 300, "x" * 300),
        (text.clean_filename, "x" * 301, "x" * 200),
        (text.clean_filename, "y" * 290 + " [group one] z", "y" * 290 + " z"),
        (html.strip_tags, "<b>a</b> b", "a b"),
        (html.decode, "a &amp;amp; b &copy; &amp", "a &amp; b © &"),
    ],
)
def test_function(spark, f, given, want):
    assert value(spark, f(F.lit(given))) == want


def test_numbers_of_chapters(spark):
    assert value(spark, urls.chapter_url(F.lit(COMIC), F.lit(7.0))) == f"{COMIC}-chap-7.html"
    assert value(spark, urls.chapter_url(F.lit(COMIC), F.lit(7.5))) == f"{COMIC}-chap-7-5.html"
    assert value(spark, urls.chapter_url(F.lit(COMIC), F.lit(7.5), compat=True)) == f"{COMIC}-chap-7-5.0.html"
    assert value(spark, urls.fractional_chapter_number(F.lit(7.5))) == "7.5"
    assert value(spark, urls.fractional_chapter_number(F.lit(7.5), compat=True)) == "7.5.0"
    assert value(spark, urls.chapter_key(F.lit("7.10"))) == [7, 10]


def test_resolve(spark):
    base = F.lit("https://a.example")
    assert value(spark, urls.resolve(base, F.lit("/b"))) == "https://a.example/b"
    assert value(spark, urls.resolve(base, F.lit("//c.example/b"))) == "https://c.example/b"
    assert value(spark, urls.resolve(base, F.lit("http://d.example"))) == "http://d.example"


def test_book_texts(spark):
    assert value(spark, text.chapter_title(F.lit("x"), F.lit(3))) == "Chương 3: x"
    assert value(spark, text.chapter_title(F.lit("Chương 9"), F.lit(3))) == "Chương 9"
    assert value(spark, text.book_name_list(F.lit("T"), F.array(F.lit(3), F.lit(1)))) == "T - Chương 3 1.epub"
    assert value(spark, text.book_name_range(F.lit("T"), F.lit(1), F.lit(4))) == "T - Chương 1 đến 4.epub"
    assert value(spark, text.book_identifier(F.lit("T"), F.lit("A"))) == value(spark, text.book_identifier(F.lit("T"), F.lit("A")))
    assert value(spark, text.joined_or(F.expr("cast(array() as array<string>)"))) == "Khác"
