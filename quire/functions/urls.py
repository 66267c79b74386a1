"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_url(url: Column) -> Column:
    """Scheme and host; https and the first segment where there is no scheme."""
    part = lambda k: F.split_part(url, F.lit("/"), F.lit(k))
    return F.when(url.startswith("http"), F.concat(part(1), F.lit("//"), part(3))).otherwise(F.concat(F.lit("https://"), part(1)))


def referrer(url: Column) -> Column:
    """https and the host of a URL that goes on after its host, else null."""
    host = F.regexp_extract(url, "https?://([^/]+)/", 1)
    return F.when(host != "", F.concat(F.lit("https://"), host, F.lit("/")))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def title_from_url(url: Column) -> Column:
    """The last segment with - and _ as spaces; empty after a final slash."""
    return F.translate(last_segment(url), "-_", "  ")


def strip_slash(url: Column) -> Column:
    """Without one final slash."""
    return F.regexp_replace(url, "/$", "")


def resolve(base: Column, href: Column) -> Column:
    """A link as an absolute URL: protocol-relative gets https, rooted gets the base."""
    return F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(base, href)).otherwise(href)


def is_absolute(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def last_number(url: Column) -> Column:
    """The last run of digits, null without one."""
    return F.element_at(F.regexp_extract_all(url, F.lit("([0-9]+)"), F.lit(1)), -1)


def first_number(name: Column) -> Column:
    """The first run of digits as a number, null without one."""
    return F.nullif(F.regexp_extract(name, "([0-9]+)", 1), F.lit("")).cast("long")


def comic_name(url: Column) -> Column:
    """Between truyen-tranh/ and the first place where - and the URL's last number follow."""
    after = F.substring_index(url, "truyen-tranh/", -1)
    code = F.concat(F.lit("-"), last_number(url))
    at = F.instr(F.substring(after, 2, 1 << 30), code)
    return F.when(url.contains("truyen-tranh/") & (at > 0), F.substring(after, F.lit(1), at)).otherwise(F.lit("Unknown Comic"))


def chapter_number(url: Column) -> Column:
    """The number after the last chap-: "n", or "n.m" where a second run of digits follows; null without digits."""
    runs = F.regexp_extract_all(F.element_at(F.split(url, "chap-"), -1), F.lit("([0-9]+)"), F.lit(1))
    first = F.get(runs, F.lit(0))
    return F.when(F.size(runs) < 2, first).otherwise(F.concat(first, F.lit("."), F.get(runs, F.lit(1))))


def chapter_key(number: Column) -> Column:
    """Sort key of "n" or "n.m"."""
    return F.transform(F.split(number, r"\."), lambda x: x.cast("long"))


def _tenth(chapter: Column, compat: bool) -> Column:
    digit = F.pmod(chapter * 10, F.lit(10))
    return digit.cast("double").cast("string") if compat else F.round(digit).cast("int").cast("string")


def fractional_chapter_number(chapter: Column, compat: bool = False) -> Column:
    """7.5 as "7.5"; compat keeps the ".0" that a float's text has."""
    return F.concat(F.floor(chapter).cast("string"), F.lit("."), _tenth(chapter, compat))


def chapter_url(comic: Column, chapter: Column, compat: bool = False) -> Column:
    """Link of a chapter by number; a fraction becomes -n-m."""
    whole = F.floor(chapter).cast("string")
    tail = F.when(chapter == F.floor(chapter), whole).otherwise(F.concat(whole, F.lit("-"), _tenth(chapter, compat)))
    return F.concat(comic, F.lit("-chap-"), tail, F.lit(".html"))


def gallery_url(base: Column, code: Column) -> Column:
    return F.concat(base, F.lit("/g/"), code.cast("string"), F.lit("/"))


def extension(url: Column) -> Column:
    """Lower-cased extension with its dot, without a query; empty without one."""
    return F.lower(F.regexp_extract(F.split_part(url, F.lit("?"), F.lit(1)), r"(\.[^./]+)$", 1))


def with_extension(name: Column, to: str) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", to)


def media_type(name: Column) -> Column:
    return F.concat(F.lit("image/"), F.element_at(F.split(name, r"\."), -1))


IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif")


def is_image(url: Column, bmp: bool = False) -> Column:
    return extension(url).isin(*IMAGE_EXTENSIONS, *([".bmp"] if bmp else []))


def is_blocked(url: Column, parts: tuple[str, ...]) -> Column:
    """Whether a URL contains one of the parts."""
    out = F.lit(False)
    for p in parts:
        out = out | url.contains(p)
    return out


def is_code(text: Column) -> Column:
    return text.rlike("^[0-9]+$")
