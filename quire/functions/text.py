"""Text functions as column expressions: titles, file names, markup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed texts of books.
CHAPTER, OTHER, NO_DESCRIPTION, COVER, INTRO, TO = "Chương", "Khác", "<p>Không có mô tả</p>", "Bìa sách", "Giới thiệu nội dung", "đến"


def strip(text: Column) -> Column:
    """Without white space at either end (ASCII white space; trim() alone would remove only spaces)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def drop_illegal(name: Column) -> Column:
    """Without characters that file names can't have."""
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "")


def clean_filename(title: Column) -> Column:
    """A title as a file name: over 300 characters without [groups], and if still over 300 its first 200."""

    def shortened(name: Column) -> Column:
        short = collapse(strip(F.regexp_replace(name, r"\[([^\]]+)\]", "")))
        return _bound(short, lambda x: F.when(F.length(x) <= 300, x).otherwise(F.substring(x, 1, 200)))

    return _bound(collapse(drop_illegal(strip(title))), lambda x: F.when(F.length(x) <= 300, x).otherwise(shortened(x)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def directory_name(title: Column) -> Column:
    """A colon as a comma, question marks gone."""
    return F.translate(title, ":?", ",")


def file_slug(url: Column, base: str) -> Column:
    return F.replace(F.replace(url, F.lit(base), F.lit("")), F.lit("-"), F.lit(""))


def chapter_title(title: Column, index: Column) -> Column:
    return F.when(title.contains(CHAPTER), title).otherwise(F.concat(F.lit(f"{CHAPTER} "), index.cast("string"), F.lit(": "), title))


def joined_or(items: Column, default: str = OTHER, separator: str = ", ") -> Column:
    """Items in one text, or the default without any."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, separator)).otherwise(F.lit(default))


def book_name(title: Column) -> Column:
    return F.concat(title, F.lit(".epub"))


def book_name_list(title: Column, indices: Column) -> Column:
    """For one chapter or several."""
    return F.concat(title, F.lit(f" - {CHAPTER} "), F.array_join(indices.cast("array<string>"), " "), F.lit(".epub"))


def book_name_range(title: Column, start: Column, end: Column) -> Column:
    return F.concat(title, F.lit(f" - {CHAPTER} "), start.cast("string"), F.lit(f" {TO} "), end.cast("string"), F.lit(".epub"))


def book_identifier(title: Column, author: Column) -> Column:
    """The same in every run."""
    return F.concat(F.sha2(F.coalesce(title, F.lit("")), 256), F.lit("-"), F.sha2(F.coalesce(author, F.lit("")), 256))


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def is_truncated(markup: Column) -> Column:
    """A page cut short has exactly eight line breaks."""
    return count_of(markup, "<br/>") == 8


def is_short_canvas(markup: Column) -> Column:
    return count_of(markup, "<br><br>") <= 4


def normal_breaks(markup: Column) -> Column:
    """Double breaks become single, then all double; line feeds become spaces."""
    single = F.replace(markup, F.lit("<br/><br/>"), F.lit("<br/>"))
    return F.replace(F.replace(single, F.lit("<br/>"), F.lit("<br/><br/>")), F.lit("\n"), F.lit(" "))


def lines_to_breaks(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n\n"), F.lit("<br/><br/>")), F.lit("\n"), F.lit(" "))


def is_yes(answer: Column) -> Column:
    return F.lower(strip(answer)) == "y"


def capitalised(text: Column) -> Column:
    return F.initcap(text)


def parse_int_list(text: Column) -> Column:
    """A list of numbers as a user writes it; null if it is anything else. Nothing is evaluated."""
    return F.from_json(text, "array<bigint>")
