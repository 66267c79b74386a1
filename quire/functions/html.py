"""HTML functions in built-in expressions, for elements that don't nest; what nests goes through operators.elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(text: Column) -> Column:
    """The commonest character references, & last; a final &amp may lack its semicolon. operators.elements decodes all."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, "&amp;?", "&")


def undecoded(page: Column) -> Column:
    """A page of which a parser, which decodes all references (also &quot without a semicolon), gives texts and attributes as they stand."""
    return F.replace(page, F.lit("&"), F.lit("&amp;"))


def escape(text: Column) -> Column:
    """Text as it stands in markup."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def drop_elements(page: Column, tag: str) -> Column:
    """Without void elements of a tag, such as images."""
    return F.regexp_replace(page, f"<{tag}[^>]*>", "")


def strip_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, "<[^>]*>", "")


def as_document(fragment: Column) -> Column:
    return F.concat(F.lit("<html><body>"), fragment, F.lit("</body></html>"))
