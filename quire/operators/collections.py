"""Chapters as ordered collections: selection, gaps, duplicates, assembly, sequence logic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.names import unused
from quire.operators.scans import numbered, running_sum


def select_range(chapters: DataFrame, start: int, end: int, index: str = "index", count: int | None = None) -> DataFrame:
    """Chapters start to end, both included; end must not be beyond count, if that is given."""
    if not 0 < start <= end or (count is not None and end > count):
        raise ValueError(f"not a range of chapters: {start} to {end}")
    return chapters.where(F.col(index).between(start, end))


def select(chapters: DataFrame, wanted: str | int | Sequence[int], key: str, index: str = "index", link: str = "url", order: str | None = None) -> DataFrame:
    """One selector for all kinds: "all", a number, "a-b", a link, or a list of numbers in the caller's order."""
    if isinstance(wanted, str):
        first, dash, last = wanted.strip().partition("-")
        if wanted.strip() == "all":
            return chapters
        if first.strip().isdecimal() and (not dash or last.strip().isdecimal()):
            return select_range(chapters, int(first), int(last or first), index)
        return chapters.where(F.col(link) == F.lit(wanted))
    if isinstance(wanted, int):
        return select_range(chapters, wanted, wanted, index)
    return select_list(chapters, wanted, key, index, order)


def misplaced(chapters: DataFrame, key: str, order: str, index: str = "index") -> DataFrame:
    """Chapters whose number isn't their place in the collection, with that place as `place`."""
    return numbered(chapters, [key], [order], "place").where(~F.col(index).eqNullSafe(F.col("place")))


def select_list(chapters: DataFrame, wanted: Sequence[int], key: str, index: str = "index", order: str | None = None) -> DataFrame:
    """Of each collection the wanted indices in the caller's order, repeats kept, absent ones skipped; of several chapters with one index the first by `order`. `request_pos` is the place in the request."""
    request = chapters.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(wanted)], "request_pos int, wanted long")
    first = first_of(chapters.where(F.col(index).isin(*map(int, wanted))), [key, index], order) if order else chapters
    return first.join(F.broadcast(request), F.col(index) == F.col("wanted")).drop("wanted")  # a row for each index asked for


def first_of(rows: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    n = unused(rows.columns, 1)[0]
    return rows.withColumn(n, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def first_by_min(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by an aggregate, which combines before it shuffles: for keys that may be hot."""
    others = [c for c in rows.columns if c not in keys]
    own = unused(rows.columns, 1)[0]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias(own))
    return best.select(*[c if c in keys else F.col(own)[c].alias(c) for c in rows.columns])


def position(links: Column, link: Column, strict: bool = False) -> Column:
    """1-based place of a link in a list: null where it is absent, or an error if strict."""
    at = F.nullif(F.array_position(links, link).cast("long"), F.lit(0).cast("long"))
    return F.coalesce(at, F.raise_error(F.lit("no such link"))) if strict else at


def missing(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is wanted and not stored."""
    return wanted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def expected(spans: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each index of each span, both ends included."""
    return spans.withColumn("index", F.explode(F.sequence(F.col(start), F.col(end))))


def links_of(pages: DataFrame, links: Column, newest_first: bool = False) -> DataFrame:
    """pages with a row for each link: pos from 0, url."""
    return pages.select("*", F.posexplode(F.reverse(links) if newest_first else links).alias("pos", "url"))


def assemble(chapters: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str = "index", name: str = "chapters") -> DataFrame:
    """One row a key with its chapters in order, whatever order they arrive in."""
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(c) for c in fields if c != order])))
    return chapters.groupBy(*keys).agg(sorted_.alias(name))


def first_heading(rows: DataFrame, key: str, order: str, body: Column, heading: Column) -> DataFrame:
    """rows with `content`: the body, of each key's first row after its heading."""
    first = F.row_number().over(W.partitionBy(key).orderBy(order)) == 1
    return rows.withColumn("content", F.when(first, F.concat(heading, body)).otherwise(body))


def streaks(attempts: DataFrame, key: str, order: Sequence[str], failed: Column) -> DataFrame:
    """attempts with `streak`, the failures in a row up to each: 0 at a success. A key may have any number of attempts."""
    return running_sum(attempts, [key], order, failed.cast("int"), ~failed, "streak")


def given_up(attempts: DataFrame, key: str, order: Sequence[str], failed: Column, most: int = 5) -> DataFrame:
    """The failures at which `most` in a row are reached, and those after them."""
    return streaks(attempts, key, order, failed).where(F.col("streak") >= most)


def outcome(status: Column) -> Column:
    """ok, missing (404) or retry."""
    return F.when(status == 200, F.lit("ok")).when(status == 404, F.lit("missing")).otherwise(F.lit("retry"))


def require_ok(status: Column, what: Column) -> Column:
    """The status of an answer that is there; any other is an error."""
    return F.when(status == 200, status).otherwise(F.raise_error(F.concat(F.lit("not landed: "), what)))


def first_good(attempts: DataFrame, key: str, attempt: str, truncated: Column, most: int) -> DataFrame:
    """The first attempt that isn't truncated among the first `most`, null where all are: the item is missing."""
    good = F.when(~truncated & (F.col(attempt) <= most), F.col(attempt))
    return attempts.groupBy(key).agg(F.min(good).alias("attempt"))


def natural_order(name: Column) -> list[Column]:
    """By the first number in a file name, then the name."""
    return [F.regexp_extract(name, "([0-9]+)", 1).cast("long"), name]


def page_ranks(files: DataFrame, key: Sequence[str], name: str, lexicographic: bool = False, drop_first: bool = False) -> DataFrame:
    """files with `page` from 1, by number or by text; without the first one if asked."""
    order = [F.col(name)] if lexicographic else natural_order(F.col(name))
    out = files.withColumn("page", F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long"))
    return out.where("page > 1").withColumn("page", F.col("page") - 1) if drop_first else out


def with_fallback(rows: DataFrame, other: DataFrame, on: str, value: str) -> DataFrame:
    """rows with a value from another source where their own is null."""
    own = unused([*rows.columns, on, value], 1)[0]
    return rows.join(other.select(on, F.col(value).alias(own)), on, "left").withColumn(value, F.coalesce(value, own)).drop(own)


def retry_then_other(attempts: DataFrame, key: str, attempt: str, truncated: Column, most: int, value: str, other: DataFrame) -> DataFrame:
    """key and value of the first good attempt among the first `most`; where all fail, the other source's value."""
    good = F.when(~truncated & (F.col(attempt) <= most), F.struct(attempt, value))
    tried = attempts.groupBy(key).agg(F.min(good)[value].alias(value))
    return with_fallback(tried, other, key, value)


def once_for_each(rows: DataFrame, key: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what `derive` adds to a table of the different keys, so that a repeated key is worked out once."""
    return rows.join(derive(rows.select(key).distinct()), key, "left")
