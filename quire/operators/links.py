"""Link graphs and snapshots: walks along next links, two hops, merges of what is stored with what is fresh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.names import unused
from quire.sources.shared import written


def two_hop(first: DataFrame, second: DataFrame, link: Column, target: str) -> DataFrame:
    """Rows of `first` with the row of `second` that their link names."""
    own = unused([*first.columns, *second.columns], 1)[0]
    return first.withColumn(own, link).join(second, F.col(own) == F.col(target)).drop(own)


def walk(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, hop, url) along next links: links has (url, next), seeds has (seed, url) at hop 0, hops below `hops`.

    Pointers double: after k rounds each page knows the page 2**k steps on, so a walk of n hops takes about log2(n) joins
    instead of n. Each round is written, so its plan is two joins whatever the number of hops. A url with several rows has
    the smallest of their next links.
    """
    jump = links.where("next is not null").groupBy("url").agg(F.min("next").alias("next"))
    parts = [seeds.select("seed", F.lit(0).cast("long").alias("hop"), "url")]
    step = 1
    while step < hops:
        moved = reduce(DataFrame.unionByName, parts).join(jump, "url").select("seed", (F.col("hop") + step).alias("hop"), F.col("next").alias("url")).where(F.col("hop") < hops)
        parts.append(written(moved, "walk"))
        if parts[-1].isEmpty():
            break
        step *= 2
        if step < hops:
            onward = jump.select(F.col("url").alias("next"), F.col("next").alias("onward"))
            jump = written(jump.join(onward, "next").select("url", F.col("onward").alias("next")), "jump")
    return reduce(DataFrame.unionByName, parts)


def trace(links: DataFrame) -> DataFrame:
    """Where following next links leads from each url: url, ending ("end" or "circle"), entry, hops, circle, length.

    links has (url, next); a url with several rows has the smallest of their next links, one without any is an end. entry is the
    end or the first url of the circle, hops the steps to it, circle the least url of the circle and length its number of urls (null and
    0 at an end). Pointers double until they have made as many steps as there are links: those that are still on their way then are in
    circles. Then they are taken down again: each keeps the steps that don't reach its ending. So a table of n links takes
    about 2 * log2(n) joins, each written.
    """
    step = links.where("url is not null and next is not null").groupBy("url").agg(F.min("next").alias("next"))
    step = written(step, "step")
    jumps, count = [step], step.count()
    while 2 ** (len(jumps) - 1) < count:
        onward = jumps[-1].select(F.col("url").alias("next"), F.col("next").alias("onward"))
        longer = written(jumps[-1].join(onward, "next").select("url", F.col("onward").alias("next")), "jump")
        jumps.append(longer)
        if longer.isEmpty():
            break

    inside = written(jumps[-1].select(F.col("next").alias("url")).distinct(), "circles")  # of 2**k >= n steps only circles are left
    least = inside.join(step, "url").select("url", "next", F.least("url", "next").alias("circle"))
    for _ in jumps:  # the least url of the next 2**k ones
        ahead = least.select(F.col("url").alias("next"), F.col("next").alias("onward"), F.col("circle").alias("further"))
        least = written(least.join(ahead, "next").select("url", F.col("onward").alias("next"), F.least("circle", "further").alias("circle")), "least")
    sizes = least.groupBy("circle").agg(F.count("*").alias("length"))
    ringed = written(least.select("url", "circle").join(sizes, "circle"), "ringed")

    every = step.select("url").union(step.select("next")).union(links.where("url is not null").select("url")).distinct()
    at = every.select("url", F.col("url").alias("at"), F.lit(0).cast("long").alias("hops"))
    on = ringed.select(F.col("url").alias("to"), F.lit(True).alias("ringed"))
    for k in range(len(jumps) - 1, -1, -1):  # steps that end before the ending
        jump = jumps[k].select(F.col("url").alias("at"), F.col("next").alias("to"))
        here = on.select(F.col("to").alias("at"), F.lit(True).alias("done"))
        last = step.select(F.col("url").alias("to"), F.lit(True).alias("goes_on"))
        moved = at.join(jump, "at", "left").join(on, "to", "left").join(last, "to", "left").join(here, "at", "left")
        may = F.col("done").isNull() & F.col("to").isNotNull() & F.col("ringed").isNull() & F.col("goes_on").isNotNull()
        at = written(moved.select("url", F.when(may, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(may, F.col("hops") + 2**k).otherwise(F.col("hops")).alias("hops")), "descent")
    final = at.join(step.select(F.col("url").alias("at"), "next"), "at", "left").join(on.select(F.col("to").alias("at"), "ringed"), "at", "left")
    stay = F.col("ringed").isNotNull() | F.col("next").isNull()
    final = final.select("url", F.when(stay, F.col("at")).otherwise(F.col("next")).alias("entry"), F.when(stay, F.col("hops")).otherwise(F.col("hops") + 1).alias("hops"))
    out = final.join(ringed.select(F.col("url").alias("entry"), "circle", "length"), "entry", "left")
    return out.select("url", F.when(F.col("circle").isNull(), "end").otherwise("circle").alias("ending"), "entry", "hops", "circle", F.coalesce("length", F.lit(0)).cast("long").alias("length"))


SAME = ("title", "author", "num_chapters", "start_chapter", "end_chapter")


def merge_snapshots(fresh: DataFrame, stored: DataFrame, key: str = "title", fields: tuple[str, ...] = SAME) -> DataFrame:
    """fresh with `outcome`: create, reuse, rebuild_links (equal, but links are missing), rebuild_all (another start), extend (more chapters) or update.

    Both have the fields and `chapter_links`; a stored row's columns come along as stored_*.
    """
    right = stored.select(*[F.col(c).alias(f"stored_{c}") for c in stored.columns])
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"stored_{c}"))
    complete = F.size("stored_chapter_links") == F.col("stored_num_chapters")
    outcome = (
        F.when(F.col(f"stored_{key}").isNull(), "create")
        .when(same & complete, "reuse")
        .when(same, "rebuild_links")
        .when(~F.col("start_chapter").eqNullSafe(F.col("stored_start_chapter")), "rebuild_all")
        .when(F.col("num_chapters") > F.col("stored_num_chapters"), "extend")
        .otherwise("update")
    )
    return fresh.join(right, F.col(key) == F.col(f"stored_{key}"), "left").withColumn("outcome", outcome)


def keep_chapters(stored: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Stored chapters (key, url, ...) whose link the fresh list still has."""
    return stored.join(links.select(key, "url").distinct(), [key, "url"], "left_semi")


def extend(links: Column, end: Column, fresh: Column) -> Column:
    """Stored links up to and with the stored end, then the fresh ones."""
    return F.concat(F.slice(links, F.lit(1), F.array_position(links, end).cast("int")), fresh)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows, and the stored ones whose key isn't among them."""
    return fresh.unionByName(stored.join(fresh.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
