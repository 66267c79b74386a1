"""Groups of spelling variants: words of a vocabulary at a distance of exactly one code point.

The vocabulary is counted in Spark. Near words are found by a self-join of a trie. Two words at distance one, the shorter of m
code points, agree in the first half of its length or in the rest of it at the end; so a word is put into tiles by its first
and by its last part, each beside words of its own length and of one more. A tile's words form a trie of what lies between the
parts that they share, and the sets of nodes within distance one are passed down it level by level: siblings become a pair by
a replaced code point, a node and its parent one by an inserted code point, and a pair's children by the same code point stay
a pair. Pairs that both end words are emitted. The tries of many tiles are walked together as arrays.

A tile of more than `most` words is split the same way by what lies between, until one code point is left; so no tile is large, however
many words begin alike. A pair is emitted only by the first tile of those that hold it.

Defined cases: null texts have no words; a null id counts as empty; repeated rows count each; ties of the most frequent near word go to
the smallest in code-point order; other columns are ignored; without words the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, bounded, released, stored

#: Code points of a word at least.
LEAST = 7
#: Words of a tile, and words that a Python worker walks at once.
MOST, AT_ONCE = 20_000, 60_000


def vocabulary(docs: DataFrame, damage: int | None = None, least: int = LEAST, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the runs of letters with at least `least` code points that occur at least `times` times, A-Z lower-cased.

    With `damage`, a run loses one code point where crc32("<doc_id>:<run>") is divisible by it.
    """
    letters = rf"[A-Za-zÀ-ÿ]{{{least},}}"
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(letters), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if damage:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        word = F.when(h % damage == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


@cache
def parts(m: int, path: str) -> tuple[int, int, tuple[tuple[int, int], ...]]:
    """Lengths of the first and the last part that a tile's words share, and the spans in which its pairs must differ.

    m is the shorter word's length. A step "a" adds the first half of what lies between to the first part, "b" the rest to the last part.
    """
    first, last, differ = 0, 0, []
    for step in path:
        between = m - first - last
        half = between // 2
        if step == "a":
            first += half
        else:
            differ.append((first, first + half))
            last += between - half
    return first, last, tuple(differ)


def _tiles(entries: DataFrame) -> DataFrame:
    """Each entry (word, n, m, path, first, last) in two tiles, one step further."""
    half = F.floor((F.col("m") - F.col("first") - F.col("last")) / 2).cast("int")
    rest = F.col("m") - F.col("first") - F.col("last") - half
    step = lambda name, first, last: F.struct(F.concat("path", F.lit(name)).alias("path"), first.cast("int").alias("first"), last.cast("int").alias("last"))
    both = F.array(step("a", F.col("first") + half, F.col("last")), step("b", F.col("first"), F.col("last") + rest))
    out = entries.select("word", "n", "m", F.explode(both).alias("tile")).select("word", "n", "m", "tile.*")
    return out.withColumn("key", F.xxhash64("m", "path", F.col("word").substr(F.lit(1), F.col("first")), F.col("word").substr(F.length("word") - F.col("last") + 1, F.col("last"))))


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted are among the sorted keys, and where."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    found = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return found, at[found]


def trie_pairs(tiles: list[int], middles: list[bytes], shorter: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the entries of one tile each whose middles, of `shorter` bytes or one more, are at distance one.

    tiles: a number for each entry. Nodes of a depth are numbered by their place in the order of tile and middle.
    """
    width = shorter + 1
    joined = np.empty(len(middles), f"S{4 + width}")
    joined[:] = [t + x for t, x in zip((t.to_bytes(4, "big") for t in tiles), middles, strict=True)]
    order = np.argsort(joined, kind="stable")
    chars = joined[order].view("u1").reshape(len(middles), 4 + width)
    long = chars[:, -1] > 0
    differ = chars[1:] != chars[:-1]
    from_here = np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), 4 + width)]  # the first place in which a row differs from the one before

    def nodes(depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's node at a depth, and each node's first row."""
        new = from_here < 4 + depth
        new[0] = True
        return np.cumsum(new) - 1, np.flatnonzero(new)

    number, start = nodes(0)
    has_short, has_long = np.logical_or.reduceat(~long, start), np.logical_or.reduceat(long, start)
    none = np.zeros(0, "i8")
    same_u, same_v = none, none  # replaced: both of this depth
    more_u, more_v = none, none  # inserted: u of this depth, v of the one before
    keys_before = none  # of the depth before: parent and code point
    ends, replaced = start, (none, none)  # where the shorter words end, and pairs of them
    for depth in range(1, width + 1):
        up, before_short = number, has_short
        number, start = nodes(depth)
        parent, char = up[start], chars[start, 3 + depth].astype("i8")
        keys = parent * 256 + char
        has_short, has_long = np.logical_or.reduceat(~long, start), np.logical_or.reduceat(long, start)
        real = char > 0  # the end of a shorter word is no node
        count = np.bincount(parent, minlength=int(parent[-1]) + 1)
        first_child = np.cumsum(count) - count

        def children(u: np.ndarray, count: np.ndarray = count, first_child: np.ndarray = first_child) -> tuple[np.ndarray, np.ndarray]:
            """For each pair's u: the number of its pair, and a child."""
            n = count[u]
            pair = np.repeat(np.arange(len(u)), n)
            return pair, np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_child[u], n)

        # inserted: pairs of the depth before go on by the same code point; a node is one more than its parent
        pair, child = children(more_u)
        found, v = _lookup(keys_before, more_v[pair] * 256 + char[child])
        u, v = np.r_[child[found], np.arange(len(start))], np.r_[v, parent]
        good = real[u] & has_long[u] & before_short[v]
        both = np.unique(u[good] * (len(up) + 1) + v[good])
        more_u, more_v = both // (len(up) + 1), both % (len(up) + 1)

        # replaced
        pair, child = children(same_u)
        found, v = _lookup(keys, same_v[pair] * 256 + char[child])
        us, vs = [child[found]], [v]
        step = 1
        while True:
            u = np.flatnonzero(parent[step:] == parent[:-step]) if step < len(parent) else none
            if not len(u):
                break
            us.append(u)
            vs.append(u + step)
            step += 1
        u, v = np.concatenate(us), np.concatenate(vs)
        good = real[u] & real[v] & has_short[u] & has_short[v]
        same_u, same_v = u[good], v[good]
        keys_before = keys
        if depth == shorter:  # a shorter word is the first row of its node
            ends = start
            replaced = start[same_u], start[same_v]
    return np.r_[order[replaced[0]], order[start[more_u]]], np.r_[order[replaced[1]], order[ends[more_v]]]


@released
def _near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, path, key, word, n), tile by tile, to pairs of near words (a, of_a, b, of_b)."""
    held: list[tuple[int, str, int, str, int]] = []
    for batch in batches:
        held += zip(*[c.to_pylist() for c in batch.columns], strict=True)
        if len(held) > AT_ONCE:
            cut = len(held) - 1
            while cut and held[cut - 1][:3] == held[-1][:3]:
                cut -= 1
            yield from _walked(held[:cut])
            held = held[cut:]
    yield from _walked(held)


def _walked(rows: list[tuple[int, str, int, str, int]]) -> Iterator[pa.RecordBatch]:
    """The pairs of whole tiles; those of one length and path share a walk."""
    found: list[tuple[str, int, str, int]] = []
    for (m, path), run in groupby(rows, key=lambda r: r[:2]):
        members: list[tuple[str, int]] = []
        tiles: list[int] = []
        for tile, (_, group) in enumerate(groupby(run, key=lambda r: r[2])):
            words = [r[3:] for r in group]
            if len(words) > 1:
                members += words
                tiles += [tile] * len(words)
        if not members:
            continue
        first, last, differ = parts(m, path)
        middles = [w[first : len(w) - last].encode("latin-1") for w, _ in members]
        for i, j in zip(*(x.tolist() for x in trie_pairs(tiles, middles, m - first - last)), strict=True):
            (x, of_x), (y, of_y) = members[i], members[j]
            if x[:first] == y[:first] and x[len(x) - last :] == y[len(y) - last :] and all(x[p:q] != y[p:q] for p, q in differ):  # keys are hashes; each pair counts once
                found.append((x, of_x, y, of_y))
    if found:
        a, of_a, b, of_b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(of_a, pa.int64()), pa.array(b, pa.string()), pa.array(of_b, pa.int64())], ["a", "of_a", "b", "of_b"])


def near_pairs(words: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Pairs (a, of_a, b, of_b), each once, of distinct words (word, n) of `least` code points or more that differ by one inserted, deleted or replaced code point."""
    tile = ["m", "path", "key"]
    length = F.length("word")
    fresh = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"), F.lit("").alias("path"), F.lit(0).alias("first"), F.lit(0).alias("last")).where(F.col("m") >= max(1, least))
    done = None
    while True:
        tiles = _tiles(fresh)
        can_split = F.col("m") - F.col("first") - F.col("last") > 1
        hot = stored(tiles.where(can_split).groupBy(*tile).count().where(F.col("count") > most).select(*tile), "hot-tiles")
        split = hot.limit(1).count() > 0
        small = tiles.join(bounded(hot), tile, "left_anti") if split else tiles
        done = small if done is None else done.unionByName(small)
        if not split:
            break
        fresh = stored(tiles.join(bounded(hot), tile, "left_semi").select("word", "n", "m", "path", "first", "last"), "split-tiles")
    rows = done.select(*tile, "word", "n").repartition(*tile).sortWithinPartitions(*tile)
    return rows.mapInArrow(_near, "a string, of_a long, b string, of_b long")


def variants(words: DataFrame, times: int = 10, least: int = LEAST, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the distinct words (word, n), which should be stored.

    The form is the most frequent near word, if it is at least `times` as frequent; the root is where following forms ends.
    """
    pairs = stored(near_pairs(words, least, most), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("of_b").alias("of"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("of_a").alias("of")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("of")).alias("rank"), F.col("other"), F.col("of"))).alias("best"))
    out = words.join(best, "word", "left")
    formed = F.col("best.of") >= times * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, F.col("best.of")).alias("form_n")), "forms")

    # counts grow tenfold along forms, so there are few steps, and each round doubles those taken
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    return out.join(roots.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, damage: int | None = None, times: int = 10, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the words of all texts that occur twice or more."""
    return variants(stored(vocabulary(docs, damage, least, 2, id_col, text_col), "vocabulary"), times, least)
