"""Exact similarity join of word n-gram sets by Jaccard similarity, and the components of its links.

Documents with equal sets are one class. A class of n elements can only be linked if so many of its elements are in other classes
too. This is counted twice, each class's hashes packed by ranges of the hash space: for all classes over a part of the space (a class with too
many elements of its own there is done), then for those left over all of it. Of those left, two that are similar enough share one of their first elements in
the order of hashes, n - ceil(t * n) + 1 of each; these are the keys.

The sets of a key are held against a few leaders, which makes most links; components of these are labels. What remains are keys of
several labels. Keys with the same set of labels are one tile, and tiles are cut by size, each beside the next larger, since sets whose sizes are in
no band or in bands that don't touch can't be similar. In a tile, sets have a bitmap that holds for each bit whether an odd number of hashes fall on it: two
bitmaps that differ in d bits belong to sets that differ in d elements at least, which bounds the overlap from above. Pairs that
pass are decided by intersecting the sorted sets. Blocks of a tile are compared in tasks of bounded size, pairs of one label are
passed over. Bitmaps are dealt out first. The pairs that pass, each once, are decided by sets, where they are some times a cell's sets at most; where they are more,
the cell's sets are dealt out and decided there, and only links that connect labels come out. So no group becomes its pairs as rows, and no link is lost.

Defined cases: null text counts as empty; documents without words have no elements and are linked with nothing; fewer words than a
shingle has are one element; rows with a null id link nothing; rows that share an id are one each; other columns are ignored; an empty
table gives an empty result. Elements are 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, released, stored, text_slices
from quire.llm.graph import components
from quire.llm.near_dedup import WordHashes, shingle_sets

#: A bitmap has 2 ** LEAST_BITS bits at least.
LEAST_BITS = 10
#: The part of the hash space that is counted for all classes, in eighths.
EIGHTHS = 3
#: Leaders that a key's sets are held against, one after the other.
LEADERS = 1
#: Pairs of a cell for each of its sets, beyond which the sets are dealt out instead of the pairs.
MOST_PAIRS = 8
#: Sets of a part of a tile, and elements of theirs, about; sets of a block.
PART_SETS, PART_ELEMENTS, BLOCK = 1024, 500_000, 128

#: Hashes and sets of a chunk, whose hashes of one range are one row.
CHUNK_HASHES, CHUNK_SETS = 2_000_000, 60_000

_PACKED = "chunk string, range int, names binary, owners binary, counts binary, hashes binary"
_PACKED_ARROW = [("chunk", pa.string()), ("range", pa.int32()), *((c, pa.binary()) for c in ("names", "owners", "counts", "hashes"))]
_OWN = f"doc_id long, n_shingles long, digest binary, {_PACKED}"
_OWN_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), *_PACKED_ARROW])


def digests(sets: list[np.ndarray]) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]


class Packer:
    """Hashes of sets by ranges of the hash space, 32 bits each, a chunk of sets at a time.

    A row (range not null) has the chunk's hashes of a range, with the sets' digests, their places in the chunk, and how many are each one's; another (range
    null) has the digests of all sets of the chunk.
    """

    def __init__(self, ranges: int, eighths: int) -> None:
        self.ranges, self.of = ranges, ranges * 8 // eighths
        self.names: list[bytes] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.weight = 0

    def add(self, sets: list[np.ndarray], names: list[bytes]) -> Iterator[dict]:
        if not sets:
            return
        joined, owner = np.concatenate(sets), np.repeat(np.arange(len(self.names), len(self.names) + len(sets)), [len(s) for s in sets])
        at = ((joined >> np.uint64(40)) * np.uint64(self.of)) >> np.uint64(24)
        inside = at < self.ranges
        self.held.append((at[inside].astype("i4"), owner[inside].astype("u2"), joined[inside].astype("u4")))
        self.names += names
        self.weight += int(inside.sum())
        if self.weight >= CHUNK_HASHES or len(self.names) >= CHUNK_SETS:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        if not self.names:
            return
        names = np.array(self.names, "V16")
        chunk = xxhash.xxh3_128_hexdigest(names.tobytes())  # by content, so that a task that runs again names it alike
        yield {"chunk": chunk, "range": None, "names": names.tobytes()}
        at, owner, low = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(at, kind="stable")
        at, owner, low = at[order], owner[order], low[order]
        edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
        for a, b in zip(edges, [*edges[1:], len(at)], strict=True) if len(at) else ():
            own = owner[a:b]
            run = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            yield {"chunk": chunk, "range": int(at[a]), "names": names[own[run]].tobytes(), "owners": own[run].tobytes(), "counts": np.diff(np.r_[run, len(own)]).astype("u4").tobytes(), "hashes": low[a:b].tobytes()}
        self.names, self.held, self.weight = [], [], 0


def _classes(n: int, ranges: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordHashes(), Packer(ranges, EIGHTHS)
        for batch, texts in text_slices(batches):
            sets = shingle_sets(*words.of(texts), n)
            names, ids = digests(sets), batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), *(pa.nulls(len(sets), kind) for _, kind in _PACKED_ARROW)], schema=_OWN_ARROW)
            first = {d: i for i, d in reversed(list(enumerate(names))) if d is not None and ids[i] is not None}
            for row in packer.add([sets[i] for i in first.values()], list(first)):
                yield pa.RecordBatch.from_pylist([row], schema=_OWN_ARROW)
        for row in packer.flush():
            yield pa.RecordBatch.from_pylist([row], schema=_OWN_ARROW)

    return run


def _repacked(ranges: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, schema = Packer(ranges, 8), pa.schema(_PACKED_ARROW)
        for batch in batches:
            lists = batch.column("elements")
            ends = np.cumsum(np.asarray(lists.value_lengths(), "i8"))
            sets = np.split(lists.flatten().to_numpy(zero_copy_only=False).view("u8"), ends[:-1])
            for row in packer.add(sets, batch.column("digest").to_pylist()):
                yield pa.RecordBatch.from_pylist([row], schema=schema)
        for row in packer.flush():
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in table.column(name).to_pylist()), kind)


def _own_elements(table: pa.Table) -> pa.Table:
    """For each chunk's sets of a range, how many of their hashes no other class has there; copies of a class count once."""
    names, owners, counts, hashes = (_joined(table, c, kind) for c, kind in (("names", "S16"), ("owners", "u2"), ("counts", "u4"), ("hashes", "u4")))
    first = np.unique(names, return_index=True)[1]
    keep = np.zeros(len(names), bool)
    keep[first] = True
    kept = np.repeat(keep, counts)
    owner, hashes = np.repeat(np.arange(len(names), dtype="i4"), counts)[kept], hashes[kept]
    order = np.argsort(hashes)
    owner, hashes = owner[order], hashes[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]]
    alone = np.bincount(owner[new & np.r_[new[1:], True]], minlength=len(names)).astype("u4")
    sizes = [len(x) // 2 for x in table.column("owners").to_pylist()]
    cuts = np.cumsum(sizes)[:-1]
    some = [np.flatnonzero(a) for a in np.split(alone, cuts)]
    rows = [(c, o[k].tobytes(), a[k].tobytes()) for c, o, a, k in zip(table.column("chunk").to_pylist(), np.split(owners, cuts), np.split(alone, cuts), some, strict=True) if len(k)]
    chunk, own, count = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.string()), "owners": pa.array(own, pa.binary()), "counts": pa.array(count, pa.binary())})


def _chunk_sums(table: pa.Table) -> pa.Table:
    """Over all ranges, for each set of a chunk. Chunks of the same sets are one: their sets count in one of them each."""
    names, owners, counts = (_joined(table, c, kind) for c, kind in (("names", "V16"), ("owners", "u2"), ("counts", "u4")))
    alone = np.bincount(owners, counts, len(names)).astype("i8")
    return pa.table({"digest": pa.array([x.tobytes() for x in names], pa.binary()), "alone": pa.array(alone, pa.int64())})


def _possible(classes: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """The classes (digest, n) of which enough elements are in others too, with the number of those that aren't."""
    by_range = packed.where("range is not null").groupBy("range").applyInArrow(_own_elements, "chunk string, owners binary, counts binary")
    back = by_range.unionByName(packed.where("range is null").select("chunk", "names"), allowMissingColumns=True)
    alone = back.groupBy("chunk").applyInArrow(_chunk_sums, "digest binary, alone long").groupBy("digest").agg(F.sum("alone").alias("alone"))
    found = classes.join(alone, "digest", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    return found.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Which bits an odd number of elements fall on; bits are some four times the elements, a power of two."""
    width = 1 << max(LEAST_BITS, (4 * len(elements) - 1).bit_length())
    at = (elements * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) & np.uint64(width - 1)
    return np.packbits((np.bincount(at.astype("i8"), minlength=width) & 1).astype("u1"))


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as one of `size` bytes: halves laid over one another keep what is odd."""
    out = np.frombuffer(bits, "u1")
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _sets(n: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for _, texts in text_slices(batches):
            sets = [s for s in shingle_sets(*words.of(texts), n) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(digests(sets), pa.binary()), pa.array([bitmap(x).tobytes() for x in sets], pa.binary()), pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))], ["digest", "bits", "elements"])

    return run


def overlap_bound(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most elements that sets with these bitmaps (words of 64 bits, last axis) and sizes can share."""
    differ = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype="i8")
    return np.minimum((n_a + n_b - differ) // 2, np.minimum(n_a, n_b))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _enough(n_shared: object, n_a: object, n_b: object, percent: int) -> object:
    return 100 * n_shared >= percent * (n_a + n_b - n_shared)


def _linked(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with bitmaps and sets to those that are similar enough."""
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)):
                a, b = (batch.column(c)[i].values.to_numpy().view("u8") for c in ("of_a", "of_b"))
                least = min(len(x), len(y))
                if _enough(overlap_bound(folded(x, least).view("u8"), folded(y, least).view("u8"), len(a), len(b)), len(a), len(b), percent) and _enough(shared(a, b), len(a), len(b), percent):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough; of the b only the sets that are asked for are dealt out."""
    pairs = stored(pairs, "pairs")
    left = sets.select(F.col("node").alias("a"), F.col("bits").alias("bits_a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("bits").alias("bits_b"), F.col("elements").alias("of_b"))
    right = right.join(bounded(stored(pairs.select("b").distinct(), "leaders")), "b", "left_semi")
    return left.join(bounded(pairs), "a").join(right, "b").mapInArrow(_linked(percent), "a long, b long")


class _Cell:
    """The sets of a cell in order of size, and the blocks of its pairs that sizes, bands and bitmaps allow."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        self.percent = percent
        order = np.argsort(table.column("n").to_numpy(), kind="stable")
        self.table = table.take(pa.array(order))
        self.sizes = self.table.column("n").to_numpy()
        bits = self.table.column("bits").to_pylist()
        least = min(map(len, bits))  # sizes of a cell are within two bands, so widths differ by little
        self.bits = np.stack([folded(b, least) for b in bits]).view("u8")
        self.names, self.label = np.unique(self.table.column("label").to_numpy(), return_inverse=True)
        self.home = np.asarray(self.table.column("home"), bool)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs of different labels, one of them at home, whose overlap may suffice."""
        for i in range(0, len(self.sizes), BLOCK):
            for j in range(i, len(self.sizes), BLOCK):
                a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
                if 100 * self.sizes[a][-1] < self.percent * self.sizes[b][0]:
                    break
                n_a, n_b = self.sizes[a][:, None], self.sizes[b][None, :]
                can = (self.label[a][:, None] != self.label[b][None, :]) & (self.home[a][:, None] | self.home[b][None, :])
                can &= 100 * np.minimum(n_a, n_b) >= self.percent * np.maximum(n_a, n_b)
                can = np.triu(can) if i == j else can
                if can.any():
                    x, y = np.nonzero(can & _enough(overlap_bound(self.bits[a][:, None, :], self.bits[b][None, :, :], n_a, n_b), n_a, n_b, self.percent))
                    yield x + i, y + j


def _tile_candidates(percent: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """The pairs (node, other) of a cell that bitmaps allow; where these are many for its size, the sets in them instead, with no other."""
        cell = _Cell(table, percent)
        blocks, used, n = [], np.zeros(table.num_rows, bool), 0
        for x, y in cell.blocks():
            used[x] = used[y] = True
            n += len(x)
            if n <= MOST_PAIRS * table.num_rows:
                blocks.append((x, y))
        if n > MOST_PAIRS * table.num_rows:
            some = cell.table.filter(pa.array(used)).select(_CELL)
            return some.append_column("other", pa.nulls(some.num_rows, pa.int64()))
        x, y = (np.concatenate([b[k] for b in blocks]) for k in (0, 1)) if blocks else (np.zeros(0, "i8"),) * 2
        nodes = cell.table.column("node").to_numpy()
        return cell.table.take(pa.array(x)).select(_CELL).append_column("other", pa.array(nodes[y]))

    return run


def _tile_links(percent: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Pairs of labels with a link between sets of a cell, as many as connect them."""
        cell = _Cell(table, percent)
        elements = cell.table.column("elements").combine_chunks().flatten().to_numpy().view("u8")
        ends = np.cumsum(cell.sizes)
        sets = [elements[b - n : b] for b, n in zip(ends.tolist(), cell.sizes.tolist(), strict=True)]
        over = list(range(len(cell.names)))

        def top(x: int) -> int:
            while over[x] != x:
                over[x] = over[over[x]]
                x = over[x]
            return x

        out: list[tuple[int, int]] = []
        for pairs in cell.blocks():
            for x, y in zip(*(v.tolist() for v in pairs), strict=True):
                p, q = top(cell.label[x]), top(cell.label[y])
                if p != q and _enough(shared(sets[x], sets[y]), len(sets[x]), len(sets[y]), percent):
                    over[p] = q
                    out.append((int(cell.names[cell.label[x]]), int(cell.names[cell.label[y]])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


_CELL = ["tile", "band", "x", "y", "node", "label", "home"]


def _tiles(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of labels, from the sets (node, n, label, tile) of each tile, a row each."""
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    at = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band - 1).alias("band"), F.lit(False).alias("home"))))
    both = mixed.select("node", "n", "label", "tile", at.alias("at")).select("node", "n", "label", "tile", "at.*")
    plan = both.groupBy("tile", "band").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.max("home").alias("any_home"), F.min("label").alias("low"), F.max("label").alias("high")).where("any_home and low < high")
    plan = plan.select("tile", "band", F.greatest(F.ceil(F.col("members") / PART_SETS), F.ceil(F.col("weight") / PART_ELEMENTS), F.lit(1)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = both.join(bounded(stored(plan, "plan")), ["tile", "band"]).select("tile", "band", "node", "label", "home", own.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = stored(rows.select("tile", "band", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "node", "label", "home"), "cells")
    cell = ["tile", "band", "x", "y"]
    held = sets.select("node", "n", "bits").join(bounded(rows), "node")  # bitmaps first: few sets are dealt out whole
    some = held.groupBy(*cell).applyInArrow(_tile_candidates(percent), "tile long, band int, x int, y int, node long, label long, home boolean, other long")
    some = stored(some, "candidates")
    pairs = some.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    found = _confirmed(pairs, sets, percent)  # a pair may be in many tiles, and is decided once
    dense = stored(some.where("other is null").drop("other"), "dense")
    if dense.limit(1).count():
        found = found.unionByName(sets.join(bounded(dense), "node").groupBy(*cell).applyInArrow(_tile_links(percent), "a long, b long").distinct())
    return found


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between the sets (node, n, alone, bits, elements) whose components are those of all links."""
    first: Column = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1
    entries = sets.select("node", "n", (F.col("alone") / F.col("n")).alias("rank"), F.explode(F.slice("elements", F.lit(1), first.cast("int"))).alias("key"))
    several = entries.groupBy("key").count().where("count > 1").select("key")
    entries = stored(entries.join(several, "key"), "keys")

    def labelled(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return entries.withColumn("label", F.col("node"))
        return entries.join(bounded(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))

    edges, labels = None, None
    for turn in range(LEADERS):
        marked = labelled(labels)
        rank = F.col("rank") if turn == 0 else F.xxhash64("node", F.lit(turn)).cast("double")
        leaders = marked.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), F.col("node"), F.col("n"), F.col("label"))).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "lead")
        can = (F.col("label") != F.col("lead.label")) & (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n"))
        pairs = marked.join(leaders, "key").where(can).groupBy(F.col("node").alias("a")).agg(F.min("lead").alias("lead")).select("a", F.col("lead.node").alias("b"))
        found = stored(_confirmed(pairs, sets, percent), "led")
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges, "labels")
    marked = labelled(labels)
    kinds = marked.select("key", "label").distinct().groupBy("key").agg(F.count("*").alias("labels"), F.bit_xor(F.xxhash64("label")).alias("tile")).where("labels > 1").select("key", "tile")
    mixed = stored(marked.join(kinds, "key").select("node", "n", "label", "tile").distinct(), "mixed")
    return edges.unionByName(stored(_tiles(mixed, sets, percent), "tile-links"))


def similar(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs; documents link when 100 * intersection >= percent * union.

    ranges: of the hash space in the first count, of which a task holds one at a time; a third of the shuffle partitions if not given.
    """
    ranges = ranges or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 3)
    ranges += -ranges % EIGHTHS  # so that the part is a whole number of ranges
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = stored(rows.mapInArrow(_classes(words, ranges), _OWN), "classes")
    single = own.where("chunk is null").select("doc_id", "n_shingles", "digest")
    classes = single.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"))
    possible = stored(_possible(classes, own.where("chunk is not null"), percent), "possible")

    wanted = bounded(stored(possible.select(F.col("least").alias("doc_id")).distinct(), "wanted"))
    sets = rows.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(_sets(words), "digest binary, bits binary, elements array<long>")
    sets = sets.join(bounded(possible.select("digest")), "digest", "left_semi")
    if single.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["digest"])
    sets = stored(sets, "sets")
    again = sets.select("digest", "elements").mapInArrow(_repacked(ranges), _PACKED)
    left = _possible(possible.select("digest", "least", "n"), again, percent)
    left = stored(left.withColumn("node", F.monotonically_increasing_id()), "left")  # a short name, fixed once it is written
    sets = sets.join(bounded(left.select("digest", "node", "n", "alone")), "digest").drop("digest")

    labels = components(_links(sets, percent), "linked")
    named = stored(left.select("digest", "least", "node").join(bounded(labels), "node"), "named")
    ids = stored(named.groupBy("label").agg(F.min("least").alias("component_id")), "ids")
    found = stored(named.join(bounded(ids), "label").select("digest", "component_id"), "found")
    out = single.join(classes.select("digest", "least"), "digest", "left").join(bounded(found), "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "least", "doc_id")).alias("component_id"))
