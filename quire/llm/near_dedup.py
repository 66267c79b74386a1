"""Near-duplicates of word shingle sets by min-max hashing.

Each permutation of the hashed shingles gives two values, the least and the greatest, so half as many are evaluated. Values
are cut to bands; documents that agree in a band share a bucket. Documents with equal sets are one node. In a bucket, all
nodes are held against one, the node with the largest share of shingles that others have too; links are confirmed on full
sets, and linked nodes become components. Nodes that can't be linked are left out by an exact bound: a shingle that no other
node in any bucket has can't be shared, which leaves most with too few. What remains of a bucket in more than one component is
held against each other in cells of bounded size. So a large group of copies doesn't become all its pairs as rows, and no link
that the bands find is lost.

Bands: 25 of 5 values from 63 permutations (the last one's greatest value is not used) miss a pair of similarity 0.85 with probability 4e-7, one of 0.8 with 5e-5.

Defined cases: null text counts as empty; documents without words are linked with nothing; fewer words than a shingle has are
one shingle; rows with a null id are left alone; rows that share an id are one node each per set of shingles, and stay or go each for itself; other columns are ignored
(`keep_one` carries them along); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, released, stored, text_slices, unused
from quire.llm.graph import components

BANDS, ROWS = 25, 5
PERMUTATIONS = (BANDS * ROWS + 1) // 2
#: Words remembered in a Python worker.
MEMORY = 250_000
#: Nodes of a part of a bucket, and shingles of theirs, about.
PART_NODES, PART_SHINGLES = 1024, 500_000

_rng = np.random.default_rng(20240501)
FLIP = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype="u8")
FACTOR = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype="u8") | np.uint64(1)


class WordHashes(dict):
    """A number for each word, and its 64-bit hash."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []
        self.hashes = np.zeros(0, "u8")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words of all texts, and how many each text has; A-Z are lower-cased."""
        if len(self) > MEMORY:
            self.clear()
            self.hashes = np.zeros(0, "u8")
        get, out, sizes = self.__getitem__, [], []
        for t in texts:
            words = t.lower().split()  # of bytes, so only A-Z change and only ASCII white space splits
            sizes.append(len(words))
            out += map(get, words)
        if self.fresh:
            new, self.fresh = self.fresh, []
            self.hashes = np.r_[self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), "u8", len(new))]
        return self.hashes[np.asarray(out, "i8")], np.asarray(sizes, "i8")


def shingle_sets(words: np.ndarray, sizes: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles."""
    with np.errstate(over="ignore"):

        def mixed(h: np.ndarray) -> np.ndarray:
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(32))

        h = np.zeros(max(0, len(words) - n + 1), "u8")
        for k in range(n):
            h = mixed((h + np.uint64(k + 1)) ^ words[k : len(words) - n + 1 + k]) if len(h) else h
        out, start = [], 0
        for size in sizes.tolist():
            if size >= n:
                out.append(np.unique(h[start : start + size - n + 1]))
            elif size:
                x = np.full(1, np.uint64(1000 + size))
                for w in words[start : start + size]:
                    x = mixed(x ^ w)
                out.append(x)
            else:
                out.append(np.zeros(0, "u8"))
            start += size
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band hashes for each set that isn't empty."""
    sizes = np.fromiter(map(len, sets), "i8", len(sets))
    starts, joined = np.cumsum(sizes) - sizes, np.concatenate(sets)
    values = np.empty((len(sets), 2 * PERMUTATIONS), "u8")
    with np.errstate(over="ignore"):
        for k in range(PERMUTATIONS):
            v = (joined ^ FLIP[k]) * FACTOR[k]
            values[:, 2 * k], values[:, 2 * k + 1] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
        out = np.tile(np.arange(1, BANDS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15), (len(sets), 1))
        for r in range(ROWS):
            out = (out ^ values[:, r : BANDS * ROWS : ROWS]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return out


def _signatures(n: int) -> object:
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch, texts in text_slices(batches):
            sets = shingle_sets(*words.of(texts), n)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = iter(bands([sets[i] for i in full]).view("i8").tolist() if full else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "n_shingles", "digest", "bands"],
            )

    return run


def _full_sets(n: int) -> object:
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch, texts in text_slices(batches):
            sets = shingle_sets(*words.of(texts), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))], ["id", "digest", "shingles"])

    return run


def _enough(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b with so many shared elements have the similarity."""
    return 100 * shared >= percent * (a + b - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").where(_enough(shared, F.size("of_a"), F.size("of_b"), percent)).select("a", "b")


def _cells(marked: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components of which members in one bucket are similar enough.

    A bucket's members are dealt to parts of bounded size, those of its largest component apart from the others. A cell holds
    two parts, and there is none for two parts of the largest component. Sets of a cell are intersected as a product of
    matrices, so pairs of documents never become rows.
    """
    parts = lambda members, weight: F.greatest(F.ceil(members / PART_NODES), F.ceil(weight / PART_SHINGLES), F.lit(1)).cast("int")
    plan = mixed.select("bucket", F.col("major.label").alias("major"), parts(F.col("major.members"), F.col("major.weight")).alias("large"), parts(F.col("members") - F.col("major.members"), F.col("weight") - F.col("major.weight")).alias("small"))
    rows = marked.join(plan, "bucket").withColumn("in_major", F.col("label") == F.col("major"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("in_major"), F.col("large")).otherwise(F.col("small"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("small") - 1)
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    of_major = F.transform(others, lambda y: cell("large", F.col("part"), y))
    with_major = F.transform(F.sequence(F.lit(0), F.col("large") - 1), lambda x: cell("large", x, F.col("part")))
    with_others = F.transform(others, lambda y: cell("small", F.least(F.col("part"), y), F.greatest(F.col("part"), y)))
    rows = rows.select("bucket", "node", "label", "in_major", F.explode(F.when(F.col("in_major"), of_major).otherwise(F.concat(with_major, with_others))).alias("cell"))
    full = rows.select("bucket", "cell.kind", "cell.x", "cell.y", "node", "label").join(sets, "node").select("bucket", "kind", "x", "y", "label", "shingles")

    def run(table: pa.Table) -> pa.Table:
        label = table.column("label").to_numpy()
        shingles = table.column("shingles").combine_chunks()
        size = np.asarray(shingles.value_lengths(), "i8")
        shared = intersections(shingles.flatten().to_numpy(zero_copy_only=False), size)
        enough = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
        i, j = np.nonzero(np.triu(enough & (label[:, None] != label[None, :])))
        pairs = np.unique(np.stack([np.minimum(label[i], label[j]), np.maximum(label[i], label[j])], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return full.groupBy("bucket", "kind", "x", "y").applyInArrow(run, "a long, b long").distinct()


def intersections(elements: np.ndarray, sizes: np.ndarray, columns: int = 2048) -> np.ndarray:
    """How many elements each two sets share; the sets' elements follow one another."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, column, n = np.unique(elements, return_inverse=True, return_counts=True)
    held = n[column] > 1
    row, column = row[held], (np.cumsum(n > 1) - 1)[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.diag(sizes).astype("f4")
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        block = np.zeros((len(sizes), columns), "f4")
        block[row[a:b], column[a:b] - at] = 1
        out += block @ block.T
    np.fill_diagonal(out, sizes)
    return out.astype("i8")


def _linked(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """doc_id, text_key, n_shingles, component_id of each row of docs, with a number of its component (null without words), and whether rows share an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = stored(keyed.mapInArrow(_signatures(words), "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>"), "signatures")
    repeats = own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    classes = own.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # classes are numbered by their smallest id, unless an id may be that of several
    classes = stored(classes, "classes").withColumn("node", F.monotonically_increasing_id() if repeats else F.col("id"))
    classes = stored(classes, "classes") if repeats else classes

    # buckets of two nodes or more, and the full sets of their nodes
    entries = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    entries = stored(entries.join(shared, "bucket"), "entries")
    involved = stored(entries.select("node").distinct().join(classes.select("node", "id", "digest"), "node"), "involved")
    wanted = bounded(involved.select(F.col("id").alias("doc_id")).distinct())
    texts = rows.join(wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(_full_sets(words), "id long, digest binary, shingles array<long>")
    sets = sets.join(involved, ["id", "digest"]).select("node", "shingles")
    if repeats:
        sets = sets.dropDuplicates(["node"])
    sets = stored(sets, "sets")

    # a shingle that one node alone has can't be shared: nodes left with too few are done, which may leave others alone
    nodes = sets.select("node", F.size("shingles").cast("long").alias("n"))
    common = None
    for _ in range(2):
        tokens = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
        alone = tokens.groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("nodes")).where("nodes = 1").groupBy("node").agg(F.count("*").alias("alone"))
        common = nodes.select("node", "n").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
        nodes = stored(common.where(_enough(F.col("common"), F.col("n"), F.col("common"), percent)), "nodes")
    entries = stored(entries.select("bucket", "node").join(nodes, "node"), "live")

    # all members of a bucket against the one with the largest common share
    share = F.col("common") / F.col("n")
    leaders = entries.groupBy("bucket").agg(F.min(F.struct((-share).alias("rank"), F.col("node"), F.col("n"), F.col("common"))).alias("lead"), F.count("*").alias("members")).where("members > 1")
    pairs = entries.join(leaders.select("bucket", "lead"), "bucket").where(F.col("node") != F.col("lead.node"))
    pairs = pairs.where(_enough(F.least("common", "lead.common"), F.col("n"), F.col("lead.n"), percent)).select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct()
    stars = stored(_confirmed(pairs, sets, percent), "stars")
    labels = components(stars, "first")

    # what else may be linked in a bucket: members of different components, held against each other cell by cell
    marked = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = marked.groupBy("bucket", "label").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    mixed = by_label.groupBy("bucket").agg(F.max(F.struct("members", "label", "weight")).alias("major"), F.sum("members").alias("members"), F.sum("weight").alias("weight")).where("members > major.members")
    more = stored(_cells(marked, mixed, sets, percent), "more")
    over = components(more, "second") if more.limit(1).count() else more.select(F.col("a").alias("node"), F.col("b").alias("label"))
    over = over.select(F.col("node").alias("label"), F.col("label").alias("higher"))
    ends = labels.select("label").unionByName(over.select("label")).distinct()
    labels = labels.unionByName(ends.select(F.col("label").alias("node"), "label")).distinct().join(over, "label", "left").select("node", F.coalesce("higher", "label").alias("label")).distinct()

    found = classes.select("digest", "id", "node").join(labels, "node", "left").select("digest", "id", F.coalesce("label", "node").alias("component"))
    if repeats:
        found = stored(found, "found")
        least = found.groupBy("component").agg(F.min("id").alias("component_id"))
        found = found.join(least, "component").select("digest", "component", "component_id")
    else:
        found = found.select("digest", "component", F.col("component").alias("component_id"))
    rows = own.drop("bands").join(found, "digest", "left")
    return rows.select("doc_id", "text_key", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id")), repeats


def link(docs: DataFrame, words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    return _linked(docs, words, percent, id_col, text_col)[0].select("doc_id", "n_shingles", "component_id")


def near_dedup(docs: DataFrame, words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    return link(docs, words, percent, id_col, text_col).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one of each component stays (the smallest id; of texts that share it, one), with all their columns. Rows alike in id and text stay or go together."""
    own_id, own_key, gone_id, gone_key = unused(docs, 4)
    found, repeats = _linked(docs, words, percent, id_col, text_col)
    others = found.where("doc_id != component_id")
    keyed, match = docs.withColumn(own_id, F.col(id_col).cast("long")), F.col(own_id) == F.col(gone_id)
    if repeats:
        found = stored(found.where("doc_id is not null and component is not null"), "near-found")
        stays = found.where("doc_id = component_id").groupBy("component").agg(F.min("text_key").alias("stays"))
        others = found.join(stays, "component").where("doc_id != component_id or text_key != stays")
        keyed, match = keyed.withColumn(own_key, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), match & (F.col(own_key) == F.col(gone_key))
    gone = others.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    kept = keyed.join(bounded(stored(gone, "near-gone")), match, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
