"""Exact deduplication by a minimal perfect hash over the distinct digests of the history.

Texts are equal when they are identical after each run of white space is replaced by one space. The history's distinct
digests are dealt to shards; each shard holds a minimal perfect hash (levels of bit vectors, ranked) whose slots keep the
full 32-byte digest and the winner's doc_id. A new digest is looked up in its shard and is a repeat only if all 32 bytes of
the slot agree; the others are grouped among themselves.

Defined cases: null text counts as empty; a null id comes after all others; of rows that agree in id and text one is kept;
an empty table gives an empty result; very long texts are read whole; other columns are ignored (`drop_repeats` carries them
along, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, stored, unused

DIGEST = np.dtype("S32")
#: Bits a key in each level of the perfect hash.
GAMMA = 2.0
#: Digests that one shard holds on average.
SHARD_ROWS = 50_000

INDEX = "shard int, n long, levels array<binary>, digests binary, winners binary"
FOUND = "digest binary, winner long, member boolean, id long, copies long"


def digest(text: Column) -> Column:
    """sha256 of the text in UTF-8 with white space runs replaced by one space, as 32 bytes."""
    runs = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"  # a lone space stands for itself
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), runs, " "), 256))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, dtype="<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words[:, 0] ^ (words[:, 1] * np.uint64(2 * level + 1)) ^ (words[:, 2] + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x % np.uint64(bits)


def build_hash(digests: bytes) -> tuple[list[bytes], np.ndarray]:
    """Bit vectors of a minimal perfect hash over distinct digests, and the slot of each. Keys alone on their place of a level are settled there; the rest go on to the next."""
    words = _words(digests)
    slot, left, levels, settled = np.zeros(len(words), "i8"), np.arange(len(words)), [], 0
    while len(left):
        bits = max(64, int(len(left) * GAMMA) // 8 * 8 + 8)
        place = _place(words[left], len(levels), bits)
        alone = np.bincount(place, minlength=bits)[place] == 1
        taken = np.zeros(bits, "u1")
        taken[place[alone]] = 1
        slot[left[alone]] = settled + (np.cumsum(taken) - 1)[place[alone]]
        settled += int(alone.sum())
        left = left[~alone]
        levels.append(np.packbits(taken).tobytes())
    return levels, slot


def look_up(levels: list[bytes], digests: bytes) -> np.ndarray:
    """The slot that the hash gives each digest, -1 where no level has it; a nonmember may get any slot."""
    words = _words(digests)
    slot, left, settled = np.full(len(words), -1, "i8"), np.arange(len(words)), 0
    for level, packed in enumerate(levels):
        taken = np.unpackbits(np.frombuffer(packed, "u1"))
        place = _place(words[left], level, len(taken))
        hit = taken[place] == 1
        slot[left[hit]] = settled + (np.cumsum(taken) - 1)[place[hit]]
        settled += int(taken.sum())
        left = left[~hit]
    return slot


def _build(table: pa.Table) -> pa.Table:
    digests = b"".join(table.column("digest").to_pylist())
    levels, slot = build_hash(digests)
    n = len(slot)
    held, winners = np.zeros(n, DIGEST), np.zeros(n, "<i8")
    held[slot] = np.frombuffer(digests, DIGEST)
    ids = table.column("winner").to_numpy(zero_copy_only=False)
    winners[slot] = ids
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n": [n], "levels": pa.array([levels], pa.list_(pa.binary())), "digests": pa.array([held.tobytes()], pa.binary()), "winners": pa.array([winners.tobytes()], pa.binary())})


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard from distinct (digest, winner); winner must not be null."""
    return history.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(_build, INDEX)


def _probe(index: pa.Table, new: pa.Table) -> pa.Table:
    member, winner = np.zeros(new.num_rows, bool), np.zeros(new.num_rows, "i8")
    if index.num_rows and new.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        digests = b"".join(new.column("digest").to_pylist())
        slot = look_up(row["levels"], digests)
        full, keys = _words(row["digests"]), _words(digests)  # compared as numbers: a text type would drop zero bytes at the end
        member = (slot >= 0) & (full[slot] == keys).all(axis=1)
        winner = np.where(member, np.frombuffer(row["winners"], "<i8")[slot], 0)
    return pa.table({"digest": new.column("digest").cast(pa.binary()), "winner": pa.array(winner, mask=~member), "member": pa.array(member), "id": new.column("id"), "copies": new.column("copies")})


def probe(index: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """Looks distinct new digests (digest, id, copies) up in the index."""
    right = new.withColumn("shard", shard_of(shards))
    return index.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(_probe, FOUND)


def groups(rows: DataFrame, pivot: int | None) -> DataFrame:
    """digest, keep_id, group_size of rows (id, digest, copies): ids up to the pivot are the history, the others are new."""
    old = F.coalesce(F.col("id") <= F.lit(pivot), F.lit(False))
    by_digest = lambda df: df.groupBy("digest").agg(F.min("id").alias("id"), F.sum("copies").alias("copies"))
    history = stored(by_digest(rows.where(old)), "history")
    shards = max(64, 1 << (history.count() // SHARD_ROWS).bit_length())
    index = stored(build_index(history.select("digest", F.col("id").alias("winner")), shards), "index")
    new = probe(index, by_digest(rows.where(~old)), shards)
    found = new.select("digest", F.when(F.col("member"), F.col("winner")).otherwise(F.col("id")).alias("id"), "copies")
    return history.unionByName(found).groupBy("digest").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest and the number of rows that agree in both, in the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"))
    return stored(rows.groupBy("id", "digest").agg(F.count("*").alias("copies")), "digests")


def decide(rows: DataFrame) -> DataFrame:
    """id, digest, copies with keep_id and group_size. The history is the lower half of the range of ids, so its winners stay winners."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    repeated = stored(groups(rows, None if low is None else low + (high - low) // 2).where("group_size > 1"), "groups")
    joined = rows.join(repeated, "digest", "left")  # AQE splits a hot digest, or broadcasts if the groups are few
    return joined.select("id", "digest", "copies", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    out = decide(digests(docs, id_col, text_col)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = digests(docs, id_col, text_col)
    gone = stored(decide(rows).where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "digest"), "gone")
    own_id, own_digest, gone_id, gone_digest = unused(docs, 4)
    keyed = docs.withColumns({own_id: F.col(id_col).cast("long"), own_digest: digest(F.col(text_col))})
    right = gone.select(F.col("id").alias(gone_id), F.col("digest").alias(gone_digest))
    key = F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(own_digest) == F.col(gone_digest))
    kept = keyed.join(bounded(right), key, "left_anti")
    if rows.where("copies > 1").limit(1).count():
        kept = kept.dropDuplicates([own_id, own_digest])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
