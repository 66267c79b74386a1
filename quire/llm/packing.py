"""Packing by concatenate and cut.

Documents lie in blocks by a hash of their id and text, within a block by id and text. The first pass encodes them and keeps
each one's place in its block; running sums over the blocks' totals give each block's place in the one long run of tokens. The
second pass adds the two and cuts documents where fixed windows end: a document over a boundary has a piece on either side.

Defined cases: null text counts as empty, which still is one end token; rows that agree in id and text are packed each, in any
order; an empty table gives an empty result; extra columns are ignored; very long texts and words are encoded whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import give_back, released, stored, text_slices
from quire.llm.token_counts import byte_alphabet, default_vocabulary

#: Rows of a block on average, and the least and most blocks; the table of blocks is what is broadcast.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 1024, 1024, 1 << 17

#: Bytes of a word that the step by step merges take; a step passes over all symbols, so longer words go to the library.
STEP_BYTES = 256

#: Pieces that a Python worker remembers, twice, and their words; and the bytes of either. One is some 200 bytes of memory beside its own.
MEMORY, MEMORY_BYTES = 200_000, 8 << 20

#: Bytes of text encoded at once; the pieces of a text weigh some ten times as much as the text.
ENCODED_BYTES = 1 << 20

#: A mark after a letter and before white space is a word of its own; set apart, it leaves fewer pieces to remember.
MARK = re.compile(rb"[.,!?;:](?<=[a-z].)(?=[\x20\x09-\x0D])")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class PairTable:
    """Rank of a pair of symbols, for arrays of pairs: a hash table with 16 slots a pair or more, whose few collisions go to a smaller one."""

    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.tables = []
        for factor in self.FACTORS:
            bits = len(keys).bit_length() + 4
            slot = self._slot(keys, factor, bits)
            held, kept = np.full(1 << bits, -1, "i8"), np.zeros(1 << bits, "i4")
            held[slot], kept[slot] = keys, values
            self.tables.append((factor, bits, held, kept))
            left = held[slot] != keys
            keys, values = keys[left], values[left]
            if not len(keys):
                return
        raise ValueError("pairs collide in all tables")

    def _slot(self, keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view("u8") * np.uint64(factor)) >> np.uint64(64 - bits)).view("i8")

    def get(self, left: np.ndarray, right: np.ndarray, default: int) -> np.ndarray:
        keys = left.astype("i8") << 20 | right
        out = np.full(len(keys), default, "i4")
        for factor, bits, held, kept in self.tables:
            slot = self._slot(keys, factor, bits)
            hit = np.flatnonzero(held[slot] == keys)
            out[hit] = kept[slot[hit]]
        return out


def _without(matrix: np.ndarray, each: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The matrix with one element less in each row."""
    stays = np.ones(matrix.shape, bool)
    stays[each, column] = False
    return matrix[stays].reshape(len(matrix), matrix.shape[1] - 1)


class Encoder:
    """Ids as the library gives them, as little-endian 32-bit bytes.

    Tokens never hold white space, so the pieces between it are encoded for themselves and remembered, within a bound. For a
    vocabulary of words with end marks and byte symbols the merges run here, for all new words of a batch at once; very long
    words, pieces with special tokens, and other kinds of vocabulary, go to the library.
    """

    NONE = (1 << 31) - 1

    def __init__(self, path: str) -> None:
        self.path = path
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.by_word: dict[str, bytes] = {}
        self.piece_bytes = self.word_bytes = 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.own = model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        if self.own:
            ids, end = model["vocab"], model["end_of_word_suffix"]
            self.words = regex.compile(steps[0]["pattern"]["Regex"] + r"|\n")
            self.inner = np.asarray([ids[x] for x in byte_alphabet()], "i4")
            self.last = np.asarray([ids[x + end] for x in byte_alphabet()], "i4")
            pairs = np.asarray([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], "i8")
            self.pairs, self.merged = PairTable(pairs[:, 0] << 20 | pairs[:, 1], np.arange(len(pairs))), pairs[:, 2].astype("i4")
            two = np.arange(1 << 16)  # what two bytes give, as most lookups are of these
            self.of_inner, self.of_last = (self.pairs.get(self.inner[two >> 8], b[two & 255], self.NONE) for b in (self.inner, self.last))

    @cached_property
    def tokenizer(self):
        """The library's, loaded when a piece needs it: few texts do, and an idle worker would hold it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of non-empty words. Words of as many symbols are rows of a matrix; those with a pair to merge, the lowest and of equals the first, go on to the words of one symbol less."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), "i8", len(words))
        order, out = np.argsort(lengths, kind="stable"), [b""] * len(words)
        raw = np.frombuffer(b"".join(map(words.__getitem__, order.tolist())), "u1")
        firsts = np.searchsorted(lengths[order], np.arange(lengths.max() + 2))
        end = len(raw)
        row, symbol, found = np.zeros(0, "i8"), np.zeros((0, 0), "i4"), np.zeros((0, 0), "i4")
        for n in range(len(firsts) - 2, 0, -1):
            own = order[firsts[n] : firsts[n + 1]]
            if len(own):
                part = raw[end - n * len(own) : end].reshape(-1, n)
                end -= part.size
                fresh = self.inner[part]
                fresh[:, -1] = self.last[part[:, -1]]
                two = part[:, :-1].astype("i4") << 8 | part[:, 1:]
                pairs = self.of_inner[two]
                pairs[:, -1:] = self.of_last[two[:, -1:]]
                row, symbol, found = map(np.concatenate, ((row, own), (symbol, fresh), (found, pairs))) if len(row) else (own, fresh, pairs)
            if not len(row):
                continue
            at = found.argmin(axis=1) if n > 1 else np.zeros(len(row), "i8")
            best = found[np.arange(len(row)), at] if n > 1 else np.full(len(row), self.NONE)
            done = best == self.NONE
            ids = symbol[done].astype("<u4").tobytes()
            for k, r in enumerate(row[done].tolist()):
                out[r] = ids[4 * n * k : 4 * n * (k + 1)]
            go = np.flatnonzero(~done)
            row, symbol, found, at = row[go], symbol[go], found[go], at[go]
            if not len(row):
                continue
            each = np.arange(len(row))
            symbol[each, at] = self.merged[best[go]]
            symbol, found = _without(symbol, each, at + 1), _without(found, each, at)
            for side in (at - 1, at):  # the pairs beside the merged one are new
                new = np.flatnonzero((side >= 0) & (side < n - 2))
                a = side[new]
                found[new, a] = self.pairs.get(symbol[new, a], symbol[new, a + 1], self.NONE)
        return out

    def library(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, pieces: set[bytes], special: bool = True) -> None:
        """special: whether pieces may hold special tokens."""
        new = pieces.difference(self.known)
        self.piece_bytes += sum(map(len, new))
        if len(self.known) + len(new) > MEMORY or self.piece_bytes > MEMORY_BYTES:
            self.older, self.known, new = self.known, {}, set(pieces)  # what is still in use moves on
            self.piece_bytes = sum(map(len, new))
        again = new.intersection(self.older) if self.older else set()
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new.difference_update(again)
        other = [p for p in new if not self.own or b"<|" in p] if special or not self.own else []
        self.known.update(zip(other, self.library([p.decode("utf-8", "replace") for p in other]), strict=True))
        plain = list(new.difference(other) if other else new)
        if self.own and plain:
            # all at once, a line each; lower-cased one by one: str.lower() looks at a final sigma's place
            lines = unicodedata.normalize("NFC", b"\n".join(plain).decode("utf-8", "replace")).replace("Σ", "σ").lower().split("\n")
            single = list(map(str.isalpha, lines))  # letters alone are one word
            several = list(map(not_, single))
            words = self.words.findall("\n".join(compress(lines, several))) if any(several) else []
            kinds = set(compress(lines, single)).union(words)
            kinds.discard("\n")
            fresh = list(kinds.difference(self.by_word))
            self.word_bytes += sum(map(len, fresh))
            if len(self.by_word) + len(fresh) > MEMORY or self.word_bytes > MEMORY_BYTES:
                self.by_word, fresh = {}, list(kinds)
                self.word_bytes = sum(map(len, fresh))
            raw = list(map(str.encode, fresh))
            short = [len(b) <= STEP_BYTES for b in raw]
            self.by_word.update(zip(compress(fresh, short), self.merge(list(compress(raw, short))), strict=True))
            long = list(compress(fresh, map(not_, short)))
            self.by_word.update(zip(long, self.library(long), strict=True))
            known = self.by_word.__getitem__
            self.known.update(zip(compress(plain, single), map(known, compress(lines, single)), strict=True))
            ids, out = [], []
            for w in words:
                if w == "\n":
                    out.append(b"".join(ids))
                    ids = []
                else:
                    ids.append(known(w))
            if any(several):
                out.append(b"".join(ids))
            self.known.update(zip(compress(plain, several), out, strict=True))

    def forget(self) -> None:
        """Drops what is remembered: a worker that stands idle keeps the vocabulary alone."""
        self.known, self.older, self.by_word = {}, {}, {}
        self.piece_bytes = self.word_bytes = 0

    def encode(self, texts: list[bytes], end: bytes = b"") -> list[bytes]:
        special = [b"<|" in t for t in texts]
        split = [(t if x or not self.own else MARK.sub(rb" \g<0>", t.lower())).split() for t, x in zip(texts, special, strict=True)]
        self.learn(set().union(*split), any(special))
        known = self.known.__getitem__
        return [b"".join(map(known, pieces)) + end for pieces in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    own = Encoder(path)
    give_back()  # what was read of the file
    return own


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(blocks)).cast("int")


def shrunk(ids: bytes) -> bytes:
    """Ids below 65536 in two bytes each, after a byte that says so."""
    x = np.frombuffer(ids, "<u4")
    return b"\x02" + x.astype("<u2").tobytes() if x.max(initial=0) < 1 << 16 else b"\x04" + ids


def widened(small: bytes) -> bytes:
    return np.frombuffer(small, "<u2", offset=1).astype("<u4").tobytes() if small[0] == 2 else small[1:]


def cut(offset: int, tokens: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset there) of its pieces."""
    at = 0
    while at < tokens:
        sequence, place = divmod(offset + at, window)
        length = min(window - place, tokens - at)
        yield at, length, sequence, place
        at += length


def pack(docs: DataFrame, window: int = 4096, end_id: int = 2, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.asarray([end_id], "<u4").tobytes()
    blocks = max(LEAST_BLOCKS, min(MOST_BLOCKS, docs.count() // BLOCK_ROWS))

    @released
    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, place = encoder(vocabulary or default_vocabulary()), None, 0
        for batch, texts in text_slices(batches, most=ENCODED_BYTES):
            ids, places = own.encode(texts, end), []
            for b, x in zip(batch.column("block").to_pylist(), ids, strict=True):
                block, place = (block, place) if b == block else (b, 0)
                places.append(place)
                place += len(x) // 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), pa.array(places, pa.int64()), pa.array(map(shrunk, ids), pa.binary())], ["doc_id", "block", "place", "ids"])
        own.forget()

    placed = _placed(docs, id_col, text_col).withColumn("block", _block(blocks)).repartition("block").sortWithinPartitions("block", "doc_id", "text_key")
    tokens = stored(placed.select("doc_id", "text", "block").mapInArrow(walk, "doc_id long, block int, place long, ids binary"), "pack-tokens")
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    width = F.when(F.substring("ids", 1, 1) == F.unhex(F.lit("02")), 2).otherwise(4)
    totals = tokens.groupBy("block").agg(F.sum(((F.octet_length("ids") - 1) / width).cast("long")).alias("tokens"))
    starts = stored(totals.select("block", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("block_start")), "pack-blocks")

    @released
    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, place, small in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "ids")), strict=True):
                ids = widened(small)
                n = len(ids) // 4
                out += [(doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, sequence, offset) for at, length, sequence, offset in cut(place, n, window)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    # starts has at most MOST_BLOCKS rows of 12 bytes
    return tokens.join(F.broadcast(starts), "block").select("doc_id", (F.col("block_start") + F.col("place")).alias("place"), "ids").mapInArrow(pieces, PIECES)
