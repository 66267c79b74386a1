"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at white space; each piece is normalised and cut to words as the vocabulary file says; a word's symbols form a
linked list, its adjacent pairs a heap by merge rank (then place). The lowest pair is popped and merged until none is left.
The count is the initial symbols less the merges; no ids are made. Counts of pieces are remembered, within a bound.

Defined cases: null text counts as empty (0 tokens); strings of special tokens in a text count one each, as in the library;
extra columns are ignored; an empty table gives an empty result; a very long word is merged whole, in n log n steps.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_slices

#: Pieces remembered in a Python worker, and bytes of one that is; beyond the number the memory starts anew.
MEMORY, SHORT = 400_000, 64

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next from code point 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    moved = {b: 256 + i for i, b in enumerate(others)}
    return [chr(moved.get(b, b)) for b in range(256)]


def pieces_words(piece: bytes, pattern: regex.Pattern) -> tuple[str, ...] | list[str]:
    """The words of a piece of text without white space, normalised. Letters alone, or with one mark at the end, need no pattern."""
    text = piece.decode("utf-8", "replace")
    if not piece.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # str.lower() looks at a final sigma's place, the library doesn't
    text = text.lower()
    if text.isalpha():
        return (text,)
    if text[-1:] in ".,;:!?" and text[:-1].isalpha():
        return (text[:-1], text[-1])
    return pattern.findall(text)


class Merger:
    """Counts tokens of a vocabulary file of kind BPE with ends of words, lower-casing and byte symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.alphabet = byte_alphabet()
        self.by_word: dict[str, int] = {}
        self.by_piece: dict[bytes, int] = {}

    def count_word(self, word: str) -> int:
        symbols: list[str | None] = [self.alphabet[b] for b in word.encode()]
        symbols[-1] += self.end
        n = count = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None:
                heap.append((r, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the pair was merged since
            symbols[i], symbols[j], k = a + b, None, after[j]
            after[i] = k
            count -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return count

    def count_piece(self, piece: bytes) -> int:
        if b"<|" in piece:
            text = piece.decode("utf-8", "replace")
            return len(self.special.findall(text)) + sum(self.count_plain(x.encode()) for x in self.special.split(text))
        return self.count_plain(piece)

    def count_plain(self, piece: bytes) -> int:
        total, known = 0, self.by_word
        for word in pieces_words(piece, self.words):
            n = known.get(word)
            if n is None:
                n = self.count_word(word)
                if len(known) >= MEMORY:
                    known.clear()
                if len(word) < SHORT:
                    known[word] = n
            total += n
        return total

    def count(self, text: bytes) -> int:
        """Tokens of a text. White space is never part of a token, so its pieces count for themselves."""
        total, known = 0, self.by_piece
        for piece in text.split():
            n = known.get(piece)
            if n is None:
                n = self.count_piece(piece)
                if len(known) >= MEMORY:
                    known.clear()
                if len(piece) < SHORT:
                    known[piece] = n
            total += n
        return total


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit. Without a path the executors find the vocabulary themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(vocabulary or default_vocabulary())
        for batch, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(own.count, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
