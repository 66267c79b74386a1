"""Language identification, word first with backoff to character n-grams.

Known words add their log frequency in each language. An unseen word backs off: at each of its places the longest character
n-gram that the model knows adds its, a shorter one where the longer is unseen, down to single characters; the word counts as
their mean. A text's language is the one with the greatest sum; its score is the share of that language, with the sums divided
by the words so that long texts don't saturate. Frequencies are mixed with a uniform one, which is the same for all languages,
so that a language with few texts gains nothing from what it hasn't seen.

The classifier is fitted on a bounded sample, drawn by a hash of the id and text: about `FIT_ROWS` rows of each language, fewer
where there are so many languages that they would be more than `FIT_TOTAL` together, but `LEAST_ROWS` always. All languages are
learned, with all words and n-grams that the sample holds `LEAST_COUNT` times in a language.

Defined cases: null text, or text without a letter, is `und` with score 0; without any language learned all is `und`; each row
is predicted for itself; other columns are ignored; an empty table gives an empty result; very long texts and words are read
whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored, text_slices
from quire.llm.hashing import Table, mixed

#: Rows of a language that the model learns from, about; of all languages together; and of a language in any case.
FIT_ROWS, FIT_TOTAL, LEAST_ROWS = 5_000, 100_000, 20
#: Times that the sample holds what the model keeps; share of the uniform frequency.
LEAST_COUNT, UNIFORM = 2, 0.05
LONGEST = 4
#: Words remembered in a Python worker, and numbers held for them or for the n-grams of new words.
MEMORY, CELLS = 300_000, 4_000_000
EDGES = ".,;:!?\"'()[]{}<>|%&$#*+-_=/\\0123456789"


class Rows:
    """A row of log frequencies for each item, a column for each language; only what differs from `floor` is held."""

    def __init__(self, column: np.ndarray, item: np.ndarray, n: np.ndarray, items: int, languages: int) -> None:
        order = np.argsort(item, kind="stable")
        item, n, self.column = item[order], n[order].astype("f8"), column[order].astype("i4")
        self.first = np.searchsorted(item, np.arange(items + 1))
        total = np.maximum(np.bincount(column, n[np.argsort(order)], languages), 1)
        self.floor = float(np.log(UNIFORM / (items + 1)))
        self.more = (np.log((1 - UNIFORM) * n / total[self.column] + UNIFORM / (items + 1)) - self.floor).astype("f4")
        self.languages = languages

    def get(self, items: np.ndarray) -> np.ndarray:
        sizes = self.first[items + 1] - self.first[items]
        at = np.arange(sizes.sum()) + np.repeat(self.first[items] - (np.cumsum(sizes) - sizes), sizes)
        out = np.full((len(items), self.languages), self.floor, "f4")
        out[np.repeat(np.arange(len(items)), sizes), self.column[at]] += self.more[at]
        return out


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def window_hashes(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    h = np.full(len(at), np.uint64(length) * np.uint64(0xD6E8FEB86659), "u8")
    for k in range(length):
        h = mixed(h, codes[at + k])
    return h


class Model:
    """Words and n-grams with their rows."""

    def __init__(self, languages: list[str], words: tuple[list[str], list[str], np.ndarray], grams: tuple[list[str], list[str], np.ndarray]) -> None:
        """From (language, item, count) of words and of n-grams, as columns."""
        self.languages = languages
        self.words, self.word_rows = self._rows(*words)
        index, self.gram_rows = self._rows(*grams)
        keys, ids = [np.zeros(0, "u8")], [np.zeros(0, "i8")]
        for length in range(1, LONGEST + 1):
            own = [g for g in index if len(g) == length]
            keys.append(window_hashes(code_points(own), np.arange(len(own)) * length, length))
            ids.append(np.asarray([index[g] for g in own], "i8"))
        self.grams = Table(np.concatenate(keys), np.concatenate(ids))

    def _rows(self, langs: list[str], items: list[str], counts: np.ndarray) -> tuple[dict[str, int], Rows]:
        column = {lang: i for i, lang in enumerate(self.languages)}
        index: dict[str, int] = {}
        item = np.asarray([index.setdefault(x, len(index)) for x in items], "i8")
        return index, Rows(np.asarray([column[x] for x in langs], "i8"), item, np.asarray(counts), len(index), len(self.languages))

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own, or the mean over its places of the longest known n-gram there."""
        out = np.zeros((len(words), len(self.languages)), "f4")
        known = np.fromiter((self.words.get(w, -1) for w in words), "i8", len(words))
        seen = np.flatnonzero(known >= 0)
        out[seen] = self.word_rows.get(known[seen])
        new, step = np.flatnonzero(known < 0), max(1, CELLS // max(1, len(self.languages)))
        sizes = np.fromiter((len(words[i]) + 2 for i in new.tolist()), "i8", len(new))
        block = np.cumsum(sizes) // step
        for b in np.unique(block):
            mine = new[block == b]
            out[mine] = self._unseen([f" {words[i]} " for i in mine.tolist()])
        return out

    def _unseen(self, padded: list[str]) -> np.ndarray:
        codes, sizes = code_points(padded), np.fromiter(map(len, padded), "i8", len(padded))
        word = np.repeat(np.arange(len(padded)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        gram, open_ = np.full(len(codes), -1), np.arange(len(codes))
        for length in range(LONGEST, 0, -1):
            at = open_[left[open_] >= length]
            where, ids = self.grams.find(window_hashes(codes, at, length))
            gram[at[where]] = ids
            open_ = np.flatnonzero(gram < 0)
        out = np.zeros((len(padded), len(self.languages)), "f4")
        found = np.flatnonzero(gram >= 0)
        if len(found):
            own, first, n = np.unique(word[found], return_index=True, return_counts=True)
            out[own] = np.add.reduceat(self.gram_rows.get(gram[found]), first, axis=0, dtype="f8") / n[:, None]
        return out


def clean(piece: bytes) -> str:
    return piece.decode("utf-8", "replace").strip(EDGES).lower()


class Pieces(dict):
    """A number for each piece between white space, and its row: letters or not, then a column for each language."""

    def __init__(self, model: Model) -> None:
        self.model, self.fresh = model, []
        self.rows = np.zeros((0, len(model.languages) + 1), "f4")

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n

    def _new(self, pieces: list[bytes]) -> np.ndarray:
        words = [clean(p) for p in pieces]
        letters = np.fromiter((w[:1].isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))
        out = np.zeros((len(words), len(self.model.languages) + 1), "f4")
        out[letters, 0] = 1
        out[letters, 1:] = self.model.of([w for w, letter in zip(words, letters.tolist(), strict=True) if letter])
        return out

    def sums(self, texts: list[bytes]) -> np.ndarray:
        if len(self) > min(MEMORY, CELLS // self.rows.shape[1]):
            self.clear()
            self.rows = self.rows[:0]
        get, numbers, sizes = self.__getitem__, [], []
        for t in texts:
            pieces = t.split()
            sizes.append(len(pieces))
            numbers += map(get, pieces)
        if self.fresh:
            new, self.fresh = self.fresh, []
            self.rows = np.concatenate([self.rows, self._new(new)])
        end = np.cumsum(sizes)
        out = np.zeros((len(texts), self.rows.shape[1]))
        numbers = np.asarray(numbers, "i8")
        for i, (a, b) in enumerate(zip(end - sizes, end, strict=True)):
            if b > a:
                out[i] = self.rows[numbers[a:b]].sum(axis=0, dtype="f8")
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _counts(rows: DataFrame) -> DataFrame:
    """lang, kind (word or gram), item, n of (lang, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            pieces: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                pieces.setdefault(lang, Counter()).update(text.split())
            for lang, counts in pieces.items():
                words, grams = Counter(), Counter()
                for piece, n in counts.items():
                    word = clean(piece)
                    if any(c.isalpha() for c in word):
                        words[word] += n
                for word, n in words.items():
                    padded = f" {word} "
                    for k in range(1, LONGEST + 1):
                        for i in range(len(padded) - k + 1):
                            grams[padded[i : i + k]] += n
                for kind, c in (("word", words), ("gram", grams)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array([kind] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "kind", "item", "n"])

    return rows.mapInArrow(run, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame) -> Model:
    """A model of (doc_id, text, lang); rows without text or lang teach nothing."""
    rows = rows.where("lang is not null and text is not null")
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("rows")), "langid-sizes")  # a row a language
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    each = max(LEAST_ROWS, min(FIT_ROWS, FIT_TOTAL // max(1, len(languages))))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(sizes.select("lang", (each / F.col("rows")).alias("share")), "lang").where(draw < F.col("share")).select("lang", "text")
    counts = stored(_counts(sample).where(F.col("n") >= LEAST_COUNT), "langid-counts")
    found = []
    for kind in ("word", "gram"):  # what the driver gets is bounded by the sample
        own = counts.where(F.col("kind") == kind).orderBy("lang", "item").select("lang", "item", "n").toArrow()
        found.append((own.column("lang").to_pylist(), own.column("item").to_pylist(), own.column("n").to_numpy()))
    return Model(languages, *found)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pieces = Pieces(model)
        for batch, texts in text_slices(batches):
            sums = pieces.sums(texts)
            known = (sums[:, 0] > 0) & bool(model.languages)
            if model.languages:
                mean = sums[:, 1:] / np.maximum(sums[:, :1], 1)
                best = mean.argmax(axis=1)
                share = 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best = share = np.zeros(len(texts), "i8")
            names = [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0))], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(rows.where(~held_out(F.col("doc_id"))))
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
