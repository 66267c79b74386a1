"""Quality rules: simple text counts, and perplexity of a character n-gram model with modified Kneser-Ney smoothing.

Spark counts the 5-grams of characters of each language's different texts, a text being its words with one space after each, so
that n-grams run on across words. Counts of shorter n-grams are the numbers of different characters before them, contexts and
numbers of counts (for the discounts) are aggregates of all of them, and joins of each length with the one below give every
5-gram of the corpus its interpolated probability: the model has all n-grams. The probabilities of the most frequent 5-grams, at
most `HELD`, go to the tasks as a table of hashes; the other 5-grams of a text are joined, and their words' sums completed by it,
so the bound decides where a probability is found and not what it is.

A document's perplexity is that of a word, its characters taken with the model of its language: marks that junk hangs on words
cost a word something however well one character of them foretells the next. Each language has a band of log perplexity from its different
texts that pass the base rules: the shortest interval with half of them gives the centre, that of the longer half of the texts
the spread, which less than half of junk can't carry off, however far away it lies. To it comes what the words of a text vary by
chance, the median variance of a text's words over their number, so that short texts have a wider band.
Documents outside the band on either side are rejected, as are those that fail the base
rules, and those of a language that has no text that passes.

Defined cases: null text counts as empty (no words, rejected); a null language is a language of its own; every row is judged
for itself, also repeated ones; an empty table gives an empty result; very long texts and words are read whole; other columns
are ignored (`keep_good` carries them along, whatever their names).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quire.llm.common import bounded, released, stored, text_slices, unused

ORDER = 5
#: 5-grams whose probabilities the tasks hold at most, all languages together; the others are joined.
HELD = 2_000_000
#: For a smaller model: n-grams of each length that it keeps at most, all languages together; None for the whole model.
KEPT: int | None = None
#: Robust standard deviations that a band reaches to either side: of texts, and of the mean of a text's words; the least one of texts.
REACH, WORD_REACH, LEAST_SPREAD = 5.0, 3.5, 0.15
#: Words remembered in a Python worker, n-grams counted before they are handed on, characters looked up together.
MEMORY, HELD_GRAMS, TOGETHER = 150_000, 1_000_000, 500_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Bytes of text held as arrays of characters at once: some 60 bytes of memory for each.
SLICE = 1 << 20
#: Bits of a character's number while n-grams are counted: five of them fit a 64-bit key.
BITS = 12

FEATURES = "doc_id long, text_key long, model_lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_sum double, square_sum double"
#: Beside them, in rows of their own: the 5-grams of a row's words that aren't held. The first of a word has the word's other log probabilities.
OPEN = "row_id long, word long, gram string, known double"
FOUND = pa.schema([(name, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in f"{FEATURES}, {OPEN}".split(", "))])

_rng = np.random.default_rng(20240607)
FACTORS = _rng.integers(0, 1 << 64, ORDER, dtype="u8") | np.uint64(1)


def character_hashes(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (codes.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def row_hashes(language: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of each row of code points with its language's number: a sum over places, counted from the end."""
    with np.errstate(over="ignore"):
        out = character_hashes(language + 0x200000)
        for t in range(codes.shape[1]):
            out = out + character_hashes(codes[:, codes.shape[1] - 1 - t]) * FACTORS[t]
        return out


def window_hashes(language: int, codes: np.ndarray) -> np.ndarray:
    """row_hashes of the windows of ORDER characters of a stream, by their ends; those that would start before it get 0."""
    out, lead = np.zeros(len(codes), "u8"), ORDER - 1
    own = character_hashes(np.asarray([language]) + 0x200000)[0]
    for at in range(lead, len(codes), TOGETHER):
        part = character_hashes(codes[at - lead : at + TOGETHER])
        n = len(part) - lead
        with np.errstate(over="ignore"):
            out[at : at + n] = own
            for t in range(ORDER):
                out[at : at + n] += part[lead - t : lead - t + n] * FACTORS[t]
    return out


class Sorted:
    """Hashes in order, each with a number; an index over their first bits, about one a hash, tells where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        keys = keys[order]
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype="u8") << self.shift).astype("i4")
        self.keys = np.r_[keys, np.uint64(0xFFFFFFFFFFFFFFFF)]
        self.values = np.r_[values[order], np.nan].astype("f4")

    def get(self, keys: np.ndarray) -> np.ndarray:
        """NaN where a hash is missing."""
        at = self.first[keys >> self.shift]
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.float32(np.nan))
        open_ = np.flatnonzero(held < keys)
        while len(open_):
            at[open_] += 1
            held = self.keys[at[open_]]
            same = open_[held == keys[open_]]
            out[same] = self.values[at[same]]
            open_ = open_[held < keys[open_]]
        return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """For counts 0, 1, 2 and above, from the numbers of n-grams with counts 1 to 4."""
    n = [max(1, x) for x in (n1, n2, n3, n4)]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *(float(np.clip(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1, k + 0.9)) for k in range(3))]


class KneserNey:
    """Interpolated modified Kneser-Ney model of several languages, built up from single characters."""

    def __init__(self, languages: int) -> None:
        self.grams: dict[int, Sorted] = {}
        self.contexts: dict[int, Sorted] = {}
        self.floor = np.zeros(languages)

    def add(self, order: int, discount: np.ndarray, language: np.ndarray, codes: np.ndarray, counts: np.ndarray, of_context: np.ndarray, context: np.ndarray, total: np.ndarray, mass: np.ndarray) -> None:
        """The n-grams of one length that are kept, and their contexts with all counts and what the kept ones take of them."""
        keys = row_hashes(of_context, context)
        order_of = np.argsort(keys)
        weight = np.maximum(1 - mass / total, 1e-9)
        where = order_of[np.searchsorted(keys[order_of], row_hashes(language, codes[:, :-1]))] if len(codes) else np.zeros(0, "i8")
        p = (counts - discount[language, np.minimum(counts, 3)]) / total[where]
        if order > 1:
            lower = self._rows(language, codes[:, 1:])
        else:
            lower = self.floor[language]
        p = np.log(p + weight[where] * np.exp(lower))
        self.grams[order], self.contexts[order] = Sorted(row_hashes(language, codes), p), Sorted(keys, np.log(weight))

    def _look_up(self, n: int, order: int, own: Callable, before: Callable, floor: Callable) -> np.ndarray:
        out, left = np.zeros(n), np.arange(n)
        for k in range(order, 0, -1):
            p = self.grams[k].get(own(k, left))
            seen = ~np.isnan(p)
            out[left[seen]] += p[seen]
            left = left[~seen]
            if not len(left):
                return out
            out[left] += np.nan_to_num(self.contexts[k].get(before(k, left)))
        out[left] += floor(left)
        return out

    def _rows(self, language: np.ndarray, codes: np.ndarray) -> np.ndarray:
        size = codes.shape[1]
        own = lambda k, i: row_hashes(language[i], codes[i, size - k :])
        before = lambda k, i: row_hashes(language[i], codes[i, size - k : size - 1])
        return self._look_up(len(codes), size, own, before, lambda i: self.floor[language[i]])

    def stream(self, language: int, codes: np.ndarray) -> np.ndarray:
        """Log probability of each character after the ones before it; the first ORDER - 1 get 0."""
        out, lead = np.zeros(len(codes)), ORDER - 1
        if not self.grams:
            return out
        own_language = character_hashes(np.asarray([language]) + 0x200000)[0]
        for at in range(lead, len(codes), TOGETHER):
            part = character_hashes(codes[at - lead : at + TOGETHER])
            n = len(part) - lead
            with np.errstate(over="ignore"):
                sums = [np.full(len(part), own_language)]
                for t in range(ORDER):  # sums[k][i]: the k characters that end at i
                    last = sums[-1].copy()
                    last[t:] += part[: len(part) - t] * FACTORS[t]
                    sums.append(last)
            own = lambda k, i: sums[k][i + lead]  # noqa: E731,B023
            before = lambda k, i: sums[k - 1][i + lead - 1]  # noqa: E731,B023
            out[at : at + n] = self._look_up(n, ORDER, own, before, lambda i: np.full(len(i), self.floor[language]))
        return out


def streamed(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts given as words, each text ORDER - 1 spaces and then its words with a space after each; and the texts' lengths, 0 without words."""
    texts = [" " * (ORDER - 1) + b" ".join(w).decode("utf-8", "replace") + " " if w else "" for w in words]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, texts), "i8", len(texts))


class GramCounts:
    """Counts of 5-grams by language, as keys of character numbers."""

    def __init__(self) -> None:
        self.number = np.zeros(0x110000, "u8")
        self.characters = np.zeros(1, "<u4")
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, language: str, codes: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts the windows that end at `ends`; yields what has to be handed on first."""
        present = np.unique(codes)
        fresh = present[self.number[present] == 0]
        if len(self.characters) + len(fresh) > 1 << BITS:
            yield from self.flush()
            fresh = present
        if len(fresh) >= 1 << BITS:  # too many characters for the keys: two halves
            for part in (ends[: len(ends) // 2], ends[len(ends) // 2 :]):
                low = part[0] - ORDER + 1
                yield from self.add(language, codes[low : part[-1] + 1], part - low)
            return
        self.number[fresh] = np.arange(len(self.characters), len(self.characters) + len(fresh))
        self.characters = np.r_[self.characters, fresh]
        number, keys = self.number[codes], np.zeros(len(ends), "u8")
        for k in range(ORDER - 1, -1, -1):
            keys = keys << np.uint64(BITS) | number[ends - k]
        own = self.held.setdefault(language, [])
        own.append(np.unique(keys, return_counts=True))
        if len(own) > 1 and sum(len(k) for k, _ in own[1:]) > len(own[0][0]):
            own[:] = [self._merged(own)]
        if sum(len(k) for parts in self.held.values() for k, _ in parts) > HELD_GRAMS:
            yield from self.flush()

    def _merged(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype("i8")

    def flush(self) -> Iterator[pa.RecordBatch]:
        for language, parts in self.held.items():
            keys, counts = self._merged(parts)
            for at in range(0, len(keys), 100_000):
                own = keys[at : at + 100_000]
                codes = np.stack([self.characters[(own >> np.uint64(BITS * k)) & np.uint64((1 << BITS) - 1)] for k in range(ORDER - 1, -1, -1)], axis=1)
                text = np.ascontiguousarray(codes, "<u4").tobytes().decode("utf-32-le", "replace")
                grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams)), pa.array(grams), pa.array(counts[at : at + 100_000], pa.int64())], ["lang", "gram", "n"])
        self.held.clear()
        self.number[:] = 0
        self.characters = np.zeros(1, "<u4")


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all texts of (lang, text)."""

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = GramCounts()
        for batch, texts in text_slices(batches, most=SLICE):
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                codes, sizes = streamed([texts[i].split() for i in np.flatnonzero(langs == lang)])
                ends = characters(sizes)
                if len(ends):
                    yield from held.add(lang, codes, ends)
        yield from held.flush()

    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def characters(sizes: np.ndarray) -> np.ndarray:
    """Places of a stream that aren't the spaces before a text."""
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.flatnonzero(place >= ORDER - 1)


def code_points(grams: pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of code points; Python strings are made for a bounded number at a time."""
    out = np.empty((len(grams), size), "u4")
    for at in range(0, len(grams) if size else 0, 500_000):
        part = "".join(grams.slice(at, 500_000).to_pylist()).encode("utf-32-le", "surrogatepass")
        out[at : at + 500_000] = np.frombuffer(part, "<u4").reshape(-1, size)
    return out


def levels(rows: DataFrame) -> Iterator[tuple[int, list[Row], np.ndarray, DataFrame]]:
    """For n-grams of each length, from 1: the length, a row a language with numbers of counts, discounts, and (lang, gram, n, number, kept, less)."""
    found = [stored(count_grams(rows), "grams")]
    for _ in range(ORDER - 1):  # how many n-grams end so
        found.append(stored(found[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "grams"))
    for order, level in enumerate(reversed(found), 1):
        few = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
        stats = level.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), *few).orderBy("lang").collect()  # a row a language
        discount = np.asarray([discounts(r["n1"], r["n2"], r["n3"], r["n4"]) for r in stats]).reshape(-1, 4)
        least = [len(stats) * r["total"] / KEPT if KEPT else 0.0 for r in stats]
        limits = level.sparkSession.createDataFrame([(r["lang"], i, least[i], 1 / (1 + r["kinds"]), *discount[i, 1:].tolist()) for i, r in enumerate(stats)], "lang string, number int, least double, floor double, d1 double, d2 double, d3 double")
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        yield order, stats, discount, level.join(F.broadcast(limits), "lang").select("lang", "gram", "n", "number", "floor", (F.col("n") >= F.col("least")).alias("kept"), less.alias("less"))


def of_contexts(level: DataFrame, order: int, key: str) -> DataFrame:
    """key, context, with all counts of its n-grams, and what the kept ones take of them (null if none is kept)."""
    return level.groupBy(key, F.substring("gram", 1, order - 1).alias("context")).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("kept"), F.col("n") - F.col("less"))).alias("mass"))


def probabilities(rows: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """The languages of (lang, text), lang not null, by number, and lang, number, gram, n, logp of every 5-gram."""
    number, lower = {}, None
    for order, stats, _, level in levels(rows):
        number = {r["lang"]: i for i, r in enumerate(stats)}
        all_of = of_contexts(level, order, "lang")
        joined = level.withColumn("context", F.substring("gram", 1, order - 1)).join(all_of, ["lang", "context"])
        if lower is None:
            joined = joined.withColumn("lower", F.col("floor"))
        else:
            joined = joined.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower, ["lang", "suffix"])
        own = F.when(F.col("kept"), (F.col("n") - F.col("less")) / F.col("total")).otherwise(0.0)
        weight = F.when(F.col("mass").isNull(), 1.0).otherwise(F.greatest(1 - F.col("mass") / F.col("total"), F.lit(1e-9)))
        p = joined.select("lang", "number", "gram", "n", (own + weight * F.col("lower")).alias("p"))
        lower = p.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    return number, stored(p.select("lang", "number", "gram", "n", F.log("p").alias("logp")), "grams-p")


def held(grams: DataFrame) -> tuple[Sorted, bool]:
    """The table of the most frequent of `probabilities`, and whether it has all of them. The driver gets at most HELD short rows."""
    step = F.floor(F.log2("n") * 16).cast("int")
    least, taken = 0, 0
    for r in grams.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 1,024 rows
        taken += r["count"]
        if taken > HELD:
            least = r["step"] + 1
            break
    rows = grams.where(step >= least).select("number", "gram", "logp").toArrow()
    keys = row_hashes(rows.column("number").to_numpy(), code_points(rows.column("gram"), ORDER))
    return Sorted(keys, rows.column("logp").to_numpy()), least == 0


def train(rows: DataFrame) -> tuple[dict[str, int], KneserNey]:
    """A model of KEPT n-grams a length for texts that (lang, text) needn't have, with the languages by number. The driver gets what is kept; the queries take `probabilities`."""
    if KEPT is None:
        raise ValueError("a model on the driver needs a bound")
    model, number = None, {}
    for order, stats, discount, level in levels(rows):
        if model is None:
            number = {r["lang"]: i for i, r in enumerate(stats)}
            model = KneserNey(len(stats))
            model.floor = -np.log(1.0 + np.asarray([r["kinds"] for r in stats]))
        if not stats:
            return number, model
        kept = level.where("kept").select("number", "gram", "n").toArrow()
        contexts = of_contexts(level, order, "number").where("mass is not null").toArrow()
        column = lambda table, name: table.column(name).to_numpy()
        model.add(order, discount, column(kept, "number"), code_points(kept.column("gram"), order), column(kept, "n"), column(contexts, "number"), code_points(contexts.column("context"), order - 1), column(contexts, "total"), column(contexts, "mass"))
    return number, model


class Words(dict):
    """A number for each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over runs of the given sizes, 0 for empty runs."""
    through = np.r_[values.dtype.type(0), np.cumsum(values)]
    end = np.cumsum(sizes)
    return through[end] - through[end - sizes]


def repeat_words(numbers: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows that it has twice or more."""
    n = len(numbers) - window + 1
    if n <= 0:
        return np.zeros(len(sizes), "i8")
    text = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        mixed = (numbers.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        key = (text[:n].astype("u8") + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in range(window):
            key = (key ^ mixed[k : n + k]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(29)
    whole = np.flatnonzero(text[:n] == text[window - 1 :])
    order = whole[np.argsort(key[whole], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    cover = np.zeros(len(numbers) + 1, "i8")
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return sums((np.cumsum(cover[:-1]) > 0).astype("i8"), sizes)


def dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if line.strip())


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def language_key(lang: str) -> Column:
    return F.coalesce(F.concat(F.lit("l:"), F.col(lang).cast("string")), F.lit("none"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and log perplexity of each row, in the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _text_key(text_col).alias("text_key"), language_key(lang_col).alias("lang"))
    copied = rows.groupBy("lang", "text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1").select("lang", "text_key", "first", F.lit(True).alias("copied"))
    once = rows.join(bounded(stored(copied, "copied")), ["lang", "text_key"], "left").where(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("first")))
    number, grams = probabilities(once.select("lang", "text"))
    table, whole = held(grams)
    shared = docs.sparkSession.sparkContext.broadcast((number, table))  # at most HELD hashes and floats

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (number, table), ids = shared.value, Words()
        for batch, texts in text_slices(batches, most=SLICE):
            if len(ids) > MEMORY:
                ids.clear()
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            row_ids = batch.column("row_id").to_numpy()
            out, logp, squares = np.zeros((len(texts), 5), "i8"), np.zeros(len(texts)), np.zeros(len(texts))
            for lang in set(langs.tolist()):
                mine = np.flatnonzero(langs == lang)
                words = [texts[i].split() for i in mine]
                sizes = np.fromiter(map(len, words), "i8", len(words))
                out[mine, 0] = sizes
                out[mine, 4] = repeat_words(np.asarray([i for w in words for i in map(ids.__getitem__, w)], "i8"), sizes)
                codes, length = streamed(words)
                after = characters(length)
                out[mine, 1] = np.maximum(length - ORDER + 1, 0) - sizes
                if not len(after):
                    continue
                p = table.get(window_hashes(number[lang], codes)[after]).astype("f8")
                ends = np.flatnonzero(codes[after] == 32)  # a word has no space but the one after it
                missing = np.flatnonzero(np.isnan(p))
                p[missing] = 0.0
                of_word = np.diff(np.cumsum(p)[ends], prepend=0.0)
                if len(missing):
                    word = np.searchsorted(ends, missing)
                    first = np.r_[True, word[1:] != word[:-1]]
                    yield from open_rows(lang, np.repeat(row_ids[mine], sizes)[word], word, codes, after[missing], np.where(first, of_word[word], 0.0))
                    of_word[word] = 0.0
                logp[mine], squares[mine] = sums(of_word, sizes), sums(of_word**2, sizes)
            out[:, 2] = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
            out[:, 3] = [dup_lines(t) for t in texts]
            own = [batch.column("doc_id"), batch.column("text_key"), batch.column("lang"), *(pa.array(out[:, k]) for k in range(5)), pa.array(logp), pa.array(squares), batch.column("row_id")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(texts), f.type) for f in list(FOUND)[len(own) :])], schema=FOUND)

    found = stored(rows.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(run, f"{FEATURES}, {OPEN}"), "features")
    own = found.where("word is null").drop("word", "gram", "known")
    own = own.drop("row_id") if whole else completed(own, found.where("word is not null"), grams)
    n = F.greatest("n_words", F.lit(1))
    own = own.withColumn("log_ppl", -F.col("log_sum") / n)
    return own.withColumn("word_var", F.greatest(F.col("square_sum") / n - F.col("log_ppl") * F.col("log_ppl"), F.lit(0.0))).drop("log_sum", "square_sum")


def open_rows(language: str, row_ids: np.ndarray, word: np.ndarray, codes: np.ndarray, ends: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of OPEN, with the language and otherwise empty FEATURES, for the windows of a stream that have these ends."""
    for at in range(0, len(ends), 100_000):
        part = slice(at, at + 100_000)
        n = len(ends[part])
        text = np.ascontiguousarray(codes[ends[part, None] + np.arange(1 - ORDER, 1)], "<u4").tobytes().decode("utf-32-le", "replace")
        own = {"model_lang": pa.array([language] * n), "row_id": pa.array(row_ids[part]), "word": pa.array(word[part]), "gram": pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)]), "known": pa.array(known[part])}
        yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(n, f.type) for f in FOUND], schema=FOUND)


def completed(rows: DataFrame, missing: DataFrame, grams: DataFrame) -> DataFrame:
    """rows with the sums over words whose 5-grams weren't all held, their probabilities joined."""
    joined = missing.select(F.col("model_lang").alias("lang"), "row_id", "word", "gram", "known").join(grams.select("lang", "gram", "logp"), ["lang", "gram"])
    words = joined.groupBy("row_id", "word").agg(F.sum(F.col("known") + F.col("logp")).alias("of_word"))
    more = words.groupBy("row_id").agg(F.sum("of_word").alias("more"), F.sum(F.col("of_word") * F.col("of_word")).alias("more_squares"))
    plus = lambda c, extra: (F.col(c) + F.coalesce(F.col(extra), F.lit(0.0))).alias(c)
    same = [c for c in rows.columns if c not in ("row_id", "log_sum", "square_sum")]
    return stored(rows.join(more, "row_id", "left").select(*same, plus("log_sum", "more"), plus("square_sum", "more_squares")), "features")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def shortest_half(value: Column) -> Column:
    """centre and spread (as a standard deviation, if normal) of the shortest interval with half of a group's values."""
    q = F.percentile_approx(value, F.array(*[F.lit(k / 200) for k in range(201)]), 10_000)
    halves = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: F.struct((F.get(q, k + 100) - F.get(q, k)).alias("length"), ((F.get(q, k + 100) + F.get(q, k)) / 2).alias("centre")))
    best = F.array_min(halves)
    return F.struct(best["centre"].alias("centre"), (best["length"] / (2 * 0.6745)).alias("spread"))


def bands(rows: DataFrame) -> DataFrame:
    """model_lang, centre, spread, word_var of log perplexity: one row a language, from its different texts that pass the base rules."""
    texts = rows.where(~base_failed()).groupBy("model_lang", "text_key").agg(*[F.first(c).alias(c) for c in ("log_ppl", "n_words", "word_var")])
    texts = stored(texts, "learned")
    median = lambda c: F.percentile_approx(c, 0.5, 10_000)
    own = stored(texts.groupBy("model_lang").agg(shortest_half(F.col("log_ppl"))["centre"].alias("centre"), median("word_var").alias("word_var"), median("n_words").alias("middle")), "centres")
    longer = texts.drop("word_var").join(own, "model_lang").where("n_words >= middle").groupBy("model_lang", "centre", "word_var")
    return longer.agg(F.greatest(shortest_half(F.col("log_ppl"))["spread"], F.lit(LEAST_SPREAD)).alias("spread"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """features with base_failed, ppl, lower and upper (the band that the text's number of words gives) and kept."""
    rows = features(docs, id_col, text_col, lang_col)
    limits = stored(bands(rows), "bands")  # a row a language
    reach = F.sqrt(F.pow(REACH * F.col("spread"), 2) + WORD_REACH**2 * F.col("band_var") / F.greatest("n_words", F.lit(1)))
    joined = rows.join(limits.withColumnRenamed("word_var", "band_var"), "model_lang", "left").withColumn("lower", F.exp(F.col("centre") - reach)).withColumn("upper", F.exp(F.col("centre") + reach)).withColumn("ppl", F.exp("log_ppl"))
    inside = F.col("ppl").between(F.col("lower"), F.col("upper"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ppl, lower, upper."""
    return judge(docs, id_col, text_col, lang_col).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ppl", "lower", "upper")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    own_id, key, lang, bad_id, bad_key, bad_lang = unused(docs, 6)
    bad = judge(docs, id_col, text_col, lang_col).where(~F.col("kept")).select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key), F.col("model_lang").alias(bad_lang)).distinct()
    keyed = docs.withColumns({own_id: F.col(id_col).cast("long"), key: _text_key(text_col), lang: language_key(lang_col)})
    match = F.col(own_id).eqNullSafe(F.col(bad_id)) & (F.col(key) == F.col(bad_key)) & (F.col(lang) == F.col(bad_lang))
    return keyed.join(bounded(stored(bad, "bad")), match, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
