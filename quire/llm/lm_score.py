"""Language model scores by a lattice over subword pieces.

The pieces are those of an existing vocabulary file. Their scores there are the first weights (a rank r counts as 1 / (r + 10)
where scores are ranks); expectation maximisation over the word counts of the training texts fits them to the corpus. A word's
probability is the sum over all its segmentations, by forward recursion in log space, with bytes for characters that are no
pieces; a text's is the product over its words and one end. `vocab_score` is the same with the first weights alone. Beside them
stands a plain word model with add-one counts.

Texts are held once, as chunks of word numbers. A chunk's own words are dealt to buckets by their hash and travel as one
compressed row for each chunk and bucket: to the bucket, where all chunks' words meet, are counted and priced, and back to the
chunk as columns of numbers. So what is shuffled is a chunk's vocabulary, packed, and never a row a token. The number of buckets
grows with the bytes of text, which bounds what one bucket holds.

Defined cases: null text counts as empty (its end alone); a null id counts as a training row; each row is scored for itself;
other columns are ignored; an empty table gives an empty result; without training rows the scores are those of the first weights;
a very long text is a chunk of its own, and a very long word takes time in proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored, text_slices
from quire.llm.hashing import Table, mixed

#: Rounds of expectation maximisation, and what each piece's expected count gets added.
ROUNDS, ADDED = 3, 0.1
#: Tokens of a chunk, and different words, about (a longer text alone may have more); they bound a worker's memory.
CHUNK_TOKENS, CHUNK_WORDS = 6_000_000, 400_000
#: Bytes of text for each bucket of words, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 16
#: Characters of words whose lattices are built together; longer words than LONG_WORD have a lattice for themselves.
TOGETHER_CHARS, LONG_WORD = 400_000, 256
#: Positions of a long word whose edges are sought together.
LONG_STEP = 100_000
START = 0x2581
LN10 = float(np.log(10))

#: A row a chunk with its texts (bucket is null), and a row for each bucket of its words.
CHUNKS = "chunk long, bucket int, doc_ids array<long>, held array<boolean>, lengths array<int>, codes binary, words binary, trained binary"
#: A row a bucket with its different words (chunk is null), and a row for each chunk: which of them are the chunk's.
MERGED = "bucket int, chunk long, words binary, counts binary, codes binary, tokens long, kinds long"
PRICED = "chunk long, bucket int, counts binary, logp binary, vocab_logp binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, vocab_score double"


def packed_words(words: list[bytes]) -> bytes:
    """Words without white space, at least one."""
    return zstandard.compress(b"\n".join(words))


def unpacked_words(packed: bytes) -> list[bytes]:
    return zstandard.decompress(packed).split(b"\n")


def packed_numbers(values: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes, then the next ones, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view("u1").reshape(len(values), values.itemsize).T).tobytes())


def unpacked_numbers(packed: bytes, kind: str) -> np.ndarray:
    """Numbers of the kind (as numpy names it) that were packed."""
    raw = np.frombuffer(zstandard.decompress(packed), "u1")
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def hashed(codes: np.ndarray) -> np.ndarray:
    """Hashes of rows of code points."""
    h = np.zeros(len(codes), "u8")
    for k in range(codes.shape[1]):
        h = mixed(h, codes[:, k])
    return h


class Pieces:
    """The pieces of a vocabulary file that can occur in a word: 256 bytes first, then texts, and one end."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts, scores = [], []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and chr(START) not in piece[1:]:
                texts.append(piece)
                scores.append(model.get_score(i))
        self.longest = max(map(len, texts))
        scores = np.asarray(scores)
        weights = np.exp(scores) if scores.min(initial=0) > -100 else 1 / (10 - scores)
        self.first = np.r_[np.full(256, weights.min() / 256), weights, weights.max()]
        # each beginning of a piece, with the piece's number where it is one
        numbers: dict[str, int] = {t[:k]: -1 for t in texts for k in range(1, len(t))}
        numbers.update(zip(texts, range(256, 256 + len(texts)), strict=True))
        found, keys = list(numbers), np.zeros(len(numbers), "u8")
        sizes = np.fromiter(map(len, found), "i8", len(found))
        for length in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == length)
            codes = np.frombuffer("".join([found[i] for i in mine]).encode("utf-32-le"), "<u4").reshape(-1, length)
            keys[mine] = hashed(codes)
        self.table = Table(keys, np.fromiter(numbers.values(), "i8", len(numbers)))
        self.size = len(self.first)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def utf8(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(where, bytes) of the first, second, ... byte of each code point."""
    c = codes.astype("i8")
    n = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    lead = np.choose(n - 1, [c, 0xC0 | c >> 6, 0xE0 | c >> 12, 0xF0 | c >> 18])
    out = [(np.ones(len(c), bool), lead)]
    for k in range(1, 4):
        out.append((n > k, 0x80 | (c >> np.maximum(0, 6 * (n - 1 - k)) & 0x3F)))
    return out


class Lattice:
    """Sums over segmentations with given log probabilities of the pieces."""

    def __init__(self, pieces: Pieces, logp: np.ndarray) -> None:
        self.pieces, self.logp = pieces, logp
        self.byte_logp = logp[:256]

    def _fallback(self, codes: np.ndarray) -> np.ndarray:
        return sum(np.where(where, self.byte_logp[b], 0.0) for where, b in utf8(codes))

    def _one_length(self, codes: np.ndarray, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        m, n = codes.shape
        edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        forward = [np.zeros(m)] + [np.full(m, -np.inf) for _ in range(n)]
        single = [self._fallback(codes[:, s]) for s in range(n)]
        for s in range(n):
            rows, h = np.arange(m), np.zeros(m, "u8")
            for e in range(s + 1, min(n, s + self.pieces.longest) + 1):
                h = mixed(h, codes[rows, e - 1])
                alive, piece = self.pieces.table.find(h)
                if not len(alive):
                    break  # no piece begins so
                rows, h = rows[alive], h[alive]
                whole = piece >= 0
                if whole.any():
                    hit, p = rows[whole], piece[whole]
                    forward[e][hit] = np.logaddexp(forward[e][hit], forward[s][hit] + self.logp[p])
                    if expected is not None:
                        edges[s, e] = hit, p
            forward[s + 1] = np.logaddexp(forward[s + 1], forward[s] + single[s])
        if expected is not None:
            backward = [np.full(m, -np.inf) for _ in range(n)] + [np.zeros(m)]
            for s in range(n - 1, -1, -1):
                for e in range(s + 1, min(n, s + self.pieces.longest) + 1):
                    if (s, e) in edges:
                        hit, p = edges[s, e]
                        backward[s][hit] = np.logaddexp(backward[s][hit], self.logp[p] + backward[e][hit])
                backward[s] = np.logaddexp(backward[s], single[s] + backward[s + 1])
                for e in range(s + 1, min(n, s + self.pieces.longest) + 1):
                    if (s, e) in edges:
                        hit, p = edges[s, e]
                        share = np.exp(forward[s][hit] + self.logp[p] + backward[e][hit] - forward[n][hit]) * counts[hit]
                        expected += np.bincount(p, share, self.pieces.size)
                share = np.exp(forward[s] + single[s] + backward[s + 1] - forward[n]) * counts
                for where, b in utf8(codes[:, s]):
                    expected += np.bincount(b[where], share[where], self.pieces.size)
        return forward[n]

    def _long(self, codes: np.ndarray, count: float, expected: np.ndarray | None) -> float:
        """One word: edges of all places at once, then one step a character."""
        n, single = len(codes), self._fallback(codes)
        forward, blocks = [0.0] + [-math.inf] * n, []
        for at in range(0, n, LONG_STEP):
            rows = np.arange(at, min(n, at + LONG_STEP))
            h, found = np.zeros(len(rows), "u8"), []
            for length in range(1, self.pieces.longest + 1):
                inside = rows + length <= n
                rows = rows[inside]
                h = mixed(h[inside], codes[rows + length - 1])
                alive, piece = self.pieces.table.find(h)
                if not len(alive):
                    break
                rows, h = rows[alive], h[alive]
                whole = piece >= 0
                found.append((rows[whole], rows[whole] + length, piece[whole]))
            start, end, piece = (np.concatenate([x[k] for x in found] + [np.zeros(0, "i8")]).astype("i8") for k in range(3))
            order = np.argsort(start, kind="stable")
            start, end, piece = start[order], end[order], piece[order]
            blocks.append((start, end, piece))
            edge, starts, ends, prices, stop = 0, start.tolist(), end.tolist(), self.logp[piece].tolist(), len(start)
            for s, alone in zip(range(at, min(n, at + LONG_STEP)), single[at : at + LONG_STEP].tolist(), strict=True):
                base = forward[s]
                forward[s + 1] = _plus(forward[s + 1], base + alone)
                while edge < stop and starts[edge] == s:
                    forward[ends[edge]] = _plus(forward[ends[edge]], base + prices[edge])
                    edge += 1
        if expected is not None:
            backward = [-math.inf] * n + [0.0]
            for at in range((n - 1) // LONG_STEP * LONG_STEP, -1, -LONG_STEP):
                start, end, piece = blocks[at // LONG_STEP]
                edge, starts, ends, prices = len(start) - 1, start.tolist(), end.tolist(), self.logp[piece].tolist()
                for s in range(min(n, at + LONG_STEP) - 1, at - 1, -1):
                    total = float(single[s]) + backward[s + 1]
                    while edge >= 0 and starts[edge] == s:
                        total = _plus(total, prices[edge] + backward[ends[edge]])
                        edge -= 1
                    backward[s] = total
            f, b = np.asarray(forward), np.asarray(backward)
            for start, end, piece in blocks:
                expected += np.bincount(piece, np.exp(f[start] + self.logp[piece] + b[end] - f[n]) * count, self.pieces.size)
            share = np.exp(f[:-1] + single + b[1:] - f[n]) * count
            for where, byte in utf8(codes):
                expected += np.bincount(byte[where], share[where], self.pieces.size)
        return forward[n]

    def words(self, words: list[bytes], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word; adds the expected piece counts of `counts` words to `expected`."""
        texts = [chr(START) + w.decode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, texts), "i8", len(texts))
        out = np.zeros(len(texts))
        for n in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == n)
            if n > LONG_WORD:
                for i in mine.tolist():
                    out[i] = self._long(np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), "<u4"), 1.0 if counts is None else float(counts[i]), expected)
                continue
            step = max(1, TOGETHER_CHARS // n)
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                codes = np.frombuffer("".join([texts[i] for i in part]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
                out[part] = self._one_length(codes, None if counts is None else counts[part], expected)
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


class Numbers(dict):
    """A number for each word, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(buckets: int) -> object:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        index, ids, held, lengths, codes, tokens = Numbers(), [], [], [], [], 0

        def out() -> pa.RecordBatch:
            words = list(index)
            bucket = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")  # words are numbered anew, bucket by bucket
            place = np.empty(len(words), "<u4")
            place[order] = np.arange(len(words))
            own = place[np.concatenate([*codes, np.zeros(0, "u4")])]
            trained = np.bincount(own[np.repeat(~np.asarray(held, bool), lengths)], minlength=len(words)).astype("<u8")
            present, first = np.unique(bucket[order], return_index=True)
            ends = [*first[1:].tolist(), len(words)]
            parts = list(zip(first.tolist(), ends, strict=False)) if len(words) else []
            ordered, none = order.tolist(), [None] * len(parts)
            columns = [
                [(part << 32) + made] * (1 + len(parts)),
                [None, *present.tolist()][: 1 + len(parts)],
                [ids, *none],
                [held, *none],
                [lengths, *none],
                [packed_numbers(own), *none],
                [None, *(packed_words([words[i] for i in ordered[a:b]]) for a, b in parts)],
                [None, *(packed_numbers(trained[a:b]) for a, b in parts)],
            ]
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in CHUNKS.split(", ")])

        for batch, texts in text_slices(batches):
            for doc_id, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), texts, strict=True):
                words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
                codes.append(np.fromiter(map(index.__getitem__, words), "<u4", len(words)))
                ids.append(doc_id)
                held.append(h)
                lengths.append(len(words))
                tokens += len(words) + 1
                if tokens >= CHUNK_TOKENS or len(index) >= CHUNK_WORDS:
                    yield out()
                    made, index, ids, held, lengths, codes, tokens = made + 1, Numbers(), [], [], [], [], 0
        if ids:
            yield out()

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The different words of a bucket with their training counts, and for each chunk the numbers of its words there."""
    index, codes, trained = Numbers(), [], []
    chunks = table.column("chunk").to_pylist()
    for words, counts in zip(table.column("words"), table.column("trained"), strict=True):
        words = unpacked_words(words.as_py())
        codes.append(np.fromiter(map(index.__getitem__, words), "<u4", len(words)))
        trained.append(unpacked_numbers(counts.as_py(), "<u8"))
    total = np.bincount(np.concatenate(codes), np.concatenate(trained), len(index)).astype("<u8")
    none = [None] * len(chunks)
    columns = {
        "bucket": [table.column("bucket")[0].as_py()] * (1 + len(chunks)),
        "chunk": [None, *chunks],
        "words": [packed_words(list(index)), *none],
        "counts": [packed_numbers(total), *none],
        "codes": [None, *map(packed_numbers, codes)],
        "tokens": [int(total.sum()), *none],
        "kinds": [int((total > 0).sum()), *none],
    }
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), types, strict=True)})


def fit(totals: DataFrame, train_docs: int, path: str | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces from packed (words, counts): only the pieces' expected counts, of bounded number, come to the driver."""
    pieces = pieces_of(path or default_pieces())
    logp = np.log(pieces.first / pieces.first.sum())
    shared = totals.sparkSession.sparkContext
    for _ in range(rounds):
        sent = shared.broadcast(logp)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = pieces_of(path or default_pieces())
            lattice, expected = Lattice(own, sent.value), np.zeros(own.size)
            for batch in batches:
                for packed, counts in zip(batch.column("words"), batch.column("counts"), strict=True):
                    words, n = unpacked_words(packed.as_py()), unpacked_numbers(counts.as_py(), "<u8")
                    lattice.words([words[i] for i in np.flatnonzero(n).tolist()], n[n > 0].astype("f8"), expected)
            piece = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(expected[piece])], ["piece", "n"])

        found = totals.select("words", "counts").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        expected = np.full(pieces.size, ADDED)
        expected[found.column("piece").to_numpy()] += found.column("n").to_numpy()
        expected[-1] += train_docs
        logp = np.log(expected / expected.sum())
    return logp


def lm_score(docs: DataFrame, pieces: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocab_score."""
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())
    chunks = stored(rows.mapInArrow(_chunks(buckets), CHUNKS), "lm-chunks")
    texts = chunks.where("bucket is null")
    merged = stored(chunks.where("bucket is not null").select("chunk", "bucket", "words", "trained").groupBy("bucket").applyInArrow(_merge, MERGED), "lm-words")
    totals = merged.where("chunk is null")
    train_docs = texts.select(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n")).first()["n"] or 0
    tokens, kinds = totals.agg(F.sum("tokens"), F.sum("kinds")).first()
    n_all, v_all = (tokens or 0) + train_docs, (kinds or 0) + (train_docs > 0)
    logp = fit(totals, train_docs, pieces)
    sent = docs.sparkSession.sparkContext.broadcast(logp)  # a number a piece of the vocabulary
    first = pieces_of(pieces or default_pieces()).first
    end_vocab = float(np.log10(first[-1] / first.sum()))

    def price(table: pa.Table) -> pa.Table:
        own = pieces_of(pieces or default_pieces())
        out = {"chunk": [], "counts": [], "logp": [], "vocab_logp": []}
        rows = table.select(["chunk", "codes"]).filter(pc.is_valid(table.column("chunk"))).to_pylist()
        row = table.filter(pc.is_null(table.column("chunk"))).select(["words", "counts"]).to_pylist()[0]
        words, counts = unpacked_words(row["words"]), unpacked_numbers(row["counts"], "<u8")
        fitted = Lattice(own, sent.value).words(words) / LN10
        vocab = Lattice(own, np.log(own.first / own.first.sum())).words(words) / LN10
        for row in rows:
            codes = unpacked_numbers(row["codes"], "<u4")
            out["chunk"].append(row["chunk"])
            for name, values in (("counts", counts), ("logp", fitted), ("vocab_logp", vocab)):
                out[name].append(packed_numbers(values[codes]))
        bucket = pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int32())
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "bucket": bucket, **{k: pa.array(out[k], pa.binary()) for k in ("counts", "logp", "vocab_logp")}})

    priced = merged.select("bucket", "chunk", "words", "counts", "codes").groupBy("bucket").applyInArrow(price, PRICED)
    end_logp, floor = float(logp[-1]) / LN10, float(np.log10(n_all + v_all + 1))
    end_base = float(np.log10(train_docs + 1)) - floor

    def score(chunk: pa.Table, prices: pa.Table) -> pa.Table:
        out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "vocab_score")}
        prices = prices.sort_by("bucket")  # as the chunk's words are numbered
        n, fitted, vocab = (np.concatenate([unpacked_numbers(x.as_py(), kind) for x in prices.column(name)] or [np.zeros(0, kind)]) for name, kind in (("counts", "<u8"), ("logp", "<f8"), ("vocab_logp", "<f8")))
        base, known = np.log10(n + 1.0) - floor, n > 0
        for row in chunk.select(["doc_ids", "held", "lengths", "codes"]).to_pylist():
            lengths, codes = np.asarray(row["lengths"], "i8"), unpacked_numbers(row["codes"], "<u4")
            end = np.cumsum(lengths)
            for a, b in zip((end - lengths).tolist(), end.tolist(), strict=True):
                own = codes[a:b]
                out["n_known"].append(int(known[own].sum()) + (train_docs > 0))
                out["base_score"].append(float(base[own].sum()) + end_base)
                out["score"].append(float(fitted[own].sum()) + end_logp)
                out["vocab_score"].append(float(vocab[own].sum()) + end_vocab)
            out["doc_id"] += row["doc_ids"]
            out["held_out"] += row["held"]
            out["n_tokens"] += (lengths + 1).tolist()
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        arrays = {k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)}
        arrays["train_tokens"] = pa.array([n_all] * len(out["doc_id"]), pa.int64())
        return pa.table({c: arrays[c] for c in (x.split()[0] for x in SCORES.split(", "))})

    texts = texts.select(F.col("chunk").alias("of_chunk"), "doc_ids", "held", "lengths", "codes")
    return texts.groupBy("of_chunk").cogroup(priced.groupBy("chunk")).applyInArrow(score, SCORES)
