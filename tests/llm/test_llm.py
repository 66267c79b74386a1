"""The operators against plain Python on small tables, and on rows that are odd."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import exact_dedup, html_main, langid, licenses, lm_score, mixing, near_dedup, packing, quality, token_counts
from quire.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, digest string, label string, words string"
LONG = "word other words here " * 20_000
LONG_WORD = "abcdefghij" * 20_000 + " " + "é中" * 5_000

ODD = [
    (1, "The quick brown fox jumps over the lazy dog by the river bank today", "en", "a"),
    (2, "The quick  brown\tfox jumps over the lazy dog by the river bank today", "en", "b"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, "The quick brown fox jumps over the lazy dog by the river bank today", "en", "a"),
    (5, "The quick brown fox jumps over the lazy dog by the river bank today", "en", "a"),
    (6, LONG, "en", "b"),
    (None, "no id at all", "fr", None),
    (7, "\x00  <|endoftext|> Ünḯ ΣΑΣ 中文 🙂 All Rights—Reserved CC-BY cc by", None, "c"),
    (8, "one", "de", "c"),
    (9, "\n \t", "de", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "x", "x", "x", "x") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


OPERATORS = [
    exact_dedup.exact_dedup,
    lm_score.lm_score,
    near_dedup.near_dedup,
    token_counts.token_counts,
    mixing.mix,
    quality.quality,
    packing.pack,
    langid.identify,
    licenses.license_scan,
]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_odd_and_empty_tables(odd, empty, operator):
    assert operator(empty).count() == 0
    rows = operator(odd).collect()
    if operator is not packing.pack:
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_very_long_words(odd, operator):
    """A word of 200,000 characters gets its row like any other."""
    long_word = odd.sparkSession.createDataFrame([(10, LONG_WORD, "de", "c", 0, "x", "x", "x", "x")], SCHEMA)
    rows = operator(odd.where("doc_id = 1").unionByName(long_word)).collect()
    assert {r["doc_id"] for r in rows} == {1, 10}


CARRIERS = {
    "drop_repeats": exact_dedup.drop_repeats,
    "keep_one": near_dedup.keep_one,
    "mixture": mixing.mixture,
    "keep_good": quality.keep_good,
}


@pytest.mark.parametrize("name", CARRIERS)
def test_carriers_keep_columns_of_any_name(odd, name):
    """Columns with names that the operators might use come out as they went in, of odd and repeated rows too."""
    names = ["__key", "__gone", "__digest", "__id", "own_0", "OWN_1", "own_2", "own_3", "key", "bucket", "node", "lang_key"]
    long_word = odd.sparkSession.createDataFrame([(10, "x" * 200_000 + " " + "yz" * 30_000, "de", "c", 0, "x", "x", "x", "x")], SCHEMA)
    clashing = odd.unionByName(long_word).select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("text"), F.lit(""))).alias(n) for n in names])
    out = CARRIERS[name](clashing)
    assert out.columns == clashing.columns
    for r in out.collect():
        assert all(r[n] == f"{n}:{r['text'] or ''}" for n in names)


def folded(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(odd):
    rows = exact_dedup.exact_dedup(odd).collect()
    by_text = defaultdict(list)
    for r in ODD:
        by_text[folded(r[1])].append(r[0])
    for r in rows:
        group = next(ids for t, ids in by_text.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        known = [i for i in group if i is not None]
        assert (r["keep_id"], r["group_size"]) == (min(known, default=None), len(group))
    assert sum(r["kept"] for r in rows) == len(by_text)
    kept = exact_dedup.drop_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(by_text)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    digests = rng.bytes(32 * 5000)
    levels, slot = exact_dedup.build_hash(digests)
    assert sorted(slot.tolist()) == list(range(5000))
    assert (exact_dedup.look_up(levels, digests) == slot).all()
    assert exact_dedup.build_hash(b"") [0] == []
    assert (exact_dedup.look_up(levels, rng.bytes(32 * 100)) < 5000).all()


def lower(text):
    return (text or "").encode().lower()


def test_lm_base(docs, texts):
    train = Counter()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    for d, t in texts.items():
        if not held[d]:
            train.update([*lower(t).split(), None])
    n, v = sum(train.values()), len(train)
    for r in lm_score.lm_score(docs).collect():
        tokens = [*lower(texts[r["doc_id"]]).split(), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens))
        assert r["score"] < 0


def test_lattice_sums_all_segmentations():
    pieces = lm_score.pieces_of(lm_score.default_pieces())
    logp = np.log(pieces.first / pieces.first.sum())
    lattice = lm_score.Lattice(pieces, logp)
    for word in (b"the", "éa中".encode(), b"", b"%%"):
        text = chr(lm_score.START) + word.decode()
        total = 0.0
        for cuts in product((0, 1), repeat=len(text) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            ways = 1.0
            for a, b in zip(at, at[1:], strict=False):
                part = text[a:b]
                _, piece = pieces.table.find(lm_score.hashed(np.asarray([[ord(c) for c in part]])))
                p = math.exp(logp[piece[0]]) if len(piece) and piece[0] >= 0 else 0.0
                if len(part) == 1:
                    p += math.exp(sum(logp[x] for x in part.encode()))
                ways *= p
            total += ways
        expected = np.zeros(pieces.size)
        assert lattice.words([word], np.ones(1), expected)[0] == pytest.approx(math.log(total))
        assert expected.sum() > 0


def packed_totals(spark, counts):
    """(words, counts) rows as the operator packs them, in three buckets."""
    rows = []
    for k in range(3):
        part = [(w, n) for i, (w, n) in enumerate(sorted(counts.items())) if i % 3 == k]
        rows.append((bytearray(lm_score.packed_words([w for w, _ in part])), bytearray(lm_score.packed_numbers(np.asarray([n for _, n in part], "<u8")))))
    return spark.createDataFrame(rows, "words binary, counts binary")


def test_lm_learns(spark, texts):
    counts = Counter(w for t in texts.values() for w in (t or "").encode().split())
    words, n = list(counts), np.asarray(list(counts.values()))
    pieces = lm_score.pieces_of(lm_score.default_pieces())
    totals = packed_totals(spark, counts)
    scores = [float((lm_score.Lattice(pieces, lm_score.fit(totals, 200, rounds=k)).words(words) * n).sum()) for k in (0, 1, 2)]
    assert scores[0] < scores[1] < scores[2]


def test_lm_packing_round_trip():
    rng = np.random.default_rng(2)
    for kind in ("<u4", "<u8", "<f8"):
        for n in (0, 1, 1000):
            values = (rng.random(n) * 1e6).astype(kind)
            assert (lm_score.unpacked_numbers(lm_score.packed_numbers(values), kind) == values).all()
    assert lm_score.unpacked_words(lm_score.packed_words([b"a", b"\xff\x00", b"bc"])) == [b"a", b"\xff\x00", b"bc"]


def test_lm_documents_against_plain_python(spark, docs, texts, monkeypatch):
    """Chunks of few tokens and many buckets; each text is the sum over its words and one end."""
    train = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in lower(t).split())
    n_train = sum(zlib.crc32(str(d).encode()) % 7 != 2 for d in texts)
    pieces = lm_score.pieces_of(lm_score.default_pieces())
    fitted = lm_score.Lattice(pieces, lm_score.fit(packed_totals(spark, train), n_train))
    first = lm_score.Lattice(pieces, np.log(pieces.first / pieces.first.sum()))
    monkeypatch.setattr(lm_score, "CHUNK_TOKENS", 2000)
    words = sorted({w for t in texts.values() for w in lower(t).split()})
    price = {name: dict(zip(words, lattice.words(words).tolist(), strict=True)) for name, lattice in (("score", fitted), ("vocab_score", first))}
    ends = {"score": fitted.logp[-1], "vocab_score": first.logp[-1]}
    for r in lm_score.lm_score(docs).collect():
        for name, of in price.items():
            assert r[name] == pytest.approx((sum(of[w] for w in lower(texts[r["doc_id"]]).split()) + ends[name]) / math.log(10), rel=1e-9)


def test_lattice_of_a_long_word_is_the_same(monkeypatch):
    pieces = lm_score.pieces_of(lm_score.default_pieces())
    lattice = lm_score.Lattice(pieces, np.log(pieces.first / pieces.first.sum()))
    words = [b"thequickbrownfox" * 3, "éa中🙂".encode() * 9, b"x" * 50]
    got = []
    for longest, step in ((256, 100_000), (8, 100_000), (8, 7)):
        monkeypatch.setattr(lm_score, "LONG_WORD", longest)
        monkeypatch.setattr(lm_score, "LONG_STEP", step)
        expected = np.zeros(pieces.size)
        got.append((lattice.words(words, np.asarray([2.0, 1.0, 3.0]), expected), expected))
    for price, expected in got[1:]:
        assert price == pytest.approx(got[0][0])
        assert expected == pytest.approx(got[0][1])


def shingles(text, n):
    w = lower(text).split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(sets, percent):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in sets}


def test_near_dedup_of_rows_that_share_an_id(spark):
    """Each text of an id has its own links, and one that is linked with nothing stays beside one that goes."""
    text = lambda name, *changed: " ".join(f"{name}{i}" + "x" * (i in changed) for i in range(100))
    rows = [(5, text("a")), (6, text("a", 0)), (5, text("b")), (7, text("b", 99)), (5, text("c")), (4, text("c", 0)), (8, text("d")), (8, text("d", 0)), (5, text("e")), (9, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.link(table).collect()}
    assert got == {(5, 5), (6, 5), (7, 5), (5, 4), (4, 4), (8, 8), (9, 9)}
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.keep_one(table, 3, 85).collect()]
    of_eight = [r for r in kept if r[0] == 8]
    assert len(of_eight) == 1 and of_eight[0] in rows
    assert sorted(r for r in kept if r[0] != 8) == sorted([(4, text("c", 0)), (5, text("a")), (5, text("b")), (5, text("e")), (9, "")])


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(docs, texts, n, percent):
    sets = {d: shingles(t, n) for d, t in texts.items()}
    want = linked(sets, percent)
    for r in near_dedup.near_dedup(docs, n, percent).collect():
        d = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), want[d], want[d] == d)


def test_near_dedup_of_a_chain_and_a_star(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):  # each differs a little from the one before, the ends differ much
        w = list(words)
        w[: 4 * i] = [f"x{k}" for k in range(4 * i)]
        rows.append((i, " ".join(w)))
    for i in range(100, 160):  # copies of one text, less like each other than like it
        w = [f"s{k}" for k in range(300)]
        if i > 100:
            for k in range(3):
                w[(i * 37 + k * 71) % 300] = f"c{i}x{k}"
        rows.append((i, " ".join(w)))
    rows.append((500, None))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked({d: shingles(t, 3) for d, t in rows}, 85)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(table).collect()} == want
    assert near_dedup.keep_one(table, 3, 85).count() == len(set(want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (300, 100)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


def test_token_counts(docs, texts, odd):
    tokenizer = library()
    for table, of in ((docs, texts), (odd.where("doc_id is not null"), {r[0]: r[1] for r in ODD})):
        for r in token_counts.token_counts(table).collect():
            t = of[r["doc_id"]] or ""
            n = len(tokenizer.encode(t, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_long_words_as_the_library(monkeypatch):
    tokenizer = library()
    words = [LONG_WORD, "x" * 100_000, "ab" * 200, "Ünḯ" * 300, "'" * 400, "1234" * 100, "a" * 256, "a" * 257]
    counts, own = token_counts.merger(token_counts.default_vocabulary()), packing.Encoder(token_counts.default_vocabulary())
    for limit in (packing.MEMORY_BYTES, 300):
        monkeypatch.setattr(packing, "MEMORY_BYTES", limit)
        for some in (words[:3], words[2:], [w + " and " + w for w in words], words):
            expected = [tokenizer.encode(w, add_special_tokens=False).ids for w in some]
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([w.encode() for w in some])] == expected
            assert [counts.count(w.encode()) for w in some] == list(map(len, expected))
    assert max(map(len, counts.by_word), default=0) < token_counts.SHORT


def test_encoder_holds_little():
    own, words = packing.Encoder(token_counts.default_vocabulary()), ["".join(x) for x in product("etaoinshrdlucm", repeat=5)]
    own.encode([b"The quick brown fox, of 1 and 22 dogs."])
    assert "tokenizer" not in vars(own)  # the library is for other pieces
    for at in (0, 150_000, 300_000):
        own.encode([" ".join(words[at : at + 150_000]).encode()])
        assert max(len(own.known), len(own.older), len(own.by_word)) <= 200_000
    again = b"<|endoftext|> " + " ".join([*words[:50], "e" * 300, *words[-50:]]).encode()
    assert own.encode([again])[0] == np.asarray(library().encode(again.decode(), add_special_tokens=False).ids, "<u4").tobytes()
    assert "tokenizer" in vars(own)


def test_merges_look_up_new_pairs_alone(monkeypatch):
    """What is looked up grows with the merges, not with the symbols times the steps; ids are the library's."""
    tokenizer, own, looked_up = library(), packing.Encoder(token_counts.default_vocabulary()), []
    get = packing.PairTable.get
    monkeypatch.setattr(packing.PairTable, "get", lambda self, keys, *rest: looked_up.append(len(keys)) or get(self, keys, *rest))
    words = ["a", "é", "$", "thether", *("".join(random.Random(i).choices("etaoné", k=i % 60 + 1)) for i in range(300))]
    ids = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.merge([w.encode() for w in words])] == ids
    assert sum(looked_up) <= sum(3 * len(w.encode()) for w in words)
    assert own.merge([]) == []


def test_packing(docs, texts):
    tokenizer, place = library(), defaultdict(list)
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    for r in packing.pack(docs).collect():
        own = ids[r["doc_id"]]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(own)
        assert zlib.crc32(np.asarray(piece, "<u4").tobytes()) == r["ids_crc32"]
        place[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"], r["start"]))
    assert sorted(place) == list(range(len(place)))
    covered = Counter()
    for s, pieces in place.items():
        at = 0
        for offset, length, d, _ in sorted(pieces):
            assert offset == at
            at += length
            covered[d] += length
        assert at == 4096 or s == len(place) - 1 and at <= 4096
    assert covered == {d: len(x) for d, x in ids.items()}


def test_mixing(odd, docs):
    rows = docs.select("doc_id", "source", "text").join(mixing.mix(docs), "doc_id").collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == again[r["doc_id"]]
        sizes[r["source"]] += r["size"]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, left = {}, dict(weights)
    while left:
        level = (sum(sizes.values()) - sum(target.values())) / sum(left.values())
        full = [s for s in left if level * left[s] >= 3 * sizes[s]]
        for s in full or list(left):
            target[s] = 3 * sizes[s] if full else level * left[s]
            del left[s]
    taken = defaultdict(int)
    for r in rows:
        assert (r["source_size"], r["target"]) == (sizes[r["source"]], pytest.approx(target[r["source"]]))
        taken[r["source"]] += r["taken"]
    largest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest / 2 for s in sizes)
    mixed = mixing.mixture(odd)
    assert mixed.columns == odd.columns


def test_mixing_offers_until_nothing_fits(spark):
    """No document that would fit is left out while the ranking is gone through: as a walk over it in plain Python."""
    rng = random.Random(7)  # two sources take more than three offers
    rows = [(i, "w " * int(4096 ** rng.random()), f"s{i % 3}") for i in range(150)]
    of = defaultdict(list)
    for r in mixing.drawn(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        of[r["source_key"]].append(r)
    assert len(of) == 3
    for rows in of.values():
        need, got = rows[0]["target"] - rows[0]["whole"] * rows[0]["source_size"], set()
        order = sorted((r for r in rows if r["rank_odds"] is not None), key=lambda r: (r["rank_odds"], r["key"]))
        for r in order:
            if r["words"] <= need:
                got.add(r["key"])
                need -= r["words"]
        rest = [(abs(r["words"] - need), r["rank_odds"], r["key"]) for r in order if r["key"] not in got and abs(r["words"] - need) < need]
        got |= {min(rest)[2]} if rest else set()
        assert {r["key"] for r in rows if r["times"] > r["whole"]} == got


def test_quality_base(docs, texts):
    def repeats(w):
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})

    def dups(t):
        seen, n = set(), 0
        for line in t.split("\n"):
            n += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
            seen.add(line)
        return n

    for r in quality.quality(docs).collect():
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups(t), repeats(w))
        assert r["base_failed"] == (len(w) < 20 or 100 * r["n_repeat_words"] > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_clean_and_rejects_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    rows = [r for r in docs.collect() if not judged[r["doc_id"]]["base_failed"]]
    noisy = [r["doc_id"] for r in rows if len(re.findall(r"(%%%|&&&|\*\*\*|\$\$\$|###)", r["text"])) > 0.5 * len(r["text"].split())]
    plain = [r["doc_id"] for r in rows if judged[r["doc_id"]]["n_symbols"] == 0]
    assert sum(judged[d]["kept"] for d in noisy) <= 0.1 * len(noisy) and len(noisy) > 20
    assert sum(judged[d]["kept"] for d in plain) >= 0.995 * len(plain)


def test_quality_band_holds_against_junk(docs, spark):
    """A third of a language is junk with one text more often than others, and a few texts of frequent words only are too easy."""
    rng = np.random.default_rng(3)
    clean = [(r["doc_id"], r["text"]) for r in docs.where("lang = 'en' and not text rlike '[#*$%&|<>]'").select("doc_id", "text").collect()]
    marks = ["%%%", "&&&", "***", "$$$", "###", "<|>"]
    junk = [(-10_000 - i, " ".join("".join(rng.choice(list("qxzjkvw#%&*"), 5)) + rng.choice(marks) for _ in range(40 + i % 60))) for i in range(len(clean) // 2)]
    junk += [(-20_000 - i, junk[0][1]) for i in range(len(clean) // 4)]
    easy = [(-30_000 - i, " ".join(rng.choice(["the", "of", "and", "in", "to", "er"], 400))) for i in range(3)]
    rows = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame([(d, t, "en") for d, t in clean + junk + easy], "doc_id long, text string, lang string")).collect()}
    assert not any(rows[d]["base_failed"] for d, _ in junk + easy)
    assert not any(rows[d]["kept"] for d, _ in junk)
    assert not any(rows[d]["kept"] for d, _ in easy)
    assert all(rows[d]["kept"] for d, _ in clean if not rows[d]["base_failed"])


class PlainKneserNey:
    """The model of one language by dictionaries; grams holds counts of 5-grams."""

    def __init__(self, grams, languages, kept):
        self.counts = {5: dict(grams)}
        for k in (4, 3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.least = {}, {}
        for k, counts in self.counts.items():
            n = [max(1, sum(c == j for c in counts.values())) for j in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            self.d[k] = [0, *(min(max(j + 1 - (j + 2) * y * n[j + 1] / n[j], 0.1), j + 0.9) for j in range(3))]
            self.least[k] = languages * sum(counts.values()) / kept
        self.total, self.mass = defaultdict(int), defaultdict(float)
        for k, counts in self.counts.items():
            for g, c in counts.items():
                self.total[k, g[:-1]] += c
                if c >= self.least[k]:
                    self.mass[k, g[:-1]] += c - self.d[k][min(c, 3)]

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.counts[1]) + 1)
        c, context, more = self.counts[k].get(gram, 0), (k, gram[:-1]), self.p(gram[1:])
        if context not in self.mass:
            return more
        own = (c - self.d[k][min(c, 3)]) / self.total[context] if c and c >= self.least[k] else 0
        return own + max(1 - self.mass[context] / self.total[context], 1e-9) * more


def streams(words):
    return "    " + " ".join(words) + " " if words else ""


def grams_of(texts):
    return Counter(s[i : i + 5] for s in map(streams, texts) for i in range(len(s) - 4))


@pytest.mark.parametrize("kept", [2_000_000, 2_000])
def test_quality_model_against_plain_python(docs, texts, monkeypatch, kept):
    """Each language's model is of its own different texts, also beside larger ones and where rare n-grams aren't kept."""
    monkeypatch.setattr(quality, "KEPT", kept)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    models = {x: PlainKneserNey(grams_of(t.split() for t in {texts[d] for d in texts if lang[d] == x}), len(set(lang.values())), kept) for x in set(lang.values())}
    seen = {}
    for r in quality.judge(docs).collect():
        s = streams(texts[r["doc_id"]].split())
        want = 0.0
        for i in range(len(s) - 4):
            key = lang[r["doc_id"]], s[i : i + 5]
            if key not in seen:
                seen[key] = math.log(models[key[0]].p(key[1]))
            want += seen[key]
        assert r["log_ppl"] == pytest.approx(-want / max(1, len(texts[r["doc_id"]].split())), rel=1e-4)


@pytest.mark.parametrize(("held", "kept"), [(2_000_000, None), (300, None), (0, None), (300, 2_000)])
def test_quality_model_is_whole_whatever_is_held(spark, monkeypatch, held, kept):
    """A long text beside short ones takes nothing from the model, and what the tasks don't hold is joined."""
    monkeypatch.setattr(quality, "HELD", held)
    if kept:
        monkeypatch.setattr(quality, "KEPT", kept)
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(1, 9))))
    rows = [(i, " ".join(word() for _ in range(400)), f"l{i // 2}") for i in range(6)]
    rows += [(900, rows[0][1], "l0"), (901, rows[0][1], "l0"), (902, "", "l0"), (903, None, "l0"), (904, "é" * 5000 + " 🙂", "l1")]
    if held == 2_000_000:  # a share of 3 in 2,000,000 of its 5-grams is more than one
        rows.append((950, " ".join(rng.choice([word() for _ in range(30)], 200_000)), "l0"))
    by_lang = defaultdict(set)
    for _, t, lang in rows:
        by_lang[lang].add(t or "")
    checked = ("l0", "l1")
    models = {x: PlainKneserNey(grams_of(t.split() for t in by_lang[x]), len(by_lang), kept or math.inf) for x in checked}
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        if lang not in checked:
            continue
        s, of_word, known = streams((t or "").split()), [0.0], {}
        for k in range(len(s) - 4):
            gram = s[k : k + 5]
            if gram not in known:
                known[gram] = math.log(models[lang].p(gram))
            of_word[-1] += known[gram]
            if gram[-1] == " ":
                of_word.append(0.0)
        n = max(1, len(of_word) - 1)
        assert got[i]["log_ppl"] == pytest.approx(-sum(of_word) / n, rel=1e-4)
        assert got[i]["word_var"] == pytest.approx(max(0, sum(x * x for x in of_word) / n - (sum(of_word) / n) ** 2), rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("kept", [2_000_000, 30])
def test_kneser_ney_sums_to_one(spark, monkeypatch, kept):
    monkeypatch.setattr(quality, "KEPT", kept)
    rows = [("l", "aba ab ca bac aba bac bac aba"), ("l", "ab ab cab"), ("m", "xyz zyx xx yy")]
    number, model = quality.train(spark.createDataFrame(rows, "lang string, text string"))
    for lang, letters in (("l", "abc "), ("m", "xyz ")):
        for context in product(letters + "?", repeat=4):
            codes = [np.asarray([ord(x) for x in "".join(context) + last], "<u4") for last in letters + "!"]
            assert sum(math.exp(model.stream(number[lang], c)[-1]) for c in codes) == pytest.approx(1, abs=1e-5)


def test_gram_counts_of_many_characters():
    """More characters than a key can hold: counts come out in parts."""
    rng = np.random.default_rng(4)
    texts = [[chr(0x4E00 + int(x)) for x in rng.integers(0, 9000, 3000)], ["ab", "𝒳𝒴", "ab"], []]
    codes, sizes = quality.streamed([[w.encode() for w in t] for t in texts])
    held, got = quality.GramCounts(), Counter()
    for _ in range(2):
        for batch in [*held.add("x", codes, quality.characters(sizes)), *held.flush()]:
            for r in batch.to_pylist():
                got[r["gram"]] += r["n"]
    assert got == Counter({g: 2 * n for g, n in grams_of(texts).items()})


def test_sorted_hashes():
    rng = np.random.default_rng(6)
    keys = np.unique(np.r_[rng.integers(0, 1 << 64, 5000, dtype="u8"), np.arange(50, dtype="u8")])
    table = quality.Sorted(keys[::-1].copy(), np.arange(len(keys))[::-1].copy())
    assert (table.get(keys) == np.arange(len(keys), dtype="f4")).all()
    assert np.isnan(table.get(keys[keys > 100] + np.uint64(1))).all()
    assert np.isnan(quality.Sorted(keys[:0], np.zeros(0)).get(keys[:9])).all()


def test_langid(docs, odd):
    rows = docs.select("doc_id", "lang").join(langid.identify(docs), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    of = defaultdict(set)
    for r in langid.identify(odd).collect():
        of[r["doc_id"]].add(r["lang_pred"])
    assert of[3] == of[4] == of[9] == {"und"} and "und" not in of[1]


def test_langid_against_plain_python(docs):
    """Counts, frequencies, backoff and sums by dictionaries and loops."""
    rows = docs.select("doc_id", "text", "lang").collect()
    counts = {"word": Counter(), "gram": Counter()}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            for w in map(langid.clean, r["text"].encode().split()):
                if any(c.isalpha() for c in w):
                    counts["word"][r["lang"], w] += 1
                    padded = f" {w} "
                    counts["gram"].update((r["lang"], padded[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(padded) - k + 1))
    languages = sorted({r["lang"] for r in rows})
    price = {}
    for kind, found in counts.items():
        found = {k: n for k, n in found.items() if n >= langid.LEAST_COUNT}
        items = {x for _, x in found}
        total = Counter()
        for (lang, _), n in found.items():
            total[lang] += n
        price[kind] = {x: [math.log((1 - langid.UNIFORM) * found.get((lang, x), 0) / max(1, total[lang]) + langid.UNIFORM / (len(items) + 1)) for lang in languages] for x in items}

    def word(w):
        if w in price["word"]:
            return price["word"][w]
        padded, places = f" {w} ", []
        for i in range(len(padded)):
            hit = next((padded[i : i + k] for k in (4, 3, 2, 1) if i + k <= len(padded) and padded[i : i + k] in price["gram"]), None)
            if hit:
                places.append(price["gram"][hit])
        return [sum(p[k] for p in places) / len(places) for k in range(len(languages))] if places else [0.0] * len(languages)

    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for r in rows:
        words = [w for w in map(langid.clean, r["text"].encode().split()) if any(c.isalpha() for c in w)]
        mean = np.mean([word(w) for w in words], axis=0) if words else None
        if mean is None:
            assert got[r["doc_id"]]["lang_pred"] == "und"
        else:
            assert got[r["doc_id"]]["lang_pred"] == languages[int(mean.argmax())]
            assert got[r["doc_id"]]["score"] == pytest.approx(1 / np.exp(mean - mean.max()).sum(), abs=1e-4)


def test_langid_of_many_languages(spark):
    """Each of 600 languages is learned, a word alone or from its parts; a language of one text wins nothing it hasn't seen."""
    rows = [(i * 10 + k, f"wa{i}x{chr(97 + i % 26)}q tok{i}en wa{i}x{chr(97 + i % 26)}q tok{i}en".replace("0", "o").replace("1", "l"), f"l{i}") for i in range(600) for k in range(4)]
    rows.append((99_999, "zz zz", "rare"))
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    of = {d: lang for d, _, lang in rows}
    assert sum(r["lang_pred"] == of[r["doc_id"]] for r in got) >= 0.9 * len(got)


def test_licenses(docs, texts, spark):
    cases = [
        (1, "Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
        (2, "SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        (3, "released under the MIT License", "mit"),
        (4, "GNU General Public License, version 3", "gpl,gpl-3.0"),
        (5, "nothing to see: ccby, accs by", ""),
        (6, "CC BY cc--by ALL rights\nreserved", "cc-by,reserved"),
        (7, "the BSD 3-Clause License", "bsd-3-clause"),
    ]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")).collect()}
    assert {d: r["labels"] for d, r in got.items()} == {c[0]: c[2] for c in cases}
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (3, 0, 4)
    assert len(licenses.rules()) > 200
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in licenses.license_scan(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(upper))
        at = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in licenses.PHRASES}
        places = [i for x in at.values() for i in x]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(licenses.PHRASES[p] for p, x in at.items() if x))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licenses_across_breaks(spark):
    cases = [
        ("released into the public\ndomain", "public-domain"),
        ("Creative\nCommons Attribution", "cc-by"),
        ("Creative_Commons -- Zero", "cc0"),
        ("MIT_0", "mit-0"),
        ("the MIT\t0", "mit-0"),
        ("MIT No\nAttribution", "mit-0"),
        ("Tous droits\nreserves", "reserved"),
        ("Tous_droits réservés", "reserved"),
        ("alle Rechte\nvorbehalten", "reserved"),
        ("Redistribution and use in\nsource and binary forms, with or without\nmodification, are permitted", "bsd"),
        ("a public place, domain of none", ""),
        ("Copyright © 2020 Foo", "copyright"),
        ("Copyright (c) 2019, 2020 Foo", "copyright"),
        ("Apache-2.0", "apache-2.0"),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"),
        ("SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause) OR MIT", "bsd-3-clause,gpl-2.0,mit"),
        ("under LGPL-2.1", "lgpl-2.1"),
        ("GPLv3", "gpl-3.0"),
        ("LGPLv2.1+ or MPLv2.0", "lgpl-2.1,mpl-2.0"),
        ("Unauthorized copying of this file, via any medium, by any person or company whatsoever and for whatever reason is strictly prohibited", "proprietary"),
        ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
    ]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(len(cases))] == [want for _, want in cases]
    assert all((got[i]["n_detections"] > 0) == (got[i]["score"] > 0) == bool(want) for i, (_, want) in enumerate(cases))


def test_licenses_against_plain_python(spark, texts):
    """Every rule tried on every text, with no gate and no keyword, and suppression by loops."""
    import regex

    cases = [
        "Licensed under the Apache License, Version 2.0. See LICENSE. SPDX-License-Identifier: Apache-2.0 OR MIT",
        "Released under the terms of the GNU Lesser General Public License v 2.1, and the Mozilla Public License version 2.0; all rights reserved",
        "This is free and unencumbered software released into the public domain. the Unlicense",
        "CC BY-NC-SA 4.0 / creativecommons.org/licenses/by-nc-sa/4.0 Creative Commons Attribution-NonCommercial 3.0 CC0 1.0",
        "Copyright 2001 2002 by X. All rights are reserved. May not be copied without prior written permission. Confidential and proprietary",
        "BSD 3-Clause License, New BSD License, BSD license; Neither the name of X nor others may be used to endorse or promote products",
        *(t for t in texts.values() if t),
    ]
    rules = [(label, regex.compile(f"(?<= )(?:{pattern})(?= )"), rank) for label, _, pattern, rank, _ in licenses.rules()]
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    for r in rows:
        words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", cases[r["doc_id"]].translate(upper))) + " "
        found = {(m.start(), m.end(), rank, label) for label, pattern, rank in rules for m in pattern.finditer(words)} if len(words) < 3000 or r["labels"] else set()
        kept = [x for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and (y[2] < x[2] or y[2] == x[2] and y[1] - y[0] > x[1] - x[0]) for y in found)]
        base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in words}
        assert r["labels"] == ",".join(sorted(base | {x[3] for x in kept}))
    assert len({pattern for _, _, pattern, _, _ in licenses.rules()}) > 500


PAGES = [
    ("<article><h1>T &amp; t</h1><p>a\n  b<br>c<p>d <i>e</i></article><footer>f</footer>", "T & t\na b c\nd e"),
    ("<body><header>Site</header><nav>menu</nav><main><p>x</p><aside>side</aside><form>f</form></main></body>", "x"),
    ("<div class='cookie-notice'>ok?</div><div id=content><p>one</p><div class='ad-slot'>buy</div><ul><li>two</li></ul></div><section id='comments'><p>me</p></section>", "one\ntwo"),
    ("<script>var a = '<p>no</p>';</script><p>yes</p><!-- <p>no</p> --><style>p{}</style>", "yes"),
    ("<article><p>unclosed <b>bold", "unclosed bold"),
    (None, ""),
    ("", ""),
    ("just text &lt;3 &#233;", "just text <3 é"),
    ("<article><header><h1>H</h1><p>by me</p></header><p>x</p><div class=share>tweet</div><footer>tags</footer></article>", "H\nx"),
    ("<div class='page has-sidebar'><div class='post'><p>kept</p></div><div id=sidebar>links</div></div>", "kept"),
    ("<article><div class='entry-header'><h1>H</h1><span>by me</span></div><p>x</p></article>", "H\nx"),
]


def test_html_main(spark, sf):
    table = spark.createDataFrame([(i, f"https://h{i}.example/", p, "x") for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html_main.main_text(table).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))
    assert html_main.main_text(table.where("false")).count() == 0


def test_html_main_learns_a_site(spark):
    """Boxes that a site's pages share go, though no tag or class gives them away."""
    rows = [(i, "http://a.example/x", f"<body><div class=q1><p>Welcome to the site</p></div><div class=q2><p>story {i} about {i * 7}</p><p>The end {i}.</p></div><div class=q3>Call us</div></body>") for i in range(30)]
    rows.append((100, None, rows[0][2]))
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 about 21\nThe end 3."
    assert got[100].startswith("Welcome")


WRAPPED = [
    ("<div class='content-sidebar-wrap'><main><article><p>one text</p></article></main><aside>s</aside></div>", "one text"),
    ("<div class='content-sidebar-wrap'><article><p>one text</p></article><div class=sidebar>links</div></div>", "one text"),
    ("<div class='main-content right-sidebar'><div><p>a text of some length that is the page's own</p></div><div class=sidebar><p>links</p></div></div>", "a text of some length that is the page's own"),
    ("<div class='content-with-sidebar'><p>kept</p></div><div id=comments><p>a longer comment than text</p></div>", "kept"),
    ("<div class='elementor-element elementor-widget elementor-widget-text-editor'><div class='elementor-widget-container'><p>one</p></div></div><div class='elementor-widget elementor-widget-theme-post-content'><p>two</p></div>", "one\ntwo"),
    ("<div class='overflow-hidden'><p>kept</p></div>", "kept"),
    ("<div class='menu-open search'><div itemprop=articleBody><p>kept</p></div><p>other</p></div>", "kept"),
    ("<div class=post><p>the text of a post</p></div><div class=sidebar><article><p>teaser</p></article></div><div class=comments><article><p>a comment that is longer than the post</p></article></div>", "the text of a post"),
]


def test_html_main_wrappers():
    for page, want in WRAPPED:
        assert html_main.Page().walk(page).main_text() == want


def test_html_main_tree_by_pieces(spark):
    """A menu goes though one of its links differs on each page; a byline that differs stays, and articles side by side do."""
    page = "<body><div class=q1><a href=/a>One</a><a href=/b>Two</a><a href=/c>Three</a><a href=/p{0}>Page {0}</a></div><div class=q2><span>by {0}</span><p>story {0} about {0}</p></div></body>"
    rows = [(i, "http://a.example/", page.format(i)) for i in range(40)]
    rows.append((100, "http://b.example/", "<main><article><p>the first part of it</p></article><article><p>the second part</p></article><article><p>ad</p></article></main>"))
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "by 7\nstory 7 about 7"
    assert got[100] == "the first part of it\nthe second part"


@pytest.mark.parametrize(
    "page",
    ["<![CDATA[" * 50_000 + "x", "<![CDATA[ a > b ]]>" * 20_000, "<b>" * 20_000 + "<li>" * 20_000, "<p><ul>" + "<b>" * 20_000 + "<li>y" * 20_000, "<b>" * 20_000 + "x" + "</b>" * 20_000, "<a" * 100_000, "<!" * 100_000, "<p>" + "word " * 200_000, "<!--" + "x" * 500_000],
    ids=["cdata", "cdata-closed", "b-li", "ul-b-li", "nested", "open", "bogus", "long", "comment"],
)
def test_html_main_takes_linear_time(page):
    began = time.process_time()
    html_main.Page(counting=True).walk(page)
    html_main.Page().walk(page).main_text()
    assert time.process_time() - began < 15


def test_html_main_copies_count_once(spark):
    page = "<body><div class=content><p>story {0} about {0}</p></div><div class=q3>Call us</div></body>"
    inside = "<article><div class='entry-content'><p>the only page</p></div></article>"
    rows = [(i, "http://a.example/", page.format(1)) for i in range(60)] + [(100 + i, "http://a.example/", page.format(50 + i)) for i in range(10)]
    rows += [(200 + i, "http://b.example/", inside) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "story 1 about 1" and got[103] == "story 53 about 53"
    assert got[205] == "the only page"


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns
        kept.append(spark.createDataFrame(out.toArrow()))
    ids = [Counter(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]
    assert ids[1] == Counter(r["doc_id"] for r in quality.quality(kept[0]).where("kept").collect())
    assert ids[2] == Counter(r["doc_id"] for r in exact_dedup.exact_dedup(kept[1]).where("kept").collect())
    of = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    want = linked({d: shingles(t, 5) for d, t in of.items()}, 80)
    assert ids[3] == Counter(set(want.values()))
    assert ids[4] == Counter({r["doc_id"]: r["times"] for r in mixing.mix(kept[3]).where("times > 0").collect()})
    pieces = pipeline.run(spark, sf).collect()
    once = {d: sum(n for i, n in Counter((r["start"], r["length"]) for r in pieces if r["doc_id"] == d).items()) for d in list(ids[4])[:5]}
    assert all(once.values())
    tokens = Counter()
    for r in pieces:
        tokens[r["doc_id"]] += r["length"]
    size = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert tokens == Counter({d: size[d] * n for d, n in ids[4].items()})


def test_pipeline_on_odd_and_empty_tables(odd, empty, spark, tmp_path):
    import corpus_pipeline as pipeline

    plain = "Some sentences of plain words follow one another here, and none of them is said twice by the person who wrote this page for us all to read today."
    more = spark.createDataFrame([(100 + i, f"{plain} It is page {i}.", "en", "a" if i % 2 else None, 0, "x", "x", "x", "x") for i in range(30)], SCHEMA)
    for name, table in (("odd", odd.unionByName(more)), ("empty", empty)):
        table.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        pieces = pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert (len(pieces) > 0) == (name == "odd")
        assert {r["doc_id"] for r in pieces} <= {r["doc_id"] for r in table.collect()}


def test_sql_names_registered_queries():
    from quire.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))
    json.dumps(queries.oracle_sql())
